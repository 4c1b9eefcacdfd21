"""Repeated rows, null ids, long texts and clashing names; chat repairs and fingerprints against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import audio, chat, langid, lm, mixing, pieces, simhash, toxicity

CLASH = ("id", "row", "word", "piece", "n", "f", "fp", "score", "lang_pred", "component", "block", "place", "part", "parts", "slot", "keys", "learned", "ids")
LONG = "A long, long text about Nothing at all; " * 3000 + "z" * 5000
TEXTS = [(1, "The quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "der schnelle braune Fuchs springt"), (5, LONG), (6, "漢字 仮名"), (None, "no id at all"), (1, "The quick brown fox jumps over the lazy dog"), (5, LONG)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en" if i and i < 4 else "de") for i, t in TEXTS], "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


OPERATORS = {
    "toxicity": lambda spark, df: toxicity.predict(df, toxicity.ToxicityModel(b"abcdefgh" * 40, b"hgfedcba" * 40, (1.0, 0.5, 0.2, -3.0))),
    "language": lambda spark, df: langid.predict(df, langid.fit(df, F.lit(True))),
    "scores": lambda spark, df: lm.score_texts(df, F.lit(True)),
    "pieces": lambda spark, df: pieces.encode(df),
    "fingerprints": lambda spark, df: simhash.fingerprints(df, 3),
    "audio": lambda spark, df: audio.audio_features(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_null_ids_long_texts_and_clashing_names(spark, odd, name):
    made = OPERATORS[name](spark, odd)
    got = made.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)
    for i in (1, 5):  # repeated rows give equal rows
        a, b = [r for r in got if r["doc_id"] == i]
        assert a == b
    bare = sorted((tuple(map(repr, r)) for r in OPERATORS[name](spark, odd.select("doc_id", "text", "lang")).select(made.columns).collect()))
    if name not in ("scores", "language"):  # sums of floats, in an order that may differ
        assert sorted(tuple(map(repr, r)) for r in got) == bare
    assert len(bare) == len(got)
    if name == "pieces":
        assert all(r["round_trip"] for r in got)


def test_fingerprints_bit_by_bit(spark, odd):
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(odd, 3).collect()}
    for i, t in TEXTS:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))] if w else []
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), i


def test_links_of_null_ids_and_repeated_rows(spark):
    rows = [(7, 5), (7, 5), (3, 4), (None, 4), (None, -1), (9, 1 << 40)]  # 4 and 5 differ in a bit
    got = simhash.link_fingerprints(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert Counter((r["doc_id"], r["component"]) for r in got) == Counter([(7, 3), (7, 3), (3, 3), (None, 3), (None, None), (9, 3)])


def repairs(turns):
    """(cost, turns as (role, text)) of every repair with at most two empty turns in a row."""
    def go(i, made, cost, state, empty):
        if i == len(turns) and state in (0, 3):
            yield cost, tuple(made)
        if empty < 2:
            for q in chat.NEXT[state]:
                yield from go(i, [*made, (q, "")], cost + chat.INSERT, q, empty + 1)
        if i < len(turns):
            role, text = turns[i]
            price = lambda q: 0 if role == chat.ROLES[q] else chat.RELABEL if role in chat.ROLES[1:] else chat.UNKNOWN
            for q in chat.NEXT[state]:
                yield from go(i + 1, [*made, (q, text)], cost + price(q), q, 0)
            if state:
                q, before = made[-1]
                yield from go(i + 1, [*made[:-1], (q, before + "\n\n" + text)], cost + chat.MERGE + price(q), state, 0)

    yield from go(0, [], 0, 0, 0)


def test_rendered_chats_are_cheapest_repairs(spark):
    rng = random.Random(4)
    chats = {c: [(rng.choice(["system", "user", "assistant", "tool", None]), f"t{c}.{i}") for i in range(rng.randint(1, 5))] for c in range(60)}
    rows = [(c, i, r, t) for c, turns in chats.items() for i, (r, t) in enumerate(turns)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, turns in chats.items():
        every = list(repairs(turns))
        least = min(cost for cost, _ in every)
        best = {"".join(f"<|{chat.ROLES[q]}|>\n{t}<|end|>\n" for q, t in made) for cost, made in every if cost == least}
        assert got[c]["rendered"] in best, (turns, got[c]["rendered"], best)


def test_mix_of_null_ids_repeated_rows_and_ties(spark):
    rows = [(None, "a")] * 5 + [(1, "a")] * 7 + [(1, None)] * 3 + [(None, None)] * 2 + [(i, "b") for i in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=4).select("doc_id", "source", "mix.*").collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    a = sorted((r["slot"], r["place"], r["doc_id"] is not None) for r in got if r["source"] == "a")
    assert [x[2] for x in a] == [False] * 5 + [True] * 7  # null ids first
