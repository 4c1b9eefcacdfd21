"""Runs, prefix tries and secret scans against brute force, with edge cases; the pipeline's order."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import automata, mixing, prefix_trie, queries, secret_scan, suffix_runs

ODD = "doc_id long, text string, runs string, spans string, collapsed int, id long, kind string"


def odd(spark, rows):
    """Documents with columns of clashing names."""
    return spark.createDataFrame([(i, t, "r", "s", 1, 2, "k") for i, t in rows], ODD)


def brute_runs(w, least):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q) if q % d == 0):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_all_kinds():
    rng = random.Random(5)
    for _ in range(1500):
        k, n, p = rng.choice([1, 2, 2, 3, 4]), rng.randint(1, 40), rng.randint(1, 5)
        s = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.3:
            s = [s[i % p] if 3 < i and p <= n else s[i] for i in range(n)]
        assert [tuple(r) for r in suffix_runs.all_runs(s).tolist()] == brute_runs(s, 0), s
        for least in (2, 5, 12):
            assert [tuple(r) for r in suffix_runs.runs_of_words([b"%d" % x for x in s], least).tolist()] == brute_runs(s, least), (s, least)


def test_common_extensions_of_suffixes():
    rng = random.Random(1)
    s = [rng.randint(1, 2) for _ in range(60)]
    tree = suffix_runs.SuffixTree([*s, 0])
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(61) for b in range(61) if a != b], strict=True))
    full = [*s, 0]
    want = [next(k for k in range(62) if max(a, b) + k >= 61 or full[a + k] != full[b + k]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert tree.common(i, j).tolist() == want
    order = sorted(range(61), key=lambda a: full[a:])
    assert [int(tree.rank[a]) for a in order] == list(range(61))


def test_periodic_documents(spark):
    line = " ".join(f"w{i}" for i in range(7))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a " * 40), (5, f"x {line} {line} y\x0b{line}\t{line} z"), (5, f"x {line} {line} y\x0b{line}\t{line} z"), (None, "b c " * 9), (6, "é日 " * 12 + "\xa0"), (7, " ".join(f"u{i % 900}" for i in range(20_000)))]
    got = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in suffix_runs.periodic_runs(odd(spark, rows)).collect()}
    assert got == {
        (1, ""): [], (2, ""): [], (3, ""): [], (4, "a"): [(0, 40, 1)], (5, f"x {line} y {line} z"): [(1, 14, 7), (16, 14, 7)], (None, "b c"): [(0, 18, 2)], (6, "é日 \xa0"): [(0, 12, 1)], (7, " ".join(f"u{i}" for i in range(900))): [(0, 20_000, 900)],
    }
    assert suffix_runs.periodic_runs(odd(spark, rows)).count() == len(rows) and suffix_runs.periodic_runs(odd(spark, [])).count() == 0


def test_periodic_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 90)))) for i in range(150)]
    odd(spark, [*rows, (500, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for i, text in [*rows, (500, "")]:
        w, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w, 12)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = {"doc_id": i, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[0] if best[0] is None else 1000 * best[1] // best[2]}
        want |= {"runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), "collapsed_sha256": sha(" ".join(x for k, x in enumerate(w) if k not in gone))}
        assert got[i] == want, i


def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [v for v in nodes if v[: len(p)] == p]
        leaf = lambda v: not any(len(u) == len(v) + 1 and u[: len(v)] == v for u in nodes)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        saved = sum((len(nodes[v]) - 1) * len(v[-1][1]) for v in below if v)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(v) == len(p) + 1 for v in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("segment", "shard"), [(3, 4), (64, 2048)])
def test_trie(spark, monkeypatch, segment, shard):
    """Also over many shards and segments of few turns, with one long conversation and many copies."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "TOGETHER", 5)
    rng, convs = random.Random(4), {}
    for c in range(60):
        convs[c] = [(rng.choice(["user", ""]), rng.choice(["a", "é日", ""])) for _ in range(rng.randint(1, 8))]
    convs |= {100 + c: convs[3] for c in range(15)} | {-7: convs[3][:2], 200: [("user", "a")] * 40, 201: [("user", "a")] * 17}
    rows = [(c, t * 2, *((x or None) for x in turn), 9, "x") for c, turns in convs.items() for t, turn in enumerate(turns)] + [(None, 1, "user", "lost", 9, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, seg string").repartition(3)
    keys = prefix_trie.turn_keys(df)
    empty = spark.createDataFrame([(999, 0, None, None, None)], "conv_id long, pos long, k1 long, k2 long, chars long")
    got = prefix_trie.prefix_trie(keys.unionByName(empty))
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str) == brute_trie(convs | {999: []})
    assert prefix_trie.prefix_trie(keys.limit(0)).count() == 0


def test_turns_are_ordered(spark):
    rows = [(1, None, "b", "2"), (1, 3, "a", "4"), (1, None, None, "1"), (1, 0, "z", "3"), (1, 3, "a", "4"), (1, 5000, "a", None)]
    keys = prefix_trie.turn_keys(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("pos").collect()
    assert [r["pos"] for r in keys] == [1, 2, 3, 4, 5, 6] and [r["chars"] for r in keys] == [1, 1, 1, 1, 1, 0]
    assert len({(r["k1"], r["k2"]) for r in keys}) == 5 and keys[3]["k1"] == keys[4]["k1"]


def test_trie_query(spark, tmp_path):
    rng = random.Random(6)
    convs = {c: [("user", rng.choice("ab")) for _ in range(rng.randint(1, 7))] for c in [*range(30), 100, 101, 150, 205, 299, 1000]} | {c: [("user", "a")] for c in range(301, 312)}
    rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rebuilt = {c: convs.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + turns[h:] for c, turns in convs.items()}
    got = queries.op12_prefix_trie(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str) == brute_trie(rebuilt) and any(not t for t in rebuilt.values())


PATTERNS = [re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile(r"(AKIA[A-Z0-9]+)"), re.compile(r"([0-9a-f]+)")]


def brute_spans(text):
    found = [(m.start(), k, m.end()) for k, (p, least) in enumerate(zip(PATTERNS, (12, 18, 16), strict=True)) for m in p.finditer(text) if len(m[1]) >= least]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def test_secrets(spark):
    rng = random.Random(2)
    parts = ["password", "passwd", "SECRET", "token", "api_key", "ApiKey", "AKIA", '"', "'", " ", "=", ":", "abcdef0123456789", "0123456789ABCDEF", "x", "é", "\n", "f", "0", " = ", "AKIAABCDEFGHIJKLMN", "日"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(3000)]
    rows += [(3000, None), (3001, ""), (None, "secret: " + "z" * 12), (3002, "é" * 9 + "token=" + "a" * 100_000 + "ſecret=abcdefabcdefabcdef"), (3002, "é"), (3003, "p" * 50_000 + "assword='" + "k" * 12 + "'")]
    got = secret_scan.secret_spans(odd(spark, rows), secret_scan.BASE).collect()
    want = {(i, tuple(brute_spans(t or ""))) for i, t in rows}
    assert len(got) == len(rows) and {(r["doc_id"], tuple(map(tuple, r["spans"]))) for r in got} == want
    assert secret_scan.secret_spans(odd(spark, [])).count() == 0


def test_more_rules_and_redaction(spark):
    text = "é eyJab12345678.eyJcd12345678.sig_-12345 and ghp_" + "A1" * 18 + ", xoxb-1234567890 -----BEGIN RSA PRIVATE KEY----- token = abcdefabcdefabcdef!"
    docs = odd(spark, [(1, text), (2, None), (3, "nothing")])
    spans = secret_scan.secret_spans(docs)
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in spans.collect()}
    assert [k for k, _, _ in found[1]] == ["jwt", "git", "chat", "pem", "assign", "hex"] and not found[2] and not found[3]
    out = {r["doc_id"]: (r["text"], r["spans"]) for r in secret_scan.redacted(docs, spans).collect()}
    assert out == {1: ("é [jwt] and [git], [chat] [pem] [assign]!", "s"), 2: (None, "s"), 3: ("nothing", "s")}


@pytest.mark.parametrize("pattern", [rb"a(b|cd)*e", rb"[^ab]{2,3}x", rb"(?i:Ab)c?", rb"a.?b|ba{2}", rb"x[a-c]+y?"])
def test_automata_agree_with_re(pattern):
    rng = random.Random(3)
    forward, back = automata.compile_patterns([pattern]), automata.compile_patterns([pattern], reverse=True, search=True)
    for _ in range(300):
        data = bytes(rng.choices(b"aabbcdexyAB\n", k=rng.randint(0, 14)))
        ends = [next((e for e in range(len(data), i, -1) if re.fullmatch(pattern, data[i:e])), -1) for i in range(len(data))]
        assert [automata.longest(forward, data, i, len(data))[0] for i in range(len(data))] == ends, data
        places, _ = automata.marks(back, np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))
        assert places.tolist() == [i for i, e in enumerate(ends) if e >= 0], data
    with pytest.raises(ValueError, match="empty"):
        automata.compile_patterns([b"a*"])
    with pytest.raises(ValueError, match="a rule has no"):
        automata.compile_patterns([b"^a"])


def test_side_by_side_reading_equals_one_by_one():
    rng = random.Random(9)
    dfa = automata.compile_patterns([rb"ab+c", rb"[0-9]{3,}"], reverse=True, search=True)
    texts = [bytes(rng.choices(b"abbc0123 \n", k=rng.randint(0, 60))) for _ in range(400)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    places, hits = automata.marks(dfa, np.frombuffer(b"".join(texts), np.uint8), ends[:-1], ends[1:])
    want = [(int(a) + i, k) for a, t in zip(ends, texts, strict=False) for i in range(len(t)) if (k := sum(1 << n for n, p in enumerate((rb"ab+c", rb"[0-9]{3,}")) if re.match(p, t[i:])))]
    assert list(zip(places.tolist(), hits.tolist(), strict=True)) == want


def test_pipeline_keeps_the_mix(spark, tmp_path):
    rows = [(i, f"text number {i}", f"s{i % 7 % 3}", "en") for i in range(150)] + [(None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    corpus_pipeline.mixed(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    stored = spark.read.parquet(f"{tmp_path}/mixed")
    assert stored.columns == docs.columns
    got = corpus_pipeline.encoded(spark, stored, "").orderBy("place").collect()
    want = mixing.mix(docs).orderBy("mix.slot", "mix.place").collect()
    assert [(r["doc_id"], r["source"]) for r in got] == [(r["doc_id"], r["source"]) for r in want] and [r["place"] for r in got] == list(range(151)) and all(r["round_trip"] for r in got)
    assert corpus_pipeline.encoded(spark, stored.filter(F.lit(False)), "").count() == 0
