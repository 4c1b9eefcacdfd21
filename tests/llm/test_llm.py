"""The training-data operators against brute force, round trips and held-out labels, with edge cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import ann, audio, chat, graph, langid, lattice, lm, mixing, neardup, pieces, simhash, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, score double, id long, n_chars long"
SYLLABLES = {"en": ["th", "er", "ing", "on", "an"], "de": ["sch", "ung", "ein", "ver", "keit"]}


def document(i, lang, rng, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0.0, 9, 0) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, document(i, lang := ("en", "de")[i % 2], rng), lang, f"s{i % 3}") for i in range(120)]
    rows += [(200, None, "en", None), (201, "", None, "s0"), (202, "1 2 3 !", "de", "s1"), (203, " \n  x▁y \0z\n\n日本 émile ", "en", "s1"), (204, rows[0][1], "en", "s0"), (204, rows[0][1], "en", "s0"), (205, "ab" * 4000, "en", "s2")]
    return frame(spark, rows).repartition(3).cache()


def empty(spark):
    return frame(spark, [])


def test_language_id(spark, docs):
    held = F.col("doc_id") % 4 == 2
    model = langid.fit(docs, ~held)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0) and got[204][0] == "en"
    assert all(got[i][0] == ("en", "de")[i % 2] for i in range(120))
    assert langid.predict(empty(spark), model).count() == 0
    nothing = langid.fit(empty(spark), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_lattice_sums_all_segmentations():
    words = ["▁abab", "▁", "▁xéb", "▁aaaaaaa"]
    found = lattice.Matcher(["▁", "a", "b", "ab", "▁a", "ba", "aa"]).lattice(words)
    rng = np.random.default_rng(0)
    log_p = np.log(rng.dirichlet(np.ones(7 + 256)))
    names = {p: k for k, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aa"])}

    def brute(w):
        if not w:
            return 1.0
        total = sum(np.exp(log_p[names[w[:n]]]) * brute(w[n:]) for n in range(1, len(w) + 1) if w[:n] in names)
        return total + (0 if w[0] in names else np.exp(sum(log_p[7 + b] for b in w[0].encode())) * brute(w[1:]))

    assert np.allclose(np.exp(found.marginal(log_p)), [brute(w) for w in words])
    used = found.expected(log_p, np.ones(len(words)))
    step = 1e-6
    for k in (0, 1, 3, 5):  # the expected count is the gradient of the log-likelihood
        moved = log_p.copy()
        moved[k] += step
        assert used[k] == pytest.approx((found.marginal(moved).sum() - found.marginal(log_p).sum()) / step, abs=1e-4)


def test_lm_scores(spark, docs):
    learn = F.col("doc_id") % 5 != 1
    rows = lm.score_texts(docs, learn).collect()
    base = docs.collect()
    counts, ends = {}, 0
    for r in base:
        if r["doc_id"] % 5 != 1:
            ends += 1
            for w in (r["text"] or "").encode().lower().split():
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    text = {r["doc_id"]: r["text"] or "" for r in base}
    assert len(rows) == len(base)
    for r in rows:
        w = text[r["doc_id"]].encode().lower().split()
        want = sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w) + np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert r["base_score"] == pytest.approx(want) and r["n_tokens"] == len(w) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(x in counts for x in w) + 1 and r["score"] < 0 and r["word_score"] < 0
    assert lm.score_texts(empty(spark), learn).count() == 0
    assert lm.score_texts(docs.limit(3), F.lit(False)).count() == 3


def test_lm_score_sums_all_segmentations(spark, docs):
    """Without rows to learn from the weights are the vocabulary's own, so a plain sum over segmentations must agree."""
    vocab = lattice.read_vocabulary()
    weight = dict(zip(vocab.pieces, vocab.prior, strict=False))
    spelt = lambda c: sum(vocab.prior[len(vocab.pieces) + b] for b in c.encode())

    def log_p(word):
        t = pieces.MARK + word
        alpha = [0.0] + [-np.inf] * len(t)
        for j in range(1, len(t) + 1):
            for n in range(1, min(j, 16) + 1):
                w = weight.get(t[j - n : j], spelt(t[j - 1]) if n == 1 else None)
                if w is not None:
                    alpha[j] = np.logaddexp(alpha[j], alpha[j - n] + w)
        return alpha[-1] / np.log(10)

    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in lm.score_texts(docs, F.lit(False)).collect():
        if len(text[r["doc_id"]]) < 2000:
            want = sum(log_p(w.decode()) + np.log10(0.5) for w in text[r["doc_id"]].encode().lower().split()) + np.log10(0.5)
            assert r["score"] == pytest.approx(want, rel=1e-9) and r["word_score"] == pytest.approx(want, rel=1e-9)


def test_blocks_do_not_depend_on_batches(monkeypatch):
    import pyarrow as pa

    from cohortlens.llm import blocks

    class Task:
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(blocks, "TaskContext", type("T", (), {"get": staticmethod(lambda: Task)}))
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    rng = random.Random(2)
    texts = [None, "", " A b\tC "] + [document(i, "en", rng, rng.randint(0, 300)) for i in range(40)] + ["x" * 9000]
    whole = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts, "learn": [i % 3 == 0 for i in range(len(texts))]})

    def seen(size):
        cut = blocks.cut((whole.slice(i, size) for i in range(0, len(texts), size)), lm.split, None)
        return [(b.number, b.ids.to_pylist(), [b.words[i].as_py() for i in b.flat.tolist()], b.n.tolist()) for b in cut]

    assert seen(1) == seen(7) == seen(1000) and len(seen(7)) > 5
    words = [w.decode() for t in texts for w in (t or "").encode().lower().split()]
    assert [w for b in seen(5) for w in b[2]] == words


def viterbi(text, vocab):
    """The largest weight of any segmentation, by plain dynamic programming over the whole text."""
    weight = dict(zip(vocab.pieces, vocab.prior, strict=False))
    unknown = min(weight.values()) - 10
    t = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    best = [0.0] + [-np.inf] * len(t)
    for j in range(1, len(t) + 1):
        for n in range(1, min(j, 16) + 1):
            w = weight.get(t[j - n : j], unknown if n == 1 else None)
            if w is not None:
                best[j] = max(best[j], best[j - n] + w)
    return best[-1]


def test_sentencepiece(spark, docs):
    vocab = lattice.read_vocabulary()
    got = pieces.decode(pieces.encode(docs)).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    weight = dict(zip(vocab.ids.tolist(), vocab.prior.tolist(), strict=False))
    assert len(got) == docs.count()
    for r in got:
        want = text[r["doc_id"]]
        assert r["round_trip"] and r["decoded"] == want.replace("▁", " ") and r["n_pieces"] == len(r["ids"])
        if all(i in weight for i in r["ids"]) and len(want) < 2000:
            assert sum(weight[i] for i in r["ids"]) == pytest.approx(viterbi(want, vocab), abs=1e-6)
    assert pieces.encode(empty(spark)).count() == 0


def test_sentencepiece_long_words(spark):
    vocab = lattice.read_vocabulary()
    rng = random.Random(1)
    parts = ["th", "er", "ing", "on", "an", "s", "tion"]
    near = pieces.CHUNK + 15
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(80, 900)))) for i in range(12)] + [(100 + n, "a" * n) for n in range(near - 2, near + 3)]
    rows += [(200, "\x01\x02\x03 \x01a\n\x02b\n\x03c"), (201, " a b "), (202, "\0\0"), (203, "\u65e5" * 3000), (204, "".join(rng.choices("abcdefghijkl", k=1_000_000)))]
    weight, text = dict(zip(vocab.ids.tolist(), vocab.prior.tolist(), strict=False)), dict(rows)
    for r in pieces.decode(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        assert r["round_trip"] and r["decoded"] == text[r["doc_id"]]
        if r["doc_id"] < 200:
            assert sum(weight[i] for i in r["ids"]) == pytest.approx(viterbi(text[r["doc_id"]], vocab), rel=1e-9)


def test_toxicity(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(3, 9))) for _ in range(3000)]
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = rng.choices(vocabulary, k=80)
        if bad:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(["wretch", "villain", "scoundrel"])
        rows.append((i, " ".join(w), "en", "s"))
        marks.append((i, int(bad) if i % 11 else None))
    docs, labels = frame(spark, [*rows, (900, None, "en", "s"), (901, "", "en", "s")]), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert got[900]["predicted"] == got[901]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = toxicity.fit(docs, labels.filter("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.predict(docs, nothing).collect()} == {0.0}


def test_fingerprints_and_links(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(-(2**62), 2**62, 60)]
    fps += [f ^ (1 << int(b)) for f in fps[:20] for b in rng.integers(0, 60, 2)] + [f ^ 5 for f in fps[20:40]] + [0, 0, -1]
    df = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    got = {r["doc_id"]: r["component"] for r in simhash.link_fingerprints(df).collect()}
    part = list(range(len(fps)))
    for _ in fps:
        for a, b in itertools.combinations(range(len(fps)), 2):
            if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2 and part[a] != part[b]:
                part[a] = part[b] = min(part[a], part[b])
    assert got == dict(enumerate(part))


def test_fingerprint_of_texts(spark, docs):
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs, 3).collect()}
    assert got[200] == got[201] == 0
    one = spark.createDataFrame([(1, "AbC d")], "doc_id long, text string")
    want = one.select(F.xxhash64(F.lit("abc d")).alias("h")).first()["h"]
    assert simhash.fingerprints(one, 3).first()["fp"] == want


def test_near_duplicates(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    rows, sets = [], {}
    for g in range(8):
        base = rng.choices(words, k=120)
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            i = len(rows)
            rows.append((i, " ".join(w), "en", "s"))
            sets[i] = set(simhash.shingles(simhash.words(" ".join(w)), 5))
    rows += [(1000, None, "en", "s"), (1001, " ", "en", "s")]
    part = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    got = {r["doc_id"]: r["component"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got.pop(1000) == got.pop(1001) == 1000
    assert got == part
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_in_one_large_group(spark):
    """Copies of one text, most of them a little less than similar to each other: the links are found without loss."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(150)]
    texts = []
    for i in range(400):
        w = list(base)
        for at in rng.sample(range(150), 1 + i % 4):
            w[at] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base[:k]) for k in (1, 2, 5, 6, 100, 118, 125)] + [" ".join(base[:40] + [word() for _ in range(60)]) for _ in range(60)]
    sets = [set(simhash.shingles(simhash.words(t), 5)) for t in texts]
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            part[y] = x
    got = {r["doc_id"]: r["component"] for r in neardup.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and len(set(got.values())) > 100


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (620, [0.0] * 16), (640, [float("nan")] + [1.0] * 15), (660, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    hit = 0
    for q in range(0, 600, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:10].tolist()) & {r["vec_id"] for r in own})
        assert len(own) == 10 and all(r["score"] == pytest.approx(s[r["vec_id"]], rel=1e-12) for r in own)
    assert hit >= 0.9 * 10 * 30 and not {r["query_id"] for r in got} & {600, 620, 640, 660}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_url_filters(spark):
    rules = spark.sql("SELECT * FROM VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/', 'block'), ('b.a.net', '/x', 'allow'), ('a.net', '/', 'allow') AS r(host, path, verdict)")
    cases = ["http://www.Example.COM/en/77?q", "http://com/en/#x", "https://xcom/en/", "http://c.b.a.net/xy", "http://a.net/xy", "http://q.net/", "http://q.net", None, "no scheme", "http://", "x://a.net/?y", "x://ba.net/"]
    df = spark.createDataFrame(list(enumerate([*cases, cases[0]])), "page_id long, url string").withColumn("rule", F.lit("clash"))

    def brute(host, path):
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in map(tuple, rules.collect()) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if host and fit else (None, "allow")

    got = urls.url_verdicts(df, rules).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r["rule"], r["verdict"]) == brute(r["host"], r["path"])
    assert {r["page_id"]: (r["host"], r["path"]) for r in got}[0] == ("www.example.com", "/en/77")
    assert urls.url_verdicts(df.limit(0), rules).count() == 0 and {r["verdict"] for r in urls.url_verdicts(df, rules.limit(0)).collect()} == {"allow"}


def test_mix_stays_within_a_block(spark):
    rows = [(i, ("a", "b", "c", "d", None)[min(4, i % 11 // 2)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({c: F.lit("clash") for c in ("block", "parts", "period", "mix")})
    texts = mixing.mix(df.select(F.col("doc_id").cast("string").alias("doc_id"), "source"), block=8, slots=50).select("doc_id", "mix.slot").collect()
    assert len({r["doc_id"] for r in texts}) == 1500
    got = mixing.mix(df, block=8, slots=50).select("doc_id", "source", "mix.*").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    weight = {r["name"]: r["parts"] / r["period"] for r in mixing.period(mixing.proportional_weights(df), 50).collect()}
    slots = {(r["slot"], "n" if r["source"] is None else "s" + r["source"]) for r in got}
    assert len({s for s, _ in slots}) == len(slots)
    by = {n: sorted(s for s, m in slots if m == n) for n in weight}
    end = min(max(v) for v in by.values())  # until a source runs out
    for n, w in weight.items():
        for t in range(end + 1):
            assert abs(sum(s < t for s in by[n]) - t * w) < 1
    assert mixing.mix(df.limit(0)).count() == 0


def legal(roles):
    body = roles[1:] if roles[:1] == "s" else roles
    return not roles or (len(body) % 2 == 0 and len(body) > 0 and all(c == "ua"[i % 2] for i, c in enumerate(body)))


def cheapest(roles):
    """Uniform-cost search over single steps of the repair."""
    import heapq

    index = {"start": 0, "system": 1, "user": 2, "assistant": 3}
    heap, seen = [(0, 0, 0)], set()
    while heap:
        cost, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(roles) and s in (0, 3):
            return cost
        for q in chat.NEXT[s]:
            heapq.heappush(heap, (cost + chat.INSERT, i, q))
            if i < len(roles):
                heapq.heappush(heap, (cost + chat._label(roles[i], q), i + 1, q))
        if s and i < len(roles):
            heapq.heappush(heap, (cost + chat.MERGE + chat._label(roles[i], s), i + 1, s))
    return None


def test_chat_repair(spark):
    names = ["system", "user", "assistant", None, "tool"]
    cases = [list(c) for n in range(1, 4) for c in itertools.product(names, repeat=n)] + [[random.Random(i).choice(names) for _ in range(700)] for i in range(2)]
    rows = [(k, t, r, f"t{t} <|user|>" if t % 2 else None) for k, c in enumerate(cases) for t, r in enumerate(c)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for k, c in enumerate(cases):
        parts = sorted((r for r in got if r["conv_id"] == k), key=lambda r: r["part"])
        roles = "".join(r["roles"] for r in parts)
        assert legal(roles) and sum(r["turns"] for r in parts) == len(c)
        assert "".join(r["rendered"] for r in parts).count("<|end|>") == len(roles)
        costs = chat.transfer(c)
        total = min(costs[s] + chat.INSERT * len(chat.closing(s)) for s in range(4))
        assert total == cheapest(c)
        plain = sum(r["inserts"] for r in parts) * chat.INSERT + sum(r["merges"] for r in parts) * chat.MERGE
        assert plain <= total
    big = [((1 << 60) + 1, 0, "user", "a"), (None, 0, "user", "b"), (None, None, None, None), ((1 << 60) + 1, 0, "user", "a")]
    odd = spark.createDataFrame([(*r, "clash") for r in big], "conv_id long, turn long, role string, text string, part string").coalesce(1)
    got = {r["conv_id"]: (r["turns"], r["rendered"].count("a\n\na")) for r in chat.format_chats(odd).collect()}
    assert got == {(1 << 60) + 1: (2, 1), None: (2, 0)}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_audio(spark, docs):
    got = audio.audio_features(docs).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in got:
        raw = text[r["doc_id"]]
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert audio.from_wav(bytes(r["media"])) == payload and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["n_bytes"] == len(raw) and r["media_bytes"] == len(r["media"])
        blocks = audio.read_tensors(bytes(r["blocks"]))
        assert blocks.schema.field("tensor").type.shape == [audio.BLOCK, audio.MELS] and blocks.num_rows >= 1
        mels, spans = audio.features(payload)
        stored = blocks.column("tensor").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
        assert np.array_equal(stored[: len(mels)], mels) and (stored[len(mels) :] == audio.FLOOR_DB).all()
        assert [(x["start_ms"], x["end_ms"]) for x in r["spans"]] == [(audio.millis(a), audio.millis(b)) for a, b in spans]
        assert blocks.column("start_ms")[0].as_py() == 0 and blocks.column("end_ms")[-1].as_py() == audio.millis(len(mels))
    assert audio.audio_features(empty(spark)).count() == 0


def test_resampling_and_segments(monkeypatch):
    x = np.sin(2 * np.pi * 440 * np.arange(12_000) / 12_000).astype(np.float32)
    y = audio.resample(x)
    spectrum = np.abs(np.fft.rfft(y[:8000]))
    assert len(y) == 8000 and spectrum.argmax() == 440
    monkeypatch.setattr(audio, "PIECE", 1000)  # pieces don't matter
    assert np.array_equal(audio.resample(x), y)
    assert audio.segments(np.array([0, 0, 5, 2, 3, -9, 0, 6, 0], np.float32)) == [(2, 5), (7, 9)]


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, document(i, ("en", "de")[i % 2], rng, 90), ("en", "de")[i % 2], f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, "12 34", "en", "s0"), (102, None, "en", "s1")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(60)) and got.filter("not round_trip").count() == 0
