"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import ann, mixing, neardup, simhash, toxicity


def test_cut_and_extended_copies_are_near_duplicates(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    rows, pairs = [], 0
    for n in (60, 200, 400):
        for _ in range(20):
            w, extra = [word() for _ in range(n)], [word() for _ in range(int(n * 0.21))]
            for copy in (w, w[: len(w) - int(n * 0.18)], w + extra):
                rows.append((len(rows), " ".join(copy)))
            sets = [set(simhash.shingles(simhash.words(t), neardup.SHINGLE)) for _, t in rows[-3:]]
            assert all(len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets[1:])
            pairs += 2
    got = {r["doc_id"]: r["component"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[i] == i // 3 * 3 for i in got if i % 3)
    assert found == pairs, f"{found} of {pairs} pairs"


def test_nearest_where_density_is_uneven(spark):
    rng = np.random.default_rng(8)
    near = rng.standard_normal(32) + 0.02 * rng.standard_normal((1800, 32))
    x = np.vstack([near, rng.standard_normal((200, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0], rows[1980], (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    hit, asked = 0, range(0, 2000, 20)
    for q in asked:
        own = [r["score"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        s = np.delete(np.concatenate([x @ x[q], x[[0, 1980]] @ x[q]]), [q, *([2000] if q == 0 else [2001] if q == 1980 else [])])
        assert len(own) == 10, (q, len(own))
        hit += sum(v >= np.sort(s)[-10] - 1e-12 for v in own)
    assert hit >= 0.95 * 10 * len(asked), hit


def test_queries_go_in_bounded_groups(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    read = lambda: sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 4 == 0, k=5).collect()))
    whole = read()
    monkeypatch.setattr(ann, "QUERY_GROUP", 7)
    assert read() == whole and len(whole) == 50 * 5


@pytest.mark.parametrize("bad,glue", [("xq", " {} "), ("zap", " {} "), ("villain", " something,{} "), ("villain", ' ("{}") '), ("villain", " http://abcdefgh.example/{}?q "), ("villain", "\u6f22\u5b57\u4eee\u540d\u6587\u7ae0{} "), ("\u60aa\u8005\u8ff7", "{}")])
def test_toxic_words_are_seen_wherever_they_stand(spark, bad, glue):
    rng = random.Random(5)
    unspaced = glue == "{}"
    vocabulary = [chr(0x4E00 + i) for i in range(900)] if unspaced else ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(3000)]
    vocabulary = [v for v in vocabulary if v not in bad]
    rows = []
    for i in range(600):
        w = rng.choices(vocabulary, k=80)
        if i % 4 == 0:
            for at in rng.sample(range(80), 4):
                # learned as a word of its own, met behind other characters
                w[at] = (glue if i % 5 == 0 else "{}").format(bad)
        rows.append((i, ("" if unspaced else " ").join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.predict(docs.filter("doc_id % 5 = 0"), model).collect()}
    right = sum(p == (i % 4 == 0) for i, p in got.items())
    assert right >= 0.95 * len(got), f"{right} of {len(got)}"


def test_every_byte_takes_part():
    for text in ("abcdefghijklmnopqrstuvwxyz", "a", "ab!?", "\u6f22\u5b57 kana\u30ab\u30ca", "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35", "x_y-1.5e3", "\u043f\u0440\u0438\u0432\u0435\u0442hi\U0001f600", "\u0939\u093f\u0928\u094d\u0926\u0940", "a\ud800b"):
        raw = text.encode("utf-8", "surrogatepass")
        for at, c in enumerate(text):
            if not c.isspace():
                changed = text[:at] + ("\u6c34" if c != "\u6c34" else "\u706b") + text[at + 1 :]
                assert toxicity.words(changed) != toxicity.words(text), (raw, at)
        assert {b for w in toxicity.words(text) for p in toxicity.prefixes(w) for b in p} >= set(raw) - {0x20}


def test_pipeline_stages_judge_each_row(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, a), (1, a), (2, b), (2, "1 2 3"), (None, c), (None, c), (None, b), (3, a)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    key = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    assert key(corpus_pipeline.language(spark, docs, "")) == sorted((i or 0, t) for i, t in rows if t != "1 2 3")
    assert key(corpus_pipeline.distinct_texts(spark, docs, "")) == sorted([(1, a), (2, b), (2, "1 2 3"), (0, c)])
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = lambda d, m, id_col: d.select(id_col, (F.col("text") == b).cast("int").alias("predicted"))
    monkeypatch.setattr(toxicity, "predict", seen)
    assert key(corpus_pipeline.harmless(spark, docs, str(tmp_path))) == sorted((i or 0, t) for i, t in rows if t != b)


def test_language_keeps_texts_without_a_majority(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc", "en"), (2, "7", "en")], "doc_id long, text string, lang string")
    verdict = lambda d, m, id_col="doc_id": d.select(id_col, F.when(F.col("text") == "7", "und").otherwise("en").alias("lang_pred"), F.lit(0.4).alias("score"))
    monkeypatch.setattr(corpus_pipeline.langid, "predict", verdict)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]


def test_mix_stays_near_the_target_weights(spark):
    rows = spark.range(90_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"))
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    total = sum(c**0.5 for c in counts.values())
    got = mixing.mix(rows, block=4).groupBy("source", "mix.slot").count().collect()
    by = {n: np.sort([r["slot"] for r in got if r["source"] == n]) for n in counts}
    end = min(v[-1] for v in by.values())
    off = {n: max(abs(np.arange(len(v)) - v * counts[n] ** 0.5 / total)[v <= end]) for n, v in by.items()}
    assert max(off.values()) < 2, max(off.values())
