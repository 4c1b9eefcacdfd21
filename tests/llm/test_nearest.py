"""Nearest neighbours: how much the tables prune, hot cells, repeated rows and clashing names, against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import ann


def brute(x, ids, q, k):
    s = np.where(ids == q, -np.inf, x @ x[np.flatnonzero(ids == q)[0]])
    return np.sort(s[np.isfinite(s)])[::-1][:k]


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def test_tables_prune_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 32))
    x = centres[rng.integers(0, 150, 6000)] + 0.2 * rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # of lengths that differ, the nearest by inner product are not close
    got = ann.nearest(frame(spark, range(6000), x), F.col("vec_id") % 50 == 0, k=10).toPandas()
    hit = sum((g["score"] >= brute(x, np.arange(6000), q, 10)[-1] - 1e-9).sum() for q, g in got.groupby("query_id"))
    assert len(got) == 1200 and hit >= 0.9 * 1200, hit
    compared = got.groupby("query_id")["n_compared"].first()
    assert compared.mean() < 0.2 * 6000, compared.mean()


def test_hot_cells_are_split_and_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.vstack([np.repeat(rng.standard_normal((1, 8)), 300, axis=0), rng.standard_normal((300, 8))])
    df = frame(spark, range(600), x).withColumns({c: F.lit("clash") for c in ("id", "v", "row", "key", "shard", "rank", "score", "asks")})
    read = lambda: sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 30 == 0, k=5).collect())
    whole = read()
    hot = [r for r in whole if r[0] < 300]
    assert all(r[2] == (r[1] - 1 if r[0] >= r[1] else r[1]) for r in hot) and len(hot) == 50  # ties go to the smaller id
    monkeypatch.setattr(ann, "SHARD_ROWS", 40)
    monkeypatch.setattr(ann, "QUERY_GROUP", 3)
    split = read()
    assert len(split) == 100 and [r for r in split if r[0] < 300] == hot


def test_repeated_rows_and_few_rows_are_answered_whole(spark):
    x = np.random.default_rng(5).standard_normal((40, 4))
    ids = np.array([*range(30), *range(10)])
    x[30:35] = x[:5]  # the same rows again; the others share only an id
    got = ann.nearest(frame(spark, ids, x), F.col("vec_id") == 20, k=100).toPandas().sort_values("rank")
    assert len(got) == 39 and np.allclose(got["score"], brute(x, ids, 20, 100)) and got["rank"].tolist() == list(range(1, 40))


def test_likeliest_products_in_order():
    chance = np.random.default_rng(6).random((3, 5, 4))
    p, at = ann.likeliest(chance, 50)
    for i in range(3):
        every = np.sort(np.einsum("a,b,c,d,e->abcde", *chance[i]).ravel())[::-1][:50]
        assert np.allclose(p[i], every) and np.allclose(np.prod(chance[i][np.arange(5), at[i]], axis=1), every)
