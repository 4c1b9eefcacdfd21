"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is projected on Gaussian directions (p-stable for p = 2), shifted by chance and cut into cells of one width,
in several tables. A query visits the cells of a table in the order of their estimated probability to hold a near
neighbour, until these add up to the wanted success; whatever lies there in any table is a candidate, and candidates
are ranked by their exact inner product on the original vectors.

Density differs from place to place, so the reach is judged by each query's merged answers. A query whose k-th candidate
is farther than its cells were chosen for asks again, with that distance as spread. A query that still has fewer than k
candidates, or whose cells do not add up to the wanted success within MOST_CELLS of a table, is compared with every row,
in blocks.

Largest inner product is turned into smallest distance first: vectors are scaled by the largest length and get one more
coordinate that brings all of them to length 1. The neighbours' distance, which fixes the cells' width and the first
probabilities, is measured from a bounded sample of rows to all rows; every row is indexed. Directions grow with the
logarithm of the rows.

Rows and probes meet in shards of whole cells. A shard of more than SHARD_ROWS rows (a hot cell, say) is split by a hash
of the row, and one that more than QUERY_GROUP queries visit by a hash of the query, so no task holds more than about
so many of either. Shards that nobody visits are not shuffled. `n_compared` counts a query's comparisons (a row met in
two tables counts twice).

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows of a null id. Ties go to the smaller id. Rows of equal ids but the query's own are candidates of
their own, repeated rows as often as they occur; of query rows of equal ids the one of the smallest vector asks. An empty
table gives an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable_table

#: Rows of a shard and queries that one task answers, at most about; at least MIN_SHARDS shards a table.
SHARD_ROWS, QUERY_GROUP, MIN_SHARDS = 32_768, 16_384, 4
#: Queries whose cells are listed at a time, and cells that one query visits in a table at most (else all rows).
QUERY_ROWS, MOST_CELLS = 256, 512
#: The shards' sizes, one row for SHARD_ROWS rows and table, are broadcast up to this many.
BROADCAST_SHARDS = 500_000
#: Cells on each side of a query's own, in each direction.
STEPS = np.arange(-2, 3)

_ANSWER = "query_id long, vec_id long, row long, score double, found_in int, seen long"


@dataclass(frozen=True)
class Index:
    longest: float
    directions: np.ndarray  # tables x projections x (dimensions + 1)
    shifts: np.ndarray
    width: float
    spread: float  # distance of a near neighbour
    success: float  # wanted of each table
    multipliers: np.ndarray  # tables x projections; a cell's key is the sum of products


def valid(vector_col: str) -> Column:
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    v = vectors / longest
    return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1, keepdims=True)))])


def asking(queries: np.ndarray) -> np.ndarray:
    return np.hstack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))])


def _keys(index: Index, table: int, cells: np.ndarray) -> np.ndarray:
    return (cells.astype(np.int64) * index.multipliers[table]).sum(axis=-1)


def row_keys(index: Index, points: np.ndarray) -> np.ndarray:
    """The key of each augmented row's cell in each table."""
    return np.stack([_keys(index, t, np.floor((points @ d.T + s) / index.width)) for t, (d, s) in enumerate(zip(index.directions, index.shifts, strict=True))], axis=1)


def likeliest(chance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest products of one chance from each row, largest first, and which they take: chance is
    queries x projections x steps. What is not among the largest of some projections is in none of all projections."""
    p, at = np.ones((len(chance), 1)), np.zeros((len(chance), 1, 0), np.int8)
    for j in range(chance.shape[1]):
        every = (p[:, :, None] * chance[:, j, None, :]).reshape(len(chance), -1)
        order = np.argsort(-every, axis=1, kind="stable")[:, :most]
        p = np.take_along_axis(every, order, axis=1)
        steps = order % chance.shape[2]
        at = np.concatenate([np.take_along_axis(at, (order // chance.shape[2])[:, :, None], axis=1), steps[:, :, None].astype(np.int8)], axis=2)
    return p, at


_normal = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))), otypes=[float])


def probes(index: Index, table: int, asks: np.ndarray, spread: np.ndarray) -> list[np.ndarray | None]:
    """For each query the keys of the visited cells, likeliest first, up to the wanted success; None where the cells at
    hand do not reach it. spread: of each query."""
    f = (asks @ index.directions[table].T + index.shifts[table]) / index.width
    home = np.floor(f)
    edges = (home[:, :, None] + np.append(STEPS, STEPS[-1] + 1) - f[:, :, None]) * (index.width / spread)[:, None, None]
    p, at = likeliest(np.diff(_normal(edges), axis=2), MOST_CELLS)
    reached = np.cumsum(p, axis=1)
    enough = (reached < index.success).sum(axis=1) + 1
    return [_keys(index, table, home[i] + STEPS[at[i, :n]]) if n <= reached.shape[1] else None for i, n in enumerate(enough)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def answer(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Each query's k best rows of one piece of a shard, among those of the cells it visits (null: all), and a row that
    counts its comparisons."""
    parts: list[tuple] = []
    if left.num_rows and right.num_rows:
        keys = left.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        ids, x, row, keys = left.column("id").to_numpy()[order], _matrix(left.column("v"))[order], left.column("row").to_numpy()[order], keys[order]
        table = left.column("found_in")[0].as_py()
        for q, vector, visited in zip(right.column("id").to_numpy(), _matrix(right.column("v")), right.column("keys"), strict=True):
            if visited.is_valid:
                wanted = np.unique(visited.values.to_numpy())
                first, last = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
                n = last - first
                at = np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())
            else:
                at = np.arange(len(ids))
            at = at[ids[at] != q]
            s = np.einsum("ij,j->i", x[at], vector)  # a row's sum does not depend on the rows beside it
            parts.append(([q], [-1], [0], [np.nan], [table], [len(at)]))
            if len(at) > 4 * k:
                best = s >= np.partition(s, len(s) - k)[len(s) - k]
                at, s = at[best], s[best]
            top = np.lexsort((ids[at], -s))[:k]
            m = len(top)
            parts.append((np.full(m, q), ids[at[top]], row[at[top]], s[top], np.full(m, table), np.full(m, -1)))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 6
    q, found, row, s, table, seen = columns
    ranked = seen < 0
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64()]
    values = [q.astype(np.int64), found.astype(np.int64), row.astype(np.int64), s.astype(np.float64), table.astype(np.int32), seen.astype(np.int64)]
    masks = [None, ~ranked, ~ranked, ~ranked, None, ranked]
    return pa.table({n: pa.array(v, t, mask=m) for n, v, t, m in zip(["query_id", "vec_id", "row", "score", "found_in", "seen"], values, types, masks, strict=True)})


def usual_reach(rows: DataFrame, longest: float, near: int, total: int, sample: int) -> float:
    """The median distance from a row to its `near`-th nearest of all rows, of about `sample` rows taken by a hash. Every
    batch of rows gives each of them its nearest few, which are merged: one pass, however many rows there are."""
    share = F.lit(min(1.0, sample / max(1, total)) * (1 << 20))
    some = _matrix(rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < share).orderBy("row").limit(2 * sample).select("v").toArrow().column("v"))
    if not len(some):
        return 1.0
    asks = rows.sparkSession.sparkContext.broadcast(asking(some))

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(asks.value), 0), np.inf)
        for b in batches:
            best = np.hstack([best, np.maximum(0, 2 - 2 * asks.value @ augmented(_matrix(b.column("v")), longest).T)])
            best = np.sort(best, axis=1)[:, : near + 1]  # a row is its own nearest
        asker = np.repeat(np.arange(len(best)), best.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(asker), pa.array(np.sqrt(best).ravel())], ["asker", "distance"])

    rank = F.row_number().over(Window.partitionBy("asker").orderBy("distance"))
    last = rows.select("v").mapInArrow(closest, "asker long, distance double").withColumn("rank", rank).filter(F.col("rank") <= near + 1).groupBy("asker").agg(F.max("distance").alias("distance"))
    return last.agg(F.median("distance").alias("d")).first()["d"] or 0.0


def fit(rows: DataFrame, dims: int, longest: float, near: int, total: int, *, sample: int = 128, tables: int = 2, projections: int | None = None, success: float = 0.92, slack: float = 1.05, seed: int = 7) -> Index:
    """Cells for the distance (and `slack`) at which half of about `sample` rows have their neighbours.
    success: that of all tables for a neighbour so far away."""
    rng = np.random.default_rng(seed)
    spread = max(1e-3, slack * usual_reach(rows, longest, near, total, sample))
    k = projections or max(4, min(12, round(math.log2(max(2, total)) / 2)))
    width = (k / 4 + 0.5) * spread  # wider cells for more directions, so that the cells to visit stay few
    return Index(longest, rng.standard_normal((tables, k, dims + 1)), rng.uniform(0, width, (tables, k)), width, spread, 1 - (1 - success) ** (1 / tables), rng.integers(1, 1 << 62, (tables, k)) | 1)


def _counted(rows: DataFrame) -> DataFrame:
    """Rows a shard; a list of one row for about SHARD_ROWS rows."""
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def _meet(rows: DataFrame, asks: DataFrame, shards: int, k: int) -> DataFrame:
    """The answers to `asks` (shard, keys, id, v) from `rows` (shard, found_in, key, id, v, row)."""
    pieces = lambda n, most: F.ceil(n / F.lit(most)).cast("int")
    layout = _counted(rows).select("shard", pieces(F.col("n"), SHARD_ROWS).alias("parts")).join(_counted(asks).select("shard", pieces(F.col("n"), QUERY_GROUP).alias("askers")), "shard")
    hint = F.broadcast if shards <= BROADCAST_SHARDS else lambda d: d
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.join(hint(layout), "shard").select("shard", F.pmod("row", "parts").cast("int").alias("part"), upto("askers").alias("asker"), "found_in", "key", "id", "v", "row")
    right = asks.join(hint(layout), "shard").select("shard", upto("parts").alias("part"), F.pmod(F.xxhash64("id"), F.col("askers")).cast("int").alias("asker"), "keys", "id", "v")
    by = ("shard", "part", "asker")

    def answered(a: pa.Table, b: pa.Table) -> pa.Table:
        return answer(a, b, k)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(answered, _ANSWER)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: (query_id, rank, vec_id, score, row, n_compared). A row that several tables gave counts
    once, repeated rows as often as one table gave them."""
    once = found.groupBy("query_id", "vec_id", "row", "found_in").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("times"), F.sum("seen").alias("seen"))
    once = once.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"), F.max("times").alias("times"), F.sum("seen").alias("seen"))
    once = once.withColumn("n_compared", F.coalesce(F.sum("seen").over(Window.partitionBy("query_id")), F.lit(0))).filter(F.col("vec_id").isNotNull())
    copies = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return copies.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "row", "n_compared")


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, **options) -> DataFrame:
    """(query_id, rank, vec_id, score, n_compared): each query's k nearest found, by largest inner product."""
    spark = vectors.sparkSession
    kept = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.filter(valid(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kept).alias("v"), is_query.alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shape = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest")).orderBy(F.desc("n"), "dims").first()
    result = ("query_id", "rank", "vec_id", "score", "n_compared")
    if shape is None:
        return _merged(spark.createDataFrame([], _ANSWER), k).select(*result)
    rows = rows.filter(F.size("v") == shape["dims"]).withColumn("row", F.xxhash64("id", "v"))
    longest, each = math.sqrt(shape["longest"]) * (1 + 1e-12), max(MIN_SHARDS, math.ceil(shape["n"] / SHARD_ROWS))
    fitted = fit(rows, shape["dims"], longest, k, shape["n"], **options)
    index, tables = spark.sparkContext.broadcast(fitted), len(fitted.directions)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = row_keys(index.value, augmented(_matrix(b.column("v")), longest)) if b.num_rows else np.zeros((0, tables), np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("row"), lists], ["id", "v", "row", "cells"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_ROWS):
                b = whole.slice(at, QUERY_ROWS)
                asks, spread = asking(_matrix(b.column("v"))), b.column("spread").to_numpy(zero_copy_only=False)
                lists = []
                for visited in zip(*[probes(index.value, t, asks, spread) for t in range(tables)], strict=True):
                    if any(c is None for c in visited):
                        lists.append(None)
                        continue
                    own = []
                    for t, cells in enumerate(visited):
                        shard = (cells.view(np.uint64) >> np.uint64(33)).astype(np.int64) % each
                        own += [{"shard": t * each + int(s), "keys": cells[shard == s]} for s in np.unique(shard)]
                    lists.append(own)
                kind = pa.list_(pa.struct([("shard", pa.int32()), ("keys", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(lists, kind)], ["id", "v", "visits"])

    hashed = rows.select("id", "v", "row").mapInArrow(keyed, f"id long, v {kept}, row long, cells array<long>").select("id", "v", "row", F.posexplode("cells").alias("found_in", "key"))
    hashed = hashed.withColumn("shard", (F.col("found_in") * each + F.shiftrightunsigned("key", 33) % each).cast("int"))

    def asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The answers from the cells that `queries` (id, v, spread) visit, and the queries that no cells suffice for."""
        visits = durable_table(queries.mapInArrow(visiting, f"id long, v {kept}, visits array<struct<shard: int, keys: array<long>>>"))
        asks = visits.select("id", "v", F.inline("visits"))
        return _meet(hashed, asks, tables * each, k), visits.filter(F.col("visits").isNull()).select("id", "v")

    def reach(queries: DataFrame, found: DataFrame) -> DataFrame:
        """`queries` with the distance of the k-th candidate, null where there are fewer."""
        last = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("last"))
        length = F.sqrt(square) * F.lit(longest)
        square_distance = F.greatest(F.lit(0.0), 2 - 2 * F.col("last") / length)
        return queries.join(last, "id", "left").withColumn("reach", F.when(F.col("last").isNotNull(), F.sqrt(square_distance)))

    queries = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    answers, _ = asked(queries.withColumn("spread", F.lit(fitted.spread)))
    first = durable_table(_merged(answers, k))
    far = durable_table(reach(queries, first).filter(F.col("reach").isNull() | (F.col("reach") > fitted.spread)).select("id", "v", "reach"))
    if not far.take(1):
        return first.select(*result)
    again, beyond = asked(far.filter(F.col("reach").isNotNull()).select("id", "v", F.col("reach").alias("spread")))
    rest = far.filter(F.col("reach").isNull()).select("id", "v").unionByName(beyond)
    spread_out = rows.select(F.pmod("row", F.lit(each)).cast("int").alias("shard"), F.lit(0).alias("found_in"), F.col("row").alias("key"), "id", "v", "row")
    everywhere = rest.select(F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("shard"), F.lit(None).cast("array<long>").alias("keys"), "id", "v")
    every = _meet(spread_out, everywhere, each, k)
    counted = first.select("query_id", *[F.lit(None).cast("long").alias(c) for c in ("vec_id", "row")], F.lit(None).cast("double").alias("score"), F.lit(-1).alias("found_in"), "n_compared").distinct().withColumnRenamed("n_compared", "seen")
    before = first.select("query_id", "vec_id", "row", "score", F.lit(-1).alias("found_in"), F.lit(None).cast("long").alias("seen"))
    return _merged(before.unionByName(counted).unionByName(again).unionByName(every), k).select(*result)
