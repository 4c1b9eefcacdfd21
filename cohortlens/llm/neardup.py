"""Near-duplicate texts: five-word shingle sets with a Jaccard similarity of 0.8 or more, found but for the chance that
the bound on fingerprints below states and that of equal 40-bit hashes of different shingles.

SimHash alone can't give them: at a similarity of 0.8 the fingerprints of two texts differ in 15 % of their bits on
average, too many for any equal segment to be certain. So pairs come from a prefix filter, which is exact, and SimHash with
a pigeonring chain prunes them before their sets are fetched and compared.

1. Equal word sequences are one node. Its shingles are ordered from rare to common (by a bounded sample; the order
   matters for speed alone). Two similar sets share a shingle among the first few: a fifth of the larger set's, a ninth
   of the smaller one's; and what stands behind both must still be able to make up the overlap.
2. Of each shingle's nodes the most central one (with the most common shingles) is a hub. Every node is compared with
   the hub that it shares most shingles with, which joins nearly all of a large group of near-copies at once.
3. Pairs of nodes in different groups are compared then. Each has a node outside its shingle's largest group, so they
   are looked for from there; links within a group add nothing to it.

Pairs whose fingerprints differ in more than TAU of 128 bits are dropped unseen; at a similarity of 0.8 they differ in 19
with a deviation of 4, so TAU is six deviations away. Sets of fewer than SMALL shingles are always compared.

Edge cases: null and empty texts, or ones without a word, are one node of an empty set. Texts of fewer words than a
shingle are one shingle. Null ids are ids like others, the smallest of all being null last. Repeated rows are copies. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable_table, sample_rate
from .graph import components
from .simhash import fingerprint, hashes, shingles, words

SIMILARITY, SHINGLE = 0.8, 5
#: Overlap that a pair needs, as a share of both sizes.
OVERLAP = SIMILARITY / (1 + SIMILARITY)
TAU, SEGMENTS, SMALL = 44, 8, 64
#: Texts whose shingles are counted for the order, and the most common shingles that are known by name.
SAMPLE_TEXTS, KNOWN = 8_000, 200_000
#: How many shared shingles before its own a row knows, so that a pair is found at few of its common shingles.
EARLIER = 8
#: Bits of the filter that keeps most texts without a partner from being cut into shingles a second time.
FILTER_BITS = 1 << 23
_LOW = np.uint64((1 << 40) - 1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingle_hashes(w: list[bytes]) -> np.ndarray:
    """The set's 40-bit hashes, in ascending order: of two sets of 20,000 shingles, one in 3,000 pairs has a false match."""
    return np.unique(hashes(shingles(w, SHINGLE)) & _LOW)


def node_of(text: Column) -> list[Column]:
    """128 bits of the word sequence, upper and lower case apart: t0 and t1."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return [F.xxhash64(plain).alias("t0"), F.xxhash64(F.lit(7), plain).alias("t1")]


def prefix_lengths(n: int) -> tuple[int, int]:
    """How many of n shingles the larger and the smaller set of a pair must look at."""
    return (n - math.ceil(SIMILARITY * n - 1e-9) + 1, n - math.ceil(2 * OVERLAP * n - 1e-9) + 1) if n else (0, 0)


def _five_bytes(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(body, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least three texts of a sample have, and in how many."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_pydict({"h": pa.array(shingle_hashes(words(t.as_py())).view(np.int64))})

    rate = sample_rate(docs.count(), SAMPLE_TEXTS)
    some = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < rate * (1 << 20)).select(text_col).distinct()
    often = some.mapInArrow(rows, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(KNOWN).orderBy("h").toArrow()
    return often.column("h").to_numpy().astype(np.uint64), often.column("n").to_numpy()


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, id, n, central, f0, f1, keys): a row for each distinct word sequence, with its smallest id."""
    known = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, text_col))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = known.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "central", "f", "keys")}
            for t in batch.column("text"):
                h = shingle_hashes(words(t.as_py()))
                at = np.minimum(np.searchsorted(names, h), max(0, len(names) - 1))
                common = np.where(names[at] == h, counts[at], 0) if len(names) else np.zeros(len(h), np.int64)
                out["n"].append(len(h))
                out["central"].append(float((common > 0).mean()) if len(h) else 0.0)
                out["f"].append(fingerprint((h[:, None] * _MIX) ^ (h[:, None] * _MIX >> np.uint64(29))))
                out["keys"].append(_five_bytes(h[np.lexsort((h, common))[: prefix_lengths(len(h))[0]]]))
            f = np.array(out["f"], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "t0": batch.column("t0"), "t1": batch.column("t1"), "n": pa.array(out["n"], pa.int32()), "central": pa.array(out["central"], pa.float64()), "f0": pa.array(f[:, 0]), "f1": pa.array(f[:, 1]), "keys": pa.array(out["keys"], pa.binary())})

    seen = docs.select(F.col(id_col).alias("id"), *node_of(F.col(text_col)), F.col(text_col).alias("text")).mapInArrow(rows, f"id {dict(docs.dtypes)[id_col]}, t0 long, t1 long, n int, central double, f0 long, f1 long, keys binary")
    own = ("n", "central", "f0", "f1", "keys")
    once = seen.groupBy("t0", "t1").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in own])
    return durable_table(once.select(F.struct("t0", "t1").alias("node"), "id", *own))


def _key_rows(nodes: DataFrame) -> DataFrame:
    """(key, node, n, pos, central) of every prefix shingle that a node shares with one that it could be similar to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_from_five(k).view(np.int64) for k in batch.column("keys").to_pylist()]
            size = np.array([len(k) for k in keys], np.int64)
            row = np.repeat(np.arange(len(keys)), size)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            take = lambda c: batch.column(c).take(pa.array(row))  # noqa: B023, E731
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), "t0": take("t0"), "t1": take("t1"), "n": take("n"), "pos": pa.array(pos.astype(np.int32)), "central": take("central")})

    flat = nodes.select("node.t0", "node.t1", "n", F.round("central", 3).cast("float").alias("central"), "keys").mapInArrow(rows, "key long, t0 long, t1 long, n int, pos int, central float")
    # the smallest partner that a row could have is that of the nearest size below, the largest that of the one above
    n, by = F.col("n"), Window.partitionBy("key").orderBy("n")
    most = (n - F.col("pos")) / OVERLAP - n
    below, above = F.lag("n").over(by), F.lead("n").over(by)
    partner = (above <= most + 1e-9) | ((below >= SIMILARITY * n - 1e-9) & ((most >= n) | (F.min("n").over(Window.partitionBy("key")) <= most + 1e-9)))
    return durable_table(flat.withColumn("__p", F.coalesce(partner, F.lit(False))).filter("__p").drop("__p").select("key", F.struct("t0", "t1").alias("node"), "n", "pos", "central"))


def possible(x: str, y: str) -> Column:
    """Whether two rows of one key can belong to a similar pair, by their sizes and positions."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    return (F.least(nx, ny) >= SIMILARITY * F.greatest(nx, ny) - 1e-9) & (F.least(nx - px, ny - py) >= OVERLAP * (nx + ny) - 1e-9)


def ring(a: list[Column], b: list[Column]) -> Column:
    """Whether from some segment on, every chain of segments keeps within its share of TAU; the whole ring is the full
    Hamming check."""
    width = 128 // SEGMENTS
    per = 64 // width
    d = [x.bitwiseXOR(y) for x, y in zip(a, b, strict=True)]
    parts = F.array(*[F.bit_count(F.shiftrightunsigned(d[i // per], 64 - width * (i % per + 1)).bitwiseAND(F.lit((1 << width) - 1))) for i in range(SEGMENTS)])

    def starts(s: Column) -> Column:
        sums = F.aggregate(
            F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("ok")),
            lambda acc, i: F.struct((acc["sum"] + F.get(parts, F.pmod(s + i, F.lit(SEGMENTS)))).alias("sum"), (acc["ok"] & ((acc["sum"] + F.get(parts, F.pmod(s + i, F.lit(SEGMENTS)))) * SEGMENTS <= (i + 1) * TAU)).alias("ok")),
        )
        return sums["ok"]

    return F.exists(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), starts)


def _pruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints leave them a chance."""
    f = nodes.select("node", "n", "f0", "f1")
    both = pairs.join(f.select(F.col("node").alias("a"), F.struct("n", "f0", "f1").alias("x")), "a").join(f.select(F.col("node").alias("b"), F.struct("n", "f0", "f1").alias("y")), "b")
    near = ring([F.col("x.f0"), F.col("x.f1")], [F.col("y.f0"), F.col("y.f1")])
    return both.filter((F.least("x.n", "y.n") < SMALL) | near).select("a", "b")


def _place(t0: int, t1: int, doc_id: object) -> int:
    return xxhash.xxh64_intdigest(f"{t0} {t1} {doc_id}") % FILTER_BITS


def _sets(docs: DataFrame, nodes: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, own): the shingle sets of the nodes in `rows`, made where the text is read.

    A filter of a fixed number of bits keeps most other texts, and copies of one text, from being cut once more; what
    passes it by chance is never asked for.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": pa.array([_place(*x) + 1 for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.int64())})

    wanted = nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node.t0", "node.t1", "id").mapInArrow(places, "h long")
    bits = wanted.groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    whole = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in bits.collect():
        whole[r["b"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    asked = docs.sparkSession.sparkContext.broadcast(whole.ravel())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            t0, t1, own = [], [], []
            for i, x in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t0", "t1", "id")), strict=True)):
                at = _place(*x)
                if asked.value[at >> 3] >> (at & 7) & 1 and x[:2] not in done:
                    done.add(x[:2])
                    t0.append(x[0])
                    t1.append(x[1])
                    own.append(_five_bytes(shingle_hashes(words(batch.column("text")[i].as_py()))))
            yield pa.RecordBatch.from_pydict({"t0": pa.array(t0, pa.int64()), "t1": pa.array(t1, pa.int64()), "own": pa.array(own, pa.binary())})

    texts = docs.select(F.col(id_col).alias("id"), *node_of(F.col(text_col)), F.col(text_col).alias("text"))
    return durable_table(texts.mapInArrow(cut, "t0 long, t1 long, own binary").select(F.struct("t0", "t1").alias("node"), "own"))


def similar(x: bytes, y: bytes) -> bool:
    a, b = _from_five(x), _from_five(y)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a0", "a1", "b0", "b1"]).filter(pa.array(keep, pa.bool_()))

    left = sets.join(pairs, F.col("node") == F.col("a")).select("a", "b", F.col("own").alias("x"))
    both = sets.join(left, F.col("node") == F.col("b")).select(F.col("a.t0").alias("a0"), F.col("a.t1").alias("a1"), F.col("b.t0").alias("b0"), F.col("b.t1").alias("b1"), "x", F.col("own").alias("y"))
    found = both.mapInArrow(rows, "a0 long, a1 long, b0 long, b1 long")
    return durable_table(found.select(F.struct(F.col("a0").alias("t0"), F.col("a1").alias("t1")).alias("a"), F.struct(F.col("b0").alias("t0"), F.col("b1").alias("t1")).alias("b")).distinct())


def node_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, id, group): every distinct word sequence with its smallest id, and the least node of its group."""
    nodes = _nodes(docs, id_col, text_col)
    rows = _key_rows(nodes)
    sets = _sets(docs, nodes, rows, id_col, text_col)
    hubs = rows.groupBy("key").agg(F.max_by(F.struct("node", "n", "pos"), F.struct("central", "node")).alias("hub")).select("key", "hub.*")
    near = rows.alias("x").join(hubs.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & possible("x", "y"))
    shared = near.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    first = shared.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    links = _linked(_pruned(first, nodes), sets)
    earlier = F.collect_list("key").over(Window.partitionBy("node").orderBy("pos").rowsBetween(-EARLIER, -1))
    part = rows.withColumn("earlier", earlier).join(components(links).withColumnRenamed("component", "part"), "node", "left").select("key", "earlier", "node", "n", "pos", F.coalesce("part", "node").alias("part"))
    part = durable_table(part)
    sizes = part.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("part", F.struct("size", "part")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    outside = part.join(sizes, "key").filter("part <> largest")
    # where both have a shingle earlier in the order, the pair is found there already
    new = ~F.arrays_overlap("x.earlier", "y.earlier")
    cross = outside.alias("x").join(part.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part")) & new & possible("x", "y"))
    rest = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    final = components(links.union(_linked(_pruned(rest, nodes), sets)))
    groups = durable_table(nodes.join(final, "node", "left").select("node", "id", F.coalesce("component", "node").alias("group")))
    discard(nodes, rows, sets, part, links)
    return groups


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) for every row: the smallest id of its group of near-duplicates."""
    groups = node_groups(docs, id_col=id_col, text_col=text_col)
    least = groups.groupBy("group").agg(F.min("id").alias("component"))
    named = groups.join(least, "group").select("node.t0", "node.t1", "component")
    return docs.select(F.col(id_col), *node_of(F.col(text_col))).join(named, ["t0", "t1"]).select(id_col, "component")


def distinct_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: one of the smallest id; null ids come last."""
    groups = node_groups(docs, id_col=id_col, text_col=text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    kept = groups.groupBy("group").agg(first).select("first.node.t0", "first.node.t1", F.col("first.id").alias("id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *node_of(F.col(text_col)), F.col(id_col).alias("own"))
    on = (F.col("r.t0") == F.col("k.t0")) & (F.col("r.t1") == F.col("k.t1")) & F.col("r.own").eqNullSafe(F.col("k.id"))
    chosen = rows.alias("r").join(kept.alias("k"), on, "left_semi")
    nth = F.row_number().over(Window.partitionBy("t0", "t1", "own").orderBy("t0"))
    return chosen.withColumn("nth", nth).filter("nth = 1").select("row.*")
