"""SimHash near-dedup with pigeonring filtering.

A fingerprint bit is 1 if it is set in more than half of the features' hashes. The bits form a ring of segments. Of two
fingerprints that differ in at most tau bits, some segment starts a chain whose first l segments differ in at most
l * tau / m bits, for every l up to the number m of segments. Where tau < m the first segment must be equal, so
fingerprints are joined on the start and that segment. The first two segments differ in 2 * tau / m bits at most, fewer
than the second has halves if tau < m, so one of its halves is equal too and is part of the key. A pair must pass all of
the chain's budgets, the last of which is the full Hamming check, within the join condition. Each start's row holds the
ring turned to that start. `link_fingerprints` finds every link.

Edge cases: null and empty texts, or ones without a word, have fingerprint 0. Texts of fewer words than a shingle are one
shingle. Equal fingerprints are collapsed first, so copies cost no pairs. Repeated rows give repeated rows. A row of a null
id gets the smallest id of its component, and null where all ids in it are null. Long texts are hashed whole. An empty
table gives an empty result; other columns, of whatever names, are ignored or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components

SEED = 42


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(w: list[bytes], k: int) -> list[bytes]:
    if len(w) < k:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


def hashes(features: list[bytes], seed: int = SEED) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, features, repeat(seed)), np.uint64, len(features))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """h: a row for each feature, of 64-bit words; one row of words comes out."""
    if not len(h):
        return np.zeros(h.shape[1], np.int64)
    ones = np.unpackbits(np.ascontiguousarray(h).astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h)).view(">u8").astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): 64 bits over all k-word shingles, repeats included. No shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [int(fingerprint(hashes(shingles(words(t.as_py()), k))[:, None])[0]) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "fp": pa.array(made, pa.int64())})

    return docs.select(id_col, text_col).mapInArrow(rows, f"id {dict(docs.dtypes)[id_col]}, fp long").withColumnRenamed("id", id_col)


def _turned(fp: list[Column], at: int) -> list[Column]:
    """The ring of 64-bit words, turned left by `at` bits."""
    n, (w, s) = len(fp), divmod(at, 64)
    take = lambda i: fp[(w + i) % n]
    return [take(i) if s == 0 else F.shiftleft(take(i), s).bitwiseOR(F.shiftrightunsigned(take(i + 1), 64 - s)) for i in range(n)]


def _top(bits: int) -> int:
    """A signed 64-bit mask of the upper bits."""
    m = ((1 << bits) - 1) << (64 - bits)
    return m - (1 << 64) if m >> 63 else m


def turned(nodes: DataFrame, fp: list[str], m: int, keep: list[str]) -> DataFrame:
    """Two rows for each node and start: `ring` (start, first segment and a half of the second) and the turned words."""
    size = 64 * len(fp)
    cuts = [round(i * size / m) for i in range(m + 1)]
    ends = [cuts[i % m + 1] - cuts[i % m] for i in range(2 * m)]
    starts = []
    for i in range(m):
        r = _turned([F.col(c) for c in fp], cuts[i])
        first, half = ends[i], ends[i + 1] // 2
        for at, width, which in ((0, half, 0), (half, ends[i + 1] - half, 1)):
            part = F.shiftrightunsigned(F.shiftleft(r[0], first + at), 64 - width)
            key = F.struct(F.lit(2 * i + which).alias("start"), F.shiftrightunsigned(r[0], 64 - first).alias("first"), part.alias("half"))
            starts.append(F.struct(key.alias("ring"), F.lit(i).alias("start"), *[x.alias(f"r{j}") for j, x in enumerate(r)]))
    return nodes.select(*keep, F.explode(F.array(*starts)).alias("s")).select(*keep, "s.*")


def chain(a: str, b: str, n: int, m: int, tau: int) -> Column:
    """Whether the chain from the start stays within all budgets; a, b: the sides' aliases."""
    cuts = [round(i * 64 * n / m) for i in range(m + 1)]
    size = [y - x for x, y in zip(cuts, cuts[1:], strict=False)]
    diff = [F.col(f"{a}.r{j}").bitwiseXOR(F.col(f"{b}.r{j}")) for j in range(n)]
    out = F.lit(True)
    for count in range(2, m + 1):
        lengths = [sum((size * 2)[i : i + count]) for i in range(m)]
        parts = []
        for j in range(n):
            masks = [_top(max(0, min(64, x - 64 * j))) for x in lengths]
            if any(masks):
                mask = F.lit(masks[0]) if len(set(masks)) == 1 else F.element_at(F.array(*map(F.lit, masks)), F.col(f"{a}.start") + 1)
                parts.append(F.bit_count(diff[j] if set(masks) == {-1} else diff[j].bitwiseAND(mask)))
        out &= sum(parts[1:], parts[0]) <= count * tau // m
    return out


def pairs(rows: DataFrame, n: int, m: int, tau: int, key: str) -> DataFrame:
    """(a, b) of all rows that share a ring key and pass the chain."""
    on = (F.col("x.ring") == F.col("y.ring")) & (F.col(f"x.{key}") < F.col(f"y.{key}")) & chain("x", "y", n, m, tau)
    joined = rows.alias("x").join(rows.alias("y"), on)
    return joined.select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).distinct()


def link_fingerprints(prints: DataFrame, *, id_col: str = "doc_id", tau: int = 2, segments: int = 3) -> DataFrame:
    """`prints` (id, fp) with `component`: the smallest id that can be reached over fingerprints at most tau bits apart."""
    if tau >= segments or segments < 2:
        raise ValueError("an equal segment is certain only for fewer differing bits than segments")
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("rep"))
    links = pairs(turned(classes, ["fp"], segments, ["fp"]), 1, segments, tau, "fp")
    parts = components(links)
    grouped = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("part"))
    least = grouped.groupBy("part").agg(F.min("rep").alias("component"))
    return prints.join(grouped.join(least, "part").select("fp", "component"), "fp")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
