"""Prefix trie of conversations by vertical bitmaps.

A turn is known by a 128-bit key of (role, text); a prefix by the exclusive or of its (position, turn) keys, so texts are
read once and never shuffled. Conversations are cut into segments of SEGMENT turns, and units (a conversation's
segment) sorted by id are dealt out to shards of SHARD units each. A shard indexes (position, turn) to bitsets of its units
and walks depth-first: a parent's bitset, intersected with the postings of the next position, gives the children,
popcounts and lists of members that end.

Shards' nodes are then summed up by prefix. What needs the whole subtree is shared out by ownership: a node belongs to its
smallest member, which owns all deeper nodes on its own path as well. So one number a conversation, the depth from
which on it owns, says which nodes a shard has to count, and a second walk gives children, leaves and tokens as plain
sums over shards: no iteration over depths and no task that sees more than a shard.

Edge cases: null conversation ids are no conversation; null role or text is empty; a null turn comes first; rows of one
turn number are ordered by role and a hash of the text, and repeated rows are turns of their own. A conversation without
turns is a member of the root. An empty table gives no node. Input columns but the four named are not read. Very long
texts cost their hash alone.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable_table

#: Turns of a unit, units of a shard, and turn numbers that are numbered together.
SEGMENT, SHARD, TOGETHER = 64, 2048, 1024


def turn_keys(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, k1, k2, chars): each turn's number from 1 on, its key and its text's code points.

    Rows are numbered within TOGETHER consecutive turn numbers of a conversation, so a very long one is many tasks'."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("k1"), F.xxhash64(F.lit(2), role, text).alias("k2"), F.char_length(text).alias("chars"))
    turns = turns.filter("conv_id is not null").withColumn("part", F.floor(F.col("turn") / TOGETHER))
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "k1", "k2"))
    counts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("part")).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = turns.withColumn("nth", nth).join(first, (F.col("conv_id") == F.col("c")) & F.col("part").eqNullSafe(F.col("p")))
    return numbered.select("conv_id", (F.col("first") + F.col("nth")).alias("pos"), "k1", "k2", F.col("chars").cast("long").alias("chars"))


def units(keys: DataFrame) -> DataFrame:
    """(seg, conv_id, turns, x1, x2, total, tail): a row for each conversation and segment: its turns (pos, t1, t2, chars),
    the key of the prefix before it, all turns of the conversation, and the code points after it. A row of `keys` with
    position 0 stands for a conversation without turns."""
    at = F.col("pos") > 0
    cut = keys.select("conv_id", F.floor((F.greatest("pos", F.lit(1)) - 1) / SEGMENT).cast("int").alias("seg"), F.when(at, F.struct("pos", F.xxhash64("pos", "k1", "k2").alias("t1"), F.xxhash64(F.lit(1), "k2", "k1", "pos").alias("t2"), "chars")).alias("t"))
    made = cut.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.bit_xor("t.t1").alias("y1"), F.bit_xor("t.t2").alias("y2"), F.coalesce(F.sum("t.chars"), F.lit(0)).alias("chars"))
    made = durable_table(made)
    every = Window.partitionBy("conv_id").orderBy("seg")
    before, so_far, all_rows = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    key = lambda y: F.coalesce(F.bit_xor(y).over(before), F.lit(0)).alias(y.replace("y", "x"))
    heads = made.select("conv_id", "seg", key("y1"), key("y2"), F.sum(F.size("turns")).over(all_rows).alias("total"), (F.sum("chars").over(all_rows) - F.sum("chars").over(so_far)).alias("tail"))
    return durable_table(made.select("seg", "conv_id", "turns").join(heads, ["conv_id", "seg"]))


class _Shard:
    """The walk over one shard: units of one segment, by ascending id."""

    def __init__(self, rows: list[dict]):
        self.rows, self.base = rows, rows[0]["seg"] * SEGMENT
        self.sizes = [len(r["turns"]) for r in rows]
        most = max(self.sizes)
        self.post: list[dict[tuple[int, int], int]] = [defaultdict(int) for _ in range(most)]
        self.inside, self.goes_on, starts = [0] * (most + 1), 0, defaultdict(int)
        for i, r in enumerate(rows):
            bit = 1 << i
            starts[r["x1"], r["x2"]] |= bit
            for p, t in enumerate(r["turns"]):
                self.post[p][t["t1"], t["t2"]] |= bit
                self.inside[p] |= bit
            if r["total"] > self.base + self.sizes[i]:
                self.goes_on |= bit
        # nodes: (place, members, key, parent's number, code points); parents come before their children
        self.nodes: list[tuple] = [(0, bits, *key, -1, 0) for key, bits in sorted(starts.items())]
        self.roots = len(self.nodes)
        todo = list(range(self.roots))
        while todo:
            k = todo.pop()
            p, bits, x1, x2, _, _ = self.nodes[k]
            rest = bits & self.inside[p]
            while rest:
                t = rows[(rest & -rest).bit_length() - 1]["turns"][p]
                below = bits & self.post[p][t["t1"], t["t2"]]
                rest ^= below
                todo.append(len(self.nodes))
                self.nodes.append((p + 1, below, x1 ^ t["t1"], x2 ^ t["t2"], k, t["chars"]))

    def members(self, bits: int) -> Iterator[dict]:
        while bits:
            low = bits & -bits
            yield self.rows[low.bit_length() - 1]
            bits ^= low

    def counted(self) -> Iterator[tuple]:
        """Of each node but those that the segment before has: its parent's key, members, and those that end there."""
        for k, (p, bits, x1, x2, up, chars) in enumerate(self.nodes):
            if k < self.roots and self.base:
                continue
            above = self.nodes[up][2:4] if up >= 0 else (None, None)
            ends = bits & ~self.inside[p] & ~(self.goes_on if p == SEGMENT else 0)
            listed = ",".join(str(r["conv_id"]) for r in self.members(ends)) if ends else None
            first = self.rows[(bits & -bits).bit_length() - 1]["conv_id"]
            yield (self.base + p, x1, x2, *above, bits.bit_count(), first, bits != ends, chars, self.rows[(ends & -ends).bit_length() - 1]["conv_id"] if ends else None, listed)

    def summed(self) -> Iterator[tuple]:
        """Of the same nodes: children, leaves below and tokens saved, as far as this shard's conversations own them."""
        owned, leaves = [0] * (SEGMENT + 2), 0
        for i, r in enumerate(self.rows):
            if r["own"] is not None:
                for p in range(max(r["own"] - self.base, 0), min(r["total"] - self.base, SEGMENT + 1) + 1):
                    owned[p] |= 1 << i
                leaves |= r["leaf"] << i
        saved = [0] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            p, bits, _, _, up, chars = self.nodes[k]
            saved[k] += (bits.bit_count() - bool(bits & owned[p])) * chars
            for r in self.members(bits & self.goes_on if p == SEGMENT else 0):
                saved[k] += r["tail"] - min(r["tail"], r["owned"] or 0)
            if up >= 0:
                saved[up] += saved[k]
        for k, (p, bits, x1, x2, _, _) in enumerate(self.nodes):
            if k >= self.roots or not self.base:
                yield (self.base + p, x1, x2, (bits & owned[p + 1]).bit_count(), (bits & leaves).bit_count(), saved[k])


_COUNTED = "depth long, x1 long, x2 long, up1 long, up2 long, n long, least long, deeper boolean, chars long, end_id long, ends string"
_SUMMED = "depth long, x1 long, x2 long, children long, leaves long, saved long"
_NODE = ["depth", "x1", "x2"]


def _walked(rows: DataFrame, what: str, schema: str) -> DataFrame:
    """`what` of every shard: a partition has a range of (segment, id), and its units are walked SHARD at a time."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def walk(held: list[dict]) -> Iterator[pa.RecordBatch]:
        found = list(getattr(_Shard(held), what)())
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[at : at + 10_000], strict=True), kinds, strict=True)], names)

    def work(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == SHARD or held[0]["seg"] != row["seg"]):
                    yield from walk(held)
                    held = []
                held.append(row)
        if held:
            yield from walk(held)

    return rows.repartitionByRange("seg", "conv_id").sortWithinPartitions("seg", "conv_id").mapInArrow(work, schema)


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): of each node's lists, in the order of their first id. A node's lists pass one after
    another through the hash, so that none has to be held whole."""

    def work(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                here = (row["depth"], row["x1"], row["x2"])
                if here != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = here, hashlib.sha256(row["ends"].encode())
                else:
                    digest.update(b"," + row["ends"].encode())
            if done:
                yield made(done)
        if key:
            yield made([(*key, digest.hexdigest())])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (*[pa.int64()] * 3, pa.string()), strict=True)], [*_NODE, "ends_sha256"])

    return ends.repartition(*_NODE).sortWithinPartitions(*_NODE, "end_id").mapInArrow(work, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(keys: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (each node's members but one, times the code points of its text, over the subtree) and ends_sha256.

    `keys` are those of `turn_keys` with whole numbers as ids; a row of position 0 stands for a conversation as such.
    """
    rows = units(keys)
    counted = durable_table(_walked(rows, "counted", _COUNTED))
    nodes = counted.groupBy(*_NODE).agg(F.first("up1").alias("up1"), F.first("up2").alias("up2"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max("deeper").alias("deeper"), F.max("chars").alias("chars"))
    nodes = durable_table(nodes)
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("own"), F.max((~F.col("deeper")).cast("int")).alias("leaf"), F.sum("chars").alias("owned"))
    summed = _walked(durable_table(rows.join(owners, "conv_id", "left")), "summed", _SUMMED)
    sums = summed.groupBy(*_NODE).agg(F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ended = _digests(counted.filter("ends is not null").select(*_NODE, "end_id", "ends"))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("up1"), F.col("x2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, _NODE).join(ended, _NODE, "left").join(up, ["depth", "up1", "up2"], "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
