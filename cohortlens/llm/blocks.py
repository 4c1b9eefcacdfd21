"""Blocks of documents that share one list of distinct words.

Looking words up in a table that grows with the corpus would shuffle every token. Instead, a partition's documents are
cut into blocks of bounded size. Of each block, its distinct words travel to the table (one row a word and block) and
what was found travels back, packed; the documents travel once, as packed numbers into their block's words.

Both passes read the same input and must cut it alike, which holds for files and checkpoints; an input that comes out of
a shuffle is written first (`prepared`). A checksum of each block's words is compared in the end.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable_table

BLOCK_BYTES = 40_000_000
#: Bytes of text that are split at a time. A block keeps numbers and distinct words only, so this bounds a worker's memory.
SLICE_BYTES = 4_000_000
#: place = block * WORDS + the word's number in its block; block = partition * BLOCKS + number in its partition.
WORDS, BLOCKS = 1 << 28, 1 << 12
BATCH = 65_536


@dataclass
class Block:
    number: int
    words: pa.Array
    ids: pa.Array
    learn: np.ndarray
    digests: list[int]
    n: np.ndarray  # of words in each document
    flat: np.ndarray  # the documents' words as numbers, one document after another


#: Texts (no null among them) -> a list of words each.
Split = Callable[[pa.Array], pa.ListArray]
#: Words -> their parts, and for each word the numbers of its parts, one word after another, with where they begin.
Refine = Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Pieces of batches, and whether a block ends after each. Where blocks end depends on the rows alone."""
    size = 0
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            stop = int(np.searchsorted(total, before + BLOCK_BYTES - size)) + 1
            full, stop = stop <= batch.num_rows, min(stop, batch.num_rows)
            near = int(np.searchsorted(total, before + SLICE_BYTES)) + 1
            full, stop = full and stop <= near, min(stop, near)
            yield batch.slice(at, stop - at), full
            size = 0 if full else size + int(total[stop - 1]) - before
            at = stop


def unified(coded: list[pa.DictionaryArray]) -> tuple[pa.Array, list[np.ndarray]]:
    """One dictionary, in the order of first appearance, and each array's numbers in it."""
    chunks = pa.chunked_array(coded).unify_dictionaries().chunks
    return chunks[0].dictionary, [c.indices.to_numpy() for c in chunks]


def raw(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all values, one after another, and where each begins and the last one ends; none may be null."""
    if not len(texts):
        return b"", np.zeros(1, np.int64)
    _, offsets, body = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if texts.type in (pa.large_string(), pa.large_binary()) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return body.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if body else b"", at.astype(np.int64) - at[0]


def cut(batches: Iterator[pa.RecordBatch], split: Split, digest: Callable[[bytes], int] | None, refine: Refine | None = None) -> Iterator[Block]:
    """Blocks of the rows (id, text, learn); `refine` may cut a block's distinct words into parts."""
    numbers = itertools.count(TaskContext.get().partitionId() * BLOCKS)
    held: list[tuple] = []

    def block() -> Block:
        ids, learn, digests, tokens, n = map(list, zip(*held, strict=True))
        held.clear()
        words, flats = unified(tokens)
        tokens.clear()
        if refine:
            words, parts, first = refine(words)
            first, uses = first[:-1], np.diff(first)
            for i, flat in enumerate(flats):  # one slice after another, as this takes several numbers a word
                size = uses[flat]
                ends = np.cumsum(size)
                at = np.repeat(first[flat] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
                n[i] = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n[i])])])
                flats[i] = parts[at].astype(np.int32)
        return Block(next(numbers), words, pa.concat_arrays(ids), np.concatenate(learn), list(itertools.chain(*digests)), np.concatenate(n), np.concatenate(flats))

    for batch, full in _slices(batches):
        texts = pc.fill_null(batch.column(1), "")
        words = split(texts)
        digests = [digest(t) for t in texts.cast(pa.binary()).to_pylist()] if digest else [0] * len(texts)
        ids = pa.concat_arrays([batch.column(0).slice(0, 0), batch.column(0)])  # a copy, so that the batch and its texts can go
        held.append((ids, pc.fill_null(batch.column(2), False).to_numpy(zero_copy_only=False), digests, words.flatten().dictionary_encode(), pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)))
        if full:
            yield block()
    if held:
        yield block()


def hashed(words: pa.Array) -> np.ndarray:
    """As Spark's xxhash64."""
    body, at = raw(words)
    return np.fromiter((xxhash.xxh64_intdigest(body[a:b], 42) for a, b in itertools.pairwise(at.tolist())), np.uint64, len(words)).view(np.int64)


def pack(columns: dict) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as r:
        return r.read_next_batch()


def squeeze(numbers: np.ndarray) -> bytes:
    """Word numbers as four planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).ravel(), 3)


def unsqueeze(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(body), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def word_rows(docs: DataFrame, split: Split, kind: str, refine: Refine | None = None) -> DataFrame:
    """(word, place, n): a row for each distinct word of each block; n: its uses in the rows to learn from.
    `docs` has id, text, learn."""

    def rows(batches):
        for b in cut(batches, split, None, refine):
            n = np.bincount(b.flat[np.repeat(b.learn, b.n)], minlength=len(b.words))
            place = b.number * WORDS + np.arange(len(b.words))
            words = b.words.cast(pa.string() if kind == "string" else pa.binary())
            for at in range(0, len(b.words), BATCH):
                s = slice(at, at + BATCH)
                yield pa.RecordBatch.from_pydict({"word": words[s], "place": pa.array(place[s]), "n": pa.array(n[s].astype(np.int64))})

    return docs.mapInArrow(rows, f"word {kind}, place long, n long")


def doc_rows(docs: DataFrame, split: Split, digest: Callable[[bytes], int] | None = None, refine: Refine | None = None) -> DataFrame:
    """(block, body): a block's documents as numbers into its words."""

    def rows(batches):
        for b in cut(batches, split, digest, refine):
            body = pack({"id": b.ids, "learn": pa.array(b.learn), "digest": pa.array(b.digests, pa.uint64()), "n": pa.array(b.n, pa.int32())})
            head = pack({"words": pa.array([len(b.words)]), "check": pa.array([int(np.bitwise_xor.reduce(hashed(b.words), initial=0))])})
            yield pa.RecordBatch.from_pydict({"block": pa.array([b.number]), "head": pa.array([head], pa.binary()), "body": pa.array([body], pa.binary()), "tokens": pa.array([squeeze(b.flat)], pa.binary())})

    return docs.mapInArrow(rows, "block long, head binary, body binary, tokens binary")


def answers(places: pa.ListArray, h: np.ndarray, columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    """(block, answer): what was found for words, dealt out to the blocks that asked. h: the words' hashes."""
    where = places.flatten().to_numpy()
    row = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
    order = np.argsort(where, kind="stable")
    where, row = where[order], row[order]
    block = where // WORDS
    at = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        r = row[a:b]
        packed = {k: v.take(pa.array(r)) if isinstance(v, pa.Array) else pa.array(v[r]) for k, v in columns.items()}
        # places ascend, so their differences are small numbers
        steps = np.diff(where[a:b] % WORDS, prepend=0).astype(np.int32)
        out.append(pack({"place": pa.array(steps), "check": pa.array(np.full(b - a, np.bitwise_xor.reduce(h[r]))), **packed}))
    return pa.RecordBatch.from_pydict({"block": pa.array(block[at[:-1]] if len(block) else [], pa.int64()), "answer": pa.array(out, pa.binary())})


def gather(found: pa.Table, asked: pa.Table) -> tuple[pa.Table | None, pa.RecordBatch, np.ndarray, np.ndarray]:
    """All answers of a block in the order of its words, its documents, their words and where each document's begin."""
    parts = [unpack(x.as_py()) for x in found.column("answer")]
    parts = [p.set_column(0, "place", pa.array(np.cumsum(p.column("place").to_numpy(), dtype=np.int32))) for p in parts]
    head = unpack(asked.column("head")[0].as_py())
    table = pa.Table.from_batches(parts).sort_by("place") if parts else None
    check = int(np.bitwise_xor.reduce([p.column("check")[0].as_py() for p in parts], initial=0))
    if asked.num_rows != 1 or head.column("words")[0].as_py() != (table.num_rows if table else 0) or head.column("check")[0].as_py() != check:
        raise ValueError("the documents came in another order when read again")
    body = unpack(asked.column("body")[0].as_py())
    at = np.concatenate([[0], np.cumsum(body.column("n").to_numpy().astype(np.int64))])
    return table, body, unsqueeze(asked.column("tokens")[0].as_py()), at


def stretches(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents that have `size` words at most, or one document each. at: where each document's words begin."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, b
        a = b


def join_back(found: DataFrame, asked: DataFrame, combine: Callable[[pa.Table | None, pa.RecordBatch, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        return combine(*gather(left, right))

    return found.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(whole, schema)


def prepared(docs: DataFrame, id_col: str, text_col: str, learn) -> DataFrame:
    """(id, text, learn); written first where the plan deals rows out, as they may then come in another order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), learn.alias("learn"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return durable_table(rows) if "Exchange" in plan or "InMemoryTableScan" in plan else rows
