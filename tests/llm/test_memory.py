"""What a worker needs to cut documents into blocks, and to put them together again, does not grow with the block."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cohortlens.llm import blocks, lattice, pieces


@pytest.fixture
def task(monkeypatch):
    monkeypatch.setattr(blocks, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("U", (), {"partitionId": staticmethod(lambda: 3)}))}))


def texts(n):
    rng = random.Random(4)
    return ["".join(rng.choices(["tion", "er", "ing", " ", " ", "on", "é", "an"], k=400)) for _ in range(n)]


def test_a_worker_needs_little_more_than_a_block_holds(task, monkeypatch):
    """numpy's and Python's memory, as Arrow's is not traced. Cut at once, these texts take 24 bytes for each byte of theirs."""
    monkeypatch.setattr(blocks, "SLICE_BYTES", 100_000, raising=False)
    monkeypatch.setattr(pieces, "REFINED", 2_000, raising=False)
    refine, some = pieces.refiner(lattice.read_vocabulary()), texts(2000)
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(some))), "text": some, "learn": [False] * len(some)})
    tracemalloc.start()
    (block,) = blocks.cut(iter([batch]), pieces.split, None, refine)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * sum(len(t.encode()) for t in some), most / sum(len(t.encode()) for t in some)


def test_raw_bytes_of_slices():
    words = pa.array(["", "é", "abc", "", "日本"])
    for part in (words, words[1:4], words[5:], words.cast(pa.binary())[2:], words.cast(pa.large_string())[1:]):
        body, at = blocks.raw(part)
        assert [body[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == part.cast(pa.large_binary()).to_pylist()
        assert blocks.hashed(part).tolist() == [np.uint64(xxhash.xxh64_intdigest(b, 42)).view(np.int64) for b in part.cast(pa.large_binary()).to_pylist()]


def test_stretches_have_all_documents_once():
    at = np.cumsum([0, 3, 0, 9, 1, 1, 0])
    assert list(blocks.stretches(at, 4)) == [(0, 2), (2, 3), (3, 6)] and list(blocks.stretches(at[:1], 4)) == []
