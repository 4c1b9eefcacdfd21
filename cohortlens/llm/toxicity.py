"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into windows of words and
each window is compressed with either dictionary; how much shorter the toxic dictionary makes it is the window's
distance. A text's score is a logistic curve over its largest distances, calibrated on labelled texts, with 0.5 at the
threshold.

A word is a run of letters of one kind, of digits or of signs; a run of more than LAST bytes is cut into several. Scripts
that put no space between words have a word at every character, of DENSE characters, so that whatever stands before a
word does not hide it. Before compression every word is written as the codes of its prefixes of FIRST to LAST bytes, a
short word as if filled up to SHORT bytes. So two words share bytes just as far as they share a beginning, and a shared
ending, as common in ordinary words, saves nothing; a single sign, too short to match, is one code. A dictionary's own
part holds the prefixes that are significantly more frequent in its kind of text and occur in a fair share of it; both
have the same common words behind it.

Edge cases: null and empty texts are one empty window. Without both kinds of labelled text every score is 0. Repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored. Long texts have more windows,
and all are read. Rows without a label, or
with one that is neither 0 nor 1, are never learned from. Several labels of one id count as rows of their own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_rate, unit_hash

FIRST, LAST = 3, 9
SHORT, DENSE = 6, 3
WINDOW = 8
COMMON_BYTES = 4096
#: A toxic or ordinary prefix occurs in this share of its kind's texts at least.
SHARE = 0.02
TOP = 3
PROPERTIES = {"strategy": 1, "min_match": 5, "hash_log": 15, "chain_log": 15, "search_log": 4}


_LATIN = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0300-\u036f\u1e00-\u1eff"
_SIGNS = "!-/:-@\\[-`{-~\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u2bff\u3000-\u3004\u3008-\u3020\u3030\ufe10-\ufe6f\uff00-\uff20\uff3b-\uff40\uff5b-\uff65\U0001f000-\U0001faff"
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u302f\u3031-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
#: Words in groups: plain ones, ones of unspaced scripts.
WORD = re.compile(f"([{_LATIN}]+|[0-9]+|[{_SIGNS}]+|[^\\s0-9{_LATIN}{_SIGNS}{_UNSPACED}]+)|([{_UNSPACED}]+)")


def words(text: str | None) -> list[bytes]:
    out = []
    for plain, unspaced in WORD.findall((text or "").lower()):
        if unspaced:
            out += [unspaced[i : i + DENSE].encode() for i in range(len(unspaced))]
        else:
            w = plain.encode("utf-8", "surrogatepass")
            out += [w] if len(w) <= LAST else [w[i : i + LAST] for i in range(0, len(w), LAST)]
    return out


def _beginnings(word: bytes) -> list[bytes]:
    return [word[:k] for k in range(FIRST, min(len(word), LAST) + 1)]


def prefixes(word: bytes) -> list[bytes]:
    return [word] if len(word) == 1 and not word.isalnum() else _beginnings(word.ljust(SHORT, b"\0"))


def _codes(parts: list[bytes]) -> bytes:
    return b"".join(zlib.crc32(p).to_bytes(4, "little") for p in parts)


class Encoder(dict):
    """word -> its prefixes' codes; each batch starts afresh, which bounds it."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = out = _codes(prefixes(word))
        return out


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters.from_level(3, source_size=256, dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **PROPERTIES)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # of the largest distances, then the constant


def windows(text: str | None, code: Encoder) -> list[bytes]:
    w = list(map(code.__getitem__, words(text)))
    return [b"".join(w[i : i + WINDOW]) for i in range(0, max(1, len(w)), WINDOW)]


def largest(text: str | None, code: Encoder, toxic, ordinary) -> list[float]:
    """The TOP largest distances; zero where there are fewer windows."""
    d = sorted((len(ordinary(x)) - len(toxic(x)) for x in windows(text, code)), reverse=True)[:TOP]
    return [float(max(0, v)) for v in d] + [0.0] * (TOP - len(d))


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = set(words(text.as_py()))
            counts[toxic].update({p for w in own for p in prefixes(w)} | {b" " + w for w in own})
        both = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({"prefix": pa.array(both, pa.binary()), "ordinary": pa.array([counts[0][k] for k in both], pa.int64()), "toxic": pa.array([counts[1][k] for k in both], pa.int64())})


def bound(a: int, n: int, b: int, m: int) -> float:
    """Two standard errors below the log ratio of the rates a / n and b / m."""
    return math.log((a + 1) / (n + 2) * (m + 2) / (b + 1)) - 2 * math.sqrt(1 / (a + 1) + 1 / (b + 1))


def distinctive(own: dict[bytes, int], n: int, other: dict[bytes, int], m: int) -> list[bytes]:
    """Shortest prefixes that are significantly more frequent, each made longer while nearly all its uses agree.

    One of FIRST bytes is a single code, too short to match, and so does not stand for longer ones.
    """
    good = {p for p, c in own.items() if c >= max(3, SHARE * n) and bound(c, n, other.get(p, 0), m) > 2}
    child: dict[bytes, bytes] = {}
    for p, c in own.items():
        if len(p) > FIRST and c > own.get(child.get(p[:-1], b""), 0):
            child[p[:-1]] = p
    out = set()
    for p in good:
        if not any(p[:k] in good for k in range(FIRST + 1, len(p))):
            longer = p
            while own.get(child.get(longer, b""), 0) >= 0.85 * own[p]:
                longer = child[longer]
            out.add(longer)
    return sorted(out, key=lambda p: (own[p], p))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, trains: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 16_000) -> ToxicityModel:
    """Fit on about `max_docs` labelled rows of those where `trains` holds, chosen by a hash of the id.

    Half of them train the dictionaries, the other half calibrate. The driver gets the prefixes that occur in SHARE of
    either kind, the most common words and three numbers a calibration text, all bounded by the sample.
    """
    spark = docs.sparkSession
    marks = labels.filter(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("__toxic"))
    known = marks.filter(trains)
    rate = sample_rate(known.count(), max_docs)
    chosen = known.filter(unit_hash(id_col) < rate)
    half = F.pmod(F.xxhash64(F.lit("half"), F.col(id_col)), F.lit(2)) == 0
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(chosen, id_col).select("__toxic", "__text", half.alias("calibrates")).persist()
    learn = rows.filter("not calibrates").select("__toxic", "__text")
    n = {r[0]: r[1] for r in learn.groupBy("__toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        rows.unpersist()
        return ToxicityModel(b"", b"", ())
    counts = learn.mapInArrow(_prefix_counts, "prefix binary, ordinary long, toxic long").groupBy("prefix").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    often = counts.filter((F.col("ordinary") >= 0.3 * SHARE * n[0]) | (F.col("toxic") >= 0.3 * SHARE * n[1])).toArrow().to_pylist()
    by = ({}, {})
    common = Counter()
    for r in often:
        if r["prefix"].startswith(b" "):
            common[r["prefix"][1:]] = r["ordinary"] + r["toxic"]
        else:
            by[0][r["prefix"]], by[1][r["prefix"]] = r["ordinary"], r["toxic"]
    code = Encoder()
    stems = [distinctive(by[k], n[k], by[1 - k], n[1 - k]) for k in (0, 1)]
    special = {p for s in stems for p in s}
    plain = [w for w in common if special.isdisjoint(prefixes(w))]
    shared = b"".join(code[w] for w in sorted(plain, key=lambda w: (common[w], w)))[-COMMON_BYTES:]
    own = [b"".join(_codes(_beginnings(p)) for p in s) for s in stems]
    model = ToxicityModel(shared + own[1], shared + own[0], ())
    shipped = spark.sparkContext.broadcast(model)
    seen = rows.filter("calibrates").select("__toxic", "__text").mapInArrow(lambda it: _features(it, shipped), "id int, f array<double>").toArrow()
    rows.unpersist()
    y = seen.column(0).to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(model.toxic, model.ordinary, (1.0, 0.0, 0.0, -6.0))
    return ToxicityModel(model.toxic, model.ordinary, tuple(logistic(np.array(seen.column(1).to_pylist()), y).tolist()))


def _features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: ToxicityModel = model.value
    toxic, ordinary = (compressor(d).compress for d in (m.toxic, m.ordinary))
    for whole in batches:
        for at in range(0, whole.num_rows, 2500):
            batch, code = whole.slice(at, 2500), Encoder()
            rows = [largest(t.as_py(), code, toxic, ordinary) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "f": pa.array(rows, pa.list_(pa.float64()))})


def predict(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, distances) for every row. No shuffle."""
    kind, rows = dict(docs.dtypes)[id_col], docs.select(id_col, text_col)
    if not model.weights:
        return rows.select(id_col, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast("array<double>").alias("distances"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    seen = rows.mapInArrow(lambda it: _features(it, shipped), f"id {kind}, f array<double>")
    z = sum((F.col("f")[i] * w for i, w in enumerate(model.weights[:-1])), F.lit(model.weights[-1]))
    score = 1 / (1 + F.exp(-z))
    return seen.select(F.col("id").alias(id_col), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("f").alias("distances"))
