"""Language identification by segmentation-marginalised unigrams.

Every language has its own probabilities over the pieces of one fixed public vocabulary, fitted by expectation
maximisation over all segmentations of its training words. A text's likelihood in a language is the product of its
words' marginals, each a forward sum over all segmentations.

Edge cases: null texts and texts without a letter are `und` with score 0; so is every text if nothing can be learned
(no labelled row). Ties go to the language that sorts first. Rows of a null language are never learned from, but are
predicted. Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored. Long texts
are read whole, each distinct word once.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_rate, unit_hash
from .lattice import DEFAULT_VOCABULARY, MARK, Matcher, read_vocabulary, smoothed

#: Words that are scored together, and rows that share a list of words; both bound a worker's memory.
CHUNK, ROWS = 8_000, 1_000


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    matcher: Matcher
    log_p: np.ndarray  # a row for each piece and byte, a column for each language


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _text(word: bytes) -> str:
    return MARK + word.decode("utf-8", "surrogatepass")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            found[lang.as_py()].update(words((text.as_py() or "").encode("utf-8", "surrogatepass")))
        for lang, c in found.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(c.keys(), pa.binary()), "n": pa.array(c.values(), pa.int64())})


def _expect(batches: Iterator[pa.RecordBatch], matcher, log_p: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            by[lang][0].append(_text(word))
            by[lang][1].append(n)
        for lang, (ws, ns) in by.items():
            for at in range(0, len(ws), CHUNK):
                got = matcher.value.lattice(ws[at : at + CHUNK]).expected(log_p[lang], np.array(ns[at : at + CHUNK], float))
                total[lang] = total.get(lang, 0) + got
    for lang, v in total.items():
        used = np.flatnonzero(v)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "piece": pa.array(used, pa.int32()), "n": pa.array(v[used], pa.float64())})


def fit(docs: DataFrame, trains: Column, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY, max_docs: int = 12_000, rounds: int = 2, strength: float = 2000.0) -> LanguageModel:
    """Fit on about `max_docs` labelled rows of those where `trains` holds, chosen by a hash of the id.

    What reaches the driver is a number for each language and vocabulary piece.
    """
    vocab = read_vocabulary(vocabulary)
    spark = docs.sparkSession
    labelled = docs.filter(trains & F.col(lang_col).isNotNull())
    rate = sample_rate(labelled.count(), max_docs)
    sample = labelled.filter(unit_hash(id_col) < rate).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = sample.mapInArrow(_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    matcher = spark.sparkContext.broadcast(Matcher(vocab.pieces))
    log_p = {lang: vocab.prior for lang in languages}
    for _ in range(rounds if languages else 0):
        now = dict(log_p)
        rows = counts.mapInArrow(lambda it, now=now: _expect(it, matcher, now), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n")).toArrow()
        got = {lang: np.zeros(vocab.size) for lang in languages}
        for lang, piece, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            got[lang][piece] = n
        log_p = {lang: smoothed(got[lang], vocab.prior, strength) for lang in languages}
    counts.unpersist()
    return LanguageModel(languages, matcher.value, np.stack([log_p[x] for x in languages], axis=1) if languages else np.zeros((vocab.size, 0)))


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: LanguageModel = model.value
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            index: dict[bytes, int] = defaultdict(itertools.count().__next__)
            ids: list[np.ndarray | None] = []
            for text in batch.column(1):
                t = text.as_py()
                if t is None or not m.languages or not any(map(str.isalpha, t)):
                    ids.append(None)
                else:
                    ids.append(np.fromiter(map(index.__getitem__, words(t.encode("utf-8", "surrogatepass"))), np.int64))
            each = np.empty((len(index), len(m.languages)))
            texts = list(map(_text, index))
            for a in range(0, len(texts), CHUNK):
                each[a : a + CHUNK] = m.matcher.lattice(texts[a : a + CHUNK]).marginal(m.log_p)
            lang, score = [], []
            for i in ids:
                if i is None:
                    lang.append("und")
                    score.append(0.0)
                    continue
                total = each[i].sum(axis=0)
                best = int(total.argmax())
                lang.append(m.languages[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; score is the posterior under equal priors. No shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(id_col, text_col).mapInArrow(lambda it: _predict(it, shipped), f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double").withColumnRenamed("id", id_col)
