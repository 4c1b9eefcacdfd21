"""Language-model scoring by a subword lattice.

The probability of a text is the product over its words and one end. A word's lattice has an edge for each vocabulary
piece that matches; log-space forward recursion sums all segmentations. The pieces' weights start from the existing
vocabulary's and are learned by expectation maximisation. That is `score`.

`word_score` is a second model beside it, in which a word that the corpus has may also be one edge, weighted by its
discounted count; the discount's mass is what the pieces' paths share. In both the probabilities of all words and the end
sum to at most 1.

Edge cases: null texts are empty and score as one end. Without rows to learn from, the vocabulary's own weights and an
even chance of an end are used. A character that no piece holds is spelt by its bytes. Repeated rows give repeated
rows; an empty table gives an empty result; other columns are ignored. Long texts are cut at words into blocks and their
sums are joined again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import durable_table
from .lattice import DEFAULT_VOCABULARY, MARK, Matcher, read_vocabulary, smoothed

CHUNK = 20_000
LN10 = math.log(10)


def split(texts: pa.Array) -> pa.ListArray:
    """Words between ASCII white space, with A-Z in lower case."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts))


def _texts(words: list[bytes]) -> list[str]:
    return [MARK + w.decode("utf-8", "surrogatepass") for w in words]


def _expect(batches: Iterator[pa.RecordBatch], matcher, log_p) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        words = _texts(batch.column(0).to_pylist())
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            total = total + matcher.value.lattice(part).expected(log_p.value, np.ones(len(part)))
    if isinstance(total, np.ndarray):
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "n": pa.array(total[used])})


@dataclass(frozen=True)
class Totals:
    tokens: int  # N, with the ends
    types: int  # V, with the end
    ends: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return min(0.9, max(0.1, self.once / (self.once + 2 * self.twice))) if self.once else 0.5

    def backoff(self) -> float:
        """The share of words (not ends) that the pieces' paths get."""
        return self.discount * self.types / self.tokens if self.tokens else 0.5

    def word(self) -> float:
        """The share of words that are not ends."""
        return (self.tokens - self.ends + self.discount) / self.tokens if self.ends else 0.5

    def end(self) -> float:
        return math.log10((self.ends - self.discount) / self.tokens) if self.ends else math.log10(0.5)


def _scored(batches: Iterator[pa.RecordBatch], matcher, log_p, totals: Totals) -> Iterator[pa.RecordBatch]:
    """word, n, places -> answers with n, the score by pieces and the score by words and pieces (log10)."""
    for batch in batches:
        words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        texts, pieces = _texts(words), np.empty(len(words))
        for at in range(0, len(words), CHUNK):
            pieces[at : at + CHUNK] = matcher.value.lattice(texts[at : at + CHUNK]).marginal(log_p.value)
        path, pieces = pieces + math.log(totals.backoff()), pieces + math.log(totals.word())
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(n - totals.discount, 0) / max(1, totals.tokens))
        yield blocks.answers(batch.column(2), batch.column(3).to_numpy(), {"n": n, "score": pieces / LN10, "word_score": np.logaddexp(path, whole) / LN10})


def score_texts(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, rounds: int = 2, strength: float = 5000.0) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score, word_score) for every row.

    The words' counts are shuffled once and written; the driver gets sums and a number for each vocabulary piece.
    """
    spark = docs.sparkSession
    rows = blocks.prepared(docs, id_col, text_col, learn)
    words = durable_table(blocks.word_rows(rows, split, "binary").groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("place").alias("places")))
    ends = rows.filter("learn").count()
    t = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    totals = Totals(t[0] + ends, t[1] + (ends > 0), ends, t[2], t[3])
    vocab = read_vocabulary(vocabulary)
    matcher, log_p = spark.sparkContext.broadcast(Matcher(vocab.pieces)), vocab.prior
    for _ in range(rounds if totals.tokens else 0):
        now = spark.sparkContext.broadcast(log_p)
        got = words.filter("n > 0").select("word").mapInArrow(lambda it, now=now: _expect(it, matcher, now), "piece int, n double").groupBy("piece").agg(F.sum("n")).toArrow()
        counts = np.zeros(vocab.size)
        counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
        log_p = smoothed(counts, vocab.prior, strength)
    fitted = spark.sparkContext.broadcast(log_p)
    found = words.select("word", "n", "places", F.xxhash64("word").alias("h")).mapInArrow(lambda it: _scored(it, matcher, fitted, totals), "block long, answer binary")
    smooth = totals.tokens + 0.5 * (totals.types + 1)
    end_base, end_score = math.log10((ends + 0.5) / smooth), totals.end()

    def combine(table: pa.Table | None, body: pa.RecordBatch, flat: np.ndarray, at: np.ndarray) -> pa.Table:
        n, score, word = (table.column(k).to_numpy() if table else np.zeros(0) for k in ("n", "score", "word_score"))
        base, known = np.log10((n + 0.5) / smooth), n > 0
        at = at.tolist()
        made = [(b - a + 1, int(known[i].sum()) + (ends > 0), float(base[i].sum()) + end_base, float(score[i].sum()) + end_score, float(word[i].sum()) + end_score) for a, b in zip(at[:-1], at[1:], strict=True) for i in (flat[a:b],)]
        c = list(zip(*made, strict=True))
        return pa.table({"id": body.column("id"), "learned": body.column("learn"), "n_tokens": pa.array(c[0], pa.int64()), "n_known": pa.array(c[1], pa.int64()), "train_tokens": pa.array([totals.tokens] * len(made), pa.int64()), "base_score": pa.array(c[2], pa.float64()), "score": pa.array(c[3], pa.float64()), "word_score": pa.array(c[4], pa.float64())})

    schema = f"id {dict(docs.dtypes)[id_col]}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, word_score double"
    return blocks.join_back(found, blocks.doc_rows(rows, split), combine, schema).withColumnRenamed("id", id_col)
