"""A corpus pipeline in five stages: each takes what its predecessor kept and is written before the next one reads it."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cohortlens.llm import langid, mixing, neardup, pieces, toxicity
from cohortlens.llm.common import checkpoint_folder, id_remainder, table


def _judged(docs: DataFrame, predict: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of `docs` whose own verdict holds: each row takes the place of its id, so that ids may be null or repeat."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return predict(rows).filter(condition).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (`und`) go."""
    model = langid.fit(docs, id_remainder("doc_id", 4) != 2)
    return _judged(docs, lambda rows: langid.predict(rows, model, id_col="row"), "lang_pred <> 'und'")


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    return _judged(docs, lambda rows: toxicity.predict(rows, model, id_col="row"), "predicted = 0")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, one of the smallest id; null ids come last."""
    return neardup.distinct_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files and rows follow the slots."""
    ordered = mixing.mix(docs).repartitionByRange("mix.slot").sortWithinPartitions("mix.slot", "mix.place")
    return ordered.select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, with `place`, its number in the order of the files and rows of `docs`: the mix. Encoding
    deals rows out anew, so that order would be lost without it. Where `docs` is no file, `place` is the plan's order."""
    keys = [c for c in ("doc_id", "source", "lang") if c in docs.columns]
    try:
        rows = docs.select(*keys, "text", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        rows = docs.select(*keys, "text", F.lit("").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    files = rows.groupBy("__file").agg((F.max("__row") + 1).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    first = files.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    names = [*keys, "__file", "__row"]  # the cast lets all of them be null, as what comes back from Python may be
    known = F.struct(*names).cast(f"struct<{', '.join(f'`{c}`: {dict(rows.dtypes)[c]}' for c in names)}>").alias("row")
    made = pieces.encode(rows.select(known, "text"), id_col="row").select("row.*", "ids", "n_pieces", "round_trip")
    return made.join(first, "__file").select(*keys, (F.col("__first") + F.col("__row")).alias("place"), "ids", "n_pieces", "round_trip")


STAGES = [("language", language), ("harmless", harmless), ("distinct_texts", distinct_texts), ("mixed", mixed), ("encoded", encoded)]

#: The stages' models can't be expressed in SQL; tests compare what the stages keep, and the mix's order, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"

    def step(docs: DataFrame, numbered: tuple[int, tuple]) -> DataFrame:
        i, (name, stage) = numbered
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        return spark.read.parquet(f"{folder}/{i}_{name}")

    return functools.reduce(step, enumerate(STAGES), table(spark, sf_dir, "documents"))
