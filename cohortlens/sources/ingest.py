"""Incremental, pseudonymised ingest and erasure, as set operations on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text
from ..operators.facts import enrich
from ..operators.labels import insert_or_ignore
from . import files
from .store import settled
from .versioned import Table
from .versioned import bucket as versioned_bucket


def jdbc(spark: SparkSession, url: str, table: str, *, key: str, bounds: tuple[int, int], partitions: int = 64, fetch: int = 5000, **options: str) -> DataFrame:
    """A partitioned scan of a source database; filters on it and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, fetchsize=fetch, preferTimestampNTZ="true", **options)
    return reader.load()


def scan_above(spark: SparkSession, url: str, table: str, above: int, columns: list[str], *, key: str = "id", rows_per_task: int = 1_000_000, most_tasks: int = 256, **options: str) -> DataFrame:
    """`columns` of the rows of a source table whose `key` is above the watermark, read in ranges of the key.

    The source itself finds how far the key goes (one row comes back); so a weekly run's ranges cover the new rows only,
    and there are as many as those need, up to `most_tasks` connections.
    """
    named = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    ends = f"(SELECT MIN({named}) AS lo, MAX({named}) AS hi FROM {table} WHERE {named} > {int(above)}) ends"
    first, last = spark.read.format("jdbc").options(url=url, dbtable=ends, **options).load().first()
    new = F.col(key) > above
    first, last = (above + 1, above) if first is None else (first, last)
    tasks = max(1, min(most_tasks, -(-(last + 1 - first) // rows_per_task)))
    return jdbc(spark, url, table, key=key, bounds=(first, last + 1), partitions=tasks, **options).filter(new).select(*columns)


def watermark(messages: DataFrame) -> int:
    """The largest id read so far; ids only grow, so a row with a smaller id that comes later is never read."""
    return messages.agg(F.coalesce(F.max("history_id"), F.lit(0))).first()[0]


def new_students(students: DataFrame, key: bytes) -> DataFrame:
    """(pseudonym, registered_at); users without a registration time are left out."""
    s = students.filter("created_at is not null")
    return s.select(text.hmac_sha256(text.normal_uid(F.col("uid")), key).alias("pseudonym"), F.col("created_at").alias("registered_at"))


def new_messages(history: DataFrame, students: DataFrame, above: int, key: bytes) -> DataFrame:
    """Rows of `history` above the watermark with their user's pseudonym; a row without a time raises."""
    users = students.select("student_id", text.hmac_sha256(text.normal_uid(F.col("uid")), key).alias("pseudonym"))
    h = history.filter(F.col("id") > above).join(users, "student_id")
    time = F.when(F.col("created_at").isNotNull(), F.col("created_at")).otherwise(F.raise_error(F.concat(F.lit("history row without created_at: "), F.col("id"))))
    return h.select(F.col("id").alias("history_id"), "pseudonym", F.col("started").alias("session_started"), time.alias("created_at"))


def with_new_students(known: DataFrame, students: DataFrame, key: bytes) -> DataFrame:
    """The first registration of a pseudonym stays."""
    first = new_students(students, key).groupBy("pseudonym").agg(F.min("registered_at").alias("registered_at"))
    return insert_or_ignore(known, first, ["pseudonym"])


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def ingest(spark: SparkSession, store: str, students: DataFrame, history: DataFrame, key: bytes) -> int:
    """One weekly run into the folder `store`: students first seen, messages above the watermark, by week, and the time
    of the run, also if nothing is new. Returns the number of new messages.

    The watermark is the largest id in the store, so a run that fails between two writes is made good by the next.
    """
    known = stored(spark, f"{store}/students", "pseudonym string, registered_at timestamp_ntz")
    new_students(students, key).groupBy("pseudonym").agg(F.min("registered_at").alias("registered_at")).join(known, "pseudonym", "left_anti").write.mode("append").parquet(f"{store}/students")
    had = stored(spark, f"{store}/messages", "history_id long, pseudonym string, session_started long, created_at timestamp_ntz, week string")
    above = watermark(had)
    rows = enrich(new_messages(history, students, above, key)).select("history_id", "pseudonym", "session_started", "created_at", "week")
    rows.repartition("week", F.pmod("history_id", F.lit(16))).write.mode("append").partitionBy("week").parquet(f"{store}/messages")
    now = spark.read.schema(had.schema).parquet(f"{store}/messages").filter(F.col("history_id") > above).agg(F.count(F.lit(1)), F.max("history_id")).first()
    files.write_watermark(spark, f"{store}/watermark", now[1] or above)
    return now[0]


def check_key(stored: str | None, key: bytes, *, adopt: bool = True) -> str:
    """The fingerprint to store; another key than before raises, and erasure never adopts one."""
    own = text.fingerprint(key)
    if stored is None and not adopt:
        raise ValueError("no key is known here")
    if stored not in (None, own):
        raise ValueError("this is not the key that the pseudonyms were made with")
    return own


def erase(tables: dict[str, DataFrame], pseudonym: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without a user, and (table, erased) counts.

    Tables with a pseudonym lose the user's rows; tables with a history_id lose the rows of the user's messages.
    """
    gone = tables["messages"].filter(F.col("pseudonym") == pseudonym).select("history_id").distinct()
    kept, counts = {}, None
    for name, t in tables.items():
        if "pseudonym" in t.columns:
            hit = t.filter(F.col("pseudonym") == pseudonym)
            kept[name] = t.filter(F.coalesce(F.col("pseudonym") != pseudonym, F.lit(True)))
        else:
            hit, kept[name] = t.join(gone, "history_id", "left_semi"), t.join(gone, "history_id", "left_anti")
        n = hit.agg(F.count(F.lit(1)).alias("erased")).select(F.lit(name).alias("table"), "erased")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def erase_stored(messages: Table, by_user: dict[str, Table], by_message: dict[str, Table], pseudonym: str, buckets: int) -> dict[str, int]:
    """Takes a user out of stored tables; table -> rows erased. Only partitions that hold the user are read whole and
    written anew.

    `messages` is searched by pseudonym, which Parquet's statistics and column pruning make cheap. Tables by user and by
    message have a partition column `bucket` (of the pseudonym and of the history_id, out of `buckets`), so theirs follow
    from the ids. Messages go last: a run that stops before can be repeated.
    """
    spark = messages.spark
    rows = messages.read().filter(F.col("pseudonym") == pseudonym)
    old = messages.folders_of(rows)
    gone = settled(rows.select("history_id", versioned_bucket(F.col("history_id"), buckets).alias("bucket")))
    erased = {name: t.delete(t.touched(gone), gone, ["history_id"]) for name, t in by_message.items()}
    user = spark.range(1).select(F.lit(pseudonym).alias("pseudonym")).withColumn("bucket", versioned_bucket(F.col("pseudonym"), buckets))
    erased |= {name: t.delete(t.touched(user), user, ["pseudonym"]) for name, t in by_user.items()}
    return erased | {"messages": messages.delete(old, user, ["pseudonym"])}
