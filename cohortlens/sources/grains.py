"""The maintained user grain: messages summed up by week, once, and added to by weekly runs.

One table has all that sections and trends count, a row a week and user. Kinds are `hour` (a user's messages by level,
weekday, hour and language), `topic` (by level and code) and `session` (the part of a session that lies in the week). All
of them come from one scan of the messages of new weeks, which are counted first, so that tasks are of one size. A run writes a partition of its own, the batch,
which holds the weeks that are new to the store, and then a line of the log that names the batches to read; so a reader
finds the last whole state, and a run that failed leaves nothing that counts. First days of users are a table of minima,
to which a batch adds only the users that it moves forward.

A session that goes on over a week's end has a part in each week; parts are mergeable, so old batches stay as they are.
Levels and labels are those of the run that wrote a week: after a change of the roster or of labels, `since` builds the
batches anew that have weeks from that Monday on.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import calendar as cal
from ..operators import facts
from .store import scratch, tasks

_DIMS = "level string, dow int, hour int, lang string, domain string, code string, session_started long"
GRAIN = f"pseudonym string, {_DIMS}, n long, lo timestamp, hi timestamp, monday date, batch string, kind string"
FIRST = "pseudonym string, first_seen date, batch string"
#: live: (batch, its last Monday) of what a reader has to read.
LOG = "at timestamp, live array<struct<batch: string, through: date>>"
#: Messages a task sums up.
MESSAGES = 150_000
_KEY = ["kind", "monday", "pseudonym", "level", "dow", "hour", "lang", "domain", "code", "session_started"]


def marks(labels: DataFrame, label_version: str, language_version: str) -> DataFrame:
    """(history_id, lang, codes): a message's language and codes, each of its version, from one pass over the labels."""
    language, code = F.col("domain") == "language", F.col("code")
    mine = labels.filter((F.col("value") == 1) & (F.col("label_version") == F.when(language, language_version).otherwise(label_version)))
    return mine.groupBy("history_id").agg(F.max(F.when(language, code)).alias("lang"), F.collect_list(F.when(~language, F.struct("domain", "code"))).alias("codes"))


def week_grain(rows: DataFrame, labelled: DataFrame, roster: DataFrame, n_tasks: int) -> DataFrame:
    """The grain of enriched messages; `labelled` is that of `marks`. Labels come first, as they go by message; then a
    message is dealt out by user once, before it becomes several rows, and level and grain need no further shuffle."""
    marked = rows.select("history_id", "pseudonym", "session_started", "local", "monday", "dow", "hour").join(labelled, "history_id", "left").drop("history_id")
    # both sides, as Spark would else take the number of tasks of the one that has none of its own
    m = facts.with_level(marked.repartition(n_tasks, "pseudonym"), roster.repartition(n_tasks, "pseudonym"), F.to_date(cal.local(F.timestamp_millis("session_started"))))
    none = {name: F.lit(None).cast(kind) for name, kind in (c.split() for c in _DIMS.split(", "))}

    def key(kind: str, **own: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[(own.get(name, none[name])).alias(name) for name in none])

    fixed = F.array(key("hour", level=F.col("level"), dow=F.col("dow"), hour=F.col("hour"), lang=F.coalesce("lang", F.lit("undetermined"))), key("session", level=F.col("level"), session_started=F.col("session_started")))
    topics = F.transform(F.coalesce("codes", F.array().cast("array<struct<domain: string, code: string>>")), lambda c: key("topic", level=F.col("level"), domain=c["domain"], code=c["code"]))
    each = m.select("monday", "pseudonym", "local", F.explode(F.concat(fixed, topics)).alias("k")).select("monday", "pseudonym", "k.*", "local")
    return each.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("local").alias("lo"), F.max("local").alias("hi"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def live(spark: SparkSession, folder: str) -> list[tuple[str, dt.date]]:
    """(batch, through) of the batches that count, by their last Monday."""
    last = _read(spark, f"{folder}/log", LOG).agg(F.max_by("live", "at")).first()[0]
    return sorted(((r["batch"], r["through"]) for r in last or []), key=lambda r: r[1])


def new_weeks(messages: DataFrame, through: dt.date, after: dt.date | None) -> DataFrame:
    """Messages of the weeks after `after` up to `through` (Mondays). A table partitioned by `week` is pruned to them."""
    week = F.col("week")
    label = lambda d: "{}-W{:02}".format(*d.isocalendar()[:2])
    if "week" in messages.columns:
        messages = messages.filter(week <= label(through))
        messages = messages.filter(week > label(after)) if after else messages
        return facts.enrich(messages.drop("week"))
    inside = F.col("monday") <= F.lit(through)
    return facts.enrich(messages).filter(inside & (F.col("monday") > F.lit(after)) if after else inside)


def update(corpus: facts.Corpus, folder: str, *, extracted: dt.date, axis_start: dt.date | None = None, label_version: str = "v1", language_version: str = "v1", since: dt.date | None = None) -> None:
    """Adds the complete weeks that the store lacks to `folder`; with `since`, batches with weeks from that Monday on are
    built anew."""
    spark, through = corpus.messages.sparkSession, facts.through_monday(extracted)
    kept = [b for b in live(spark, folder) if since is None or b[1] < since]
    after = kept[-1][1] if kept else None
    if after and after >= through:
        return
    batch = uuid.uuid4().hex
    rows = new_weeks(corpus.messages, through, after)
    inside = rows.filter(F.col("day") >= F.lit(axis_start)) if axis_start else rows
    grain = week_grain(inside, marks(corpus.labels, label_version, language_version), corpus.roster, tasks(spark, inside.count(), MESSAGES))
    # the aggregate's own partitions are written, as another shuffle would move the whole grain once more
    _write(grain.sortWithinPartitions("kind", "monday"), f"{folder}/grain", batch, "kind")
    known = _first(spark, folder, kept).withColumnRenamed("first_seen", "known")
    mine = rows.groupBy("pseudonym").agg(F.min("day").alias("first_seen"))
    _write(mine.join(known, "pseudonym", "left").filter("known is null or first_seen < known").select("pseudonym", "first_seen"), f"{folder}/first", batch)
    _log(spark, folder, [*kept, (batch, through)])


def erase(spark: SparkSession, folder: str, pseudonym: str) -> int:
    """Takes a user out of the store; gives the number of grain rows erased. Only batches that hold the user are written
    anew, and what they replace is deleted."""
    batches = live(spark, folder)
    names = [b for b, _ in batches]
    mine = (F.col("pseudonym") == pseudonym) & F.col("batch").isin(names)
    hit = {r[0]: r[1] for r in _read(spark, f"{folder}/grain", GRAIN).filter(mine).groupBy("batch").agg(F.count(F.lit(1))).collect()}
    old = set(hit) | {r[0] for r in _read(spark, f"{folder}/first", FIRST).filter(mine).select("batch").distinct().collect()}
    renamed = {b: uuid.uuid4().hex for b in old}
    for b, new in renamed.items():
        others = (F.col("batch") == b) & (F.col("pseudonym") != pseudonym)
        _write(_read(spark, f"{folder}/grain", GRAIN).filter(others).sortWithinPartitions("kind", "monday"), f"{folder}/grain", new, "kind")
        _write(_read(spark, f"{folder}/first", FIRST).filter(others), f"{folder}/first", new)
    if renamed:
        _log(spark, folder, [(renamed.get(b, b), through) for b, through in batches])
    path = spark._jvm.org.apache.hadoop.fs.Path
    for b in old:
        for top in ("grain", "first"):
            gone = path(f"{folder}/{top}/batch={b}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return sum(hit.values())


def _log(spark: SparkSession, folder: str, batches: list[tuple[str, dt.date]]) -> None:
    entry = spark.createDataFrame([(batches,)], "live array<struct<batch: string, through: date>>")
    entry.select(F.current_timestamp().alias("at"), "live").coalesce(1).write.mode("append").parquet(f"{folder}/log")


def _write(rows: DataFrame, path: str, batch: str, *by: str) -> None:
    rows.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", *by).parquet(path)


def _first(spark: SparkSession, folder: str, batches: list[tuple[str, dt.date]]) -> DataFrame:
    """(pseudonym, first_seen)"""
    rows = _read(spark, f"{folder}/first", FIRST).filter(F.col("batch").isin([b for b, _ in batches]))
    return rows.groupBy("pseudonym").agg(F.min("first_seen").alias("first_seen"))


def sessions(parts: DataFrame) -> DataFrame:
    """Whole sessions from their weeks' parts, in the week of their first message. A session has one level, that of the
    day on which it started."""
    minutes = (F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / 60e6
    s = parts.groupBy("pseudonym", "session_started", "level").agg(F.min("monday").alias("monday"), F.sum("n").alias("n_messages"), minutes.alias("minutes"))
    return s.select("pseudonym", "session_started", "monday", cal.week_id(F.col("monday")).alias("week"), "level", "n_messages", "minutes", F.lit(1).alias("n"))


def view(corpus: facts.Corpus, folder: str, *, extracted: dt.date, axis_start: dt.date | None = None, label_version: str = "v1", **_: object) -> facts.View:
    """What `facts.view` gives, over the store: no message is read."""
    spark, through = corpus.messages.sparkSession, facts.through_monday(extracted)
    batches = live(spark, folder)
    grain = _read(spark, f"{folder}/grain", GRAIN).filter(F.col("batch").isin([b for b, _ in batches]) & (F.col("monday") <= F.lit(through)))
    kind = lambda name: grain.filter(F.col("kind") == name)
    hours = kind("hour").withColumns({"week": cal.week_id(F.col("monday")), "day": F.date_add("monday", F.col("dow") - 1)})
    hours = hours.select("pseudonym", "monday", "week", "day", "level", "dow", "hour", "lang", "n", "lo", "hi")
    topic = kind("topic").select("pseudonym", "monday", "level", "domain", "code", "n")
    seen = _first(spark, folder, batches)
    reg = facts.registrations(corpus, through, axis_start)
    return facts.assemble(hours, hours, None, sessions(kind("session")), reg, seen, facts.positive_labels(corpus.labels, label_version), through, topic)


def stored(corpus: facts.Corpus, **options: object) -> facts.View:
    """A view over a store of its own, made for one use."""
    folder = scratch(corpus.messages.sparkSession)
    update(corpus, folder, **options)
    return view(corpus, folder, **options)
