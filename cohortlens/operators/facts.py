"""Row facts: enriched messages, sessions, registrations, levels, windows. Everything else is built on a `View`."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal

LEVELS = ("bachelor", "master", "staff", "unknown")
LANGUAGES = ("de", "en", "other", "undetermined")
SLICE_WEEKS = 4


@dataclass(frozen=True)
class Corpus:
    """Base tables: messages(history_id, pseudonym, session_started, created_at), students(pseudonym, registered_at),
    roster(pseudonym, status, ma_start_semester), labels(history_id, label_version, domain, code, value)."""

    messages: DataFrame
    students: DataFrame
    roster: DataFrame
    labels: DataFrame


@dataclass(frozen=True)
class View:
    """`rows` are the enriched messages and `msg` the same with their level; `language` has (history_id, lang). Each
    section takes the narrowest that it needs, as every further column is a join of all messages.

    A row stands for `n` messages between `lo` and `hi`: one in a view over messages, more in a view over stored grains
    (`sources.grains`), whose rows have `lang` already and whose `topic` has (monday, pseudonym, level, domain, code, n).
    """

    rows: DataFrame
    msg: DataFrame
    language: DataFrame | None
    sess: DataFrame
    reg: DataFrame
    first_seen: DataFrame
    positives: DataFrame
    axis: DataFrame
    win: DataFrame
    win_week: DataFrame
    topic: DataFrame | None = None


def level_at(status: Column, ma_start: Column, day: Column) -> Column:
    """A user with a transition term is a master student from its first day on and has the own status before."""
    moved = F.when(day >= cal.term_start(ma_start), "master").otherwise(status)
    return F.coalesce(F.when(ma_start.isNotNull(), moved).otherwise(status), F.lit("unknown"))


def with_level(df: DataFrame, roster: DataFrame, day: Column) -> DataFrame:
    r = roster.select("pseudonym", "status", "ma_start_semester")
    return df.join(r, "pseudonym", "left").withColumn("level", level_at(F.col("status"), F.col("ma_start_semester"), day)).drop("status", "ma_start_semester")


def enrich(messages: DataFrame) -> DataFrame:
    """Local time, its day, Monday and week, weekday and hour. A message without a time raises."""
    checked = F.when(F.col("created_at").isNotNull(), F.col("created_at")).otherwise(F.raise_error(F.lit("message without created_at")))
    m = messages.withColumn("local", cal.local(checked))
    day = F.to_date("local")
    return m.withColumns({"day": day, "monday": cal.monday(day), "week": cal.week_id(day), "dow": cal.iso_weekday(day), "hour": F.hour("local")})


def first_seen(enriched: DataFrame) -> DataFrame:
    """Over all rows, also those before the axis starts."""
    return enriched.groupBy("pseudonym").agg(F.min("day").alias("first_seen"))


def languages(labels: DataFrame, version: str) -> DataFrame:
    """(history_id, lang) of one version of the language labels."""
    return labels.filter((F.col("label_version") == version) & (F.col("domain") == "language") & (F.col("value") == 1)).select("history_id", F.col("code").alias("lang"))


def spoken(messages: DataFrame, v: View) -> DataFrame:
    """Messages with `lang`; those without a label stay."""
    if v.language is None:
        return messages
    return messages.join(v.language, "history_id", "left").withColumn("lang", F.coalesce("lang", F.lit("undetermined")))


def positive_labels(labels: DataFrame, version: str) -> DataFrame:
    """(history_id, domain, code) of one version, without languages."""
    return labels.filter((F.col("value") == 1) & (F.col("label_version") == version) & (F.col("domain") != "language")).select("history_id", "domain", "code")


def topic_rows(v: View) -> DataFrame:
    """(monday, pseudonym, level, domain, code, n)"""
    return v.msg.join(v.positives, "history_id").select("monday", "pseudonym", "level", "domain", "code", "n") if v.topic is None else v.topic


def sessionize(msg: DataFrame) -> DataFrame:
    """By the client's key. A session belongs to the week and level of its first message and keeps its whole size."""
    start = F.min(F.struct("local", "history_id", "monday", "week", "level"))
    minutes = (F.unix_micros(F.max("local")) - F.unix_micros(F.min("local"))) / 60e6
    s = msg.groupBy("pseudonym", "session_started").agg(start.alias("s"), F.count(F.lit(1)).alias("n_messages"), minutes.alias("minutes"))
    return s.select("pseudonym", "session_started", "s.monday", "s.week", "s.level", "n_messages", "minutes", F.lit(1).alias("n"))


def through_monday(extracted: dt.date) -> dt.date:
    """The Monday of the last week that was over when extraction ran."""
    return extracted - dt.timedelta(days=extracted.weekday() + 7)


def week_axis(msg: DataFrame, through: dt.date) -> DataFrame:
    """(monday, week): dense from the first message's week, which is looked up at once."""
    first = msg.agg(F.min("monday")).first()[0]
    days = f"sequence(date'{first or through}', date'{through}', interval 7 days)" if first else "cast(array() as array<date>)"
    return msg.sparkSession.range(1).select(F.explode(F.expr(days)).alias("monday")).withColumn("week", cal.week_id(F.col("monday")))


def local_copy(calendar: DataFrame) -> DataFrame:
    """The same rows as a local relation: a calendar has a few rows a week, and every section joins it."""
    return calendar.sparkSession.createDataFrame(calendar.toArrow())


def term_weeks(axis: DataFrame) -> DataFrame:
    """(term, semester_week, monday, week) of the full membership of every term that the axis touches."""
    terms = axis.select(cal.term_of(F.col("monday")).alias("term")).filter("term is not null").distinct()
    days = F.sequence(cal.monday(cal.term_start(F.col("term"))), cal.term_end(F.col("term")), F.expr("interval 7 days"))
    weeks = terms.select("term", F.explode(days).alias("monday")).filter(F.date_add("monday", 3).between(cal.term_start(F.col("term")), cal.term_end(F.col("term"))))
    nth = F.row_number().over(Window.partitionBy("term").orderBy("monday"))
    return weeks.select("term", nth.alias("semester_week"), "monday", cal.week_id(F.col("monday")).alias("week"))


def windows(axis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry (window_id, kind, parent_id, first_week, last_week, first_monday, n_weeks, single_week,
    in_progress) and the bridge (window_id, monday, week, semester_week). Both are as small as the calendar."""
    full = term_weeks(axis)
    covered = full.join(axis.select("monday"), "monday")
    latest = covered.groupBy().agg(F.max(F.struct("monday", "term")).alias("x")).select(F.col("x.term").alias("term"))
    back = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("monday")))
    tail = covered.join(latest, "term").withColumns({"back": back, "n": F.count(F.lit(1)).over(Window.partitionBy("term"))})
    cols = ["window_id", "kind", "parent_id", "monday", "week", "semester_week"]
    none = F.lit(None).cast("string")
    parts = [
        axis.select(F.lit("all_time").alias("window_id"), F.lit("all_time").alias("kind"), none.alias("parent_id"), "monday", "week", F.lit(None).cast("int").alias("semester_week")),
        covered.select(F.col("term").alias("window_id"), F.lit("semester").alias("kind"), none.alias("parent_id"), "monday", "week", "semester_week"),
        tail.filter((F.col("back") <= SLICE_WEEKS) & (F.col("n") >= 2)).select(F.concat("term", F.lit(f".last{SLICE_WEEKS}")).alias("window_id"), F.lit("semester_slice").alias("kind"), F.col("term").alias("parent_id"), "monday", "week", "semester_week"),
        tail.filter("back = 1").select(F.concat("term", F.lit(".last1")).alias("window_id"), F.lit("semester_slice").alias("kind"), F.col("term").alias("parent_id"), "monday", "week", "semester_week"),
    ]
    bridge = parts[0].select(cols)
    for p in parts[1:]:
        bridge = bridge.unionByName(p.select(cols))
    win = bridge.groupBy("window_id", "kind", "parent_id").agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.min("monday").alias("first_monday"), F.count(F.lit(1)).alias("n_weeks"))
    last = full.groupBy("term").agg(F.max("week").alias("term_last"))
    win = win.join(last, F.col("term") == F.col("window_id"), "left")
    win = win.withColumns({"single_week": F.col("first_week") == F.col("last_week"), "in_progress": F.coalesce(F.col("last_week") < F.col("term_last"), F.lit(False))}).drop("term", "term_last")
    return win, bridge.select("window_id", "monday", "week", "semester_week")


def view(corpus: Corpus, *, extracted: dt.date, axis_start: dt.date | None = None, label_version: str = "v1", language_version: str = "v1") -> View:
    """First-seen comes from all rows; then rows before the axis and in weeks not yet over are left out.

    A message's level is that of the day on which its session started, so a session has one level. Languages have a
    label version of their own.
    """
    through = through_monday(extracted)
    raw = enrich(corpus.messages)
    rows = raw.filter(_inside(through, axis_start)).withColumns({"n": F.lit(1), "lo": F.col("local"), "hi": F.col("local")})
    msg = with_level(rows, corpus.roster, F.to_date(cal.local(F.timestamp_millis("session_started"))))
    return assemble(rows, msg, languages(corpus.labels, language_version), sessionize(msg), registrations(corpus, through, axis_start), first_seen(raw), positive_labels(corpus.labels, label_version), through)


def _inside(through: dt.date, axis_start: dt.date | None) -> Column:
    inside = F.col("monday") <= F.lit(through)
    return inside & (F.col("day") >= F.lit(axis_start)) if axis_start else inside


def registrations(corpus: Corpus, through: dt.date, axis_start: dt.date | None) -> DataFrame:
    """(pseudonym, registered_at, day, monday, week, level, n) of the weeks of the axis."""
    reg = corpus.students.filter("registered_at is not null").withColumn("day", F.to_date(cal.local(F.col("registered_at"))))
    reg = reg.withColumns({"monday": cal.monday(F.col("day")), "week": cal.week_id(F.col("day")), "n": F.lit(1)})
    return with_level(reg.filter(_inside(through, axis_start)), corpus.roster, F.col("day"))


def assemble(rows: DataFrame, msg: DataFrame, language: DataFrame | None, sess: DataFrame, reg: DataFrame, seen: DataFrame, positives: DataFrame, through: dt.date, topic: DataFrame | None = None) -> View:
    """A view with its calendar: the axis begins with the first week of `rows`."""
    axis = local_copy(week_axis(rows, through))
    win, bridge = map(local_copy, windows(axis))
    return View(rows, msg, language, sess, reg, seen, positives, axis, win, bridge, topic)


def grain(rows: DataFrame, *dims: str) -> DataFrame:
    """(monday, dims, pseudonym, n): messages at user grain, before weeks are dealt out to windows and levels."""
    return rows.groupBy("monday", *dims, "pseudonym").agg(F.sum("n").alias("n"))


def by_level(df: DataFrame) -> DataFrame:
    """Every row once for `all` and once for its own level."""
    return df.withColumn("level", F.explode(F.array(F.lit("all"), "level")))


def in_windows(df: DataFrame, v: View) -> DataFrame:
    """Every row once for each window that its week lies in; the bridge has a few rows a calendar week."""
    return df.join(v.win_week.select("window_id", "monday"), "monday")


def levels_present(v: View) -> DataFrame:
    return by_level(v.msg.select("level").distinct()).distinct()


def values(spark: SparkSession, name: str, items: tuple) -> DataFrame:
    """A small dimension; `items` is a fixed list of names."""
    return spark.sql(f"SELECT explode(array({', '.join(repr(x) for x in items)})) AS {name}")
