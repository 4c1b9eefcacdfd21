"""The whole published document as tables, guarded: the weekly run's aggregate and publish steps."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.calendar import DAYPARTS
from ..operators import guard, sections, tallies, trends
from ..operators.facts import LANGUAGES, View, levels_present, values
from ..operators.tallies import Tallies
from ..sources import files

HISTOGRAMS = ("user_messages", "user_weeks", "session_messages", "session_minutes")
SUMMARIES = ("user_messages_summary", "session_minutes_summary")


def build(v: View | Tallies, floor: int) -> dict[str, DataFrame]:
    """Section name -> long table. A view is tallied first."""
    t = v if isinstance(v, Tallies) else tallies.tally(v)
    v, found = t.view, tallies.cells(t)
    windows, findings = trends.section(tallies.measured(t), floor)
    return {
        "windows": v.win,
        "weekly_activity": sections.weekly_activity(v, floor, found["weekly_activity"]),
        "weekly_registrations": sections.weekly_registrations(v, floor, found["weekly_registrations"]),
        "weekly_language": sections.weekly_language(v, floor, found["weekly_language"]),
        "usage": sections.window_usage(v, floor, found["usage"]),
        "retention": sections.retention(v, floor, found["retention"]),
        "classes": sections.user_classes(v, floor, found["classes"]),
        "heatmap": sections.hour_heatmap(v, floor, found["heatmap"]),
        "dayparts": sections.dayparts(v, floor, found["dayparts"]),
        "languages": sections.language_totals(v, floor, found["languages"]),
        "topics": sections.topics(v, floor, found["topics"]),
        "profile": sections.semester_profile(v, floor, found["profile"]),
        "user_messages": tallies.user_histogram(t, "messages", sections.MESSAGE_BINS, floor),
        "user_weeks": tallies.user_histogram(t, "weeks", sections.SESSION_BINS, floor),
        "session_messages": tallies.session_histogram(t, "messages", "n_messages", sections.SESSION_BINS, floor),
        "session_minutes": tallies.session_histogram(t, "minutes", "minutes", sections.MINUTE_BINS, floor),
        "user_messages_summary": tallies.user_summary(t, floor),
        "session_minutes_summary": tallies.session_summary(t, floor),
        "trends": windows,
        "findings": findings,
    }


DAYPART_KEYS = ["window_id", "level", "shape", "dow", "part"]


def daypart_scaffold(v: View) -> DataFrame:
    """Every row that the dayparts must have: weekdays by dayparts, dayparts, week and weekend."""
    spark, dows = v.win.sparkSession, F.explode(F.sequence(F.lit(1), F.lit(7))).alias("dow")
    names = values(spark, "part", tuple(p[0] for p in DAYPARTS))
    shapes = names.select(F.lit("grid").alias("shape"), dows, "part").unionByName(names.select(F.lit("daypart").alias("shape"), F.lit(0).alias("dow"), "part")).unionByName(values(spark, "part", ("weekday", "weekend")).select(F.lit("span").alias("shape"), F.lit(0).alias("dow"), "part"))
    return v.win.select("window_id").crossJoin(levels_present(v)).crossJoin(shapes)


def rules(tables: dict[str, DataFrame], v: View, floor: int, through: dt.date, enrolled: DataFrame | None = None, observed: DataFrame | None = None) -> DataFrame:
    """(rule, n) over all of the document's tables; n is 0 where a rule is kept. `observed`: what the rules that a row
    shows have counted while the tables were written; else one aggregate a table counts it."""
    spark, win, usage = v.win.sparkSession, tables["windows"], tables["usage"]
    cells = guard.long_cells(tables)
    dows = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("dow")
    grid = win.select("window_id", dows).select("window_id", "dow", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    weeks = v.axis.select("week").crossJoin(levels_present(v))
    measures, langs = values(spark, "measure", ("messages", "sessions", "active_users")), values(spark, "lang", LANGUAGES)
    parts = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, DAYPARTS)) + " AS p(name, from_hour, to_hour)")
    found = [
        *([guard.counted_rules(t, floor) for t in tables.values() if guard.row_rules(t.columns, floor)] if observed is None else [observed]),
        guard.no_recoverable_partition(usage), guard.no_small_remainder(usage, floor),
        guard.dense_over(tables["heatmap"], grid, ["window_id", "dow", "hour"], "heatmap_dense"),
        guard.dense_over(tables["dayparts"], daypart_scaffold(v), DAYPART_KEYS, "dayparts_dense"),
        guard.dense_over(tables["weekly_activity"], weeks.crossJoin(measures), ["week", "level", "measure"], "weekly_dense"),
        guard.dense_over(tables["weekly_language"], weeks.crossJoin(langs), ["week", "level", "lang"], "weekly_dense"),
        guard.dense_over(tables["weekly_registrations"], v.axis.select("week"), ["week"], "weekly_dense"),
        guard.tiles(parts), *[guard.bins_ascend(tables[t], ["window_id", "level"]) for t in HISTOGRAMS],
        guard.windows_resolve(win, cells), guard.slices_contiguous(v.win_week, win), guard.profiles_ascend(tables["profile"], win),
        guard.coverage_ordered(win, v.axis, through), guard.trend_rules(tables["findings"], tables["trends"], win),
    ]
    if enrolled is not None:
        found.append(guard.enrollment_terms(enrolled, win))
    return reduce(DataFrame.unionByName, found).groupBy("rule").agg(F.sum("n").alias("n"))


def report(v: View, floor: int, through: dt.date, enrolled: DataFrame | None = None) -> DataFrame:
    """The rules over the document as it would be written. Its tables, each as small as the calendar times a few levels,
    are kept in memory, as several rules read each."""
    found = tallies.tally(v)
    return rules({name: t.persist() for name, t in build(found, floor).items()}, found.view, floor, through, enrolled)


def write(tables: dict[str, DataFrame], folder: str, floor: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table written once below `folder`, and (rule, n): what its rows break, observed in that write. No table is
    read again for it."""
    spark, found, counts = next(iter(tables.values())).sparkSession, {}, []
    for name, t in tables.items():
        own = guard.row_rules(t.columns, floor)
        seen = Observation(name)
        (t.observe(seen, *own.values()) if own else t).write.mode("errorifexists").parquet(f"{folder}/{name}")
        counts += seen.get.items() if own else []
        found[name] = spark.read.schema(t.schema).parquet(f"{folder}/{name}")
    return found, spark.createDataFrame(counts, "rule string, n long")


def publish(v: View, folder: str, version: str, floor: int, through: dt.date, enrolled: DataFrame | None = None) -> None:
    """Every section is written once, the rules that rows show are counted in that write, and the others on what was
    written. If all are kept, the document is rendered, and only then does the pointer name the version."""
    found = tallies.tally(v)
    tables, observed = write(build(found, floor), f"{folder}/sections/{version}", floor)
    guard.require_clean(rules(tables, found.view, floor, through, enrolled, observed))
    files.render_document(tables, f"{folder}/document/{version}")
    files.publish(tables["windows"], folder, version)
