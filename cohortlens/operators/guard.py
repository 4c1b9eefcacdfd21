"""Publish rules on the output tables. Each rule gives (rule, n): how many rows break it."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import OK, SUPPRESSED
from .facts import LEVELS
from .sections import PARTITIONED


def _count(df: DataFrame, rule: str, broken: Column | str | None = None) -> DataFrame:
    rows = df if broken is None else df.filter(broken)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")


def long_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, window_id, level, status, value) of every table of cells, so that one pass checks all of them."""
    parts = []
    for name, t in tables.items():
        if {"status", "value"} <= set(t.columns):
            own = lambda c, t=t: F.col(c) if c in t.columns else F.lit(None).cast("string").alias(c)
            parts.append(t.select(F.lit(name).alias("section"), own("window_id"), own("level"), "status", F.col("value").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def suppressed_bare(cells: DataFrame) -> DataFrame:
    return _count(cells, "suppressed_bare", (F.col("status") == SUPPRESSED) & F.col("value").isNotNull())


def summaries_bare(summaries: DataFrame) -> DataFrame:
    shown = [F.col(c).isNotNull() for c in ("n_users", "median", "p25", "p75", "mean", "sd")]
    return _count(summaries, "suppressed_bare", (F.col("status") == SUPPRESSED) & reduce(Column.__or__, shown))


def floor_respected(rows: DataFrame, floor: int) -> DataFrame:
    """No number of users that is published may be below the floor."""
    users = [c for c in rows.columns if c.startswith("n_users") or c.startswith("users_")]
    broken = reduce(Column.__or__, [F.coalesce(F.col(c) < floor, F.lit(False)) for c in users])
    if "trajectory" in rows.columns:
        broken |= F.coalesce(F.exists("trajectory", lambda x: x["n_users"] < floor), F.lit(False))
    return _count(rows, "floor_respected", broken)


def row_rules(columns: list[str], floor: int) -> dict[str, Column]:
    """rule -> how many rows break it, for the rules that one row of a table shows. As aggregates they can be observed
    while the table is written."""
    have, broken = set(columns), {}
    hidden = F.col("status") == SUPPRESSED
    shown = [F.col(c).isNotNull() for c in ("value", "median", "p25", "p75", "mean", "sd") if c in have]
    shown += [F.col("n_users").isNotNull()] if "median" in have else []
    if "status" in have and shown:
        broken["suppressed_bare"] = hidden & reduce(Column.__or__, shown)
    if users := [c for c in columns if c.startswith(("n_users", "users_"))]:
        few = reduce(Column.__or__, [F.coalesce(F.col(c) < floor, F.lit(False)) for c in users])
        broken["floor_respected"] = few | F.coalesce(F.exists("trajectory", lambda x: x["n_users"] < floor), F.lit(False)) if "trajectory" in have else few
    if "level" in have:
        broken["levels_known"] = ~F.col("level").isin("all", *LEVELS)
    return {rule: F.count_if(F.coalesce(c, F.lit(False))).alias(rule) for rule, c in broken.items()}


def counted_rules(table: DataFrame, floor: int) -> DataFrame:
    """(rule, n) of `row_rules`, by one aggregate."""
    found = row_rules(table.columns, floor)
    return table.agg(*found.values()).unpivot([], list(found), "rule", "n")


def no_recoverable_partition(usage: DataFrame) -> DataFrame:
    """A lone suppressed level beside a published total could be had by subtraction."""
    g = usage.filter(F.col("measure").isin(*PARTITIONED)).groupBy("window_id", "measure").agg(F.count_if((F.col("level") != "all") & (F.col("status") == SUPPRESSED)).alias("hidden"), F.count_if((F.col("level") == "all") & (F.col("status") == OK)).alias("total"))
    return _count(g, "no_recoverable_partition", "hidden = 1 and total > 0")


def no_small_remainder(usage: DataFrame, floor: int) -> DataFrame:
    """What published levels leave of a published total is a number too, and so is zero or no smaller than the floor."""
    g = usage.filter(F.col("measure").isin(*PARTITIONED)).groupBy("window_id", "measure").agg(F.count_if(F.col("status") == SUPPRESSED).alias("hidden"), F.max(F.when(F.col("level") == "all", F.col("value"))).alias("total"), F.sum(F.when(F.col("level") != "all", F.col("value"))).alias("levels"))
    return _count(g, "no_small_remainder", (F.col("hidden") == 0) & (F.col("total") != F.col("levels")) & (F.col("total") - F.col("levels") < floor))


def dense_over(cells: DataFrame, scaffold: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Cells missing from the scaffold, beyond it, or there twice."""
    c = cells.select(*keys)
    return _total([_count(scaffold.join(c, keys, "left_anti"), rule), _count(c.join(scaffold, keys, "left_anti"), rule), _count(c.groupBy(*keys).count(), rule, "count > 1")])


def tiles(parts: DataFrame) -> DataFrame:
    """(name, from_hour, to_hour) cover 0 to 24 without gap or overlap."""
    w = Window.orderBy("from_hour")
    p = parts.withColumns({"before": F.coalesce(F.lag("to_hour").over(w), F.lit(0)), "last": F.lead("from_hour").over(w).isNull()})
    return _count(p, "dayparts_tile", (F.col("before") != F.col("from_hour")) | (F.col("to_hour") <= F.col("from_hour")) | (F.col("last") & (F.col("to_hour") != 24)))


def bins_ascend(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Bins (bin, lo, hi) ascend without overlap; only the last one is open."""
    w = Window.partitionBy(*keys).orderBy("bin")
    b = bins.withColumns({"before": F.lag("hi").over(w), "first": F.lag("lo").over(w).isNull(), "last": F.lead("lo").over(w).isNull()})
    return _count(b, "bins_ascend", (~F.col("first") & (F.col("before").isNull() | (F.col("lo") <= F.col("before")))) | (F.col("hi") < F.col("lo")) | (F.col("hi").isNull() & ~F.col("last")))


def windows_resolve(win: DataFrame, cells: DataFrame) -> DataFrame:
    """Ids are unique, the cells' windows and the slices' parents exist."""
    ids = win.select("window_id").distinct()
    twice = _count(win.groupBy("window_id").count(), "windows_resolve", "count > 1")
    lost = _count(cells.select("window_id").filter("window_id is not null").distinct().join(ids, "window_id", "left_anti"), "windows_resolve")
    orphans = _count(win.filter("parent_id is not null").select(F.col("parent_id").alias("window_id")).join(ids, "window_id", "left_anti"), "windows_resolve")
    return _total([twice, lost, orphans])


def slices_contiguous(win_week: DataFrame, win: DataFrame) -> DataFrame:
    s = win_week.join(win.filter("kind = 'semester_slice'").select("window_id"), "window_id")
    g = s.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("monday"), F.min("monday")).alias("d"))
    return _count(g, "slices_contiguous", "d <> 7 * (n - 1)")


def trend_rules(findings: DataFrame, windows: DataFrame, win: DataFrame, cap: int = 5, tab_caps: dict[str, int] | None = None) -> DataFrame:
    """`findings` keep to the caps, belong to windows with a baseline and enough data, and have points just under a
    trajectory, each of a known term. `windows` (window_id, baseline, insufficient_data): baselines resolve, all time's
    alone is a trajectory, and nothing is insufficient without one."""
    caps = {"topics": 3} if tab_caps is None else tab_caps
    limit = F.lit(2)
    for tab, n in caps.items():
        limit = F.when(F.col("tab") == tab, n).otherwise(limit)
    ids = win.select("window_id", "kind")
    windows = windows.withColumnRenamed("baseline", "against")
    trajectory = F.col("against") == "trajectory"
    known = findings.join(windows, "window_id", "left")
    points = findings.filter("trajectory is not null").select(F.explode("trajectory.term").alias("window_id"))
    named = windows.filter("against is not null")
    rules = [
        _count(findings.groupBy("window_id").count(), "trends", F.col("count") > cap),
        _count(findings.groupBy("window_id", "tab").count(), "trends", F.col("count") > limit),
        _count(known, "trends", F.col("against").isNull() | F.col("insufficient_data") | (trajectory != F.col("trajectory").isNotNull())),
        _count(points.join(ids.filter("kind = 'semester'"), "window_id", "left_anti"), "trends"),
        _count(named.filter(~trajectory).select(F.col("against").alias("window_id")).join(ids, "window_id", "left_anti"), "trends"),
        _count(named.join(ids, "window_id", "left"), "trends", trajectory & F.coalesce(F.col("kind") != "all_time", F.lit(True))),
        _count(windows, "trends", F.col("insufficient_data") & F.col("against").isNull()),
    ]
    return _total(rules)


def _total(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules).groupBy("rule").agg(F.sum("n").alias("n"))


def profiles_ascend(profile: DataFrame, win: DataFrame) -> DataFrame:
    w = Window.partitionBy("window_id", "measure").orderBy("semester_week")
    gaps = _count(profile.withColumn("d", F.col("semester_week") - F.lag("semester_week").over(w)), "profiles_ascend", "d <> 1")
    lost = _count(profile.select("window_id").distinct().join(win.filter("kind = 'semester'").select("window_id"), "window_id", "left_anti"), "profiles_ascend")
    return _total([gaps, lost])


def levels_known(cells: DataFrame) -> DataFrame:
    return _count(cells.select("level").distinct(), "levels_known", ~F.col("level").isin("all", *LEVELS) & F.col("level").isNotNull())


def coverage_ordered(win: DataFrame, axis: DataFrame, through: dt.date) -> DataFrame:
    """Windows end after they begin and lie within the axis, whose last day is the Sunday `through`."""
    ends = axis.agg(F.min("week").alias("lo"), F.max("week").alias("hi"), F.max(F.date_add("monday", 6)).alias("last"))
    outside = _count(win.crossJoin(ends), "coverage_ordered", (F.col("first_week") > F.col("last_week")) | (F.col("first_week") < F.col("lo")) | (F.col("last_week") > F.col("hi")))
    return _total([outside, _count(ends, "coverage_ordered", F.col("last") != F.lit(through))])


def enrollment_terms(enrolled: DataFrame, win: DataFrame) -> DataFrame:
    return _count(enrolled.select("window_id").distinct().join(win.filter("kind = 'semester'").select("window_id"), "window_id", "left_anti"), "enrollment_terms")


def require_clean(report: DataFrame) -> DataFrame:
    """The report itself; raises if a rule is broken."""
    broken = report.filter("n > 0").collect()
    if broken:
        raise ValueError("publish rules are broken: " + ", ".join(f"{r['rule']} ({r['n']})" for r in broken))
    return report
