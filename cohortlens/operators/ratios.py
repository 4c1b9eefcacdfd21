"""Ratios of published cells: a ratio is null unless both of its cells are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import OK, SUPPRESSED
from .facts import LEVELS


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part * 100.0 / total)


def share_of_total(cells: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `share`: the cell's value in percent of the published total with the same keys."""
    t = totals.filter(F.col("status") == OK).select(*keys, F.col("value").alias("__total"))
    return cells.join(t, keys, "left").withColumn("share", percent(F.col("value"), F.col("__total"))).drop("__total")


def level_composition(cells: DataFrame) -> DataFrame:
    """Each level's share of the sum of the levels, all or nothing: none if any level is suppressed."""
    w = Window.partitionBy("window_id", "measure")
    hidden = F.max((F.col("status") == SUPPRESSED).cast("int")).over(w) == 1
    return cells.filter("level <> 'all'").withColumn("share", F.when(~hidden, percent(F.col("value"), F.sum("value").over(w))))


def enrollment(win: DataFrame, enrolled: DataFrame) -> DataFrame:
    """(window_id, level, enrolled): a window's own figure, else its parent's; figures of windows not published go."""
    known = enrolled.join(win.filter("kind = 'semester'").select("window_id"), "window_id", "left_semi")
    own = win.select(F.col("window_id").alias("id"), F.coalesce("parent_id", "window_id").alias("window_id"))
    return own.join(known, "window_id").select(F.col("id").alias("window_id"), "level", "enrolled")


def reach(usage: DataFrame, win: DataFrame, enrolled: DataFrame) -> DataFrame:
    """(window_id, level, reach): active users in percent of enrolled ones to one decimal, bachelor and master only."""
    active = usage.filter("measure = 'active_users' and level in ('bachelor', 'master')")
    return active.join(enrollment(win, enrolled), ["window_id", "level"]).select("window_id", "level", F.round(percent(F.col("value"), F.col("enrolled")), 1).alias("reach"))


def tried_once(weeks_histogram: DataFrame) -> DataFrame:
    """(window_id, level, share): users with one active week in percent of all, if all bins are published."""
    h = weeks_histogram.groupBy("window_id", "level").agg(F.max(F.when(F.col("bin") == 0, F.col("value"))).alias("first"), F.sum("value").alias("n"), F.max((F.col("status") == SUPPRESSED).cast("int")).alias("hidden"))
    return h.select("window_id", "level", F.when(F.col("hidden") == 0, percent(F.col("first"), F.col("n"))).alias("share"))


def ranked_codes(topics: DataFrame, top: int = 7) -> DataFrame:
    """Per window, level and domain: published positive cells by size, then suppressed ones, then zeros."""
    rank = F.when((F.col("status") == OK) & (F.col("value") > 0), 0).when(F.col("status") == SUPPRESSED, 1).otherwise(2)
    w = Window.partitionBy("window_id", "level", "domain").orderBy(rank, F.desc_nulls_last("value"), "code")
    return topics.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def available_levels(cells: DataFrame) -> DataFrame:
    """(level, position) of the levels that a section has, in the fixed order."""
    order = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).cast("int")
    return cells.filter("level <> 'all'").select("level").distinct().withColumn("position", order)


def slice_by_level(cells: DataFrame, level: str) -> DataFrame:
    """The level's rows with scoped = true; without any split published, the rows of `all` with scoped = false."""
    split = F.max((F.col("level") != "all").cast("int")).over(Window.partitionBy("window_id")) == 1
    return cells.withColumn("scoped", split).filter(F.when(F.col("scoped"), F.col("level") == level).otherwise(F.col("level") == "all"))


def slice_to_window(series: DataFrame, win: DataFrame) -> DataFrame:
    """Weekly rows of each window: week ids sort as text."""
    w = win.select("window_id", "first_week", "last_week")
    return series.join(w, F.col("week").between(F.col("first_week"), F.col("last_week"))).drop("first_week", "last_week")
