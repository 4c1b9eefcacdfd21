"""The published sections as long tables of floored cells.

A section counts its cells in the rows of a view, unless it is given them as `cells`, (keys, value, n_users): a whole
document counts those of all sections at once (`tallies`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import stats
from ..functions.cells import SUPPRESSED, both_cells, count_cells, dense, floored, status, suppress_together
from .facts import LANGUAGES, View, by_level, grain, in_windows, levels_present, spoken, topic_rows, values

#: Bins as (lo, hi), the last one open.
SESSION_BINS = ((1, 1), (2, 3), (4, 7), (8, None))
MINUTE_BINS = ((0, 1), (2, 5), (6, 15), (16, 30), (31, None))
MESSAGE_BINS = ((1, 2), (3, 5), (6, 10), (11, 25), (26, None))
#: Classes of users, the last one a subset of the second.
CLASSES = ("one_time", "monthly", "sporadic", "frequent")
#: Measures whose levels add up to the published total.
PARTITIONED = ("messages", "sessions", "new_registrations", "new_registrations_active")


def _measure(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("measure", F.lit(name))


def weekly_activity(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    """(level, week, measure, status, value) for messages, sessions and active users, dense over axis and levels."""
    keys = ["level", "week"]
    if cells is None:
        sessions = count_cells(by_level(v.sess.select("level", "week", "pseudonym")), keys)
        cells = both_cells(by_level(v.msg.select("level", "week", "pseudonym", "n")), keys, n=F.col("n")).unionByName(_measure(sessions, "sessions"))
    scaffold = v.axis.select("week").crossJoin(levels_present(v)).crossJoin(values(v.msg.sparkSession, "measure", ("messages", "sessions", "active_users")))
    return floored(dense(cells, scaffold, [*keys, "measure"]), floor)


def weekly_registrations(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    cells = count_cells(v.reg.select("week", "pseudonym"), ["week"]) if cells is None else cells
    return floored(dense(cells, v.axis.select("week"), ["week"]), floor)


def weekly_language(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    keys = ["level", "lang", "week"]
    cells = count_cells(by_level(spoken(v.msg, v).select(*keys, "pseudonym", "n")), keys, n=F.col("n")) if cells is None else cells
    scaffold = v.axis.select("week").crossJoin(levels_present(v)).crossJoin(values(v.msg.sparkSession, "lang", LANGUAGES))
    return floored(dense(cells, scaffold, keys), floor)


def activated(v: View) -> DataFrame:
    """Registrations of users who wrote in the same window."""
    active = in_windows(v.rows.select("monday", "pseudonym").distinct(), v).select("window_id", "pseudonym")
    return in_windows(v.reg, v).join(active, ["window_id", "pseudonym"], "left_semi")


def window_usage(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    """(window_id, level, measure, status, value). Levels of one measure that add up are suppressed together, and the
    levels are those of the messages."""
    keys = ["window_id", "level"]
    if cells is None:
        wide = lambda rows: in_windows(by_level(grain(rows, "level")), v)
        act = by_level(activated(v).select("window_id", "level", "pseudonym"))
        parts = {"sessions": count_cells(wide(v.sess), keys, n=F.col("n")), "new_registrations": count_cells(wide(v.reg), keys, n=F.col("n")), "new_registrations_active": count_cells(act, keys)}
        cells = both_cells(wide(v.msg), keys, n=F.col("n"))
        for name, p in parts.items():
            cells = cells.unionByName(_measure(p, name))
    scaffold = v.win.select("window_id").crossJoin(levels_present(v)).crossJoin(values(v.msg.sparkSession, "measure", ("messages", "active_users", "sessions", "new_registrations", "new_registrations_active")))
    return joint_floor(floored(dense(cells, scaffold, [*keys, "measure"]), floor))


def joint_floor(cells: DataFrame) -> DataFrame:
    """One suppressed level hides that measure on every level (not the total), if the levels add up to the total."""
    hides = (F.col("status") == SUPPRESSED) & (F.col("level") != "all") & F.col("measure").isin(*PARTITIONED)
    hidden = (F.max(hides.cast("int")).over(Window.partitionBy("window_id", "measure")) == 1) & (F.col("level") != "all")
    return cells.withColumns({"value": F.when(~hidden, F.col("value")), "status": F.when(hidden, SUPPRESSED).otherwise(F.col("status"))})


def retention(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    """(window_id, level, kind, status, value): active users first seen in the window, or before it."""
    if cells is None:
        active = in_windows(by_level(v.msg.select("monday", "level", "pseudonym").distinct()), v).select("window_id", "level", "pseudonym").distinct()
        seen = active.join(v.first_seen, "pseudonym").join(v.win.select("window_id", "first_monday"), "window_id")
        both = seen.groupBy("window_id", "level").agg(*[F.count_if(c).alias(k) for k, c in (("new", F.col("first_seen") >= F.col("first_monday")), ("returning", F.col("first_seen") < F.col("first_monday")))])
        cells = both.unpivot(["window_id", "level"], ["new", "returning"], "kind", "value").withColumn("n_users", F.col("value"))
    return suppress_together(floored(cells, floor), ["window_id", "level"])


def day_grain(rows: DataFrame, *dims: str) -> DataFrame:
    """(dims, pseudonym, day, lo, hi): each user's first and last time of a day, from rows with `lo` and `hi`, or `local`."""
    lo, hi = ("lo", "hi") if "lo" in rows.columns else ("local", "local")
    return rows.groupBy(*dims, "pseudonym", F.to_date(lo).alias("day")).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))


def user_profiles(days: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pseudonym, span_days, within_day, longest_gap, class, frequent) from rows of `day_grain`.

    The span counts both ends; within_day: at most 24 hours between first and last; gaps are between distinct days.
    """
    days = days.groupBy(*keys, "pseudonym", "day").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(*keys, "pseudonym").orderBy("day")))
    u = days.withColumn("gap", gap).groupBy(*keys, "pseudonym").agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"), (F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo")) <= 86_400_000_000).alias("within_day"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))
    return u.withColumns(classified())


def classified() -> dict[str, Column]:
    """`class` and `frequent` from span_days, within_day and longest_gap."""
    kind = F.when((F.col("span_days") < 3) & F.col("within_day"), "one_time").when((F.col("longest_gap") < 30) & (F.col("span_days") >= 30), "monthly").otherwise("sporadic")
    return {"class": kind, "frequent": (F.col("longest_gap") < 14) & (F.col("span_days") > 30)}


def user_classes(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    """(window_id, level, class, status, value); `frequent` is a subset of `monthly`."""
    if cells is None:
        keys = ["window_id", "level"]
        u = user_profiles(in_windows(by_level(day_grain(v.msg, "monday", "level")), v), keys)
        n = u.groupBy(*keys).agg(*[F.count_if(F.col("class") == c).alias(c) for c in CLASSES[:3]], F.count_if("frequent").alias("frequent"))
        cells = n.unpivot(keys, list(CLASSES), "class", "value").withColumn("n_users", F.col("value"))
    return floored(cells, floor)


def hour_heatmap(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    """(window_id, dow, hour, status, value), 168 cells a window."""
    keys = ["window_id", "dow", "hour"]
    cells = count_cells(in_windows(grain(v.rows, "dow", "hour"), v), keys, n=F.col("n")) if cells is None else cells
    grid = v.win.select("window_id").select("window_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("dow")).select("window_id", "dow", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return floored(dense(cells, grid, keys), floor)


def dayparts(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    """(window_id, level, shape, dow, part, status, value): the grid of weekday and daypart, the dayparts' totals and
    the totals of week and weekend. Each total has users of its own and is not summed up from the grid."""
    keys = ["window_id", "level", "shape", "dow", "part"]
    if cells is None:
        rows = grain(v.msg.withColumn("part", cal.daypart(F.col("hour"))), "level", "dow", "part")
        all_rows = in_windows(by_level(rows.select("monday", "level", "pseudonym", "n", F.explode(daypart_shapes()).alias("s")).select("monday", "level", "pseudonym", "n", "s.*")), v)
        cells = count_cells(all_rows, keys, n=F.col("n"))
    spark = v.msg.sparkSession
    names = values(spark, "part", tuple(p[0] for p in cal.DAYPARTS))
    grid = names.select(F.lit("grid").alias("shape"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("dow"), "part")
    grid = grid.unionByName(names.select(F.lit("daypart").alias("shape"), F.lit(0).alias("dow"), "part")).unionByName(values(spark, "part", ("weekday", "weekend")).select(F.lit("span").alias("shape"), F.lit(0).alias("dow"), "part"))
    scaffold = v.win.select("window_id").crossJoin(levels_present(v)).crossJoin(grid)
    return floored(dense(cells, scaffold, keys), floor)


def daypart_shapes() -> Column:
    """The three (shape, dow, part) that a row with `dow` and `part` counts in."""
    span = F.when(F.col("dow") >= 6, "weekend").otherwise("weekday")
    shapes = (("grid", F.col("dow"), F.col("part")), ("daypart", F.lit(0), F.col("part")), ("span", F.lit(0), span))
    return F.array(*[F.struct(F.lit(name).alias("shape"), dow.alias("dow"), part.alias("part")) for name, dow, part in shapes])


def language_totals(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    keys = ["window_id", "level", "lang"]
    cells = count_cells(in_windows(by_level(grain(spoken(v.msg, v), "level", "lang")), v), keys, n=F.col("n")) if cells is None else cells
    scaffold = v.win.select("window_id").crossJoin(levels_present(v)).crossJoin(values(v.msg.sparkSession, "lang", LANGUAGES))
    return floored(dense(cells, scaffold, keys), floor)


def topics(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    """(window_id, level, domain, code, status, value, n_total): multi-label; every code of the version appears."""
    keys = ["window_id", "level", "domain", "code"]
    if cells is None:
        labelled = grain(topic_rows(v), "level", "domain", "code")
        cells = count_cells(in_windows(by_level(labelled), v), keys, n=F.col("n"))
    total = in_windows(by_level(v.msg.groupBy("monday", "level").agg(F.sum("n").alias("n"))), v).groupBy("window_id", "level").agg(F.sum("n").alias("n_total"))
    scaffold = v.win.select("window_id").crossJoin(levels_present(v)).crossJoin(v.positives.select("domain", "code").distinct())
    out = floored(dense(cells, scaffold, keys), floor).join(total, ["window_id", "level"], "left")
    return out.withColumn("n_total", F.coalesce("n_total", F.lit(0)))


def describe_codes(cells: DataFrame, sets: DataFrame, version: str) -> DataFrame:
    """Adds a reviewed set's descriptions to emergent codes."""
    s = sets.filter(F.col("set_version") == version).select("code", "description")
    return cells.join(s, "code", "left")


def bin_of(value: Column, bins) -> Column:
    out = F
    for i, (lo, hi) in enumerate(bins):
        out = out.when((value >= lo) & (F.lit(True) if hi is None else value <= hi), i)
    return out.otherwise(F.raise_error(F.concat(F.lit("value fits no bin: "), value.cast("string"))))


def histogram(rows: DataFrame, keys: list[str], value: str, bins, floor: int) -> DataFrame:
    """(keys, bin, lo, hi, status, value): every bin of every group; rows have keys, pseudonym and the value."""
    binned = rows.withColumn("bin", bin_of(F.floor(F.col(value)), bins))
    return binned_cells(count_cells(binned, [*keys, "bin"]), rows.select(*keys).distinct(), keys, bins, floor)


def binned_cells(cells: DataFrame, groups: DataFrame, keys: list[str], bins, floor: int) -> DataFrame:
    """Every bin of every group (keys), from (keys, bin, value, n_users)."""
    spark = cells.sparkSession
    dim = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, {lo}, {'CAST(NULL AS INT)' if hi is None else hi})" for i, (lo, hi) in enumerate(bins)) + " AS b(bin, lo, hi)")
    return floored(dense(cells, groups.crossJoin(dim), [*keys, "bin"]), floor)


def summary(rows: DataFrame, keys: list[str], value: str, floor: int, *, with_mean: bool = True) -> DataFrame:
    """(keys, status, n_users, median, p25, p75, mean, sd), to one decimal: all of it or, below the floor, nothing."""
    rows = rows.select(*keys, "pseudonym", F.col(value).cast("double").alias("__v"))
    users = rows.select(*keys, "pseudonym").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_users"))
    moments = rows.groupBy(*keys).agg(F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd"))
    return _summarised(rows, None, users, moments, keys, floor, with_mean)


def summary_of(spread: DataFrame, users: DataFrame, keys: list[str], floor: int, *, with_mean: bool = True) -> DataFrame:
    """The same from how often a group has which value, (keys, x, n), and its users, (keys, n_users)."""
    rows = spread.select(*keys, F.col("x").cast("double").alias("__v"), "n")
    mean = rows.groupBy(*keys).agg((F.sum(F.col("__v") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("__rows"))
    off = (F.col("__v") - F.col("mean")) * (F.col("__v") - F.col("mean")) * F.col("n")
    total = rows.join(mean, keys).groupBy(*keys, "mean", "__rows").agg(F.sum(off).alias("__off"))
    moments = total.select(*keys, "mean", F.when(F.col("__rows") > 1, F.sqrt(F.col("__off") / (F.col("__rows") - 1))).alias("sd"))
    return _summarised(rows, "n", users, moments, keys, floor, with_mean)


def _summarised(rows: DataFrame, n: str | None, users: DataFrame, moments: DataFrame, keys: list[str], floor: int, with_mean: bool) -> DataFrame:
    out = stats.quantiles_type2(rows, keys, "__v", {"median": 0.5, "p25": 0.25, "p75": 0.75}, n=n).join(users, keys).join(moments, keys).withColumn("status", status(F.col("n_users"), floor))
    shown = F.col("status") == "ok"
    cols = [F.when(shown & F.lit(with_mean or x not in ("mean", "sd")), F.round(x, 1)).alias(x) for x in ("median", "p25", "p75", "mean", "sd")]
    return out.select(*keys, "status", F.when(shown, F.col("n_users")).alias("n_users"), *cols)


def session_rows(v: View) -> DataFrame:
    return in_windows(by_level(v.sess), v)


def per_user_rows(v: View) -> DataFrame:
    """(window_id, level, pseudonym, messages, sessions, weeks): one row a user, window and level."""
    keys = ["window_id", "level", "pseudonym"]
    m = in_windows(by_level(grain(v.msg, "level")), v)
    # Weeks are not summed over levels: a week with two levels counts once for `all`.
    m = m.groupBy(*keys, "monday").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("weeks"))
    s = in_windows(by_level(grain(v.sess, "level")), v).groupBy(*keys).agg(F.sum("n").alias("sessions"))
    return m.join(s, keys, "left")


def semester_profile(v: View, floor: int, cells: DataFrame | None = None) -> DataFrame:
    """(window_id, semester_week, measure, status, value) for the covered weeks of every term."""
    weeks = v.win_week.join(v.win.filter("kind = 'semester'").select("window_id"), "window_id").select("window_id", "monday", "semester_week")
    keys = ["window_id", "semester_week"]
    cells = both_cells(grain(v.rows).join(weeks, "monday"), keys, n=F.col("n")) if cells is None else cells
    scaffold = weeks.select(*keys).crossJoin(values(v.msg.sparkSession, "measure", ("messages", "active_users")))
    return floored(dense(cells, scaffold, [*keys, "measure"]), floor)


def semester_overlay(profile: DataFrame, terms: list[str], measure: str = "messages") -> DataFrame:
    """Rows: teaching week; columns: terms. The list of columns is given, so no job is needed to find it."""
    return profile.filter(F.col("measure") == measure).groupBy("semester_week").pivot("window_id", terms).agg(F.first("value"))
