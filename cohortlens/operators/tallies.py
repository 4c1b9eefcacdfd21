"""The counts of all sections of a document from one pass over the users' rows.

Rows are dealt out by user once. Each user's weeks are summed up, and these to windows, on that one partitioning: cells in
which a user wrote are bits of a mask, so a user has one row a window and level, whatever the number of sections. Users
are then counted by mask, and numbers of messages by sums that need no user. What sections and trends read is as small as
the calendar times the cells.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.cells import both_measures
from ..sources.store import settled, tasks
from . import sections, trends
from .facts import LANGUAGES, View, by_level, in_windows, spoken, topic_rows

PARTS = tuple(name for name, _, _ in cal.DAYPARTS)
SPANS = ("weekday", "weekend")
#: What a bit of `flags` stands for, and one of `parts` as (shape, dow, part).
FLAGS = (*LANGUAGES, *[f"messages {i}" for i in range(len(sections.SESSION_BINS))], *[f"minutes {i}" for i in range(len(sections.MINUTE_BINS))], *sections.CLASSES, "new", "returning")
SHAPES = (*[("grid", d, p) for d in range(1, 8) for p in PARTS], *[("daypart", 0, p) for p in PARTS], *[("span", 0, s) for s in SPANS])
#: Bits a column of a mask that needs several: of the hours of a week, and of codes.
HOURS, CODES = 56, 62
#: Rows that a task deals out.
ROWS = 400_000


@dataclass(frozen=True)
class Tallies:
    """`users` (bucket, level, kind, mark, n_users): how many users have a bit of a mask or a number of messages, weeks,
    sessions or registrations; a bucket is a window or a week's Monday. `hours` (monday, level, dow, hour, lang, n), `topics`
    (monday, level, domain, code, n, at) and `spread` (monday, level, n_messages, minutes, n): numbers of messages and
    sessions. `view` has the calendar, and `hours` in place of messages."""

    users: DataFrame
    hours: DataFrame
    topics: DataFrame
    spread: DataFrame
    view: View


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _bits(mask: Column) -> Column:
    """The numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("getbit", mask, i) == 1)


def _place(value: Column, names: tuple) -> Column:
    """The number of `value` among `names`, null if it is none of them."""
    return reduce(lambda out, i: out.when(value == names[i], i), range(len(names)), F)


def _flag(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(1 << FLAGS.index(name))).otherwise(F.lit(0)).cast("long")


def _masks(at: Column, width: int, n: int) -> list[Column]:
    """The bit `at` in columns of `width` bits."""
    return [F.when(F.floor(at / width) == i, _bit(at % width)) for i in range(n)]


def _week_gap(days: Column) -> Column:
    """The most days between neighbours among a week's days, a mask of seven bits."""

    def gap(mask: int) -> int:
        on = [i for i in range(7) if mask >> i & 1]
        return max((b - a for a, b in zip(on, on[1:], strict=False)), default=0)

    return F.element_at(F.array(*[F.lit(gap(m)) for m in range(128)]), days.cast("int") + 1)


def _events(v: View, codes: DataFrame) -> DataFrame:
    """A row for each row of messages, topics, sessions, registrations and first days, by user. `joined` is the level of a
    registration, `at` the hour of the week."""
    kinds = "pseudonym string, monday date, level string, joined string, n long, sessions long, at int, lang int, lo timestamp, hi timestamp, code int, bins long, seen date"
    columns = [c.split() for c in kinds.split(", ")]

    def row(df: DataFrame, **own: Column) -> DataFrame:
        return df.select(*[(own[c] if c in own else F.col(c) if c in ("pseudonym", "monday", "level") else F.lit(None)).cast(kind).alias(c) for c, kind in columns])

    n, place = F.col("n"), (F.col("dow") - 1) * 24 + F.col("hour")
    bins = [F.when(sections.bin_of(F.floor(x), edges) == i, 1 << FLAGS.index(f"{name} {i}")).otherwise(0) for name, x, edges in (("messages", F.col("n_messages"), sections.SESSION_BINS), ("minutes", F.col("minutes"), sections.MINUTE_BINS)) for i in range(len(edges))]
    return reduce(DataFrame.unionByName, [
        row(spoken(v.msg, v), n=n, at=place, lang=_place(F.col("lang"), LANGUAGES), lo=F.col("lo"), hi=F.col("hi")),
        row(topic_rows(v).join(F.broadcast(codes), F.col("domain").eqNullSafe(F.col("of_domain")) & F.col("code").eqNullSafe(F.col("of_code"))), code=F.col("at")),
        row(v.sess, sessions=n, bins=reduce(Column.__add__, bins)),
        row(v.reg, level=F.lit("all"), joined=F.col("level"), n=n),
        row(v.first_seen.filter("pseudonym is not null"), level=F.lit(""), monday=F.lit(None), seen=F.col("first_seen")),
    ])


def _buckets(v: View) -> DataFrame:
    """(monday, bucket, whole, opens, closes): the windows that a week lies in, and the week itself, with their first and
    last day. Windows have no gaps (`facts.windows`). `whole`: a window."""
    ends = v.win_week.groupBy("window_id").agg(F.min("monday").alias("opens"), F.date_add(F.max("monday"), 6).alias("closes"))
    mine = v.win_week.select("window_id", "monday").join(ends, "window_id").select("monday", F.col("window_id").alias("bucket"), F.lit(True).alias("whole"), "opens", "closes")
    return mine.unionByName(v.axis.select("monday", F.col("monday").cast("string").alias("bucket"), F.lit(False).alias("whole"), F.col("monday").alias("opens"), F.date_add("monday", 6).alias("closes")))


def _users(v: View, codes: DataFrame, n_codes: int, n_tasks: int) -> DataFrame:
    """(bucket, level, kind, mark, n_users)"""
    heat, topic = [f"hours {i}" for i in range(168 // HOURS)], [f"codes {i}" for i in range(-(-n_codes // CODES))]
    every = F.when(F.col("level").isin("", "all"), F.array("level")).otherwise(F.array(F.lit("all"), "level"))
    e = _events(v, codes).repartition(n_tasks, "pseudonym").withColumn("level", F.explode(every))
    at, dow = F.col("at"), F.floor(F.col("at") / 24).cast("int")
    day, part = F.date_add("monday", dow), _place(cal.daypart(F.col("at") % 24), PARTS)
    shapes = [_bit(dow * len(PARTS) + part), _bit(F.lit(7 * len(PARTS)) + part), _bit(F.lit(8 * len(PARTS)) + F.when(dow >= 5, 1).otherwise(0))]
    masks = {"days": _bit(dow), "parts": reduce(Column.bitwiseOR, shapes), "flags": F.coalesce(_bit(F.col("lang")), F.lit(0)).bitwiseOR(F.coalesce("bins", F.lit(0)))}
    masks |= dict(zip(heat, _masks(at, HOURS, len(heat)), strict=True)) | dict(zip(topic, _masks(F.col("code"), CODES, len(topic)), strict=True))
    # A user's weeks. Rows of messages have days; those of registrations stand apart, and the first day before them all.
    weeks = e.groupBy("pseudonym", "level", "monday", "joined").agg(F.sum("n").alias("n"), F.sum("sessions").alias("sessions"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("seen").alias("seen"), F.min(day).alias("first"), F.max(day).alias("last"), *[F.bit_or(c).alias(name) for name, c in masks.items()])
    w = Window.partitionBy("pseudonym").orderBy("level", "monday", "joined")
    wrote = F.col("first").isNotNull()
    before = {c: F.last(F.when(wrote, F.col(x)), True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c, x in (("last_before", "last"), ("level_before", "level"))}
    after = {c: F.expr(f"lead(if(first is not null, {x}, null)) ignore nulls over (partition by pseudonym order by level, monday, joined)") for c, x in (("first_after", "first"), ("level_after", "level"))}
    seen = F.first("seen", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    weeks = weeks.withColumns({"__seen": seen, **before, **after}).filter("monday is not null")
    joined = F.col("joined").isNotNull()
    same = F.col("level_before") == F.col("level")
    active = F.col("pseudonym").isNotNull() & ((same & (F.col("last_before") >= F.col("opens"))) | ((F.col("level_after") == F.col("level")) & (F.col("first_after") <= F.col("closes"))))
    gap = F.greatest(_week_gap(F.col("days")), F.when(same & (F.col("last_before") >= F.col("opens")), F.datediff("first", "last_before")))
    levels = F.when(joined, F.array(F.lit("all"), "joined")).otherwise(F.array("level"))
    dealt = weeks.join(F.broadcast(_buckets(v)), "monday").withColumns({"reg": joined, "gap": gap, "act": F.when(joined & F.coalesce(active, F.lit(False)), F.col("n")), "new": F.when(wrote, F.col("__seen") >= F.col("opens"))}).withColumn("level", F.explode(levels))
    names = [*masks][1:]
    u = dealt.groupBy("pseudonym", "bucket", "whole", "level", "reg").agg(F.sum("n").alias("n"), F.count("first").alias("weeks"), F.sum("sessions").alias("sessions"), F.sum("act").alias("act"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("gap").alias("longest_gap"), F.max("new").alias("new"), *[F.bit_or(c).alias(c) for c in names])
    u = u.withColumns({"span_days": F.datediff("last", "first") + 1, "within_day": F.unix_micros("hi") - F.unix_micros("lo") <= 86_400_000_000}).withColumns(sections.classified())
    wrote = F.col("first").isNotNull()
    own = [_flag(wrote & (F.col("class") == c), c) for c in sections.CLASSES[:3]] + [_flag(wrote & F.col("frequent"), "frequent"), _flag(F.col("new"), "new"), _flag(~F.col("new"), "returning")]
    flags = F.coalesce("flags", F.lit(0)) + F.when(F.col("whole"), reduce(Column.__add__, own)).otherwise(0)
    reg, whole = F.col("reg"), F.col("whole")
    mark = lambda when, kind, value: F.when(when, F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("mark")))
    marks = [
        mark(reg, "registered", F.col("n")), mark(reg & whole & F.col("act").isNotNull(), "activated", F.col("act")), mark(~reg & wrote, "messages", F.col("n")), mark(F.col("sessions").isNotNull(), "sessions", F.col("sessions")), mark(~reg, "flags", flags),
        mark(whole & wrote, "weeks", F.col("weeks")), mark(whole & wrote, "parts", F.col("parts")), *[mark(whole & F.col(c).isNotNull(), c, F.col(c)) for c in topic], *[mark(whole & (F.col("level") == "all") & F.col(c).isNotNull(), c, F.col(c)) for c in heat],
    ]
    said = u.select("bucket", "level", F.explode(F.array(*marks)).alias("m")).filter("m is not null").groupBy("bucket", "level", "m.kind", "m.mark").agg(F.count(F.lit(1)).alias("n_users"))
    masked = F.col("kind").isin("flags", "parts", *heat, *topic)
    each = F.explode(F.when(masked, _bits(F.col("mark"))).otherwise(F.array(F.lit(-1)))).alias("bit")
    bits = said.select("bucket", "level", "kind", "mark", "n_users", each)
    return bits.groupBy("bucket", "level", "kind", F.when(F.col("bit") < 0, F.col("mark")).otherwise(F.col("bit")).alias("mark")).agg(F.sum("n_users").alias("n_users"))


def tally(v: View) -> Tallies:
    hours = settled(spoken(v.msg, v).groupBy("monday", "level", "dow", "hour", "lang").agg(F.sum("n").alias("n")))
    topics = settled(topic_rows(v).groupBy("monday", "level", "domain", "code").agg(F.sum("n").alias("n")))
    spread = settled(v.sess.groupBy("monday", "level", "n_messages", "minutes").agg(F.sum("n").alias("n")))
    names = topics.select("domain", "code").distinct().orderBy("domain", "code").collect()  # as short as the list of codes
    codes = v.win.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(names)], "of_domain string, of_code string, at int")
    n_rows = sum(t.agg(F.sum("n")).first()[0] or 0 for t in (hours, topics, spread))
    users = settled(_users(v, codes, len(names), tasks(v.win.sparkSession, n_rows, ROWS)))
    numbered = topics.join(F.broadcast(codes), F.col("domain").eqNullSafe(F.col("of_domain")) & F.col("code").eqNullSafe(F.col("of_code"))).drop("of_domain", "of_code")
    codes_known = settled(v.positives.select("domain", "code").distinct())
    rows = hours.withColumn("week", cal.week_id(F.col("monday")))
    return Tallies(users, hours, numbered, spread, replace(v, rows=rows, msg=rows, language=None, positives=codes_known))


def _counted(t: Tallies, kind: str, by: str = "window_id") -> DataFrame:
    """(by, level, mark, n_users) of one kind; `by`: window_id or week."""
    rows = t.users.filter(F.col("kind") == kind)
    if by == "week":
        weeks = t.view.axis.select("week", F.col("monday").cast("string").alias("bucket"))
        return rows.join(weeks, "bucket").select("week", "level", "mark", "n_users")
    return rows.withColumnRenamed("bucket", "window_id").join(t.view.win.select("window_id"), "window_id").select("window_id", "level", "mark", "n_users")


def _summed(t: Tallies, kind: str, by: str = "window_id") -> DataFrame:
    """(by, level, value, n_users) of a kind that is a number."""
    return _counted(t, kind, by).groupBy(by, "level").agg(F.sum(F.col("mark") * F.col("n_users")).alias("value"), F.sum("n_users").alias("n_users"))


def _named(t: Tallies, kind: str, names: DataFrame, by: str = "window_id") -> DataFrame:
    """(by, level, names, n_users): users by the bits that `names` has as `mark`."""
    return _counted(t, kind, by).join(F.broadcast(names), "mark").drop("mark")


def _flags(t: Tallies, column: str, bits: dict) -> DataFrame:
    """(mark, column) of the flags `bits` (name to what it stands for)."""
    return t.users.sparkSession.createDataFrame([(FLAGS.index(k), x) for k, x in bits.items()], f"mark long, {column} {'int' if isinstance(next(iter(bits.values())), int) else 'string'}")


def _hours(t: Tallies) -> DataFrame:
    """(mark, kind, dow, hour) of the bits of a week's hours."""
    at = F.col("id").cast("int")
    return t.users.sparkSession.range(168).select((at % HOURS).cast("long").alias("mark"), F.concat(F.lit("hours "), F.floor(at / HOURS).cast("string")).alias("kind"), (F.floor(at / 24) + 1).cast("int").alias("dow"), (at % 24).alias("hour"))


def _shapes(t: Tallies) -> DataFrame:
    return t.users.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(SHAPES)], "mark long, shape string, dow int, part string")


def _messages(t: Tallies, rows: DataFrame, *keys: str) -> DataFrame:
    """(window_id, level, keys, value): how many messages `rows` count."""
    return in_windows(by_level(rows), t.view).groupBy("window_id", "level", *keys).agg(F.sum("n").alias("value"))


def _parted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", cal.daypart(F.col("hour"))).select("monday", "level", "n", F.explode(sections.daypart_shapes()).alias("s")).select("monday", "level", "n", "s.*")


def _coded(t: Tallies) -> DataFrame:
    """(window_id, level, domain, code, value, n_users)"""
    kind = F.concat(F.lit("codes "), F.floor(F.col("at") / CODES).cast("string"))
    value = _messages(t, t.topics, "domain", "code", "at").withColumns({"kind": kind, "mark": (F.col("at") % CODES).cast("long")})
    users = t.users.filter(F.col("kind").startswith("codes ")).withColumnRenamed("bucket", "window_id")
    return value.join(users, ["window_id", "level", "kind", "mark"]).drop("kind", "mark", "at")


def cells(t: Tallies) -> dict[str, DataFrame]:
    """What each section takes for its cells."""
    v, keys, none = t.view, ["window_id", "level"], F.lit(0)
    measure = lambda df, name: df.withColumn("measure", F.lit(name))
    weekly = both_measures(_summed(t, "messages", "week"), ["level", "week"])
    usage = both_measures(_summed(t, "messages"), keys)
    for name, kind in (("sessions", "sessions"), ("new_registrations", "registered"), ("new_registrations_active", "activated")):
        usage = usage.unionByName(measure(_summed(t, kind), name))
    said = t.hours.groupBy("level", "monday", "lang").agg(F.sum("n").alias("n"))
    langs = _flags(t, "lang", {x: x for x in LANGUAGES})
    spoken_weeks = by_level(said.join(v.axis, "monday")).groupBy("level", "lang", "week").agg(F.sum("n").alias("value"))
    wrote = _summed(t, "messages").select(*keys)

    def each(kind: str, names: tuple) -> DataFrame:
        dim = _flags(t, kind, {x: x for x in names})
        every = wrote.crossJoin(dim.select(kind)).join(_named(t, "flags", dim), [*keys, kind], "left")
        return every.withColumn("n_users", F.coalesce("n_users", none)).withColumn("value", F.col("n_users"))

    kept = each("kind", ("new", "returning"))
    seen = kept.groupBy(*keys).agg(F.sum("value").alias("__all")).filter("__all > 0").select(*keys)
    heat = in_windows(t.hours.groupBy("monday", "dow", "hour").agg(F.sum("n").alias("n")), v).groupBy("window_id", "dow", "hour").agg(F.sum("n").alias("value"))
    hot = t.users.filter(F.col("level") == "all").join(F.broadcast(_hours(t)), ["kind", "mark"]).select(F.col("bucket").alias("window_id"), "dow", "hour", "n_users")
    terms = v.win_week.join(v.win.filter("kind = 'semester'").select("window_id"), "window_id").select("window_id", "week", "semester_week")
    shaped = ["shape", "dow", "part"]
    return {
        "weekly_activity": weekly.unionByName(measure(_summed(t, "sessions", "week"), "sessions")),
        "weekly_registrations": _summed(t, "registered", "week").filter("level = 'all'").drop("level"),
        "weekly_language": spoken_weeks.join(_named(t, "flags", langs, "week"), ["level", "lang", "week"]),
        "usage": usage,
        "retention": kept.join(seen, keys, "left_semi"),
        "classes": each("class", sections.CLASSES),
        "heatmap": heat.join(hot, ["window_id", "dow", "hour"]),
        "dayparts": _messages(t, _parted(t.hours), *shaped).join(_named(t, "parts", _shapes(t)), [*keys, *shaped]),
        "languages": _messages(t, said, "lang").join(_named(t, "flags", langs), [*keys, "lang"]),
        "topics": _coded(t),
        "profile": both_measures(_summed(t, "messages", "week").filter("level = 'all'").join(terms, "week").select("window_id", "semester_week", "value", "n_users"), ["window_id", "semester_week"]),
    }


def user_numbers(t: Tallies, kind: str) -> DataFrame:
    """(window_id, level, x, n): how many users have which number of messages or weeks."""
    return _counted(t, kind).select("window_id", "level", F.col("mark").alias("x"), F.col("n_users").alias("n"))


def session_numbers(t: Tallies, column: str) -> DataFrame:
    """(window_id, level, x, n): how many sessions have which number of messages or minutes."""
    return _messages(t, t.spread, column).select("window_id", "level", F.col(column).alias("x"), F.col("value").alias("n"))


def user_histogram(t: Tallies, kind: str, bins: tuple, floor: int) -> DataFrame:
    keys, rows = ["window_id", "level"], user_numbers(t, kind)
    n = rows.withColumn("bin", sections.bin_of(F.col("x"), bins)).groupBy(*keys, "bin").agg(F.sum("n").alias("value"))
    return sections.binned_cells(n.withColumn("n_users", F.col("value")), rows.select(*keys).distinct(), keys, bins, floor)


def session_histogram(t: Tallies, name: str, column: str, bins: tuple, floor: int) -> DataFrame:
    keys, rows = ["window_id", "level"], session_numbers(t, column)
    n = rows.withColumn("bin", sections.bin_of(F.floor("x"), bins)).groupBy(*keys, "bin").agg(F.sum("n").alias("value"))
    users = _named(t, "flags", _flags(t, "bin", {f"{name} {i}": i for i in range(len(bins))}))
    return sections.binned_cells(n.join(users, [*keys, "bin"]), rows.select(*keys).distinct(), keys, bins, floor)


def user_summary(t: Tallies, floor: int) -> DataFrame:
    rows = user_numbers(t, "messages")
    return sections.summary_of(rows, rows.groupBy("window_id", "level").agg(F.sum("n").alias("n_users")), ["window_id", "level"], floor)


def session_summary(t: Tallies, floor: int) -> DataFrame:
    return sections.summary_of(session_numbers(t, "minutes"), _summed(t, "sessions").drop("value"), ["window_id", "level"], floor, with_mean=False)


def measured(t: Tallies) -> trends.Measured:
    """What `trends.measure` gives, from the cells of all levels of every term. `once` is that of the users alone."""
    v = t.view
    term = v.win.filter("kind = 'semester'").select(F.col("window_id").alias("term"))
    own = lambda df: df.filter("level = 'all'").withColumnRenamed("window_id", "term").join(term, "term")
    found = cells(t)
    both = lambda df, *meta: own(df).select("term", *meta, F.col("value").alias("num"), "n_users")
    part, lang = trends.timing_meta(F.col("part")), trends.language_meta()
    rows = [both(found["dayparts"].filter("shape = 'span' and part = 'weekend'"), *trends.weekend_meta()), both(found["dayparts"].filter("shape = 'daypart'"), *part)]
    rows += [both(found["languages"].filter(F.col("lang").isin("de", "en")), *lang), both(trends.named_codes(found["topics"]), *trends.topic_meta())]
    rows += [both(_summed(t, kind), *trends.rate_meta(name, family)) for kind, name, family in (("messages", "messages", "volume_rate"), ("messages", "active-users", "people_rate"), ("sessions", "sessions", "volume_rate"), ("registered", "registrations", "people_rate"))]
    once = own(_named(t, "flags", _flags(t, "class", {"one_time": "one_time"}))).select("term", F.col("n_users").alias("once"))
    weeks = v.win_week.select(F.col("window_id").alias("term")).join(term, "term").groupBy("term").agg(F.count(F.lit(1)).alias("weeks"))
    cells_ = reduce(DataFrame.unionByName, rows).join(once, "term", "left").withColumn("once", F.coalesce("once", F.lit(0))).join(weeks, "term")
    spread = own(in_windows(trends.session_spread(replace(v, sess=t.spread)).withColumn("level", F.lit("all")), v)).groupBy("term", "candidate", "x").agg(F.sum("n").alias("n"))
    return trends.Measured(settled(cells_), settled(spread), v.win)
