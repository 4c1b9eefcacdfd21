"""Period comparison: candidates, tests, gates, findings and trajectories over pairs of windows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import stats
from ..sources.store import settled
from .facts import View, spoken, topic_rows

#: family, least absolute effect, least relative change, least n of a side. Fixed values.
FAMILIES = (
    ("language_share", 5.0, 0.0, 30), ("timing_share", 5.0, 0.0, 30), ("topic_share", 2.0, 0.3, 30), ("user_share", 5.0, 0.0, 10),
    ("volume_rate", 0.2231435513, 0.0, 30), ("people_rate", 0.2231435513, 0.0, 8), ("median", 0.2, 0.0, 10),
)
ALPHA = 0.05
CAP, TAB_CAPS, TAB_CAP = 5, {"topics": 3}, 2
TOP_CATEGORIES = ("statistics_interaction",)
LOW_CATEGORIES = ("politeness_expression", "greeting_expression")
LEFT_OUT = ("english_input", "german_input")
DAYPART_ORDER = ("morning", "afternoon", "evening", "night")


def families(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(str(f) for f in FAMILIES) + " AS f(family, min_effect, min_relative, min_n)")


def pairs(win: DataFrame) -> DataFrame:
    """(window_id, side, term): current (1) and baseline (2). A term is compared with the one before; all time compares
    the last term with the first, if there are two. Slices are not compared."""
    terms = win.filter("kind = 'semester'").select("window_id", "first_monday")
    w = Window.partitionBy(F.lit(0)).orderBy("first_monday")
    prev = terms.select("window_id", F.lag("window_id").over(w).alias("baseline")).filter("baseline is not null").select("window_id", F.col("window_id").alias("current"), "baseline")
    ends = terms.agg(F.max_by("window_id", "first_monday").alias("current"), F.min_by("window_id", "first_monday").alias("baseline")).filter("current <> baseline")
    both = prev.unionByName(ends.select(F.lit("all_time").alias("window_id"), "current", "baseline"))
    return both.select("window_id", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("current").alias("term")), F.struct(F.lit(2).alias("side"), F.col("baseline").alias("term")))).alias("s")).select("window_id", "s.*")


_META = ["candidate", "tab", "tier", "kind", "family", "grp"]


def _meta(candidate: Column, tab: str, tier: Column, kind: str, family: str, group: Column | None = None) -> list[Column]:
    return [candidate.alias("candidate"), F.lit(tab).alias("tab"), tier.alias("tier"), F.lit(kind).alias("kind"), F.lit(family).alias("family"), (F.lit(None).cast("string") if group is None else group).alias("grp")]


def rate_meta(name: str, family: str) -> list[Column]:
    return _meta(F.lit(f"adoption-rate-{name}"), "adoption", F.lit(3), "rate", family)


def weekend_meta() -> list[Column]:
    return _meta(F.lit("timing-weekend"), "timing", F.lit(2), "share", "timing_share")


def timing_meta(part: Column) -> list[Column]:
    return _meta(F.concat(F.lit("timing-"), part), "timing", F.lit(2), "share", "timing_share", F.lit("daypart"))


def language_meta() -> list[Column]:
    return _meta(F.concat(F.lit("language-"), F.col("lang")), "language", F.lit(3), "share", "language_share", F.lit("language"))


def topic_meta() -> list[Column]:
    domain, code = F.col("domain"), F.col("code")
    tier = F.when(domain.isin("method_theme", "emergent_theme"), 1).when(domain == "software_theme", 2).when(code.isin(*TOP_CATEGORIES), 1).when(code.isin(*LOW_CATEGORIES), 3).otherwise(2)
    return _meta(F.concat_ws("-", F.lit("topics"), domain, code), "topics", tier, "share", "topic_share")


def named_codes(rows: DataFrame) -> DataFrame:
    """Without the codes that are no topic of their own."""
    return rows.filter(~((F.col("domain") == "deductive") & F.col("code").isin(*LEFT_OUT)))


_STRUCT = "struct<candidate: string, tab: string, tier: int, kind: string, family: string, grp: string>"
_USERS, _MESSAGES, _SESSIONS = "adoption-rate-active-users", "adoption-rate-messages", "adoption-rate-sessions"


def candidate_rows(v: View, weeks: DataFrame) -> DataFrame:
    """(term, pseudonym, candidate, tab, tier, kind, family, grp, n, lo, hi) in the weeks (term, monday): rows that say how
    many messages a predicate holds for, or how many sessions or registrations there are; lo, hi: first and last message."""
    m = spoken(v.rows, v).join(weeks, "monday")
    fixed = [
        F.when(F.col("dow") >= 6, F.struct(*weekend_meta())),
        F.struct(*timing_meta(cal.daypart(F.col("hour")))),
        F.when(F.col("lang").isin("de", "en"), F.struct(*language_meta())),
        F.struct(*rate_meta("messages", "volume_rate")), F.struct(*rate_meta("active-users", "people_rate")),
    ]
    every = F.filter(F.array(*fixed).cast(f"array<{_STRUCT}>"), lambda x: x.isNotNull())
    hits = m.select("term", "pseudonym", "n", "lo", "hi", F.explode(every).alias("c")).select("term", "pseudonym", "c.*", "n", "lo", "hi")
    codes = named_codes(topic_rows(v)).join(weeks, "monday").select("term", "pseudonym", *topic_meta(), "n")
    none = F.lit(None).cast("timestamp")
    others = [rows.join(weeks, "monday").select("term", "pseudonym", *rate_meta(name, family), "n") for rows, name, family in ((v.sess, "sessions", "volume_rate"), (v.reg, "registrations", "people_rate"))]
    return reduce(DataFrame.unionByName, [hits, *[x.withColumns({"lo": none, "hi": none}) for x in (codes, *others)]])


def session_spread(v: View) -> DataFrame:
    """(monday, candidate, x, n): how many sessions of a week have which number of messages and minutes."""
    one = lambda name, x: F.struct(F.lit(name).alias("candidate"), x.cast("double").alias("x"))
    measures = F.array(one("engagement-messages-per-session", F.col("n_messages")), one("engagement-session-duration", F.col("minutes")))
    return v.sess.select("monday", "n", F.explode(measures).alias("m")).select("monday", "m.*", "n").groupBy("monday", "candidate", "x").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Measured:
    """What every comparison is made of, a row a term: `cells` (term, candidate, tab, tier, kind, family, grp, num,
    n_users, once, weeks) and `spread` (term, candidate, x, n). `once`: users whose messages of the term lie within a
    day, on at most two calendar days."""

    cells: DataFrame
    spread: DataFrame
    win: DataFrame


def measure(v: View) -> Measured:
    """One bridge deals weeks out to terms, which do not overlap, so no row of the grain is copied; period pairs and
    trajectories are pairs and lists of terms. Both tables are as small as terms times candidates (and distinct values),
    and are written, so that the many uses of them repeat neither scans nor plans."""
    terms = v.win_week.join(v.win.filter("kind = 'semester'").select("window_id"), "window_id").select(F.col("window_id").alias("term"), "monday")
    users = candidate_rows(v, terms).groupBy("term", *_META, "pseudonym").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    once = (F.datediff("hi", "lo") < 2) & (F.unix_micros("hi") - F.unix_micros("lo") <= 86_400_000_000)
    cells = users.groupBy("term", *_META).agg(F.sum("n").alias("num"), F.count(F.lit(1)).alias("n_users"), F.count_if(once).alias("once"))
    weeks = terms.groupBy("term").agg(F.count(F.lit(1)).alias("weeks"))
    spread = session_spread(v).join(terms, "monday").groupBy("term", "candidate", "x").agg(F.sum("n").alias("n"))
    return Measured(settled(cells.join(weeks, "term")), settled(spread), v.win)


def sides(m: Measured, sets: DataFrame) -> DataFrame:
    """(window_id, side, candidate.., num, den, n_users): a row for every share and rate of a side that has it.

    `sets` has (window_id, side, term). Users of a share are those of its numerator; what shares of messages are parts of
    is the count of the rate of messages, which has every message.
    """
    whole = F.max(F.when(F.col("candidate") == _MESSAGES, F.col("num"))).over(Window.partitionBy("window_id", "side"))
    hits = m.cells.join(sets, "term").withColumn("whole", whole)
    people, share = F.col("candidate") == _USERS, F.col("kind") == "share"
    row = lambda meta, num, den, users: F.struct(*meta, num.cast("long").alias("num"), den.cast("long").alias("den"), users.cast("long").alias("n_users"))
    own = [F.col(c) for c in _META]
    own_row = row(own, F.when(people, F.col("n_users")).otherwise(F.col("num")), F.when(share, F.col("whole")).otherwise(F.col("weeks")), F.col("n_users"))
    once = F.when(people, row(_meta(F.lit("adoption-one-time-share"), "adoption", F.lit(1), "share", "user_share"), F.col("once"), F.col("n_users"), F.col("once")))
    kind = f"array<{_STRUCT[:-1]}, num: bigint, den: bigint, n_users: bigint>>"
    every = F.filter(F.array(own_row, once).cast(kind), lambda x: x.isNotNull() & x["den"].isNotNull())
    return hits.select("window_id", "side", F.explode(every).alias("c")).select("window_id", "side", "c.*")


def evaluate_counts(rows: DataFrame) -> DataFrame:
    """(window_id, candidate.., current, baseline, users_1, users_2, n_1, n_2, delta, effect, z) from both sides' counts.
    A share of messages that is absent on one side is zero there, if the side has messages at all."""
    key = ["window_id", *_META]
    one = F.col("side") == 1
    a = rows.groupBy("window_id", *_META).agg(*[F.max(F.when(one if i == 1 else ~one, F.col(c))).cast("double").alias(f"{c}_{i}") for c in ("num", "den", "n_users") for i in (1, 2)])
    part = (F.col("kind") == "share") & (F.col("family") != "user_share")
    for i in (1, 2):
        there = F.max(F.when(part, F.col(f"den_{i}"))).over(Window.partitionBy("window_id"))
        a = a.withColumn(f"den_{i}", F.when(part, there).otherwise(F.col(f"den_{i}")))
        a = a.withColumns({c: F.when(part & F.col(f"den_{i}").isNotNull(), F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)) for c in (f"num_{i}", f"n_users_{i}")})
    x1, n1, x2, n2 = (F.col(c) for c in ("num_1", "den_1", "num_2", "den_2"))
    share = F.col("kind") == "share"
    defined = F.when(share, (n1 > 0) & (n2 > 0)).otherwise((x1 > 0) & (x2 > 0))
    ratio = stats.poisson_log_ratio(x1, n1, x2, n2)
    scale = F.when(share, 100.0).otherwise(1.0)
    cur, base = x1 / n1 * scale, x2 / n2 * scale
    z = F.when(share, stats.two_proportion_z(x1, n1, x2, n2)).otherwise(stats.poisson_z(x1, n1, x2, n2))
    out = a.filter(defined)
    return out.select(*key, cur.alias("current"), base.alias("baseline"), F.col("n_users_1").cast("long").alias("users_1"), F.col("n_users_2").cast("long").alias("users_2"), F.when(share, n1).otherwise(x1).alias("n_1"), F.when(share, n2).otherwise(x2).alias("n_2"), (cur - base).alias("delta"), F.abs(F.when(share, cur - base).otherwise(ratio)).alias("effect"), z.alias("z"))


def medians(m: Measured, sets: DataFrame) -> DataFrame:
    """(window_id, side, candidate, median, n_users)"""
    users = m.cells.filter(F.col("candidate") == _SESSIONS).join(sets, "term").select("window_id", "side", "n_users")
    return stats.quantiles_type2(m.spread.join(sets, "term"), ["window_id", "side", "candidate"], "x", {"median": 0.5}, n="n").join(users, ["window_id", "side"])


def evaluate_medians(m: Measured, sets: DataFrame) -> DataFrame:
    """The same columns for the two medians over sessions, by the rank test."""
    key, one = ["window_id", "candidate"], F.col("side") == 1
    wide = medians(m, sets).groupBy(*key).agg(*[F.max(F.when(one if i == 1 else ~one, F.col(c))).alias(f"{c}_{i}") for c in ("median", "n_users") for i in (1, 2)]).filter("median_1 is not null and median_2 is not null")
    out = wide.join(stats.mann_whitney(m.spread.join(sets, "term"), key, "side", "x", n="n"), key)
    meta = _meta(F.col("candidate"), "engagement", F.lit(2), "median", "median")
    return out.select("window_id", *meta, F.col("median_1").alias("current"), F.col("median_2").alias("baseline"), F.col("n_users_1").alias("users_1"), F.col("n_users_2").alias("users_2"), F.col("n1").alias("n_1"), F.col("n2").alias("n_2"), (F.col("median_1") - F.col("median_2")).alias("delta"), F.abs("effect").alias("effect"), "z")


def evaluate(v: View | Measured, floor: int, shapes: DataFrame | None = None) -> DataFrame:
    """All candidates of all compared windows; those of all time only if their whole trajectory is defined. A view is
    measured first."""
    m = v if isinstance(v, Measured) else measure(v)
    sets = pairs(m.win)
    both = evaluate_counts(sides(m, sets)).unionByName(evaluate_medians(m, sets))
    whole = (trajectories(m, floor) if shapes is None else shapes).select("candidate", F.lit("all_time").alias("window_id"), F.lit(True).alias("whole"))
    kept = both.join(whole, ["window_id", "candidate"], "left").filter("window_id <> 'all_time' or whole").select(both.columns)
    return kept.withColumn("p", stats.two_sided_p(F.col("z")))


def pool_order(candidate: Column) -> Column:
    """Dayparts in the pool's own order, then the id."""
    place = F.array_position(F.array(*[F.lit(f"timing-{d}") for d in DAYPART_ORDER]), candidate)
    return F.concat(F.lpad(place.cast("string"), 2, "0"), candidate)


def assess(evaluated: DataFrame, floor: int) -> DataFrame:
    """Every candidate with a verdict: floor, min_n, effect, p, group, cap or published; and its evidence.

    Gates come in this order. The false-discovery correction is over a window's testable candidates. Of a group only
    the largest effect stays. Published are at most CAP a window, and of a tab no more than its cap.
    """
    e = evaluated.join(F.broadcast(families(evaluated.sparkSession)), "family")
    low = F.least("users_1", "users_2") < floor
    few = F.least("n_1", "n_2") < F.col("min_n")
    relative = (F.col("min_relative") > 0) & (F.col("baseline") > 0) & (F.abs(F.col("current") - F.col("baseline")) / F.col("baseline") < F.col("min_relative"))
    e = e.withColumn("gate", F.when(low, "floor").when(few, "min_n").when((F.col("effect") < F.col("min_effect")) | relative, "effect").when(F.col("p") >= ALPHA, "p"))
    testable = F.coalesce(~F.col("gate").isin("floor", "min_n"), F.lit(True))
    tested = stats.benjamini_hochberg(e.withColumn("testable", testable), ["window_id", "testable"], "p", "candidate").withColumn("q", F.when(F.col("testable"), F.col("q"))).drop("testable")
    alive = F.col("gate").isNull()
    best = F.row_number().over(Window.partitionBy("window_id", alive, F.coalesce("grp", "candidate")).orderBy(F.desc("effect"), pool_order(F.col("candidate"))))
    t = tested.withColumn("gate", F.coalesce("gate", F.when(best > 1, "group")))
    alive = F.col("gate").isNull()
    order = ["tier", F.desc("effect"), "candidate"]
    in_tab = F.row_number().over(Window.partitionBy("window_id", alive, "tab").orderBy(*order))
    cap = F.lit(TAB_CAP)
    for tab, n in TAB_CAPS.items():
        cap = F.when(F.col("tab") == tab, n).otherwise(cap)
    t = t.withColumn("gate", F.coalesce("gate", F.when(in_tab > cap, "cap")))
    alive = F.col("gate").isNull()
    nth = F.row_number().over(Window.partitionBy("window_id", alive).orderBy(*order))
    t = t.withColumn("verdict", F.coalesce("gate", F.when(nth > CAP, "cap"), F.lit("published")))
    return t.withColumn("evidence", F.when(F.col("verdict") == "published", F.when(F.col("q") < ALPHA, "robust").otherwise("indicative"))).drop("gate", "min_effect", "min_relative", "min_n")


def findings(assessed: DataFrame) -> DataFrame:
    """(window_id, place, candidate, tab, title, current, baseline, delta, evidence, users_1, users_2), numbers to one decimal."""
    place = F.row_number().over(Window.partitionBy("window_id").orderBy("tier", F.desc("effect"), "candidate"))
    verb = F.when(F.col("kind") == "median", F.when(F.col("delta") > 0, "lengthened").otherwise("shortened")).otherwise(F.when(F.col("delta") > 0, "rose").otherwise("fell"))
    one = lambda c: F.round(c, 1).alias(c)
    return assessed.filter("verdict = 'published'").select("window_id", place.alias("place"), "candidate", "tab", F.concat_ws(" ", "candidate", verb).alias("title"), one("current"), one("baseline"), one("delta"), "evidence", "users_1", "users_2")


def verdict_tally(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("window_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


def baselines(win: DataFrame) -> DataFrame:
    """(window_id, baseline) of every window but slices: the term before, `trajectory` for all time, or none."""
    against = F.when(F.col("window_id") == "all_time", "trajectory").otherwise(F.col("term"))
    named = pairs(win).filter("side = 2").select("window_id", against.alias("baseline"))
    return win.filter("kind <> 'semester_slice'").select("window_id").join(named, "window_id", "left")


def sufficient(v: View | Measured, assessed: DataFrame) -> DataFrame:
    """(window_id, baseline, insufficient_data): there is a baseline, but no candidate could be tested."""
    tested = assessed.groupBy("window_id").agg(F.count_if(~F.col("verdict").isin("floor", "min_n")).alias("tested"))
    flag = F.col("baseline").isNotNull() & (F.coalesce("tested", F.lit(0)) == 0)
    return baselines(v.win).join(tested, "window_id", "left").select("window_id", "baseline", flag.alias("insufficient_data"))


def trajectories(v: View | Measured, floor: int) -> DataFrame:
    """(candidate, points): a candidate's value in every term, oldest first, with its users; none if any term is
    undefined or below the floor. A view is measured first."""
    m = v if isinstance(v, Measured) else measure(v)
    # A candidate that a term lacks is undefined there; so every term gets every candidate's row.
    sets = m.win.filter("kind = 'semester'").select(F.lit("all").alias("window_id"), F.dense_rank().over(Window.orderBy("window_id")).alias("side"), F.col("window_id").alias("term"))
    scale = F.when(F.col("kind") == "share", 100.0).otherwise(1.0)
    counted = sides(m, sets).select("candidate", "side", (F.col("num") / F.col("den") * scale).alias("value"), "n_users", ((F.col("n_users") >= floor) & (F.col("num") > 0)).alias("ok"))
    middle = medians(m, sets).select("candidate", "side", F.col("median").alias("value"), "n_users", (F.col("n_users") >= floor).alias("ok"))
    rows = counted.unionByName(middle).join(sets.select("term", "side"), "side")
    points = F.sort_array(F.collect_list(F.struct("term", "value", "n_users")))
    whole = rows.groupBy("candidate").agg(points.alias("points"), F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("n")).filter("ok")
    return whole.join(sets.agg(F.count(F.lit(1)).alias("n")), "n").select("candidate", "points")


def section(v: View | Measured, floor: int) -> tuple[DataFrame, DataFrame]:
    """The published section: (window_id, baseline, insufficient_data), and the findings, each with its sides' users
    and, under a trajectory, its points. What both read, a row a candidate, is written once."""
    m = v if isinstance(v, Measured) else measure(v)
    shapes = settled(trajectories(m, floor))
    assessed = settled(assess(evaluate(m, floor, shapes), floor))
    points = shapes.select("candidate", F.lit("all_time").alias("window_id"), F.transform("points", lambda x: F.struct(x["term"].alias("term"), F.round(x["value"], 1).alias("value"), x["n_users"].alias("n_users"))).alias("trajectory"))
    return sufficient(m, assessed), findings(assessed).join(points, ["window_id", "candidate"], "left")
