"""Registered queries of trends, labels, ingest, erasure and the guard."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import stats, text
from ..functions.cells import count_cells, floored
from ..operators import guard, labels, sections, trends
from ..operators.facts import View, levels_present
from ..sources import files, grains, ingest, store, versioned
from . import document, section_queries
from .corpora import EXTRACTED, LONG, SHORT, corpus, corpus_view, options, read, stored_view, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = b"a key for tests"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _on(kind: str, build: Callable[[View], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(corpus_view(spark, sf_dir, kind))


def _stored(build: Callable[[View], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(stored_view(spark, sf_dir, LONG))


def _measured(build: Callable[[trends.Measured], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return _stored(lambda v: build(trends.measure(v)))


def _erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    p = repr(stats.ERFC[-1])
    for c in reversed(stats.ERFC[:-1]):
        p = f"({c!r} + {t} * {p})"
    return f"({t} * exp(-{x} * {x} + {p}))"


_PAIRS = """
, sem AS (SELECT window_id, first_monday FROM win WHERE kind = 'semester')
, pairs AS (
    SELECT window_id, window_id AS cur, lag(window_id) OVER (ORDER BY first_monday) AS base FROM sem QUALIFY base IS NOT NULL
    UNION ALL SELECT 'all_time', max_by(window_id, first_monday), min_by(window_id, first_monday) FROM sem HAVING count(*) > 1)
, sets AS (
    SELECT p.window_id, 1 AS side, monday FROM pairs p JOIN win_week w ON w.window_id = p.cur
    UNION ALL SELECT p.window_id, 2, monday FROM pairs p JOIN win_week w ON w.window_id = p.base)
, hits AS (
    SELECT history_id, pseudonym, monday, concat_ws('-', 'topics', domain, code) AS candidate, 'topics' AS tab, CASE WHEN domain = 'method_theme' THEN 1 ELSE 2 END AS tier, 'share' AS kind, 'topic_share' AS family, CAST(NULL AS VARCHAR) AS grp FROM msg JOIN pos USING (history_id)
    UNION ALL SELECT history_id, pseudonym, monday, 'timing-weekend', 'timing', 2, 'share', 'timing_share', NULL FROM msg WHERE dow >= 6
    UNION ALL SELECT history_id, pseudonym, monday, 'timing-' || CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END, 'timing', 2, 'share', 'timing_share', 'daypart' FROM msg
    UNION ALL SELECT history_id, pseudonym, monday, 'language-' || lang, 'language', 3, 'share', 'language_share', 'language' FROM msg WHERE lang IN ('de', 'en'))
, share AS (
    SELECT window_id, side, candidate, tab, tier, kind, family, grp, coalesce(num, 0) AS num, den, coalesce(n_users, 0) AS n_users
    FROM (SELECT window_id, side, count(*) AS den FROM msg JOIN sets USING (monday) GROUP BY ALL)
    JOIN (SELECT DISTINCT window_id, candidate, tab, tier, kind, family, grp FROM hits JOIN sets USING (monday)) USING (window_id)
    LEFT JOIN (SELECT window_id, side, candidate, count(*) AS num, count(DISTINCT pseudonym) AS n_users FROM hits JOIN sets USING (monday) GROUP BY ALL) USING (window_id, side, candidate))
, days AS (SELECT window_id, side, pseudonym, day, min(local) AS lo, max(local) AS hi FROM msg JOIN sets USING (monday) GROUP BY ALL)
, once AS (
    SELECT window_id, side, 'adoption-one-time-share' AS candidate, 'adoption' AS tab, 1 AS tier, 'share' AS kind, 'user_share' AS family, CAST(NULL AS VARCHAR) AS grp, count(*) FILTER (span < 3 AND within_day) AS num, count(*) AS den, num AS n_users
    FROM (SELECT window_id, side, pseudonym, max(day) - min(day) + 1 AS span, epoch_us(max(hi)) - epoch_us(min(lo)) <= 86400000000 AS within_day FROM days GROUP BY ALL) GROUP BY ALL)
, rate AS (
    SELECT window_id, side, 'adoption-rate-' || name AS candidate, 'adoption' AS tab, 3 AS tier, 'rate' AS kind, CASE WHEN name IN ('messages', 'sessions') THEN 'volume_rate' ELSE 'people_rate' END AS family, CAST(NULL AS VARCHAR) AS grp,
           CASE WHEN name = 'active-users' THEN count(DISTINCT pseudonym) ELSE count(*) END AS num, any_value(weeks) AS den, count(DISTINCT pseudonym) AS n_users
    FROM (SELECT 'messages' AS name, monday, pseudonym FROM msg UNION ALL SELECT 'sessions', monday, pseudonym FROM sess UNION ALL SELECT 'active-users', monday, pseudonym FROM msg UNION ALL SELECT 'registrations', monday, pseudonym FROM reg)
    JOIN sets USING (monday) JOIN (SELECT window_id, side, count(*) AS weeks FROM sets GROUP BY ALL) USING (window_id, side) GROUP BY window_id, side, name)
, sides AS (SELECT * FROM share UNION ALL SELECT * FROM once UNION ALL SELECT * FROM rate)
, wide AS (
    SELECT window_id, candidate, tab, tier, kind, family, grp, CAST(max(num) FILTER (side = 1) AS DOUBLE) AS x1, CAST(max(den) FILTER (side = 1) AS DOUBLE) AS n1, CAST(max(num) FILTER (side = 2) AS DOUBLE) AS x2, CAST(max(den) FILTER (side = 2) AS DOUBLE) AS n2,
           max(n_users) FILTER (side = 1) AS users_1, max(n_users) FILTER (side = 2) AS users_2
    FROM sides GROUP BY ALL)
, counted AS (
    SELECT window_id, candidate, tab, tier, kind, family, grp, x1 / n1 * f AS current, x2 / n2 * f AS baseline, users_1, users_2, CASE WHEN kind = 'share' THEN n1 ELSE x1 END AS n_1, CASE WHEN kind = 'share' THEN n2 ELSE x2 END AS n_2, current - baseline AS delta,
           abs(CASE WHEN kind = 'share' THEN current - baseline ELSE ln((x1 / n1) / (x2 / n2)) END) AS effect,
           CASE WHEN kind = 'rate' THEN ln((x1 / n1) / (x2 / n2)) / sqrt(1 / x1 + 1 / x2) WHEN (x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) > 0 THEN (x1 / n1 - x2 / n2) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)) ELSE 0 END AS z
    FROM (SELECT *, CASE WHEN kind = 'share' THEN 100.0 ELSE 1.0 END AS f FROM wide) WHERE CASE WHEN kind = 'share' THEN n1 > 0 AND n2 > 0 ELSE x1 > 0 AND x2 > 0 END)
"""
_MEDIANS = """
, s AS (
    SELECT window_id, side, pseudonym, candidate, x FROM (SELECT monday, pseudonym, 'engagement-messages-per-session' AS candidate, CAST(n_messages AS DOUBLE) AS x FROM sess UNION ALL SELECT monday, pseudonym, 'engagement-session-duration', minutes FROM sess) JOIN sets USING (monday))
, ranked AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY window_id, candidate, x) - 1) / 2 AS midrank, count(*) OVER (PARTITION BY window_id, candidate, x) AS ties FROM s WINDOW w AS (PARTITION BY window_id, candidate ORDER BY x))
, mw AS (
    SELECT window_id, candidate, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (side = 2) AS DOUBLE) AS n2, sum(midrank) FILTER (side = 1) - n1 * (n1 + 1) / 2 AS u, sum(CAST(ties AS DOUBLE) * ties - 1) AS tied,
           (quantile_disc(x, 0.5) FILTER (side = 1) - quantile_disc(-x, 0.5) FILTER (side = 1)) / 2 AS m1, (quantile_disc(x, 0.5) FILTER (side = 2) - quantile_disc(-x, 0.5) FILTER (side = 2)) / 2 AS m2,
           count(DISTINCT pseudonym) FILTER (side = 1) AS users_1, count(DISTINCT pseudonym) FILTER (side = 2) AS users_2
    FROM ranked GROUP BY ALL)
, medians AS (
    SELECT window_id, candidate, 'engagement' AS tab, 2 AS tier, 'median' AS kind, 'median' AS family, CAST(NULL AS VARCHAR) AS grp, m1 AS current, m2 AS baseline, users_1, users_2, n1 AS n_1, n2 AS n_2, m1 - m2 AS delta, abs(2 * u / (n1 * n2) - 1) AS effect,
           CASE WHEN var > 0 THEN sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(var) ELSE 0 END AS z
    FROM (SELECT *, n1 * n2 / 12 * (n1 + n2 + 1 - tied / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM mw) WHERE m1 IS NOT NULL AND m2 IS NOT NULL)
"""
_COLS = "window_id, candidate, tab, tier, kind, family, grp, current, baseline, users_1, users_2, n_1, n_2, delta, effect, z"
_add("trend_counts", _measured(lambda m: trends.evaluate_counts(trends.sides(m, trends.pairs(m.win)))), view_sql(LONG) + _PAIRS + f"SELECT {_COLS} FROM counted")
_add("trend_medians", _measured(lambda m: trends.evaluate_medians(m, trends.pairs(m.win))), view_sql(LONG) + _PAIRS + _MEDIANS + f"SELECT {_COLS} FROM medians")
_T = ("sets", "share", "days", "once", "rate", "sides", "pairs")
_TRAJ = "\n, tsets AS (SELECT 'all' AS window_id, dense_rank() OVER (ORDER BY window_id) AS side, window_id AS term, monday FROM win_week WHERE kind = 'semester')" + re.sub(rf"\b({'|'.join(_T)})\b(?= AS \(| USING| GROUP|$)|(?<=JOIN )({'|'.join(_T)})\b|(?<=FROM )({'|'.join(_T)})\b", lambda m: "t" + m[0], _PAIRS[_PAIRS.index("\n, share"):_PAIRS.index("\n, wide")])
_TRAJ += """
, tpoints AS (
    SELECT candidate, side, num / den * CASE WHEN kind = 'share' THEN 100.0 ELSE 1.0 END AS value, n_users, n_users >= 5 AND num > 0 AS ok FROM tsides
    UNION ALL SELECT candidate, side, (quantile_disc(x, 0.5) - quantile_disc(-x, 0.5)) / 2, count(DISTINCT pseudonym) AS u, u >= 5 FROM (SELECT side, pseudonym, unnest([{'candidate': 'engagement-messages-per-session', 'x': CAST(n_messages AS DOUBLE)}, {'candidate': 'engagement-session-duration', 'x': minutes}], recursive := true) FROM sess JOIN tsets USING (monday)) GROUP BY candidate, side)
, whole AS (SELECT candidate FROM tpoints GROUP BY 1 HAVING bool_and(ok) AND count(*) = (SELECT count(*) FROM win WHERE kind = 'semester'))
"""
_ASSESS = f"""
, fam(family, min_effect, min_relative, min_n) AS (VALUES {", ".join(map(str, trends.FAMILIES))})
, ev AS (SELECT *, least(1.0, {_erfc_sql("(abs(z) / sqrt(2.0))")}) AS p FROM (SELECT {_COLS} FROM counted UNION ALL SELECT {_COLS} FROM medians) JOIN fam USING (family) WHERE window_id <> 'all_time' OR candidate IN (SELECT candidate FROM whole))
, g1 AS (SELECT *, CASE WHEN least(users_1, users_2) < 5 THEN 'floor' WHEN least(n_1, n_2) < min_n THEN 'min_n' WHEN effect < min_effect OR (min_relative > 0 AND baseline > 0 AND abs(current - baseline) / baseline < min_relative) THEN 'effect' WHEN p >= 0.05 THEN 'p' END AS gate FROM ev)
, g2 AS (SELECT *, coalesce(gate NOT IN ('floor', 'min_n'), true) AS testable FROM g1)
, g3 AS (SELECT *, count(*) OVER (PARTITION BY window_id, testable) / row_number() OVER (PARTITION BY window_id, testable ORDER BY p, candidate) * p AS raw FROM g2)
, g4 AS (SELECT *, CASE WHEN testable THEN least(1.0, min(raw) OVER (PARTITION BY window_id, testable ORDER BY p DESC, candidate DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM g3)
, g5 AS (SELECT * REPLACE (coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY window_id, gate IS NULL, coalesce(grp, candidate) ORDER BY effect DESC, lpad(CAST(coalesce(list_position(['timing-morning', 'timing-afternoon', 'timing-evening', 'timing-night'], candidate), 0) AS VARCHAR), 2, '0') || candidate) > 1 THEN 'group' END) AS gate) FROM g4)
, g6 AS (SELECT * REPLACE (coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY window_id, gate IS NULL, tab ORDER BY tier, effect DESC, candidate) > CASE tab WHEN 'topics' THEN 3 ELSE 2 END THEN 'cap' END) AS gate) FROM g5)
, assessed AS (SELECT *, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY window_id, gate IS NULL ORDER BY tier, effect DESC, candidate) > 5 THEN 'cap' END, 'published') AS verdict FROM g6)
"""
_add("trend_verdicts", _measured(lambda v: trends.assess(trends.evaluate(v, 5), 5).select("window_id", "candidate", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "verdict", "evidence")),
     view_sql(LONG) + _PAIRS + _MEDIANS + _TRAJ + _ASSESS + "SELECT window_id, candidate, round(p, 6) AS p, round(q, 6) AS q, verdict, CASE WHEN verdict = 'published' THEN CASE WHEN q < 0.05 THEN 'robust' ELSE 'indicative' END END AS evidence FROM assessed")
_add("trend_tally", _measured(lambda v: trends.verdict_tally(trends.assess(trends.evaluate(v, 5), 5))), view_sql(LONG) + _PAIRS + _MEDIANS + _TRAJ + _ASSESS + "SELECT window_id, verdict, count(*) AS n FROM assessed GROUP BY ALL")
_add("trend_findings", _measured(lambda v: trends.section(v, 5)[1].select("window_id", "place", "candidate", "tab", "title", "current", "baseline", "delta", "evidence", "users_1", "users_2", F.size("trajectory").alias("points"))),
     view_sql(LONG) + _PAIRS + _MEDIANS + _TRAJ + _ASSESS + """SELECT window_id, row_number() OVER (PARTITION BY window_id ORDER BY tier, effect DESC, candidate) AS place, candidate, tab, candidate || CASE WHEN kind = 'median' THEN CASE WHEN delta > 0 THEN ' lengthened' ELSE ' shortened' END WHEN delta > 0 THEN ' rose' ELSE ' fell' END AS title,
     round(current, 1) AS current, round(baseline, 1) AS baseline, round(delta, 1) AS delta, CASE WHEN q < 0.05 THEN 'robust' ELSE 'indicative' END AS evidence, users_1, users_2, CASE WHEN window_id = 'all_time' THEN (SELECT CAST(count(*) AS INT) FROM win WHERE kind = 'semester') END AS points FROM assessed WHERE verdict = 'published'""")
_add("trend_sufficient", _measured(lambda v: trends.sufficient(v, trends.assess(trends.evaluate(v, 5), 5))),
     view_sql(LONG) + _PAIRS + _MEDIANS + _TRAJ + _ASSESS + """SELECT w.window_id, CASE WHEN w.window_id = 'all_time' AND p.base IS NOT NULL THEN 'trajectory' ELSE p.base END AS baseline, p.base IS NOT NULL AND coalesce(n, 0) = 0 AS insufficient_data
     FROM win w LEFT JOIN pairs p USING (window_id) LEFT JOIN (SELECT window_id, count(*) FILTER (verdict NOT IN ('floor', 'min_n')) AS n FROM assessed GROUP BY 1) a USING (window_id) WHERE w.kind <> 'semester_slice'""")
_add("trend_trajectories", _measured(lambda v: trends.trajectories(v, 5).select("candidate", F.explode("points").alias("x")).select("candidate", "x.term", "x.value", "x.n_users")),
     view_sql(LONG) + _PAIRS + _TRAJ + "SELECT candidate, term, value, n_users FROM tpoints JOIN whole USING (candidate) JOIN (SELECT DISTINCT side, term FROM tsets) USING (side)")


def _two_runs(s: SparkSession, d: str) -> View:
    """A view over a store that two runs have filled, the first up to the middle of the years."""
    c, folder, own = corpus(s, d, LONG), store.scratch(s), options(LONG)
    grains.update(c, folder, **own | {"extracted": dt.date(1998, 8, 6)})
    grains.update(c, folder, **own)
    return grains.view(c, folder, **own)


_add("stored_grain", lambda s, d: _two_runs(s, d).rows.groupBy("week", "level", "lang", "dow", "hour").agg(F.sum("n").alias("n"), F.count_distinct("pseudonym").alias("users")),
     view_sql(LONG) + "SELECT week, level, lang, dow, hour, count(*) AS n, count(DISTINCT pseudonym) AS users FROM msg GROUP BY ALL")
_add("stored_sessions", lambda s, d: _two_runs(s, d).sess.select("pseudonym", "session_started", "week", "level", "n_messages", "minutes"), view_sql(LONG) + "SELECT pseudonym, session_started, week, level, n_messages, minutes FROM sess")
_add("stored_retention", lambda s, d: sections.retention(_two_runs(s, d), 5), section_queries.ORACLES["retention"])

_THROUGH = EXTRACTED[LONG] - dt.timedelta(days=EXTRACTED[LONG].weekday() + 1)
RULES = ("suppressed_bare", "floor_respected", "no_recoverable_partition", "no_small_remainder", "heatmap_dense", "dayparts_dense", "weekly_dense", "dayparts_tile", "bins_ascend", "windows_resolve", "slices_contiguous", "profiles_ascend", "levels_known", "coverage_ordered", "trends")
_add("guard_report", _stored(lambda v: document.report(v, 4, _THROUGH)), f"SELECT unnest({list(RULES)}) AS rule, 0 AS n")


def _faulty(v: View) -> DataFrame:
    """The rules over tables with faults that follow from the data."""
    usage = sections.window_usage(v, 4)
    heat, week, keys = sections.hour_heatmap(v, 4), sections.weekly_activity(v, 4), ["window_id", "level"]
    users = sections.per_user_rows(v)
    grid = v.win.select("window_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("dow")).select("window_id", "dow", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    weeks = v.axis.select("week").crossJoin(levels_present(v))
    levels = usage.withColumn("level", F.when(F.col("level") == "master", "phd").otherwise(F.col("level")))
    lone = usage.withColumn("status", F.when((F.col("level") == "staff") & F.col("measure").isin("messages", "sessions"), "suppressed").when(F.col("level") != "all", "ok").otherwise(F.col("status")))
    short = usage.withColumns({"status": F.lit("ok"), "value": F.when(F.col("level") == "all", 7).when(F.col("level") == "master", 6).otherwise(0)})
    bins = sections.histogram(users, keys, "messages", sections.MESSAGE_BINS, 4).withColumn("hi", F.when(F.col("bin") == 1, 6).otherwise(F.col("hi")))
    # six findings of one tab in every window that could be compared, none with points
    crowded = v.win.filter("kind <> 'semester_slice'").select("window_id", F.lit("topics").alias("tab"), F.lit(9).alias("users_1"), F.lit(9).alias("users_2"), F.lit(None).cast("array<struct<term: string, value: double, n_users: long>>").alias("trajectory"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("place"))
    found = [
        guard.suppressed_bare(usage.withColumn("value", F.coalesce("value", F.lit(1)))),
        guard.floor_respected(sections.summary(users, keys, "messages", 1), 4), guard.no_recoverable_partition(lone), guard.no_small_remainder(short, 4),
        guard.dense_over(heat.filter("hour <> 3"), grid, ["window_id", "dow", "hour"], "heatmap_dense"),
        guard.dense_over(week.filter("measure = 'messages' and level <> 'staff'"), weeks, ["week", "level"], "weekly_dense"),
        guard.bins_ascend(bins, keys), guard.windows_resolve(v.win.filter("kind <> 'semester'"), usage),
        guard.slices_contiguous(v.win_week.filter("semester_week <> 16"), v.win), guard.profiles_ascend(sections.semester_profile(v, 3).filter("semester_week <> 2"), v.win),
        guard.levels_known(levels), guard.enrollment_terms(v.win.filter("kind <> 'semester_slice'").select("window_id"), v.win),
        guard.coverage_ordered(v.win.withColumns({"first_week": F.col("last_week"), "last_week": F.col("first_week")}), v.axis, _THROUGH), guard.tiles(v.win.sparkSession.sql("SELECT * FROM VALUES ('a', 0, 6), ('b', 7, 24) AS p(name, from_hour, to_hour)")),
        guard.dense_over(sections.dayparts(v, 4).filter("not (shape = 'grid' and dow = 3 and part = 'night')"), document.daypart_scaffold(v), document.DAYPART_KEYS, "dayparts_dense"),
        guard.trend_rules(crowded, trends.baselines(v.win).withColumn("insufficient_data", F.lit(False)), v.win),
    ]
    return reduce(DataFrame.unionByName, found)


_add("guard_faults", _on(LONG, _faulty), view_sql(LONG) + section_queries.USAGE + """
, lw AS (SELECT DISTINCT window_id, level FROM usage)
, users AS (SELECT window_id, lv AS level, pseudonym FROM lmsg JOIN win_week USING (monday) GROUP BY ALL)
SELECT 'suppressed_bare' AS rule, count(*) FILTER (status = 'suppressed') AS n FROM usage
UNION ALL SELECT 'floor_respected', count(*) FROM (SELECT window_id, level FROM users GROUP BY ALL HAVING count(*) < 4)
UNION ALL SELECT 'no_recoverable_partition', count(*) FROM usage WHERE level = 'all' AND measure IN ('messages', 'sessions') AND status = 'ok'
UNION ALL SELECT 'no_small_remainder', count(*) FROM usage WHERE level = 'all' AND measure <> 'active_users'
UNION ALL SELECT 'heatmap_dense', 7 * count(*) FROM win
UNION ALL SELECT 'weekly_dense', count(*) FROM axis
UNION ALL SELECT 'bins_ascend', count(DISTINCT (window_id, level)) FROM users
UNION ALL SELECT 'windows_resolve', (SELECT count(DISTINCT window_id) FROM usage JOIN win USING (window_id) WHERE kind = 'semester') + (SELECT count(*) FROM win WHERE kind = 'semester_slice')
UNION ALL SELECT 'slices_contiguous', count(*) FROM (SELECT window_id FROM win_week WHERE kind = 'semester_slice' AND semester_week <> 16 GROUP BY 1 HAVING max(monday) - min(monday) <> 7 * (count(*) - 1))
UNION ALL SELECT 'profiles_ascend', 2 * count(*) FROM (SELECT window_id FROM win_week WHERE kind = 'semester' AND semester_week IN (1, 3) GROUP BY 1 HAVING count(*) = 2)
UNION ALL SELECT 'levels_known', 1
UNION ALL SELECT 'enrollment_terms', count(*) FROM win WHERE kind = 'all_time'
UNION ALL SELECT 'coverage_ordered', count(*) FROM win WHERE first_week <> last_week
UNION ALL SELECT 'dayparts_tile', 1
UNION ALL SELECT 'dayparts_dense', (SELECT count(*) FROM win) * (SELECT count(*) FROM levels)
UNION ALL SELECT 'trends', 2 * count(*) + 12 FROM win WHERE kind <> 'semester_slice'""")


# Labels. `documents` stands in for messages; `labels` holds the truth, a rule on the length the prediction.
def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("history_id"), F.lit("truth").alias("label_version"), F.explode(F.array(F.struct(F.lit("quality").alias("code"), F.col("quality").alias("value")), F.struct(F.lit("toxic").alias("code"), F.col("toxic").alias("value")))).alias("x")).select("history_id", "label_version", F.lit("deductive").alias("domain"), "x.*")
    rule = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("history_id"), F.lit("rule").alias("label_version"), F.lit("deductive").alias("domain"), F.explode(F.array(F.struct(F.lit("quality").alias("code"), (F.col("n_chars") > 300).cast("int").alias("value")), F.struct(F.lit("toxic").alias("code"), (F.col("n_chars") < 100).cast("int").alias("value")))).alias("x")).select("history_id", "label_version", "domain", "x.*")
    return truth.unionByName(rule)


_AGREE = """SELECT 'deductive' AS domain, code, count(*) AS n, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn
FROM (SELECT 'quality' AS code, quality AS t, CAST(n_chars > 300 AS INT) AS p FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'toxic', toxic, CAST(n_chars < 100 AS INT) FROM labels JOIN documents USING (doc_id)) GROUP BY code"""
_MCC = "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END"
_add("label_agreement", lambda s, d: labels.agreement(_coded(s, d), "truth", "rule"), f"SELECT *, {_MCC} AS mcc FROM ({_AGREE})")
_add("label_agreement_average", lambda s, d: labels.average_agreement(labels.agreement(_coded(s, d), "truth", "rule")), f"SELECT avg({_MCC}) AS mcc, count({_MCC}) AS codes FROM ({_AGREE})")
_add("label_coverage", lambda s, d: labels.coverage(_coded(s, d).withColumn("provenance", F.concat("label_version", F.lit("-"), "code")), "truth", "rule"),
     "SELECT count(DISTINCT doc_id) AS messages, (SELECT list_sort(list(DISTINCT 'rule-' || code)) FROM (SELECT doc_id, unnest(['toxic', 'quality']) AS code FROM documents)) AS models FROM labels JOIN documents USING (doc_id)")
_add("label_versions", lambda s, d: labels.versions(_coded(s, d)).join(_coded(s, d).groupBy("label_version").agg(F.count_distinct("history_id").alias("messages")), "label_version"),
     "SELECT 'truth' AS label_version, count(DISTINCT doc_id) AS messages FROM labels UNION ALL SELECT 'rule', count(DISTINCT doc_id) FROM documents")
_add("label_pending", lambda s, d: labels.pending(read(s, d, "documents").select(F.col("doc_id").alias("history_id")), _coded(s, d), label_version="truth", domain="deductive"), "SELECT doc_id AS history_id FROM documents ANTI JOIN labels USING (doc_id)")
_add("label_batches", lambda s, d: labels.batches(labels.pending(read(s, d, "documents").select(F.col("doc_id").alias("history_id")), _coded(s, d), label_version="truth")).select("bucket", "batch", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last")),
     "SELECT bucket, batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, doc_id % 64 AS bucket, (row_number() OVER (PARTITION BY doc_id % 64 ORDER BY doc_id) - 1) // 10 AS batch FROM documents ANTI JOIN labels USING (doc_id)) GROUP BY 1, 2")
_add("label_upsert", lambda s, d: labels.upsert(_coded(s, d).filter("label_version = 'rule'"), _coded(s, d).filter("label_version = 'truth'").withColumn("label_version", F.lit("rule")).withColumn("at", F.lit(1)).unionByName(_coded(s, d).filter("label_version = 'truth' and code = 'toxic'").withColumns({"label_version": F.lit("rule"), "value": 1 - F.col("value"), "at": F.lit(2)})), labels.KEY, "at"),
     """SELECT doc_id AS history_id, 'rule' AS label_version, 'deductive' AS domain, code, CASE WHEN l.doc_id IS NULL THEN rule ELSE truth END AS value
     FROM (SELECT doc_id, 'quality' AS code, CAST(n_chars > 300 AS INT) AS rule FROM documents UNION ALL SELECT doc_id, 'toxic', CAST(n_chars < 100 AS INT) FROM documents) x
     LEFT JOIN (SELECT doc_id, 'quality' AS code, quality AS truth FROM labels UNION ALL SELECT doc_id, 'toxic', 1 - toxic FROM labels) l USING (doc_id, code)""")


def _label_store(s: SparkSession, d: str) -> DataFrame:
    """What `label_upsert` gives, read back from a stored table in which two upserts rewrote the partitions they touch."""
    rows = _coded(s, d).withColumn("bucket", versioned.bucket(F.col("history_id"), 16))
    t = versioned.Table(s, store.scratch(s), "history_id long, domain string, code string, value int, label_version string, bucket int", ("label_version", "bucket"))
    t.append(rows)
    truth = rows.filter("label_version = 'truth'").withColumn("label_version", F.lit("rule"))
    t.upsert(truth.withColumn("at", F.lit(1)), labels.KEY, "at")
    again = truth.filter("code = 'toxic'").withColumn("at", F.explode(F.array(F.lit(1), F.lit(2))))
    t.upsert(again.withColumn("value", F.when(F.col("at") == 2, 1 - F.col("value")).otherwise(7)), labels.KEY, "at")
    return t.read().filter("label_version = 'rule'").drop("bucket")


_add("label_store", _label_store, ORACLES["label_upsert"])
_add("language_labels", lambda s, d: labels.label_language(read(s, d, "documents"), labels.language_profile(read(s, d, "documents"), "lang"), id_col="doc_id").withColumn("confidence", F.round("confidence", 6)),
     """WITH t AS (SELECT doc_id, lang, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents),
     tok AS (SELECT doc_id, lang, unnest(string_split(lower(t), ' ')) AS token FROM t),
     prof AS (SELECT lang, token, n / sum(n) OVER (PARTITION BY lang) AS weight FROM (SELECT lang, token, count(*) AS n FROM tok WHERE lang IS NOT NULL AND token <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) <= 40),
     score AS (SELECT tok.doc_id, prof.lang, sum(weight) AS score FROM tok JOIN prof USING (token) GROUP BY ALL),
     best AS (SELECT doc_id, lang, score / sum(score) OVER (PARTITION BY doc_id) AS confidence FROM score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
     SELECT doc_id, CASE WHEN length(t) < 10 OR coalesce(confidence, 0) < 0.6 THEN 'undetermined' WHEN b.lang IN ('de', 'en') THEN b.lang ELSE 'other' END AS code, round(coalesce(confidence, 0), 6) AS confidence FROM t LEFT JOIN best b USING (doc_id)""")
_add("label_unpivot", lambda s, d: labels.unpivot_coded(read(s, d, "labels").select(F.col("doc_id").alias("history_id"), F.when(F.col("doc_id") % 3 == 0, "Master_sample").otherwise("x").alias("group"), F.col("quality").alias("Good Quality"), F.col("toxic").alias("Is-Toxic!")), ["Good Quality", "Is-Toxic!"]),
     "SELECT doc_id AS history_id, 'v0' AS label_version, 'deductive' AS domain, code, value, CASE WHEN doc_id % 3 = 0 THEN 'consensus' ELSE 'single_coder' END AS provenance FROM (SELECT doc_id, 'good_quality' AS code, quality AS value FROM labels UNION ALL SELECT doc_id, 'is_toxic', toxic FROM labels)")
_add("candidate_codes", lambda s, d: labels.candidate_frequencies(labels.candidate_rows(read(s, d, "events").select(F.col("event_id").alias("history_id"), F.when(F.col("event_id") % 5 != 0, F.array(F.upper("event_type"), F.concat(F.lit("  "), "event_type"), F.lit("one two three four five six"))).alias("codes")), "r1"), "r1"),
     "SELECT event_type AS code, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1")


def _responses(s: SparkSession, d: str) -> DataFrame:
    """One coding table a batch of ten labelled documents; every seventh batch has a value that is no 0 or 1."""
    row = F.concat(F.lit("| "), "doc_id", F.lit(" | "), F.when((F.col("doc_id") % 70) == 3, "2").otherwise(F.col("quality").cast("string")), F.lit(" | "), "toxic", F.lit(" |"))
    b = read(s, d, "labels").withColumns({"batch": F.floor(F.col("doc_id") / 10), "row": row}).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("doc_id", "row"))).alias("r"))
    return b.select("batch", F.expr("transform(r, x -> x.doc_id)").alias("expected"), F.concat(F.lit("| message | Quality | Toxic |\n|---|---|---|\n"), F.array_join(F.expr("transform(r, x -> x.row)"), "\n")).alias("text"))


_add("parse_responses", lambda s, d: labels.parse_binary(_responses(s, d), ("Quality", "Toxic"))[0],
     "SELECT doc_id AS history_id, code, value FROM (SELECT doc_id, 'quality' AS code, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) WHERE doc_id // 10 NOT IN (SELECT doc_id // 10 FROM labels WHERE doc_id % 70 = 3)")
_add("parse_rejects", lambda s, d: labels.parse_binary(_responses(s, d), ("Quality", "Toxic"))[1], "SELECT DISTINCT doc_id // 10 AS batch, 'value' AS reason FROM labels WHERE doc_id % 70 = 3")
_NUMBERS = "SELECT * FROM VALUES (1, 'theory'), (2, 'software'), (3, 'method') AS l(number, code)"
_add("parse_numbers", lambda s, d: labels.parse_numbers(read(s, d, "events").select(F.col("event_id").alias("history_id"), F.when(F.col("event_id") % 4 == 0, "none").otherwise(F.concat(F.col("event_id") % 5, F.lit("; 3"))).alias("cell")), s.sql(_NUMBERS))[0],
     "SELECT event_id AS history_id, code FROM events, (VALUES (1, 'theory'), (2, 'software'), (3, 'method')) l(number, code) WHERE event_id % 4 <> 0 AND (number = 3 OR number = event_id % 5)")
_add("parse_number_rejects", lambda s, d: labels.parse_numbers(read(s, d, "events").select(F.col("event_id").alias("history_id"), F.when(F.col("event_id") % 4 == 0, " None ").otherwise(F.concat(F.col("event_id") % 5, F.lit("; "), F.when(F.col("event_id") % 9 == 0, F.lit("x7")).otherwise(F.lit("3")))).alias("cell")), s.sql(_NUMBERS))[1],
     "SELECT event_id AS history_id, unnest(list_filter([CAST(event_id % 5 AS VARCHAR), CASE WHEN event_id % 9 = 0 THEN 'x7' ELSE '3' END], lambda x: x NOT IN ('1', '2', '3'))) AS x FROM events WHERE event_id % 4 <> 0")
_add("candidate_pending", lambda s, d: labels.pending(read(s, d, "events").select(F.col("event_id").alias("history_id")), labels.candidate_rows(read(s, d, "events").filter("event_id % 3 = 0").select(F.col("event_id").alias("history_id"), F.array("event_type").alias("codes")), "r1").unionByName(labels.candidate_rows(read(s, d, "events").filter("event_id % 5 = 0").select(F.col("event_id").alias("history_id"), F.array().cast("array<string>").alias("codes")), "r2")), run_id="r2"),
     "SELECT event_id AS history_id FROM events WHERE event_id % 5 <> 0")
_add("explicit_labels", lambda s, d: labels.explicit_labels(read(s, d, "events").select(F.col("event_id").alias("history_id")), s.sql(_NUMBERS), read(s, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("history_id"), F.lit("software").alias("code"))),
     "SELECT event_id AS history_id, code, CAST(event_type = 'error' AND code = 'software' AS INT) AS value FROM events, (SELECT unnest(['theory', 'software', 'method']) AS code)")
_add("theme_faults", lambda s, d: labels.theme_faults(read(s, d, "nation").select(F.col("n_name").alias("code"), F.when(F.col("n_nationkey") > 0, F.col("n_name")).otherwise("").alias("description"))), "SELECT 'description' AS rule, count(*) AS n FROM nation WHERE n_nationkey = 0")


# Ingest. Customers are users, orders their history.
def _source(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    users = read(s, d, "customer").select(F.col("c_custkey").alias("student_id"), F.concat(F.lit(" User"), F.col("c_custkey")).alias("uid"))
    first = read(s, d, "orders").groupBy(F.col("o_custkey").alias("student_id")).agg(F.min("o_orderdate").alias("created_at"))
    history = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("started"), F.col("o_orderdate").alias("created_at"))
    return users.join(first, "student_id", "left"), history


def _ingested(s: SparkSession, d: str) -> DataFrame:
    """Two runs: the first finds the history up to the middle id, the second has the rest to add, above the watermark."""
    students, history = _source(s, d)
    middle = history.agg(F.max("id")).first()[0] // 2
    old = ingest.new_messages(history.filter(F.col("id") <= middle), students, 0, KEY)
    new = ingest.new_messages(history, students, ingest.watermark(old), KEY)
    return old.withColumn("run", F.lit(1)).unionByName(new.withColumn("run", F.lit(2)))


_add("ingest_messages", lambda s, d: _ingested(s, d).select("history_id", "session_started", "pseudonym", "created_at", "run"),
     "SELECT o_orderkey AS history_id, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS session_started, {hash} AS pseudonym, o_orderdate AS created_at, CASE WHEN o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders) THEN 1 ELSE 2 END AS run FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey > 0")
_IPAD, _OPAD = ("".join(f"\\x{b ^ p:02X}" for b in KEY.ljust(64, b"\0")) for p in (0x36, 0x5C))
_HASH = f"sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode('user' || c_custkey))))"
ORACLES["ingest_messages"] = ORACLES["ingest_messages"].format(hash=_HASH)
_add("pseudonyms", lambda s, d: read(s, d, "customer").select("c_custkey", text.hmac_sha256(text.normal_uid(F.concat(F.lit(" User"), F.col("c_custkey"))), KEY).alias("pseudonym")), f"SELECT c_custkey, {_HASH} AS pseudonym FROM customer")
_add("ingest_students", lambda s, d: ingest.with_new_students(ingest.new_students(_source(s, d)[0].filter("student_id % 2 = 0"), KEY), _source(s, d)[0], KEY).select("pseudonym", "registered_at"),
     f"SELECT {_HASH} AS pseudonym, min(o_orderdate) AS registered_at FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey")


def _roster_lines(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A line for each customer; every 700th comes again as the same user, and staff and master users with a term."""
    k = F.col("c_custkey")
    status = F.when(k % 9 == 0, "guest").when(k % 4 == 1, " master ").when(k % 4 == 2, "staff").otherwise("bachelor")
    term = F.when(k % 11 == 0, "2024X").when(k % 13 == 0, " 2024W ").otherwise("")
    return files.check_roster(read(s, d, "customer").select(k.alias("line"), F.concat(F.lit(" U"), k % 700).alias("uid"), status.alias("status"), term.alias("ma_start_semester"), F.when(k % 17 == 0, " ").otherwise("t").alias("source")), KEY)


_ROSTER = """WITH t AS (SELECT c_custkey AS line, c_custkey % 700 AS u, CASE WHEN c_custkey % 9 = 0 THEN 'guest' WHEN c_custkey % 4 = 1 THEN 'master' WHEN c_custkey % 4 = 2 THEN 'staff' ELSE 'bachelor' END AS status, CASE WHEN c_custkey % 11 = 0 THEN '2024X' WHEN c_custkey % 13 = 0 THEN '2024W' END AS term, c_custkey % 17 = 0 AS bare FROM customer)
, f AS (SELECT *, CASE WHEN status = 'guest' THEN 'status' WHEN term = '2024X' OR (term IS NOT NULL AND status <> 'bachelor') THEN 'ma_start_semester' WHEN bare THEN 'source' WHEN row_number() OVER (PARTITION BY u ORDER BY line) > 1 THEN 'duplicate' END AS fault FROM t)"""
_add("roster_check", lambda s, d: _roster_lines(s, d)[1], _ROSTER + " SELECT line, fault FROM f WHERE fault IS NOT NULL")
_add("roster_rows", lambda s, d: _roster_lines(s, d)[0].groupBy("status", "ma_start_semester").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pseudonym").alias("users")), _ROSTER + " SELECT status, term AS ma_start_semester, count(*) AS n, count(DISTINCT u) AS users FROM f WHERE fault IS NULL GROUP BY ALL")


def _erased(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d, LONG)
    return ingest.erase({"messages": c.messages, "students": c.students, "roster": c.roster, "labels": c.labels}, "7")[1]


_add("erase_user", _erased, view_sql(LONG) + """SELECT 'messages' AS "table", count(*) AS erased FROM messages WHERE pseudonym = '7' UNION ALL SELECT 'students', count(*) FROM students WHERE pseudonym = '7' UNION ALL SELECT 'roster', count(*) FROM roster WHERE pseudonym = '7'
    UNION ALL SELECT 'labels', (SELECT count(*) FROM pos JOIN messages USING (history_id) WHERE pseudonym = '7') * 2 + (SELECT count(*) FILTER (history_id % 37 <> 0) + count(*) FILTER (history_id % 3 = 0) FROM messages WHERE pseudonym = '7')""")


def _erased_stored(s: SparkSession, d: str) -> DataFrame:
    """(table, erased, kept): a user taken out of stored tables, and what is read back."""
    c, n = corpus(s, d, LONG), 16
    place = lambda df, key: df.withColumn("bucket", versioned.bucket(F.col(key), n))
    made = {
        "messages": (c.messages.withColumn("quarter", F.concat(F.year("created_at"), F.quarter("created_at"))), ("quarter",)),
        "students": (place(c.students, "pseudonym"), ("bucket",)), "roster": (place(c.roster, "pseudonym"), ("bucket",)), "labels": (place(c.labels, "history_id"), ("label_version", "bucket")),
    }
    top, tables = store.scratch(s), {}
    for name, (rows, by) in made.items():
        tables[name] = versioned.Table(s, f"{top}/{name}", ", ".join(f"{c} {k}" for c, k in rows.dtypes if c not in by) + "".join(f", {c} {dict(rows.dtypes)[c]}" for c in by), by)
        tables[name].append(rows)
    erased = ingest.erase_stored(tables["messages"], {k: tables[k] for k in ("students", "roster")}, {"labels": tables["labels"]}, "7", n)
    kept = [t.read().agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("table"), F.lit(erased[name]).cast("long").alias("erased"), "kept") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, kept)


_add("erase_stored", _erased_stored, view_sql(LONG) + """, l AS (SELECT history_id, pseudonym, 2 + CAST(history_id % 37 <> 0 AS INT) + CAST(history_id % 3 = 0 AS INT) + 2 AS n FROM messages)
SELECT 'messages' AS "table", count(*) FILTER (pseudonym = '7') AS erased, count(*) FILTER (pseudonym <> '7') AS kept FROM messages UNION ALL SELECT 'students', count(*) FILTER (pseudonym = '7'), count(*) FILTER (pseudonym <> '7') FROM students
UNION ALL SELECT 'roster', count(*) FILTER (pseudonym = '7'), count(*) FILTER (pseudonym <> '7') FROM roster UNION ALL SELECT 'labels', CAST(coalesce(sum(n) FILTER (pseudonym = '7'), 0) AS BIGINT), CAST(sum(n) FILTER (pseudonym <> '7') AS BIGINT) FROM l""")
_add("users_without_roster", lambda s, d: files.without_roster(corpus(s, d, LONG).students, corpus(s, d, LONG).roster).select("pseudonym"), view_sql(LONG) + "SELECT pseudonym FROM students ANTI JOIN roster USING (pseudonym)")
_add("session_join_check", lambda s, d: files.join_check(corpus(s, d, SHORT).messages, corpus(s, d, SHORT).messages.select("history_id", F.when(F.col("history_id") % 50 == 0, F.col("session_started") + 1).otherwise(F.col("session_started")).alias("started"))).select("history_id"), "SELECT event_id AS history_id FROM events WHERE event_id % 50 = 0")
_add("conversation_depth", lambda s, d: floored(count_cells(read(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")), ["turns"], user="conv_id"), 3), "SELECT turns, CASE WHEN value >= 3 THEN 'ok' ELSE 'suppressed' END AS status, CASE WHEN value >= 3 THEN value END AS value FROM (SELECT turns, count(*) AS value FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) GROUP BY 1)")
_add("snapshot_lines", _on(LONG, lambda v: files.render(v.win.select("window_id", "kind", "first_week", "last_week"), ["window_id"])), view_sql(LONG) + """SELECT '{"first_week":"' || first_week || '","kind":"' || kind || '","last_week":"' || last_week || '","window_id":"' || window_id || '"}' AS value FROM win""")
_add("week_calendar", lambda s, d: read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().select("d", cal.week_id(F.col("d")).alias("week"), cal.week_monday(cal.week_id(F.col("d"))).alias("first"), cal.week_sunday(cal.week_id(F.col("d"))).alias("last")),
     "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%G-W%V') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS first, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS last FROM orders")
