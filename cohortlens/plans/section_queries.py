"""Registered queries of the calendar, facts, sections and ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, ratios, sections
from .corpora import LONG, SHORT, corpus_view, floor_sql, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Q = Callable[[facts.View], DataFrame]


def _add(name: str, kind: str, build: Q, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(corpus_view(spark, sf_dir, kind))
    if sql:
        ORACLES[name] = view_sql(kind) + sql


def _cells(keys: list[str], scaffold: str, cells: str, floor: int) -> str:
    return f"SELECT {', '.join(keys)}, {floor_sql(floor)} FROM ({scaffold}) s LEFT JOIN ({cells}) c USING ({', '.join(keys)})"


def _counts(keys: dict[str, str], source: str, value: str = "count(*)") -> str:
    return f"SELECT {', '.join(f'{e} AS {k}' for k, e in keys.items())}, {value} AS value, count(DISTINCT pseudonym) AS n_users FROM {source} GROUP BY ALL"


_USERS = "count(DISTINCT pseudonym)"
_W = " JOIN win_week USING (monday)"

_add("calendar_windows", LONG, lambda v: v.win, " SELECT window_id, kind, parent_id, first_week, last_week, first_monday, n_weeks, single_week, in_progress FROM win")
_add("calendar_window_weeks", SHORT, lambda v: v.win_week.join(v.win.select("window_id", "kind"), "window_id").select("window_id", "week", "semester_week"), " SELECT window_id, week, semester_week FROM win_week")
_add("enriched_messages", SHORT, lambda v: facts.spoken(v.msg, v).select("history_id", "pseudonym", "day", "week", "dow", "hour", "lang", "level"), " SELECT history_id, pseudonym, day, week, dow, hour, lang, level FROM msg")
_add("first_seen", LONG, lambda v: v.first_seen, " SELECT pseudonym, first_seen FROM seen")
_add("sessions", SHORT, lambda v: v.sess.select("pseudonym", "session_started", "week", "level", "n_messages", "minutes"), " SELECT pseudonym, session_started, week, level, n_messages, minutes FROM sess")

_LW = {"level": "lv", "week": "week"}
_add(
    "weekly_activity", SHORT, lambda v: sections.weekly_activity(v, 40),
    _cells(["level", "week", "measure"], "SELECT level, week, unnest(['messages', 'sessions', 'active_users']) AS measure FROM axis, levels",
           f"SELECT *, 'messages' AS measure FROM ({_counts(_LW, 'lmsg')}) UNION ALL SELECT *, 'sessions' FROM ({_counts(_LW, 'lsess')}) UNION ALL SELECT *, 'active_users' FROM ({_counts(_LW, 'lmsg', _USERS)})", 40),
)
_add("weekly_registrations", LONG, lambda v: sections.weekly_registrations(v, 3), _cells(["week"], "SELECT week FROM axis", _counts({"week": "week"}, "reg"), 3))
_add("weekly_language", SHORT, lambda v: sections.weekly_language(v, 25), _cells(["level", "lang", "week"], "SELECT level, lang, week FROM axis, levels, langs", _counts({"level": "lv", "lang": "lang", "week": "week"}, "lmsg"), 25))

_WL = {"window_id": "window_id", "level": "lv"}
_MEASURES = ["messages", "sessions", "active_users", "new_registrations", "new_registrations_active"]
USAGE = f"""
, cells AS (
    SELECT *, 'messages' AS measure FROM ({_counts(_WL, 'lmsg' + _W)}) UNION ALL SELECT *, 'sessions' FROM ({_counts(_WL, 'lsess' + _W)})
    UNION ALL SELECT *, 'active_users' FROM ({_counts(_WL, 'lmsg' + _W, _USERS)}) UNION ALL SELECT *, 'new_registrations' FROM ({_counts(_WL, 'lreg' + _W)})
    UNION ALL SELECT *, 'new_registrations_active' FROM ({_counts(_WL, f"(SELECT * FROM lreg{_W} SEMI JOIN (SELECT DISTINCT window_id, pseudonym FROM msg{_W}) a USING (window_id, pseudonym))")})),
floored AS ({_cells(["window_id", "level", "measure"], f"SELECT window_id, level, unnest({_MEASURES}) AS measure FROM win, levels", "SELECT * FROM cells", 4)}),
usage AS (
    SELECT window_id, level, measure, CASE WHEN hide THEN 'suppressed' ELSE status END AS status, CASE WHEN NOT hide THEN value END AS value
    FROM (SELECT *, level <> 'all' AND coalesce(bool_or(status = 'suppressed' AND level <> 'all' AND measure <> 'active_users') OVER (PARTITION BY window_id, measure), false) AS hide FROM floored))
"""
_add("window_usage", LONG, lambda v: sections.window_usage(v, 4), USAGE + "SELECT * FROM usage")

_add(
    "retention", LONG, lambda v: sections.retention(v, 5),
    f"""
, c AS (SELECT window_id, lv AS level, count(DISTINCT pseudonym) FILTER (first_seen >= first_monday) AS new, count(DISTINCT pseudonym) FILTER (first_seen < first_monday) AS returning_
        FROM lmsg{_W} JOIN seen USING (pseudonym) JOIN (SELECT window_id, first_monday FROM win) USING (window_id) GROUP BY ALL)
, f AS (SELECT *, (new BETWEEN 1 AND 4) OR (returning_ BETWEEN 1 AND 4) AS hide FROM c)
SELECT window_id, level, kind, CASE WHEN hide THEN 'suppressed' ELSE 'ok' END AS status, CASE WHEN NOT hide THEN CASE kind WHEN 'new' THEN new ELSE returning_ END END AS value
FROM f, (SELECT unnest(['new', 'returning']) AS kind)""",
)

_PROFILE = f"""
, days AS (SELECT window_id, lv AS level, pseudonym, day, min(local) AS lo, max(local) AS hi FROM lmsg{_W} GROUP BY ALL)
, gaps AS (SELECT *, day - lag(day) OVER (PARTITION BY window_id, level, pseudonym ORDER BY day) AS gap FROM days)
, prof AS (SELECT window_id, level, pseudonym, max(day) - min(day) + 1 AS span, epoch_us(max(hi)) - epoch_us(min(lo)) <= 86400000000 AS within_day, coalesce(max(gap), 0) AS gap FROM gaps GROUP BY ALL)
, classed AS (SELECT *, CASE WHEN span < 3 AND within_day THEN 'one_time' WHEN gap < 30 AND span >= 30 THEN 'monthly' ELSE 'sporadic' END AS class, gap < 14 AND span > 30 AS frequent FROM prof)
"""
for _kind, _name in ((LONG, "user_classes"), (SHORT, "user_classes_short")):
    _add(
        _name, _kind, lambda v: sections.user_classes(v, 3),
        _PROFILE + f"""SELECT window_id, level, class, {floor_sql(3)} FROM (
            SELECT window_id, level, k AS class, count(*) FILTER (class = k OR (k = 'frequent' AND frequent)) AS value, value AS n_users
            FROM classed, (SELECT unnest(['one_time', 'monthly', 'sporadic', 'frequent']) AS k) GROUP BY ALL)""",
    )

_add("hour_heatmap", SHORT, lambda v: sections.hour_heatmap(v, 40), _cells(["window_id", "dow", "hour"], "SELECT window_id, dow, unnest(generate_series(0, 23)) AS hour FROM (SELECT window_id, unnest(generate_series(1, 7)) AS dow FROM win)", _counts({"window_id": "window_id", "dow": "dow", "hour": "hour"}, f"msg{_W}"), 40))

_PART = "CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END"
_SPAN = "CASE WHEN dow >= 6 THEN 'weekend' ELSE 'weekday' END"
_DAYPARTS = _cells(
    ["window_id", "level", "shape", "dow", "part"],
    "SELECT window_id, level, shape, dow, part FROM win, levels, (SELECT 'grid' AS shape, d AS dow, p AS part FROM (SELECT unnest(generate_series(1, 7)) AS d), (SELECT unnest(['night', 'morning', 'afternoon', 'evening']) AS p) UNION ALL SELECT 'daypart', 0, unnest(['night', 'morning', 'afternoon', 'evening']) UNION ALL SELECT 'span', 0, unnest(['weekday', 'weekend']))",
    " UNION ALL ".join(_counts({"window_id": "window_id", "level": "lv", "shape": f"'{s}'", "dow": d, "part": p}, f"lmsg{_W}") for s, d, p in (("grid", "dow", _PART), ("daypart", "0", _PART), ("span", "0", _SPAN))), 30,
)
_add("dayparts", SHORT, lambda v: sections.dayparts(v, 30), _DAYPARTS)
_add("language_totals", LONG, lambda v: sections.language_totals(v, 10), _cells(["window_id", "level", "lang"], "SELECT window_id, level, lang FROM win, levels, langs", _counts(_WL | {"lang": "lang"}, f"lmsg{_W}"), 10))
_TOPICS = f"""SELECT window_id, level, domain, code, status, value, coalesce(n_total, 0) AS n_total FROM (
    {_cells(["window_id", "level", "domain", "code"], "SELECT window_id, level, domain, code FROM win, levels, (SELECT DISTINCT domain, code FROM pos)", _counts(_WL | {"domain": "domain", "code": "code"}, f"lmsg{_W} JOIN pos USING (history_id)"), 6)})
    LEFT JOIN (SELECT window_id, lv AS level, count(*) AS n_total FROM lmsg{_W} GROUP BY ALL) USING (window_id, level)"""
_add("topics", LONG, lambda v: sections.topics(v, 6), _TOPICS)


def _bins(bins) -> str:
    return "(VALUES " + ", ".join(f"({i}, {lo}, {'NULL' if hi is None else hi})" for i, (lo, hi) in enumerate(bins)) + ") b(bin, lo, hi)"


def _hist(rows: str, value: str, bins, floor: int) -> str:
    return f""", r AS ({rows})
    SELECT window_id, level, bin, lo, hi, {floor_sql(floor)} FROM (
        SELECT k.window_id, k.level, bin, lo, hi, count(r.pseudonym) AS value, count(DISTINCT r.pseudonym) AS n_users
        FROM (SELECT DISTINCT window_id, level FROM r) k CROSS JOIN {_bins(bins)} LEFT JOIN r ON r.window_id = k.window_id AND r.level = k.level AND floor(r.{value}) >= lo AND (hi IS NULL OR floor(r.{value}) <= hi) GROUP BY ALL)"""


def _summary(rows: str, value: str, floor: int, mean: bool = True) -> str:
    q = lambda p: f"(quantile_disc({value}, {p}) + quantile_disc(-{value}, {1 - p}) * -1) / 2"
    ok = f"n_users = 0 OR n_users >= {floor}"
    show = lambda c: f"CASE WHEN {ok} THEN round({c}, 1) END AS {c}"
    hide = lambda c: f"CAST(NULL AS DOUBLE) AS {c}"
    return f""", r AS (SELECT * REPLACE (CAST({value} AS DOUBLE) AS {value}) FROM ({rows}))
    SELECT window_id, level, CASE WHEN {ok} THEN 'ok' ELSE 'suppressed' END AS status, CASE WHEN {ok} THEN n_users END AS n_users, {show("median")}, {show("p25")}, {show("p75")}, {(show if mean else hide)("mean")}, {(show if mean else hide)("sd")}
    FROM (SELECT window_id, level, count(DISTINCT pseudonym) AS n_users, {q(0.5)} AS median, {q(0.25)} AS p25, {q(0.75)} AS p75, avg({value}) AS mean, stddev_samp({value}) AS sd FROM r GROUP BY ALL)"""


_KEYS = ["window_id", "level"]
_SROWS = f"SELECT window_id, lv AS level, pseudonym, n_messages, minutes FROM lsess{_W}"
_UROWS = f"""SELECT m.*, sessions FROM (SELECT window_id, lv AS level, pseudonym, count(*) AS messages, count(DISTINCT monday) AS weeks FROM lmsg{_W} GROUP BY ALL) m
    LEFT JOIN (SELECT window_id, lv AS level, pseudonym, count(*) AS sessions FROM lsess{_W} GROUP BY ALL) USING (window_id, level, pseudonym)"""
_add("histogram_session_messages", SHORT, lambda v: sections.histogram(sections.session_rows(v), _KEYS, "n_messages", sections.SESSION_BINS, 20), _hist(_SROWS, "n_messages", sections.SESSION_BINS, 20))
_add("histogram_session_minutes", SHORT, lambda v: sections.histogram(sections.session_rows(v), _KEYS, "minutes", sections.MINUTE_BINS, 20), _hist(_SROWS, "minutes", sections.MINUTE_BINS, 20))
_add("summary_session_minutes", SHORT, lambda v: sections.summary(sections.session_rows(v), _KEYS, "minutes", 20, with_mean=False), _summary(_SROWS, "minutes", 20, False))
_add("histogram_user_messages", LONG, lambda v: sections.histogram(sections.per_user_rows(v), _KEYS, "messages", sections.MESSAGE_BINS, 5), _hist(_UROWS, "messages", sections.MESSAGE_BINS, 5))
_add("histogram_user_weeks", LONG, lambda v: sections.histogram(sections.per_user_rows(v), _KEYS, "weeks", sections.SESSION_BINS, 5), _hist(_UROWS, "weeks", sections.SESSION_BINS, 5))
_add("histogram_user_sessions", SHORT, lambda v: sections.histogram(sections.per_user_rows(v).filter("sessions is not null"), _KEYS, "sessions", sections.SESSION_BINS, 5), _hist(f"SELECT * FROM ({_UROWS}) WHERE sessions IS NOT NULL", "sessions", sections.SESSION_BINS, 5))
_add("summary_user_messages", LONG, lambda v: sections.summary(sections.per_user_rows(v), _KEYS, "messages", 5), _summary(_UROWS, "messages", 5))

_PROF = _cells(
    ["window_id", "semester_week", "measure"], "SELECT window_id, semester_week, unnest(['messages', 'active_users']) AS measure FROM win_week WHERE kind = 'semester'",
    f"SELECT *, 'messages' AS measure FROM ({_counts({'window_id': 'window_id', 'semester_week': 'semester_week'}, f'msg{_W}')}) UNION ALL SELECT *, 'active_users' FROM ({_counts({'window_id': 'window_id', 'semester_week': 'semester_week'}, f'msg{_W}', _USERS)})", 3,
)
_add("semester_profile", LONG, lambda v: sections.semester_profile(v, 3), _PROF)
_TERMS = [f"{y}{t}" for y in range(1995, 2001) for t in "SW"]
_add("semester_overlay", LONG, lambda v: sections.semester_overlay(sections.semester_profile(v, 3), _TERMS),
     ", p AS (" + _PROF + ") SELECT semester_week, " + ", ".join(f"max(value) FILTER (window_id = '{t}') AS \"{t}\"" for t in _TERMS) + " FROM p WHERE measure = 'messages' GROUP BY 1")

_add("ratio_level_composition", LONG, lambda v: ratios.level_composition(sections.window_usage(v, 4)),
     USAGE + "SELECT window_id, level, measure, status, value, CASE WHEN NOT bool_or(status = 'suppressed') OVER w AND sum(value) OVER w > 0 THEN value * 100.0 / sum(value) OVER w END AS share FROM usage WHERE level <> 'all' WINDOW w AS (PARTITION BY window_id, measure)")
_add("ratio_language_share", LONG, lambda v: ratios.share_of_total(sections.language_totals(v, 10), sections.window_usage(v, 4).filter("measure = 'messages'"), ["window_id", "level"]),
     USAGE + f", l AS ({_cells(['window_id', 'level', 'lang'], 'SELECT window_id, level, lang FROM win, levels, langs', _counts(_WL | {'lang': 'lang'}, f'lmsg{_W}'), 10)}) SELECT l.*, CASE WHEN t.value > 0 THEN l.value * 100.0 / t.value END AS share FROM l LEFT JOIN (SELECT window_id, level, value FROM usage WHERE measure = 'messages' AND status = 'ok') t USING (window_id, level)")
_add("ratio_daypart_share", SHORT, lambda v: ratios.share_of_total(sections.dayparts(v, 30).filter("shape <> 'grid'"), sections.window_usage(v, 4).filter("measure = 'messages'"), ["window_id", "level"]),
     USAGE + f", d AS ({_DAYPARTS}) SELECT d.*, CASE WHEN t.value > 0 THEN d.value * 100.0 / t.value END AS share FROM d LEFT JOIN (SELECT window_id, level, value FROM usage WHERE measure = 'messages' AND status = 'ok') t USING (window_id, level) WHERE shape <> 'grid'")
_add("ratio_topic_share", LONG, lambda v: sections.topics(v, 6).withColumn("share", ratios.percent(F.col("value"), F.col("n_total"))), f"SELECT *, CASE WHEN n_total > 0 THEN value * 100.0 / n_total END AS share FROM ({_TOPICS})")
_add("ratio_tried_once", LONG, lambda v: ratios.tried_once(sections.histogram(sections.per_user_rows(v), _KEYS, "weeks", sections.SESSION_BINS, 5)),
     _hist(_UROWS, "weeks", sections.SESSION_BINS, 5).replace("SELECT window_id, level, bin", ", h AS (SELECT window_id, level, bin", 1) + ") SELECT window_id, level, CASE WHEN NOT bool_or(status = 'suppressed') AND sum(value) > 0 THEN max(value) FILTER (bin = 0) * 100.0 / sum(value) END AS share FROM h GROUP BY ALL")
_add("ranked_topics", LONG, lambda v: ratios.ranked_codes(sections.topics(v, 6), 3).select("window_id", "level", "domain", "code", "status", "value", "n_total", "rank"),
     f"SELECT *, row_number() OVER (PARTITION BY window_id, level, domain ORDER BY CASE WHEN status = 'ok' AND value > 0 THEN 0 WHEN status = 'suppressed' THEN 1 ELSE 2 END, value DESC NULLS LAST, code) AS rank FROM ({_TOPICS}) QUALIFY rank <= 3")
_add("available_levels", LONG, lambda v: ratios.available_levels(sections.window_usage(v, 4)), " SELECT level, list_position(['bachelor', 'master', 'staff', 'unknown'], level) AS position FROM levels WHERE level <> 'all'")
_add("level_slice", LONG, lambda v: ratios.slice_by_level(sections.window_usage(v, 4), "master"), USAGE + "SELECT *, true AS scoped FROM usage WHERE level = 'master'")
_add("series_slice", LONG, lambda v: ratios.slice_to_window(sections.weekly_registrations(v, 3), v.win),
     f", s AS ({_cells(['week'], 'SELECT week FROM axis', _counts({'week': 'week'}, 'reg'), 3)}) SELECT s.week, status, value, window_id FROM s JOIN win ON s.week BETWEEN first_week AND last_week")


def _enrolled(v: facts.View) -> DataFrame:
    """Figures that follow from the roster's rule: 200 + 10 a term's year modulo 7."""
    terms = v.win.filter("kind = 'semester'").select("window_id")
    known = terms.unionByName(v.win.sparkSession.sql("SELECT '1990S' AS window_id UNION ALL SELECT 'all_time'"))  # these two have no business there
    return known.select("window_id", F.explode(F.array(F.lit("bachelor"), F.lit("master"))).alias("level"), (F.try_to_number(F.substring("window_id", 1, 4), F.lit("9999")).cast("int") % 7 * 10 + 200).alias("enrolled"))


_add("ratio_reach", LONG, lambda v: ratios.reach(sections.window_usage(v, 4), v.win, _enrolled(v)),
     USAGE + "SELECT u.window_id, level, round(value * 100.0 / (CAST(substr(w.window_id, 1, 4) AS INT) % 7 * 10 + 200), 1) AS reach FROM usage u JOIN win w USING (window_id) WHERE kind <> 'all_time' AND measure = 'active_users' AND level IN ('bachelor', 'master')")
