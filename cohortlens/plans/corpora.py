"""How the test tables stand in for a corpus of messages, in Spark and as DuckDB SQL.

`events` is a month with hours; `orders` is seven years of days with many terms.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import Corpus, View, view
from ..sources import grains

SHORT, LONG = "short", "long"
EXTRACTED = {SHORT: dt.date(2024, 2, 5), LONG: dt.date(2001, 8, 6)}
AXIS_START = {SHORT: None, LONG: dt.date(1995, 3, 1)}
#: Users whose number modulo 20 is 10, or 11 and 18, become master students with this term; 18 is staff before.
TRANSITIONS = {SHORT: ("2024S", "2023W"), LONG: ("1998S", "1996W")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _roster(users: DataFrame, kind: str) -> DataFrame:
    m = F.col("pseudonym").cast("long") % 20
    first, second = TRANSITIONS[kind]
    status = F.when(m < 12, "bachelor").when(m < 17, "master").otherwise("staff")
    return users.filter(m < 19).withColumns({"status": status, "ma_start_semester": F.when(m == 10, first).when(m.isin(11, 18), second)})


def _language(history_id: Column) -> Column:
    d = history_id % 10
    return F.when(history_id % 37 == 0, None).when(d < 6, "de").when(d < 9, "en").otherwise("other")


def _labels(messages: DataFrame, domains: dict[str, str]) -> DataFrame:
    """Languages and codes have versions of their own; each version also has rows that the other one's readers must not see."""
    row = lambda version, domain, code: F.struct(F.lit(version).alias("label_version"), F.lit(domain).alias("domain"), code.alias("code"))
    pairs = [row("language", "language", _language(F.col("history_id"))), row("codes", "language", F.when(F.col("history_id") % 3 == 0, "other"))]
    pairs += [row("codes", d, F.col(c)) for d, c in domains.items()] + [row("language", d, F.lit("old")) for d in domains]
    rows = messages.select("history_id", F.explode(F.array(*pairs)).alias("x")).select("history_id", "x.*").filter("code is not null")
    return rows.withColumn("value", F.lit(1))


def corpus(spark: SparkSession, sf_dir: str, kind: str) -> Corpus:
    if kind == SHORT:
        e = read(spark, sf_dir, "events")
        m = e.select(F.col("event_id").alias("history_id"), F.col("user_id").cast("string").alias("pseudonym"), F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("session_started"), F.col("ts").alias("created_at"), F.col("event_type").alias("code"))
        students = m.filter("code = 'signup'").groupBy("pseudonym").agg(F.min("created_at").alias("registered_at"))
        labels = _labels(m, {"activity": "code"})
    else:
        o = read(spark, sf_dir, "orders")
        m = o.select(F.col("o_orderkey").alias("history_id"), F.col("o_custkey").cast("string").alias("pseudonym"), F.unix_millis(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp"))).alias("session_started"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("state"))
        students = m.groupBy("pseudonym").agg(F.min("created_at").alias("registered_at"))
        labels = _labels(m, {"method_theme": "code", "deductive": "state"})
    users = m.select("pseudonym").distinct()
    return Corpus(m.select("history_id", "pseudonym", "session_started", "created_at"), students, _roster(users, kind), labels)


def options(kind: str) -> dict:
    return {"extracted": EXTRACTED[kind], "axis_start": AXIS_START[kind], "label_version": "codes", "language_version": "language"}


def corpus_view(spark: SparkSession, sf_dir: str, kind: str) -> View:
    return view(corpus(spark, sf_dir, kind), **options(kind))


def stored_view(spark: SparkSession, sf_dir: str, kind: str) -> View:
    """The same over stored grains, for what reads many sections."""
    return grains.stored(corpus(spark, sf_dir, kind), **options(kind))


_SHORT_SQL = """
messages AS (SELECT event_id AS history_id, CAST(user_id AS VARCHAR) AS pseudonym, epoch_ms(date_trunc('day', ts)) AS session_started, ts AS created_at FROM events),
students AS (SELECT CAST(user_id AS VARCHAR) AS pseudonym, min(ts) AS registered_at FROM events WHERE event_type = 'signup' GROUP BY 1),
pos AS (SELECT event_id AS history_id, 'activity' AS domain, event_type AS code FROM events),
"""
_LONG_SQL = """
messages AS (SELECT o_orderkey AS history_id, CAST(o_custkey AS VARCHAR) AS pseudonym, epoch_ms(date_trunc('quarter', CAST(o_orderdate AS TIMESTAMP))) AS session_started, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders),
students AS (SELECT CAST(o_custkey AS VARCHAR) AS pseudonym, CAST(min(o_orderdate) AS TIMESTAMP) AS registered_at FROM orders GROUP BY 1),
pos AS (SELECT o_orderkey AS history_id, 'method_theme' AS domain, o_orderpriority AS code FROM orders UNION ALL SELECT o_orderkey, 'deductive', o_orderstatus FROM orders),
"""


def _level_sql(day: str) -> str:
    return f"CASE WHEN r.ma IS NOT NULL THEN CASE WHEN {day} >= make_date(CAST(substr(r.ma, 1, 4) AS INT), CASE WHEN substr(r.ma, 5) = 'S' THEN 3 ELSE 10 END, 1) THEN 'master' ELSE r.status END ELSE coalesce(r.status, 'unknown') END"


def view_sql(kind: str) -> str:
    """WITH clause that defines msg, sess, reg, seen, pos, axis, win_week and win; lmsg, lsess and lreg have each row
    once for `all` and once for its level (lv)."""
    first, second = TRANSITIONS[kind]
    start = AXIS_START[kind]
    inside = "monday <= DATE '{}'{}".format(EXTRACTED[kind] - dt.timedelta(days=EXTRACTED[kind].weekday() + 7), f" AND day >= DATE '{start}'" if start else "")
    session = "CAST((epoch_ms(session_started) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna' AS DATE)"
    local = "({} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna'"
    return f"""WITH {_SHORT_SQL if kind == SHORT else _LONG_SQL}
roster AS (
    SELECT pseudonym, CASE WHEN m < 12 THEN 'bachelor' WHEN m < 17 THEN 'master' ELSE 'staff' END AS status, CASE WHEN m = 10 THEN '{first}' WHEN m IN (11, 18) THEN '{second}' END AS ma
    FROM (SELECT DISTINCT pseudonym, CAST(pseudonym AS BIGINT) % 20 AS m FROM messages) WHERE m < 19),
raw AS (
    SELECT *, CAST(local AS DATE) AS day, CAST(date_trunc('week', local) AS DATE) AS monday, strftime(local, '%G-W%V') AS week, isodow(local) AS dow, hour(local) AS hour
    FROM (SELECT *, {local.format("created_at")} AS local FROM messages)),
seen AS (SELECT pseudonym, min(day) AS first_seen FROM raw GROUP BY 1),
msg AS (
    SELECT raw.*, CASE WHEN history_id % 37 = 0 THEN 'undetermined' WHEN history_id % 10 < 6 THEN 'de' WHEN history_id % 10 < 9 THEN 'en' ELSE 'other' END AS lang, {_level_sql(session)} AS level
    FROM raw LEFT JOIN roster r USING (pseudonym) WHERE {inside}),
sess AS (
    SELECT pseudonym, session_started, first(monday ORDER BY local, history_id) AS monday, first(week ORDER BY local, history_id) AS week, first(level ORDER BY local, history_id) AS level,
           count(*) AS n_messages, (epoch_us(max(local)) - epoch_us(min(local))) / 60e6 AS minutes
    FROM msg GROUP BY 1, 2),
reg AS (
    SELECT x.*, {_level_sql("day")} AS level
    FROM (SELECT pseudonym, CAST(l AS DATE) AS day, CAST(date_trunc('week', l) AS DATE) AS monday, strftime(l, '%G-W%V') AS week FROM (SELECT pseudonym, {local.format("registered_at")} AS l FROM students WHERE registered_at IS NOT NULL)) x
    LEFT JOIN roster r USING (pseudonym) WHERE {inside}),
axis AS (
    SELECT monday, strftime(monday, '%G-W%V') AS week,
           CASE WHEN month(t) BETWEEN 3 AND 6 THEN year(t) || 'S' WHEN month(t) >= 10 THEN year(t) || 'W' WHEN month(t) = 1 THEN (year(t) - 1) || 'W' END AS term
    FROM (SELECT CAST(m AS DATE) AS monday, CAST(m AS DATE) + 3 AS t FROM (SELECT unnest(generate_series(CAST(min(monday) AS TIMESTAMP), TIMESTAMP '{EXTRACTED[kind] - dt.timedelta(days=EXTRACTED[kind].weekday() + 7)}', INTERVAL 7 DAY)) AS m FROM msg))),
full_terms AS (
    SELECT term, CAST(m AS DATE) AS monday, row_number() OVER (PARTITION BY term ORDER BY m) AS semester_week
    FROM (SELECT term, s, e, unnest(generate_series(date_trunc('week', s), e, INTERVAL 7 DAY)) AS m
          FROM (SELECT DISTINCT term, make_date(CAST(substr(term, 1, 4) AS INT), CASE WHEN substr(term, 5) = 'S' THEN 3 ELSE 10 END, 1) AS s,
                       CASE WHEN substr(term, 5) = 'S' THEN make_date(CAST(substr(term, 1, 4) AS INT), 6, 30) ELSE make_date(CAST(substr(term, 1, 4) AS INT) + 1, 1, 31) END AS e FROM axis WHERE term IS NOT NULL))
    WHERE CAST(m AS DATE) + 3 BETWEEN s AND e),
covered AS (SELECT f.*, a.week, row_number() OVER (PARTITION BY f.term ORDER BY f.monday DESC) AS back, count(*) OVER (PARTITION BY f.term) AS n FROM full_terms f JOIN axis a USING (monday)),
latest AS (SELECT term FROM covered ORDER BY monday DESC LIMIT 1),
win_week AS (
    SELECT 'all_time' AS window_id, 'all_time' AS kind, CAST(NULL AS VARCHAR) AS parent_id, monday, week, NULL AS semester_week FROM axis
    UNION ALL SELECT term, 'semester', NULL, monday, week, semester_week FROM covered
    UNION ALL SELECT term || '.last4', 'semester_slice', term, monday, week, semester_week FROM covered JOIN latest USING (term) WHERE back <= 4 AND n >= 2
    UNION ALL SELECT term || '.last1', 'semester_slice', term, monday, week, semester_week FROM covered JOIN latest USING (term) WHERE back = 1),
win AS (
    SELECT w.*, first_week = last_week AS single_week, coalesce(last_week < term_last, false) AS in_progress
    FROM (SELECT window_id, kind, parent_id, min(week) AS first_week, max(week) AS last_week, min(monday) AS first_monday, count(*) AS n_weeks FROM win_week GROUP BY 1, 2, 3) w
    LEFT JOIN (SELECT term AS window_id, strftime(max(monday), '%G-W%V') AS term_last FROM full_terms GROUP BY 1) USING (window_id)),
lmsg AS (SELECT *, unnest(['all', level]) AS lv FROM msg),
lsess AS (SELECT *, unnest(['all', level]) AS lv FROM sess),
lreg AS (SELECT *, unnest(['all', level]) AS lv FROM reg),
levels AS (SELECT DISTINCT lv AS level FROM lmsg),
langs AS (SELECT unnest(['de', 'en', 'other', 'undetermined']) AS lang)
"""


def floor_sql(floor: int) -> str:
    ok = f"coalesce(n_users, 0) = 0 OR n_users >= {floor}"
    return f"CASE WHEN {ok} THEN 'ok' ELSE 'suppressed' END AS status, CASE WHEN {ok} THEN CAST(coalesce(value, 0) AS BIGINT) END AS value"
