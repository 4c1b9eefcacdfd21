import datetime as dt
import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import calendar as cal
from cohortlens.functions import cells, stats, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_two_proportion_z(spark):
    z = stats.two_proportion_z(*map(F.lit, (45.0, 100.0, 30.0, 100.0)))
    r = one(spark, z.alias("z"), stats.two_sided_p(z).alias("p"))
    assert r["z"] == pytest.approx(2.1909, abs=1e-4) and r["p"] == pytest.approx(0.02847, abs=1e-4)


def test_no_variance_is_zero(spark):
    assert one(spark, stats.two_proportion_z(*map(F.lit, (0.0, 10.0, 0.0, 10.0))))[0] == 0


@pytest.mark.parametrize(("a", "b", "u", "z"), [([1, 2, 3, 4, 5], [6, 7, 8, 9, 10], 0, -2.50672), ([1, 1, 2], [1, 2, 2], 3, -0.496904)])
def test_mann_whitney(spark, a, b, u, z):
    df = spark.createDataFrame([("k", 1, float(x)) for x in a] + [("k", 2, float(x)) for x in b], "k string, side int, x double")
    r = stats.mann_whitney(df, ["k"], "side", "x").first()
    assert r["u"] == u and r["z"] == pytest.approx(z, abs=1e-5)
    if u == 0:
        assert r["effect"] == -1


@pytest.mark.parametrize("rows", [[(1, 3.0)], [(2, 3.0)], [(1, 3.0), (1, 4.0)], [(2, 3.0), (2, 3.0)]])
def test_mann_whitney_of_one_side(spark, rows):
    """A side without rows has no effect, and none is divided by."""
    df = spark.createDataFrame([("k", *r) for r in rows] + [("l", 1, 1.0), ("l", 2, 2.0)], "k string, side int, x double")
    got = {r["k"]: (r["z"], r["effect"]) for r in stats.mann_whitney(df, ["k"], "side", "x").collect()}
    assert got == {"k": (0.0, None), "l": (pytest.approx(0.0), -1.0)}


def test_erfc(spark):
    for x in (-3.0, -0.5, 0.0, 0.3, 1.7, 4.0):
        assert one(spark, stats.erfc(F.lit(x)))[0] == pytest.approx(math.erfc(x), rel=2e-7)


@pytest.mark.parametrize(("v", "p", "want"), [([1, 2, 3, 4], 0.25, 1.5), ([1, 2, 3, 4], 0.5, 2.5), ([1, 2, 3], 0.5, 2), ([5], 0.75, 5)])
def test_quantile_type2(spark, v, p, want):
    df = spark.createDataFrame([("k", float(x)) for x in v], "k string, x double")
    assert stats.quantiles_type2(df, ["k"], "x", {"q": p}).first()["q"] == want


def test_benjamini_hochberg(spark):
    # The 15 p-values of Benjamini and Hochberg (1995): four are rejected at .05.
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    df = spark.createDataFrame([("w", f"c{i:02}", x) for i, x in enumerate(p)], "w string, c string, p double")
    q = {r["c"]: r["q"] for r in stats.benjamini_hochberg(df, ["w"], "p", "c").collect()}
    assert sum(v < 0.05 for v in q.values()) == 4 and max(q.values()) <= 1


def test_mcc(spark):
    assert one(spark, stats.mcc(*map(F.lit, (2, 1, 1, 0))))[0] == pytest.approx(2 / math.sqrt(12))
    assert one(spark, stats.mcc(*map(F.lit, (2, 0, 1, 0))))[0] is None


def test_hmac_and_fingerprint(spark):
    for key in (b"short", b"k" * 100):
        got = one(spark, text.hmac_sha256(text.normal_uid(F.lit("  UsER ")), key))[0]
        assert got == hmac.new(key, b"user", hashlib.sha256).hexdigest()


def test_weeks(spark):
    for d in (dt.date(2024, 12, 30), dt.date(2021, 1, 3), dt.date(2020, 2, 29), dt.date(2023, 1, 1)):
        y, w, _ = d.isocalendar()
        r = one(spark, cal.week_id(F.lit(d)).alias("w"), cal.week_monday(cal.week_id(F.lit(d))).alias("m"), cal.week_sunday(cal.week_id(F.lit(d))).alias("s"))
        assert (r["w"], r["m"], r["s"]) == (f"{y}-W{w:02}", d - dt.timedelta(d.weekday()), d + dt.timedelta(6 - d.weekday()))


@pytest.mark.parametrize(("monday", "term"), [("2024-02-26", None), ("2024-03-04", "2024S"), ("2024-06-24", "2024S"), ("2024-07-01", None), ("2024-09-30", "2024W"), ("2025-01-27", "2024W"), ("2025-02-03", None)])
def test_terms(spark, monday, term):
    assert one(spark, cal.term_of(F.lit(monday).cast("date")))[0] == term


def test_malformed_term_raises(spark):
    with pytest.raises(Exception, match="malformed term"):
        one(spark, cal.term_start(F.lit("2024X")))


def test_dayparts_and_dst(spark):
    assert [one(spark, cal.daypart(F.lit(h)))[0] for h in (0, 5, 6, 12, 18, 23)] == ["night", "night", "morning", "afternoon", "evening", "evening"]
    r = one(spark, cal.local(F.lit("2024-10-27 00:30:00").cast("timestamp_ntz")).cast("string"), cal.local(F.lit("2024-10-27 01:30:00").cast("timestamp_ntz")).cast("string"))
    assert r[0] == r[1] == "2024-10-27 02:30:00"


def test_floor(spark):
    df = spark.createDataFrame([(0, 0), (5, 2), (5, 3)], "value long, n_users long")
    assert [(r["status"], r["value"]) for r in cells.floored(df, 3).collect()] == [("ok", 0), ("suppressed", None), ("ok", 5)]


@pytest.mark.parametrize("row", [(-1, 0), (3, 0), (1, 2)])
def test_incoherent_cell_raises(spark, row):
    with pytest.raises(Exception, match="incoherent"):
        cells.floored(spark.createDataFrame([row], "value long, n_users long"), 3).collect()
