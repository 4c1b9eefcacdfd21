"""Statistics as column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rational approximation of erfc (Numerical Recipes in C, erfcc; relative error below 1.2e-7). Fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    p = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        p = F.lit(c) + t * p
    y = t * F.exp(-z * z + p)
    return F.when(x >= 0, y).otherwise(2.0 - y)


def normal_sf(z: Column) -> Column:
    return 0.5 * erfc(z / 2.0**0.5)


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / 2.0**0.5))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled, without continuity correction; 0 where there is no variance."""
    pool = (x1 + x2) / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    return F.when(se > 0, (x1 / n1 - x2 / n2) / se).otherwise(0.0)


def poisson_log_ratio(c1: Column, w1: Column, c2: Column, w2: Column) -> Column:
    return F.log((c1 / w1) / (c2 / w2))


def poisson_z(c1: Column, w1: Column, c2: Column, w2: Column) -> Column:
    return poisson_log_ratio(c1, w1, c2, w2) / F.sqrt(1 / c1 + 1 / c2)


def cumulative(ties: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`ties` (keys, value, ties) with `up_to`, the rows up to and with each value.

    Values are summed up within their whole number, and whole numbers (few) within the group, so that a group of very
    many distinct values is no single task.
    """
    b = ties.withColumn("__b", F.floor(value))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = b.groupBy(*keys, "__b").agg(F.sum("ties").alias("n")).withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.sum("ties").over(Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("__in", inside).join(first, [*keys, "__b"]).withColumn("up_to", F.col("__in") + F.col("__first")).drop("__b", "__in", "__first")


def quantiles_type2(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], n: str | None = None) -> DataFrame:
    """(keys, a column for each p): the mean of the order statistics ceil(np) and floor(np + 1), from a histogram. A row
    counts once, or as often as its column `n` says."""
    ties = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(n or F.lit(1)).alias("ties"))
    ranked = cumulative(ties, keys, value).join(ties.groupBy(*keys).agg(F.sum("ties").alias("__n")), keys)
    at = lambda rank: F.min(F.when(F.col("up_to") >= rank, F.col(value)))
    n = F.col("__n")
    return ranked.groupBy(*keys).agg(*[((at(F.ceil(n * p)) + at(F.least(n, F.floor(n * p + 1)))) / 2).alias(name) for name, p in ps.items()])


def midranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, ties, midrank): one row a distinct value. Ranks come from a histogram, not a sort of all rows."""
    ties = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    return cumulative(ties, keys, value).withColumn("midrank", F.col("up_to") - (F.col("ties") - 1) / 2).drop("up_to")


def mann_whitney(df: DataFrame, keys: list[str], side: str, value: str, n: str | None = None) -> DataFrame:
    """(keys, n1, n2, u, z, effect) for side 1 against side 2: normal approximation with tie and continuity correction,
    rank-biserial effect; z is 0 without variance, and the effect null where a side has no row. A row counts once, or as
    often as its column `n` says."""
    one, times = F.col(side) == 1, F.col(n) if n else F.lit(1)
    by = df.groupBy(*keys, value).agg(F.sum(F.when(one, times).otherwise(0)).alias("c1"), F.sum(F.when(~one, times).otherwise(0)).alias("c2")).withColumn("ties", F.col("c1") + F.col("c2"))
    t = F.col("ties").cast("double")
    rank = F.col("up_to") - (F.col("ties") - 1) / 2
    sums = cumulative(by, keys, value).groupBy(*keys).agg(F.sum("c1").cast("double").alias("n1"), F.sum("c2").cast("double").alias("n2"), F.sum(F.col("c1") * rank).alias("r1"), F.sum(t * t * t - t).alias("tied"))
    n1, n2 = F.col("n1"), F.col("n2")
    both = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = F.when((n1 > 0) & (n2 > 0), n1 * n2 / 12 * (both + 1 - F.col("tied") / (both * (both - 1))))
    d = u - n1 * n2 / 2
    z = F.when(var > 0, F.signum(d) * F.greatest(F.abs(d) - 0.5, F.lit(0.0)) / F.sqrt(var)).otherwise(0.0)
    return sums.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"), F.when((n1 > 0) & (n2 > 0), 2 * u / (n1 * n2) - 1).alias("effect"))


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, order: str, q: str = "q") -> DataFrame:
    """Adds q: the smallest m / rank * p over all larger p of the group, at most 1. Groups are small."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(p, order))
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = df.withColumn("__raw", m / rank * F.col(p)).withColumn("__rank", rank)
    down = Window.partitionBy(*keys).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(q, F.least(F.lit(1.0), F.min("__raw").over(down))).drop("__raw", "__rank")


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation; null where a margin is empty."""
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den > 0, (tp * tn - fp * fn) / den)
