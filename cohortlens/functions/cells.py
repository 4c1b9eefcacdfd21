"""Floored cells: a number may be published if no user or at least `floor` users stand behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OK, SUPPRESSED = "ok", "suppressed"


def status(n_users: Column, floor: int) -> Column:
    return F.when((n_users == 0) | (n_users >= floor), OK).otherwise(SUPPRESSED)


def floored(df: DataFrame, floor: int, value: str = "value", n_users: str = "n_users") -> DataFrame:
    """Replaces n_users by `status`; the value is null where suppressed. Negative or incoherent input raises."""
    v, n = F.col(value), F.col(n_users)
    wrong = (v < 0) | (n < 0) | ((n == 0) & (v != 0)) | (n > v)
    checked = F.when(wrong, F.raise_error(F.lit("incoherent cell"))).otherwise(n)
    s = status(checked, floor)
    return df.withColumns({"status": s, value: F.when(s == OK, v).cast("bigint")}).drop(n_users)


def suppress_together(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """If one cell of a group is suppressed, so are all; else one could be had by subtraction."""
    hidden = F.max((F.col("status") == SUPPRESSED).cast("int")).over(Window.partitionBy(*keys)) == 1
    return df.withColumns({value: F.when(~hidden, F.col(value)), "status": F.when(hidden, SUPPRESSED).otherwise(F.col("status"))})


def count_cells(df: DataFrame, keys: list[str], user: str = "pseudonym", n: Column | None = None) -> DataFrame:
    """(keys, value, n_users): first to user grain, then to the cell, so that no distinct count is needed."""
    grain = df.groupBy(*keys, user).agg(F.sum(F.lit(1) if n is None else n).alias("n"))
    return grain.groupBy(*keys).agg(F.sum("n").alias("value"), F.count(F.lit(1)).alias("n_users"))


def both_cells(df: DataFrame, keys: list[str], names: tuple[str, str] = ("messages", "active_users"), n: Column | None = None) -> DataFrame:
    """(keys, measure, value, n_users) of a count and of its users, from one aggregate at user grain."""
    return both_measures(count_cells(df, keys, n=n), keys, names)


def both_measures(c: DataFrame, keys: list[str], names: tuple[str, str] = ("messages", "active_users")) -> DataFrame:
    """(keys, measure, value, n_users): the value and the users of (keys, value, n_users) as two measures."""
    measures = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(value).alias("value")) for name, value in zip(names, ("value", "n_users"), strict=True)])
    return c.select(*keys, "n_users", F.explode(measures).alias("m")).select(*keys, "m.measure", "m.value", "n_users")


def dense(cells: DataFrame, scaffold: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of the scaffold, with 0 where there is no cell. Only a scaffold may fill in zeros."""
    return scaffold.join(cells, keys, "left").withColumns({"value": F.coalesce("value", F.lit(0)), "n_users": F.coalesce("n_users", F.lit(0))})
