"""Calendar expressions: ISO weeks, terms by the Thursday rule, dayparts. All are plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Vienna"
#: name, from hour, to hour (half-open); they tile the day.
DAYPARTS = (("night", 0, 6), ("morning", 6, 12), ("afternoon", 12, 18), ("evening", 18, 24))


def local(utc: Column, zone: str = ZONE) -> Column:
    """Wall-clock time of a UTC timestamp without zone; the session's time zone must be UTC."""
    return F.from_utc_timestamp(utc, zone)


def monday(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def week_id(d: Column) -> Column:
    """`YYYY-Www`, which sorts as text."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), d).cast("string"), 2, "0"))


def week_monday(week: Column) -> Column:
    """The Monday of a week id: the ISO week of 4 January is week 1."""
    first = monday(F.make_date(F.substring(week, 1, 4).cast("int"), F.lit(1), F.lit(4)))
    return F.date_add(first, (F.substring(week, 7, 2).cast("int") - 1) * 7)


def week_sunday(week: Column) -> Column:
    return F.date_add(week_monday(week), 6)


def term_of(mon: Column) -> Column:
    """The term that owns a week (March to June: summer; October to January: winter), else null."""
    thursday = F.date_add(mon, 3)
    y, m = F.year(thursday), F.month(thursday)
    return (
        F.when(m.between(3, 6), F.concat(y, F.lit("S"))).when(m >= 10, F.concat(y, F.lit("W"))).when(m == 1, F.concat(y - 1, F.lit("W")))
    )


def term_start(term: Column) -> Column:
    """1 March or 1 October; a malformed id raises."""
    checked = F.when(term.isNull() | term.rlike(r"^\d{4}[SW]$"), term).otherwise(F.raise_error(F.concat(F.lit("malformed term: "), term)))
    return F.make_date(F.substring(checked, 1, 4).cast("int"), F.when(F.substring(checked, 5, 1) == "S", 3).otherwise(10), F.lit(1))


def term_end(term: Column) -> Column:
    y = F.substring(term, 1, 4).cast("int")
    return F.when(F.substring(term, 5, 1) == "S", F.make_date(y, F.lit(6), F.lit(30))).otherwise(F.make_date(y + 1, F.lit(1), F.lit(31)))


def daypart(hour: Column, parts=DAYPARTS) -> Column:
    out = F
    for name, lo, hi in parts:
        out = out.when((hour >= lo) & (hour < hi), name)
    return out


def iso_weekday(d: Column) -> Column:
    return F.weekday(d) + 1
