"""URL filters by a sort-merge range join (DataFrame functions only).

A rule is a host and a path prefix; it fits the host and all its subdomains where the path starts with the prefix. In
the key space (path prefix, reversed host) a rule is the interval of all keys below its own, and intervals either nest
or are apart. Interval ends and the pages' distinct keys are sorted together; a sweep keeps the stack of active rules:
the depth is a running sum of starts and ends, and the innermost rule at depth d is the last one started at depth d.
Range partitions are swept on their own, with what is open at their start carried in from the ones before.

Edge cases: null urls and urls without `://` have an empty host and path and match no rule. Of the fitting rules the
longest (host and path together) wins, ties go to the host that is longer, then sorts last; of equal rules, `allow`
wins. No rule fits: the default verdict. Repeated rows are kept; an empty table, or no rules, gives no matches. Other
columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

_START, _PROBE, _END = 1, 2, 0


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _plain(c: Column) -> Column:
    """Control characters 0 to 3 are marked, so that those of the key can't be in the data."""
    return F.regexp_replace(c, r"([\x00-\x03])", "\x03$1")


def _key(host: Column, prefix: Column) -> Column:
    """Path prefix, then the host's labels in reverse, each ended by character 1."""
    labels = F.reverse(F.split(_plain(host), r"\."))
    return F.concat(_plain(prefix), F.lit("\x00"), F.concat_ws("\x01", labels), F.lit("\x01"))


def _active(events: DataFrame) -> DataFrame:
    """(key, rule) for every probe key, with the innermost active rule, if any. `events` holds key, ord, hi, rule."""
    parts = durable(events.repartitionByRange("key").withColumn("pid", F.spark_partition_id()))
    order = ["key", "ord", F.col("hi").desc_nulls_last()]
    delta = F.when(F.col("ord") == _START, 1).when(F.col("ord") == _END, -1).otherwise(0)
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = parts.groupBy("pid").agg(F.sum(delta).alias("open")).select("pid", F.coalesce(F.sum("open").over(before), F.lit(0)).alias("base"))
    run = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = parts.withColumn("local", F.sum(delta).over(run)).join(base, "pid").withColumn("depth", F.col("base") + F.col("local"))
    swept = swept.withColumn("started", F.when(F.col("ord") == _START, F.col("rule")))
    level = Window.partitionBy("pid", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("here", F.last("started", ignorenulls=True).over(level))
    ends = swept.groupBy("pid", "depth").agg(F.max_by("started", F.when(F.col("started").isNotNull(), F.struct("key", "ord", -F.length("hi")))).alias("last"))
    carried = ends.select("pid", "depth", F.last("last", ignorenulls=True).over(Window.partitionBy("depth").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    probes = swept.filter(F.col("ord") == _PROBE).filter("depth > 0").join(carried, ["pid", "depth"])
    return probes.select("key", F.coalesce("here", "carried").alias("rule"))


def url_verdicts(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """`rules` has host, path, verdict. Returns (id, host, path, rule, verdict) for every row of `pages`.

    The distinct lengths of the rules' paths (few) become one array, by which a page's path is cut into the prefixes
    that a rule could have. Equal (host, path) pairs are looked up once, so a hot host costs nothing more.
    """
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    lo = _key(F.col("host"), F.col("path"))
    rule = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.col("host"), F.col("path"), F.col("verdict"))
    spans = rules.select(lo.alias("lo"), rule.alias("rule")).withColumn("hi", F.concat(F.col("lo").substr(F.lit(1), F.length("lo") - 1), F.lit("\x02")))
    bounds = spans.select(F.col("lo").alias("key"), F.lit(_START).alias("ord"), "hi", "rule").unionByName(spans.select(F.col("hi").alias("key"), F.lit(_END).alias("ord"), "hi", "rule"))
    sizes = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    targets = parsed.filter("host <> ''").select("host", "path").distinct()
    lengths = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("path"))
    cut = targets.select("host", "path", F.explode(lengths).alias("n")).select("host", "path", _key(F.col("host"), F.col("path").substr(F.lit(1), F.col("n"))).alias("key"))
    probes = cut.select("key").distinct().select("key", F.lit(_PROBE).alias("ord"), F.lit(None).cast("string").alias("hi"), F.lit(None).cast(spans.schema["rule"].dataType).alias("rule"))
    found = cut.join(_active(bounds.unionByName(probes)), "key").groupBy("host", "path").agg(F.max("rule").alias("hit"))
    out = parsed.join(found, ["host", "path"], "left")
    return out.select(id_col, "host", "path", F.concat("hit.host", "hit.path").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
