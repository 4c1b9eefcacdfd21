"""Labels: versions, pending work, upserts, parsing of coding responses, language labels, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text

KEY = ["history_id", "label_version", "domain", "code"]


def read_version(labels: DataFrame, version: str) -> DataFrame:
    return labels.filter(F.col("label_version") == version)


def versions(labels: DataFrame) -> DataFrame:
    return labels.select("label_version").distinct()


def pending(messages: DataFrame, done: DataFrame, **where: str) -> DataFrame:
    """Messages without a row in `done` that meets all of `where` (a version, a domain, a run)."""
    d = done
    for c, v in where.items():
        d = d.filter(F.col(c) == v)
    return messages.join(d.select("history_id").distinct(), "history_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Old rows without a new one of the same key, and of new rows of one key the last to arrive."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(arrival)))
    fresh = new.withColumn("__n", last).filter("__n = 1").drop("__n", arrival)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def batches(rows: DataFrame, size: int = 10, buckets: int = 64, span: int = 1 << 18) -> DataFrame:
    """(bucket, batch, ids): up to `size` ids in order, numbered within hash buckets, so no global order is needed.

    A bucket's rows are numbered in ranges of `span` ids, of which each holds span / buckets at most; so tasks are as many
    as the table needs, and what is summed up over a whole bucket is one number a range. Ids are distinct.
    """
    if not 1 <= size <= 50:
        raise ValueError("a batch has 1 to 50 messages")
    b = rows.select("history_id", F.pmod("history_id", F.lit(buckets)).alias("bucket"), F.expr(f"history_id div {span}").alias("range"))
    before = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = b.groupBy("bucket", "range").agg(F.count(F.lit(1)).alias("n")).select("bucket", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("bucket", "range").orderBy("history_id"))
    numbered = b.withColumn("nth", nth).join(first, ["bucket", "range"])
    return numbered.withColumn("batch", F.floor((F.col("first") + F.col("nth") - 1) / size)).groupBy("bucket", "batch").agg(F.sort_array(F.collect_list("history_id")).alias("ids"))


def language_profile(texts: DataFrame, lang: str, *, top: int = 40) -> DataFrame:
    """(lang, token, weight): each language's most frequent tokens with their share; `top` bounds it."""
    tokens = texts.select(F.col(lang).alias("lang"), F.explode(F.split(F.lower(text.collapse(F.col("text"))), " ")).alias("token")).filter("lang is not null and token <> ''")
    n = tokens.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))
    return n.withColumns({"weight": share, "rank": rank}).filter(F.col("rank") <= top).select("lang", "token", "weight")


#: A profile has fewer rows than this (languages times `top`); it becomes part of the plan.
MOST_PROFILE_ROWS = 20_000


def label_language(texts: DataFrame, profile: DataFrame, *, id_col: str, known: tuple[str, ...] = ("de", "en")) -> DataFrame:
    """(id, code, confidence): de, en, other or undetermined (below 10 characters or 0.6 confidence).

    The profile is a short list, so a text is scored where it is read: its tokens that any language knows are folded into
    a sum a language, and no row is shuffled.
    """
    rows = profile.limit(MOST_PROFILE_ROWS).collect()
    if len(rows) == MOST_PROFILE_ROWS:
        raise ValueError(f"a profile has fewer than {MOST_PROFILE_ROWS} rows")
    weights, langs = {}, sorted({r["lang"] for r in rows})
    for r in rows:
        weights.setdefault(r["token"], {})[r["lang"]] = r["weight"]
    t = texts.select(id_col, text.collapse(F.coalesce("text", F.lit(""))).alias("t"))
    none = F.lit(0.0)
    if not rows:
        return t.select(id_col, F.lit("undetermined").alias("code"), none.alias("confidence"))
    table = F.create_map(*[x for token, own in weights.items() for x in (F.lit(token), F.array(*[F.lit(float(own.get(lang, 0.0))) for lang in langs]))])
    met = F.filter(F.split(F.lower("t"), " "), lambda x: x.isin(*weights))
    score = F.aggregate(met, F.array(*[none] * len(langs)), lambda a, x: F.zip_with(a, F.element_at(table, x), lambda i, j: i + j))
    t = t.withColumn("score", score).withColumns({"best": F.array_max("score"), "total": F.aggregate("score", none, lambda a, x: a + x)})
    lang = F.element_at(F.array(*map(F.lit, langs)), F.array_position("score", F.col("best")).cast("int"))
    t = t.withColumns({"lang": lang, "confidence": F.when(F.col("total") > 0, F.col("best") / F.col("total")).otherwise(none)})
    code = F.when((F.length("t") < 10) | (F.col("confidence") < 0.6), "undetermined").when(F.col("lang").isin(*known), F.col("lang")).otherwise("other")
    return t.select(id_col, code.alias("code"), "confidence")


def unpivot_coded(wide: DataFrame, categories: list[str], *, group_col: str = "group", version: str = "v0") -> DataFrame:
    """Long labels with provenance by group; a value that is neither 0 nor 1 raises."""
    long = wide.unpivot(["history_id", group_col], categories, "name", "value")
    value = F.when(F.col("value").isin(0, 1), F.col("value").cast("int")).otherwise(F.raise_error(F.lit("a coded value is neither 0 nor 1")))
    source = F.when(F.col(group_col) == "Master_sample", "consensus").otherwise("single_coder")
    return long.select("history_id", F.lit(version).alias("label_version"), F.lit("deductive").alias("domain"), text.slug(F.col("name")).alias("code"), value.alias("value"), source.alias("provenance"))


def agreement(labels: DataFrame, truth: str, predicted: str, domain: str | None = None) -> DataFrame:
    """(domain, code, n, tp, tn, fp, fn, mcc) of two versions of the same messages' labels."""
    t, p = (read_version(labels, v).select("history_id", "domain", "code", F.col("value").alias(n)) for v, n in ((truth, "t"), (predicted, "p")))
    both = t.join(p, ["history_id", "domain", "code"])
    if domain:
        both = both.filter(F.col("domain") == domain)
    n = both.groupBy("domain", "code").agg(F.count(F.lit(1)).alias("n"), *[F.count_if((F.col("t") == a) & (F.col("p") == b)).alias(k) for k, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))])
    return n.withColumn("mcc", stats.mcc(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")))


def average_agreement(per_code: DataFrame) -> DataFrame:
    """Codes without an MCC are left out of the average."""
    return per_code.agg(F.avg("mcc").alias("mcc"), F.count("mcc").alias("codes"))


def coverage(labels: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(messages, models): how many messages have a label of both versions, and who made the predicted ones."""
    t, p = (labels.filter(F.col("label_version") == v) for v in (truth, predicted))
    n = t.join(p.select("history_id", "domain", "code"), ["history_id", "domain", "code"], "left_semi").agg(F.count_distinct("history_id").alias("messages"))
    return n.crossJoin(p.agg(F.sort_array(F.collect_set("provenance")).alias("models")))


def candidate_frequencies(candidates: DataFrame, run_id: str) -> DataFrame:
    return candidates.filter((F.col("run_id") == run_id) & (F.col("code") != "")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def parse_binary(responses: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Responses (batch, expected: array of ids, text) of one Markdown row a message -> (labels, rejects).

    A response is rejected as a whole if its header, row set, width or a value is wrong, or a row comes twice.
    """
    cells = lambda line: F.transform(F.split(F.trim(F.regexp_replace(line, r"^\s*\||\|\s*$", "")), r"\|"), lambda x: F.trim(x))
    r = responses.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    r = r.withColumns({"header": cells(F.get("lines", F.lit(0))), "body": F.slice("lines", 3, F.greatest(F.lit(0), F.size("lines") - 2))})
    good_header = F.coalesce(F.col("header") == F.array(F.lit("message"), *map(F.lit, names)), F.lit(False))
    rows = r.withColumn("rows", F.transform("body", cells))
    ids = F.transform("rows", lambda c: F.try_to_number(c[0], F.lit("99999999999999999")).cast("long"))
    reason = (
        F.when(~good_header, "header").when(F.exists("rows", lambda c: F.size(c) != len(names) + 1), "width")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate").when(F.sort_array(F.coalesce(ids, F.array().cast("array<bigint>"))) != F.sort_array("expected"), "rows")
        .when(F.exists("rows", lambda c: F.exists(F.slice(c, 2, len(names)), lambda x: ~x.isin("0", "1"))), "value")
    )
    judged = rows.withColumn("reason", reason)
    long = judged.filter("reason is null").select(F.explode("rows").alias("c")).select(F.col("c")[0].cast("long").alias("history_id"), F.posexplode(F.slice("c", 2, len(names))).alias("i", "v"))
    named = long.select("history_id", text.slug(F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)).alias("code"), F.col("v").cast("int").alias("value"))
    return named, judged.filter("reason is not null").select("batch", "reason")


def parse_numbers(cells: DataFrame, labels: DataFrame, *, cell: str = "cell") -> tuple[DataFrame, DataFrame]:
    """Cells `1; 3` or `none` -> (history_id, code); numbers that `labels` (number, code) has not are rejects."""
    wanted = cells.filter(F.lower(F.trim(cell)) != "none").select("history_id", F.explode(F.split(cell, ";")).alias("x")).select("history_id", F.trim("x").alias("x"))
    joined = wanted.withColumn("number", F.when(F.col("x").rlike(r"^\d{1,6}$"), F.col("x").cast("int"))).join(F.broadcast(labels), "number", "left")
    return joined.filter("code is not null").select("history_id", "code").distinct(), joined.filter("code is null").select("history_id", "x")


def normal_codes(codes: Column) -> Column:
    """Codes in lower case with single spaces, distinct, without those of over 5 words or 60 characters."""
    clean = F.transform(codes, lambda c: text.collapse(F.lower(c)))
    return F.array_distinct(F.filter(clean, lambda c: (c != "") & (F.size(F.split(c, " ")) <= 5) & (F.length(c) <= 60)))


def candidate_rows(coded: DataFrame, run_id: str) -> DataFrame:
    """(history_id, run_id, code) with an empty code for a message without any, which marks it as done."""
    return coded.select("history_id", F.lit(run_id).alias("run_id"), F.explode_outer(normal_codes(F.col("codes"))).alias("code")).withColumn("code", F.coalesce("code", F.lit("")))


def explicit_labels(messages: DataFrame, codes: DataFrame, hits: DataFrame) -> DataFrame:
    """(history_id, code, value): 1 for a hit, else 0, for every message and code (codes: a short list)."""
    return messages.select("history_id").crossJoin(F.broadcast(codes.select("code"))).join(hits.select("history_id", "code").distinct().withColumn("value", F.lit(1)), ["history_id", "code"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def theme_faults(themes: DataFrame) -> DataFrame:
    """(rule, n) of a theme list's broken rules: 3 to 40 rows, labels of 1 to 80 characters, unique in any case, described."""
    one = themes.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.length(F.trim("code")) == 0) | (F.length("code") > 80)).alias("label"), F.count_if(F.length(F.trim("description")) == 0).alias("description"), F.count_distinct(F.lower("code")).alias("d"))
    wide = one.select(F.when(F.col("n").between(3, 40), 0).otherwise(F.col("n")).alias("rows"), "label", "description", (F.col("n") - F.col("d")).alias("unique"))
    return wide.unpivot([], ["rows", "label", "description", "unique"], "rule", "n").filter("n > 0")


def freeze(sets: DataFrame, entries: DataFrame, version: str) -> DataFrame:
    """Adds a reviewed version; one that exists is never changed."""
    if not sets.filter(F.col("set_version") == version).isEmpty():
        raise ValueError(f"set {version} exists")
    return sets.unionByName(entries.select(F.lit(version).alias("set_version"), "code", "description", F.current_timestamp().alias("reviewed_at")))


def reviewed(sets: DataFrame, version: str) -> DataFrame | None:
    """The codes of a version; none if it is absent; an error if a row was not reviewed."""
    s = sets.filter(F.col("set_version") == version)
    state = s.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("reviewed_at").isNotNull()).alias("ok")).first()
    if state["n"] and not state["ok"]:
        raise ValueError(f"set {version} has rows that were not reviewed")
    return s.select("code") if state["n"] else None
