"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, chat, langid, lm, mixing, pieces, prefix_trie, secret_scan, simhash, suffix_runs, toxicity, urls
from .common import durable_table, id_remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio.audio_features(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.size("spans").alias("n_spans"), F.octet_length("blocks").alias("block_bytes"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_texts(table(spark, sf_dir, "documents"), id_remainder("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score")


#: host, path, verdict
URL_RULES = "VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block') AS rules(host, path, verdict)"


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix.block", "mix.slot", "mix.place")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {URL_RULES}"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = durable_table(simhash.fingerprints(table(spark, sf_dir, "documents"), 3))
    return simhash.link_fingerprints(prints).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of `documents`, of which a tenth (by the id's crc32) is made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(h / 10).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("planted"))
    docs = docs.withColumn("w", F.when(F.col("planted"), suffix_runs.words_of(F.col("text"))))
    n = F.size("w")
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    periodic = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    made = suffix_runs.periodic_runs(docs.select("doc_id", F.when(F.col("p").isNotNull(), periodic).otherwise(F.col("text")).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    made = made.withColumn("best", best).withColumn("length", -F.col("best.short"))
    exponent = F.floor(1000 * F.col("length") / F.col("best.period"))
    return made.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "length", "best.period", exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of `conversations`, each rebuilt to begin like the first of its hundred."""
    keys = durable_table(prefix_trie.turn_keys(table(spark, sf_dir, "conversations")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    heads = keys.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") <= 5)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "chars"))).alias("head"))
    convs = keys.filter("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"))
    convs = durable_table(convs.join(heads, "base", "left").select("conv_id", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,k1:bigint,k2:bigint,chars:bigint>>")), F.lit(1), F.col("h").cast("int")).alias("head")))
    own = keys.filter(F.col("pos") > h).join(convs.select("conv_id", F.size("head").alias("m")), "conv_id").select("conv_id", (F.col("pos") - h + F.col("m")).alias("pos"), "k1", "k2", "chars")
    none = F.lit(None).cast("long")
    rebuilt = own.unionByName(convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")).unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("pos"), none.alias("k1"), none.alias("k2"), none.alias("chars")))
    return prefix_trie.prefix_trie(rebuilt)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def number(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, kinds), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_source_mix": op2_source_mix,
    "op3_language_id": op3_language_id,
    "op4_lm_score": op4_lm_score,
    "op5_url_filters": op5_url_filters,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_simhash": op7_simhash,
    "op8_nearest": op8_nearest,
    "op9_chat_format": op9_chat_format,
    "op10_audio_features": op10_audio_features,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_secret_scan": op13_secret_scan,
}
_URL = """
WITH parsed AS (
    SELECT page_id,
           CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages),
ranked AS (
    SELECT p.*, r.host || r.path AS rule, r.verdict
    FROM (SELECT row_number() OVER () AS rn, * FROM parsed) p
    LEFT JOIN (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) r(host, path, verdict)
      ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM ranked QUALIFY row_number() OVER (PARTITION BY rn ORDER BY length(rule) DESC NULLS LAST) = 1
"""

_MIX = """
WITH RECURSIVE src AS (
    SELECT source, round(sqrt(count(*)) / sum(sqrt(count(*))) OVER () * 1000, 12) AS share, count(*) AS n FROM documents GROUP BY source),
parts AS (SELECT source, greatest(1, CAST(floor(share + 0.5) AS BIGINT)) AS p, row_number() OVER (ORDER BY source) AS i FROM src),
one AS (SELECT list(p ORDER BY i) AS ps, CAST(sum(p) AS BIGINT) AS q FROM parts),
edf(t, done, pick) AS (
    SELECT CAST(-1 AS BIGINT), list_transform(ps, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM one
    UNION ALL
    SELECT t, list_transform(done, lambda d, i: d + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
        SELECT t + 1 AS t, done, list_min(list_transform(ps, lambda x, i: CASE WHEN done[i] * q // x <= t + 1 THEN (((done[i] + 1) * q + x - 1) // x) * 100000 + i END)) % 100000 AS pick
        FROM edf, one WHERE t + 1 < q)),
slots AS (SELECT pick AS i, t AS at, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM edf WHERE t >= 0),
rows AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 2147483648) * 2654435761 // 4194304 % 1024, doc_id) - 1 AS k FROM documents)
SELECT r.doc_id, r.source, r.k // 32 AS block, CAST(r.k // 32 // parts.p * one.q + slots.at AS BIGINT) AS slot, r.k % 32 AS place
FROM rows r JOIN parts USING (source) CROSS JOIN one JOIN slots ON slots.i = parts.i AND slots.nth = r.k // 32 % parts.p
"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text: -1 stands for one shift of the register, other numbers are bytes."""
    bits = f"list_concat([4294967295], flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({bits}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"


_RUNS = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS own FROM documents),
shape AS (SELECT *, len(own) AS n, h % 10 = 0 AND len(own) > 0 AS planted, h // 10 AS g FROM docs),
cuts AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM shape),
texts AS (SELECT rid, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: own[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE own END AS w FROM cuts),
words AS (SELECT rid, unnest(range(n)) AS i, unnest(w) AS w FROM texts),
same AS (SELECT x.rid, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.rid = y.rid AND x.w = y.w AND x.i < y.i),
isles AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM same),
stretches AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM isles GROUP BY rid, q, isle HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT * FROM stretches a WHERE NOT EXISTS (SELECT 1 FROM stretches b WHERE b.rid = a.rid AND b.q < a.q AND b.s <= a.s AND b.s + b.len >= a.s + a.len)),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed, arg_min([s, len, q], [-len, s, q]) AS best FROM runs GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""

_TRIE = f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(t ORDER BY pos) AS own, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM turns GROUP BY conv_id),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS t FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (SELECT conv_id, unnest(range(len(t) + 1)) AS d, t FROM rebuilt),
nodes AS (SELECT t[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, bool_and(len(t) = d) AS leaf, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(t) = d), '') AS ends FROM prefixes GROUP BY ALL),
below AS (SELECT u.p, count(*) FILTER (v.d = u.d + 1) AS n_children, count(*) FILTER (v.leaf) AS n_leaves, sum(CASE WHEN v.d > 0 THEN (v.n - 1) * length(v.p[v.d].text) ELSE 0 END) AS saved FROM nodes u JOIN nodes v ON v.d >= u.d AND v.p[1:u.d] = u.p GROUP BY u.p)
SELECT u.conv_id, u.d AS depth, o.conv_id AS parent_conv_id, u.n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM nodes u JOIN below USING (p) LEFT JOIN nodes o ON o.d = u.d - 1 AND o.p = u.p[1:u.d - 1]
"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _spans_sql() -> str:
    """Where the matches of each rule lie: between the pieces that splitting by the same pattern leaves."""
    rules = [  # kind, pattern with the part whose characters count as its group, how many of them
        ("assign", "(?:" + _either_case("password|passwd|secret|token|api_?key") + """)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 12),
        ("access", "(AKIA[A-Z0-9]+)", 18), ("hex", "([0-9a-f]{16,})", 16), ("pem", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 8), ("git", "gh[opsu]_([A-Za-z0-9]+)", 36), ("chat", "xox[abprs]-([0-9A-Za-z-]+)", 10),
    ]
    one = """SELECT rid, {k} AS k, '{kind}' AS kind, list_sum(list_transform(range(1, i + 1), lambda j: length(cut[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(hit[j]))), 0) AS s, s + length(hit[i]) AS e
    FROM (SELECT rid, regexp_split_to_array(text, '{p}') AS cut, regexp_extract_all(text, '{p}', 0) AS hit, regexp_extract_all(text, '{p}', 1) AS part, unnest(range(1, len(hit) + 1)) AS i FROM docs) WHERE length(part[i]) >= {n}"""
    return " UNION ALL ".join(one.format(k=k, kind=kind, p=p, n=n) for k, (kind, p, n) in enumerate(rules))


_SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_spans_sql()}),
whole AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                 coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN whole USING (rid)
"""

ORACLES: dict[str, str] = {"op2_source_mix": _MIX, "op5_url_filters": _URL, "op11_periodic_runs": _RUNS, "op12_prefix_trie": _TRIE, "op13_secret_scan": _SECRETS}
