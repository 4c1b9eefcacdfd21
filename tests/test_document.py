"""The rendered document, rules counted while writing, and row-local plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text
from cohortlens.operators import guard, labels
from cohortlens.plans import document
from cohortlens.sources import files
from cohortlens.streaming.ingest import HISTORY, ingest_available

CELLS = "window_id string, level string, status string, value long"


def cells(spark, hidden=None, tasks=2):
    rows = [(f"w{i:02}", ("all", "staff")[i % 2], "ok" if i % 3 else "suppressed", i if i % 3 else hidden) for i in range(25)]
    return spark.createDataFrame(rows, CELLS).repartition(tasks)


def summaries(spark, users=9):
    return spark.createDataFrame([("w", "all", "ok", users, 1.5, 1.0, 2.0, 1.6, None)], "window_id string, level string, status string, n_users long, median double, p25 double, p75 double, mean double, sd double")


def test_document_has_stable_bytes(spark, tmp_path):
    for name, tasks in (("a", 1), ("b", 7)):
        files.render_document({"cells": cells(spark, tasks=tasks), "summary": summaries(spark)}, str(tmp_path / name), lines=10)
        files.check_document(spark, str(tmp_path / name))

    def content(name):
        return {p.parent.relative_to(tmp_path / name): p.read_bytes() for p in (tmp_path / name).rglob("part-*.txt")}

    assert content("a") == content("b") and len(content("a")) == 3 + 1 + 1
    lines = [x for part in range(3) for x in (b"".join(v for k, v in content("a").items() if k.parts[-2:] == ("section=cells", f"part={part}"))).decode().splitlines()]
    assert len(lines) == 25 and lines == sorted(lines) and lines[0] == '{"level":"all","status":"ok","value":10,"window_id":"w10"}'
    got = {(r["section"], r["part"]): r["lines"] for r in files.read_manifest(spark, str(tmp_path / "a")).collect()}
    assert got == {("cells", 0): 10, ("cells", 1): 10, ("cells", 2): 5, ("summary", 0): 1}
    one = next(p for p in (tmp_path / "b").rglob("section=summary/*/part-*.txt"))
    one.with_name(f".{one.name}.crc").unlink()
    one.write_text(one.read_text().replace("1.5", "1.6"))
    with pytest.raises(ValueError, match="summary"):
        files.check_document(spark, str(tmp_path / "b"))


def test_rules_are_counted_in_the_write(spark, tmp_path):
    tables = {"cells": cells(spark, hidden=1).withColumn("level", F.when(F.col("value") == 4, "phd").otherwise(F.col("level"))), "summary": summaries(spark, users=2), "bare": spark.range(3)}
    found, observed = document.write(tables, str(tmp_path / "x"), 3)
    got = {}
    for r in observed.collect():
        got[r["rule"]] = got.get(r["rule"], 0) + r["n"]
    assert got == {"suppressed_bare": 9, "levels_known": 1, "floor_respected": 1} and found["cells"].count() == 25
    again = {name: {r["rule"]: r["n"] for r in guard.counted_rules(t, 3).collect()} for name, t in tables.items() if guard.row_rules(t.columns, 3)}
    assert {k: sum(t.get(k, 0) for t in again.values()) for k in got} == got
    with pytest.raises(ValueError, match="suppressed_bare"):
        guard.require_clean(observed.groupBy("rule").agg(F.sum("n").alias("n")))


def test_key_stands_in_no_plan(spark):
    key = b"a very secret key of ours"
    df = spark.createDataFrame([("u",), (None,)], "uid string").select(text.hmac_sha256(text.normal_uid(F.col("uid")), key).alias("p"))
    plan = df._jdf.queryExecution().toString()
    padded = key.ljust(64, b"\0")
    forms = [key.decode(), key.hex(), *(bytes(b ^ p for b in padded).hex() for p in (0x36, 0x5C)), *(bytes(b ^ p for b in padded).decode("latin-1") for p in (0x36, 0x5C))]
    assert not any(f[:12].lower() in plan.lower() for f in forms) and "keyed_hash" in plan
    assert [r["p"] for r in df.collect()][1] is None


def test_language_is_labelled_without_a_shuffle(spark, tmp_path):
    profile = spark.createDataFrame([("de", "und", 0.5), ("de", "die", 0.5), ("en", "the", 0.6), ("en", "die", 0.4), ("fr", "le", 1.0)], "lang string, token string, weight double")
    rows = [(1, "und und die Sonne"), (2, "The sun the moon"), (3, "le soleil le"), (4, "die die die die"), (5, None), (6, "kurz"), (7, "nothing known here"), (1, "und und die Sonne")]
    spark.createDataFrame(rows, "id long, text string").write.parquet(str(tmp_path / "t"))
    got = labels.label_language(spark.read.parquet(str(tmp_path / "t")), profile, id_col="id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["code"], round(r["confidence"], 3)) for r in got.collect()) == [(1, "de", 0.789), (1, "de", 0.789), (2, "en", 1.0), (3, "other", 1.0), (4, "undetermined", 0.556), (5, "undetermined", 0.0), (6, "undetermined", 0.0), (7, "undetermined", 0.0)]
    none = labels.label_language(spark.read.parquet(str(tmp_path / "t")), profile.limit(0), id_col="id")
    assert {r["code"] for r in none.collect()} == {"undetermined"}


def test_batches_do_not_depend_on_ranges(spark):
    ids = spark.range(0, 3000, 7).select(F.col("id").alias("history_id"))
    key = lambda df: sorted((r["bucket"], r["batch"], tuple(r["ids"])) for r in df.collect())
    whole = key(labels.batches(ids, 5, buckets=4, span=1 << 30))
    assert key(labels.batches(ids, 5, buckets=4, span=64)) == whole
    by = {}
    for bucket, batch, got in whole:
        by.setdefault(bucket, []).append((batch, got))
    assert all([i for _, got in sorted(bs) for i in got] == [i for i in range(0, 3000, 7) if i % 4 == b] and all(len(g) == 5 for _, g in sorted(bs)[:-1]) for b, bs in by.items())


def test_stream_never_reads_its_target(spark, tmp_path):
    at = lambda day: dt.datetime(2026, 3, day)
    students = spark.createDataFrame([(1, "u1"), (2, "u2")], "student_id long, uid string")
    write = lambda rows: spark.createDataFrame(rows, HISTORY).write.mode("append").parquet(str(tmp_path / "in"))
    for name, within in (("kept", None), ("forgotten", "30 days")):
        out, cp = tmp_path / name, tmp_path / f"{name}-cp"
        run = lambda out=out, cp=cp, within=within: ingest_available(spark, str(tmp_path / "in"), students, b"k", str(out), str(cp), repeats_within=within).awaitTermination()
        if within is None:
            write([(1, 1, 5, at(9)), (2, 2, 6, at(10)), (2, 2, 6, at(10))])
        run()
        first = list(out.rglob("*.parquet"))
        for f in first:
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
            f.write_bytes(b"spoilt")
        write([(2, 2, 6, at(10)), (3 if within is None else 4, 1, 7, at(17))])
        run()
        new = [str(f) for f in out.rglob("*.parquet") if f not in first]
        got = [r["history_id"] for r in spark.read.parquet(*new).collect()]
        assert got == [3] if within is None else got == [4], name
