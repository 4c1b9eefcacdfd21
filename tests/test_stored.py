"""Stored tables that change by partition, and the source scan."""

import datetime as dt
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import labels
from cohortlens.sources import files, ingest
from cohortlens.sources.versioned import Table, bucket

LABELS = "history_id long, domain string, code string, value int, label_version string, bucket int"


def files_of(table):
    return {unquote(f).split("/data/")[1] for f in table.read().inputFiles()}


def label_rows(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"history_id long, label_version string, domain string, code string, value int{extra}").withColumn("bucket", bucket(F.col("history_id"), 8))


def test_label_store_rewrites_touched_partitions_only(spark, tmp_path):
    t = Table(spark, str(tmp_path / "labels"), LABELS, ("label_version", "bucket"))
    assert t.read().count() == 0 and t.live() == []
    t.append(label_rows(spark, [(i, v, "d", "c", 0) for i in range(200) for v in ("v 1", "w")]))
    before = files_of(t)
    new = label_rows(spark, [(7, "v 1", "d", "c", 1, 1), (7, "v 1", "d", "c", 5, 2), (999, "v 1", "d", "c", 3, 1)], ", at int")
    old = t.upsert(new, labels.KEY, "at")
    touched = {f"bucket={r['bucket']}" for r in new.select("bucket").distinct().collect()}
    assert len(old) == len(touched) and all(p.split("/")[1] in touched and p.startswith("label_version=v 1") for p in old)
    after = files_of(t)
    assert {f for f in before if not any(f.startswith(p) for p in old)} <= after and not any(f.startswith(p) for f in after for p in old)
    got = {(r["history_id"], r["label_version"]): r["value"] for r in t.read().collect()}
    assert len(got) == 401 == t.read().count() and got[7, "v 1"] == 5 and got[999, "v 1"] == 3 and got[7, "w"] == 0
    # a change that was written but not named is no part of the table
    label_rows(spark, [(1, "x", "d", "c", 1)]).withColumn("gen", F.lit("lost")).write.mode("append").partitionBy("label_version", "bucket", "gen").parquet(str(tmp_path / "labels" / "data"))
    assert t.read().count() == 401
    # what only old states need can go
    t.discard(old)
    assert t.read().count() == 401 and not any((tmp_path / "labels" / "data" / p).exists() for p in old)


def test_erase_touches_the_users_partitions_only(spark, tmp_path):
    n = 8
    rows = [(i, f"u{i % 5}" if i < 300 else f"late{i % 3}", f"2026-W{10 + i // 100}") for i in range(500)]
    messages = Table(spark, str(tmp_path / "m"), "history_id long, pseudonym string, week string", ("week",))
    messages.append(spark.createDataFrame(rows, messages.schema))
    codes = Table(spark, str(tmp_path / "l"), LABELS, ("label_version", "bucket"))
    codes.append(label_rows(spark, [(i, "v", "d", "c", 1) for i in range(0, 500, 2)] + [(900, "v", "d", "c", 1)]))
    roster = Table(spark, str(tmp_path / "r"), "pseudonym string, status string, bucket int", ("bucket",))
    roster.append(spark.createDataFrame([(f"u{i}", "staff") for i in range(5)], "pseudonym string, status string").withColumn("bucket", bucket(F.col("pseudonym"), n)))
    weeks = {f for f in files_of(messages) if f.startswith(("week=2026-W13", "week=2026-W14"))}
    erased = ingest.erase_stored(messages, {"roster": roster}, {"labels": codes}, "u1", n)
    assert erased == {"messages": 60, "labels": 30, "roster": 1}
    assert weeks and weeks <= files_of(messages), "weeks without the user keep their files"
    assert messages.read().filter("pseudonym = 'u1'").count() == 0 and messages.read().count() == 440
    assert codes.read().count() == 221 and {r["history_id"] for r in codes.read().filter("history_id % 10 = 6").collect()} == set(range(306, 500, 10))
    assert roster.read().count() == 4
    left = [p.read_bytes() for p in (tmp_path / "r").rglob("*.parquet")]
    assert left and not any(b"u1" in b for b in left), "the files that held the user are deleted"
    assert ingest.erase_stored(messages, {"roster": roster}, {"labels": codes}, "u1", n) == {"messages": 0, "labels": 0, "roster": 0}


def test_source_scan_is_pushed_down(spark, tmp_path):
    """An embedded database stands for the source."""
    url, driver = f"jdbc:derby:{tmp_path}/source;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.jdbc(url, name, "append", {"driver": driver})
    day = lambda i: dt.datetime(2026, 3, 9) + dt.timedelta(hours=i)
    history = "id long, student_id long, started long, created_at timestamp_ntz, noise string"
    write([(i, i % 3, 5, day(i), "x") for i in range(1, 41)], history, "history")
    write([(i, f" U{i}", day(0)) for i in range(3)], "student_id long, uid string, created_at timestamp_ntz", "students")
    columns = ["id", "student_id", "started", "created_at"]
    got = ingest.scan_above(spark, url, "history", 30, columns, rows_per_task=3, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and {r["id"] for r in got.collect()} == set(range(31, 41))
    plan = got.select("id", "started")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,30)]" in plan and "ReadSchema: struct<id:bigint,started:bigint>" in plan and "noise" not in plan
    assert ingest.scan_above(spark, url, "history", 99, columns, driver=driver).count() == 0
    students = ingest.scan_above(spark, url, "students", -1, ["student_id", "uid", "created_at"], key="student_id", driver=driver)
    store = str(tmp_path / "store")
    assert ingest.ingest(spark, store, students, ingest.scan_above(spark, url, "history", 0, columns, driver=driver).filter("id <= 25"), b"k") == 25
    above = files.read_watermark(spark, f"{store}/watermark")[0]
    write([(41, 2, 5, day(41), "x")], history, "history")
    assert ingest.ingest(spark, store, students, ingest.scan_above(spark, url, "history", above, columns, driver=driver), b"k") == 16
    kept = spark.read.parquet(f"{store}/messages")
    assert kept.count() == kept.select("history_id").distinct().count() == 41 and kept.filter("history_id = 41").first()["created_at"] == day(41)


def test_freshness(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.publish(spark.range(3), folder, "v1")
    assert files.read_latest(spark, folder, max_age="1 hour").count() == 3
    old = spark.range(1).select(F.lit("v0").alias("version"), (F.current_timestamp() - F.expr("interval 9 days")).alias("published_at"))
    spark.range(1).write.parquet(f"{folder}-old/v0")
    old.write.parquet(f"{folder}-old/pointers")
    assert files.read_latest(spark, f"{folder}-old").count() == 1
    assert files.read_latest(spark, f"{folder}-old", max_age="10 days").count() == 1
    with pytest.raises(TimeoutError, match="older than 8 days"):
        files.read_latest(spark, f"{folder}-old", max_age="8 days")
