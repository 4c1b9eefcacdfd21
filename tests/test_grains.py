"""The maintained grain: weekly runs against a full rebuild, and what they read."""

import datetime as dt
import random

import pytest

from cohortlens.operators import facts, sections, trends
from cohortlens.plans import corpora
from cohortlens.sources import grains

MSG = "history_id long, pseudonym string, session_started long, created_at timestamp_ntz, week string"
OPTIONS = {"label_version": "codes", "language_version": "language"}


def millis(t):
    return int(t.replace(tzinfo=dt.UTC).timestamp() * 1000)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Ten weeks of messages in a table by week; some sessions go on over a Sunday's midnight."""
    rng, rows, codes = random.Random(3), [], []
    for i in range(600):
        t = dt.datetime(2026, 2, 2) + dt.timedelta(minutes=rng.randrange(10 * 7 * 24 * 60))
        began = t - dt.timedelta(minutes=t.minute % 7) if i % 3 else t.replace(hour=0, minute=0) - dt.timedelta(days=t.weekday() % 2)
        local = t + dt.timedelta(hours=1 if t < dt.datetime(2026, 3, 29, 1) else 2)
        rows.append((i, f"u{rng.randrange(25)}", millis(began), t, "{}-W{:02}".format(*local.isocalendar()[:2])))
        codes += [(i, "language", "language", rng.choice(["de", "en"]), 1)] * (i % 5 > 0) + [(i, "codes", "method_theme", rng.choice("xyz"), 1)] * (i % 4 == 0)
    for k in range(4):  # a Sunday evening's session ends on Monday
        t = dt.datetime(2026, 2, 8, 21, 30) + dt.timedelta(weeks=k)
        rows += [(1000 + 2 * k, "n", millis(t), t, f"2026-W{6 + k:02}"), (1001 + 2 * k, "n", millis(t), t + dt.timedelta(hours=3), f"2026-W{7 + k:02}")]
    folder = str(tmp_path_factory.mktemp("messages") / "table")
    spark.createDataFrame(rows, MSG).write.partitionBy("week").parquet(folder)
    roster = spark.createDataFrame([(f"u{i}", ("bachelor", "master", "staff")[i % 3], "2026S" if i % 9 == 0 else None) for i in range(20)], "pseudonym string, status string, ma_start_semester string")
    students = spark.createDataFrame([(f"u{i}", dt.datetime(2026, 2, 3 + i)) for i in range(20)], "pseudonym string, registered_at timestamp_ntz")
    labels = spark.createDataFrame(codes, "history_id long, label_version string, domain string, code string, value int")
    return facts.Corpus(spark.read.parquet(folder), students, roster, labels)


def tables(v):
    users, keys = sections.per_user_rows(v), ["window_id", "level"]
    made = {
        "weekly": sections.weekly_activity(v, 3), "language": sections.weekly_language(v, 3), "usage": sections.window_usage(v, 3), "retention": sections.retention(v, 3), "classes": sections.user_classes(v, 3), "heat": sections.hour_heatmap(v, 3),
        "dayparts": sections.dayparts(v, 3), "languages": sections.language_totals(v, 3), "topics": sections.topics(v, 3), "profile": sections.semester_profile(v, 3), "bins": sections.histogram(users, keys, "messages", sections.MESSAGE_BINS, 3),
        "minutes": sections.summary(sections.session_rows(v), keys, "minutes", 3), "trends": trends.sides(trends.measure(v), trends.pairs(v.win)),
    }
    return {name: sorted(map(str, t.select(sorted(t.columns)).collect())) for name, t in made.items()}


def test_weekly_runs_equal_a_rebuild_and_a_view_over_messages(spark, corpus, tmp_path):
    folder = str(tmp_path / "store")
    for day in (dt.date(2026, 2, 25), dt.date(2026, 3, 4), dt.date(2026, 3, 4), dt.date(2026, 4, 8)):
        grains.update(corpus, folder, extracted=day, **OPTIONS)
    assert [b[1] for b in grains.live(spark, folder)] == [dt.date(2026, 2, 16), dt.date(2026, 2, 23), dt.date(2026, 3, 30)]
    end = {"extracted": dt.date(2026, 4, 8)}
    by_weeks = tables(grains.view(corpus, folder, **end, **OPTIONS))
    at_once = tables(grains.stored(corpus, **end, **OPTIONS))
    raw = tables(facts.view(corpus, **end, **OPTIONS))
    for name in raw:
        assert by_weeks[name] == raw[name], name
        assert at_once[name] == raw[name], name


def test_axis_start_cuts_a_week(spark, corpus):
    options = {"extracted": dt.date(2026, 3, 11), "axis_start": dt.date(2026, 2, 12), **OPTIONS}
    stored, raw = tables(grains.stored(corpus, **options)), tables(facts.view(corpus, **options))
    assert stored == raw


def test_a_run_reads_its_own_weeks_only(spark, corpus, tmp_path):
    """Once a week is in the store its files are not opened again: here they are spoilt."""
    folder, table = str(tmp_path / "store"), tmp_path / "table"
    corpus.messages.write.partitionBy("week").parquet(str(table))
    mine = facts.Corpus(spark.read.schema(corpus.messages.schema).parquet(str(table)), corpus.students, corpus.roster, corpus.labels)
    grains.update(mine, folder, extracted=dt.date(2026, 3, 4), **OPTIONS)
    for f in table.glob("week=*/*.parquet"):
        if f.parent.name != "week=2026-W10":
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
            f.write_bytes(b"spoilt")
    with pytest.raises(Exception, match="spoilt|Parquet"):
        mine.messages.agg(facts.F.max("history_id")).collect()
    grains.update(mine, folder, extracted=dt.date(2026, 3, 11), **OPTIONS)
    weeks = {r["week"] for r in grains.view(corpus, folder, extracted=dt.date(2026, 3, 11), **OPTIONS).rows.select("week").distinct().collect()}
    assert weeks == {f"2026-W{w:02}" for w in range(6, 11)}


def test_since_builds_batches_anew(spark, corpus, tmp_path):
    folder = str(tmp_path / "store")
    for day in (dt.date(2026, 2, 25), dt.date(2026, 3, 11)):
        grains.update(corpus, folder, extracted=day, **OPTIONS)
    old = grains.live(spark, folder)
    moved = facts.Corpus(corpus.messages, corpus.students, corpus.roster.withColumn("status", facts.F.lit("staff")), corpus.labels)
    grains.update(moved, folder, extracted=dt.date(2026, 3, 11), since=dt.date(2026, 2, 23), **OPTIONS)
    new = grains.live(spark, folder)
    assert new[0] == old[0] and new[1][1] == old[1][1] and new[1][0] != old[1][0]
    levels = grains.view(moved, folder, extracted=dt.date(2026, 3, 11), **OPTIONS).rows
    assert "bachelor" not in {r["level"] for r in levels.filter("monday >= '2026-02-23'").select("level").distinct().collect()}
    assert "bachelor" in {r["level"] for r in levels.filter("monday < '2026-02-23'").select("level").distinct().collect()}


def test_erased_users_leave_the_store(spark, corpus, tmp_path):
    folder, options = str(tmp_path / "store"), {"extracted": dt.date(2026, 4, 8), **OPTIONS}
    for day in (dt.date(2026, 2, 25), dt.date(2026, 4, 8)):
        grains.update(corpus, folder, **options | {"extracted": day})
    old = grains.live(spark, folder)
    rest = facts.Corpus(corpus.messages.filter("pseudonym <> 'u3'"), corpus.students.filter("pseudonym <> 'u3'"), corpus.roster, corpus.labels)
    assert grains.erase(spark, folder, "u3") > 20 and grains.erase(spark, folder, "u3") == 0
    new = grains.live(spark, folder)
    assert [b[1] for b in new] == [b[1] for b in old] and not {b[0] for b in new} & {b[0] for b in old}
    assert {p.name for p in (tmp_path / "store" / "grain").glob("batch=*")} == {f"batch={b[0]}" for b in new}
    v, raw = grains.view(rest, folder, **options), facts.view(rest, **options)
    rows = lambda t: sorted(map(str, t.select(sorted(t.columns)).collect()))
    assert rows(sections.window_usage(v, 3)) == rows(sections.window_usage(raw, 3)) and rows(v.first_seen) == rows(raw.first_seen.join(v.first_seen.select("pseudonym"), "pseudonym"))


def test_trends_read_no_message_twice(spark, tmp_path):
    """The grain takes one scan of the messages; what follows scans small tables only."""
    folder = str(tmp_path)
    spark.range(400).select(facts.F.col("id").alias("o_orderkey"), (facts.F.col("id") % 17).alias("o_custkey"), facts.F.expr("timestamp_ntz'1995-03-01' + make_interval(0, 0, 0, cast(id as int))").alias("o_orderdate"), facts.F.lit("x").alias("o_orderpriority"), facts.F.lit("O").alias("o_orderstatus")).write.parquet(f"{folder}/orders.parquet")
    c = corpora.corpus(spark, folder, corpora.LONG)
    v = grains.stored(c, **corpora.options(corpora.LONG))
    assert "orders.parquet" not in " ".join(f for t in (v.rows, v.sess, v.topic, v.first_seen) for f in t.inputFiles())
    m = trends.measure(v)
    verdicts = trends.assess(trends.evaluate(m, 2), 2)
    assert len({f for f in verdicts.inputFiles() if "orders" in f or "grain" in f}) == 0 and verdicts.count() > 0
