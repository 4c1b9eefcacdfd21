"""Hand-made corpora, guards, labels, ingest and streams."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import facts, guard, labels, sections, trends
from cohortlens.plans import document
from cohortlens.sources import files, ingest
from cohortlens.streaming.ingest import ingest_available

MSG = "history_id long, pseudonym string, session_started long, created_at timestamp_ntz"


#: Milliseconds of 8 March 2026.
BEGAN = 1_772_928_000_000


def corpus(spark, rows, roster=(), codes=(), students=()):
    def frame(data, schema):
        return spark.createDataFrame(list(data), schema)

    return facts.Corpus(frame(rows, MSG), frame(students, "pseudonym string, registered_at timestamp_ntz"), frame(roster, "pseudonym string, status string, ma_start_semester string"), frame(codes, "history_id long, label_version string, domain string, code string, value int"))


def at(day, hour=9):
    return dt.datetime(2026, 3, day, hour)


@pytest.fixture(scope="module")
def view(spark):
    # Week 11 (from 9 March) has three users, week 12 two, week 13 none; extraction runs in week 14.
    rows = [(1, "a", 1, at(9)), (2, "a", 1, at(9, 10)), (3, "b", 2, at(10)), (4, "c", 3, at(11)), (5, "a", 4, at(16)), (6, "b", 5, at(17)), (7, "b", 5, at(17, 11)), (8, "a", 6, at(30)), (9, "a", 1, at(9, 11))]
    rows = [(i, u, BEGAN + s, t) for i, u, s, t in rows]
    c = corpus(spark, rows, [("a", "bachelor", "2026S"), ("b", "staff", None)], [(1, "v1", "language", "de", 1), (3, "v1", "method_theme", "x", 1)], [("a", at(9)), ("d", at(10)), ("e", None)])
    return facts.view(c, extracted=dt.date(2026, 4, 1))


def test_weekly(view):
    got = {(r["week"], r["measure"]): (r["status"], r["value"]) for r in sections.weekly_activity(view, 3).filter("level = 'all'").collect()}
    assert got["2026-W11", "messages"] == ("ok", 5) and got["2026-W11", "active_users"] == ("ok", 3)
    assert got["2026-W12", "messages"] == ("suppressed", None) and got["2026-W13", "sessions"] == ("ok", 0)
    assert ("2026-W14", "messages") not in got


def test_windows(view):
    got = {r["window_id"]: (r["first_week"], r["last_week"], r["in_progress"]) for r in view.win.collect()}
    assert got == {"all_time": ("2026-W11", "2026-W13", False), "2026S": ("2026-W11", "2026-W13", True), "2026S.last4": ("2026-W11", "2026-W13", False), "2026S.last1": ("2026-W13", "2026-W13", False)}


def test_levels_and_language(view):
    got = {r["history_id"]: (r["level"], r["lang"]) for r in facts.spoken(view.msg, view).collect()}
    assert got[1] == ("master", "de") and got[3] == ("staff", "undetermined") and got[4] == ("unknown", "undetermined")


def test_session_over_midnight_has_one_level(spark):
    """The session starts on the last day before the term; a staff user has the own status until then."""
    late = int(dt.datetime(2026, 2, 28, 22, 30, tzinfo=dt.UTC).timestamp() * 1000)
    rows = [(1, "a", late, dt.datetime(2026, 2, 28, 22, 30)), (2, "a", late, dt.datetime(2026, 3, 1, 8)), (3, "s", late, dt.datetime(2026, 3, 1, 8)), (4, "s", late + 86_400_000, dt.datetime(2026, 3, 2, 8))]
    v = facts.view(corpus(spark, rows, [("a", "bachelor", "2026S"), ("s", "staff", "2026S")]), extracted=dt.date(2026, 4, 1))
    assert {r["history_id"]: r["level"] for r in v.msg.collect()} == {1: "bachelor", 2: "bachelor", 3: "staff", 4: "master"}


def test_label_versions_are_apart(spark):
    codes = [(1, "new", "method_theme", "x", 1), (1, "new", "language", "other", 1), (1, "lang", "language", "de", 1), (1, "lang", "method_theme", "old", 1)]
    v = facts.view(corpus(spark, [(1, "a", BEGAN, at(9))], codes=codes), extracted=dt.date(2026, 4, 1), label_version="new", language_version="lang")
    assert [r["lang"] for r in facts.spoken(v.rows, v).collect()] == ["de"] and [r["code"] for r in v.positives.collect()] == ["x"]


def test_sessions(view):
    got = {(r["pseudonym"], r["session_started"]): (r["n_messages"], r["minutes"]) for r in view.sess.collect()}
    assert got["a", BEGAN + 1] == (3, 120.0) and got["b", BEGAN + 5] == (2, 120.0)


def test_registrations(view):
    got = {r["measure"]: r["value"] for r in sections.window_usage(view, 1).filter("window_id = 'all_time' and level = 'all'").collect()}
    assert got["new_registrations"] == 2 and got["new_registrations_active"] == 1


def test_retention_hides_both_sides(view):
    got = {(r["kind"], r["status"]) for r in sections.retention(view, 3).filter("window_id = '2026S.last4' and level = 'unknown'").collect()}
    assert got == {("new", "suppressed"), ("returning", "suppressed")}


def test_joint_floor_leaves_no_lone_cell(view):
    usage = sections.window_usage(view, 3)
    assert guard.no_recoverable_partition(usage).first()["n"] == 0
    assert {r["status"] for r in usage.filter("window_id = 'all_time' and measure = 'messages' and level <> 'all'").collect()} == {"suppressed"}


def test_first_seen_before_axis(spark):
    c = corpus(spark, [(1, "a", 1, at(2)), (2, "a", 2, at(16)), (3, "b", 3, at(16))])
    v = facts.view(c, extracted=dt.date(2026, 4, 1), axis_start=dt.date(2026, 3, 9))
    got = {r["kind"]: r["value"] for r in sections.retention(v, 1).filter("window_id = 'all_time' and level = 'all'").collect()}
    assert got == {"new": 1, "returning": 1} and v.msg.count() == 2


def test_empty_corpus(spark):
    v = facts.view(corpus(spark, []), extracted=dt.date(2026, 4, 1))
    assert v.win.count() == 0 and sections.weekly_activity(v, 3).count() == 0 and trends.evaluate(v, 3).count() == 0


def test_message_without_time_raises(spark):
    with pytest.raises(Exception, match="without created_at"):
        facts.enrich(corpus(spark, [(1, "a", 1, None)]).messages).collect()


def test_user_classes(spark):
    days = {"once": [9], "both": [1, 31], "spread": [2, 12]}
    rows = [(u, dt.datetime(2026, 3, d, 9)) for u, ds in days.items() for d in ds] + [("often", dt.datetime(2026, 3, 1, 9) + dt.timedelta(days=10 * i)) for i in range(5)]
    df = spark.createDataFrame([("w", *r) for r in rows], "w string, pseudonym string, local timestamp")
    got = {r["pseudonym"]: (r["class"], r["frequent"]) for r in sections.user_profiles(sections.day_grain(df, "w"), ["w"]).collect()}
    assert got == {"once": ("one_time", False), "both": ("sporadic", False), "spread": ("sporadic", False), "often": ("monthly", True)}


def test_value_without_bin_raises(spark):
    with pytest.raises(Exception, match="fits no bin"):
        sections.histogram(spark.createDataFrame([("w", "a", 0)], "w string, pseudonym string, x int"), ["w"], "x", sections.SESSION_BINS, 1).collect()


def test_planted_shift_is_found(spark, tmp_path, monkeypatch):
    rows, codes, i = [], [], 0
    for start, share in ((dt.date(2025, 10, 6), 20), (dt.date(2026, 3, 9), 60)):
        for d in range(60):
            for u in range(4):
                i += 1
                rows.append((i, f"u{(d + u) % 12}", i, dt.datetime.combine(start + dt.timedelta(days=d), dt.time(9))))
                if (i * 37) % 100 < share:
                    codes.append((i, "v1", "method_theme", "shifted", 1))
    v = facts.view(corpus(spark, rows, codes=codes), extracted=dt.date(2026, 7, 1))
    got = {r["candidate"]: (r["verdict"], r["evidence"]) for r in trends.assess(trends.evaluate(v, 3), 3).filter("window_id = '2026S'").collect()}
    assert got["topics-method_theme-shifted"] == ("published", "robust")
    assert {r["window_id"]: (r["baseline"], r["insufficient_data"]) for r in trends.sufficient(v, trends.assess(trends.evaluate(v, 3), 3)).collect()} == {"2025W": (None, False), "2026S": ("2025W", False), "all_time": ("trajectory", False)}
    through = dt.date(2026, 6, 28)
    document.publish(v, str(tmp_path / "out"), "v1", 3, through)
    assert files.read_latest(spark, str(tmp_path / "out")).count() == v.win.count()
    # a document that does not end with that Sunday is refused, and v1 stays the latest
    tables = {name: spark.read.parquet(str(tmp_path / "out" / "sections" / "v1" / name)) for name in document.build(v, 3)}
    late = document.rules(tables, v, 3, through + dt.timedelta(days=7))
    with pytest.raises(ValueError, match="coverage_ordered"):
        files.publish(tables["windows"], str(tmp_path / "out"), "v2", late)
    assert files.read_latest(spark, str(tmp_path / "out")).count() == v.win.count()


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 40), st.integers(0, 23)), max_size=80), st.integers(1, 5))
def test_no_finding_below_the_floor(spark, messages, floor):
    rows = [(i, f"u{u}", i, dt.datetime(2025, 10, 6) + dt.timedelta(weeks=w, hours=h)) for i, (u, w, h) in enumerate(messages)]
    v = facts.view(corpus(spark, rows), extracted=dt.date(2026, 8, 1))
    got = trends.assess(trends.evaluate(v, floor), floor).filter("verdict = 'published'").collect()
    assert all(min(r["users_1"], r["users_2"]) >= floor for r in got)


def test_guard_finds_faults(spark):
    cells = spark.createDataFrame([("w", "all", "messages", "ok", 9), ("w", "bachelor", "messages", "suppressed", 2), ("w", "x", "messages", "ok", 7)], "window_id string, level string, measure string, status string, value long")
    assert guard.suppressed_bare(cells).first()["n"] == 1 and guard.no_recoverable_partition(cells).first()["n"] == 1 and guard.levels_known(cells).first()["n"] == 1
    assert guard.tiles(spark.createDataFrame([("a", 0, 6), ("b", 7, 24)], "name string, from_hour int, to_hour int")).first()["n"] == 1
    assert guard.bins_ascend(spark.createDataFrame([("k", 0, 1, 3), ("k", 1, 3, None)], "k string, bin int, lo int, hi int"), ["k"]).first()["n"] == 1
    with pytest.raises(ValueError, match="suppressed_bare"):
        guard.require_clean(guard.suppressed_bare(cells))


def test_upsert_last_wins(spark):
    schema = "history_id long, label_version string, domain string, code string, value int"
    old = spark.createDataFrame([(1, "v", "d", "c", 0), (2, "v", "d", "c", 0)], schema)
    new = spark.createDataFrame([(1, "v", "d", "c", 1, 1), (1, "v", "d", "c", 5, 2), (3, "v", "d", "c", 7, 1)], schema + ", at int")
    assert {(r["history_id"], r["value"]) for r in labels.upsert(old, new, labels.KEY, "at").collect()} == {(1, 5), (2, 0), (3, 7)}


@pytest.mark.parametrize(("text", "reason"), [("| message | A |\n|--|--|\n| 1 | 1 |\n| 2 | 0 |", None), ("| nope | A |\n|--|--|\n| 1 | 1 |\n| 2 | 0 |", "header"), ("| message | A |\n|--|--|\n| 1 | 1 | 0 |\n| 2 | 0 |", "width"), ("| message | A |\n|--|--|\n| 1 | 1 |", "rows"), ("| message | A |\n|--|--|\n| 1 | 1 |\n| 1 | 0 |", "duplicate"), ("| message | A |\n|--|--|\n| 1 | x |\n| 2 | 0 |", "value"), ("", "header")])
def test_parse_binary(spark, text, reason):
    good, bad = labels.parse_binary(spark.createDataFrame([(1, [1, 2], text)], "batch long, expected array<long>, text string"), ("A",))
    assert good.count() == (2 if reason is None else 0)
    assert [r["reason"] for r in bad.collect()] == ([] if reason is None else [reason])


def test_normal_codes(spark):
    row = spark.createDataFrame([([" A  b", "a b", "one two three four five six", ""],)], "c array<string>").select(labels.normal_codes(F.col("c"))).first()
    assert row[0] == ["a b"]


LINES = "line long, uid string, status string, ma_start_semester string, source string"


def test_roster_rejects(spark):
    raw = spark.createDataFrame([(2, " U1 ", "bachelor", "2024W", "t"), (3, "u1", "bachelor", "2024W", "t"), (4, "", "staff", "", "t"), (5, "u2", "guest", "", "t"), (6, "u3", "bachelor", "24W", "t"), (7, "u4", "staff", "2024W", "t"), (8, "u5", "master", None, " "), (9, "u6", "master", "", "t")], LINES)
    good, bad = files.check_roster(raw, b"k")
    assert {(r["status"], r["ma_start_semester"]) for r in good.collect()} == {("bachelor", "2024W"), ("master", None)}
    assert {(r["line"], r["fault"]) for r in bad.collect()} == {(3, "duplicate"), (4, "uid"), (5, "status"), (6, "ma_start_semester"), (7, "ma_start_semester"), (8, "source")}


def test_roster_import(spark, tmp_path):
    path = tmp_path / "roster.csv"
    path.write_text("source,uid,status,ma_start_semester\nt, U1 ,bachelor,2024W\n\nt,\"u2\",staff,\n")
    raw = files.read_lines(spark, str(path), files.ROSTER)
    assert [r["line"] for r in raw.orderBy("line").collect()] == [2, 4]
    name = lambda u: spark.range(1).select(files.text.hmac_sha256(files.text.normal_uid(F.lit(u)), b"k")).first()[0]
    stored = spark.createDataFrame([(name("u1"), "master", None, "old"), (name("u9"), "staff", None, "old")], "pseudonym string, status string, ma_start_semester string, provenance string")
    students = spark.createDataFrame([(name("u1"),), (name("u7"),), (name("u8"),)], "pseudonym string")
    merged, n = files.import_roster(stored, raw, students, b"k")
    assert {r["pseudonym"]: (r["status"], r["provenance"]) for r in merged.collect()} == {name("u1"): ("bachelor", "t"), name("u2"): ("staff", "t"), name("u9"): ("staff", "old")}
    assert tuple(n.first()) == (2, 2)
    path.write_text("uid,status\nu,staff\n")
    with pytest.raises(ValueError, match="missing"):
        files.read_lines(spark, str(path), files.ROSTER)
    with pytest.raises(ValueError, match="line 2"):
        files.import_roster(stored, spark.createDataFrame([(2, "", "staff", "", "t")], LINES), students, b"k")


def test_coded_import(spark):
    c = corpus(spark, [(1, "a", 5, at(9)), (2, "b", 6, at(9))])
    coded = lambda started, value: spark.createDataFrame([(1, "Master_sample", started, value), (2, "x", 6, 0)], "history_id long, group string, started long, `Good One` int")
    got = {(r["history_id"], r["code"]): (r["value"], r["provenance"]) for r in files.import_coded(c.messages, coded(5, 1), ["Good One"]).collect()}
    assert got == {(1, "good_one"): (1, "consensus"), (2, "good_one"): (0, "single_coder")}
    with pytest.raises(ValueError, match="session start"):
        files.import_coded(c.messages, coded(4, 1), ["Good One"])
    with pytest.raises(Exception, match="neither 0 nor 1"):
        files.import_coded(c.messages, coded(5, 2), ["Good One"]).collect()


def test_theme_sets(spark):
    codes = spark.createDataFrame([("a", "A code"), ("b", "B code"), ("c", "C code")], "code string, description string")
    assert labels.theme_faults(codes).count() == 0 and {r["rule"] for r in labels.theme_faults(codes.limit(2)).collect()} == {"rows"}
    none = spark.createDataFrame([], "set_version string, code string, description string, reviewed_at timestamp")
    sets = labels.freeze(labels.freeze(none, codes, "s1"), codes.withColumn("description", F.lit("other")), "s2")
    with pytest.raises(ValueError, match="exists"):
        labels.freeze(sets, codes, "s1")
    cells = spark.createDataFrame([("a", 1), ("z", 2)], "code string, value int")
    assert {r["code"]: r["description"] for r in sections.describe_codes(cells, sets, "s1").collect()} == {"a": "A code", "z": None}


def test_weekly_ingest(spark, tmp_path):
    store = str(tmp_path / "store")
    students = spark.createDataFrame([(1, "U1", at(1)), (2, "u2", None), (3, " u1", at(2))], "student_id long, uid string, created_at timestamp_ntz")
    history = spark.createDataFrame([(1, 1, 5, at(9)), (2, 2, 6, at(10)), (3, 3, 7, at(20))], "id long, student_id long, started long, created_at timestamp_ntz")
    assert ingest.ingest(spark, store, students, history.filter("id < 3"), b"k") == 2
    assert ingest.ingest(spark, store, students, history, b"k") == 1
    before = files.read_watermark(spark, f"{store}/watermark")
    assert ingest.ingest(spark, store, students, history, b"k") == 0
    after = files.read_watermark(spark, f"{store}/watermark")
    assert before[0] == after[0] == 3 and after[1] > before[1]
    got = spark.read.parquet(f"{store}/messages")
    assert got.count() == 3 and {r["week"] for r in got.collect()} == {"2026-W11", "2026-W12"}
    known = spark.read.parquet(f"{store}/students").collect()
    assert len(known) == 1 and known[0]["registered_at"] == at(1)


def test_guard_rules_each_find_their_fault(spark, view):
    usage = "window_id string, level string, measure string, status string, value long"
    n = lambda rule: rule.first()["n"]
    assert n(guard.no_small_remainder(spark.createDataFrame([("w", "all", "messages", "ok", 9), ("w", "bachelor", "messages", "ok", 8)], usage), 3)) == 1
    assert n(guard.no_small_remainder(spark.createDataFrame([("w", "all", "messages", "ok", 9), ("w", "bachelor", "messages", "ok", 5)], usage), 3)) == 0
    summary = spark.createDataFrame([("w", "suppressed", 2, None), ("v", "ok", 2, 1.0)], "window_id string, status string, n_users long, median double")
    assert n(guard.floor_respected(summary.select("n_users"), 3)) == 2
    full = summary.select("status", "n_users", "median", *[F.lit(None).cast("double").alias(c) for c in ("p25", "p75", "mean", "sd")])
    assert n(guard.summaries_bare(full)) == 1
    win = view.win
    axis_end = dt.date(2026, 3, 29)
    assert n(guard.coverage_ordered(win, view.axis, axis_end)) == 0 and n(guard.coverage_ordered(win, view.axis, axis_end - dt.timedelta(days=1))) == 1
    assert n(guard.slices_contiguous(view.win_week.filter("week <> '2026-W12'"), win)) == 1
    assert n(guard.windows_resolve(win.filter("kind <> 'semester'"), view.win.select("window_id"))) == 3
    assert n(guard.enrollment_terms(spark.createDataFrame([("2026S",), ("1990S",)], "window_id string"), win)) == 1
    points = "array<struct<term: string, value: double, n_users: long>>"
    findings = f"window_id string, tab string, users_1 long, users_2 long, trajectory {points}"
    windows = spark.createDataFrame([("all_time", "trajectory", False), ("2026S", None, True)], "window_id string, baseline string, insufficient_data boolean")
    good = [("all_time", "topics", 5, 5, [("2026S", 1.0, 5)])]
    # a window that lacks a baseline but is insufficient; then one fault more each
    assert n(guard.trend_rules(spark.createDataFrame(good, findings), windows, win)) == 1
    assert n(guard.trend_rules(spark.createDataFrame([("2026S", "topics", 5, 5, None)], findings), windows, win)) == 2
    assert n(guard.trend_rules(spark.createDataFrame([("all_time", "topics", 5, 5, None)], findings), windows, win)) == 2
    assert n(guard.trend_rules(spark.createDataFrame([("all_time", "topics", 5, 5, [("1990S", 1.0, 5)])], findings), windows, win)) == 2
    assert n(guard.trend_rules(spark.createDataFrame(good * 4, findings), windows, win)) == 2
    assert n(guard.floor_respected(spark.createDataFrame([("all_time", "topics", 5, 5, [("2026S", 1.0, 2)])], findings), 3)) == 1
    parts = spark.createDataFrame([("w", "all", "grid", 1, "night")], "window_id string, level string, shape string, dow int, part string")
    assert n(guard.dense_over(parts, parts.unionByName(parts.withColumn("dow", F.lit(2))), parts.columns, "dayparts_dense")) == 1
    profile = spark.createDataFrame([("2026S", "messages", 1), ("2026S", "messages", 3)], "window_id string, measure string, semester_week int")
    assert n(guard.profiles_ascend(profile, win)) == 1


def test_erase(spark):
    c = corpus(spark, [(1, "a", 1, at(9)), (2, "b", 2, at(9))], [("a", "staff", None)], [(1, "v1", "language", "de", 1), (2, "v1", "language", "de", 1)])
    kept, n = ingest.erase({"messages": c.messages, "roster": c.roster, "labels": c.labels}, "a")
    assert {r["table"]: r["erased"] for r in n.collect()} == {"messages": 1, "roster": 1, "labels": 1}
    assert [r["history_id"] for r in kept["labels"].collect()] == [2] and kept["roster"].count() == 0


def test_key_interlock():
    own = ingest.check_key(None, b"k")
    assert ingest.check_key(own, b"k") == own
    with pytest.raises(ValueError):
        ingest.check_key(own, b"other")
    with pytest.raises(ValueError):
        ingest.check_key(None, b"k", adopt=False)


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        files.read_latest(spark, folder)
    files.publish(spark.range(3), folder, "v1")
    with pytest.raises(Exception, match="already exists"):
        files.publish(spark.range(5), folder, "v1")
    files.publish(spark.range(5), folder, "v2")
    assert files.read_latest(spark, folder).count() == 5
    assert files.read_watermark(spark, str(tmp_path / "wm")) is None
    files.write_watermark(spark, str(tmp_path / "wm"), 42)
    assert files.read_watermark(spark, str(tmp_path / "wm"))[0] == 42


def test_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"2024W":\n {"bachelor": 10, "master": 5, "source": "x", "as_of": "2024-10-01"}}')
    assert {(r["window_id"], r["level"], r["enrolled"]) for r in files.read_enrolled(spark, str(tmp_path / "t.json")).collect()} == {("2024W", "bachelor", 10), ("2024W", "master", 5)}
    (tmp_path / "c.csv").write_bytes("ID,group,started,A\n1,Master_sample,5,1\n".encode("latin-1"))
    assert files.read_coded(spark, str(tmp_path / "c.csv"), ["A"]).first()["A"] == 1
    with pytest.raises(ValueError, match="missing"):
        files.read_coded(spark, str(tmp_path / "c.csv"), ["B"])


def test_stream_ingest(spark, tmp_path):
    students = spark.createDataFrame([(1, "u1"), (2, "u2")], "student_id long, uid string")
    run = lambda: ingest_available(spark, str(tmp_path / "in"), students, b"k", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    write = lambda rows: spark.createDataFrame(rows, "id long, student_id long, started long, created_at timestamp_ntz").write.mode("append").parquet(str(tmp_path / "in"))
    write([(1, 1, 5, at(9)), (2, 2, 6, at(16)), (2, 2, 6, at(16))])
    for _ in range(2):  # the second run finds nothing new
        run()
    write([(2, 2, 6, at(16)), (3, 1, 7, at(17))])
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["history_id"] for r in got.collect()) == [1, 2, 3] and {len(r["pseudonym"]) for r in got.collect()} == {64}
    # a batch that is written but not committed comes again and replaces itself
    for f in (tmp_path / "cp" / "commits").glob("*1*"):
        f.unlink()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
