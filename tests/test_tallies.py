"""A document from tallies against its sections counted one by one."""

import datetime as dt
from dataclasses import replace

import pytest
from test_grains import OPTIONS, corpus  # noqa: F401

from cohortlens.operators import facts, sections, trends
from cohortlens.plans import document
from cohortlens.sources import grains

FLOOR = 3


def counted(v):
    """The sections, each counted in the rows of the view."""
    users, sess, keys = sections.per_user_rows(v), sections.session_rows(v), ["window_id", "level"]
    windows, findings = trends.section(v, FLOOR)
    plain = {
        "weekly_activity": sections.weekly_activity, "weekly_registrations": sections.weekly_registrations, "weekly_language": sections.weekly_language, "usage": sections.window_usage, "retention": sections.retention, "classes": sections.user_classes,
        "heatmap": sections.hour_heatmap, "dayparts": sections.dayparts, "languages": sections.language_totals, "topics": sections.topics, "profile": sections.semester_profile,
    }
    binned = {"user_messages": (users, "messages", sections.MESSAGE_BINS), "user_weeks": (users, "weeks", sections.SESSION_BINS), "session_messages": (sess, "n_messages", sections.SESSION_BINS), "session_minutes": (sess, "minutes", sections.MINUTE_BINS)}
    found = {name: of(v, FLOOR) for name, of in plain.items()} | {name: sections.histogram(rows, keys, x, bins, FLOOR) for name, (rows, x, bins) in binned.items()}
    found |= {"user_messages_summary": sections.summary(users, keys, "messages", FLOOR), "session_minutes_summary": sections.summary(sess, keys, "minutes", FLOOR, with_mean=False)}
    return found | {"windows": v.win, "trends": windows, "findings": findings}


@pytest.fixture(scope="module")
def odd(spark, corpus):  # noqa: F811
    """Also messages of no user, a user who wrote only before the axis starts but registers after that, and one whose only
    session begins on one level's last day, in a week with both levels."""
    at = lambda *t: dt.datetime(2026, *t)
    ms = lambda t: int(t.replace(tzinfo=dt.UTC).timestamp() * 1000)
    rows = [(2000, None, at(2, 10, 9)), (2001, None, at(3, 20, 9)), (2002, "early", at(2, 3, 9)), (2003, "u0", at(2, 24, 9)), (2004, "u0", at(2, 27, 9)), (2005, "u0", at(3, 1, 9)), (2006, "u9", at(2, 28, 22))]
    rows = [(i, u, ms(t), t, "{}-W{:02}".format(*t.isocalendar()[:2])) for i, u, t in rows]
    messages = corpus.messages.unionByName(spark.createDataFrame(rows, corpus.messages.schema))
    students = corpus.students.unionByName(spark.createDataFrame([("early", at(3, 3)), (None, at(3, 3)), ("n", at(3, 30)), ("never", at(3, 4)), ("u1", at(3, 17))], corpus.students.schema))
    labels = corpus.labels.unionByName(spark.createDataFrame([(i, "codes", "emergent_theme", f"c{i % 70:02}", 1) for i in range(300)] + [(i, "codes", "deductive", "english_input", 1) for i in range(0, 300, 7)], corpus.labels.schema))
    return replace(corpus, messages=messages, students=students, labels=labels)


@pytest.mark.parametrize("kind", ["stored", "messages"])
def test_tallies_give_what_each_section_counts(odd, kind):
    options = {"extracted": dt.date(2026, 4, 8), "axis_start": dt.date(2026, 2, 5), **OPTIONS}
    v = grains.stored(odd, **options) if kind == "stored" else facts.view(odd, **options)
    rows = lambda t: sorted(map(str, t.select(sorted(t.columns)).collect()))
    made, plain = document.build(v, FLOOR), counted(v)
    assert set(made) == set(plain)
    for name in plain:
        assert rows(made[name]) == rows(plain[name]), name
        assert dict(made[name].dtypes) == dict(plain[name].dtypes), name


def test_a_document_reads_no_grain_again(odd):
    """However many sections and rules there are, the grain is read by the tallies alone."""
    v = grains.stored(odd, extracted=dt.date(2026, 4, 8), **OPTIONS)
    assert any("grain" in f for f in v.rows.inputFiles())
    made = document.build(v, FLOOR)
    assert not [f for t in made.values() for f in t.inputFiles() if "grain" in f or "messages" in f]
    assert {r["rule"]: r["n"] for r in document.report(v, FLOOR, dt.date(2026, 4, 5)).collect() if r["n"]} == {}
