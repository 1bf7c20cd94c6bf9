"""Chat logs and URL lists, and every query that SQL can express."""

import datetime

import compare
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattledger.llm import chat, queries, url_filters

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, oracle, name):
    assert compare.differences(queries.QUERIES[name](spark, SF_DIR), oracle, queries.ORACLE_SQL[name]) == []


def test_all_operators_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


EVENTS = "conv_id bigint, message string, seq bigint, kind string, role string, text string, turns string"


def fold(spark, rows):
    return {(r.conv_id, r.at): (r.role, r.text) for r in chat.fold(spark.createDataFrame([(*r, "x") for r in rows], EVENTS)).collect()}


def test_streams_edits_and_regenerations(spark):
    rows = [
        (1, "a", 1, "start", "user", None), (1, "a", 2, "delta", None, "Hel"), (1, "a", 3, "delta", None, "lo"),
        (1, "b", 4, "start", "assistant", None), (1, "b", 6, "delta", None, "y"), (1, "b", 5, "delta", None, "x"),
        (1, "b", 7, "regenerate", None, "dropped"), (1, "b", 8, "delta", None, "new "), (1, "b", 9, "delta", None, "answer"),
        (1, "a", 10, "edit", None, "Hi"), (1, "a", 11, "delta", None, "!"),
        (2, "a", 1, "delta", "user", None), (2, "z", 5, "edit", "user", "one"), (2, "z", 5, "edit", "user", "two"),
        (3, "q", None, "delta", None, "null place"), (3, "r", 0, None, "user", "null kind"), (4, "e", 1, "regenerate", "user", "gone"),
    ]
    assert fold(spark, rows) == {
        (1, 1): ("user", "Hi!"), (1, 4): ("assistant", "new answer"), (2, 1): ("user", ""), (2, 5): ("user", "two"),
        (3, -(1 << 62)): ("", "null place"), (3, 0): ("user", "null kind"), (4, 1): ("user", ""),
    }


def test_long_conversations_keep_their_order(spark):
    rows = [(i % 3, str(i), i, "delta", "user", f"{i} ") for i in range(3000)]
    got = chat.read_back(chat.render(chat.fold(spark.createDataFrame([(*r, "x") for r in rows], EVENTS))))
    for r in got.collect():
        assert [int(t.text) for t in r.turns] == list(range(r.conv_id, 3000, 3))


TEXT = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "<", "/", "turn>", "\n", " ", "### Assistant ###\n", "a", "é", "$1"]), max_size=12).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(TEXT | st.none(), TEXT | st.none()), min_size=1, max_size=40))
def test_any_text_is_read_back(spark, turns):
    rows = [(1, str(i), i, "delta", role, text, "x") for i, (role, text) in enumerate(turns)]
    got = chat.read_back(chat.render(chat.fold(spark.createDataFrame(rows, EVENTS))))
    back = got.selectExpr("posexplode(turns)").select("pos", chat.unescape("col.role").alias("role"), chat.unescape("col.text").alias("text"))
    assert [(r.role, r.text) for r in sorted(back.collect())] == [(role or "", text or "") for role, text in turns]


def test_odd_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, seq string"
    rows = [(1, 0, "user", None, ""), (1, 0, "user", None, ""), (1, 1, "assistant", "same", ""), (1, 1, "assistant", "same", ""),
            (None, 0, "user", "x", ""), (2, None, "user", "later", ""), (2, 0, None, "t", "")]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.render(chat.fold(
        chat.events_of(spark.createDataFrame(rows, schema))))).collect()}
    assert got == {1: [("user", "")] * 2 + [("assistant", "same")] * 2, None: [("user", "x")], 2: [("user", "later"), ("", "t")]}
    assert chat.render(chat.fold(chat.events_of(spark.createDataFrame([], schema)))).count() == 0


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


ENTRIES = "kind string, key string, action string, day date, added boolean, id int"


def test_entries_hold_from_their_day_to_the_next_row(spark):
    log = [
        ("host", "a.b", "block", day(0), True, 0), ("host", "a.b", "block", day(5), False, 0), ("host", "a.b", "block", day(9), True, 0),
        ("host", "a.b", "block", day(9), True, 0), ("url", "u", "allow", day(3), True, 0), ("url", "u", "allow", day(3), False, 0),
        ("host", "c", "block", day(1), None, 0), (None, "x", "block", day(1), True, 0), ("host", None, "block", day(1), True, 0), ("host", "x", "block", None, True, 0),
    ]
    got = {tuple(r) for r in url_filters.intervals(spark.createDataFrame(log, ENTRIES)).collect()}
    forever = datetime.date(9999, 12, 31)
    assert got == {("host", "a.b", "block", day(0), day(5)), ("host", "a.b", "block", day(9), forever), ("host", "c", "block", day(1), forever)}


def test_the_most_specific_active_entry_decides(spark):
    log = [
        ("domain", "b.com", "block", day(0), True, 0), ("host", "ok.b.com", "allow", day(2), True, 0), ("prefix", "ok.b.com/bad/", "block", day(4), True, 0),
        ("url", "ok.b.com/bad/good", "allow", day(6), True, 0), ("host", "tie.org", "allow", day(0), True, 0), ("host", "tie.org", "block", day(0), True, 0),
    ]
    url = "https://user@OK.b.com:8080/bad/good?q=1#x"
    captures = [(i, url, day(d), "k") for i, d in enumerate((-1, 0, 2, 4, 6))]
    captures += [(10, "http://tie.org", day(1), "k"), (11, None, day(9), "k"), (12, "no url", day(9), "k"), (13, url, None, "k"), (14, url, day(0), "k"),
                 (14, url, day(0), "k"), (14, "http://other.net/", day(0), "k"), (None, url, day(0), "k"), (15, "http://x.b.com", day(0), "k")]
    frame = spark.createDataFrame(captures, "id bigint, url string, fetched date, kind string")
    got = sorted(((r.id, r.n_entries, r.kind, r.blocked) for r in url_filters.judge(frame, spark.createDataFrame(log, ENTRIES)).collect()), key=str)
    assert got == sorted([
        (0, 0, None, False), (1, 1, "domain", True), (2, 2, "host", False), (3, 3, "prefix", True), (4, 4, "url", False), (10, 2, "host", True),
        (11, 0, None, False), (12, 0, None, False), (13, 0, None, False), (14, 1, "domain", True), (14, 1, "domain", True), (14, 0, None, False),
        (None, 1, "domain", True), (15, 1, "domain", True)], key=str)
    assert url_filters.judge(frame.limit(0), spark.createDataFrame(log, ENTRIES)).count() == 0
    assert not url_filters.judge(frame, spark.createDataFrame([], ENTRIES)).filter("blocked").count()


@pytest.mark.parametrize("name", ["op3_chat_format", "op6_url_filters"])
def test_native_operators_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
