"""Tables that change together, pulls since a clock, and the whole cycle with its failures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import changelog as cl
from tallyspark.operators import cycle as cy
from tallyspark.operators import lifecycle as lc
from tallyspark.operators.commit import Conflict, State


def numbers(spark, *n):
    return spark.createDataFrame([(k,) for k in n], "k int")


def held(state, name):
    return sorted(r[0] for r in state.read(name).collect())


def test_tables_of_a_state_change_together(spark, tmp_path):
    root = f"{tmp_path}/s"
    one = State(spark, root)
    assert one.version == 0 and one.read("a", "k int").count() == 0
    with pytest.raises(KeyError):
        one.read("a")
    assert one.commit({"a": numbers(spark, 1), "b": numbers(spark, 2)}) == 1
    old = State(spark, root)
    assert one.commit({"a": numbers(spark, 3)}) == 2
    assert (held(old, "a"), held(old, "b")) == ([1], [2])  # a reader keeps its version
    assert (held(old.refresh(), "a"), held(old, "b"), old.versions()) == ([3], [2], [1, 2])


def test_a_failure_between_two_writes_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/s"
    State(spark, root).commit({"a": numbers(spark, 1), "b": numbers(spark, 1)})
    state, write = State(spark, root), State._write

    def fails_on_b(self, df, folder):
        if "/b-" in folder:
            raise RuntimeError("lost")
        write(self, df, folder)

    monkeypatch.setattr(State, "_write", fails_on_b)
    with pytest.raises(RuntimeError):
        state.commit({"a": numbers(spark, 2), "b": numbers(spark, 2)})
    monkeypatch.setattr(State, "_write", write)
    after = State(spark, root)
    assert (after.version, held(after, "a"), held(after, "b"), held(state, "a")) == (1, [1], [1], [1])
    assert after.commit({"a": numbers(spark, 2), "b": numbers(spark, 2)}) == 2
    assert after.vacuum(keep=1) == 3  # two of the first version and what the failed commit left
    assert (held(State(spark, root), "a"), State(spark, root).versions()) == ([2], [2])


def test_of_two_commits_on_one_version_one_fails(spark, tmp_path):
    root = f"{tmp_path}/s"
    one, two = State(spark, root), State(spark, root)
    one.commit({"a": numbers(spark, 1)})
    with pytest.raises(Conflict):
        two.commit({"a": numbers(spark, 2)})
    assert held(two.refresh(), "a") == [1] and two.commit({"a": numbers(spark, 2)}) == 2


# clocks

T = "2024-03-15T10:30:45.{}Z-{}-{}"


def messages(spark, *stamps):
    return spark.createDataFrame([("t", f"r{k}", "c", f"S:{k}", x) for k, x in enumerate(stamps)], "dataset string, row string, column string, value string, timestamp string")


def test_clocks_are_ordered_by_time_counter_and_client(spark):
    stamps = [T.format("123", "0001", "B"), T.format("123", "0001", "C"), T.format("123", "0002", "A"), T.format("124", "0000", "A"), T.format("123", "10000", "A"), "no clock", None, T.format("122", "FFFF", "Z")]
    log = messages(spark, *stamps)
    behind = lambda since: sorted(r["row"] for r in cl.newer(log, since).collect())
    assert behind(stamps[0]) == ["r1", "r2", "r3", "r4"] and behind(stamps[2]) == ["r3", "r4"] and behind(stamps[4]) == ["r3"] and behind(stamps[3]) == []
    assert behind("broken") == behind(cl.EPOCH) == ["r0", "r1", "r2", "r3", "r4", "r7"]
    assert cl.advanced(log, cl.EPOCH) == stamps[3] and cl.advanced(log.limit(0), stamps[1]) == stamps[1]


def test_a_second_pull_brings_only_what_is_newer(spark):
    none = spark.createDataFrame([], "dataset string, row string, column string, value string, timestamp string")
    first = messages(spark, T.format("123", "0001", "B"), T.format("123", "0002", "A"))
    cells, since = cl.pull(first, none, cl.EPOCH)
    assert since == T.format("123", "0002", "A") and cells.count() == 2
    grown = first.union(spark.createDataFrame([("t", "r0", "c", "S:new", T.format("123", "0002", "B")), ("t", "r1", "c", "S:late", T.format("123", "0001", "A")), ("prefs", "x", "c", "S:y", T.format("123", "0003", "A"))], first.schema))
    cells, since = cl.pull(grown, cells, since)
    assert {r["row"]: r["value"] for r in cells.collect()} == {"r0": "S:new", "r1": "S:1"} and since == T.format("123", "0003", "A")
    assert cl.newer(grown, since).count() == 0


# the cycle

FEED = "feed_ord long, account long, status string, date date, amount_cents long, payee string, notes string, entry_ref string"
SCANS = "account long, pages long, error string"
RULES = [("r1", "and", json.dumps([{"type": "string", "field": "notes", "op": "contains", "value": "rent"}]), json.dumps([{"field": "category", "op": "set", "value": "housing"}, {"field": "notes", "op": "append-notes", "value": " #r"}]), 0)]


def rows(spark, *more):
    return spark.createDataFrame(list(more), FEED)


def test_cycles_on_a_state(spark, tmp_path, monkeypatch):
    root, day = f"{tmp_path}/s", dt.date(2024, 3, 1)
    State(spark, root).commit({"rules": spark.createDataFrame(RULES, cy.TABLES["rules"])})
    ok = spark.createDataFrame([(1, 1, None), (2, 0, "page 0 is missing")], SCANS)
    first = rows(spark, (1, 1, "PDNG", day, -500, "Landlord", "march rent", "A"), (2, 1, "BOOK", day, -200, "Baker", "bread", "B"))
    assert cy.run(State(spark, root), first, ok, day, "CLIENT") == 2
    state = State(spark, root)
    assert sorted((r["financial_id"], r["notes"], r["cleared"], r["category"]) for r in state.read("ledger").collect()) == [("A", "march rent", False, None), ("B", "bread", True, None)]
    assert [r["ref"] for r in state.read("refs").collect()] == ["B"] and [r["key"] for r in state.read("pending").collect()] == ["A"]
    assert state.read("outbox").count() == 0 and sorted(r["name"] for r in state.read("payees").collect()) == ["Baker", "Landlord"]
    log = state.read("log").first()
    assert (log["status"], log["added"], log["message"]) == ("success", 2, "2: page 0 is missing")

    second = rows(spark, (3, 1, "BOOK", day, -500, "Landlord", "march rent", "A"), (4, 1, "BOOK", day, -200, "Baker", "bread", "B"), (5, 1, "BOOK", day, -700, "Landlord", "old rent", ""))
    monkeypatch.setattr(lc, "next_pending", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        cy.run(State(spark, root), second, ok, day + dt.timedelta(days=1), "CLIENT")
    monkeypatch.undo()
    assert State(spark, root).version == 2  # nothing of the cycle shows
    assert cy.run(State(spark, root), second, ok, day + dt.timedelta(days=1), "CLIENT") == 3
    state = State(spark, root)
    assert sorted((r["financial_id"], r["notes"], r["cleared"], r["category"]) for r in state.read("ledger").collect()) == [("", "old rent #r", True, "housing"), ("A", "march rent #r", True, "housing"), ("B", "bread", True, None)]
    assert sorted(r["ref"] for r in state.read("refs").collect()) == ["A", "B"] and state.read("pending").count() == 0
    sent = state.read("outbox").orderBy("timestamp").collect()
    assert [(r["column"], r["value"]) for r in sent] == [("category", "S:housing"), ("notes", "S:march rent #r"), ("category", "S:housing"), ("notes", "S:old rent #r")]
    assert [r["timestamp"] for r in sent] == [f"2024-03-02T00:00:00.000Z-000{k}-CLIENT" for k in (1, 2, 3, 4)] and state.read("clock").first()["clock"] == sent[-1]["timestamp"]
    done = {r["id"]: (r["added"], r["confirmed"], r["skipped"], r["rules_applied"]) for r in state.read("log").collect()}
    assert done == {1: (2, 0, 0, 0), 2: (1, 1, 1, 2)}

    nothing = spark.createDataFrame([(1, 0, "page 0: status 500")], SCANS)
    assert cy.run(State(spark, root), second.limit(0), nothing, day, "CLIENT") == 4
    state = State(spark, root)
    assert state.read("log").where("id = 3").first()["status"] == "fetch_error" and state.read("ledger").count() == 3
