"""The set-based cycle against a row-at-a-time model on random small batches."""

import datetime as dt
import json
import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests import wire_model

from tallyspark.operators import changelog as cl
from tallyspark.operators import lifecycle as lc
from tallyspark.operators import reconcile as rc
from tallyspark.operators import rules as ru
from tallyspark.sources import feed, wire
from tallyspark.streaming import pipelines as sp

FEED = "feed_ord long, account long, status string, date date, amount_cents long, payee string, notes string, entry_ref string, cleared boolean"


def model(rows, refs=(), pending=(), ledger=()):
    """Branch and touched of each row, one row at a time. pending: key, id; ledger: id, account, ref, notes, cleared."""
    refs, pending, out = set(refs), dict(pending), {}
    table = [dict(zip(("id", "account", "ref", "notes", "cleared"), x, strict=True)) for x in ledger]

    def reconcile(r, cleared):
        ord_, acct, _, _, _, _, notes, ref, _ = r
        for t in table:
            if ref and t["account"] == acct and t["ref"] == ref:
                new = {**t, "cleared": cleared, **({"notes": notes} if notes else {})}
                changed = new != t
                t.update(new)
                return t["id"], changed
        table.append({"id": f"new{ord_}", "account": acct, "ref": ref, "notes": notes, "cleared": cleared})
        return f"new{ord_}", True

    for r in sorted(rows):
        ord_, acct, status, day, cents, _, _, ref, _ = r
        key = ref or f"{day}|{cents / 100:.2f}"
        if status == "PDNG":
            if key in pending:
                out[ord_] = ("pending_known", False)
                continue
            txn, touched = reconcile(r, False)
            if touched:
                pending[key] = txn
            out[ord_] = ("pending_new", touched)
        elif ref and ref in refs:
            out[ord_] = ("ref_known", False)
        elif key in pending:
            txn = pending.pop(key)
            own = [t for t in table if t["id"] == txn and t["account"] == acct]
            if own:
                own[0]["cleared"] = True
                out[ord_] = ("confirmed", True)
            else:
                out[ord_] = ("pending_gone", reconcile(r, True)[1])
            refs |= {ref} - {""}
        else:
            touched = reconcile(r, True)[1]
            if touched:
                refs |= {ref} - {""}
            out[ord_] = ("booked", touched)
    return out, refs, pending


@pytest.mark.parametrize("seed", range(4))
def test_settling_equals_the_row_model(spark, seed):
    """Keys that repeat in the batch and over accounts, with known references, waiting rows and a ledger before it."""
    r = random.Random(seed)
    names = ["", *(f"R{k}" for k in range(25))]
    rows = [(k, r.randint(1, 3), r.choice(["PDNG", "BOOK"]), dt.date(2024, 1, r.randint(1, 9)), r.randint(0, 4), "", r.choice(["", "x", "y"]), r.choice(names), False) for k in range(250)]
    ledger = [(f"L{k}", 1 + k % 3, f"R{k}", r.choice(["x", "y"]), r.random() < 0.5) for k in range(0, 25, 2)]
    refs = [f"R{k}" for k in range(0, 25, 5)]
    pending = [(f"R{k}", f"L{k}" if k % 4 else f"lost{k}") for k in range(0, 25, 6)] + [("2024-01-03|0.02", "L4"), ("2024-01-05|0.01", "nowhere")]
    t = spark.createDataFrame([(i, k, a, dt.date(2024, 1, 1), 7, "", "", n, f, c, "") for k, (i, a, f, n, c) in enumerate(ledger)], "id string, ord long, account long, date date, amount_cents long, payee_id string, payee_name string, notes string, financial_id string, cleared boolean, imported_payee string")
    refs_df = spark.createDataFrame([(x, dt.date(2024, 1, 1)) for x in refs], "ref string, date date")
    pending_df = spark.createDataFrame(pending, "key string, txn_id string")
    nobody = spark.createDataFrame([], "name string, id string")
    got = lc.settle(spark.createDataFrame(rows, FEED), refs_df, pending_df, t, nobody).cache()
    want, want_refs, want_pending = model(rows, refs, pending, ledger)
    assert {x["feed_ord"]: (x["branch"], x["changed"]) for x in got.collect()} == want
    assert {x["ref"] for x in lc.next_refs(refs_df, got, F.lit("2024-01-10").cast("date")).collect()} == want_refs
    left = {x["key"]: x["txn_id"] for x in lc.next_pending(pending_df, got).collect()}
    assert set(left) == set(want_pending) and all(left[k] == v or v.startswith("new") or left[k].split("|")[0] == v for k, v in want_pending.items())


@pytest.mark.parametrize("seed", range(2))
def test_cycles_in_a_row_equal_one(spark, seed):
    """Three cycles, each on the state that the one before it left and with some of its rows fetched again."""
    r = random.Random(seed)
    names = ["", *(f"R{k}" for k in range(20))]
    rows = [(k, r.randint(1, 3), r.choice(["PDNG", "BOOK"]), dt.date(2024, 1, r.randint(1, 9)), r.randint(0, 4), "shop", r.choice(["", "x", "y"]), r.choice(names), False) for k in range(120)]
    again = lambda part, at: [(at + k, *x[1:]) for k, x in enumerate(part)]
    cycles = [rows[:40], again(rows[30:40], 1000) + again(rows[40:80], 1100), again(rows[70:80], 2000) + again(rows[80:], 2100)]
    ledger = spark.createDataFrame([], "id string, ord long, account long, date date, amount_cents long, payee_id string, payee_name string, notes string, financial_id string, cleared boolean, imported_payee string")
    refs, pending, nobody = (spark.createDataFrame([], x) for x in ("ref string, date date", "key string, txn_id string", "name string, id string"))
    got = {}
    for batch in cycles:
        done = lc.settle(spark.createDataFrame(batch, FEED), refs, pending, ledger, nobody).cache()
        got |= {x["feed_ord"]: (x["branch"], x["changed"]) for x in done.collect()}
        refs, pending, ledger = (spark.createDataFrame(x.collect(), x.schema) for x in (lc.next_refs(refs, done, F.lit("2024-01-10").cast("date")), lc.next_pending(pending, done), lc.next_ledger(ledger, done)))
    want, want_refs, want_pending = model([x for b in cycles for x in b])
    assert got == want and {x["ref"] for x in refs.collect()} == want_refs and {x["key"] for x in pending.collect()} == set(want_pending)
    assert ledger.count() == ledger.select("id").distinct().count()


def test_settling_an_empty_batch(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    t = none("id string, ord long, account long, date date, amount_cents long, payee_id string, payee_name string, notes string, financial_id string, cleared boolean, imported_payee string")
    got = lc.settle(none(FEED), none("ref string, date date"), none("key string, txn_id string"), t, none("name string, id string"))
    assert got.count() == 0 and lc.next_pending(none("key string, txn_id string"), got).count() == 0


def test_actions_send_one_message_each(spark):
    row = spark.createDataFrame([("t1", 1, "p", "n", " some note ", "c", False)], "id string, ord long, payee_id string, payee_name string, notes string, category string, cleared boolean").selectExpr("*", "'' AS imported_payee", "'a' AS account", "5L AS amount_cents")
    acts = ({"field": "notes", "op": "append-notes", "value": "z"}, {"field": "category", "value": ""}, {"field": "cleared", "value": True}, {"field": "payee", "value": "p9"}, {"field": "notes", "op": "set", "value": ""})
    out = ru.apply_rules(row, [ru.Rule("r", "and", (), acts), ru.Rule("never", "or", (), acts)], messages="messages")
    sent = ru.action_messages(out, "id", "ord").orderBy("position").collect()
    assert [(x["row"], x["column"], x["value"]) for x in sent] == [("t1", "notes", "S:some note z"), ("t1", "cleared", "N:1"), ("t1", "description", "S:p9"), ("t1", "notes", "S:")]
    assert out.first()["notes"] == ""


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "id string, ord long, account long, date date, amount_cents long, payee_name string")


def _feed(spark, day, payee="Shop"):
    return spark.createDataFrame([(1, 1, "BOOK", day, 500, payee, "", "", True)], FEED)


def test_window_match(spark):
    day = dt.date(2024, 6, 10)
    at = lambda d: dt.date(2024, 6, d)
    hit = lambda rows, f=None: [tuple(x)[1] for x in rc.window_matches(f or _feed(spark, day), _ledger(spark, rows)).collect()]
    assert hit([("a", 1, 1, at(13), 500, "x")]) == ["a"]
    assert hit([("a", 1, 1, at(18), 500, "x")]) == []
    assert hit([("a", 1, 1, at(10), 501, "x")]) == []
    assert hit([("a", 1, 1, at(10), 500, "x"), ("b", 2, 1, at(16), 500, "SHOP")]) == ["b"]
    assert hit([("a", 1, 1, at(5), 500, "x"), ("b", 2, 1, at(11), 500, "y"), ("c", 3, 1, at(8), 500, "z")]) == ["b"]
    excluded = spark.createDataFrame([("a",)], "ledger_id string")
    assert rc.window_matches(_feed(spark, day), _ledger(spark, [("a", 1, 1, at(10), 500, "x")]), excluded).count() == 0


def test_distance_is_of_numbers_not_days(spark):
    rows = [("jan", 1, 1, dt.date(2024, 1, 31), 500, "x"), ("feb", 2, 1, dt.date(2024, 2, 8), 500, "x")]
    assert rc.window_matches(_feed(spark, dt.date(2024, 2, 1)), _ledger(spark, rows)).first()["ledger_id"] == "feb"


def test_greedy_takes_each_ledger_row_once(spark):
    day = dt.date(2024, 6, 10)
    two = spark.createDataFrame([(1, 1, "BOOK", day, 500, "s", "", "", True), (2, 1, "BOOK", day, 500, "s", "", "", True)], FEED)
    got = {r["feed_ord"]: r["ledger_id"] for r in rc.greedy_matches(two, _ledger(spark, [("a", 1, 1, day, 500, "x"), ("b", 2, 1, dt.date(2024, 6, 12), 500, "x")])).collect()}
    assert got == {1: "a", 2: "b"}


def greedy_model(feed, ledger):
    """feed: (ord, account, date, cents, payee); ledger: (id, ord, account, date, cents, payee). First come, first served."""
    number = lambda d: d.year * 10_000 + d.month * 100 + d.day
    taken, out = set(), {}
    for o, acct, day, cents, payee in sorted(feed):
        near = [(payee.lower() != x[5].lower(), abs(number(x[3]) - number(day)), x[1], x[0]) for x in ledger if x[0] not in taken and x[2] == acct and x[4] == cents and abs((x[3] - day).days) <= 7]
        if near:
            out[o] = min(near)[3]
            taken.add(out[o])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_first_come_first_served(spark, seed):
    r = random.Random(seed)
    day = lambda: dt.date(2023, 11, 1) + dt.timedelta(days=r.randint(0, 150))
    feed = [(k, r.randint(1, 2), day(), r.randint(1, 3), r.choice("AbC")) for k in range(150)]
    ledger = [(f"L{k}", k, r.randint(1, 2), day(), r.randint(1, 3), r.choice("aBd")) for k in range(150)]
    f = spark.createDataFrame([(o, a, "BOOK", d, c, p, "", "", True) for o, a, d, c, p in feed], FEED)
    got = {x["feed_ord"]: x["ledger_id"] for x in rc.greedy_matches(f, _ledger(spark, ledger)).collect()}
    assert got == greedy_model(feed, ledger)


@pytest.mark.parametrize(("seed", "buckets", "batch"), [(1, 9, 3), (2, 40, 7), (3, 3, 10_000)])
def test_an_island_over_many_buckets_is_served_in_rounds(spark, seed, buckets, batch):
    """One island, or a few, whose candidates fill many buckets: no task reads an island, and all is as before."""
    r = random.Random(seed)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(60))
    accounts = [1, 1, 1, 1, 2] if seed < 3 else [1, 2, 3]
    feed = [(k, r.choice(accounts), day(), 500, r.choice(["x", "y", ""])) for k in range(1, 181)]
    ledger = [(f"L{k}", k, r.choice(accounts), day(), 500, r.choice(["x", "Y", "z"])) for k in range(1, 141)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(keep, (str(buckets), "false", str(batch)), strict=True):
            spark.conf.set(k, v)
        f = spark.createDataFrame(feed, "feed_ord long, account long, date date, amount_cents long, payee string")
        got = {x["feed_ord"]: x["ledger_id"] for x in rc.greedy_matches(f, _ledger(spark, ledger)).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    want = greedy_model(feed, ledger)
    assert got == want and len(want) > 60


def test_reconcile_by_window_is_one_to_one(spark):
    day = dt.date(2024, 2, 27)
    rows = [(1, 1, "BOOK", day, 500, "Kiosk", "", "known", True), (2, 1, "BOOK", day, 500, "Kiosk", "", "", True), (3, 1, "BOOK", day, 500, "Kiosk", "", "", True), (4, 1, "BOOK", day, 500, "Kiosk", "", "", True)]
    t = [("a", 1, 1, day, 500, "", "", "known", "", True, "x"), ("b", 2, 1, dt.date(2024, 3, 1), 500, "", "", "", "", False, "")]
    table = spark.createDataFrame([(i, o, a, d, c, pi, pn, n, f, cl, im) for i, o, a, d, c, pi, pn, f, n, cl, im in t], "id string, ord long, account long, date date, amount_cents long, payee_id string, payee_name string, notes string, financial_id string, cleared boolean, imported_payee string")
    nobody = spark.createDataFrame([], "name string, id string")
    got = {x["feed_ord"]: (x["how"], x["ledger_id"], x["changed"]) for x in rc.reconcile(spark.createDataFrame(rows, FEED), table, nobody).collect()}
    assert got == {1: ("exact", "a", False), 2: ("window", "b", True), 3: ("created", None, False), 4: ("created", None, False)}


def test_feed_records(spark):
    good = [
        {"status": "PDNG", "value_date": "2023-11-30", "transaction_amount": {"amount": "7.05"}, "credit_debit_indic": "dbit", "creditor_name": "Night Tram", "remittance_information": ["Night Tram", "zone B"], "transaction_id": "T-81"},
        {"booking_date": "2023-12-02T08:00:00Z", "transaction_amount": {"amount": 310}, "debtor": {"name": "Mill & Barn"}, "remittance_information_unstructured": "wheat, 3 sacks", "entry_reference": "E-5", "transaction_id": "T-82"},
    ]
    bad = [{"value_date": "2023-13-01", "transaction_amount": {"amount": 1}}, {"value_date": "2023-12-01", "transaction_amount": {"amount": "much"}}]
    page = json.dumps({"transactions": [good[0], *bad, good[1]], "continuation_key": ""})
    rows = feed.feed_scan(spark.createDataFrame([(page,), ("[]",), (None,)], "page string")).orderBy("date").collect()
    assert [tuple(r)[1:] for r in rows] == [("PDNG", dt.date(2023, 11, 30), -705, "Night Tram", "Night Tram zone B", "T-81"), ("BOOK", dt.date(2023, 12, 2), 31000, "Mill & Barn", "wheat, 3 sacks", "E-5")]


def test_landed_page_files_are_read_whole(spark, tmp_path):
    record = {"value_date": "2023-11-30", "transaction_amount": {"amount": "1"}, "remittance_information": ["a\nb", 7, "c"]}
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"transactions": [record] * k, "continuation_key": str(k)}, indent=1))
    pages = feed.read_pages(spark, str(tmp_path))
    assert sorted(x["continuation_key"] for x in feed.continuation(pages).collect()) == ["0", "1", "2"]
    assert [(x["payee"], x["notes"]) for x in feed.feed_scan(pages).collect()] == [("a\nb", "a\nb c")] * 3


def test_messages_merge_by_arrival_and_skip_prefs(spark):
    rows = [("payees", "p", "name", "S:a", 1), ("payees", "p", "name", "0:", 3), ("payees", "p", "name", "S:b", 2), ("prefs", "x", "name", "S:c", 4), ("payees", "p", "bad-col", "S:d", 5)]
    m = spark.createDataFrame(rows, "dataset string, row string, column string, value string, ord long")
    assert [tuple(r) for r in cl.merge_cells(m).collect()] == [("payees", "p", "name", "0:", 3)]


def test_refs_expire_after_21_days(spark):
    from tallyspark.operators import store as st

    refs = spark.createDataFrame([("a", dt.date(2024, 1, 10)), ("b", dt.date(2024, 1, 9))], "ref string, date date")
    assert [r["ref"] for r in st.prune_refs(refs, F.lit("2024-01-31").cast("date")).collect()] == ["a"]


def test_streamed_states_equal_the_row_model(spark, tmp_path):
    r = random.Random(9)
    rows = [(k, r.randint(1, 3), r.choice(["PDNG", "BOOK"]), dt.date(2024, 1, r.randint(1, 2)), r.randint(0, 1), "p", f"n{k}", r.choice(["", "A", "B"]), False) for k in range(90)]
    df = spark.createDataFrame(rows, FEED)
    for low in (0, 30, 60):  # a batch each, in order; a batch's rows come in several pieces
        df.where(f"feed_ord >= {low} AND feed_ord < {low + 30}").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: sp.pending_to_booked(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in"))
    want = {k: b for k, (b, _) in model(rows)[0].items()}
    branches = lambda out: {x["feed_ord"]: x["branch"] for x in out.collect()}
    assert branches(sp.run_available(stream(), f"{tmp_path}/one")) == want
    assert branches(sp.run_available(stream(), f"{tmp_path}/one")) == want  # nothing new: nothing is done again
    assert branches(sp.run_available(stream(), f"{tmp_path}/two")) == want  # a new folder replays everything


def _days(spark, rows):
    return spark.createDataFrame([(k, ref, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for k, (ref, d) in enumerate(rows)], "feed_ord long, entry_ref string, ts timestamp")


def test_late_rows_are_judged_like_others(spark, tmp_path):
    first = _days(spark, [("a", 100), (None, 1), ("", 2), (None, 1)])
    late = _days(spark, [("b", 3), ("a", 5), ("a", 119), ("a", 122), ("b", 4), ("b", 60)])
    for part in (first, late):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sp.run_available(sp.dedup_refs(stream), str(tmp_path / "run")).collect()
    kept = sorted(((x["entry_ref"], (x["ts"] - dt.datetime(2024, 1, 1)).days) for x in got), key=repr)
    assert kept == sorted([("a", 100), (None, 1), ("", 2), (None, 1), ("b", 3), ("a", 122), ("b", 60)], key=repr)


def test_null_references_are_kept_beside_known_ones(spark, monkeypatch):
    from tallyspark.plans import cycle_queries

    rows = [(1, "BOOK", None), (2, "BOOK", None), (3, "BOOK", ""), (4, "BOOK", "a"), (6, "PDNG", "a")]
    monkeypatch.setattr(cycle_queries.td, "feed", lambda *_: spark.createDataFrame(rows, "feed_ord long, status string, entry_ref string"))
    monkeypatch.setattr(cycle_queries, "_refs", lambda *_: spark.createDataFrame([("a",)], "ref string"))
    assert sorted(x.feed_ord for x in cycle_queries.ref_anti_join(spark, "").collect()) == [1, 2, 3, 6]


MESSAGES = "dataset string, row string, column string, value string, ord long"


def _stream_of(spark, tmp_path, batches):
    for b in batches:
        spark.createDataFrame(b, MESSAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_matching_never_pairs_all_rows_of_one_account_and_amount(spark, monkeypatch):
    """4,000 feed rows against 4,000 ledger rows of one account, amount and fortnight; pairs would be millions (F6, F7)."""
    rows = spark.range(8000).select("id", F.expr("date_add(date'2024-06-01', int(id * 7919 % 8))").alias("date"), F.expr("concat('p', id * 31 % 50)").alias("payee"), F.lit(1).alias("account"), F.lit(500).alias("amount_cents"))
    feed = rows.where("id % 2 = 1").withColumnRenamed("id", "feed_ord")
    ledger = rows.where("id % 2 = 0").select(F.concat(F.lit("L"), "id").alias("id"), F.col("id").alias("ord"), "date", F.col("payee").alias("payee_name"), "account", "amount_cents")

    def refuse(*_):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(rc, "window_candidates", refuse)
    got = {x["feed_ord"]: x["ledger_id"] for x in rc.greedy_matches(feed, ledger).collect()}
    assert len(got) == len(set(got.values())) == 4000
    f, l = feed.orderBy("feed_ord").limit(200), ledger.where("ord < 400")
    plain = greedy_model([tuple(x) for x in f.select("feed_ord", "account", "date", "amount_cents", "payee").collect()], [tuple(x) for x in l.select("id", "ord", "account", "date", "amount_cents", "payee_name").collect()])
    assert {x["feed_ord"]: x["ledger_id"] for x in rc.greedy_matches(f, l).collect()} == plain
    assert rc.window_matches(feed, ledger).count() == 4000


def test_a_clock_that_is_made_on_the_way_is_made_once(spark):
    """the condition was pushed below the text's making and copied it for every part of the clock."""
    log = spark.range(20).select(cl.fn.format_clock(F.timestamp_seconds("id"), "id", F.lit("C")).alias("timestamp"))
    new = cl.newer(log, "1970-01-01T00:00:09.000Z-0009-C")
    assert new._jdf.queryExecution().optimizedPlan().toString().count("date_format(") == 1
    assert new.count() == 10 and cl.advanced(new, cl.EPOCH) == "1970-01-01T00:00:19.000Z-0013-C"


def test_merged_cells_survive_compaction_and_repeats(spark, tmp_path):
    batches = [[("t", f"r{k % 3}", "c", f"S:{n}-{k}", 100 * n + k) for k in range(5)] for n in range(5)]
    q = sp.merge_messages(_stream_of(spark, tmp_path, batches), f"{tmp_path}/cells", f"{tmp_path}/state", compact_every=2).start()
    q.awaitTermination()
    want = {("r0", "S:4-3"), ("r1", "S:4-4"), ("r2", "S:4-2")}
    assert {(x["row"], x["value"]) for x in sp.read_cells(spark, f"{tmp_path}/cells").collect()} == want
    assert sp._written(spark, f"{tmp_path}/cells", "base") == [3] and sp._written(spark, f"{tmp_path}/cells", "delta") == [4]
    sp.merge_messages(spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/cells", f"{tmp_path}/again", compact_every=2).start().awaitTermination()
    assert {(x["row"], x["value"]) for x in sp.read_cells(spark, f"{tmp_path}/cells").collect()} == want
    assert sp.read_cells(spark, f"{tmp_path}/nothing").count() == 0


def test_pushed_messages_count_on_and_need_a_group(spark, tmp_path):
    batches = [[("t", "r", "c", f"S:{n}{k}", 10 * n + k) for k in range(4)] for n in range(2)]
    stream = _stream_of(spark, tmp_path, batches)
    sp.push_messages(stream, f"{tmp_path}/none", f"{tmp_path}/s0", "f", "", "C").start().awaitTermination()
    assert sp._written(spark, f"{tmp_path}/none", "batch") == []
    sp.push_messages(stream, f"{tmp_path}/sent", f"{tmp_path}/s1", "f", "g", "C", a_request=3).start().awaitTermination()
    sent = [spark.read.parquet(f"{tmp_path}/sent/batch={n}").orderBy("request").collect() for n in sp._written(spark, f"{tmp_path}/sent", "batch")]
    assert [len(b) for b in sent] == [2, 2]
    back = [m for b in sent for x in b for m in wire_model.decode_response(bytes(x["body"]))[0]]
    assert [m["value"] for m in back] == [f"S:{n}{k}" for n in range(2) for k in range(4)]
    assert [m["timestamp"].split("Z-")[1] for m in back] == [f"{k:04X}-C" for k in range(8)]
    assert spark.read.parquet(f"{tmp_path}/sent/clock=1").first()["counter"] == 8


def test_forgetting_streams_start(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "BOOK", dt.date(2024, 1, 1), 1, "p", "", "A", False)], FEED)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = sp.pending_to_booked(stream, forget=True).writeStream.format("memory").queryName("forgetting").option("checkpointLocation", f"{tmp_path}/s").start()
    try:
        for _ in range(60):
            if q.lastProgress and spark.table("forgetting").count():
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert [x["branch"] for x in spark.table("forgetting").collect()] == ["booked"]


class GroupHeld:
    """A group's state as applyInPandasWithState hands it out."""

    def __init__(self):
        self.value, self.now, self.limit, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.limit = ms

    def getCurrentProcessingTimeMs(self):
        return self.now


def bucket_of(*rows):
    return iter([pd.DataFrame([{"pending_key": k, "entry_ref": k, "feed_ord": str(n), "account": a, "status": s}]) for n, k, a, s in rows])  # a piece a row


def test_a_bucket_of_streamed_keys_is_one_call():
    held = GroupHeld()
    out = list(sp._advance((0,), bucket_of((4, "A", "1", "BOOK"), (1, "A", "1", "PDNG"), (2, "B", None, "PDNG"), (3, "B", str(2**60 + 1), "BOOK"), (5, "A", "1", "BOOK")), held))
    assert [dict(zip(x["feed_ord"], x["branch"], strict=True)) for x in out] == [{1: "pending_new", 2: "pending_new", 3: "pending_gone", 4: "confirmed", 5: "ref_known"}]
    assert 2**60 + 1 in set(out[0]["account"].dropna())
    assert list(list(sp._advance((0,), bucket_of((6, "B", "1", "BOOK"), (7, "C", "1", "BOOK")), held))[0]["branch"]) == ["ref_known", "booked"]


def test_streamed_keys_of_a_bucket_are_forgotten_one_by_one():
    held, day = GroupHeld(), 86_400_000
    run = lambda now, *rows: (setattr(held, "now", now), list(list(sp._advance_and_forget((0,), bucket_of(*rows), held))[0]["branch"]))[1]
    assert run(day, (1, "A", "1", "BOOK"), (2, "W", "1", "PDNG")) == ["booked", "pending_new"] and held.limit == 21 * day
    assert run(11 * day, (3, "B", "1", "BOOK")) == ["booked"] and held.limit == 11 * day
    held.now, held.hasTimedOut = 22 * day, True
    assert list(sp._advance_and_forget((0,), iter([]), held)) == [] and held.limit == 10 * day
    held.hasTimedOut = False
    assert run(23 * day, (4, "A", "1", "BOOK"), (5, "B", "1", "BOOK"), (6, "W", "1", "PDNG")) == ["booked", "ref_known", "pending_known"]


def test_rows_alone_with_their_key_are_told_as_the_walk_tells_them():
    """Lone rows and runs, cut into batches anywhere, against ``Key.step`` row by row; a lone row makes no step."""
    r, text = random.Random(3), ("notes", "payee_id", "payee_name", "imported_payee")
    held = lambda account: {"id": r.choice(["L1", "L2"]), "account": account, "amount_cents": r.choice([None, 1]), "cleared": r.choice([True, False, None])} | {c: r.choice(["", "A", "B"]) for c in text}
    rows, k = [], 0
    for n in range(3000):
        k += r.random() < 0.7
        account, ref, waits = r.randint(1, 2), r.choice(["", f"R{k}"]), r.choice([None, "L1", "L9"])
        own = held(account) if ref and r.random() < 0.6 else None
        rows.append({"pending_key": f"k{k:05}", "feed_ord": n, "account": account, "status": r.choice(["PDNG", "BOOK", None]), "date": None, "amount_cents": r.choice([None, 5]), "entry_ref": ref, "new_id": f"N{n}", "ref_known": r.random() < 0.3, "own": own,
                     "pending_id": waits, "pending_row": held(r.randint(1, 2)) if waits == "L1" else None} | {c: r.choice(["", "A", "C"]) for c in ("payee", "notes", "title", "payee_id")})
    kept = pa.struct([("id", pa.string()), ("account", pa.int64()), ("amount_cents", pa.int64()), *[(c, pa.string()) for c in text], ("cleared", pa.bool_())])
    whole, own = ("feed_ord", "account", "amount_cents"), ("own", "pending_row")
    types = {c: pa.int64() if c in whole else kept if c in own else pa.bool_() if c == "ref_known" else pa.date32() if c == "date" else pa.string() for c in rows[0]}
    table, want, key = pa.Table.from_pylist(rows, pa.schema(list(types.items()))), [], None
    for x in table.to_pylist():
        q = SimpleNamespace(**x)
        if key is None or key.name != q.pending_key:
            key = lc.Key(q.pending_key, q.ref_known, q.pending_row or {"id": q.pending_id, "account": None} if q.pending_id is not None else None)
        done = {"changed": False} | {c: x[c] for c in ("feed_ord", "account", "status", "pending_key", "entry_ref", "date", "amount_cents")} | key.step(q)
        want.append({f.name: done.get(f.name) for f in lc._SETTLED})
    for size in (1, 7, 1000):
        got = [x for b in lc._walk(iter(table.to_batches(max_chunksize=size))) for x in b.to_pylist()]
        assert sorted(got, key=lambda x: x["feed_ord"]) == want
    assert len({(x["branch"], x["how"], x["changed"]) for x in want}) >= 10
    single = table.filter(pc.less(table["feed_ord"], 1)).to_batches()[0]
    assert lc._alone(single).num_rows == 1
