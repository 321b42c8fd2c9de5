"""The cycle as a stream equals the cycle batch by batch: branches, values, ids, counters, and what is forgotten when."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import lifecycle as lc
from tallyspark.streaming import pipelines as sp
from tallyspark.streaming import settling as st

FEED = "feed_ord long, account long, status string, date date, amount_cents long, payee string, notes string, entry_ref string, cleared boolean, as_of date"
LEDGER = "id string, ord long, account long, date date, amount_cents long, payee_id string, payee_name string, notes string, financial_id string, cleared boolean, imported_payee string"
COLUMNS = ("branch", "how", "ledger_id", "changed", "amount_cents", "notes", "payee_id", "payee_name", "cleared", "imported_payee", "added", "confirmed", "skipped", "new_ref")


def stream_of(spark, batches, folder):
    for rows in batches:
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def values(df):
    return {x["feed_ord"]: tuple(x[c] for c in COLUMNS) for x in df.collect()}


def test_stream_equals_batches_with_state_before_and_expiry(spark, tmp_path):
    r = random.Random(5)
    names = ["", *(f"R{k}" for k in range(14))]
    start, batches = dt.date(2024, 3, 1), []
    for b in range(4):
        as_of = start + dt.timedelta(days=15 * b)  # references of one batch are forgotten two batches later
        day = lambda a=as_of: a - dt.timedelta(days=r.randint(0, 9))
        batches.append([(100 * b + k, r.randint(1, 3), r.choice(["PDNG", "BOOK"]), day(), r.randint(0, 3), r.choice(["Shop", "baker 1", ""]), r.choice(["", "x", "y"]), r.choice(names), False, as_of) for k in range(40)])
    ledger = spark.createDataFrame([(f"L{k}", k, 1 + k % 3, start, 7, "", "", "x", f"R{k}", bool(k % 2), "") for k in range(0, 14, 3)], LEDGER)
    refs = spark.createDataFrame([(f"R{k}", start - dt.timedelta(days=k)) for k in range(0, 14, 4)], "ref string, date date")
    pending = spark.createDataFrame([("R1", "lost|2024-02-01"), ("R3", "L3"), ("R6", "L6|2024-02-02"), (f"{start}|0.02", "L9")], "key string, txn_id string")
    payees = spark.createDataFrame([("Shop", "p1")], "name string, id string")
    folder = str(tmp_path)
    out = sp.run_available(st.settle_stream(stream_of(spark, batches, folder), payees, st.initial_state(refs, pending, ledger)), folder, st.STATE_CONF)
    got, want = values(out), {}
    for rows in batches:
        as_of = F.lit(rows[0][-1])
        refs = refs.where(F.col("date") >= F.date_sub(as_of, sp.REF_DAYS))
        done = lc.settle(spark.createDataFrame(rows, FEED).drop("as_of"), refs, pending, ledger, payees).cache()
        want |= values(done)
        after = lc.next_refs(refs, done, as_of), lc.next_pending(pending, done), lc.next_ledger(ledger, done)
        refs, pending, ledger = (spark.createDataFrame(x.collect(), x.schema) for x in after)
    assert got == want
    assert {x[0] for x in want.values()} == {"pending_known", "pending_new", "ref_known", "confirmed", "pending_gone", "booked"}


def test_a_stream_goes_on_where_it_stopped_and_ends_with_a_time_limit(spark, tmp_path):
    day = dt.date(2024, 3, 1)
    row = lambda k, status, when=day: (k, 1, status, day, 500, "s", "", "R1", False, when)
    nobody, folder = spark.createDataFrame([], "name string, id string"), str(tmp_path)
    run = lambda batches: {x["feed_ord"]: x["branch"] for x in sp.run_available(st.settle_stream(stream_of(spark, batches, folder), nobody, keep_days=400), folder, st.STATE_CONF).collect()}
    assert run([[row(1, "PDNG")]]) == {1: "pending_new"}
    later = dt.date(2024, 4, 1)
    assert run([[row(2, "PDNG"), row(3, "BOOK")], [row(4, "BOOK"), row(5, "BOOK", later)]]) == {1: "pending_new", 2: "pending_known", 3: "confirmed", 4: "ref_known", 5: "booked"}


@pytest.mark.parametrize(("value", "want"), [(float("nan"), None), (None, None), ("x", "x"), (True, True), (dt.date(2024, 1, 1), dt.date(2024, 1, 1))])
def test_plain_values(value, want):
    assert st._plain(value) == want


class Held:
    """Value state of one bucket, and the handle and the clock a processor meets it by."""

    def __init__(self):
        self.value, self.calls, self.now = None, 0, 0

    def getValueState(self, name, schema, ttl=None):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def getCurrentProcessingTimeInMs(self):
        return self.now


def bucket_rows(*rows):
    day = dt.date(2024, 3, 1)
    base = {"date": day, "payee": "s", "notes": "", "title": "S", "payee_id": "p", "as_of": None}
    return pd.DataFrame([base | {"pending_key": k, "entry_ref": k, "feed_ord": str(n), "account": a, "status": s, "amount_cents": c, "new_id": f"N{n}"} for n, k, a, s, c in rows])


def test_a_bucket_of_keys_is_one_call_and_whole_numbers_stay_exact():
    held, big = Held(), str(2**60 + 1)
    walk = st.Settling()
    walk.init(held)
    # pieces of one batch; rows are taken in order of feed_ord, whatever their key
    first = list(walk.handleInputRows((0,), iter([bucket_rows((10, "B", "1", "BOOK", None), (9, "A", "1", "BOOK", big)), bucket_rows((2, "A", "1", "PDNG", big), (3, "C", None, "PDNG", None))]), held))[0]
    assert dict(zip(first["feed_ord"], first["branch"], strict=True)) == {10: "booked", 9: "confirmed", 2: "pending_new", 3: "pending_new"}
    assert set(first["amount_cents"][first["pending_key"] == "A"]) == {2**60 + 1}
    again = list(walk.handleInputRows((0,), iter([bucket_rows((11, "A", "1", "BOOK", big), (12, "C", "2", "BOOK", "5"), (13, "D", "1", "BOOK", "5"))]), held))[0]
    assert list(again["branch"]) == ["ref_known", "pending_gone", "booked"]
    assert held.calls == 4


def test_a_key_of_a_bucket_lives_as_long_as_it_is_met():
    held = Held()
    walk = st.Settling(1000)
    walk.init(held)
    run = lambda now, *rows: (setattr(held, "now", now), list(list(walk.handleInputRows((0,), iter([bucket_rows(*rows)]), held))[0]["branch"]))[1]
    assert run(1, (1, "A", "1", "BOOK", "5"), (2, "B", "1", "BOOK", "5")) == ["booked", "booked"]
    assert run(900, (3, "A", "1", "BOOK", "5")) == ["ref_known"]
    assert run(1500, (4, "A", "1", "BOOK", "5"), (5, "B", "1", "BOOK", "5")) == ["ref_known", "booked"]
