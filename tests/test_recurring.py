"""Runs that fetch again what overlaps count every row once, also over a restart."""

import datetime as dt
import time

from pyspark.sql import functions as F

from tallyspark.operators.commit import State
from tallyspark.streaming import recurring as rec

LANDED = "feed_ord long, account long, status string, date date, amount_cents long, payee string, notes string, entry_ref string, landed int"
DAY = dt.date(2024, 3, 10)


class Bank:
    """Landed rows in a folder, fetched from a day on; what was asked for is kept."""

    def __init__(self, spark, at):
        self.spark, self.at, self.asked, self.n = spark, at, [], 0

    def land(self, *rows):
        made = [(1000 * self.n + k, 1, status, day, -100 * (k + 1), "Shop", "x", ref, self.n) for k, (ref, status, day) in enumerate(rows)]
        self.spark.createDataFrame(made, LANDED).coalesce(1).write.mode("append").parquet(self.at)
        self.n += 1

    def arrivals(self):
        return self.spark.readStream.schema(LANDED).parquet(self.at)

    def fetch(self, since):
        self.asked.append(since)
        rows = self.spark.read.schema(LANDED).parquet(self.at).where(F.col("date") >= F.lit(since)).drop("landed")
        return rows, self.spark.createDataFrame([(1, 1, None)], "account long, pages long, error string")


def test_three_runs_and_a_restart_count_the_overlap_once(spark, tmp_path):
    bank, root, state = Bank(spark, f"{tmp_path}/in"), f"{tmp_path}/s", lambda: State(spark, f"{tmp_path}/s")
    run = lambda k, day: rec.recurring(bank.arrivals(), bank.fetch, root, f"{tmp_path}/cp{k}", None, lambda: day).start().awaitTermination()
    added = lambda: [r["added"] for r in state().read("log").orderBy("id").collect()]
    bank.land(("A", "BOOK", DAY), ("W", "PDNG", DAY - dt.timedelta(days=3)))
    run(0, DAY)
    bank.land(("B", "BOOK", DAY + dt.timedelta(days=1)))
    run(0, DAY + dt.timedelta(days=1))
    bank.land(("W", "BOOK", DAY - dt.timedelta(days=3)), ("C", "BOOK", DAY + dt.timedelta(days=2)))
    run(0, DAY + dt.timedelta(days=2))
    assert added() == [2, 1, 1]
    assert bank.asked == [DAY - dt.timedelta(days=30), DAY - dt.timedelta(days=3), DAY - dt.timedelta(days=3)]
    assert sorted((r["financial_id"], r["cleared"]) for r in state().read("ledger").collect()) == [("A", True), ("B", True), ("C", True), ("W", True)]
    before = state().version
    run(0, DAY + dt.timedelta(days=2))  # nothing has arrived
    assert rec.run_batch(spark, bank.fetch, root, 2, DAY + dt.timedelta(days=2)) is None and state().version == before  # the last batch again
    run(1, DAY + dt.timedelta(days=3))  # the checkpoint is lost: its first batch is the third one's past
    assert state().version == before
    assert rec.run_batch(spark, bank.fetch, root, 3, DAY + dt.timedelta(days=3)) == before + 1
    assert added() == [2, 1, 1, 0] and bank.asked[-1] == DAY + dt.timedelta(days=2) and state().read("ledger").count() == 4


def test_a_run_under_a_trigger(spark, tmp_path):
    bank, root = Bank(spark, f"{tmp_path}/in"), f"{tmp_path}/s"
    bank.land(("A", "BOOK", DAY))
    q = rec.recurring(bank.arrivals(), bank.fetch, root, f"{tmp_path}/cp", "1 second", lambda: DAY).start()
    try:
        for want, more in ((1, ("B", "BOOK", DAY)), (2, None)):
            end = time.time() + 90
            while State(spark, root).version < want and q.isActive and time.time() < end:
                time.sleep(0.5)
            assert State(spark, root).version == want
            if more:
                bank.land(more)
    finally:
        q.stop()
    assert [r["added"] for r in State(spark, root).read("log").orderBy("id").collect()] == [1, 1]
