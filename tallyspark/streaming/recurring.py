"""The sync cycle again and again: each run fetches anew what may have changed since the last one.

Arrivals in a folder of landed feed rows start the runs, under a trigger of so many hours. A run does not read the
arrivals alone: like a bank's feed it is asked for everything from a day on, the day of the last run or that of the
earliest row that still waits, so a row that was fetched while it waited is met again when it is booked. What was
imported before is known by its reference, so the overlap counts once. The run's own offsets, the number of the batch and
the day, are committed with its tables: a batch that is started again after its commit does nothing.
"""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import cycle as cy
from ..operators.commit import State

PROGRESS = "batch_id bigint, last_sync date, date_from date"
FIRST_DAYS = 30


def window_start(state: State, today: dt.date) -> dt.date:
    """The first day to fetch: that of the last run (FIRST_DAYS back before the first one), or of the earliest waiting row."""
    last = state.read("progress", PROGRESS).agg(F.max("last_sync")).first()[0]
    waiting = state.read("pending", cy.TABLES["pending"]).agg(F.min(fn.parse_date(fn.split_pending("txn_id")["date"]))).first()[0]
    start = last or today - dt.timedelta(days=FIRST_DAYS)
    return min(start, waiting) if waiting else start


def run_batch(spark: SparkSession, fetch: Callable[[dt.date], tuple[DataFrame, DataFrame]], root: str, batch_id: int, today: dt.date, client: str = "0000000000000000") -> int | None:
    """One run on top of the newest state; None if this batch, or a later one, was committed before."""
    state = State(spark, root)
    done = state.read("progress", PROGRESS).agg(F.max("batch_id")).first()[0]
    if done is not None and done >= batch_id:
        return None
    since = window_start(state, today)
    feed, scans = fetch(since)
    return cy.run(state, feed, scans, today, client, also={"progress": spark.createDataFrame([(batch_id, today, since)], PROGRESS)})


def recurring(arrivals: DataFrame, fetch: Callable[[dt.date], tuple[DataFrame, DataFrame]], root: str, checkpoint: str, every: str | None = "6 hours", today: Callable[[], dt.date] = dt.date.today, client: str = "0000000000000000"):
    """The writer of the recurring run (``start()`` it): a cycle for each batch of ``arrivals``, every so often, or for
    all there is now (``every`` None). ``fetch`` gives (rows with feed_ord, scans) from a day on."""

    def cycle(batch: DataFrame, batch_id: int) -> None:
        run_batch(batch.sparkSession, fetch, root, batch_id, today(), client)

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return arrivals.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(**trigger)
