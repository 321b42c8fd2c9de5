"""Streaming forms: reference dedup with a time limit, pending-to-booked state, message merge and message push."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators import changelog
from ..operators import lifecycle as lc
from ..sources import wire
from . import buckets as bk

REF_DAYS = 21
COMPACT_EVERY = 8
MESSAGES_A_REQUEST = 10_000


def dedup_refs(feed: DataFrame, ts: str = "ts", days: int = REF_DAYS, forget: bool = False) -> DataFrame:
    """Rows of a stream whose reference was not kept in the ``days`` before them; rows without one all pass.

    A late row is judged like any other: it goes if its reference is known, and passes if it is not. ``forget`` drops a
    reference after ``days`` of wall-clock time without rows (see ``pending_to_booked``).
    """
    limit = pd.Timedelta(days=days)

    def judge(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        g = pd.concat(list(rows)).sort_values(ts, kind="stable")
        keep = []
        for t in g[ts]:
            new = last is None or pd.isna(t) or pd.Timestamp(last) < t - limit
            keep.append(new)
            if new and not pd.isna(t):
                last = t.to_pydatetime()
        state.update((last,))
        if forget:
            state.setTimeoutDuration(days * 86_400_000)
        yield g[keep]

    named = feed.where("coalesce(entry_ref, '') <> ''")
    timer = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    kept = named.groupBy("entry_ref").applyInPandasWithState(judge, feed.schema, "last timestamp", "append", timer)
    return kept.unionByName(feed.where("coalesce(entry_ref, '') = ''"))


_OUT = "pending_key string, feed_ord long, account long, branch string"
_KEYS = pa.schema([("key", pa.string()), ("waits_for", pa.int64()), ("waiting", pa.bool_()), ("booked", pa.bool_()), ("touched", pa.int64())])
_WHOLE = ("feed_ord", "account")
_REF_MS = REF_DAYS * 86_400_000


def _advance(key, rows: Iterator[pd.DataFrame], state: GroupState, now: int | None = None) -> Iterator[pd.DataFrame]:
    """One bucket's rows of one batch, key by key in order; ``now`` forgets what was not met for REF_DAYS before it."""
    table = bk.load(state.get[0] if state.exists else None, _KEYS)
    if now is not None:  # a reference is remembered for a while, a waiting row until it is booked
        table = table.filter(pc.or_(table["waiting"], pc.greater(table["touched"], now - _REF_MS)))
    if state.hasTimedOut:
        batch = []
    else:
        batch = bk.records(rows, _WHOLE)
    met, rest = bk.parted(table, {x["pending_key"] for x in batch})
    for x in batch:
        k = met.setdefault(x["pending_key"], {"key": x["pending_key"], "waits_for": None, "waiting": False, "booked": False})
        if x["status"] == "PDNG":
            x["branch"] = "pending_known" if k["waiting"] else "pending_new"
            if not k["waiting"]:
                k["waits_for"], k["waiting"] = x["account"], True
        elif x["entry_ref"] and k["booked"]:
            x["branch"] = "ref_known"
        else:
            x["branch"] = "booked" if not k["waiting"] else "confirmed" if k["waits_for"] == x["account"] else "pending_gone"
            k["waiting"], k["booked"] = False, k["booked"] or bool(x["entry_ref"])
        k["touched"] = now
    if met or rest.num_rows:
        state.update((bk.saved(rest, met.values()),))
    else:
        state.remove()
    if now is not None:
        limits = [k["touched"] for k in met.values() if not k["waiting"]] + [pc.min(rest.filter(pc.invert(rest["waiting"]))["touched"]).as_py()]
        if any(limits):
            state.setTimeoutDuration(max(min(t for t in limits if t) + _REF_MS - now, 1))
    if batch:
        yield pd.DataFrame({c: pd.Series([x[c] for x in batch], dtype="Int64" if c in _WHOLE else object) for c in ("pending_key", "feed_ord", "account", "branch")})


def _advance_and_forget(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    yield from _advance(key, rows, state, state.getCurrentProcessingTimeMs())


def pending_to_booked(feed: DataFrame, forget: bool = False) -> DataFrame:
    """The branch of each feed row, with the key's state kept between batches; keys are known whatever the account, and
    a booked row of another account finds the waiting row gone. Late rows are never dropped.

    ``forget`` drops booked references after REF_DAYS of wall-clock time. It is for streams that run on: a query with
    such timers has always another batch to wait for, so it would not end under an available-now trigger.
    """
    keyed = lc.with_keys(feed).select(bk.bucket("pending_key").alias("bucket"), *bk.exact(("pending_key", "account", "feed_ord", "status", "entry_ref"), _WHOLE))
    step, timer = (_advance_and_forget, GroupStateTimeout.ProcessingTimeTimeout) if forget else (_advance, GroupStateTimeout.NoTimeout)
    return keyed.groupBy("bucket").applyInPandasWithState(step, _OUT, "held binary", "append", timer)


def _written(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``kind``=n under ``path``, in order."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}="))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_cells(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The cell table of ``merge_messages``: the newest base and what the batches after it (up to ``upto``) changed."""
    inside = lambda kind: [n for n in _written(spark, path, kind) if upto is None or n <= upto]
    base, deltas = inside("base")[-1:], inside("delta")
    parts = [f"{path}/base={n}" for n in base] + [f"{path}/delta={n}" for n in deltas if not base or n > base[0]]
    if not parts:
        return spark.createDataFrame([], "dataset string, row string, column string, value string, ord bigint")
    cells = spark.read.option("recursiveFileLookup", "true").parquet(*parts)
    return cells.groupBy("dataset", "row", "column").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))


def merge_messages(messages: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY):
    """Merge a stream of change messages into a cell table (``read_cells``), idempotent on the batch id.

    A batch writes only its own cells as a delta; every ``compact_every`` batches the deltas become a new base and what
    it replaces goes. A batch that is run again replaces its own folders, so a failed write loses nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changelog.merge_cells(batch).write.mode("overwrite").parquet(f"{path}/delta={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            read_cells(spark, path, batch_id).write.mode("overwrite").parquet(f"{path}/base={batch_id}")
            for kind, last in (("base", batch_id - 1), ("delta", batch_id)):
                for n in _written(spark, path, kind):
                    if n <= last:
                        _remove(spark, f"{path}/{kind}={n}")

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def push_messages(messages: DataFrame, path: str, checkpoint: str, file: str, group: str, client: str, ts: str = "1970-01-01 00:00:00", a_request: int = MESSAGES_A_REQUEST):
    """Change messages out as binary requests under ``path``/batch=n (request, body), at least once: a batch that is run
    again replaces its own folder. Messages are stamped in order of ``ord`` by a clock whose counter goes on from the
    batch before; the clock is saved under ``path``/clock=n. Without a group id nothing is sent."""

    def push(batch: DataFrame, batch_id: int) -> None:
        if not group or batch.isEmpty():
            return
        spark = batch.sparkSession
        done = [n for n in _written(spark, path, "clock") if n < batch_id]
        start = spark.read.parquet(f"{path}/clock={done[-1]}").first()["counter"] if done else 0
        # gapless numbers by ranges of ord: only the ranges' sizes come together
        dealt = batch.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("part", F.spark_partition_id())
        dealt.write.mode("overwrite").parquet(f"{path}/stage")
        dealt = spark.read.parquet(f"{path}/stage")
        sizes = dealt.groupBy("part").count()
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
        inside = F.row_number().over(Window.partitionBy("part").orderBy("ord")) - 1
        numbered = dealt.withColumn("n", inside).join(F.broadcast(starts), "part").withColumn("ord", F.col("n") + F.col("start"))
        stamped = changelog.stamp(numbered, F.lit(ts).cast("timestamp"), start, client).withColumn("request", F.floor(F.col("ord") / a_request))
        wire.request_bodies(stamped, file, group, ["request"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        sizes.agg((F.sum("count") + start).alias("counter")).write.mode("overwrite").parquet(f"{path}/clock={batch_id}")
        _remove(spark, f"{path}/stage")

    return messages.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_available(stream: DataFrame, folder: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Drive what is there now to completion into a table under ``folder`` and read it back. Run again on the same folder
    it goes on where it stopped; a new folder replays everything. ``conf`` holds while the query starts."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
