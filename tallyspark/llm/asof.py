"""Tolerant as-of join: for every left row the latest right row of its key at or before its time, within a tolerance.

Two levels. Right rows of one key and time are first reduced to one, with how many there were. They and the left rows
are dealt by range of (key, time, side, row id), so a bucket is a run of neighbouring rows and no key, time or pair of
both is one task; a key that holds a third of all rows spans a third of the buckets. Inside its bucket a left row takes
the last right row of its key before it. Every bucket also tells the latest right row of its first and of its last
key; the maximum of these over a key's earlier buckets is what a left row without a match in its own bucket takes, by
an equi-join on key and bucket.

Defined results: left rows with a null key or time match nothing and stay; right rows with a null key or time are not
read; of right rows of equal key and time the one with the greatest ``prefer`` columns wins, in their order, null
losing, then the greatest other columns; ``n_tied`` counts all of them, repeated rows too; a repeated left row is
answered each time; an empty left table gives no rows, an empty right one no matches; other left columns pass through,
but a column named like the output is replaced by it.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scope, materialize, table

HOUR_US = 3_600_000_000


def _changes(key: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Where a row's key is another than that of the row before; a null key is always another."""
    first = pa.array([None if before is None else before.as_py()], key.type)
    return pc.fill_null(pc.not_equal(key, pa.concat_arrays([first, key[:-1]])), True).to_numpy(zero_copy_only=False)


def _search(batches):
    """Sorted rows (key, at, side, left, found) of one bucket: left rows with the last found row of their key before
    them, and the bucket's summaries: the latest found row of its first and of its last key."""
    bucket = TaskContext.get().partitionId()
    last_key, carried, in_first_run, first = None, None, True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, side, left, found = batch.column("key"), batch.column("side"), batch.column("left"), batch.column("found")
        n = batch.num_rows
        new = _changes(key, last_key)
        if last_key is None and key[0].is_valid and carried is None and first is None:
            new[0] = False  # the bucket's first run goes on from earlier buckets
            first = key[0]
        elif first is None:
            in_first_run = False
        place = np.arange(n)
        run = np.maximum.accumulate(np.where(new, place, -1))
        right = side.to_numpy(zero_copy_only=False) == 0
        at = np.maximum.accumulate(np.where(right, place, -1))
        own = at >= np.maximum(run, 0)
        from_before = (run < 0) & (at < 0)
        pool = pa.concat_arrays([found.slice(0, 0) if carried is None else carried, found])
        shift = len(pool) - n
        index = np.where(own, at + shift, 0)
        has = own | (from_before & (shift > 0))
        picked = pool.take(pa.array(index, pa.int64(), mask=~has)) if len(pool) else pa.nulls(n, found.type)
        head = in_first_run & (run < 0)
        rows = np.flatnonzero(~right)
        if len(rows):
            take = pa.array(rows)
            yield _out(left.take(take), key.take(take), picked.take(take), bucket, pa.array(head[rows]), False)
        if in_first_run and run[-1] >= 0:  # the first run ends here
            end = int(np.flatnonzero(run >= 0)[0]) - 1
            told = picked[end : end + 1] if end >= 0 else (carried if carried is not None else pa.nulls(1, found.type))
            if first is not None:
                yield _out(pa.nulls(1, left.type), pa.array([first.as_py()], key.type), told, bucket, pa.array([True]), True)
            in_first_run = False
        carried = picked[n - 1 : n] if has[-1] else None
        last_key = key[n - 1]
    if last_key is not None and last_key.is_valid:
        told = carried if carried is not None else pa.nulls(1, found.type)
        yield _out(pa.nulls(1, left.type), pa.array([last_key.as_py()], key.type), told, bucket, pa.array([in_first_run]), True)


def _out(left, key, found, bucket, head, summary):
    n = len(key)
    return pa.record_batch([left, key, found, pa.array(np.full(n, bucket, np.int32)), head, pa.array(np.full(n, summary))], names=["left", "key", "found", "bucket", "head", "summary"])


def asof_join(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, tolerance: int, prefer: list[str], row_id: str, out: str = "match") -> DataFrame:
    """``left`` with struct ``out`` (right_at, the other columns of ``right`` without ``by``, n_tied), null without a match.

    ``left_at`` and ``right_at`` are whole numbers of one unit, as is ``tolerance``; ``row_id`` is a left column that
    tells rows of equal key and time apart, so that they may go to several buckets."""
    left = left.drop(out)
    rest = [c for c in right.columns if c not in (by, right_at, *prefer)]
    told = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull())
    told = told.groupBy(F.col(by).alias("key"), F.col(right_at).alias("at")).agg(F.max(F.struct(*prefer, *rest)).alias("best"), F.count(F.lit(1)).alias("n_tied"))
    found = F.struct(F.col("at").alias(right_at), *[F.col("best")[c].alias(c) for c in (*prefer, *rest)], "n_tied")
    key = F.when(F.col(left_at).isNotNull(), F.col(by))
    asked = left.select(key.alias("key"), F.col(left_at).alias("at"), F.lit(1).alias("side"), F.col(row_id).alias("row_id"), F.struct(*left.columns).alias("left"))
    given = told.select("key", "at", F.lit(0).alias("side"), F.lit(None).cast(left.schema[row_id].dataType).alias("row_id"), F.lit(None).cast(asked.schema["left"].dataType).alias("left"), found.alias("found"))
    both = asked.withColumn("found", F.lit(None).cast(given.schema["found"].dataType)).unionByName(given)
    order = ["key", "at", "side", "row_id"]
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order).drop("row_id")
    kind = T.StructType([T.StructField(n, t) for n, t in (("left", asked.schema["left"].dataType), ("key", asked.schema["key"].dataType), ("found", given.schema["found"].dataType), ("bucket", T.IntegerType()), ("head", T.BooleanType()), ("summary", T.BooleanType()))])
    with Scope(left.sparkSession) as scope:
        searched = scope.keep(materialize(dealt.mapInArrow(_search, kind), "asof-buckets"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = searched.where("summary").select("key", "bucket", F.max_by("found", f"found.{right_at}").over(earlier).alias("before"))
    rows = searched.where("NOT summary")
    open_ = F.col("found").isNull() & F.col("head") & F.col("key").isNotNull()
    matched = rows.where(~open_).select("left", "found")
    later = rows.where(open_).join(before.hint("merge"), ["key", "bucket"], "left").select("left", F.col("before").alias("found"))
    near = F.col(f"left.{left_at}") - F.col(f"found.{right_at}") <= tolerance
    return matched.unionByName(later).select("left.*", F.when(near, F.col("found")).alias(out))


# the shop's clicks and sales


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970 (UTC) of a timestamp with or without a zone."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))
    return F.unix_micros(F.col(col).cast("timestamp"))


def _checksum(col: str) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def _used(df: DataFrame, at: str, id_col: str) -> Column:
    """The time in microseconds, floored to 6 hours where the id's checksum is odd."""
    t, step = micros(df, at), F.lit(6 * HOUR_US)
    return F.when(F.coalesce(_checksum(id_col) % 2 == 1, F.lit(False)), t - F.pmod(t, step)).otherwise(t)


def clicks_of(clicks: DataFrame) -> DataFrame:
    """(click_id, client_id, ts_us), one row a click id; copies that differ count as the greatest (time, client)."""
    seen = clicks.select("click_id", F.struct(_used(clicks, "ts", "click_id").alias("ts_us"), "client_id").alias("c"))
    return seen.groupBy("click_id").agg(F.max("c").alias("c")).select("click_id", "c.client_id", "c.ts_us")


def orders_of(sales: DataFrame) -> DataFrame:
    """(client_id, sold_us, total_cents, sale_id, priority): every sale, and its second order where it has one. A total
    that is no number, or whose cents do not fit, has null cents; a null id has one order, its time as it is."""
    cents = F.floor(F.when(F.abs("total") < 9e16, F.col("total")) * 100 + 0.5)
    one = sales.select("client_id", _used(sales, "sold_at", "sale_id").alias("sold_us"), cents.alias("total_cents"), "sale_id", "priority", _checksum("sale_id").alias("h"))
    twin = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).cast(sales.schema["priority"].dataType).alias("priority"))
    own = F.struct("sale_id", "priority")
    each = F.when(F.col("h") % 3 != 0, F.array(own, twin)).otherwise(F.array(own))
    return one.withColumn("o", F.explode(each)).select("client_id", "sold_us", "total_cents", "o.sale_id", "o.priority")


def op12_asof_join(spark, sf_dir: str) -> DataFrame:
    clicks, orders = clicks_of(table(spark, sf_dir, "clicks")), orders_of(table(spark, sf_dir, "sales"))
    found = asof_join(clicks, orders, "client_id", "ts_us", "sold_us", 720 * HOUR_US, ["total_cents", "sale_id"], "click_id")
    return found.select(
        "click_id", "client_id", "ts_us", "match.sale_id", (F.col("ts_us") - F.col("match.sold_us")).alias("lag_us"), "match.total_cents",
        F.coalesce("match.n_tied", F.lit(0)).cast("long").alias("n_tied"), "match.priority",
    )
