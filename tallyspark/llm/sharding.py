"""Longest-processing-time scheduling of groups of equal texts onto shards (law ``bytes``).

Groups are ordered by their size and each goes to the least-loaded shard through a heap. The heap runs on the
driver over size classes, not over groups: sizes under 2**16 are classes of their own and larger ones are kept to
13 leading bits, so there are fewer than 65,536 + 4,096 * 48 classes whatever the corpus holds. Groups of a class
are dealt in one step when there are many: the class is poured onto the lowest shards as the heap would do it.

Defined results: a null text counts as the empty text; rows with equal texts share a shard; repeated rows and null
ids each get a slot of their own; an empty table gives an empty result; other columns are not read.
"""

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scope, materialize, whole_text

EXACT_BELOW = 1 << 16
SUB_BUCKETS = 256
ROWS_A_SLOT_BUCKET = 100_000


def _pour(load: list[float], count: int, each: float) -> list[int]:
    """How many of ``count`` groups of size ``each`` every shard takes if each goes to the least-loaded one."""
    n, take = len(load), [0] * len(load)
    if count > 8 * n:
        low, high = min(load), max(load) + each * (count / n + 1)
        room = lambda level: [max(0, int((level - x) // each)) for x in load]
        for _ in range(80):
            mid = (low + high) / 2
            if sum(room(mid)) <= count:
                low = mid
            else:
                high = mid
        take = room(low)
        if sum(take) > count:
            take = [0] * n
    heap = [(x + k * each, i) for i, (x, k) in enumerate(zip(load, take, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(take)):
        at, i = heap[0]
        take[i] += 1
        heapq.heapreplace(heap, (at + each, i))
    return take


def schedule(classes: list[tuple[int, int, int]], n_shards: int) -> list[tuple[int, list[int]]]:
    """classes: (class, groups, bytes of all its groups). For each class, the running count of groups up to each shard."""
    load, out = [0.0] * n_shards, []
    for key, count, total in sorted(classes, reverse=True):
        each = total / count
        take = _pour(load, count, each)
        load = [x + k * each for x, k in zip(load, take, strict=True)]
        upto, so_far = [], 0
        for k in take:
            so_far += k
            upto.append(so_far)
        out.append((key, upto))
    return out


def _size_class(size: str):
    """``size`` itself when small, else with all but its 13 leading bits cleared."""
    cut = f"cast(greatest(0, length(bin({size})) - 13) AS INT)"
    return F.expr(f"CASE WHEN {size} < {EXACT_BELOW} THEN {size} ELSE shiftleft(shiftright({size}, {cut}), {cut}) END")


def _offsets(counts: DataFrame, keys: list[str], sub: str) -> DataFrame:
    """Rows of ``keys`` before each ``sub`` bucket."""
    upto = Window.partitionBy(*keys).orderBy(sub).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("before", F.sum("count").over(upto) - F.col("count")).drop("count")


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of id, size (UTF-8 bytes + 1), text_crc32, shard and slot (gapless from 0 in each shard)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    text = whole_text(text_col)
    with Scope(spark) as scope:
        keyed = materialize(
            docs.select(
                F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
                F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"),
            ),
            "shard-keys",
        )
        key = ["h1", "h2", "size", "crc"]
        groups = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).withColumn("bytes", F.col("size") * F.col("copies"))
        groups = materialize(groups.withColumn("class", _size_class("bytes")).withColumn("sub", F.pmod("h1", F.lit(SUB_BUCKETS))), "shard-groups")
        totals = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.sum("copies").alias("rows")).collect()
        n_rows = sum(r["rows"] for r in totals)
        plan = schedule([(r["class"], r["n"], r["b"]) for r in totals], n_shards)
        kind = T.StructType([T.StructField("class", T.LongType()), T.StructField("upto", T.ArrayType(T.LongType()))])
        plan_df = spark.createDataFrame(pd.DataFrame(plan, columns=["class", "upto"]) if plan else [], kind)
        before = _offsets(groups.groupBy("class", "sub").count(), ["class"], "sub")
        in_sub = Window.partitionBy("class", "sub").orderBy(*key)
        placed = (
            groups.withColumn("nth", F.row_number().over(in_sub) - 1)
            .join(before, ["class", "sub"])
            .join(F.broadcast(plan_df), "class")  # at most 65,536 + 4,096 * 48 rows of n_shards numbers
            .withColumn("nth", F.col("nth") + F.col("before"))
            .select(*key, F.size(F.filter("upto", lambda x: x <= F.col("nth"))).alias("shard"))
        )
        buckets = max(1, -(-n_rows // (n_shards * ROWS_A_SLOT_BUCKET)))
        dealt = materialize(
            keyed.join(placed, key).withColumn("part", F.pmod(F.xxhash64("id", "h1"), F.lit(16 * buckets))).select("id", "size", "crc", "shard", "part"), "shard-rows"
        )
        scope.keep(dealt)
    starts = _offsets(dealt.groupBy("shard", "part").count(), ["shard"], "part")
    nth = Window.partitionBy("shard", "part").orderBy("id", "size", "crc")
    return (
        dealt.withColumn("nth", F.row_number().over(nth) - 1)
        .join(starts, ["shard", "part"])
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("nth") + F.col("before")).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each document into its shard's folder, by id within a file. A row finds its shard by id, size and checksum,
    so repeated ids and repeated rows stay as many as they are."""
    text = whole_text(text_col)
    where = assigned.select(F.col(id_col).alias("__ts_id"), F.col("size").alias("__ts_size"), F.col("text_crc32").alias("__ts_crc"), "shard").distinct()
    own = docs.drop("shard").withColumns({"__ts_n": (F.octet_length(text) + 1).cast("long"), "__ts_c": F.crc32(F.encode(text, "UTF-8"))})
    same = F.col(id_col).eqNullSafe(F.col("__ts_id")) & (F.col("__ts_n") == F.col("__ts_size")) & (F.col("__ts_c") == F.col("__ts_crc"))
    wide = own.join(where, same).drop("__ts_id", "__ts_size", "__ts_crc", "__ts_n", "__ts_c")
    wide.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(16))).sortWithinPartitions("shard", id_col).write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
