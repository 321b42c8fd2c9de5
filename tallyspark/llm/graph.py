"""Connected components over links, with no link list or component on the driver.

Each partition first contracts its own links with union-find; then large-star and small-star rounds (Kiveris et al.,
2014) run until nothing changes. A node's neighbours are only ever reduced to a minimum, never gathered, and a round's
result is written to the shared folder. The minima of nodes with more than a share of 1 / ``MOST_HOT`` of all links,
``MOST_HOT`` nodes at most for each end of a link, are sent to the links; all others are joined by a shuffle, so the
middle of a large star is no task of its own.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean_rows, materialize

MOST_HOT = 10_000
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _contract(batches):
    parent: dict[bytes, bytes] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
    for i in range(0, len(rows), 100_000):
        part = rows[i : i + 100_000]
        yield pa.record_batch([pa.array([x for x, _ in part], pa.binary()), pa.array([r for _, r in part], pa.binary())], schema=_LINK)


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with m, the least v of each u."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hot = F.col("n") > total / MOST_HOT
    told = rows.join(F.broadcast(least.where(hot).select(F.col("u").alias("hot_u"), F.col("m").alias("hot_m"))), F.col("u") == F.col("hot_u"), "left")
    rest = told.where("hot_u IS NULL").select("u", "v").join(least.where(~hot).select("u", "m"), "u")
    return told.where("hot_u IS NOT NULL").select("u", "v", F.col("hot_m").alias("m")).union(rest.select("u", "v", "m"))


def _large_star(e: DataFrame, total: int) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    x = _with_least(both, total).withColumn("m", F.least("u", "m"))
    return x.where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame, total: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    x = _with_least(down, total)
    moved = x.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(x.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: columns a and b (binary node ids). Returns (node, root) for every linked node but the roots; a root is its component's least id."""
    e = materialize(links.select("a", "b").where("a <> b").mapInArrow(lean_rows(_contract), "a binary, b binary").distinct(), "components")
    sign = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        star = materialize(_large_star(e, max(1, sign[0])), "components")
        before, e = e, materialize(_small_star(star, max(1, sign[0])), "components")
        discard(before)
        discard(star)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = now
