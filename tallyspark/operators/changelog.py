"""Cell-level change messages: capture from rows, merge by last arrival, and partial-column upsert."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn

#: Datasets whose messages are not merged.
SKIPPED = ("prefs",)


def capture(rows: DataFrame, dataset: str, id_col: str, cells: dict[str, Column], order: Column | None = None) -> DataFrame:
    """One message (dataset, row, column, value) per cell, in the order of ``cells``; ``cells`` holds encoded values.

    With ``order`` (the rows' own ordinal) messages get ``ord``: row by row, then cell by cell.
    """
    wide = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(name).alias("column"), value.alias("value")) for k, (name, value) in enumerate(cells.items())])
    own = [] if order is None else [order.alias("__row")]
    long = rows.select(F.col(id_col).cast("string").alias("row"), *own, F.explode(wide).alias("c"))
    out = long.select(F.lit(dataset).alias("dataset"), "row", F.col("c.column").alias("column"), F.col("c.value").alias("value"), *([] if order is None else [(F.col("__row") * len(cells) + F.col("c.position")).alias("ord")]))
    return out


def merge_cells(messages: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """The last-arrived value of every cell (a null-valued message counts), with its arrival."""
    m = messages.where(~F.col("dataset").isin(*skipped) & fn.is_safe_identifier("column"))
    return m.groupBy("dataset", "row", "column").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))


def records(messages: DataFrame, columns: list[str], skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """A row per (dataset, row): decoded texts of ``columns``, which of them were sent, and the order of first sight."""
    m = messages.where(~F.col("dataset").isin(*skipped))
    one = lambda c: F.max_by(F.when(F.col("column") == c, F.col("value")), F.when(F.col("column") == c, F.col("ord"))).alias(c)
    sent = lambda c: (F.count(F.when(F.col("column") == c, 1)) > 0).alias(f"{c}_sent")
    return m.groupBy("dataset", "row").agg(*[one(c) for c in columns], *[sent(c) for c in columns], F.min("ord").alias("first_ord"))


def merge_into(table: DataFrame, cells: DataFrame, columns: dict[str, Column], id_col: str = "id") -> DataFrame:
    """Partial-column upsert: rows of ``cells`` (from ``records``) change only the columns that were sent.

    columns: decoded value of each target column. A row with none of them is left alone; a new one is inserted.
    """
    sent = F.lit(False)
    for c in columns:
        sent = sent | F.col(f"{c}_sent")
    new = cells.where(sent).select(F.col("row").alias("__row"), *[F.col(f"{c}_sent").alias(f"__{c}_sent") for c in columns], *[v.alias(f"__{c}") for c, v in columns.items()])
    both = table.join(new, F.col(id_col) == F.col("__row"), "full_outer")
    pick = lambda c: F.when(F.coalesce(F.col(f"__{c}_sent"), F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)) if c in columns else F.col(c)
    return both.select(*[F.coalesce(F.col(id_col), F.col("__row")).alias(id_col) if c == id_col else pick(c).alias(c) for c in table.columns])


def stamp(messages: DataFrame, ts: Column, counter_from: int, client: str) -> DataFrame:
    """Messages with a clock's timestamp each; the counter goes up by one in order of ``ord`` (given gapless from 0)."""
    return messages.withColumn("timestamp", fn.format_clock(ts, F.col("ord") + counter_from, F.lit(client)))


def load_clock(clocks: DataFrame, epoch: str = "1970-01-01T00:00:00.000Z-0000-0000000000000000") -> DataFrame:
    """The stored clock's parts; a missing or malformed one is the epoch's."""
    said = clocks.select(F.get_json_object("clock", "$.timestamp").alias("t")).agg(F.first("t").alias("t"))
    return said.select(F.coalesce(fn.parse_clock("t"), fn.parse_clock(F.lit(epoch))).alias("c")).select("c.*")


# Pulling since a clock

EPOCH = "1970-01-01T00:00:00.000Z-0000-0000000000000000"


def clock_order(text: Column | str) -> Column:
    """What clocks are ordered by: time, then counter, then client; null for a malformed one."""
    c = fn.parse_clock(text)
    return F.when(c.isNotNull(), F.struct(c["ts"].alias("ts"), c["counter"].alias("counter"), c["client"].alias("client")))


def _with_order(messages: DataFrame, stamp: str) -> DataFrame:
    """Messages with their clock's order, behind a generator, so that a condition on it is not pushed below what makes the
    text: that would make and read the text again for every part of the order."""
    read = messages.select("*", F.explode(F.array(fn.parse_clock(stamp))).alias("__clock"))
    return read.select(*messages.columns, F.when(F.col("__clock").isNotNull(), F.struct("__clock.ts", "__clock.counter", "__clock.client")).alias("__clock"))


def newer(messages: DataFrame, since: str, stamp: str = "timestamp") -> DataFrame:
    """Messages whose clock is behind ``since`` in the order of clocks; malformed clocks are behind none, and a malformed
    ``since`` counts as the epoch."""
    then = F.coalesce(clock_order(F.lit(since)), clock_order(F.lit(EPOCH)))
    one = messages.sparkSession.range(1).select(then.alias("__then"))  # one row, read once
    return _with_order(messages, stamp).join(F.broadcast(one), F.col("__clock") > F.col("__then")).drop("__clock", "__then")


def advanced(messages: DataFrame, since: str, stamp: str = "timestamp") -> str:
    """The clock after ``messages`` were taken in: that of the last of them, or ``since`` if there is none."""
    last = _with_order(messages, stamp).agg(F.max_by(stamp, "__clock").alias("t")).first()["t"]  # one row
    return since if last is None else last


def pull(log: DataFrame, cells: DataFrame, since: str) -> tuple[DataFrame, str]:
    """Cells (dataset, row, column, value, timestamp) after the messages of ``log`` that are newer than ``since``, and
    the clock to ask with the next time. Of a cell's values the one with the last clock stays, of equal clocks the greatest."""
    new = newer(log, since)
    both = cells.unionByName(new.where(~F.col("dataset").isin(*SKIPPED) & fn.is_safe_identifier("column")).select(cells.columns))
    last = F.max_by(F.struct("value", "timestamp"), F.struct(clock_order("timestamp"), "value"))
    merged = both.groupBy("dataset", "row", "column").agg(last.alias("l")).select("dataset", "row", "column", "l.value", "l.timestamp")
    return merged, advanced(new, since)
