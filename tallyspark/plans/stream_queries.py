"""Streaming forms, driven over files that are there now, and the wire codecs."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import changelog as cl
from ..operators import lifecycle as lc
from ..operators.commit import State
from ..session import scratch
from ..sources import testdata as td
from ..sources import wire
from ..streaming import pipelines as sp
from ..streaming import recurring as rec
from ..streaming import settling as st
from . import cycle_queries
from .registry import query


def _folder(spark) -> str:
    return scratch(spark, "stream")


def _landings(spark, df, folder: str, parts: int = 4):
    """``df`` (with a column ord_) landing in ``parts`` parts, in order of ord_: after each of them, the stream of what has
    landed, to be driven on from where it stopped. A part is one batch of any number of files."""
    df.write.parquet(f"{folder}/all")  # made once
    whole = spark.read.schema(df.schema).parquet(f"{folder}/all")
    cut = whole.approxQuantile("ord_", [k / parts for k in range(1, parts)], 0.001)
    for low, high in zip([None, *cut], [*cut, None], strict=True):
        part = whole.where((F.lit(low is None) | (F.col("ord_") > F.lit(low))) & (F.lit(high is None) | (F.col("ord_") <= F.lit(high))))
        part.drop("ord_").write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(df.drop("ord_").schema).parquet(f"{folder}/in")


@query(
    "stream_dedup",
    """
WITH RECURSIVE e AS (SELECT 'R' || (user_id % 60) AS entry_ref, ts::TIMESTAMP AS ts FROM events),
k AS (SELECT entry_ref, min(ts) AS ts FROM e GROUP BY entry_ref UNION ALL
      SELECT k.entry_ref, min(e.ts) FROM k JOIN e ON e.entry_ref = k.entry_ref AND e.ts > k.ts + INTERVAL 3 DAY GROUP BY k.entry_ref)
SELECT entry_ref, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM k
""",
)
def stream_dedup(spark, sf_dir):
    folder = _folder(spark)
    e = td.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("R"), F.col("user_id") % 60).alias("entry_ref"))
    e = e.withColumn("ord_", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    for landed in _landings(spark, e, folder):
        out = sp.run_available(sp.dedup_refs(landed, days=3), folder)
    return out.select("entry_ref", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("stream_pending", cycle_queries.fold_sql(prior=False))
def stream_pending(spark, sf_dir):
    folder = _folder(spark)
    feed = cycle_queries.colliding(spark, sf_dir)
    for landed in _landings(spark, feed.withColumn("ord_", F.col("feed_ord").cast("double")), folder):
        out = sp.run_available(sp.pending_to_booked(landed), folder)
    return out.select("feed_ord", "branch")


@query("stream_settle", cycle_queries.LIFECYCLE_SQL)
def stream_settle(spark, sf_dir):
    """The counters of ``lifecycle_counts``, from a stream on top of the tables before it."""
    folder = _folder(spark)
    before = st.initial_state(cycle_queries._refs(spark, sf_dir), cycle_queries._pending(spark, sf_dir), td.ledger(spark, sf_dir))
    feed = td.feed(spark, sf_dir).withColumn("ord_", F.col("feed_ord").cast("double"))
    for landed in _landings(spark, feed, folder):
        settled = sp.run_available(st.settle_stream(landed, cycle_queries._payees(spark, sf_dir), before), folder, st.STATE_CONF)
    return lc.counters(settled).withColumn("account", F.coalesce("account", F.lit(-1)))


RUN_DAYS = ("1996-01-01", "1999-01-01", "2001-12-31")


def _runs_sql() -> str:
    """Rows of each run: from the day of the run before (the first: 30 days back) to its own; those of the first day again."""
    one = lambda k, since, upto: f"SELECT {k}::BIGINT AS id, count(*) FILTER (WHERE date > DATE '{since}' OR {k} = 1) AS added, count(*) FILTER (WHERE date = DATE '{since}' AND {k} > 1) AS skipped FROM feed WHERE date BETWEEN DATE '{since}' AND DATE '{upto}'"
    parts = [one(k + 1, "1995-12-02" if k == 0 else RUN_DAYS[k - 1], day) for k, day in enumerate(RUN_DAYS)]
    return f"WITH feed AS ({td.FEED_SQL}) " + " UNION ALL ".join(parts)


@query("recurring_runs", _runs_sql())
def recurring_runs(spark, sf_dir):
    """Three recurring runs, each a restart on what has landed until its day, with windows that overlap by that day."""
    folder = _folder(spark)
    feed = td.feed(spark, sf_dir).withColumns({"status": F.lit("BOOK"), "cleared": F.lit(True)})
    scans = spark.createDataFrame([(0, 1, None)], "account long, pages long, error string")
    before = None
    for day in RUN_DAYS:
        landed = feed.where((F.col("date") <= F.lit(day).cast("date")) & (F.lit(True) if before is None else F.col("date") > F.lit(before).cast("date")))
        landed.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arrivals = spark.readStream.schema(feed.schema).parquet(f"{folder}/in")
        fetch = lambda since: (spark.read.schema(feed.schema).parquet(f"{folder}/in").where(F.col("date") >= F.lit(since)), scans)
        rec.recurring(arrivals, fetch, f"{folder}/state", f"{folder}/runs", None, lambda day=day: dt.date.fromisoformat(day)).start().awaitTermination()
        before = day
    return State(spark, f"{folder}/state").read("log").select("id", "added", "skipped")


@query("stream_merge", f'WITH m AS ({td.MESSAGES_SQL}), l AS (SELECT *, row_number() OVER (PARTITION BY dataset, "row", "column" ORDER BY ord DESC) AS k FROM m) SELECT dataset, "row", "column", value, ord FROM l WHERE k = 1')
def stream_merge(spark, sf_dir):
    folder = _folder(spark)
    m = td.messages(spark, sf_dir).withColumn("ord_", F.col("ord").cast("double"))
    for landed in _landings(spark, m, folder, 5):
        sp.merge_messages(landed, f"{folder}/cells", f"{folder}/state", compact_every=2).start().awaitTermination()
    return sp.read_cells(spark, f"{folder}/cells")


_CLOCKS = "SELECT date_trunc('day', ts::TIMESTAMP) AS t, (event_id * 7919) % 4096 AS n, 'C' || (user_id % 5) AS client, event_id % 2 = 0 AS early FROM events"


@query("pull_since", f"WITH c AS ({_CLOCKS}), last AS (SELECT max(ROW(t, n, client)) AS c FROM c WHERE early), late AS (SELECT c.* FROM c, last WHERE ROW(c.t, c.n, c.client) > last.c) SELECT (SELECT count(*) FROM c WHERE early) AS first_pull, (SELECT count(*) FROM late) AS second_pull, 0::BIGINT AS third_pull, coalesce((SELECT max(ROW(t, n, client)) FROM late), (SELECT c FROM last))[2]::BIGINT AS counter")
def pull_since(spark, sf_dir):
    """Three pulls, the second and third from a log that has grown in between: each brings only what is newer than the clock."""
    m = td.table(spark, sf_dir, "events")
    clock = cl.fn.format_clock(F.date_trunc("day", F.col("ts").cast("timestamp")), (F.col("event_id") * 7919) % 4096, F.concat(F.lit("C"), F.col("user_id") % 5))
    log = m.select(F.lit("t").alias("dataset"), F.col("event_id").cast("string").alias("row"), F.lit("c").alias("column"), F.lit("S:x").alias("value"), clock.alias("timestamp"), (F.col("event_id") % 2 == 0).alias("early"))
    since, brought = cl.EPOCH, []
    for part in (log.where("early"), log, log):
        new = cl.newer(part, since)
        brought.append(new.count())
        since = cl.advanced(new, since)
    return spark.range(1).select(*[F.lit(n).cast("long").alias(c) for n, c in zip(brought, ("first_pull", "second_pull", "third_pull"), strict=True)], cl.fn.parse_clock(F.lit(since))["counter"].cast("long").alias("counter"))


@query("stream_push", f'WITH m AS ({td.MESSAGES_SQL}) SELECT dataset, "row", "column", value, row_number() OVER (ORDER BY ord) - 1 AS counter, \'CLIENT\' AS client FROM m')
def stream_push(spark, sf_dir):
    folder = _folder(spark)
    m = td.messages(spark, sf_dir).withColumn("ord_", F.col("ord").cast("double"))
    for landed in _landings(spark, m, folder, 3):
        sp.push_messages(landed, f"{folder}/sent", f"{folder}/state", "file", "group", "CLIENT", a_request=500).start().awaitTermination()
    sent = spark.read.parquet(*[f"{folder}/sent/batch={k}" for k in sp._written(spark, f"{folder}/sent", "batch")])
    back = wire.response_messages(sent)
    counter = F.conv(F.regexp_extract("timestamp", r"Z-([0-9A-F]+)-", 1), 16, 10).cast("long")
    return back.select("dataset", "row", "column", "value", counter.alias("counter"), F.regexp_extract("timestamp", r"Z-[0-9A-F]+-(.*)$", 1).alias("client"))


@query("wire_roundtrip", f'WITH m AS ({td.MESSAGES_SQL}) SELECT "row" AS batch, ord, dataset, "column", value FROM m')
def wire_roundtrip(spark, sf_dir):
    m = td.messages(spark, sf_dir)
    stamped = cl.stamp(m, F.lit("2024-01-01 00:00:00").cast("timestamp"), 0, "CLIENT").withColumn("batch", F.col("row"))
    sent = wire.request_bodies(wire.in_requests(stamped, ["batch"], sp.MESSAGES_A_REQUEST), "", "", ["batch", "request"])
    counter = F.conv(F.regexp_extract("timestamp", r"Z-([0-9A-F]+)-", 1), 16, 10).cast("long")
    return wire.response_messages(sent.drop("request")).select("batch", counter.alias("ord"), "dataset", "column", "value")


@query("archive_scan", "SELECT n_name AS name, 'db.sqlite' AS file, octet_length(encode(n_name)) AS bytes FROM nation")
def archive_scan(spark, sf_dir):
    def pack(names: pa.Array) -> pa.Array:
        import io
        import zipfile

        out = []
        for n in names.to_pylist():
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as z:
                z.writestr("folder/db.sqlite", n)
                z.writestr("other.txt", n)
            out.append(raw.getvalue())
        return pa.array(out, pa.binary())

    zips = td.table(spark, sf_dir, "nation").select(F.col("n_name").alias("bank"), F.arrow_udf(pack, "binary")("n_name").alias("content"))
    return wire.archive_files(zips).select(F.col("bank").alias("name"), F.col("name").alias("file"), F.octet_length("data").alias("bytes"))
