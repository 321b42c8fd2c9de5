"""One sync cycle on a committed state: scans in, ledger, references, waiting rows, messages, clock and log out.

``run`` reads the state once, settles the rows of the accounts whose scan was whole, applies the rules of the ledger to
what was booked, stamps the change messages of the rules with the state's clock, and commits every table that follows
in one version: a cycle that fails anywhere leaves the state as it was and can be run again. Accounts whose scan failed
keep their rows as they are; if none was read, only the log gets a row.
"""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as fn
from ..session import scratch
from . import changelog as cl
from . import lifecycle as lc
from . import reports as rp
from . import rule_table as rt
from . import rules as ru
from . import store
from .commit import State

LEDGER = "id string, ord bigint, account bigint, date date, amount_cents bigint, payee_id string, payee_name string, notes string, financial_id string, cleared boolean, imported_payee string, category string"
TABLES = {
    "refs": "ref string, date date", "pending": "key string, txn_id string", "ledger": LEDGER, "payees": "name string, id string",
    "rules": "id string, conditions_op string, conditions string, actions string, tombstone int",
    "clock": "clock string", "outbox": "dataset string, row string, column string, value string, timestamp string",
    "log": "id bigint, as_of date, status string, added bigint, confirmed bigint, skipped bigint, rules_applied bigint, message string",
}


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, as several of the tables that follow read it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamped(messages: DataFrame, clock: str, client: str, now: str) -> tuple[DataFrame, str]:
    """Messages (row_order, position) with a timestamp each, counted on from ``clock``, and the clock after them. Numbers
    without gaps come from the sizes of ranges, so no task sees all messages."""
    spark = messages.sparkSession
    dealt = _kept(messages.repartitionByRange("row_order", "position").sortWithinPartitions("row_order", "position").withColumn("part", F.spark_partition_id()), "messages")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("start"), "count")
    place = F.row_number().over(Window.partitionBy("part").orderBy("row_order", "position")) - 1
    numbered = dealt.withColumn("n", place).join(F.broadcast(starts.select("part", "start")), "part").withColumn("ord", F.col("n") + F.col("start"))
    n = dealt.count()
    before = spark.range(1).select(fn.parse_clock(F.lit(clock)).alias("c")).first()["c"]
    first = before["counter"] + 1 if before is not None else 0
    out = cl.stamp(numbered, F.lit(now).cast("timestamp"), first, client).select("dataset", "row", "column", "value", "timestamp")
    after = spark.range(1).select(fn.format_clock(F.lit(now).cast("timestamp"), F.lit(first + n - 1), F.lit(client)).alias("c")).first()["c"] if n else clock
    return out, after


def run(state: State, feed: DataFrame, scans: DataFrame, as_of: dt.date, client: str = "0000000000000000", now: str | None = None, also: dict[str, DataFrame] | None = None) -> int:
    """One cycle. feed: rows of ``sources.feed.scan_accounts`` with ``feed_ord``; scans: its status (account, error).
    ``also`` are further tables to commit with the cycle's own.

    Returns the number of the version that was committed."""
    now = now or f"{as_of} 00:00:00"
    known = {name: state.read(name, schema) for name, schema in TABLES.items()}
    day = F.lit(as_of)
    outcome = rp.fetch_outcome(scans).first()
    next_id = (known["log"].agg(F.max("id")).first()[0] or 0) + 1
    log = lambda n: known["log"].unionByName(state.spark.createDataFrame([(next_id, as_of, outcome["status"], *n, outcome["errors"])], TABLES["log"]))
    if outcome["status"] != "success":
        return state.commit({"log": log((0, 0, 0, 0))} | (also or {}))
    refs = store.prune_refs(known["refs"], day)
    settled = lc.settle(feed, refs, known["pending"], known["ledger"], known["payees"])
    old = known["ledger"].select(F.col("id").alias("ledger_id"), "category")
    on = F.col("for_rules")
    rows = settled.join(old, "ledger_id", "left").withColumns({c: F.when(on, F.col(c)) for c in ("notes", "payee_id", "payee_name", "imported_payee")} | {f"own_{c}": F.col(c) for c in ("notes", "payee_id", "payee_name", "cleared", "imported_payee")})
    names = known["payees"].select("id", "name")
    applied = rt.apply_table(rows, rt.read_rules(known["rules"]), names, messages="messages")
    ruled = {c: F.when(on, F.col(c)).otherwise(F.col(f"own_{c}")) for c in ("notes", "payee_id", "payee_name", "cleared", "imported_payee")}
    no_rules, no_messages = F.array().cast("array<string>"), F.filter("messages", lambda _: F.lit(False))
    done = applied.withColumns(ruled | {"matched_rules": F.when(on, F.col("matched_rules")).otherwise(no_rules), "messages": F.when(on, F.col("messages")).otherwise(no_messages)})
    done = _kept(done.drop(*[c for c in done.columns if c.startswith("own_")]), "settled")
    clock = known["clock"].first()
    sent, clock = stamped(ru.action_messages(done, "ledger_id", "feed_ord"), clock["clock"] if clock else cl.EPOCH, client, now)
    n = done.agg(*[F.count_if(c) for c in ("added", "confirmed", "skipped")], F.coalesce(F.sum(F.size("matched_rules")), F.lit(0))).first()
    categories = done.where(on & (F.coalesce("category", F.lit("")) != "")).groupBy("ledger_id").agg(F.max_by("category", "feed_ord").alias("now"))
    ledger = lc.next_ledger(known["ledger"], done).join(categories, F.col("id") == F.col("ledger_id"), "left").withColumn("category", F.coalesce("now", "category")).drop("ledger_id", "now")
    met = done.where(F.col("changed") & (F.coalesce("payee_name", F.lit("")) != "")).groupBy(F.col("payee_name").alias("name")).agg(F.min("payee_id").alias("id"))
    payees = known["payees"].unionByName(met.join(known["payees"].select("name"), "name", "left_anti"))
    return state.commit(
        {
            "payees": payees, "refs": lc.next_refs(refs, done, day), "pending": lc.next_pending(known["pending"], done), "ledger": ledger, "outbox": sent,
            "clock": state.spark.createDataFrame([(clock,)], TABLES["clock"]), "log": log(tuple(n)),
        } | (also or {})
    )
