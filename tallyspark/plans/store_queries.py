"""Keyed tables, dimensions and change messages over whole test tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import changelog as cl
from ..operators import store as st
from ..schemas import LEGACY_STATE
from ..session import scratch
from ..sources import directory
from ..sources import testdata as td
from .registry import query

_CUT = "DATE '2001-07-11'"


@query("ledger_scan", f"WITH feed AS ({td.FEED_SQL}), ledger AS ({td.LEDGER_SQL}) SELECT id, account, date, amount_cents, coalesce(c_name, '') AS payee_name, notes, financial_id FROM ledger LEFT JOIN customer ON payee_name = c_name AND c_custkey % 3 <> 0 ORDER BY date DESC, id", dates=('date',))
def ledger_scan(spark, sf_dir):
    payees = td.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("P-"), "c_name").alias("payee_id"), "c_name")
    rows = td.ledger(spark, sf_dir).drop("payee_name").join(payees, "payee_id", "left")
    return rows.select("id", "account", "date", "amount_cents", F.coalesce("c_name", F.lit("")).alias("payee_name"), "notes", "financial_id").orderBy(F.col("date").desc(), "id")


@query("dim_cache_last_wins", "SELECT p_brand AS name, arg_max(p_partkey, p_partkey)::VARCHAR AS id FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0 GROUP BY p_brand")
def dim_cache_last_wins(spark, sf_dir):
    k = F.col("p_partkey")
    dim = td.table(spark, sf_dir, "part").select(k.cast("string").alias("id"), F.when(k % 7 != 0, F.col("p_brand")).otherwise("").alias("name"), (k % 10 == 0).cast("int").alias("tombstone"), k.alias("ord"))
    return st.name_to_id(dim)


@query("point_lookup", "SELECT (SELECT n_name FROM nation WHERE n_nationkey = 7) AS found, '' AS missing, true AS known, false AS unknown")
def point_lookup(spark, sf_dir):
    n = td.table(spark, sf_dir, "nation")
    s = n.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    one = [st.get_setting(s, "7").withColumnRenamed("value", "found"), st.get_setting(s, "999").withColumnRenamed("value", "missing")]
    one += [st.exists(n, F.col("n_nationkey") == 3).withColumnRenamed("found", "known"), st.exists(n, F.col("n_nationkey") == 300).withColumnRenamed("found", "unknown")]
    out = one[0]
    for x in one[1:]:
        out = out.join(x)  # one row each
    return out


@query("file_resolution", "SELECT s_suppkey::VARCHAR AS file_id, s_name AS name FROM supplier WHERE s_suppkey = 5")
def file_resolution(spark, sf_dir):
    k = F.col("s_suppkey")
    files = td.table(spark, sf_dir, "supplier").select(k.cast("string").alias("file_id"), F.col("s_name").alias("name"), F.concat(F.lit("g"), k % 2).alias("group_id"), (k % 10 == 9).alias("deleted"))
    one = st.resolve_file(files, "5")
    many, none = st.resolve_file(files, "g1"), st.resolve_file(files, "9")
    return one.unionByName(many).unionByName(none).select("file_id", "name")


@query("kv_upsert", "WITH t AS (SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_name AS key, 'new ' || max(c_custkey) AS value FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_name) SELECT coalesce(n.key, t.key) AS key, coalesce(n.value, t.value) AS value FROM t FULL JOIN n ON t.key = n.key")
def kv_upsert(spark, sf_dir):
    c = td.table(spark, sf_dir, "customer")
    table = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    changes = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("key"), F.concat(F.lit("new "), "c_custkey").alias("value"), F.col("c_custkey").alias("ord"))
    return st.upsert(table, st.latest(changes, "key", "ord").select("key", "value"), "key")


@query("insert_ignore", "SELECT 'REF-' || o_orderkey AS ref, CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE 'new' END AS date FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 0")
def insert_ignore(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    ref = F.concat(F.lit("REF-"), "o_orderkey").alias("ref")
    return st.insert_ignore(o.where("o_orderkey % 4 = 0").select(ref, F.lit("old").alias("date")), o.where("o_orderkey % 6 = 0").select(ref, F.lit("new").alias("date")), "ref")


@query("get_or_create_payee", "SELECT DISTINCT c_name AS name, c_custkey % 3 = 0 AS created, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'P' || c_custkey END AS known_id FROM customer JOIN orders ON o_custkey = c_custkey")
def get_or_create_payee(spark, sf_dir):
    c = td.table(spark, sf_dir, "customer")
    payees = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("P"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("tombstone"))
    names = td.feed(spark, sf_dir).select(F.col("payee").alias("name"))
    found, _ = st.get_or_create_payees(payees, names)
    return found.select("name", "created", F.when(F.col("created"), "").otherwise(F.col("id")).alias("known_id"))


@query("get_or_create_account", "SELECT n_name AS name, n_nationkey % 2 = 1 AS created, (n_nationkey % 2)::BIGINT AS transfer_payees FROM nation")
def get_or_create_account(spark, sf_dir):
    n = td.table(spark, sf_dir, "nation")
    accounts = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("A"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(0).alias("tombstone"))
    found, payees, _ = st.get_or_create_accounts(accounts, n.select(F.col("n_name").alias("name")))
    made = payees.groupBy(F.col("transfer_acct").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(made, "id", "left").select("name", "created", F.coalesce("n", F.lit(0)).alias("transfer_payees"))


@query("account_delete_update", f"WITH a AS ({td.BANK_ACCOUNTS_SQL}) SELECT id, CASE WHEN id % 3 = 0 THEN 'NEW' || id ELSE session_id END AS session_id FROM a WHERE id % 5 <> 0")
def account_delete_update(spark, sf_dir):
    a = td.bank_accounts(spark, sf_dir).select("id", "session_id")
    left = st.delete_keys(a, a.where("id % 5 = 0"), "id")
    return st.upsert(left, left.where("id % 3 = 0").select("id", F.concat(F.lit("NEW"), "id").alias("session_id")), "id")


@query(
    "new_transactions",
    f"""
WITH feed AS ({td.FEED_SQL}), c AS (SELECT c_name, min('P' || c_custkey) AS pid FROM customer GROUP BY c_name)
SELECT substr(sha256('txn' || chr(1) || account || chr(1) || entry_ref || chr(1) || strftime(date, '%Y-%m-%d') || chr(1) || amount_cents || chr(1) || feed_ord), 1, 32) AS id,
       account AS acct, strftime(date, '%Y%m%d')::INT AS date, amount_cents AS amount,
       CASE WHEN feed_ord % 5 = 0 THEN substr(sha256('payee' || chr(1) || 'Night Tram ' || account), 1, 32) ELSE pid END AS description,
       CASE WHEN feed_ord % 7 <> 0 THEN notes END AS notes, entry_ref AS financial_id, cleared::INT AS cleared, CASE WHEN feed_ord % 5 = 0 THEN 'night  TRAM ' || account ELSE payee END AS imported_description
FROM feed JOIN c ON c_name = payee
""",
)
def new_transactions(spark, sf_dir):
    c = td.table(spark, sf_dir, "customer")
    payees = c.select(F.concat(F.lit("P"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("tombstone"))
    k = F.col("feed_ord")
    f = td.feed(spark, sf_dir).withColumns({"payee": F.when(k % 5 == 0, F.concat(F.lit("night  TRAM "), "account")).otherwise(F.col("payee")), "notes": F.when(k % 7 != 0, F.col("notes")).otherwise("")})
    return st.new_transactions(f, payees)


@query(
    "change_capture",
    f"""
WITH feed AS ({td.FEED_SQL}), c AS (
  SELECT 'T' || feed_ord AS "row", 'amount' AS "column", 'N:' || amount_cents AS value, feed_ord * 3 AS ord FROM feed UNION ALL
  SELECT 'T' || feed_ord, 'notes', 'S:' || notes, feed_ord * 3 + 1 FROM feed UNION ALL
  SELECT 'T' || feed_ord, 'category', '0:', feed_ord * 3 + 2 FROM feed)
SELECT 'transactions' AS dataset, "row", "column", value, ord FROM c
""",
)
def change_capture(spark, sf_dir):
    f = td.feed(spark, sf_dir).withColumn("id", F.concat(F.lit("T"), "feed_ord"))
    cells = {"amount": fn.encode_number("amount_cents"), "notes": fn.encode_text("notes"), "category": fn.encode_text(F.lit(None).cast("string"))}
    return cl.capture(f, "transactions", "id", cells, F.col("feed_ord"))


@query(
    "changelog_merge",
    f"""
WITH m AS ({td.MESSAGES_SQL}), last AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, "row", "column" ORDER BY ord DESC) AS k FROM m WHERE dataset <> 'prefs')
SELECT dataset, "row", "column", value, ord, CASE WHEN starts_with(value, 'S:') THEN substr(value, 3) END AS text,
       CASE WHEN starts_with(value, 'N:') THEN substr(value, 3)::DOUBLE END AS number FROM last WHERE k = 1
""",
)
def changelog_merge(spark, sf_dir):
    x = cl.merge_cells(td.messages(spark, sf_dir))
    return x.select("dataset", "row", "column", "value", "ord", fn.decode_text("value").alias("text"), fn.decode_number("value").alias("number"))


@query(
    "changelog_records",
    f"""
WITH m AS ({td.MESSAGES_SQL}), l AS (SELECT *, row_number() OVER (PARTITION BY dataset, "row", "column" ORDER BY ord DESC) AS k FROM m)
SELECT dataset, "row", max(CASE WHEN "column" = 'c1' AND k = 1 THEN value END) AS c1, max(CASE WHEN "column" = 'c2' AND k = 1 THEN value END) AS c2,
       bool_or("column" = 'c1') AS c1_sent, bool_or("column" = 'c2') AS c2_sent, min(ord) AS first_ord FROM l GROUP BY dataset, "row"
""",
)
def changelog_records(spark, sf_dir):
    return cl.records(td.messages(spark, sf_dir), ["c1", "c2"])


@query(
    "partial_upsert",
    f"""
WITH m AS ({td.MESSAGES_SQL}), l AS (SELECT *, row_number() OVER (PARTITION BY "row", "column" ORDER BY ord DESC) AS k FROM m WHERE "column" IN ('c1', 'c2')),
r AS (SELECT "row" AS id, max(CASE WHEN "column" = 'c1' AND k = 1 THEN value END) AS c1, bool_or("column" = 'c1') AS s1, max(CASE WHEN "column" = 'c2' AND k = 1 THEN value END) AS c2, bool_or("column" = 'c2') AS s2 FROM l GROUP BY "row"),
t AS (SELECT 'r' || n_nationkey AS id, n_name AS c1, n_name AS c2, n_regionkey AS other FROM nation)
SELECT coalesce(t.id, r.id) AS id, CASE WHEN coalesce(r.s1, false) THEN CASE WHEN starts_with(r.c1, 'S:') THEN substr(r.c1, 3) END ELSE t.c1 END AS c1,
       CASE WHEN coalesce(r.s2, false) THEN CASE WHEN starts_with(r.c2, 'S:') THEN substr(r.c2, 3) END ELSE t.c2 END AS c2, t.other FROM t FULL JOIN r ON t.id = r.id
""",
)
def partial_upsert(spark, sf_dir):
    n = td.table(spark, sf_dir, "nation")
    t = n.select(F.concat(F.lit("r"), "n_nationkey").alias("id"), F.col("n_name").alias("c1"), F.col("n_name").alias("c2"), F.col("n_regionkey").alias("other"))
    cells = cl.records(td.messages(spark, sf_dir).withColumn("dataset", F.lit("nations")), ["c1", "c2"])
    return cl.merge_into(t, cells, {c: fn.decode_text(c) for c in ("c1", "c2")})


@query("ref_prune", f"WITH feed AS ({td.FEED_SQL}) SELECT entry_ref AS ref, date FROM feed WHERE date >= {_CUT}", dates=('date',))
def ref_prune(spark, sf_dir):
    refs = td.feed(spark, sf_dir).select(F.col("entry_ref").alias("ref"), "date")
    return st.prune_refs(refs, F.lit("2001-08-01").cast("date"))


def _legacy(spark, sf_dir):
    n = td.table(spark, sf_dir, "nation")
    pairs = lambda *p: F.map_from_entries(F.sort_array(F.collect_list(F.struct(*p))))
    doc = n.agg(pairs(F.concat(F.lit("k"), "n_nationkey"), "n_name").alias("pending_map"), pairs(F.concat(F.lit("REF"), "n_nationkey"), F.lit("2024-01-05")).alias("imported_refs"))
    doc = doc.select(F.to_json(F.struct(F.lit("S1").alias("session_id"), F.lit("U1").alias("account_uid"), F.lit("2024-05-01").alias("last_sync_date"), "pending_map", "imported_refs")).alias("value"))
    return doc.select(F.from_json("value", LEGACY_STATE).alias("s")).select("s.*")


@query(
    "legacy_import",
    """
SELECT 'pending' AS kind, 'k' || n_nationkey AS key, CASE WHEN n_nationkey < 5 THEN 'kept' ELSE n_name END AS value FROM nation
UNION ALL SELECT 'refs', 'REF' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '2023-12-31' ELSE '2024-01-05' END FROM nation
UNION ALL SELECT * FROM (VALUES ('settings', 'last_sync_date', '2024-05-01'), ('settings', 'other', 'x'), ('some accounts', 'S0', 'U0'), ('no accounts', 'S1', 'U1'))
""",
)
def legacy_import(spark, sf_dir):
    n, state = td.table(spark, sf_dir, "nation"), _legacy(spark, sf_dir)
    some = spark.createDataFrame([("S0", "U0", "")], "session_id string, account_uid string, session_expiry string")
    settings = spark.createDataFrame([("last_sync_date", "2023-01-01"), ("other", "x")], "key string, value string")
    refs = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("REF"), "n_nationkey").alias("ref"), F.lit("2023-12-31").alias("date"))
    pending = n.where("n_nationkey < 5").select(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.lit("kept").alias("txn_id"))
    got, bare = st.import_legacy(state, some, settings, refs, pending), st.import_legacy(state, some.limit(0), settings, refs, pending)
    parts = [("pending", got["pending"]), ("refs", got["refs"]), ("settings", got["settings"]), ("some accounts", got["accounts"]), ("no accounts", bare["accounts"])]
    out = None
    for kind, df in parts:
        one = df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("key"), F.col(df.columns[1]).alias("value"))
        out = one if out is None else out.union(one)
    return out


@query(
    "log_append",
    """
SELECT row_number() OVER (ORDER BY status) AS id, status, added, confirmed, seconds, message FROM (
  SELECT o_orderstatus AS status, count(*) AS added, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS confirmed, (min(o_orderkey) / 2.0)::DOUBLE AS seconds, 'run ' || o_orderstatus AS message FROM orders GROUP BY o_orderstatus)
""",
)
def log_append(spark, sf_dir):
    """One append per status, each by itself: ids go on."""
    o = td.table(spark, sf_dir, "orders")
    runs = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("added"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("confirmed"), (F.min("o_orderkey") / 2.0).alias("seconds")).withColumn("message", F.concat(F.lit("run "), "status"))
    folder = scratch(spark, "log")
    for status in ("F", "O", "P"):
        log = st.append_log(folder, runs.where(F.col("status") == status), "status")
    return log


@query(
    "directory_cache",
    """
SELECT 'first' AS answer, n_name AS name, n_nationkey::BIGINT AS position FROM nation WHERE n_nationkey < 20
UNION ALL SELECT 'after a day less a second', n_name, n_nationkey FROM nation WHERE n_nationkey < 20
UNION ALL SELECT 'after a day', n_name, n_nationkey FROM nation WHERE n_nationkey >= 3
""",
)
def directory_cache(spark, sf_dir):
    """Each answer is written out at once, as a later one replaces the snapshot."""
    n = td.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("x").alias("country"), F.col("n_nationkey").cast("long").alias("position"))
    folder, day = scratch(spark, "directory"), datetime(2024, 1, 1, 8)
    calls = [("first", None, day, "position < 20"), ("after a day less a second", day, day + timedelta(days=1, seconds=-1), "position < 0"), ("after a day", day, day + timedelta(days=1), "position >= 3")]
    for answer, taken, now, where in calls:
        banks, _ = directory.bank_directory(spark, f"{folder}/snapshot", taken, now, lambda where=where: n.where(where))
        banks.select(F.lit(answer).alias("answer"), "name", "position").write.mode("append").parquet(f"{folder}/answers")
    return spark.read.parquet(f"{folder}/answers")


@query("clock_load", "SELECT 10 + n_nationkey AS counter, 'C' || n_nationkey AS client, 0::INT AS fresh_counter, '0000000000000000' AS fresh_client FROM nation WHERE n_nationkey = 5")
def clock_load(spark, sf_dir):
    n = td.table(spark, sf_dir, "nation").where("n_nationkey = 5")
    clock = fn.format_clock(F.lit("2019-07-02 23:05:09").cast("timestamp"), F.col("n_nationkey") + 10, F.concat(F.lit("C"), "n_nationkey"))
    stored = n.select(F.to_json(F.struct(clock.alias("timestamp"))).alias("clock"))
    broken = stored.select(F.lit('{"timestamp":"no clock"}').alias("clock"))
    fresh = cl.load_clock(broken).select(F.col("counter").alias("fresh_counter"), F.col("client").alias("fresh_client"))
    return cl.load_clock(stored).select("counter", "client").join(fresh)  # one row each


@query("clock_save", "SELECT 'main' AS id, 'c' || max(o_orderkey) AS clock FROM orders")
def clock_save(spark, sf_dir):
    clocks = spark.createDataFrame([], "id string, clock string")
    saves = td.table(spark, sf_dir, "orders").select(F.lit("main").alias("id"), F.concat(F.lit("c"), "o_orderkey").alias("clock"), F.col("o_orderkey").alias("ord"))
    return st.upsert(clocks, st.latest(saves, "id", "ord"), "id")


@query("pending_as_map", "SELECT string_agg('k' || n_nationkey || '=' || n_name, ',' ORDER BY 'k' || n_nationkey) AS entries FROM nation")
def pending_as_map(spark, sf_dir):
    n = td.table(spark, sf_dir, "nation")
    m = st.as_map(n.select(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.col("n_name").alias("value")))
    return m.select(F.array_join(F.transform(F.array_sort(F.map_entries("entries")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("entries"))


@query("account_by_id", f"WITH a AS ({td.BANK_ACCOUNTS_SQL}) SELECT id, bank_name FROM a WHERE id = 7")
def account_by_id(spark, sf_dir):
    return td.bank_accounts(spark, sf_dir).where("id = 7").select("id", "bank_name")


@query("banks_of_country", "SELECT n_name AS bank FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' ORDER BY bank")
def banks_of_country(spark, sf_dir):
    n, r = td.table(spark, sf_dir, "nation"), td.table(spark, sf_dir, "region").where("r_name = 'EUROPE'")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left_semi").select(F.col("n_name").alias("bank")).orderBy("bank")
