"""The test tables seen as feed, ledger, messages and logs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCOUNTS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as normalised feed rows; the customer is the payee."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.join(c.select("c_custkey", "c_name"), o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("feed_ord"), (F.col("o_custkey") % ACCOUNTS).alias("account"), F.when(F.col("o_orderstatus") == "O", "PDNG").otherwise("BOOK").alias("status"),
        F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderkey") % 3 != 0, -cents).otherwise(cents).alias("amount_cents"), F.col("c_name").alias("payee"),
        F.concat(F.lit("order "), F.col("o_orderpriority")).alias("notes"), F.concat(F.lit("REF-"), F.col("o_orderkey")).alias("entry_ref"), (F.col("o_orderstatus") != "O").alias("cleared"),
    )


FEED_SQL = """
  SELECT o_orderkey AS feed_ord, o_custkey % 50 AS account, CASE WHEN o_orderstatus = 'O' THEN 'PDNG' ELSE 'BOOK' END AS status,
         o_orderdate::DATE AS date, CASE WHEN o_orderkey % 3 <> 0 THEN -1 ELSE 1 END * round(o_totalprice * 100)::BIGINT AS amount_cents, c_name AS payee,
         'order ' || o_orderpriority AS notes, 'REF-' || o_orderkey AS entry_ref, o_orderstatus <> 'O' AS cleared
  FROM orders JOIN customer ON o_custkey = c_custkey
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second order as a ledger row, with values that differ from the feed's here and there."""
    f = feed(spark, sf_dir).where("feed_ord % 2 = 0")
    k = F.col("feed_ord")
    return f.select(
        F.concat(F.lit("T"), k).alias("id"), k.alias("ord"), "account", "date", "amount_cents", F.concat(F.lit("P-"), F.col("payee")).alias("payee_id"), F.col("payee").alias("payee_name"),
        F.when(k % 10 == 0, "edited").otherwise(F.col("notes")).alias("notes"), F.when(k % 4 == 0, F.col("entry_ref")).otherwise("").alias("financial_id"), (k % 6 != 0).alias("cleared"), F.when(k % 8 == 0, F.col("payee")).otherwise("").alias("imported_payee"),
    )


LEDGER_SQL = """
  SELECT 'T' || feed_ord AS id, feed_ord AS ord, account, date, amount_cents, 'P-' || payee AS payee_id, payee AS payee_name,
         CASE WHEN feed_ord % 10 = 0 THEN 'edited' ELSE notes END AS notes, CASE WHEN feed_ord % 4 = 0 THEN entry_ref ELSE '' END AS financial_id,
         feed_ord % 6 <> 0 AS cleared, CASE WHEN feed_ord % 8 = 0 THEN payee ELSE '' END AS imported_payee
  FROM feed WHERE feed_ord % 2 = 0
"""


def feed_pages(spark: SparkSession, sf_dir: str, a_page: int = 50) -> DataFrame:
    """The feed as landed JSON pages of varied record shapes; every 17th record is malformed."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k, name, price = F.col("o_orderkey"), F.col("c_name"), F.col("o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    amount = F.round(price, 2).cast("decimal(18,2)").cast("string")
    debit = k % 3 != 0
    record = F.struct(
        F.when(k % 5 != 0, F.when(F.col("o_orderstatus") == "O", "PDNG").otherwise("BOOK")).alias("status"),
        F.when(k % 17 == 0, "not-a-date").when(k % 4 != 0, F.concat(day, F.lit("T00:00:00Z"))).alias("transaction_date"), F.when((k % 4 == 0) & (k % 17 != 0), day).alias("booking_date"),
        F.struct(amount.alias("amount")).alias("transaction_amount"), F.when(debit, "DBIT").otherwise("crdt").alias("credit_debit_indicator"),
        F.when(debit & (k % 7 != 0), F.struct(name.alias("name"))).alias("creditor"), F.when(debit & (k % 14 == 0), name).alias("creditor_name"),
        F.when(~debit & (k % 7 != 0), F.struct(F.when(k % 9 == 0, "Own Name").otherwise(name).alias("name"))).alias("debtor"),
        F.array(F.concat(F.lit("line "), k), F.lit("second")).alias("remittance_information"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("remittance_information_unstructured"),
        F.when(k % 6 != 0, F.concat(F.lit("REF-"), k)).alias("entry_reference"), F.when(k % 6 == 0, F.concat(F.lit("TX-"), k)).alias("transaction_id"),
    )
    rows = o.join(c.select("c_custkey", "c_name"), o.o_custkey == c.c_custkey).select((F.col("o_custkey") % ACCOUNTS).alias("account"), F.floor(k / a_page).alias("page_no"), k.alias("k"), F.to_json(record).alias("r"))
    pages = rows.groupBy("account", "page_no").agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("rows"))
    body = F.concat(F.lit('{"transactions":['), F.array_join(F.col("rows.r"), ","), F.lit('],"continuation_key":"'), F.col("page_no"), F.lit('"}'))
    return pages.select("account", "page_no", body.alias("page"))


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's pages as chains by account. Of every ten accounts one has a page that is no JSON, one a refused page,
    one a page that never came, one a page asked for with another key; each is the account's second page."""
    along = Window.partitionBy("account").orderBy("page_no")  # a few pages an account
    p = feed_pages(spark, sf_dir).withColumn("nth", F.row_number().over(along) - 1)
    p = p.withColumns({"before": F.coalesce(F.lag("page_no").over(along).cast("string"), F.lit("")), "last": F.lead("page_no").over(along).isNull()})
    bad = lambda k: (F.col("account") % 10 == k) & (F.col("nth") == 1)
    page = F.when(bad(3), "<html>busy</html>").when(bad(5), "").when(F.col("last"), F.regexp_replace("page", r'"continuation_key":"\d+"\}$', '"continuation_key":""}')).otherwise(F.col("page"))
    landed = p.where(~bad(7)).select("account", F.col("nth").alias("page_no"), F.when(bad(9), "other").otherwise(F.col("before")).alias("request_key"), F.when(bad(5), 503).otherwise(200).alias("status"), page.alias("page"))
    return landed


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cell messages; every eleventh sets null, and pings are skipped as a dataset."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 11 == 0, "0:").when(F.col("event_id") % 2 == 0, F.concat(F.lit("N:"), F.floor(F.col("value") * 100).cast("long"))).otherwise(F.concat(F.lit("S:"), F.col("event_type")))
    return e.select(F.col("event_type").alias("dataset"), F.concat(F.lit("r"), F.col("user_id") % 40).alias("row"), F.concat(F.lit("c"), F.col("event_id") % 5).alias("column"), value.alias("value"), F.col("event_id").alias("ord"))


MESSAGES_SQL = """
  SELECT event_type AS dataset, 'r' || (user_id % 40) AS "row", 'c' || (event_id % 5) AS "column",
         CASE WHEN event_id % 11 = 0 THEN '0:' WHEN event_id % 2 = 0 THEN 'N:' || floor(value * 100)::BIGINT ELSE 'S:' || event_type END AS value, event_id AS ord
  FROM events
"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run logs."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 9 == 0, "error").otherwise("success").alias("status"), F.col("value").alias("duration_sec"), F.col("event_type").alias("message"), F.col("user_id").alias("account"))


LOGS_SQL = """
  SELECT event_id AS id, ts, CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'success' END AS status, value AS duration_sec, event_type AS message, user_id AS account FROM events
"""


def bank_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as connected accounts."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.concat(F.lit("SESSION"), k).alias("session_id"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("2024-0"), 1 + k % 3, F.lit("-15"))).alias("start_sync_date"),
        F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), (k % 60).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("session_expiry"), F.concat(F.lit("2024-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0")).alias("created_at"), F.col("s_name").alias("bank_name"),
    )


BANK_ACCOUNTS_SQL = """
  SELECT s_suppkey AS id, 'SESSION' || s_suppkey AS session_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '2024-0' || (1 + s_suppkey % 3) || '-15' END AS start_sync_date,
         strftime(DATE '2024-02-01' + (s_suppkey % 60)::INT, '%Y-%m-%d') || 'T00:00:00Z' AS session_expiry, '2024-01-' || lpad((1 + s_suppkey % 28)::VARCHAR, 2, '0') AS created_at, s_name AS bank_name
  FROM supplier
"""
