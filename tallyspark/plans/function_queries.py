"""Scalar functions and feed normalisation over whole test tables."""

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import reports as rp
from ..sources import feed as feed_source
from ..sources import testdata as td
from .registry import query

AS_OF = "TIMESTAMP '2024-02-10 12:00:00'"

PAGES_SQL = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey % 50 AS account, o_orderstatus, o_orderdate, o_totalprice, o_orderpriority, c_name, o_orderkey % 3 <> 0 AS debit
  FROM orders JOIN customer ON o_custkey = c_custkey
), r AS (
  SELECT *, 'line ' || k AS line1, CASE WHEN debit AND (k % 7 <> 0 OR k % 14 = 0) THEN c_name WHEN NOT debit AND k % 7 <> 0 AND k % 9 <> 0 THEN c_name ELSE 'line ' || k END AS payee
  FROM o
)
"""


@query(
    "feed_normalize",
    PAGES_SQL
    + """
SELECT account, k // 50 AS page_no, CASE WHEN k % 5 = 0 THEN 'BOOK' WHEN o_orderstatus = 'O' THEN 'PDNG' ELSE 'BOOK' END AS status, o_orderdate::DATE AS date,
       CASE WHEN debit THEN -1 ELSE 1 END * round(round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR::DOUBLE * 100)::BIGINT AS amount_cents, payee,
       CASE WHEN k % 2 = 0 THEN o_orderpriority ELSE line1 || ' second' END AS notes, CASE WHEN k % 6 <> 0 THEN 'REF-' ELSE 'TX-' END || k AS entry_ref
FROM r WHERE k % 17 <> 0
""", dates=('date',))
def feed_normalize(spark, sf_dir):
    return feed_source.feed_scan(td.feed_pages(spark, sf_dir), ["own name"]).drop("position")


@query("feed_drop_malformed", "SELECT count(*) AS records, count(*) FILTER (WHERE o_orderkey % 17 = 0 OR o_orderkey % 19 = 0) AS malformed FROM orders JOIN customer ON o_custkey = c_custkey")
def feed_drop_malformed(spark, sf_dir):
    """Records without a date, and every 19th with an amount that no number of cents holds."""
    records = feed_source.page_records(td.feed_pages(spark, sf_dir))
    huge = F.regexp_extract("record", r'"line (\d+)"', 1).cast("long") % 19 == 0
    records = records.withColumn("record", F.when(huge, F.regexp_replace("record", r'"amount":"[^"]*"', '"amount":"1e30"')).otherwise(F.col("record")))
    rows = feed_source.normalise_records(records)
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("valid")).alias("malformed"))


@query("feed_pages", "SELECT DISTINCT o_custkey % 50 AS account, o_orderkey // 50 AS page_no, (o_orderkey // 50)::VARCHAR AS continuation_key FROM orders JOIN customer ON o_custkey = c_custkey")
def feed_pages(spark, sf_dir):
    return feed_source.continuation(td.feed_pages(spark, sf_dir)).select("account", "page_no", "continuation_key")


SCAN_SQL = """
WITH f AS (
  SELECT o_orderkey AS k, o_custkey % 50 AS account, o_orderkey // 50 AS page_no, o_orderkey % 17 <> 0 AS valid,
         CASE WHEN o_orderkey % 3 <> 0 THEN -1 ELSE 1 END * round(round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR::DOUBLE * 100)::BIGINT AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey
), a AS (
  SELECT account, count(DISTINCT page_no) AS pages, count(*) FILTER (WHERE valid) AS n, sum(cents) FILTER (WHERE valid) AS cents FROM f GROUP BY account
), s AS (
  SELECT *, CASE WHEN pages = 1 THEN NULL ELSE CASE account % 10 WHEN 3 THEN 'page 1: cannot be decoded' WHEN 5 THEN 'page 1: status 503' WHEN 7 THEN 'page 1 is missing' WHEN 9 THEN 'page 1 does not continue the one before it' END END AS error FROM a
)
"""


@query("feed_scan_status", SCAN_SQL + "SELECT account, error, CASE WHEN error IS NULL THEN pages ELSE 0 END AS pages, CASE WHEN error IS NULL THEN n ELSE 0 END AS n, CASE WHEN error IS NULL THEN cents ELSE 0 END::BIGINT AS cents FROM s")
def feed_scan_status(spark, sf_dir):
    rows, status = feed_source.scan_accounts(td.landed_pages(spark, sf_dir), ["own name"])
    sums = rows.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"))
    return status.join(sums, "account", "left").select("account", "error", "pages", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cents", F.lit(0)).alias("cents"))


@query("feed_scan_outcome", SCAN_SQL + "SELECT CASE WHEN count(*) = count(error) THEN 'fetch_error' ELSE 'success' END AS status, count(error) AS failed, coalesce(string_agg(account || ': ' || error, '; ' ORDER BY account) FILTER (WHERE error IS NOT NULL), '') AS errors FROM s")
def feed_scan_outcome(spark, sf_dir):
    """What a run reports of its scans: the errors by account, and fetch_error if none was read."""
    return rp.fetch_outcome(feed_source.scan_status(feed_source.decode_pages(td.landed_pages(spark, sf_dir))))


@query(
    "cents_decimal",
    """
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN -1 ELSE 1 END * round(l_extendedprice * l_discount * 100)::BIGINT AS cents FROM lineitem)
SELECT cents, CASE WHEN cents < 0 THEN '-' ELSE '' END || (abs(cents) // 100) || '.' || lpad((abs(cents) % 100)::VARCHAR, 2, '0') AS decimal_text, cents AS back, count(*) AS n
FROM x GROUP BY cents
""",
)
def cents_decimal(spark, sf_dir):
    cents = F.when(F.col("l_orderkey") % 2 == 0, -1).otherwise(1) * F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")
    x = td.table(spark, sf_dir, "lineitem").select(cents.cast("long").alias("cents")).groupBy("cents").agg(F.count(F.lit(1)).alias("n"))
    x = x.withColumn("decimal_text", fn.cents_to_decimal("cents"))
    return x.withColumn("back", fn.decimal_to_cents("decimal_text"))


@query("date_int", "SELECT o_orderdate::DATE AS d, strftime(o_orderdate, '%Y%m%d')::INT AS n, o_orderdate::DATE AS back, count(*) AS rows_of FROM orders GROUP BY ALL", dates=('d', 'back'))
def date_int(spark, sf_dir):
    x = td.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("rows_of"))
    x = x.withColumn("n", fn.date_to_int("d"))
    return x.withColumn("back", fn.int_to_date("n"))


@query(
    "title_case",
    """
SELECT p_partkey AS k, array_to_string(list_transform(list_filter(string_split(p_name || '  ' || upper(p_type), ' '), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS titled FROM part
""",
)
def title_case(spark, sf_dir):
    return td.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), fn.title_case(F.concat("p_name", F.lit(" \t"), F.upper("p_type"))).alias("titled"))


@query("own_name_filter", "SELECT c_custkey, c_name, lower(c_name) IN ('customer#000000007', 'customer#000000011') AS own FROM customer")
def own_name_filter(spark, sf_dir):
    own = fn.own_names(" Customer#000000007,, CUSTOMER#000000011 ")
    return td.table(spark, sf_dir, "customer").select("c_custkey", "c_name", fn.is_own_name("c_name", own).alias("own"))


@query(
    "value_codec",
    """
SELECT event_id, 'S:' || event_type AS s, 'N:' || event_id AS n, CASE WHEN event_id % 3 = 0 THEN '0:' ELSE 'N:' || floor(value)::BIGINT END AS f,
       event_type AS s_back, CASE WHEN event_id % 3 = 0 THEN NULL ELSE floor(value) END AS f_back, CASE WHEN event_id % 4 IN (0, 2) THEN false ELSE true END AS truth,
       (event_id % 1000)::DOUBLE AS prefix
FROM events
""",
)
def value_codec(spark, sf_dir):
    e = td.table(spark, sf_dir, "events")
    k = F.col("event_id")
    x = e.select("event_id", fn.encode_text("event_type").alias("s"), fn.encode_number("event_id").alias("n"), fn.encode_number(F.when(k % 3 != 0, F.floor("value").cast("long"))).alias("f"), (k % 4).alias("r"))
    words = F.element_at(F.array(F.lit("0"), F.lit("yes"), F.lit("false"), F.lit("1")), (F.col("r") + 1).cast("int"))
    return x.select("event_id", "s", "n", "f", fn.decode_text("s").alias("s_back"), fn.decode_number("f").alias("f_back"), fn.truthy(words).alias("truth"), fn.number_prefix(F.concat(F.lit(" "), F.col("event_id") % 1000, F.lit("x9"))).alias("prefix"))


@query("clock_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((date_part('millisecond', ts)::INT % 1000)::VARCHAR, 3, '0') || 'Z-' || CASE WHEN event_id * 9 < 65536 THEN lpad(upper(to_hex(event_id * 9)), 4, '0') ELSE upper(to_hex(event_id * 9)) END || '-ABCDEF' AS clock FROM events")
def clock_format(spark, sf_dir):
    return td.table(spark, sf_dir, "events").select("event_id", fn.format_clock("ts", F.col("event_id") * 9, F.lit("ABCDEF")).alias("clock"))


@query("clock_parse", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, (event_id * 9)::INT AS counter, 'ABCDEF' AS client FROM events WHERE event_id % 13 <> 0")
def clock_parse(spark, sf_dir):
    e = td.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 13 == 0, "notavalidtimestamp").otherwise(fn.format_clock("ts", F.col("event_id") * 9, F.lit("ABCDEF")))
    x = e.select("event_id", fn.parse_clock(text).alias("c")).where("c IS NOT NULL")
    return x.select("event_id", F.date_format("c.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "c.counter", "c.client")


@query(
    "pending_key",
    f"""
WITH feed AS ({td.FEED_SQL}), x AS (SELECT *, CASE WHEN feed_ord % 4 = 0 THEN '' ELSE entry_ref END AS ref FROM feed), y AS (
  SELECT feed_ord, CASE WHEN ref <> '' THEN ref ELSE strftime(date, '%Y-%m-%d') || '|' || CASE WHEN amount_cents < 0 THEN '-' ELSE '' END || (abs(amount_cents) // 100) || '.' || lpad((abs(amount_cents) % 100)::VARCHAR, 2, '0') END AS key FROM x)
SELECT feed_ord, key, CASE WHEN contains(key, '|') THEN split_part(key, '|', 1) ELSE key END AS head, CASE WHEN contains(key, '|') THEN split_part(key, '|', 2) ELSE '' END AS tail FROM y
""",
)
def pending_key(spark, sf_dir):
    f = td.feed(spark, sf_dir).withColumn("ref", F.when(F.col("feed_ord") % 4 == 0, "").otherwise(F.col("entry_ref")))
    x = f.select("feed_ord", fn.pending_key("ref", "date", "amount_cents").alias("key"))
    return x.select("feed_ord", "key", fn.split_pending("key")["txn_id"].alias("head"), fn.split_pending("key")["date"].alias("tail"))


@query("mask_iban", "SELECT c_custkey, CASE WHEN length(v) <= 8 THEN v ELSE left(v, 4) || repeat('*', length(v) - 8) || right(v, 4) END AS masked, CASE WHEN c_custkey % 3 = 0 THEN v ELSE c_mktsegment END AS uid FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE left(c_name, 8) END AS v FROM customer)")
def mask_iban(spark, sf_dir):
    c = td.table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.left("c_name", F.lit(8))))
    return c.select("c_custkey", fn.mask_iban("v").alias("masked"), fn.effective_uid(F.lit(""), F.when(F.col("c_custkey") % 3 == 0, F.col("v")), "c_mktsegment").alias("uid"))


@query(
    "days_left_bucket",
    f"""
WITH x AS (SELECT o_orderkey, o_orderkey % 50 - 5 AS off FROM orders), y AS (
  SELECT o_orderkey, TIMESTAMP '2024-02-10 00:00:00' + INTERVAL (off) DAY AS expiry FROM x), z AS (
  SELECT o_orderkey, trunc((epoch(expiry) - epoch({AS_OF})) / 86400)::INT AS days FROM y)
SELECT o_orderkey, days, CASE WHEN days = 0 THEN 'none' WHEN days < 7 THEN 'red' WHEN days < 30 THEN 'yellow' ELSE 'green' END AS badge FROM z
""",
)
def days_left_bucket(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    day = F.date_add(F.lit("2024-02-10").cast("date"), (F.col("o_orderkey") % 50 - 5).cast("int"))
    text = F.concat(F.date_format(day, "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "T00:00:00Z").otherwise("T00:00:00"))
    x = o.select("o_orderkey", fn.days_left(fn.parse_expiry(text), F.expr(AS_OF)).alias("days"))
    return x.withColumn("badge", fn.expiry_badge("days"))


@query("percent_encode", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name || '/' || p_brand || '?', ''), lambda c: c <> ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9._~-]$') THEN c ELSE '%' || lpad(upper(to_hex(ord(c)::BIGINT)), 2, '0') END), '') AS encoded FROM part")
def percent_encode(spark, sf_dir):
    return td.table(spark, sf_dir, "part").select("p_partkey", fn.percent_encode(F.concat("p_name", F.lit("/"), "p_brand", F.lit("?"))).alias("encoded"))


@query("number_text", "SELECT event_id, CASE WHEN event_id % 1000 = 0 THEN '0' ELSE (event_id % 1000)::VARCHAR END AS whole, (event_id % 1000) || '.5' AS half, CASE WHEN event_id = 0 THEN '0' ELSE '1e+' || CASE WHEN event_id % 2 = 0 THEN '06' ELSE '21' END END AS wide FROM events")
def number_text(spark, sf_dir):
    k = F.col("event_id") % 1000
    wide = F.when(F.col("event_id") == 0, 0.0).when(F.col("event_id") % 2 == 0, 1e6).otherwise(1e21)
    return td.table(spark, sf_dir, "events").select("event_id", fn.format_g(k).alias("whole"), fn.format_g(k + 0.5).alias("half"), fn.format_g(wide).alias("wide"))
