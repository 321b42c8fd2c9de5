"""Reports over whole test tables."""

from pyspark.sql import functions as F

from ..operators import reports as rp
from ..session import scratch
from ..sources import testdata as td
from .registry import query

AS_OF = "TIMESTAMP '2024-02-10 12:00:00'"
_LOGS = f"WITH logs AS ({td.LOGS_SQL})"


@query("run_counters", f"{_LOGS} SELECT status, count(*) AS runs FROM logs GROUP BY status")
def run_counters(spark, sf_dir):
    return rp.runs_by_status(td.logs(spark, sf_dir))


def _buckets(bounds):
    return "CASE " + " ".join(f"WHEN duration_sec <= {b} THEN '{b:g}'" for b in bounds) + " ELSE '+Inf' END"


@query("duration_histogram", f"{_LOGS} SELECT {_buckets(rp.RUN_BOUNDS)} AS le, count(*) AS n, round(sum(duration_sec), 4) AS total, min(duration_sec) AS least, max(duration_sec) AS most FROM logs GROUP BY 1")
def duration_histogram(spark, sf_dir):
    return rp.histogram(td.logs(spark, sf_dir), "duration_sec").withColumn("total", F.round("total", 4))


@query("fetch_histogram", f"{_LOGS} SELECT message, {_buckets(rp.FETCH_BOUNDS)} AS le, count(*) AS n FROM logs GROUP BY 1, 2")
def fetch_histogram(spark, sf_dir):
    return rp.histogram(td.logs(spark, sf_dir), "duration_sec", rp.FETCH_BOUNDS, ["message"]).select("message", "le", "n")


@query("log_topk", f"{_LOGS} SELECT id, status, message FROM logs ORDER BY id DESC LIMIT 20")
def log_topk(spark, sf_dir):
    return rp.newest_logs(td.logs(spark, sf_dir)).select("id", "status", "message")


@query("log_latest", f"{_LOGS} SELECT id, status FROM logs ORDER BY id DESC LIMIT 1")
def log_latest(spark, sf_dir):
    return rp.latest_log(td.logs(spark, sf_dir)).select("id", "status")


@query("account_list", f"WITH a AS ({td.BANK_ACCOUNTS_SQL}) SELECT id, created_at, bank_name FROM a ORDER BY created_at, id")
def account_list(spark, sf_dir):
    return rp.accounts_in_order(td.bank_accounts(spark, sf_dir)).select("id", "created_at", "bank_name")


_DAYS = f"trunc((epoch(session_expiry::TIMESTAMP) - epoch({AS_OF})) / 86400)::INT"


@query(
    "health_rollup",
    f"""
{_LOGS}, a AS ({td.BANK_ACCOUNTS_SQL}), x AS (SELECT count(*) AS accounts, count(*) FILTER (WHERE {_DAYS.replace("session_expiry::TIMESTAMP", "replace(session_expiry, 'Z', '')::TIMESTAMP")} < 7) AS expiring FROM a), l AS (SELECT status AS last_status FROM logs ORDER BY id DESC LIMIT 1)
SELECT accounts, expiring, last_status, CASE WHEN expiring > 0 OR last_status <> 'success' THEN 'degraded' ELSE 'healthy' END AS status, 200 AS http_status, 60 AS hours_since_sync FROM x, l
""",
)
def health_rollup(spark, sf_dir):
    return rp.health(td.bank_accounts(spark, sf_dir), td.logs(spark, sf_dir), "2024-02-08", F.expr(AS_OF))


@query("gauges", f"WITH a AS ({td.BANK_ACCOUNTS_SQL}), f AS (SELECT session_expiry FROM a ORDER BY created_at, id LIMIT 1) SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS pending_rows, trunc((epoch(replace(session_expiry, 'Z', '')::TIMESTAMP) - epoch({AS_OF})) / 86400)::INT AS days_to_expiry FROM f")
def gauges(spark, sf_dir):
    pending = td.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    return rp.gauges(td.bank_accounts(spark, sf_dir), pending, F.expr(AS_OF))


@query("error_concat", f"{_LOGS} SELECT account, string_agg(message, '; ' ORDER BY id) AS errors FROM logs WHERE status = 'error' GROUP BY account")
def error_concat(spark, sf_dir):
    return rp.error_text(td.logs(spark, sf_dir).where("status = 'error'"), ["account"], "id")


@query("fetch_outcome", "SELECT 'success' AS status, count(*) FILTER (WHERE s_suppkey % 10 = 0) AS failed, string_agg(s_suppkey || ': ' || s_name, '; ' ORDER BY s_suppkey) FILTER (WHERE s_suppkey % 10 = 0) AS errors FROM supplier")
def fetch_outcome(spark, sf_dir):
    k = F.col("s_suppkey")
    return rp.fetch_outcome(td.table(spark, sf_dir, "supplier").select(k.alias("account"), F.when(k % 10 == 0, F.col("s_name")).alias("error")))


def _components(spark, sf_dir):
    k = F.col("p_partkey")
    purl = F.concat(F.element_at(F.array(F.lit("pkg:golang/"), F.lit("pkg:apk/"), F.lit("pkg:npm/")), (k % 3 + 1).cast("int")), "p_name")
    lic = lambda i, n: F.array(F.struct(F.struct(i.alias("id"), n.alias("name")).alias("license")))
    some = F.when(k % 4 == 0, F.array().cast("array<struct<license:struct<id:string,name:string>>>")).when(k % 4 == 1, lic(F.lit("MIT"), F.lit("x"))).otherwise(lic(F.lit(""), F.col("p_brand")))
    return td.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), k.cast("string").alias("version"), purl.alias("purl"), some.alias("licenses"))


_KIND = "CASE p_partkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'apk' ELSE 'other' END"


@query("inventory_split", f"SELECT {_KIND} AS kind, p_name AS name, p_partkey::VARCHAR AS version, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'MIT' ELSE p_brand END AS license FROM part ORDER BY kind, name, version")
def inventory_split(spark, sf_dir):
    return rp.inventory(_components(spark, sf_dir))


@query("inventory_counts", f"SELECT {_KIND} AS kind, count(*) AS components FROM part GROUP BY ROLLUP (1)")
def inventory_counts(spark, sf_dir):
    return rp.inventory_counts(_components(spark, sf_dir))


@query("inventory_scan", f"SELECT {_KIND} AS kind, p_name AS name, p_partkey::VARCHAR AS version, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'MIT' ELSE p_brand END AS license FROM part")
def inventory_scan(spark, sf_dir):
    """The inventory as files of one JSON document each, read back whole."""
    folder = scratch(spark, "inventory")
    parts = _components(spark, sf_dir).withColumn("file", F.pmod(F.xxhash64("name"), F.lit(8)))
    docs = parts.groupBy("file").agg(F.collect_list(F.struct("name", "version", "purl", "licenses")).alias("components"))
    docs.repartition("file").select("file", F.to_json(F.struct("components")).alias("value")).write.partitionBy("file").text(folder)
    return rp.inventory(rp.read_inventory(spark, folder))


@query("version_max", "SELECT '1.' || (l_partkey % 30) || '.' || (l_suppkey % 20) || '.' || l_linenumber AS newest FROM lineitem WHERE l_orderkey % 7 <> 0 ORDER BY l_partkey % 30 DESC, l_suppkey % 20 DESC, l_linenumber DESC LIMIT 1")
def version_max(spark, sf_dir):
    """Tags as a registry lists them: JSON pages of names."""
    tag = F.concat(F.when(F.col("l_orderkey") % 7 == 0, "v1.").otherwise("1."), F.col("l_partkey") % 30, F.lit("."), F.col("l_suppkey") % 20, F.lit("."), "l_linenumber")
    tags = td.table(spark, sf_dir, "lineitem").select(tag.alias("name")).distinct().withColumn("page_no", F.pmod(F.xxhash64("name"), F.lit(100)))
    pages = tags.groupBy("page_no").agg(F.to_json(F.struct(F.collect_list(F.struct("name")).alias("results"))).alias("page"))
    return rp.newest_version(rp.tag_names(pages.select("page").union(spark.createDataFrame([("no page",)], "page string"))))


@query("distinct_in_order", "SELECT r_name AS country, min(n_nationkey)::BIGINT AS first_seen FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY first_seen")
def distinct_in_order(spark, sf_dir):
    n, r = td.table(spark, sf_dir, "nation"), td.table(spark, sf_dir, "region")
    banks = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("country"), F.col("n_nationkey").cast("long").alias("position"))
    return rp.countries_in_order(banks)


@query("json_props", "SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, sf_dir):
    e = td.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))
