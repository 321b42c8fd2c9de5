"""Rules that stand in a table, over whole test tables: as many rules as there are suppliers."""

from pyspark.sql import functions as F

from ..operators import rule_table as rt
from ..sources import testdata as td
from .registry import query


def _rules(spark, sf_dir):
    """Suppliers as rules on the customer of their number; every fifth is deleted or is no JSON."""
    k = F.col("s_suppkey")
    name = F.format_string("Customer#%09d", k)
    c = lambda kind, field, op, value: F.format_string(f'{{"type":"{kind}","field":"{field}","op":"{op}","value":%s}}', value)
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    listed = lambda *x: F.concat(F.lit("["), F.concat_ws(",", *x), F.lit("]"))
    own = c("string", "payee_name", "is", quoted(F.upper(name)))
    conditions = (
        F.when(k % 5 == 0, listed(own, F.when(k % 10 == 0, c("string", "notes", "isNot", F.lit('"Order 1-URGENT"')))))
        .when(k % 5 == 1, listed(c("imported_payee", "imported_payee", "contains", quoted(F.lower(name))), c("number", "amount", "gt", ((k % 7) * 1_000_000).cast("string"))))
        .when(k % 5 == 2, listed(c("string", "payee_name", "oneOf", F.concat(F.lit("["), quoted(name), F.lit("]"))), c("number", "amount", "isbetween", F.format_string('{"num1":%d,"num2":%d}', k * 1000, k * 1000 + 99))))
        .when(k % 5 == 4, listed(own, c("string", "notes", "matches", F.lit('"^order [1-3]-"'))))
        .otherwise(F.when(k % 2 == 0, "[{").otherwise(listed(own)))
    )
    action = lambda field, op, value: F.format_string(f'[{{"field":"{field}","op":"{op}","value":%s}}]', value)
    actions = F.when(k % 5 == 0, action("category", "set", quoted(F.concat(F.lit("cat-"), k)))).when(k % 5 == 1, action("notes", "append-notes", quoted(F.concat(F.lit(" #"), k)))).when(k % 5 == 2, action("notes", "prepend-notes", quoted(F.concat(k, F.lit(": "))))).otherwise(action("cleared", "set", F.lit("true")))
    return td.table(spark, sf_dir, "supplier").select(F.format_string("r%09d", k).alias("id"), F.when(k % 5 == 2, "or").otherwise("and").alias("conditions_op"), conditions.alias("conditions"), actions.alias("actions"), F.when((k % 5 == 3) & (k % 2 != 0), 1).otherwise(0).alias("tombstone"))


def _rows(spark, sf_dir):
    f = td.feed(spark, sf_dir)
    return f.select("feed_ord", F.col("account").cast("string").alias("account"), "amount_cents", "notes", "cleared", F.lit("").alias("payee_id"), F.col("payee").alias("payee_name"), F.col("payee").alias("imported_payee"), F.lit("").alias("category"))


HITS_SQL = f"""
WITH feed AS ({td.FEED_SQL}), rules AS (
  SELECT s_suppkey AS k, 'r' || lpad(s_suppkey::VARCHAR, 9, '0') AS id, 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') AS name FROM supplier
), hits AS (
  SELECT f.feed_ord, r.k, r.id FROM feed f JOIN rules r ON f.payee = r.name
  WHERE CASE r.k % 5 WHEN 0 THEN r.k % 10 <> 0 OR f.notes <> 'order 1-URGENT' WHEN 1 THEN f.amount_cents > (r.k % 7) * 1000000 WHEN 2 THEN true WHEN 4 THEN regexp_matches(f.notes, '^order [1-3]-') ELSE false END
  UNION SELECT f.feed_ord, r.k, r.id FROM feed f JOIN rules r ON r.k % 5 = 2 AND f.amount_cents BETWEEN r.k * 1000 AND r.k * 1000 + 99
)
"""


@query("rule_table_load", "SELECT 'r' || lpad(s_suppkey::VARCHAR, 9, '0') AS id, CASE WHEN s_suppkey % 5 = 2 THEN 'or' ELSE 'and' END AS op, CASE WHEN s_suppkey % 5 IN (1, 2, 4) OR s_suppkey % 10 = 0 THEN 2 ELSE 1 END AS n_conditions, 1 AS n_actions FROM supplier WHERE s_suppkey % 5 <> 3")
def rule_table_load(spark, sf_dir):
    rules = rt.read_rules(_rules(spark, sf_dir))
    return spark.createDataFrame([(r.id, r.op, len(r.conditions), len(r.actions)) for r in rules], "id string, op string, n_conditions int, n_actions int")


@query("rule_table_match", HITS_SQL + "SELECT f.feed_ord, coalesce(string_agg(h.id, ',' ORDER BY h.id), '') AS matched FROM feed f LEFT JOIN hits h ON h.feed_ord = f.feed_ord GROUP BY f.feed_ord")
def rule_table_match(spark, sf_dir):
    return rt.match_table(_rows(spark, sf_dir), rt.read_rules(_rules(spark, sf_dir))).select("feed_ord", F.array_join("matched_rules", ",").alias("matched"))


@query(
    "rule_table_actions",
    HITS_SQL
    + """, seen AS (
  SELECT feed_ord, max(k) FILTER (WHERE k % 5 = 0) AS category, string_agg(' #' || k, '' ORDER BY k) FILTER (WHERE k % 5 = 1) AS behind, string_agg(k || ': ', '' ORDER BY k DESC) FILTER (WHERE k % 5 = 2) AS ahead,
         coalesce(bool_or(k % 5 = 4), false) AS cleared, count(*) AS n FROM hits GROUP BY feed_ord
)
SELECT f.feed_ord, CASE WHEN s.category IS NULL THEN '' ELSE 'cat-' || s.category END AS category, coalesce(s.ahead, '') || f.notes || coalesce(s.behind, '') AS notes, f.cleared OR coalesce(s.cleared, false) AS cleared, coalesce(s.n, 0) AS n_messages
FROM feed f LEFT JOIN seen s ON s.feed_ord = f.feed_ord
""",
)
def rule_table_actions(spark, sf_dir):
    x = rt.apply_table(_rows(spark, sf_dir), rt.read_rules(_rules(spark, sf_dir)), messages="messages")
    return x.select("feed_ord", "category", "notes", "cleared", F.size("messages").cast("long").alias("n_messages"))
