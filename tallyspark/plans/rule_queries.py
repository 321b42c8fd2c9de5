"""The rule language over whole test tables. The same rules are spelled out in SQL."""

import json

from pyspark.sql import functions as F

from ..operators import rules as ru
from ..sources import testdata as td
from .registry import query


def _rule(id_, conditions, actions=(), op="and"):
    return {"id": id_, "conditions_op": op, "conditions": json.dumps(conditions), "actions": json.dumps(list(actions)), "tombstone": 0}


def _c(kind, field, op, value):
    return {"type": kind, "field": field, "op": op, "value": value}


RULE_ROWS = [
    _rule("r1", [_c("string", "payee_name", "contains", "customer#00000001")], [{"field": "category", "op": "set", "value": "cat-a"}]),
    _rule("r2", [_c("number", "amount", "gt", 15000000), _c("string", "notes", "contains", "urgent")], [{"field": "notes", "op": "append-notes", "value": " !"}, {"field": "cleared", "op": "set", "value": True}]),
    _rule("r3", [_c("number", "x", "isbetween", {"num1": -1000000, "num2": -30000000}), _c("string", "notes", "is", "order 3-medium")], [{"field": "payee", "op": "set", "value": "P-Customer#000000007"}], "or"),
    _rule("r4", [_c("string", "notes", "oneOf", ["Order 1-URGENT", "order 2-high"])], [{"field": "notes", "op": "prepend-notes", "value": "* "}, {"field": "category", "op": "set", "value": ""}]),
    _rule("r5", [], [{"field": "flag", "op": "set", "value": "x"}], "or"),
    _rule("r6", [_c("boolean", "cleared", "is", True)], [{"field": "category", "op": "set", "value": "never"}]),
    {"id": "bad1", "conditions_op": "and", "conditions": "NOT JSON", "actions": "[]", "tombstone": 0},
    {"id": "bad2", "conditions_op": "and", "conditions": "[]", "actions": "NOT JSON", "tombstone": 0},
    {"id": "gone", "conditions_op": "and", "conditions": "[]", "actions": "[]", "tombstone": 1},
    {"id": "all", "conditions_op": "", "conditions": "[]", "actions": "[]", "tombstone": 0},
]

_FEED = f"feed AS ({td.FEED_SQL})"
MATCHED_SQL = f"""
{_FEED}, m AS (
  SELECT *, contains(lower(payee), 'customer#00000001') AS r1, amount_cents > 15000000 AND contains(lower(notes), 'urgent') AS r2,
         amount_cents BETWEEN -30000000 AND -1000000 OR lower(notes) = 'order 3-medium' AS r3, lower(notes) IN ('order 1-urgent', 'order 2-high') AS r4 FROM feed)
"""


def _rows(spark, sf_dir):
    f = td.feed(spark, sf_dir)
    return f.select(
        "feed_ord", "account", "amount_cents", "notes", "cleared", F.concat(F.lit("P-"), "payee").alias("payee_id"), F.col("payee").alias("payee_name"), F.col("payee").alias("imported_payee"), F.lit("").alias("category"),
    )


@query("rule_load", "SELECT * FROM (VALUES ('r1', 'and', 1, 1), ('r2', 'and', 2, 2), ('r3', 'or', 2, 1), ('r4', 'and', 1, 2), ('r5', 'or', 0, 1), ('r6', 'and', 1, 1), ('all', 'and', 0, 0)) AS t(id, op, n_conditions, n_actions)")
def rule_load(spark, sf_dir):
    rows = spark.createDataFrame([tuple(r[k] for k in ("id", "conditions_op", "conditions", "actions", "tombstone")) for r in RULE_ROWS], "id string, conditions_op string, conditions string, actions string, tombstone int")
    loaded = ru.load_rules_df(rows.withColumn("stage", F.lit(None).cast("string")))
    return loaded.select("id", "op", F.size("conditions").alias("n_conditions"), F.size("actions").alias("n_actions"))


@query(
    "rule_match_all",
    f"WITH {MATCHED_SQL} SELECT feed_ord, concat_ws(',', CASE WHEN r1 THEN 'r1' END, CASE WHEN r2 THEN 'r2' END, CASE WHEN r3 THEN 'r3' END, CASE WHEN r4 THEN 'r4' END, 'all') AS matched FROM m",
)
def rule_match_all(spark, sf_dir):
    return ru.matched_rules(_rows(spark, sf_dir), ru.load_rules(RULE_ROWS)).select("feed_ord", F.array_join("matched_rules", ",").alias("matched"))


@query(
    "rule_actions",
    f"""
WITH {MATCHED_SQL}, n AS (SELECT *, CASE WHEN r2 THEN notes || ' !' ELSE notes END AS n2 FROM m)
SELECT feed_ord, CASE WHEN r1 THEN 'cat-a' ELSE '' END AS category, CASE WHEN r4 THEN '* ' || n2 ELSE n2 END AS notes, cleared OR r2 AS cleared,
       CASE WHEN r3 THEN 'P-Customer#000000007' ELSE 'P-' || payee END AS payee_id, CASE WHEN r3 THEN 'Customer#000000007' ELSE payee END AS payee_name
FROM n
""",
)
def rule_actions(spark, sf_dir):
    payees = td.table(spark, sf_dir, "customer").select(F.concat(F.lit("P-"), "c_name").alias("id"), F.col("c_name").alias("name"))
    return ru.apply_rules(_rows(spark, sf_dir), ru.load_rules(RULE_ROWS), payees).select("feed_ord", "category", "notes", "cleared", "payee_id", "payee_name")


def _marks(rows, key, **conditions):
    return rows.select(key, *[ru.condition(c).alias(name) for name, c in conditions.items()])


def _as_fields(rows, text):
    return rows.withColumns({"payee_name": F.col(text), "payee_id": F.col(text), "imported_payee": F.col(text), "notes": F.col(text), "account": F.col(text), "category": F.col(text)})


@query(
    "rule_string_ops",
    """
SELECT p_partkey, lower(p_type) = 'promo' AS is_, lower(p_type) <> 'promo' AS is_not, contains(lower(p_name), 're') AS has, NOT contains(lower(p_name), 're') AS has_not,
       lower(p_type) = 'promo' AS one_of, lower(p_type) <> 'promo' AS not_one_of, false AS unknown, true AS empty_has
FROM part
""",
)
def rule_string_ops(spark, sf_dir):
    p = td.table(spark, sf_dir, "part").withColumns({"payee_name": F.col("p_type"), "notes": F.col("p_name")})
    t, n = (lambda op: _c("string", "payee_name", op, "PROMO")), (lambda op, v: _c("string", "notes", op, v))
    return _marks(p, "p_partkey", is_=t("is"), is_not=t("isNot"), has=n("contains", "Re"), has_not=n("doesNotContain", "Re"), one_of=t("oneOf"), not_one_of=t("notOneOf"), unknown=t("soundsLike"), empty_has=n("contains", ""))


@query(
    "rule_list_ops",
    """
SELECT c_custkey, lower(c_mktsegment) IN ('building', 'machinery') AS one_of, lower(c_mktsegment) NOT IN ('building', 'machinery') AS not_one_of, false AS is_not,
       lower(c_mktsegment) IN ('building', 'machinery') AS id_one_of, lower(c_mktsegment) = 'building' AS id_is, false AS id_number
FROM customer
""",
)
def rule_list_ops(spark, sf_dir):
    c = _as_fields(td.table(spark, sf_dir, "customer"), "c_mktsegment")
    two = ["Building", "MACHINERY"]
    return _marks(
        c, "c_custkey", one_of=_c("string", "payee_name", "oneOf", two), not_one_of=_c("string", "payee_name", "notOneOf", two), is_not=_c("string", "payee_name", "isNot", two),
        id_one_of=_c("id", "category", "oneOf", two), id_is=_c("id", "category", "is", "BUILDING"), id_number=_c("id", "category", "is", 7),
    )


#: name: (pattern as a rule says it, as SQL says it; None: not valid, so it never matches)
PATTERNS = {
    "begins": ("^TH", "^th"), "ends": (r"[A-Z]+ing\.$", r"[a-z]+ing\.$"), "words": (r"the\sof|on\s+the", r"the\s+of|on\s+the".replace(r"\s+of", r"\sof")), "listed": (["ab", "qz"], "[ab qz]"),
    "braces": ("e{x}|{,3}|}", r"e\{x\}|\{,3\}|\}"), "posix": ("[[:digit:]]{2,}[^[:Alnum:]]", "[0-9]{2}[^0-9a-z]"), "inline": ("of (?i)THE", "of the"), "named": ("(?<w>on|of) (?:the)", "(on|of) the"),
    "greek": (r"\p{LATIN}\.\n", r"\p{Latin}\.\n"), "lone": ("a{1|the{", r"a\{1|the\{"), "nothing": ("", ""), "octal": (r"\056\x20t", r"\. t"), "edge": (r"\bth\b", r"\bth\b"), "lines": ("(?m)^the .*on$", r"(^|\n)the [^\n]*on(\n|$)"),
    "broken": ("[invalid", None), "ahead": ("a(?=b)", None), "possessive": ("b++", None), "atomic": ("(?>th)", None), "too_many": ("e{1,1001}", None), "named_p": ("(?P<n>e)", None), "comment": ("(?#c)e", None), "back": (r"(e)\1", None), "twice": ("e**", None), "not_white": (r"\Q.\E", None),
}


@query("rule_regex", "SELECT doc_id, " + ", ".join("false AS " + k if sql is None else f"regexp_matches(lower(text), '{sql}') AS {k}" for k, (_, sql) in PATTERNS.items()) + " FROM documents")
def rule_regex(spark, sf_dir):
    d = _as_fields(td.table(spark, sf_dir, "documents"), "text")
    return _marks(d, "doc_id", **{k: _c("string", "notes", "matches", said) for k, (said, _) in PATTERNS.items()})


@query(
    "rule_number_ops",
    f"""
WITH {_FEED}
SELECT feed_ord, amount_cents = 1000 AS is_, amount_cents > 15000000 AS gt, amount_cents >= 15000000 AS gte, amount_cents < -15000000 AS lt, amount_cents <= -15000000 AS lte,
       abs(amount_cents - 20000000) <= 1500000 AS approx, abs(amount_cents + 20000000) <= 1500000 AS approx_debit, amount_cents BETWEEN -30000000 AND -1000000 AS between_,
       false AS no_object, false AS unknown
FROM feed
""",
)
def rule_number_ops(spark, sf_dir):
    n = lambda op, v: _c("number", "notes", op, v)
    return _marks(
        _rows(spark, sf_dir), "feed_ord", is_=n("is", 1000), gt=n("gt", 15000000), gte=n("gte", 15000000), lt=n("lt", -15000000), lte=n("lte", "-15000000 cents"), approx=n("isapprox", 20000000),
        approx_debit=n("isapprox", -20000000), between_=n("isbetween", {"num1": -1000000, "num2": -30000000}), no_object=n("isbetween", 5), unknown=n("near", 5),
    )


@query(
    "rule_bool_ops",
    f"""
WITH {_FEED}
SELECT feed_ord, false AS cleared_is, true AS cleared_is_not, true AS notes_is, feed_ord % 2 = 0 AS text_is, false AS unknown_op, false AS unknown_type FROM feed
""",
)
def rule_bool_ops(spark, sf_dir):
    x = _rows(spark, sf_dir).withColumn("category", F.when(F.col("feed_ord") % 2 == 0, "1").otherwise("0"))
    b = lambda field, op, v: _c("boolean", field, op, v)
    return _marks(x, "feed_ord", cleared_is=b("cleared", "is", True), cleared_is_not=b("cleared", "isNot", "yes"), notes_is=b("notes", "is", 1), text_is=b("category", "is", True), unknown_op=b("notes", "has", True), unknown_type=_c("date", "date", "is", "2024-01-01"))
