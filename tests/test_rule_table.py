"""Rules as a table give what compiled rules give, and what they cost follows what they match."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import rule_table as rt
from tallyspark.operators import rules as ru

FIELDS = "k long, payee_id string, payee_name string, imported_payee string, notes string, account string, category string, amount_cents long, cleared boolean"
WORDS = ["Tram", "tram fare", "BOILER", "é", "", "0", "false", "urgent 7", "İx", "a.b", "zz top"]


def random_rows(r, n):
    some = lambda x: None if r.random() < 0.08 else x
    text = lambda: some(r.choice([*WORDS, f"{r.choice(WORDS)} {r.choice(WORDS)}"]))
    return [(k, text(), text(), text(), text(), text(), text(), some(r.randrange(-30, 30) * 100), r.random() < 0.5) for k in range(n)]


def random_condition(r):
    kind = r.choice(["string", "string", "imported_payee", "id", "number", "boolean", "date", None])
    op = r.choice(["is", "isNot", "contains", "doesNotContain", "oneOf", "notOneOf", "matches", "odd", None]) if kind != "number" else r.choice(["is", "gt", "gte", "lt", "lte", "isapprox", "isbetween", "odd"])
    if kind == "number":
        value = r.choice([r.randrange(-3000, 3000), f"{r.randrange(3000)} x", {"num1": r.randrange(-3000, 3000), "num2": r.randrange(-3000, 3000)}, 1e30, -1e300, None, [1], 9.3e18])
    elif op == "matches":
        value = r.choice(["^tr", "fare$", "[a-e]{2}", "(?i)BOIL", "b++", "foo{", "", "^$", "a\\.b", r"\d", ["tram", 7]])
    else:
        value = r.choice([r.choice(WORDS), r.sample(WORDS, r.randint(0, 3)), True, 0, 7.5, None])
    field = r.choice(["payee", "description", "payee_name", "imported_payee", "notes", "acct", "category", "nosuch", None])
    return {"type": kind, "field": field, "op": op, "value": value}


def random_action(r):
    field, op = r.choice(["category", "payee", "description", "notes", "cleared", "nosuch", None]), r.choice(["set", "prepend-notes", "append-notes", None])
    return {"field": field, "op": op, "value": r.choice(["cat", " x ", "", True, False, 3, None, "p1"])}


def random_rules(seed, n):
    r = random.Random(seed)
    return [ru.Rule(f"r{k}", r.choice(["and", "and", "or"]), tuple(random_condition(r) for _ in range(r.choice([0, 1, 1, 2, 2, 3]))), tuple(random_action(r) for _ in range(r.randint(0, 3)))) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_compiled_rules(spark, monkeypatch, seed):
    monkeypatch.setattr(rt, "ROWS_AT_ONCE", 50)
    df = spark.createDataFrame(random_rows(random.Random(seed), 230), FIELDS)
    rules = random_rules(seed, 120)
    want = {x["k"]: x["m"] for x in ru.matched_rules(df, rules, "m").collect()}
    got = {x["k"]: x["m"] for x in rt.match_table(df, rules, "m").collect()}
    assert got == want and sum(map(len, want.values())) > 500


@pytest.mark.parametrize("seed", range(2))
def test_actions_equal_compiled_ones(spark, seed):
    df = spark.createDataFrame(random_rows(random.Random(seed + 50), 80), FIELDS)
    payees = spark.createDataFrame([("p1", "Name"), ("cat", None)], "id string, name string")
    rules = random_rules(seed + 50, 25)
    one, other = (f(df, rules, payees, messages="said").orderBy("k").select("k", "payee_id", "payee_name", "notes", "category", "cleared", "matched_rules", "said").collect() for f in (ru.apply_rules, rt.apply_table))
    assert one == other


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame(random_rows(random.Random(1), 3), FIELDS)
    assert [x["matched_rules"] for x in rt.match_table(df, []).collect()] == [[]] * 3
    assert rt.match_table(df.limit(0), random_rules(1, 5)).count() == 0
    assert [x["notes"] for x in rt.apply_table(df, []).orderBy("k").collect()] == [x["notes"] or "" for x in df.orderBy("k").collect()]


def test_rules_are_read_from_a_table_in_order(spark, monkeypatch):
    good, act = json.dumps([{"type": "string", "field": "notes", "op": "is", "value": "x"}]), "[]"
    rows = [("b", "or", good, act, 0), ("a", "", good, act, None), ("gone", "and", good, act, 1), ("bad", "and", "[", act, 0), ("kind", "and", '[{"op": 5}]', act, 0), ("list", "and", '[{"field": ["x"]}]', act, 0), ("part", "and", "[7]", act, 0), ("null", "and", None, act, 0), ("c", None, "[null]", "[]", 0)]
    df = spark.createDataFrame(rows, "id string, conditions_op string, conditions string, actions string, tombstone int")
    assert [(r.id, r.op, len(r.conditions)) for r in rt.read_rules(df)] == [("a", "and", 1), ("b", "or", 1), ("c", "and", 1)]
    monkeypatch.setattr(rt, "MOST_RULES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        rt.read_rules(df)


@pytest.mark.parametrize("value", ["Infinity", "NaN", "1e999", "-1e999", '"1e999"', "9223372036854775807", "-9223372036854775809"])
def test_no_amount_of_a_rule_aborts_a_query(spark, value):
    df = spark.createDataFrame(random_rows(random.Random(2), 5), FIELDS)
    for op in ("is", "gt", "gte", "lt", "lte", "isapprox", "isbetween"):
        said = f'{{"num1": {value}, "num2": 5}}' if op == "isbetween" else value
        rules = ru.load_rules([{"id": "r", "conditions": f'[{{"type": "number", "op": "{op}", "value": {said}}}]', "actions": "[]"}])
        assert rt.match_table(df, rules).collect() == ru.matched_rules(df, rules).collect()


def test_thousands_of_rules_are_one_stage(spark):
    said = lambda k: [{"type": "string", "field": "notes", "op": "is", "value": f"note {k}"}, {"type": "number", "op": "gt", "value": -k}]
    rules = [ru.Rule(f"r{k}", "and", tuple(said(k)), ({"field": "category", "op": "set", "value": f"c{k}"},)) for k in range(5000)]
    df = spark.range(20_000).select(F.col("id").alias("k"), *[F.lit("").alias(c) for c in ("payee_id", "payee_name", "imported_payee", "account", "category")], F.concat(F.lit("Note "), F.col("id") % 7000).alias("notes"), F.lit(1).cast("long").alias("amount_cents"), F.lit(False).alias("cleared"))
    x = rt.apply_table(df, rules)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("EvalPython") == 1
    got = x.agg(F.count_if(F.size("matched_rules") == 1), F.count_if(F.col("category") == F.concat(F.lit("c"), F.col("k") % 7000))).first()
    assert tuple(got) == (15_000, 15_000)


def test_a_shared_test_does_not_bring_every_rule_to_a_row(monkeypatch):
    """Thousands of rules that share one test and have a text of their own: a row meets its own rule only (F3, F4)."""
    own = lambda k: {"type": "string", "field": "payee_name", "op": "is", "value": f"p{k}"}
    shared = [{"type": "string", "field": "notes", "op": op, "value": v} for op, v in (("matches", "^or"), ("isNot", "order x"))]
    band = {"type": "number", "field": "amount", "op": "isbetween", "value": {"num1": 5, "num2": 5}}
    rows = [{"id": f"r{k}", "conditions_op": "or" if k % 3 == 2 else "and", "conditions": json.dumps([own(k), band if k % 3 == 2 else shared[k % 3]]), "actions": "[]", "tombstone": 0} for k in range(3000)]
    index = rt.build_index(ru.load_rules(rows))
    n = 500
    payees, notes = [f"p{k}" for k in range(n)], ["order x" if k % 2 else "order y" for k in range(n)]
    met = []
    runs = rt._runs
    monkeypatch.setattr(rt, "_runs", lambda starts, lengths: met.append(int(lengths.sum())) or runs(starts, lengths))
    row, rule = rt.match_rows(index, {}, {"payee_name": rt.pa.array(payees), "notes": rt.pa.array(notes)}, {}, rt.np.arange(n), rt.np.ones(n, bool))
    want = [(k, r) for k in range(n) for r in range(3000) if (r == k and not (k % 3 == 1 and k % 2)) or (r % 3 == 2 and k == 5)]
    assert list(zip(row.tolist(), rule.tolist(), strict=True)) == want
    assert max(met) <= 3 * n
