import pytest

from tallyspark.operators import rules as ru

FIELDS = "payee_id string, payee_name string, imported_payee string, notes string, account string, category string, amount_cents long, cleared boolean"


@pytest.fixture(scope="module")
def holds(spark):
    def run(conditions, text="hello", cents=0, op="and"):
        df = spark.createDataFrame([(text, text, text, text, text, text, cents, False)], FIELDS)
        rule = ru.Rule("r", op, tuple(conditions), ())
        return df.select(ru.matches(rule).alias("m")).first()["m"]

    return run


def c(kind, op, value, field="notes"):
    return {"type": kind, "field": field, "op": op, "value": value}


#: op: (value, texts for which it holds, texts for which it does not)
STRINGS = {
    "is": [("Tram Fare", ["tram fare", "TRAM FARE"], ["tram", "tram fare ", ""]), (17.5, ["17.5"], ["17.50"])],
    "isNot": [("quay", ["key", "quays"], ["Quay"])],
    "contains": [("oil", ["Boiler service", "oil"], ["o il"]), ("", ["", "anything"], []), ([], [], ["[]"])],
    "doesNotContain": [("ferry", ["bus pass"], ["night FERRY 7"])],
    "oneOf": [(["Bakery", "Kiosk 9"], ["kiosk 9", "BAKERY"], ["kiosk", ""]), ("lamp", ["Lamp"], ["lamps"]), ([], [], ["x"])],
    "notOneOf": [(["mill", "barn"], ["millbarn"], ["Barn"])],
    "matches": [
        (r"^inv-\d{3}$", ["INV-204"], ["inv-20", "an inv-204", "inv-204\n"]), ("gr[ae]y+", ["Greyyy coat"], ["gry"]), (r"a\sb", ["a\tb", "a b"], ["a\vb", "ab"]), ("(left", [], ["(left", "left"]),
        ("x{2,1}", [], ["xx"]), (r"(q)\1", [], ["qq"]), ("k(?!z)", [], ["ky"]), (["uv", "w"], ["one v two"], ["x"]),
    ],
    "startsWith": [("a", [], ["a"])],
}


@pytest.mark.parametrize("op", STRINGS)
def test_strings(holds, op):
    for value, yes, no in STRINGS[op]:
        for text in [*yes, *no]:
            assert holds([c("string", op, value)], text) is (text in yes), (value, text)


@pytest.mark.parametrize("target", [0, 240, -760, 12_345])
def test_numbers_by_definition(holds, target):
    around = [target + d for d in (-1000, -18, -1, 0, 1, 18, 1000)]
    near = int(abs(target) * 0.075 + 0.5)
    means = {"is": lambda x: x == target, "gt": lambda x: x > target, "gte": lambda x: x >= target, "lt": lambda x: x < target, "lte": lambda x: x <= target, "isapprox": lambda x: abs(x - target) <= near, "about": lambda x: False}
    for op, mean in means.items():
        assert [holds([c("number", op, target, "whatever")], cents=x) for x in around] == [mean(x) for x in around], op
    for low, high in ((target - 18, target + 1), (target + 1, target - 18)):
        assert [holds([c("number", "isbetween", {"num1": low, "num2": high})], cents=x) for x in around] == [target - 18 <= x <= target + 1 for x in around]


def test_numbers_in_other_forms(holds):
    assert holds([c("number", "is", " 88.4 EUR")], cents=88) and holds([c("number", "is", "none")], cents=0) and holds([c("number", "is", -2.5)], cents=-3)
    assert not holds([c("number", "isbetween", 9)], cents=9) and not holds([c("number", "is", 88)], cents=-88)


@pytest.mark.parametrize("text", ["", "0", "false", "yes", "00"])
def test_booleans(holds, text):
    have = text not in ("", "0", "false")
    for want in (True, False, "on", 0, 3, "0"):
        truth = want not in (False, 0, "0")
        assert holds([c("boolean", "is", want)], text) is (have == truth) and holds([c("boolean", "isNot", want)], text) is (have != truth)
    assert holds([c("boolean", "equals", True)], text) is False


def test_unknown_types_and_fields(holds):
    assert holds([c("date", "is", "x")]) is False
    assert holds([c("string", "is", "", "nofield")]) is True
    assert holds([c("boolean", "is", True, "cleared")]) is False
    assert holds([c("id", "is", 7, "category")]) is False


def test_empty_and_mixed_conditions(holds):
    yes, no = c("string", "is", "hello"), c("string", "is", "x")
    assert holds([]) is True and holds([], op="or") is False
    assert holds([yes, no]) is False and holds([yes, no], op="or") is True and holds([yes, no], op="xor") is False


def test_loading_leaves_out_what_cannot_be_read():
    rows = [{"id": k, "conditions": a, "actions": b, "conditions_op": ""} for k, (a, b) in enumerate([("{oops", "[]"), ("[]", "[1,"), (None, "[]"), ("{}", "[]"), ("[]", "[]")])]
    got = ru.load_rules(rows)
    assert [(r.id, r.op) for r in got] == [(4, "and")]


def test_actions(spark):
    df = spark.createDataFrame([("p1", "One", "x", " ledger page ", "a", "", 5, False)], FIELDS)
    acts = ({"field": "notes", "op": "prepend-notes", "value": "Q3: "}, {"field": "notes", "op": "append-notes", "value": "(checked) "}, {"field": "category", "value": ""}, {"field": "payee", "value": "p2"}, {"field": "cleared", "value": True}, {"field": "nothing", "value": 1})
    payees = spark.createDataFrame([("p2", "Two")], "id string, name string")
    row = ru.apply_rules(df, [ru.Rule("r", "and", (), acts)], payees).first()
    assert (row["notes"], row["category"], row["payee_id"], row["payee_name"], row["cleared"]) == ("Q3:  ledger page(checked)", "", "p2", "Two", True)
