"""Rules: JSON conditions and actions compiled to Column expressions.

Rules are a small driver-side list (a person's settings). All rules are matched against the row as it came; then the
actions of the matching ones apply in rule order, so no action changes another rule's match.
"""

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.patterns import matches_pattern

#: Which column each condition field reads; other fields read ''.
FIELDS = {
    "description": "payee_id", "payee": "payee_id", "payee_name": "payee_name", "imported_description": "imported_payee", "imported_payee": "imported_payee",
    "notes": "notes", "acct": "account", "account": "account", "category": "category",
}


@dataclass(frozen=True)
class Rule:
    id: str
    op: str
    conditions: tuple
    actions: tuple


def load_rules(rows: list[dict]) -> list[Rule]:
    """Rules from ledger rows (id, conditions_op, conditions, actions, tombstone); deleted rows are left out, and those
    whose JSON is bad or is no list of objects with texts as field, op and type."""
    out = []
    for r in rows:
        if r.get("tombstone"):
            continue
        try:
            conditions, actions = json.loads(r["conditions"]), json.loads(r["actions"])
        except (TypeError, ValueError, RecursionError):
            continue
        if all(isinstance(x, list) and all(map(_is_part, x)) for x in (conditions, actions)):
            out.append(Rule(r["id"], r.get("conditions_op") or "and", *(tuple(p or {} for p in x) for x in (conditions, actions))))
    return out


def _is_part(x: Any) -> bool:
    return x is None or isinstance(x, dict) and all(x.get(k) is None or isinstance(x[k], str) for k in ("field", "op", "type"))


def load_rules_df(rules: DataFrame) -> DataFrame:
    """The live, well-formed rows of a rules table with parsed conditions and actions (values stay raw JSON)."""
    kind = "array<struct<field:string,op:string,value:string,type:string>>"
    parsed = rules.where(F.coalesce("tombstone", F.lit(0)) == 0).withColumns({"__c": F.from_json("conditions", kind), "__a": F.from_json("actions", kind)})
    listed = lambda c: F.col(c).rlike(r"^\s*\[.*\]\s*$")
    good = parsed.where(F.col("__c").isNotNull() & F.col("__a").isNotNull() & listed("conditions") & listed("actions"))
    return good.select("id", "stage", F.coalesce(F.nullif("conditions_op", F.lit("")), F.lit("and")).alias("op"), F.col("__c").alias("conditions"), F.col("__a").alias("actions"))


# Values as the conditions see them


def text_of(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        return general(float(v))
    if isinstance(v, list):
        return "[" + " ".join(text_of(x) for x in v) + "]"
    return v if isinstance(v, str) else json.dumps(v)


def general(x: float) -> str:
    """Shortest decimal text; an exponent of two digits at least from a million on or below 1e-4."""
    mantissa, _, power = f"{x:.17e}".partition("e")
    for digits in range(17):
        if float(text := f"{x:.{digits}e}") == x:
            mantissa, _, power = text.partition("e")
            break
    exponent = int(power)
    if x == 0 or -4 <= exponent < 6:
        return f"{x:.{max(0, len(mantissa.lstrip('-').replace('.', '')) - 1 - exponent)}f}" if x else "0"
    return f"{mantissa}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"


def number_of(v: Any) -> float:
    if isinstance(v, int | float) and not isinstance(v, bool):
        return float(v)
    m = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", v) if isinstance(v, str) else None
    return float(m[0]) if m else 0.0


def lowered(text: str) -> str:
    """The text in lower case code point by code point, as ``normalise`` has it."""
    return "".join(fn.LOWER_ALONE.get(c) or c.lower() for c in text)


def truth_of(v: Any) -> bool:
    if isinstance(v, bool):
        return v
    return v != 0 if isinstance(v, int | float) else isinstance(v, str) and v not in ("", "0", "false")


# Conditions


def string_match(field: Column, op: str, value: str) -> Column:
    f, v = fn.normalise(field), F.lit(lowered(value))
    if op in ("is", "oneOf"):
        return f == v
    if op in ("isNot", "notOneOf"):
        return f != v
    if op == "contains":
        return F.contains(f, v)
    if op == "doesNotContain":
        return ~F.contains(f, v)
    if op == "matches":
        return matches_pattern(f, lowered(value))
    return F.lit(False)


def list_match(field: Column, op: str, values: list) -> Column:
    if op not in ("oneOf", "notOneOf"):
        return F.lit(False)
    names = [lowered(text_of(v)) for v in values]
    member = fn.normalise(field).isin(names) if names else F.lit(False)
    return member if op == "oneOf" else ~member


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def interval(op: str, value: Any) -> tuple[int, int] | None:
    """The least and the greatest amount that an amount condition holds for; None if it never holds."""
    if op == "isbetween":
        if not isinstance(value, dict):
            return None
        return tuple(sorted(round_half_away(number_of(value.get(k))) for k in ("num1", "num2")))
    t = round_half_away(number_of(value))
    near = round_half_away(abs(t) * 0.075)
    low, high = {"is": (t, t), "gt": (t + 1, MOST), "gte": (t, MOST), "lt": (LEAST, t - 1), "lte": (LEAST, t), "isapprox": (max(LEAST, t - near), min(MOST, t + near))}.get(op, (1, 0))
    return (low, high) if low <= high else None


def number_match(cents: Column, op: str, value: Any) -> Column:
    found = interval(op, value)
    return cents.between(*found) if found else F.lit(False)


def round_half_away(x: float) -> int:
    """Within 64 bits; what is no number counts as 0."""
    if x != x:
        return 0
    size = int(abs(x) + 0.5) if abs(x) < 2.0**63 else MOST
    return size if x >= 0 else -size


def bool_match(field: Column, op: str, value: Any) -> Column:
    have = ~field.isin("", "0", "false")
    want = truth_of(value)
    return {"is": have == want, "isNot": have != want}.get(op, F.lit(False))


def field_of(name: str | None) -> Column:
    at = FIELDS.get(name or "")
    return F.coalesce(F.col(at), F.lit("")) if at else F.lit("")


def condition(c: dict) -> Column:
    """One condition; an unknown type or op never holds. Amount conditions read the amount whatever their field."""
    kind, op, value, field = c.get("type"), c.get("op") or "", c.get("value"), field_of(c.get("field"))
    if kind in ("string", "imported_payee"):
        if op == "matches":
            return string_match(field, op, text_of(value))
        return list_match(field, op, value) if isinstance(value, list) else string_match(field, op, text_of(value))
    if kind == "id":
        return list_match(field, op, value) if isinstance(value, list) else string_match(field, op, value) if isinstance(value, str) else F.lit(False)
    if kind == "number":
        return number_match(F.col("amount_cents"), op, value)
    if kind == "boolean":
        return bool_match(field, op, value)
    return F.lit(False)


def matches(rule: Rule) -> Column:
    """AND unless the rule says 'or'; AND over nothing holds, OR over nothing does not."""
    found = [condition(c) for c in rule.conditions]
    if rule.op == "or":
        out = F.lit(False)
        for c in found:
            out = out | c
        return out
    out = F.lit(True)
    for c in found:
        out = out & c
    return out


def matched_rules(rows: DataFrame, rules: list[Rule], out: str = "matched_rules") -> DataFrame:
    """``rows`` with the ids of the matching rules, in rule order."""
    marks = [F.when(matches(r), F.lit(r.id)) for r in rules]
    return rows.withColumn(out, F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))


# Actions

TRIMMED = r"^[\s\u0085   -     　]+|[\s\u0085   -     　]+$"


def _effects(rules: list[Rule], matched: str) -> tuple[dict[str, Column], Column, list[Column]]:
    """The columns after all actions, whether one sets the payee, and a change message for every action that runs."""
    now = {c: F.coalesce(F.col(c), F.lit("")) for c in ("payee_id", "notes", "category")} | {"cleared": F.col("cleared")}
    set_payee, messages = F.lit(False), []
    for rule in rules:
        hit = F.array_contains(F.col(matched), rule.id)
        for a in rule.actions:
            field, op, value = a.get("field"), a.get("op"), a.get("value")
            text, sent = text_of(value), None
            if field == "category" and text:
                now["category"], sent = F.when(hit, F.lit(text)).otherwise(now["category"]), ("category", fn.encode_text(F.lit(text)))
            elif field in ("description", "payee") and text:
                now["payee_id"], sent = F.when(hit, F.lit(text)).otherwise(now["payee_id"]), ("description", fn.encode_text(F.lit(text)))
                set_payee = set_payee | hit
            elif field == "notes":
                new = {"prepend-notes": F.concat(F.lit(text), now["notes"]), "append-notes": F.concat(now["notes"], F.lit(text))}.get(op, F.lit(text))
                new = F.regexp_replace(new, TRIMMED, "")
                now["notes"], sent = F.when(hit, new).otherwise(now["notes"]), ("notes", fn.encode_text(new))
            elif field == "cleared":
                now["cleared"], sent = F.when(hit, F.lit(truth_of(value))).otherwise(now["cleared"]), ("cleared", fn.encode_number(F.lit(int(truth_of(value)))))
            if sent:
                messages.append(F.when(hit, F.struct(F.lit(sent[0]).alias("column"), sent[1].alias("value"))))
    return now, set_payee, messages


def apply_rules(rows: DataFrame, rules: list[Rule], payees: DataFrame | None = None, matched: str = "matched_rules", messages: str | None = None) -> DataFrame:
    """Apply the actions of matching rules in order to payee_id, notes, category and cleared.

    payees (id, name) resolves payee names after a payee action; an unknown payee's name is ''. ``messages`` names a
    column for the changes as an array of (column, value), one for every action that ran, in order.
    """
    rows = matched_rules(rows, rules, matched)
    now, set_payee, sent = _effects(rules, matched)
    extra = {"__set_payee": set_payee}
    if messages:
        extra["__sent"] = F.filter(F.array(*sent), lambda m: m.isNotNull()) if sent else F.array().cast("array<struct<column:string,value:string>>")
    out = rows.withColumns({f"__{c}": e for c, e in now.items()} | extra)
    out = out.withColumns({c: F.col(f"__{c}") for c in now}).drop(*[f"__{c}" for c in now])
    out = out.withColumnRenamed("__sent", messages) if messages else out
    if payees is not None:
        names = payees.select(F.col("id").alias("payee_id"), F.coalesce("name", F.lit("")).alias("__name"))
        out = out.join(names, "payee_id", "left").withColumn("payee_name", F.when(F.col("__set_payee"), F.coalesce("__name", F.lit(""))).otherwise(F.col("payee_name"))).drop("__name")
    return out.drop("__set_payee")


def action_messages(applied: DataFrame, id_col: str, order: str, messages: str = "messages", dataset: str = "transactions") -> DataFrame:
    """Change messages (dataset, row, column, value, row_order, position) of rows from ``apply_rules``."""
    long = applied.select(F.col(id_col).cast("string").alias("row"), F.col(order).alias("row_order"), F.posexplode(messages).alias("position", "m"))
    return long.select(F.lit(dataset).alias("dataset"), "row", F.col("m.column").alias("column"), F.col("m.value").alias("value"), "row_order", "position")
