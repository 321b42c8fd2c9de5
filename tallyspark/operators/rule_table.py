"""Rules as a table: thousands of them matched against every row in one stage.

The live rules of a table become an index that is sent to the executors once (``MOST_RULES`` of them at most). Each
condition becomes a plain test: a text is among some, holds a text, fits a pattern, counts as true, or the amount lies
in an interval. A batch looks each different text of a field up once: equal texts in a hash table, held ones with one
automaton, patterns by RE2. A rule that needs a text is looked at only where the one that fewest rules share is found,
and its other tests are looked up there, so a rule whose own text is another one costs a row nothing, whatever tests it
shares; intervals are found in the batch's sorted amounts. A rule with nothing but negative tests or intervals
holds unless something speaks against it.

Results equal those of ``rules.matched_rules`` and ``rules.apply_rules``, which compile every rule into the plan. The
actions of the matching rules come with them and are applied in the JVM, in rule order.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.patterns import plain_pattern, re2_pattern
from . import rules as ru
from .rules import LEAST, MOST

MOST_RULES = 100_000
ROWS_AT_ONCE = 4096
ACTION = "struct<rule:string,field:string,op:string,text:string,truth:boolean>"


def read_rules(table: DataFrame, order: str = "id") -> list[ru.Rule]:
    """The live, well-formed rules of a table (id, conditions_op, conditions, actions, tombstone), in the order of a column."""
    live = table.where(F.coalesce("tombstone", F.lit(0)) == 0).orderBy(order).limit(MOST_RULES + 1)
    rows = [r.asDict() for r in live.select("id", "conditions_op", "conditions", "actions", "tombstone").collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return ru.load_rules(rows)


# Conditions as tests


def _text_test(at: str | None, op: str, value, listed: bool) -> tuple:
    """(kind, field, value, wanted); kind 'fixed' holds or does not whatever the row. Unknown fields read ''."""
    if listed:
        if op not in ("oneOf", "notOneOf"):
            return ("fixed", None, None, False)
        kind, said, wanted = "among", tuple(sorted({ru.lowered(ru.text_of(v)) for v in value})), op == "oneOf"
    elif op == "matches":
        pattern = ru.lowered(value)
        plain = plain_pattern(pattern)
        said = re2_pattern(pattern) if plain is None else pattern
        kind, wanted = "fits", True
        if said is None:
            return ("fixed", None, None, False)
        if plain is not None and not plain[0] and not plain[2]:
            kind, said = "holds", plain[1]
    else:
        kind = {"is": "among", "oneOf": "among", "isNot": "among", "notOneOf": "among", "contains": "holds", "doesNotContain": "holds"}.get(op)
        if kind is None:
            return ("fixed", None, None, False)
        said = ru.lowered(value)
        said, wanted = ((said,), op in ("is", "oneOf")) if kind == "among" else (said, op == "contains")
    if kind == "among" and not said:
        return ("fixed", None, None, not wanted)
    if kind == "holds" and said == "":
        return ("fixed", None, None, wanted)
    if at is None:
        empty = "" in said if kind == "among" else pc.match_substring_regex(pa.array([""]), pattern=said)[0].as_py() if kind == "fits" else False
        return ("fixed", None, None, empty == wanted)
    return (kind, at, said, wanted)


def test_of(c: dict) -> tuple:
    """A condition as a test; the same cases as ``rules.condition``."""
    kind, op, value, at = c.get("type"), c.get("op") or "", c.get("value"), ru.FIELDS.get(c.get("field") or "")
    listed = isinstance(value, list)
    if kind in ("string", "imported_payee"):
        return _text_test(at, op, value if listed and op != "matches" else ru.text_of(value), listed and op != "matches")
    if kind == "id" and (listed or isinstance(value, str)):
        return _text_test(at, op, value, listed)
    if kind == "number":
        found = ru.interval(op, value)
        return ("amount", None, found, True) if found else ("fixed", None, None, False)
    if kind == "boolean" and op in ("is", "isNot"):
        want = ru.truth_of(value) == (op == "is")
        return ("true", at, "", want) if at else ("fixed", None, None, not want)
    return ("fixed", None, None, False)


@dataclass
class Index:
    """What the executors get. Tests are numbered. A rule that needs some text is under one of its tests, ``lead``, and has
    the others in ``rest`` (test, whether it must hold); any other rule is under all of its tests in ``owner`` (rule, +1
    or -1). All three are flat arrays."""

    ids: list[str]
    any_of: np.ndarray  # whether a rule holds by one of its tests
    base: np.ndarray  # how many of its tests hold while nothing is found
    needed: np.ndarray  # how many must hold
    low: np.ndarray
    high: np.ndarray
    always: np.ndarray
    among: dict = field(default_factory=dict)  # field -> text -> tests
    holds: dict = field(default_factory=dict)  # field -> text -> tests
    fits: dict = field(default_factory=dict)  # field -> pattern -> tests
    true: dict = field(default_factory=dict)  # field -> tests
    amounts: np.ndarray | None = None  # (low, high, rule) of rules that hold by one test
    idle: np.ndarray | None = None  # rules with an interval that hold where nothing is found
    idle_free: np.ndarray | None = None  # the same without an interval
    owner_start: np.ndarray | None = None
    owner_rule: np.ndarray | None = None
    owner_sign: np.ndarray | None = None
    lead_start: np.ndarray | None = None
    lead_rule: np.ndarray | None = None
    rest_start: np.ndarray | None = None
    rest_test: np.ndarray | None = None
    rest_wanted: np.ndarray | None = None
    actions: pa.Array | None = None

    def fields(self) -> tuple[list[str], list[str]]:
        """The fields read as lower-cased text, and as they are."""
        return sorted({*self.among, *self.holds, *self.fits}), sorted(self.true)


def build_index(rules: list[ru.Rule]) -> Index:
    n = len(rules)
    index = Index([r.id for r in rules], np.array([r.op == "or" for r in rules], bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, LEAST), np.full(n, MOST), np.zeros(n, bool))
    numbers: dict[tuple, int] = {}
    owners: list[int] = []  # how many rules have a test
    shared: list[list[tuple[int, int]]] = []
    needs: list[list[tuple[int, bool]]] = []
    amounts: list[tuple[int, int, int]] = []
    for k, rule in enumerate(rules):
        tests = dict.fromkeys(test_of(c) for c in rule.conditions)
        fixed = [t[3] for t in tests if t[0] == "fixed"]
        ranges = [t[2] for t in tests if t[0] == "amount"]
        texts = [t for t in tests if t[0] not in ("fixed", "amount")]
        if rule.op == "or":
            index.always[k] = any(fixed)
            index.needed[k] = 1
            amounts += [(low, high, k) for low, high in ranges]
        else:
            index.needed[k] = len(texts) if all(fixed) else len(texts) + 1
            index.low[k], index.high[k] = max([LEAST, *(x for x, _ in ranges)]), min([MOST, *(x for _, x in ranges)])
        index.base[k] = sum(not wanted for *_, wanted in texts)
        needs.append([])
        for kind, at, said, wanted in texts:
            number = numbers.setdefault((kind, at, said), len(numbers))
            if number == len(owners):
                owners.append(0)
                shared.append([])
                for text in said if kind == "among" else (said,):
                    if kind == "true":
                        index.true.setdefault(at, []).append(number)
                    else:
                        getattr(index, kind).setdefault(at, {}).setdefault(text, []).append(number)
            owners[number] += 1
            needs[-1].append((number, wanted))
    index.amounts = np.array([(max(low, LEAST), min(high, MOST), k) for low, high, k in amounts if low <= min(high, MOST)], np.int64).reshape(-1, 3)
    idle = index.always | np.where(index.any_of, index.base >= 1, index.base == index.needed)
    free = (index.low == LEAST) & (index.high == MOST)
    index.idle, index.idle_free = np.flatnonzero(idle & ~free), np.flatnonzero(idle & free)
    # a rule that needs a text is looked at where its rarest one is found, whatever else it shares with other rules
    lead: list[list[int]] = [[] for _ in owners]
    for k, tests in enumerate(needs):
        wanted = [number for number, good in tests if good]
        if rules[k].op == "or" or not wanted:
            for number, good in tests:
                shared[number].append((k, 1 if good else -1))
            needs[k] = []
        elif index.needed[k] > len(tests):  # never holds
            needs[k] = []
        else:
            first = min(wanted, key=lambda number: owners[number])
            lead[first].append(k)
            needs[k] = [x for x in tests if x != (first, True)]
    index.lead_start, index.lead_rule = np.cumsum([0, *map(len, lead)]), np.array([k for own in lead for k in own], np.int64)
    index.rest_start = np.cumsum([0, *map(len, needs)])
    index.rest_test, index.rest_wanted = np.array([t for own in needs for t, _ in own], np.int64), np.array([w for own in needs for _, w in own], bool)
    flat = [x for own in shared for x in own]
    index.owner_start = np.cumsum([0, *map(len, shared)])
    index.owner_rule, index.owner_sign = np.array([r for r, _ in flat], np.int64), np.array([s for _, s in flat], np.int64)
    said = [[{"rule": r.id, "field": a.get("field"), "op": a.get("op"), "text": ru.text_of(a.get("value")), "truth": ru.truth_of(a.get("value"))} for a in r.actions] for r in rules]
    index.actions = pa.array(said, pa.list_(pa.struct([("rule", pa.string()), ("field", pa.string()), ("op", pa.string()), ("text", pa.string()), ("truth", pa.bool_())])))
    return index


# Matching a batch


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _automaton(texts: dict):
    import ahocorasick

    found = ahocorasick.Automaton()
    for text, tests in texts.items():
        found.add_word(text, tests)
    found.make_automaton()
    return found


def _found(index: Index, automata: dict, at: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, test) of the tests of a field that its texts pass; each different text is looked up once."""
    coded = texts.dictionary_encode()
    values, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    among, holds = index.among.get(at, {}), automata.get(at)
    lists = []
    for v in values.to_pylist():
        tests = list(among.get(v, ()))
        if holds is not None:
            tests += {t for _, some in holds.iter(v) for t in some}
        lists.append(tests)
    for pattern, tests in index.fits.get(at, {}).items():
        for k in np.flatnonzero(pc.match_substring_regex(values, pattern=pattern).to_numpy(zero_copy_only=False)):
            lists[k] += tests
    lengths = np.array([len(x) for x in lists], np.int64)
    start, flat = np.cumsum(lengths) - lengths, np.array([t for x in lists for t in x], np.int64)
    each = lengths[code]
    return np.repeat(np.arange(len(code)), each), flat[_runs(start[code], each)]


def _led(index: Index, rows: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, rule) of the rules that need some text and have all their texts right, of the (row, test) that hold."""
    n_tests = len(index.lead_start) - 1
    have = np.sort(rows * n_tests + tests)
    lengths = index.lead_start[tests + 1] - index.lead_start[tests]
    row, rule = np.repeat(rows, lengths), index.lead_rule[_runs(index.lead_start[tests], lengths)]
    lengths = index.rest_start[rule + 1] - index.rest_start[rule]
    at = _runs(index.rest_start[rule], lengths)
    asked = np.repeat(row, lengths) * n_tests + index.rest_test[at]
    held = have[np.minimum(np.searchsorted(have, asked), max(0, len(have) - 1))] == asked
    wrong = np.bincount(np.repeat(np.arange(len(row)), lengths), held != index.rest_wanted[at], minlength=len(row))
    return row[wrong == 0], rule[wrong == 0]


def match_rows(index: Index, automata: dict, lower: dict[str, pa.Array], raw: dict[str, pa.Array], cents: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, rule) of all matches, by row and then by rule. ``known`` says which rows have an amount."""
    n, n_rules = len(cents), len(index.ids)
    rows, tests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, texts in lower.items():
        r, t = _found(index, automata, at, texts)
        rows.append(r)
        tests.append(t)
    for at, texts in raw.items():
        hit = np.flatnonzero(~pc.is_in(texts, pa.array(["", "0", "false"])).to_numpy(zero_copy_only=False))
        for t in index.true[at]:
            rows.append(hit)
            tests.append(np.full(len(hit), t))
    rows, tests = np.concatenate(rows), np.concatenate(tests)
    owned = index.owner_start[tests + 1] - index.owner_start[tests] if len(tests) else np.zeros(0, np.int64)
    at = _runs(index.owner_start[tests], owned) if len(tests) else np.zeros(0, np.int64)
    keys, signs = [np.repeat(rows, owned) * n_rules + index.owner_rule[at]], [index.owner_sign[at]]
    order = np.argsort(np.where(known, cents, 0), kind="stable")
    order = order[known[order]]
    ranked = cents[order]

    def inside(low, high, rule):
        """Keys of the rows whose amount lies in each rule's interval, all intervals at once."""
        first = np.searchsorted(ranked, low, "left")
        lengths = np.maximum(np.searchsorted(ranked, high, "right") - first, 0)
        return order[_runs(first, lengths)] * n_rules + np.repeat(rule, lengths)

    if len(index.amounts):
        keys.append(inside(*index.amounts.T))
        signs.append(np.ones(len(keys[-1]), np.int64))
    touched, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(signs), minlength=len(touched)).astype(np.int64)
    row, rule = touched // max(1, n_rules), touched % max(1, n_rules)
    total += index.base[rule]

    def fits(row, rule):
        bounded = (index.low[rule] > LEAST) | (index.high[rule] < MOST)
        return ~bounded | (known[row] & (index.low[rule] <= cents[row]) & (cents[row] <= index.high[rule]))

    good = index.always[rule] | np.where(index.any_of[rule], total >= 1, (total == index.needed[rule]) & fits(row, rule))
    led, by = _led(index, rows, tests)
    led = (led * n_rules + by)[fits(led, by)]
    # these hold where nothing was found
    some = [inside(index.low[index.idle], index.high[index.idle], index.idle), (np.arange(n)[:, None] * n_rules + index.idle_free).ravel()]
    some = np.concatenate(some)
    held = np.sort(np.concatenate([touched[good], led, some[~np.isin(some, touched)]]))
    return held // max(1, n_rules), held % max(1, n_rules)


def match_table(rows: DataFrame, rules: list[ru.Rule], out: str = "matched_rules", actions: str | None = None) -> DataFrame:
    """``rows`` with the ids of the matching rules, in rule order, and with ``actions`` all their actions."""
    index = build_index(rules)
    lower, raw = index.fields()
    sent = rows.sparkSession.sparkContext.broadcast(index)
    kept: dict = {}

    def judge(cents: pa.Array, *columns: pa.Array) -> pa.Array:
        index = sent.value
        if "automata" not in kept:  # built once a task, as it cannot be sent
            kept["automata"] = {at: _automaton(texts) for at, texts in index.holds.items()}
        known = cents.is_valid().to_numpy(zero_copy_only=False)
        amount = pc.fill_null(cents, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(amount), ROWS_AT_ONCE):
            part = [c.slice(a, ROWS_AT_ONCE) for c in columns]
            r, k = match_rows(index, kept["automata"], dict(zip(lower, part, strict=False)), dict(zip(raw, part[len(lower) :], strict=True)), amount[a : a + ROWS_AT_ONCE], known[a : a + ROWS_AT_ONCE])
            found[0].append(r + a)
            found[1].append(k)
        row, rule = np.concatenate(found[0]), np.concatenate(found[1])
        ends = pa.array(np.searchsorted(row, np.arange(len(amount) + 1)).astype(np.int32))
        ids = pa.ListArray.from_arrays(ends, pa.array(index.ids, pa.string()).take(pa.array(rule)))
        if not actions:
            return pa.StructArray.from_arrays([ids], ["ids"])
        lists = index.actions.take(pa.array(rule))
        upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int32)
        said = pa.ListArray.from_arrays(pa.array(upto[ends.to_numpy()]), lists.flatten())
        return pa.StructArray.from_arrays([ids, said], ["ids", "actions"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    inputs = [F.col("amount_cents").cast("long"), *[fn.normalise(text(c)) for c in lower], *[text(c) for c in raw]]
    kind = "struct<ids:array<string>" + (f",actions:array<{ACTION}>" if actions else "") + ">"
    judged = rows.withColumn("__judged", F.arrow_udf(judge, kind)(*inputs))
    return judged.withColumns({out: F.col("__judged.ids")} | ({actions: F.col("__judged.actions")} if actions else {})).drop("__judged")


# Actions


def _apply(now: Column, a: Column) -> Column:
    """One action on a row's values; see ``rules.apply_rules``."""
    text, at = F.coalesce(a["text"], F.lit("")), F.coalesce(a["field"], F.lit(""))
    category, payee = (at == "category") & (text != ""), at.isin("description", "payee") & (text != "")
    op = F.coalesce(a["op"], F.lit(""))
    notes = F.regexp_replace(F.when(op == "prepend-notes", F.concat(text, now["notes"])).when(op == "append-notes", F.concat(now["notes"], text)).otherwise(text), ru.TRIMMED, "")
    flag = F.coalesce(a["truth"], F.lit(False))
    message = (
        F.when(category, F.struct(F.lit("category").alias("column"), fn.encode_text(text).alias("value"))).when(payee, F.struct(F.lit("description").alias("column"), fn.encode_text(text).alias("value")))
        .when(at == "notes", F.struct(F.lit("notes").alias("column"), fn.encode_text(notes).alias("value"))).when(at == "cleared", F.struct(F.lit("cleared").alias("column"), F.concat(F.lit("N:"), flag.cast("int").cast("string")).alias("value")))
    )
    return F.struct(
        F.when(payee, text).otherwise(now["payee_id"]).alias("payee_id"), F.when(at == "notes", notes).otherwise(now["notes"]).alias("notes"), F.when(category, text).otherwise(now["category"]).alias("category"),
        F.when(at == "cleared", flag).otherwise(now["cleared"]).alias("cleared"), (now["set_payee"] | payee).alias("set_payee"),
        F.when(message.isNotNull(), F.array_append(now["messages"], message)).otherwise(now["messages"]).alias("messages"),
    )


def apply_table(rows: DataFrame, rules: list[ru.Rule], payees: DataFrame | None = None, matched: str = "matched_rules", messages: str | None = None) -> DataFrame:
    """``rules.apply_rules`` for many rules: the actions of matching rules are folded over each row's values in order."""
    x = match_table(rows, rules, matched, "__actions")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    none = F.array().cast("array<struct<column:string,value:string>>")
    first = F.struct(text("payee_id").alias("payee_id"), text("notes").alias("notes"), text("category").alias("category"), F.col("cleared").alias("cleared"), F.lit(False).alias("set_payee"), none.alias("messages"))
    x = x.select("*", F.explode(F.array(F.aggregate("__actions", first, _apply))).alias("__now"))  # once a row, never copied
    x = x.withColumns({c: F.col(f"__now.{c}") for c in ("payee_id", "notes", "category", "cleared")} | ({messages: F.col("__now.messages")} if messages else {}))
    if payees is not None:
        names = payees.select(F.col("id").alias("payee_id"), F.coalesce("name", F.lit("")).alias("__name"))
        x = x.join(names, "payee_id", "left").withColumn("payee_name", F.when(F.col("__now.set_payee"), F.coalesce("__name", F.lit(""))).otherwise(F.col("payee_name"))).drop("__name")
    return x.drop("__actions", "__now")
