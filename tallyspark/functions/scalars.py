"""Scalar functions as Column expressions. The empty string stands for a missing text, as in the ledger."""

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_filled(*columns: C) -> Column:
    """The first text that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns], F.lit(""))


def null_if_empty(c: C) -> Column:
    return F.nullif(col(c), F.lit(""))


# Dates and amounts


def parse_date(*fields: C) -> Column:
    """The first field whose first ten characters are a strict yyyy-MM-dd date; else null."""
    return F.coalesce(*[F.when(F.substring(col(f), 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.substring(col(f), 1, 10), "yyyy-MM-dd")) for f in fields])


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def decimal_to_cents(amount: C) -> Column:
    """Decimal text to cents, half away from zero in double; null if it is no number or its cents are beyond 64 bits."""
    a = col(amount)
    cents = F.round(a.try_cast("double") * 100)
    return F.when(a.rlike(_NUMBER) & (F.abs(cents) < 2.0**63), cents.try_cast("long"))


def signed_cents(amount: C, indicator: C) -> Column:
    """Cents, negative for DBIT only, positive otherwise; a missing amount is 0."""
    cents = F.abs(decimal_to_cents(F.coalesce(col(amount), F.lit("0"))))
    return F.when(col(indicator) == "DBIT", -cents).otherwise(cents)


def indicator(first: C, second: C) -> Column:
    return F.upper(first_filled(first, second))


def cents_to_decimal(cents: C) -> Column:
    """-1234 to '-12.34'."""
    c = col(cents)
    whole = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(whole / 100).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def date_to_int(d: C) -> Column:
    return (F.year(col(d)) * 10000 + F.month(col(d)) * 100 + F.dayofmonth(col(d))).cast("int")


def int_to_date(n: C) -> Column:
    """YYYYMMDD to a date; null if there is no such day."""
    return F.try_to_date(F.lpad(col(n).cast("string"), 8, "0"), "yyyyMMdd")


# Feed texts


def remittance_list(raw: C) -> Column:
    """The entries of remittance information that is a JSON list; null if it is not one."""
    r = col(raw)
    return F.when(r.rlike(r"^\s*\["), F.from_json(r, "array<variant>"))


def _is_text(entry: Column) -> Column:
    return F.schema_of_variant(entry) == "STRING"


def remittance_items(raw: C, entries: C | None = None) -> Column:
    """Texts of remittance information that may be a JSON list or one text; other kinds in a list are left out.

    ``entries`` is ``remittance_list(raw)`` where that is at hand as a column."""
    r, e = col(raw), remittance_list(raw) if entries is None else col(entries)
    texts = F.transform(F.filter(e, _is_text), lambda x: F.variant_get(x, "$", "string"))
    return F.when(r.rlike(r"^\s*\["), texts).when(r.isNull() | (r == ""), F.array().cast("array<string>")).otherwise(F.array(r))


def first_remittance(raw: C, entries: C | None = None) -> Column:
    """The first entry if it is a text, else ''."""
    r, e = col(raw), remittance_list(raw) if entries is None else col(entries)
    head = F.get(e, F.lit(0))
    text = F.when(_is_text(head), F.try_variant_get(head, "$", "string"))
    return F.coalesce(F.when(r.rlike(r"^\s*\["), text).otherwise(r), F.lit(""))


def is_own_name(name: C, own: list[str]) -> Column:
    names = sorted({n.strip().lower() for n in own if n.strip()})
    return F.coalesce(F.lower(col(name)).isin(names), F.lit(False)) if names else F.lit(False)


def own_names(csv: str) -> list[str]:
    return [n.strip().lower() for n in csv.split(",") if n.strip()]


def payee_of(ind: C, creditor: C, creditor_name: C, debtor: C, debtor_name: C, remittance: C, own: list[str], entries: C | None = None) -> Column:
    """Debits name the creditor, credits the debtor unless that is missing or oneself; then the first remittance text."""
    said = first_remittance(remittance, entries)
    outgoing = first_filled(creditor, creditor_name, said)
    who = first_filled(debtor, debtor_name)
    incoming = F.when((who == "") | is_own_name(who, own), said).otherwise(who)
    return first_filled(F.when(col(ind) == "DBIT", outgoing).otherwise(incoming), F.lit("Unknown"))


def notes_of(unstructured: C, remittance: C, entries: C | None = None) -> Column:
    return F.when(first_filled(unstructured) != "", col(unstructured)).otherwise(F.array_join(remittance_items(remittance, entries), " "))


def entry_ref(reference: C, transaction_id: C) -> Column:
    return first_filled(reference, transaction_id)


def status_or_booked(status: C) -> Column:
    return F.coalesce(null_if_empty(status), F.lit("BOOK"))


# Text


def title_case(text: C) -> Column:
    """White space folded to single blanks, each word with a capital first letter and the rest small."""
    return F.initcap(F.trim(F.regexp_replace(col(text), r"\s+", " ")))


#: Code points whose own lower case is not what a whole text's lower case makes of them.
LOWER_ALONE = {"\u0130": "i", "\u03a3": "\u03c3"}


def _mapped(c: Column, pairs: dict[str, str]) -> Column:
    return F.translate(c, "".join(pairs), "".join(pairs.values()))


def normalise(text: C) -> Column:
    """Lower case code point by code point: a letter's place in its word does not count, and none becomes two."""
    return F.lower(_mapped(col(text), LOWER_ALONE))


@lru_cache(maxsize=1)
def _folded_alone() -> dict[str, str]:
    """Lower-case letters that share their capital with another one, and that one (simple folding): long s and s."""
    out = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        big = c.upper()
        if c == c.lower() and len(big) == 1 and big != c and big.lower() != c and len(big.lower()) == 1 and ord(big) > 0x7F or c == "\u017f":
            out[c] = big.lower()
    return out


def folded(text: C) -> Column:
    """Equal for texts that are equal under simple case folding, code point by code point; the dotted capital I, which
    folds to nothing but itself, stays apart."""
    return _mapped(F.lower(_mapped(col(text), {"\u03a3": "\u03c3", "\u0130": "\uffff"})), _folded_alone())


def same_fold(a: C, b: C) -> Column:
    return folded(a) == folded(b)


def number_prefix(text: C) -> Column:
    """The number a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(col(text), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def truthy(text: C) -> Column:
    return ~F.coalesce(col(text), F.lit("")).isin("", "0", "false")


def _unpadded(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_g(x: C) -> Column:
    """The shortest decimal form of a double, with an exponent of two digits at least from a million on or below 1e-4."""
    d = col(x).cast("double")
    said = F.abs(d).cast("string")
    parts = F.split(said, "E")
    digits = F.replace(parts[0], F.lit("."), F.lit(""))
    seven = F.size(parts) < 2  # Java writes up to 1e7 in full
    power = F.when(seven, 6).otherwise(F.try_element_at(parts, F.lit(2)).try_cast("int"))
    mantissa = F.when(seven, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(parts[0])
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    sign = F.when(d < 0, "-").otherwise("")
    small = F.when(F.abs(d) < 1e6, F.abs(d)).cast("decimal(38,24)").cast("string")
    wide = (F.abs(d) >= 1e6) | ((F.abs(d) < 1e-4) & (d != 0))
    return F.when(wide, F.concat(sign, _unpadded(mantissa), exponent)).otherwise(F.concat(sign, _unpadded(small)))


# Change messages and clocks


def encode_text(v: C) -> Column:
    return F.when(col(v).isNull(), "0:").otherwise(F.concat(F.lit("S:"), col(v)))


def encode_number(v: C) -> Column:
    kind = F.typeof(col(v))
    text = F.when(kind.isin("double", "float"), format_g(col(v).cast("double"))).otherwise(col(v).cast("string"))
    return F.when(col(v).isNull(), "0:").otherwise(F.concat(F.lit("N:"), text))


def encode_other(v: C) -> Column:
    return F.when(col(v).isNull(), "0:").otherwise(F.concat(F.lit("S:"), col(v).cast("string")))


def decode_text(v: C) -> Column:
    """The text of an S: value, null for any other."""
    return F.when(F.substring(col(v), 1, 2) == "S:", F.substr(col(v), F.lit(3)))


def decode_number(v: C) -> Column:
    """The number of an N: value, null for any other or a malformed one."""
    rest = F.substr(col(v), F.lit(3))
    return F.when((F.substring(col(v), 1, 1) == "N") & rest.rlike(_NUMBER), rest.try_cast("double"))


def is_safe_identifier(v: C) -> Column:
    return col(v).rlike(r"\A[A-Za-z0-9_]+\z")


def format_clock(ts: C, counter: C, client: C) -> Column:
    """2024-03-15T10:30:45.123Z-0042-CLIENT; a counter over FFFF keeps all its digits."""
    digits = F.hex(col(counter))
    padded = F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))
    return F.concat(F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z-"), padded, F.lit("-"), col(client))


def parse_clock(text: C) -> Column:
    """Struct (ts, counter, client) of a clock's text; null if it is malformed."""
    t = col(text)
    form = r"^(.*?Z)-(?:.*-)?([0-9A-Fa-f]+)-([^-]*)$"
    ts = F.try_to_timestamp(F.regexp_extract(t, form, 1), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))
    counter = F.conv(F.regexp_extract(t, form, 2), 16, 10).cast("int")
    return F.when(t.rlike(form) & ts.isNotNull(), F.struct(ts.alias("ts"), counter.alias("counter"), F.regexp_extract(t, form, 3).alias("client")))


# Keys, sessions, versions


def pending_key(ref: C, date: C, cents: C) -> Column:
    """The reference, or date and amount when there is none (then equal days and amounts collide)."""
    return F.when(first_filled(ref) != "", col(ref)).otherwise(F.concat_ws("|", F.date_format(col(date), "yyyy-MM-dd"), cents_to_decimal(cents)))


def split_pending(value: C) -> Column:
    """Struct (txn_id, date) of 'txn_id|date'; without a bar the date is ''."""
    parts = F.split(col(value), r"\|", 2)
    return F.struct(parts[0].alias("txn_id"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("date"))


def mask_iban(iban: C) -> Column:
    c = col(iban)
    n = F.length(c)
    return F.when(n <= 8, c).otherwise(F.concat(F.substring(c, 1, 4), F.repeat(F.lit("*"), (n - 8).cast("int")), F.right(c, F.lit(4))))


def effective_uid(*ids: C) -> Column:
    return first_filled(*ids)


def parse_expiry(text: C) -> Column:
    """RFC 3339, or naive ISO text taken as UTC; else null."""
    t = col(text)
    with_zone = F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), t.try_cast("timestamp"))
    naive = F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$"), F.concat(t, F.lit("Z")).try_cast("timestamp"))
    return F.coalesce(with_zone, naive)


def _seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / 1e6


def days_left(expiry: C, as_of: C) -> Column:
    """Whole days, truncated toward zero."""
    return ((_seconds(col(expiry)) - _seconds(col(as_of))) / 86400).cast("int")


def hours_since(then: C, as_of: C) -> Column:
    return ((_seconds(col(as_of)) - _seconds(col(then))) / 3600).cast("int")


def expiry_badge(days: C) -> Column:
    d = col(days)
    return F.when(d == 0, "none").when(d < 7, "red").when(d < 30, "yellow").otherwise("green")


def parse_version(v: C) -> Column:
    """Four integers; parts that are none, or missing, are 0."""
    parts = F.transform(F.split(col(v), r"\.", 4), lambda x: F.when(x.rlike(r"^[+-]?\d+$"), F.coalesce(x.try_cast("int"), F.lit(0))).otherwise(F.lit(0)))
    return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.coalesce(F.try_element_at(parts, i), F.lit(0)))


def is_newer(a: C, b: C) -> Column:
    return parse_version(a) > parse_version(b)


def is_release_tag(v: C) -> Column:
    return col(v).rlike(r"\A1\.\d+\.\d+\.\d+\z")


def first_license(licenses: C) -> Column:
    head = F.get(col(licenses), F.lit(0))["license"]
    return first_filled(head["id"], head["name"])


def percent_encode(text: C) -> Column:
    """Unreserved ASCII stays; any other character becomes % and its code point in hex, two digits at least."""
    code = lambda x: F.ascii(x)
    digits = lambda x: F.hex(code(x))
    one = lambda x: F.when(x.rlike(r"^[A-Za-z0-9\-._~]$"), x).otherwise(F.concat(F.lit("%"), F.when(F.length(digits(x)) < 2, F.lpad(digits(x), 2, "0")).otherwise(digits(x))))
    return F.array_join(F.transform(F.filter(F.split(col(text), ""), lambda x: x != ""), one), "")
