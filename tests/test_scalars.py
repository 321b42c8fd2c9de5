import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as fn


def one(spark, expr, **values):
    """The value of ``expr`` over one row of typed values: name=(value, type)."""
    df = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, (v, t) in values.items()])
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("cents", "text"), [(0, "0.00"), (1, "0.01"), (12345, "123.45"), (-1, "-0.01"), (-99999, "-999.99"), (None, None)])
def test_cents_to_decimal(spark, cents, text):
    assert one(spark, fn.cents_to_decimal("c"), c=(cents, "long")) == text


@pytest.mark.parametrize(("text", "cents"), [("12.34", 1234), ("-5.00", -500), ("100", 10000), ("abc", None), ("", None), (" 12 ", None), ("12d", None), ("9.999", 1000), ("0.285", 28)])
def test_decimal_to_cents(spark, text, cents):
    assert one(spark, fn.decimal_to_cents("t"), t=(text, "string")) == cents


@pytest.mark.parametrize(("amount", "ind", "cents"), [("42.50", "DBIT", -4250), ("-42.50", "CRDT", 4250), ("5", "", 500), (None, "DBIT", 0), ("x", "DBIT", None)])
def test_signed_cents(spark, amount, ind, cents):
    assert one(spark, fn.signed_cents("a", "i"), a=(amount, "string"), i=(ind, "string")) == cents


@pytest.mark.parametrize(("a", "b", "want"), [("2024-06-01T10:00:00", None, dt.date(2024, 6, 1)), ("2024-6-5", "2024-06-05", dt.date(2024, 6, 5)), ("2024-02-30", None, None), (None, "", None)])
def test_parse_date(spark, a, b, want):
    assert one(spark, fn.parse_date("a", "b"), a=(a, "string"), b=(b, "string")) == want


def test_date_int_round_trip(spark):
    assert one(spark, fn.date_to_int("d"), d=("2024-01-31", "date")) == 20240131
    assert one(spark, fn.int_to_date("n"), n=(20240131, "int")) == dt.date(2024, 1, 31)
    assert one(spark, fn.int_to_date("n"), n=(20240231, "int")) is None


@pytest.mark.parametrize(("raw", "first", "notes"), [('["a","b"]', "a", "a b"), ("plain", "plain", "plain"), ("[]", "", ""), (None, "", ""), ('[1,"b"]', "", "b"), ("", "", "")])
def test_remittance(spark, raw, first, notes):
    assert one(spark, fn.first_remittance("r"), r=(raw, "string")) == first
    assert one(spark, fn.notes_of(F.lit(None).cast("string"), "r"), r=(raw, "string")) == notes


@pytest.mark.parametrize(
    ("ind", "creditor", "debtor", "remittance", "want"),
    [("DBIT", "Shop", "Me", '["x"]', "Shop"), ("DBIT", None, "Me", '["x"]', "x"), ("CRDT", "Shop", "Boss", "x", "Boss"), ("CRDT", "Shop", "OWN", "x", "x"), ("CRDT", "", "", None, "Unknown"), ("DBIT", "", "", "[]", "Unknown")],
)
def test_payee(spark, ind, creditor, debtor, remittance, want):
    none = F.lit(None).cast("string")
    expr = fn.payee_of("i", "c", none, "d", none, "r", ["own"])
    assert one(spark, expr, i=(ind, "string"), c=(creditor, "string"), d=(debtor, "string"), r=(remittance, "string")) == want


@pytest.mark.parametrize(("text", "want"), [("green  TEAPOT", "Green Teapot"), (" o'neil\tSHOP ", "O'neil Shop"), ("", "")])
def test_title_case(spark, text, want):
    assert one(spark, fn.title_case("t"), t=(text, "string")) == want


@pytest.mark.parametrize(("x", "want"), [(2.75, "2.75"), (88.0, "88"), (1e6, "1e+06"), (1234567.0, "1.234567e+06"), (123456789.0, "1.23456789e+08"), (0.00001, "1e-05"), (0.0001, "0.0001"), (-0.5, "-0.5"), (0.0, "0"), (999999.5, "999999.5")])
def test_general_format(spark, x, want):
    from tallyspark.operators import rules

    assert one(spark, fn.format_g("x"), x=(x, "double")) == want
    assert rules.general(x) == want


def test_value_codec(spark):
    assert one(spark, fn.encode_text("v"), v=("teapot", "string")) == "S:teapot"
    assert one(spark, fn.encode_number("v"), v=(-412, "long")) == "N:-412"
    assert one(spark, fn.encode_number("v"), v=(2.75, "double")) == "N:2.75"
    assert one(spark, fn.encode_text("v"), v=(None, "string")) == "0:"
    assert one(spark, fn.encode_other("v"), v=(True, "boolean")) == "S:true"
    for text, word, number in [("S:", "", None), ("N:-7", None, -7.0), ("0:", None, None), ("", None, None), ("Q:odd", None, None), ("N:x", None, None)]:
        assert one(spark, fn.decode_text("v"), v=(text, "string")) == word
        assert one(spark, fn.decode_number("v"), v=(text, "string")) == number


@pytest.mark.parametrize(("clock", "want"), [("2019-07-02T23:05:09.004Z-01F7-00C0FFEE00C0FFEE", (0x1F7, "00C0FFEE00C0FFEE")), ("", None), ("no clock at all", None), ("2019-07-02T23:05:09.004Z-01F7", None)])
def test_clock(spark, clock, want):
    got = one(spark, fn.parse_clock("c"), c=(clock, "string"))
    assert (got and (got["counter"], got["client"])) == want


def test_clock_counter_is_never_cut(spark):
    assert one(spark, fn.format_clock(F.lit("2024-01-01").cast("timestamp"), "n", F.lit("c")), n=(0x12345, "long")).endswith("Z-12345-c")


@pytest.mark.parametrize(("iban", "want"), [("NL55BANK0417164300", "NL55**********4300"), ("NL554300", "NL554300"), ("", "")])
def test_mask_iban(spark, iban, want):
    assert one(spark, fn.mask_iban("i"), i=(iban, "string")) == want


@pytest.mark.parametrize(("a", "b", "newer"), [("2.9.31.7", "2.9.30.88", True), ("3.0.0.1", "2.99.99.99", True), ("5.6.7.8", "5.6.7.8", False), ("4.y.2", "4.0.1.5", True)])
def test_versions(spark, a, b, newer):
    assert one(spark, fn.is_newer("a", "b"), a=(a, "string"), b=(b, "string")) is newer


@pytest.mark.parametrize(("tag", "ok"), [("1.0.31.6", True), ("nightly", False), ("v1.0.31.6", False), ("1.0.31", False), ("2.0.31.6", False)])
def test_release_tag(spark, tag, ok):
    assert one(spark, fn.is_release_tag("t"), t=(tag, "string")) is ok


def test_days_left_truncates(spark):
    for expiry, days in (("2024-01-02T11:59:59Z", 0), ("2023-12-31T00:00:00Z", -1), ("2024-01-11T12:00:00", 10)):
        assert one(spark, fn.days_left(fn.parse_expiry("e"), F.expr("timestamp'2024-01-01 12:00:00'")), e=(expiry, "string")) == days


@pytest.mark.parametrize(("text", "want"), [("a b/c~", "a%20b%2Fc~"), ("é", "%E9"), ("€", "%20AC"), ("", "")])
def test_percent_encode(spark, text, want):
    assert one(spark, fn.percent_encode("t"), t=(text, "string")) == want


def test_pending_value(spark):
    assert tuple(one(spark, fn.split_pending("v"), v=("T1|2024-01-01", "string"))) == ("T1", "2024-01-01")
    assert tuple(one(spark, fn.split_pending("v"), v=("T1", "string"))) == ("T1", "")


def test_truth_and_numbers(spark):
    for text, truth, number in (("0", False, 0.0), ("", False, 0.0), ("false", False, 0.0), ("yes", True, 0.0), (" 42x", True, 42.0), (None, False, 0.0)):
        assert one(spark, fn.truthy("t"), t=(text, "string")) is truth
        assert one(spark, fn.number_prefix("t"), t=(text, "string")) == number


def test_safe_identifier(spark):
    for text, ok in (("a_1", True), ("a-b", False), ("", False), ("a\n", False)):
        assert one(spark, fn.is_safe_identifier("t"), t=(text, "string")) is ok
