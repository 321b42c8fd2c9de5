"""Patterns as rule authors write them: the definitions of RE2's syntax, after lower-casing."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import patterns as pt
from tallyspark.functions import scalars as fn

#: pattern: (texts it is found in, texts it is not found in)
FOUND = {
    "foo{bar}": (["foo{bar}", "xfoo{bar}y"], ["foobar", "foo"]), "a{,3}": (["a{,3}"], ["aaa"]), "a{2}": (["baa"], ["aba"]), "a{1": (["a{1"], ["a", "a1"]), "{": (["{"], [""]), "x{2,1b}": (["x{2,1b}"], ["xx"]), "a{01}": (["a{01}"], ["a"]),
    "a{2,}": (["aaa"], ["a"]), "^a{1,2}$": (["a", "aa"], ["aaa"]), "(ab){2}": (["abab"], ["abba"]), "a{1000}": (["a" * 1000], ["a" * 999]), "a{0}b": (["b"], ["a"]),
    "[[:digit:]]+": (["a7"], ["a", ":digit"]), "[[:^alpha:]]": (["1"], ["a", ""]), "^[[:word:][:punct:]]+$": (["a_1!"], ["a b"]), "[[:space:]]": (["a\tb"], ["ab"]), "[[:xdigit:]]{3}": (["1af"], ["1ag"]),
    "a(?i)b": (["ab", "aB"], ["a"]), "(?i:x)y": (["xy", "Xy"], ["XY"]), "(?s)a.b": (["a\nb"], ["ab"]), "a.b": (["a b"], ["a\nb"]), "(?s:.)": (["\n"], [""]), "(?-s).": (["x"], ["\n"]), "(?m)^b$": (["a\nb\nc", "b"], ["ab", "a b"]), "^b$": (["b"], ["a\nb", "b\n"]), "(?)a": (["a"], ["b"]), "(?im-s)^A": (["b\na"], ["ba"]),
    "(?<n>x)+": (["xx"], ["n"]), "(?:ab|c)d": (["cd", "abd"], ["ad"]), "()": (["", "a"], []), "a||b": (["", "z"], []), "^*a": (["a", "ba"], ["b"]), "(|a)b": (["b"], ["a"]),
    "a??b": (["ab", "b"], ["a"]), "a+?": (["a"], ["b"]), "a*?$": (["", "b"], []),
    "[]a]": (["]", "a"], ["b"]), "[^]a]": (["b"], ["]", "a", ""]), "[a-]": (["-"], ["b"]), "[-a]": (["-"], ["b"]), "[a-c-e]": (["-", "b", "e"], ["d"]), "[[a]": (["[", "a"], ["]"]), "[&&a]": (["&", "a"], ["b"]), "[a^]": (["^"], ["b"]), "[.]": (["."], ["a"]), r"[\]]": (["]"], ["\\"]), r"[\d\s]": (["1", " "], ["a"]), "[[:]": ([":", "["], ["]"]),
    r"\.": (["."], ["a"]), r"\_": (["_"], ["a"]), r"\{2}": (["{2}"], ["2"]), r"\a": (["\a"], ["a"]), r"\n\t\f\r\v": (["\n\t\f\r\v"], ["n"]), r"\x41": (["A"], ["a", "x41"]), r"\x{20ac}": (["€"], ["20ac"]), r"\012": (["\n"], ["012"]), r"\12": (["\n"], ["12"]), r"\bok\b": (["an ok.", "ok"], ["book"]), r"a\z": (["ba"], ["ab", "a\n"]), r"\s": ([" ", "\f"], ["\v", " "]), r"\w\d": (["é1_2"], ["é"]),
    r"\pl": (["é"], ["1"]), r"\p{greek}": (["αβ"], ["ab"]), r"\p{^l}": (["1"], ["é"]), r"[\p{nd}x]": (["٣", "x"], ["y"]), r"\p{letter}": (["é"], ["-"]), r"\\pl": (["\\pl"], ["é", "l"]),
    "é+": (["éé"], ["e"]), "🙂": (["a🙂"], ["a"]), "a": (["ba"], [""]), "^a": (["ab"], ["ba"]), "a$": (["ba"], ["ab", "a\n"]), "^$": ([""], ["a", "\n"]), r"^a\+b$": (["a+b"], ["aab"]),
}

NOT_VALID = [
    "(?#c)a", "b++", "b?+", "b**", "b+*", "a{2}{3}", "a{2}*", "(?>ab)", "x{1,1001}", "x{1001}", "x{2,1}", "(a{100}){11}", "(?p<n>x)", "(?<n>x)(?<n>y)", "(?<>x)", "(?<a-b>x)", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?i", "(?i-)", "(?-)a", "(?u)a", "(?x)a b",
    "(a", "a)", "[a", "[]", "[z-a]", r"[\b]", r"[a-\d]", "[[:foo:]]", "*a", "+", "?", "a|*", "(*)", r"\1", r"(q)\1", r"\8", "\\", "a\\", r"\q.\e", r"\c", r"\g", r"\é", r"\x", r"\x{", r"\x{110000}", r"\p{", r"\p{nosuch}", r"\k<n>", "(((",
]


@pytest.fixture(scope="module")
def hits(spark):
    texts = sorted({t for yes, no in FOUND.values() for t in (*yes, *no)} | {p for p in NOT_VALID} | {"a", "ab", "bb", "x", "aa", "qq", "", "\\"})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    said = [*FOUND, *NOT_VALID]
    rows = df.select("t", *[pt.matches_pattern(F.col("t"), p).alias(f"m{k}") for k, p in enumerate(said)]).collect()
    return {p: {r["t"] for r in rows if r[f"m{k}"]} for k, p in enumerate(said)}, set(texts)


@pytest.mark.parametrize("pattern", FOUND)
def test_found(hits, pattern):
    yes, no = FOUND[pattern]
    assert set(yes) <= hits[0][pattern] and not set(no) & hits[0][pattern]


@pytest.mark.parametrize("pattern", NOT_VALID)
def test_not_valid_is_never_found(hits, pattern):
    assert hits[0][pattern] == set()


@pytest.mark.parametrize(("pattern", "parts"), [("abc", (False, "abc", False)), ("^a b", (True, "a b", False)), (r"\.x\$$", (False, ".x$", True)), ("^$", (True, "", True)), ("", (False, "", False)), ("a.c", None), (r"\d", None), ("a|b", None), ("a^", None), ("$a", None), (r"\_", (False, "_", False)), ("{x}", None)])
def test_patterns_that_need_no_engine(pattern, parts):
    assert pt.plain_pattern(pattern) == parts


@pytest.mark.parametrize("pattern", ["(a*)*$", "(a|aa)+$", "(a|b|ab)*c", "(x+x+)+y", "(?:.*,){11}p"])
def test_no_text_makes_a_pattern_hang_or_fail(spark, pattern):
    df = spark.createDataFrame([("a" * 200_000 + "b",), ("x" * 200_000,), ("1," * 100_000,)], "t string")
    assert df.where(pt.matches_pattern(F.col("t"), pattern)).count() >= 0


def test_a_projection_of_patterns_passes_through_python_once(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    plan = df.select(*[pt.matches_pattern(F.col("t"), f"[{k}-9]+x?").alias(f"m{k}") for k in range(9)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("ArrowArrowEval") <= 1 or plan.count("EvalPython") == 1


CASES = [("İstanbul", "istanbul"), ("ΟΔΟΣ", "οδοσ"), ("ΣΑΣ Σ", "σασ σ"), ("ſ", "ſ"), ("K", "k"), ("ẞ", "ß"), ("ÅÉ", "åé"), ("ǅ", "ǆ"), ("ϴ", "θ"), ("I", "i"), ("ı", "ı"), ("", ""), ("𐐀", "𐐨")]


def test_lower_case_by_code_point(spark):
    df = spark.createDataFrame(CASES, "t string, want string")
    assert df.where(~fn.normalise("t").eqNullSafe(F.col("want"))).collect() == []


FOLDS = [
    ("ſ", "S", True), ("K", "K", True), ("σ", "ς", True), ("Σ", "ς", True), ("µ", "Μ", True), ("ẞ", "ß", True), ("ß", "ss", False), ("İ", "i", False), ("İ", "i̇", False), ("ı", "I", False), ("ϑ", "Θ", True), ("ϴ", "ϑ", True),
    ("ͅ", "Ι", True), ("å", "Å", True), ("ǅ", "Ǆ", True), ("Ω", "Ω", True), ("ẛ", "Ṡ", True), ("Ꭰ", "ꭰ", True), ("ᾈ", "ᾀ", True), ("É", "e", False), ("abc", "ABC", True), ("abc", "ab", False),
]


def test_simple_folding(spark):
    df = spark.createDataFrame(FOLDS, "a string, b string, want boolean")
    assert df.where(fn.same_fold("a", "b") != F.col("want")).collect() == [] and df.where(fn.same_fold("b", "a") != F.col("want")).collect() == []


def test_folding_is_that_of_the_standard_where_one_code_point_stays_one(spark):
    import unicodedata

    letters = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c))[0] in "LM" and len(chr(c).casefold()) == 1]
    df = spark.createDataFrame([(x, x.casefold()) for x in letters], "a string, b string")
    assert df.where(~fn.same_fold("a", "b")).collect() == []


@pytest.mark.parametrize(("text", "cents"), [("1e30", None), ("-1e300", None), ("1e999", None), ("92233720368547758", None), ("9e16", 9_000_000_000_000_000_000), ("12.345", 1235), ("1e2", 10000)])
def test_amounts_beyond_64_bits_are_no_amounts(spark, text, cents):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(fn.decimal_to_cents("a").alias("c")).first()["c"] == cents
