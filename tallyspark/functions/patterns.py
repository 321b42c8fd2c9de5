"""Patterns as rule authors write them (RE2 syntax), as Column expressions that no pattern and no text can make fail.

A pattern without operators is a comparison in the JVM. Every other one is given to RE2 itself, which Arrow carries:
its syntax is the one the rules are written in, and it reads a text once whatever the pattern, where a backtracking
engine can take time without end or overflow its stack. All patterns of a projection share one pass through Python.
"""

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Long names of general categories, as the Unicode standard lists them.
CATEGORIES = {
    "other": "C", "control": "Cc", "cntrl": "Cc", "format": "Cf", "unassigned": "Cn", "privateuse": "Co", "surrogate": "Cs",
    "letter": "L", "lowercaseletter": "Ll", "modifierletter": "Lm", "otherletter": "Lo", "titlecaseletter": "Lt", "uppercaseletter": "Lu",
    "mark": "M", "combiningmark": "M", "spacingmark": "Mc", "enclosingmark": "Me", "nonspacingmark": "Mn",
    "number": "N", "decimalnumber": "Nd", "digit": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "punct": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "closepunctuation": "Pe", "finalpunctuation": "Pf", "initialpunctuation": "Pi", "otherpunctuation": "Po", "openpunctuation": "Ps",
    "symbol": "S", "currencysymbol": "Sc", "modifiersymbol": "Sk", "mathsymbol": "Sm", "othersymbol": "So",
    "separator": "Z", "lineseparator": "Zl", "paragraphseparator": "Zp", "spaceseparator": "Zs",
}

_NAMED = re.compile(r"\\(?:p(?:\{(\^?)([^}]*)\}|([a-z]))|(.))", re.DOTALL)
_GROUP_NAME = re.compile(r"\\.|\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\]|\(\?<(\w+)>", re.DOTALL)
_PLAIN = re.compile(r"(\^?)((?:[^\\^$.|?*+()\[\]{}]|\\[!-/:-@\[-`{-~])*)(\$?)", re.DOTALL)


def _named_class(m: re.Match) -> str:
    """Names of classes are known in any case, with or without signs between their words; RE2 has them in one form only."""
    if m[4] is not None:
        return m[0]
    name = m[2] if m[3] is None else m[3]
    bare = re.sub(r"[\s_-]", "", name)
    known = CATEGORIES.get(bare) or (bare.capitalize() if len(bare) <= 2 else "_".join(w.capitalize() for w in re.split(r"[\s_-]+", name.strip())))
    return rf"\p{{{m[1] or ''}{known}}}"


@lru_cache(maxsize=100_000)
def re2_pattern(pattern: str) -> str | None:
    """A lower-cased pattern as RE2 takes it; None if it is not valid (then nothing matches)."""
    p = _NAMED.sub(_named_class, pattern)
    names = [m[1] for m in _GROUP_NAME.finditer(p) if m[1]]
    if len(names) > len(set(names)):  # a mere match does not name its groups, so RE2 would not say
        return None
    try:
        pc.match_substring_regex(pa.array([""]), pattern=p)
    except pa.ArrowInvalid:
        return None
    return p


def plain_pattern(pattern: str) -> tuple[bool, str, bool] | None:
    """(at the beginning, text, at the end) of a pattern that says no more than that; None of any other."""
    m = _PLAIN.fullmatch(pattern)
    return (bool(m[1]), re.sub(r"\\(.)", r"\1", m[2], flags=re.DOTALL), bool(m[3])) if m else None


def matches_pattern(text: Column, pattern: str) -> Column:
    """Whether the lower-cased ``pattern`` is found in ``text``; one that is not valid is found nowhere."""
    plain = plain_pattern(pattern)
    if plain is not None:
        begins, said, ends = plain
        say = F.lit(said)
        if begins and ends:
            return text == say
        return F.startswith(text, say) if begins else F.endswith(text, say) if ends else F.contains(text, say)
    p = re2_pattern(pattern)
    if p is None:
        return F.lit(False)
    return F.arrow_udf(lambda texts: pc.match_substring_regex(texts, pattern=p), "boolean")(text)
