"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. The vector of an n-gram binds those of its
letters: each is rotated by its place and they are multiplied. A text's vector bundles (adds) those of all its n-grams;
white space, digits and signs between words count as one blank. A language's prototype bundles the unit vectors of its
documents. A document gets the language whose prototype has the greatest cosine with it, of equal ones the first by name.

Learning takes about ``MOST_A_LANGUAGE`` documents of each language (all where there are fewer), by a hash of id and
text. They are bundled where they lie and one vector a partition and language is added up, so no document reaches the
driver. Every document is predicted from its whole text, a long one piece by piece.

Defined results: a null text or one without a letter is ``und`` with score 0; score is the cosine, 0 where it is less;
rows with a null id, language or text teach nothing, repeated rows as often as they stand; with no language to learn
all rows are ``und``; repeated rows are predicted alike; an empty table gives no rows; extra columns pass through, but a
column named like the output is replaced by it. More than ``MOST_LANGUAGES`` languages are an error, as their
prototypes are broadcast.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_rows, table

SIZE = 512
N = 3
MOST_A_LANGUAGE = 5_000
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
PIECE = 1 << 18  # characters worked on at once
AT_ONCE = 1 << 13  # n-grams whose vectors are held at once
BLANK = 32


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=4096)
def letter_vector(code_point: int) -> np.ndarray:
    bits = np.frombuffer(np.random.Generator(np.random.PCG64(code_point)).bytes(SIZE // 8), np.uint8)
    return np.unpackbits(bits).astype(np.int8) * 2 - 1


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text with a blank at both ends, every run of what is no letter as one blank."""
    s = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(is_letter()[s], s, BLANK)
    return s[(s != BLANK) | np.concatenate(([True], s[:-1] != BLANK))]


def _counted(row: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of symbols and the row each belongs to: the letters that occur; and by row and n-gram, in order, the row, the
    numbers of the n-gram's letters (one column each) and how often it occurs."""
    letters = np.flatnonzero(np.bincount(s))
    number = np.zeros(int(letters[-1]) + 1, np.uint64)
    number[letters] = np.arange(len(letters))
    s = number[s]
    base, n = np.uint64(len(letters)), max(0, len(s) - N + 1)
    key = row[:n].astype(np.uint64)
    for k in range(N):
        key = key * base + s[k : n + k]
    key = np.sort(key[row[:n] == row[N - 1 : N - 1 + n]])
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count, key = np.diff(np.append(first, len(key))), key[first]
    grams = np.empty((len(key), N), np.int64)
    for k in reversed(range(N)):
        grams[:, k], key = key % base, key // base
    return letters, key.astype(np.int64), grams, count


def _add(out: np.ndarray, rows: list[int], parts: list[np.ndarray]) -> None:
    """Bundle the n-grams of every part into the row of ``out`` it belongs to."""
    letters, row, grams, count = _counted(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts))
    drawn = np.array([letter_vector(int(c)) for c in letters])
    turned = [np.roll(drawn, N - 1 - k, axis=1) for k in range(N)]
    ends = np.searchsorted(row, np.arange(len(parts) + 1))
    for k, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        for at in range(low, high, AT_ONCE):
            some = slice(at, min(high, at + AT_ONCE))
            bound = turned[0][grams[some, 0]]
            for j in range(1, N):
                bound *= turned[j][grams[some, j]]
            out[rows[k]] += count[some].astype(np.float32) @ bound.astype(np.float32)


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and whether it has a letter."""
    out, lettered = np.zeros((len(texts), SIZE), np.float32), np.zeros(len(texts), bool)
    rows, parts, held = [], [], 0
    for k, text in enumerate(texts):
        carry = None
        for at in range(0, len(text or ""), PIECE):
            s = symbols(text[at : at + PIECE])
            lettered[k] |= len(s) > 1
            if carry is not None:  # the piece goes on where the one before it ended
                goes_on = s[1:] if is_letter()[ord(text[at].lower()[0])] or carry[-1] == BLANK else s
                s = np.concatenate((carry, goes_on))
            if at + PIECE < len(text) and is_letter()[ord(text[at + PIECE - 1].lower()[-1])]:
                s = s[:-1]
            carry = s[-(N - 1) :]
            rows.append(k)
            parts.append(s)
            held += len(s)
            if held >= PIECE or len(parts) >= 4096:
                _add(out, rows, parts)
                rows, parts, held = [], [], 0
    if parts:
        _add(out, rows, parts)
    return out, lettered


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of nothing but zeros stay."""
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(size > 0, size, 1)


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_A_LANGUAGE) -> Profiles:
    """Prototypes of the languages of ``docs``, of about ``most`` documents each."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1)
    found = {r["lang"]: r["count"] for r in counts.collect()}
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    if not found:
        return Profiles([], np.zeros((0, SIZE)))
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, most / n)) for x, n in found.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / (1 << 30) < F.col("share")
    sample = known.join(F.broadcast(shares), "lang").where(drawn).select("lang", "text")

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            v = unit(vectors(batch.column("text").to_pylist())[0]).astype(np.float64)
            langs = batch.column("lang").to_pylist()
            for x in set(langs):
                total[x] = total.get(x, 0) + v[[y == x for y in langs]].sum(0)
        if total:
            place = np.tile(np.arange(SIZE, dtype=np.int32), len(total))
            yield pa.record_batch([pa.array(np.repeat(list(total), SIZE).tolist(), pa.string()), pa.array(place), pa.array(np.concatenate(list(total.values())))], names=["lang", "place", "x"])

    sums = sample.mapInArrow(lean_rows(bundle), "lang string, place int, x double").groupBy("lang", "place").agg(F.sum("x").alias("x"))
    languages = sorted(found)
    prototypes = np.zeros((len(languages), SIZE))
    at = {x: k for k, x in enumerate(languages)}
    for r in sums.toLocalIterator():
        prototypes[at[r["lang"]], r["place"]] = round(r["x"], 6)  # the order of addition does not show
    return Profiles(languages, unit(prototypes))


def predict(docs: DataFrame, fitted: Profiles, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with struct ``out``: the language of each whole text and its cosine (0 to 1)."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast((fitted.languages, fitted.prototypes))

    def guess(texts: pa.Array) -> pa.Array:
        languages, prototypes = sent.value
        found = []
        for at in range(0, len(texts), 1024):
            v, lettered = vectors(texts.slice(at, 1024).to_pylist())
            if not languages:
                found.extend([{"lang": UNKNOWN, "score": 0.0}] * len(v))
                continue
            cosine = unit(v).astype(np.float64) @ prototypes.T
            best = cosine.argmax(1)
            found.extend({"lang": languages[b], "score": float(min(1.0, max(0.0, c[b])))} if some else {"lang": UNKNOWN, "score": 0.0} for b, c, some in zip(best, cosine, lettered, strict=True))
        return pa.array(found, kind)

    return docs.withColumn(out, F.arrow_udf(lean(guess), "struct<lang:string,score:double>")(F.col(text_col).cast("string")))


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs.where(~held_out))
    found = predict(docs.select("doc_id", "text"), model, out="l")
    return found.select("doc_id", held_out.alias("held_out"), F.col("l.lang").alias("lang_pred"), F.round("l.score", 6).alias("score"))
