r"""Substring deduplication by hashing the clauses of lines and removing long runs of repeated ones.

Lines are cut into units: a unit ends at the line's end, or behind a word that ends in one of ``. ! ? , ; :`` once it
holds ``UNIT_WORDS`` words. Units are normalised (A-Z lower-cased, ASCII white space folded) and digested to 128 bits;
digests are grouped over all documents with pre-aggregation, and the occurrence with the smallest (id, text hash,
offset) is the first. Where consecutive units of a document (also over line ends) all occur earlier and hold at least
``RUN_WORDS`` words together, they are a repeated passage and go, with what stands between them and the next unit.
Shorter runs, such as one common line, stay. The removed spans keep the offsets of the original text.

Digests with more than a ten-thousandth of all units, ``MOST_HOT`` at most, are looked up by broadcast; all others
are joined by a shuffle, so no task gathers a common line.

Defined results: null and empty texts have no units and come back as the empty text; rows that share id and text are
one document and are edited alike; null ids rank first; a text that repeats its own passage keeps the first; extra
columns pass through; an empty table gives no rows.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scope, lean, lean_rows, materialize

UNIT_WORDS = 4
RUN_WORDS = 35
MOST_HOT = 10_000
ROWS_A_BATCH = 50_000

#: A unit of a line: at least UNIT_WORDS words up to one that ends in a mark, or else the rest of the line.
UNIT = r"[\x20\x09\x0B-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]+){%d,}?[^\x20\x09-\x0D]*[.!?,;:](?:[\x20\x09\x0B-\x0D]+|$)|.+" % (UNIT_WORDS - 1)
_UNIT = re.compile(UNIT.encode(), re.DOTALL)

_UNITS = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("place", pa.decimal128(38, 0)), ("k", pa.int32()), ("words", pa.int32()), ("again", pa.bool_())])
_UNITS_DDL = "high bigint, low bigint, place decimal(38,0), k int, words int, again boolean"


def units(raw: bytes):
    """(byte offset, words) of each unit of a lower-cased text that has a word."""
    at = 0
    for line in raw.split(b"\n"):
        for m in _UNIT.finditer(line):
            w = m[0].split()
            if w:
                yield at + m.start(), w
        at += len(line) + 1


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def place_of(id_col: str, text_col: str) -> Column:
    """A document's rank as one number: its id, then the upper 62 bits of its text's hash; null ids come first."""
    mark = F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 2)
    at = F.col(id_col).cast("long").cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(19,0)") + mark.cast("decimal(19,0)")
    none = F.lit("-99999999999999999999999999999999999999").cast("decimal(38,0)") + mark.cast("decimal(19,0)")
    return F.coalesce(at.cast("decimal(38,0)"), none.cast("decimal(38,0)"))


def _unit_rows(batches):
    digest_of = xxhash.xxh3_128_digest
    for batch in batches:
        texts, places = batch.column("text"), batch.column("place")
        digests, rows, ks, words, again = [], [], [], [], []

        def table():
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(digest[:, 0]), pa.array(digest[:, 1]), places.take(pa.array(rows, pa.int32())), pa.array(ks, pa.int32()), pa.array(words, pa.int32()), pa.array(again, pa.bool_())], schema=_UNITS)

        for i in range(batch.num_rows):
            mine: set[bytes] = set()
            for k, (_, w) in enumerate(units(_lowered(texts[i].as_py()))):
                d = digest_of(b" ".join(w))
                digests.append(d)
                rows.append(i)
                ks.append(k)
                words.append(len(w))
                again.append(d in mine)
                mine.add(d)
                if len(rows) >= ROWS_A_BATCH:
                    yield table()
                    digests, rows, ks, words, again = [], [], [], [], []
        if rows:
            yield table()


def _runs(least: int):
    """Of a document's repeated units (k, words) in order: (first, last) of each consecutive run of enough words."""

    def run(lists: pa.Array) -> pa.Array:
        out = []
        for units_ in lists.to_pylist():
            found, first, last, words = [], None, None, 0
            for u in [*units_, {"k": -9, "words": 0}]:
                if last is not None and u["k"] == last:
                    continue
                if last is None or u["k"] != last + 1:
                    if words >= least:
                        found.append({"first": first, "last": last})
                    first, words = u["k"], 0
                last = u["k"]
                words += u["words"]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))

    return F.arrow_udf(lean(run), "array<struct<first:int,last:int>>")


def repeated_runs(docs: DataFrame, least: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, runs): for each document with enough repeated words, the first and last unit of each passage (maybe none)."""
    plain = docs.select(F.col(text_col).cast("string").alias("text"), place_of(id_col, text_col).alias("place"))
    found = materialize(plain.mapInArrow(lean_rows(_unit_rows), _UNITS_DDL), "units")
    first = found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    first = materialize(first, "repeated-units")
    # a digest of more than a ten-thousandth of all units: there cannot be more than MOST_HOT of them
    hot = first.n > found.count() / MOST_HOT
    common = F.broadcast(first.where(hot).select(F.col("high").alias("hh"), F.col("low").alias("hl"), F.col("first").alias("hot_first")))
    told = found.join(common, (F.col("high") == F.col("hh")) & (F.col("low") == F.col("hl")), "left")
    known = F.coalesce(F.col("hot_first"), F.lit("99999999999999999999999999999999999999").cast("decimal(38,0)")) < F.col("place")
    common_gone = told.where(F.col("again") | known)
    rare_gone = told.where("hot_first IS NULL AND NOT again").join(first.where(~hot).drop("n"), ["high", "low"]).where("place > first")
    gone = common_gone.select("place", "k", "words").union(rare_gone.select("place", "k", "words")).distinct()  # rows of one id and text share a place
    listed = gone.groupBy("place").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("k", "words"))).alias("units"))
    return listed.where(F.col("words") >= least).select("place", _runs(least)("units").alias("runs"))


_EDITED = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def cut(text: str | None, runs: list[dict]) -> dict:
    """``text`` without its ``runs`` of units, and their spans in code points."""
    starts = [at for at, _ in units(_lowered(text))]
    raw = (text or "").encode("utf-8", "surrogatepass")
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    kept, spans, at = [], [], 0
    for r in runs:
        start, stop = starts[r["first"]], starts[r["last"] + 1] if r["last"] + 1 < len(starts) else len(raw)
        kept.append(raw[at:start])
        spans.append({"start": int(points[start]), "stop": int(points[stop])})
        at = stop
    kept.append(raw[at:])
    return {"text": b"".join(kept).decode("utf-8", "surrogatepass"), "spans": spans}


def _cut():
    def edit(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([cut(t.as_py(), r.as_py()) if r.is_valid else None for t, r in zip(texts, runs, strict=True)], _EDITED)

    return F.arrow_udf(lean(edit), "struct<text:string,spans:array<struct<start:bigint,stop:bigint>>>")


def remove_repeats(docs: DataFrame, least: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text", text_out: str = "text", spans_out: str = "removed_spans") -> DataFrame:
    """``docs`` with repeated passages removed from ``text_out`` and the removed spans (null: none) in ``spans_out``."""
    with Scope(docs.sparkSession) as scope:
        runs = scope.keep(materialize(repeated_runs(docs, least, id_col, text_col), "runs"))
    runs = runs.select(F.col("place").alias("__ts_key"), F.col("runs").alias("__ts_runs")).hint("merge")  # as many as edited documents: one plan at every size
    edited = docs.withColumn("__ts_own", place_of(id_col, text_col)).join(runs, F.col("__ts_own") == F.col("__ts_key"), "left")
    text = F.col(text_col).cast("string")
    # one Python call gives text and spans; a document without runs keeps its text in the JVM
    some = F.size("__ts_runs") > 0
    edited = edited.withColumn("__ts_cut", _cut()(F.when(some, text), F.when(some, F.col("__ts_runs"))))
    own = F.when(some, F.col("__ts_cut.text")).otherwise(F.coalesce(text, F.lit("")))
    edited = edited.withColumn("__ts_text", own).withColumn("__ts_spans", F.col("__ts_cut.spans"))
    return edited.withColumns({text_out: F.col("__ts_text"), spans_out: F.col("__ts_spans")}).drop("__ts_own", "__ts_key", "__ts_runs", "__ts_cut", "__ts_text", "__ts_spans")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    listed = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    lost = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select(
        "doc_id", F.when(F.col("removed_spans").isNull(), 0).otherwise(F.size("removed_spans")).cast("long").alias("n_removed"), F.coalesce(lost, F.lit(0)).cast("long").alias("removed_chars"),
        F.coalesce(listed, F.lit("")).alias("removed"), "text",
    )
