"""Canonical exact digests with DataFrame functions only.

A text is brought to canonical form in the JVM (compatibility composition, full case folding, white-space folding)
and hashed to 128 bits by two seeded xxhash64 values. Digests are grouped; inside buckets of several texts the
canonical bytes are compared. Should a bucket hold different texts, each of them gets its own suffix, so equal
fingerprints always mean equal canonical texts.

Defined results: null and empty texts have the fingerprint of the empty text; repeated rows have equal fingerprints;
rows of one id follow each other by a hash of the row, and rows without an id come first, by a hash as well; extra
columns are not read; an empty table gives no rows.
"""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scope, materialize, whole_text

MOST_BROADCAST_KEYS = 1_000_000
MOST_BLOCKS = 65_536
IDS_A_BLOCK = 10
ROWS_A_BLOCK = 1024
SPACES = r"(?U)\s+"


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again, white space folded to single blanks. ASCII texts skip the Unicode steps."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = compose(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True)))
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), SPACES, " "))


def wide_hash(text: Column) -> Column:
    """128 bits as struct of two longs."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("tallyspark"), text).alias("h2"))


def _hex(h: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(h["h1"])), 16, "0"), F.lpad(F.lower(F.hex(h["h2"])), 16, "0"))


def split_buckets(members: DataFrame, key: str = "hash", text: str = "canon") -> DataFrame:
    """Compare the bytes inside each bucket of ``members`` (hash, canonical text). Returns (hash, text, ordinal) for the
    texts of buckets that hold different ones; a partial minimum and maximum decide, so a hot bucket is never gathered."""
    ends = materialize(members.groupBy(key).agg(F.min(text).alias("least"), F.max(text).alias("most")).where("least <> most").select(key), "mixed-buckets")
    n = ends.count()  # none, unless hashes of 128 bits collide: then nothing is dealt by bucket at all
    mixed = (members.join(_small(ends, n), key, "left_semi") if n else members.limit(0)).select(key, text).distinct()
    return mixed.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(text)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST_KEYS else df


def repeated_hashes(hashes: DataFrame) -> tuple[DataFrame, int]:
    """Hashes that occur more than once, and how many."""
    again = materialize(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    return again, again.count()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """(id, fingerprint) of every row."""
    canon = docs.select(F.col(id_col).alias("id"), canonical(whole_text(text_col)).alias("canon")).withColumn("hash", hash_of(F.col("canon")))
    again, n = repeated_hashes(canon.select("hash"))
    odd = materialize(split_buckets(canon.select("hash", "canon").join(_small(again, n), "hash", "left_semi")), "mixed")
    if odd.isEmpty():
        return canon.select(F.col("id").alias(id_col), _hex(F.col("hash")).alias("fingerprint"))
    told = canon.join(odd, ["hash", "canon"], "left")
    return told.select(F.col("id").alias(id_col), F.concat_ws("-", _hex(F.col("hash")), F.col("ordinal")).alias("fingerprint"))


def _mark(*columns: str) -> Column:
    """What tells rows of one id apart."""
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("tallyspark"), *columns).alias("h2"))


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``mark``, a hash of id and text, and struct ``next``: ``columns`` and mark of the row that follows by
    id and mark (after the last, the first).

    Ids are cut at quantiles of a sample (IDS_A_BLOCK ids a range) into at most MOST_BLOCKS ranges, of about ROWS_A_BLOCK
    rows while that suffices, wherever the ids lie; rows without an id are cut into as many ranges by their marks. A
    window works inside a range; the first row of each range is looked up, by its id and mark, for the last row of the
    range before it.
    """
    docs = docs.withColumn("mark", _mark(*[c for c in columns if c in (id_col, "text")]))
    columns = [*columns, "mark"]
    n = docs.count()
    blocks = max(1, min(MOST_BLOCKS, n // ROWS_A_BLOCK))
    some = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").sample(min(1.0, IDS_A_BLOCK * blocks / max(1, n)), seed=7)
    ids = np.sort(some.limit(2 * IDS_A_BLOCK * MOST_BLOCKS).toArrow().column("id").to_numpy()) if blocks > 1 else np.zeros(0, np.int64)  # 10 MB at most
    cuts = np.unique(ids[len(ids) * np.arange(1, blocks) // blocks]).tolist() if len(ids) else []
    at = F.lit(0)  # how many cuts are at or below the id, found by halves
    if cuts:
        listed = F.from_json(F.lit(str(cuts)), "array<bigint>")  # folded into one constant
        jumps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        found = lambda lo, jump: F.coalesce((lo + jump <= len(cuts)) & (F.get(listed, lo + jump - 1) <= F.col(id_col)), F.lit(False))
        at = F.aggregate(F.lit(jumps), F.lit(0), lambda lo, jump: F.when(found(lo, jump), lo + jump).otherwise(lo))
    block = F.when(F.col(id_col).isNull(), -1 - F.pmod("mark.h1", F.lit(blocks))).otherwise(at).cast("long")
    row = F.struct(*columns)
    inside = docs.withColumn("block", block).withColumn("next", F.lead(row).over(Window.partitionBy("block").orderBy(id_col, "mark")))
    over_all = Window.partitionBy(F.lit(0)).orderBy("of")
    ring = docs.select(block.alias("of"), F.struct(id_col, "mark").alias("first")).groupBy("of").agg(F.min("first").alias("first"))  # at most 2 * MOST_BLOCKS rows
    ring = ring.select("of", F.when(F.lead("of").over(over_all).isNull(), F.first("first").over(over_all)).otherwise(F.lead("first").over(over_all)).alias("follows"))
    first = F.col(id_col).eqNullSafe(F.col(f"follows.{id_col}")) & (F.col("mark") == F.col("follows.mark"))
    after = docs.join(F.broadcast(ring), first).groupBy("of").agg(F.min(row).alias("after"))
    out = inside.join(after, (F.col("block") == F.col("of")) & F.col("next").isNull(), "left")
    return out.withColumn("next", F.coalesce("next", "after")).drop("after", "of", "block")


def edited(text: Column, after: Column) -> Column:
    """``text`` with its last quarter replaced by as many leading code points of ``after`` (or all it has)."""
    n = F.char_length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(after, F.lit(1), k))


def edited_fingerprints(docs: DataFrame, hash_of: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text, comparable with each other."""
    docs = docs.select("doc_id", whole_text("text").alias("text"))
    digest = lambda text: hash_of(canonical(text))
    pairs = with_next(docs.withColumn("own", digest(F.col("text"))), "doc_id", ["doc_id", "text", "own"])
    pairs = pairs.withColumn("new", edited(F.col("text"), F.col("next.text")))
    hashed = pairs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("new", "UTF-8"), 256).alias("edited_sha256"),
        "own", digest(F.col("new")).alias("edit"), F.col("next.own").alias("near"), "mark", F.col("next.doc_id").alias("next_id"), F.col("next.mark").alias("next_mark"),
    )
    with Scope(docs.sparkSession) as scope:
        hashed = scope.keep(materialize(hashed, "digests"))

        again, n = repeated_hashes(hashed.select(F.col("own").alias("hash")).union(hashed.select(F.col("edit").alias("hash"))))
        again = _small(again, n)
        own_ids = materialize(hashed.select("doc_id", F.col("own").alias("hash")).join(again, "hash", "left_semi").select(F.col("doc_id").alias("want")).distinct(), "own-again")
        texts = docs.join(_small(own_ids, own_ids.count()), F.col("doc_id").eqNullSafe(F.col("want")), "left_semi")
        own = texts.select(canonical(F.col("text")).alias("canon")).withColumn("hash", hash_of(F.col("canon"))).join(again, "hash", "left_semi")
        twice = materialize(hashed.select("doc_id", "mark", "next_id", "next_mark", F.col("edit").alias("hash")).join(again, "hash", "left_semi").distinct(), "edited-again")
        ends = twice.select("doc_id", "mark").union(twice.select("next_id", "next_mark")).distinct().select(F.col("doc_id").alias("want"), F.col("mark").alias("want_mark"))
        texts = docs.withColumn("mark", _mark("doc_id", "text")).join(_small(ends, 2 * twice.count()), F.col("doc_id").eqNullSafe(F.col("want")) & (F.col("mark") == F.col("want_mark")), "left_semi")
        texts = texts.select("doc_id", "mark", "text").distinct()  # rows that are equal are one from here on
        one, two = texts.select(F.col("doc_id").alias("d1"), F.col("mark").alias("m1"), F.col("text").alias("t1")), texts.select(F.col("doc_id").alias("d2"), F.col("mark").alias("m2"), F.col("text").alias("t2"))
        new = (
            twice.join(one, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("mark") == F.col("m1"))).join(two, F.col("next_id").eqNullSafe(F.col("d2")) & (F.col("next_mark") == F.col("m2")))
            .select("hash", canonical(edited(F.col("t1"), F.col("t2"))).alias("canon"))
            .where(hash_of(F.col("canon")) == F.col("hash"))
        )
        odd = scope.keep(materialize(split_buckets(own.select("hash", "canon").union(new.select("hash", "canon"))), "mixed"))
    if odd.isEmpty():
        told = hashed.select("doc_id", "n_chars", "edited_sha256", *[_hex(F.col(c)).alias(c) for c in ("own", "edit", "near")])
    else:  # different texts with one hash: each side is told apart by its bytes
        told = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("new", "UTF-8"), 256).alias("edited_sha256"), *[canonical(F.col(t)).alias(c) for c, t in (("own", "text"), ("edit", "new"), ("near", "next.text"))])
        for c in ("own", "edit", "near"):
            side = odd.select(F.col("hash").alias("h"), F.col("canon").alias(f"{c}_text"), "ordinal")
            told = told.withColumn(f"{c}_hash", hash_of(F.col(c))).join(side, (F.col(f"{c}_hash") == F.col("h")) & (F.col(c) == F.col(f"{c}_text")), "left")
            told = told.withColumn(c, F.concat_ws("-", _hex(F.col(f"{c}_hash")), F.col("ordinal"))).drop("h", "ordinal", f"{c}_text", f"{c}_hash")
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return told.select(
        "doc_id", "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("edit").alias("edited_fingerprint"),
        same("own", "edit").alias("near_edited"), same("own", "near").alias("near_next"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
