"""Corpus preparation in five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs.

1. quality: documents that the co-trained classifier scores under 0.5 go.
2. near_dedup: one document of each group of near-duplicates (5-word shingles, similarity 0.8) stays, the one with the
   smallest id (null ids last; of several texts of one id the one whose hash is smallest; of equal rows one).
3. substring_dedup: runs of repeated clauses of at least 35 words stay in their earliest document only; a document's
   text and n_chars are what is left of it. Documents stay, even with an empty text.
4. decontamination: documents that hold a 10-word window of a benchmark item go.
5. sentencepiece: every text is encoded; rows are doc_id, n_tokens, the ids and whether they decode to the text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontamination, near_dedup, quality, sentencepiece_codec, substring_dedup
from tallyspark.llm.common import Scope, discard, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="__ts_quality").where("__ts_quality.score >= 0.5").drop("__ts_quality")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs, width=5, percent=80, marks=True)
    found = found.select(F.col("doc_id").alias("__ts_id"), F.col("text_mark").alias("__ts_mark"), "first", (F.col("n_shingles") > 0).alias("some"))
    found = materialize(found, "near-dedup-decisions")
    same = F.col("doc_id").eqNullSafe(F.col("__ts_id")) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col("__ts_mark"))
    left = docs.join(found.where("NOT first"), same, "left_anti")
    again = materialize(found.where("first AND some").groupBy("__ts_id", "__ts_mark").count().where("count > 1"), "repeated-rows")
    if again.isEmpty():
        return left
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same, "left_anti").union(once)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    edited = substring_dedup.remove_repeats(docs, text_out="text", spans_out="__ts_removed")
    n_chars = F.when(F.col("__ts_removed").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return edited.withColumn("n_chars", n_chars).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), out="__ts_found")
    return found.where("__ts_found.n_hit = 0").drop("__ts_found")


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = sentencepiece_codec.encode_and_decode(docs.select("doc_id", "text"), out="__ts_e")
    return both.select("doc_id", F.size("__ts_e.ids").cast("long").alias("n_tokens"), "__ts_e.ids", (F.col("__ts_e.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Stages 1, 2 and 5 (fitted models, similarity joins, tokenisation) are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Scope(spark) as scope:  # what a stage wrote on its way goes with its predecessor's table
            kept = scope.keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
