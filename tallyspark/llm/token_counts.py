"""Exact histogram of encoded lengths: every context limit is answered from suffix sums, with no second pass.

``length_histogram`` counts documents by encoded length and is written once, so texts are encoded once;
``limit_table`` adds, for each length taken as a context limit, the documents longer than that, the documents and
tokens up to it, and the tokens left after truncation; ``answers`` and ``quantiles`` read the table for any limit and
any share of the documents, also for limits that no document has as its length.

Defined results: null and empty texts have length 0 and count as documents; repeated rows count each; an empty table
gives no rows; other columns are not read.
"""

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, materialize

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 64


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("tallyspark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """``docs`` with the encoded length of each whole text in column ``out``."""

    def length(text: pa.Array) -> pa.Array:
        count = encoding(vocabulary).encode_ordinary
        return pa.array([len(count(t)) if t else 0 for t in text.to_pylist()], pa.int64())

    return docs.withColumn(out, F.arrow_udf(lean(length), "long")(F.col(text_col).cast("string")))


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs), one row per length that occurs; a table of its own, so what reads it encodes nothing again."""
    only = docs.select(F.col(text_col).cast("string").alias("text"))
    return materialize(encoded_lengths(only, "text", vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")


def limit_table(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, what a context limit of that many tokens would hold.

    docs_longer, tokens_longer: suffix sums beyond the limit; docs_within, tokens_within: up to it; tokens_kept: the
    total after cutting every document at the limit; quantile: the share of documents within. Suffix sums go by blocks
    of lengths and then within a block, so no task sees more than one block's rows or one row per block.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    ahead = Window.partitionBy("whole").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).withColumn("whole", F.lit(0))
    all_of = Window.partitionBy("whole")
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(
        "block", zero(F.sum("d").over(ahead)).alias("docs_after"), zero(F.sum("t").over(ahead)).alias("tokens_after"),
        F.sum("d").over(all_of).alias("all_docs"), F.sum("t").over(all_of).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = h.join(blocks, "block")
    x = x.withColumn("docs_longer", zero(F.sum("n_docs").over(inside)) + F.col("docs_after"))
    x = x.withColumn("tokens_longer", zero(F.sum("tokens").over(inside)) + F.col("tokens_after"))
    within = F.col("all_docs") - F.col("docs_longer")
    kept = F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return x.select(
        "n_tokens", "n_docs", within.alias("docs_within"), "docs_longer", (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_within"), "tokens_longer",
        kept.alias("tokens_kept"), F.round(within / F.col("all_docs"), 9).alias("quantile"),
    )


def answers(table: DataFrame, limits: list[int]) -> DataFrame:
    """For each of ``limits`` (any whole numbers): documents and tokens within and beyond it, and the tokens kept after
    cutting every document at it, from the rows of ``limit_table``. A table of no rows answers with zeros."""
    asked = table.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long").distinct()
    # per limit the greatest length within it and the least beyond it: partial aggregates, so nothing is gathered
    each = F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))])
    ends = table.withColumn("context_limit", F.explode(each)).groupBy("context_limit").agg(
        F.max(F.when(F.col("n_tokens") <= F.col("context_limit"), F.struct("n_tokens", "docs_within", "docs_longer", "tokens_within", "tokens_longer"))).alias("low"),
        F.min(F.when(F.col("n_tokens") > F.col("context_limit"), F.struct("n_tokens", "n_docs", "docs_longer", "tokens_longer"))).alias("high"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = asked.join(F.broadcast(ends), "context_limit", "left")
    longer = F.coalesce(F.col("low.docs_longer"), F.col("high.n_docs") + F.col("high.docs_longer"), F.lit(0))
    beyond = F.coalesce(F.col("low.tokens_longer"), F.col("high.n_tokens") * F.col("high.n_docs") + F.col("high.tokens_longer"), F.lit(0))
    within = zero(F.col("low.tokens_within"))
    return found.select(
        "context_limit", zero(F.col("low.docs_within")).alias("docs_within"), longer.alias("docs_longer"), within.alias("tokens_within"), beyond.alias("tokens_longer"),
        (within + F.greatest(F.col("context_limit"), F.lit(0)) * longer).alias("tokens_kept"),
    )


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """For each of ``shares`` (0 to 1) the least length that at least this share of the documents keeps within; null
    for a table of no rows."""
    asked = table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double").distinct()
    enough = F.col("docs_within") >= F.col("share") * (F.col("docs_within") + F.col("docs_longer"))
    each = F.array(*[F.lit(float(x)) for x in sorted(set(shares))])
    found = table.withColumn("share", F.explode(each)).where(enough).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
    return asked.join(F.broadcast(found), "share", "left")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return limit_table(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
