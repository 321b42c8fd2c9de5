"""Ranked lexical search: WAND over shards of documents, whose best rows are then merged.

Texts are cut into terms once: every document becomes its number of terms and, of the terms that some item asks for,
which occur and how often; a written table that statistics and search both read. A shard is a run of its rows, and
holds for every term its documents in ascending id with the impact of each, and the greatest impact. Per item the
cursors of its terms stand in order of their document; the pivot is the first document at which the greatest impacts
so far reach the threshold, the score of the worst of the best rows kept, and all cursors before it jump to it.
Before a shard is walked the threshold is raised to the score that enough of its documents are known to reach, found
by scoring those of the rarest terms. Shards' best rows are merged twice, by item and a share of the shards, then by item.

What is broadcast is bounded: items are searched in blocks of at most ``MOST_PAIRS`` (item, term) pairs, each with a
pass of its own over the documents (an item alone may hold more: all its different terms).

Scores are whole numbers: see ``weight`` and ``impacts``. Defined results: null and empty texts have no terms; items
without terms have no rows; rows of one item id (also null) are one item with all their terms; a term counts once an
item; equal scores go by ascending id, null last; repeated documents are ranked each; empty tables give no rows; other
columns are not read.
"""

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scope, byte_tokens, lean, lean_rows, materialize, table
from .linear import slices

MOST_PAIRS = 1_000_000
SHARD_POSTINGS = 4_000_000
SEEDS = 512
FAN = 256
_END = 1 << 62
#: What each byte of a text counts as: ASCII letters lower-cased, digits and non-ASCII bytes as they are, all else white space.
FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """50 plus 50 times a document's length over the mean one, rounded down."""
    if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 50 + (50 * n * n_docs) // n_terms


def distinct_terms(texts: pa.Array) -> pa.Array:
    out = []
    for part in slices(pc.fill_null(texts, "")):
        owner, tokens = byte_tokens(part, FOLD)
        words, code = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False)
        key = np.unique(owner * max(1, len(words)) + code)
        ends = np.searchsorted(key // max(1, len(words)), np.arange(len(part) + 1)).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(key % max(1, len(words))))))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term), each pair once."""
    each = F.arrow_udf(lean(distinct_terms), "array<string>")(F.col(text_col).cast("string"))
    return items.select(F.col(id_col).alias("item"), F.explode(each).alias("term")).distinct()


def term_counts(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, terms, counts) of each document that has terms: how many, and of ``vocabulary`` which (by number) and how often."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            ids, texts = batch.column("doc"), pc.fill_null(batch.column("text"), "")
            start = 0
            for part in slices(texts):
                owner, tokens = byte_tokens(part, FOLD)
                n = np.bincount(owner, minlength=len(part)).astype(np.int64)
                number = pc.fill_null(pc.index_in(tokens.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = number[tokens.indices.to_numpy(zero_copy_only=False)]
                key, times = np.unique((owner * (len(known) + 1) + term)[term >= 0], return_counts=True)
                some = np.flatnonzero(n)
                row, term = key // (len(known) + 1), key % (len(known) + 1)
                ends = pa.array(np.append(np.searchsorted(row, some), len(row)).astype(np.int32))
                yield pa.record_batch(
                    [ids.slice(start, len(part)).take(pa.array(some)), pa.array(n[some]), pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(times))],
                    names=["doc", "n", "terms", "counts"],
                )
                start += len(part)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean_rows(count), f"doc {kind}, n bigint, terms array<int>, counts array<bigint>")


class Shard:
    """Postings of some documents: by term the documents' places in ascending id, and their impacts."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int):
        rows = pa.Table.from_batches(batches).combine_chunks()
        rows = rows.take(pc.sort_indices(rows["doc"], null_placement="at_end"))
        self.ids = rows["doc"].to_pylist()
        lists, counts = (rows[c].combine_chunks() for c in ("terms", "counts"))
        lists, counts = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lists, counts))
        each = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        m = length_factor(rows["n"].to_numpy(), n_docs, n_terms)
        term, doc = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(each)), each)
        impact = impacts(weights[term], counts.flatten().to_numpy(zero_copy_only=False), m[doc])
        order = np.argsort(term, kind="stable")
        self.docs, self.impact, term = doc[order], impact[order], term[order]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(term))
        self.span = {int(t): (int(a), int(b)) for t, a, b in zip(term[first], first, last, strict=True)} if len(term) else {}
        self.most = {t: int(self.impact[a:b].max()) for t, (a, b) in self.span.items()}

    def seed(self, spans: list[tuple[int, int]], k: int) -> int:
        """A score that at least ``k`` documents of the shard reach, 0 if too few were scored."""
        found, held = [], 0
        for a, b in sorted(spans, key=lambda s: s[1] - s[0]):
            found.append(self.docs[a : min(b, a + SEEDS)])
            held += len(found[-1])
            if held >= 4 * k:
                break
        docs = np.unique(np.concatenate(found))
        if len(docs) < k:
            return 0
        score = np.zeros(len(docs), np.int64)
        for a, b in spans:
            at = a + np.searchsorted(self.docs[a:b], docs)
            at[at == b] = a
            score += np.where(self.docs[at] == docs, self.impact[at], 0)
        return int(np.partition(score, len(score) - k)[len(score) - k])

    def search(self, terms: list[int], best: list[tuple[int, int]], k: int) -> None:
        """Put what belongs to the ``k`` best rows into heap ``best`` of (score, minus id), the worst first."""
        terms = [t for t in terms if t in self.span]
        if not terms:
            return
        spans = [self.span[t] for t in terms]
        most, ends = [self.most[t] for t in terms], [b for _, b in spans]
        floor = self.seed(spans, k)  # from here on only documents that may reach it count
        threshold = max(floor, best[0][0] if len(best) >= k else 1)
        docs, impact = memoryview(self.docs), memoryview(self.impact)
        at = [a for a, _ in spans]
        cursors = sorted((docs[a], j) for j, a in enumerate(at))
        while cursors:
            reach = 0
            for pivot, j in cursors:
                reach += most[j]
                if reach >= threshold:
                    break
            else:
                return
            if cursors[0][0] == pivot:
                score, n = 0, 0
                for doc, j in cursors:
                    if doc != pivot:
                        break
                    score += impact[at[j]]
                    n += 1
                    at[j] += 1
                if score >= threshold:
                    row = (score, _key(self.ids[pivot]))
                    if len(best) < k:
                        heapq.heappush(best, row)
                    elif row > best[0]:
                        heapq.heapreplace(best, row)
                    if len(best) >= k:
                        threshold = max(floor, best[0][0])
            else:
                n = 0
                for doc, j in cursors:
                    if doc >= pivot:
                        break
                    at[j] = bisect_left(docs, pivot, at[j], ends[j])
                    n += 1
            moved = [(docs[at[j]], j) for _, j in cursors[:n] if at[j] < ends[j]]
            cursors[:n] = moved
            cursors.sort()


def _key(doc):
    """Greater for the id that goes first among equal scores; null goes last."""
    return -_END * 4 if doc is None else -doc


def _shard_best(sent, k: int):
    def run(batches):
        weights, items, n_docs, n_terms = sent.value
        best: list[list] = [[] for _ in items]
        held, size = [], 0

        def walk():
            shard = Shard(held, weights, n_docs, n_terms)
            for heap, terms in zip(best, items, strict=True):
                shard.search(terms, heap, k)

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= SHARD_POSTINGS:
                walk()
                held, size = [], 0
        if held:
            walk()
        rows = [(i, None if key == -_END * 4 else -key, score) for i, heap in enumerate(best) for score, key in heap]
        if rows:
            number = TaskContext.get().partitionId()
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.record_batch([*columns, pa.array(np.full(len(rows), number, np.int32))], names=["number", "doc", "score", "shard"])

    return run


def _blocks(pairs: DataFrame, most: int):
    """Lists of (item, term) of whole items, at most ``most`` pairs each where no item alone has more."""
    n = -(-pairs.count() // most)
    while n:
        where = F.pmod(F.xxhash64("item"), F.lit(n))
        sizes = pairs.groupBy(where.alias("block")).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(F.struct("item")).alias("items"))
        if sizes.where((F.col("pairs") > most) & (F.col("items") > 1)).isEmpty():
            for k in range(n):
                yield pairs.where(where == k).collect()
            return
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most: int = MOST_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark = docs.sparkSession
    found = []
    with Scope(spark) as scope:
        pairs = materialize(item_terms(items, item_col, text_col), "item-terms")
        for block in _blocks(pairs, most):
            vocabulary = sorted({r["term"] for r in block})
            number = {t: j for j, t in enumerate(vocabulary)}
            asked: dict = {}
            for r in block:
                asked.setdefault(r["item"], []).append(number[r["term"]])
            counted = materialize(term_counts(docs, vocabulary, id_col, text_col), "term-counts")
            totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
            df = np.zeros(len(vocabulary), np.int64)
            for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
                df[r["t"]] = r["count"]
            weights = np.array([weight(totals["docs"], int(x)) for x in df], np.int64)
            sent = spark.sparkContext.broadcast((weights, list(asked.values()), totals["docs"], totals["terms"]))
            rows = counted.mapInArrow(lean_rows(_shard_best(sent, k)), "number bigint, doc bigint, score bigint, shard int")
            for part in (["number", F.pmod("shard", F.lit(FAN))], ["number"]):
                nth = Window.partitionBy(*part).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
                rows = rows.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k)
            names = spark.createDataFrame(list(enumerate(asked)), "number bigint, item " + items.schema[item_col].dataType.simpleString())
            found.append(scope.keep(materialize(rows.join(F.broadcast(names), "number").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score"), "ranked")))
    if not found:
        return spark.createDataFrame([], f"{item_col} {items.schema[item_col].dataType.simpleString()}, rank int, {id_col} bigint, score bigint")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
