"""Severity of toxicity by cumulative-link ordinal regression on sparse words.

Labels say toxic or not; the grade of a toxic row comes from the same labelled sample: the words that occur far more
often in its toxic rows are counted in each toxic row, and the counts' terciles are grades 1 to 3 (0: not toxic). One
weight vector is shared by the three thresholds. Words are screened by how their counts go with the label. A document counts as
toxic from the score on that parts the sample best, a clean row above it weighing as FALSE_ALARM toxic ones. The fit
uses at most ``MOST_LABELLED`` labelled rows, those whose ids
hash lowest; every document is scored on its whole text.

Defined results: null and empty texts score by the thresholds alone; null labels or ids are not used for fitting; an
id labelled twice counts once, toxic if any row says so; of rows that share an id one is fitted on; with no toxic label
every document gets the prior; repeated rows score alike; an empty table gives no rows; extra columns pass through, but
a column named like the output is replaced by it.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, lean, materialize
from .linear import Ordinal, View, collected_features, fit_ordinal, one_row_an_id, screened, slices, smallest_by_hash

MOST_LABELLED = 40_000
GRADES = 4
MARKED_ODDS, MARKED_ROWS = 8.0, 5
FALSE_ALARM = 5.0
VIEW = View(words=True)


def grades_of(toxic: np.ndarray, rows: np.ndarray, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """0 for clean rows, 1 to 3 for toxic ones by terciles of how many marked words they hold."""
    size = int(slots.max()) + 1 if len(slots) else 1
    bad = toxic.astype(bool)
    in_bad = np.bincount(slots, bad[rows], minlength=size)
    in_good = np.bincount(slots, ~bad[rows], minlength=size)
    n_bad, n_good = max(bad.sum(), 1), max((~bad).sum(), 1)
    marked = (in_bad >= MARKED_ROWS) & ((in_bad + 0.5) / n_bad >= MARKED_ODDS * (in_good + 0.5) / n_good)
    hits = np.bincount(rows, np.expm1(values) * marked[slots], minlength=len(toxic)) if len(rows) else np.zeros(len(toxic))
    grade = np.zeros(len(toxic), np.int64)
    if bad.any():
        low, high = np.quantile(hits[bad], [1 / 3, 2 / 3])
        grade[bad] = 1 + (hits[bad] > low) + (hits[bad] > high)
    return grade


@dataclass
class Severity:
    """The ordinal model, and the score from which on a document counts as toxic."""

    model: Ordinal
    cut: float


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The score that parts toxic rows from clean ones best, a clean row above it weighing as FALSE_ALARM toxic ones."""
    if not toxic.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, gain = scores[order], np.cumsum(np.where(toxic[order], 1.0, -FALSE_ALARM))
    last = np.append(s[1:] != s[:-1], True)  # rows of one score stand on one side
    k = int(np.argmax(np.where(last, gain, -np.inf)))
    if gain[k] <= 0:
        return float("inf")
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Severity:
    with Scope(docs.sparkSession):
        known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        sample = smallest_by_hash(known, most)
        told = materialize(one_row_an_id(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")), "labelled")
        told, rows, slots, values = collected_features(told, VIEW, screened(told, VIEW, "toxic"))
        toxic = told["toxic"].to_numpy().astype(bool)
        model = fit_ordinal(rows, slots, values, grades_of(toxic, rows, slots, values), GRADES)
    return Severity(model, best_cut(model.scores(rows, slots, values, len(toxic)), toxic))


def severity(docs: DataFrame, fitted: Severity, text_col: str = "text", out: str = "severity") -> DataFrame:
    """``docs`` with struct ``out``: p (of at least grade 1, 2, 3), the expected grade and whether it is toxic."""
    kind = pa.struct([("p", pa.list_(pa.float64())), ("expected", pa.float64()), ("toxic", pa.bool_())])
    model, cut = fitted.model, fitted.cut
    used = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds, len(model.weights)))

    def score(texts: pa.Array) -> pa.Array:
        used, weights, thresholds, size = sent.value
        full = np.zeros(size)
        full[used] = weights
        m, found = Ordinal(full, thresholds), []
        for part in slices(texts):
            r, s, v = VIEW.features(part, full != 0)
            scores = m.scores(r, s, v, len(part))
            found.extend({"p": row, "expected": float(row.sum()), "toxic": bool(z >= cut)} for row, z in zip(m.at_least(scores), scores, strict=True))
        return pa.array(found, kind)

    return docs.withColumn(out, F.arrow_udf(lean(score), "struct<p:array<double>,expected:double,toxic:boolean>")(F.col(text_col).cast("string")))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = severity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), out="s")
    p = [F.round(F.element_at("s.p", k), 6) for k in (1, 2, 3)]
    return scored.select(
        "doc_id", p[0].alias("p_toxic"), p[1].alias("p_severe"), p[2].alias("p_extreme"), F.round("s.expected", 6).alias("expected_severity"), F.col("s.toxic").alias("toxic"),
    )
