"""Quality by co-training: a text view and a metadata view teach each other.

The text view weighs the share of words and of token shapes; the metadata view weighs source, language and size. In
each round both are fitted on the labelled rows and on pseudo-labels from the other view, and each is calibrated on
held-out labelled rows. Between rounds every document is scored on the executors, and *all* unlabelled ones that the
other view is confident about teach: their features are added up by cell (lent label, stratum of metadata and a quarter
of the ids) and slot, and a cell's mean joins the labelled rows of the next fit. Cells and slots are bounded, so the
driver gets the same amount from any number of documents; a source or wording without labels is learnt wherever it is.
Text slots are screened on labelled and pseudo-labelled rows together. At the end the calibrated log-odds are added
(less the prior, which both hold) and every document is scored on its whole text.

The fit uses at most ``MOST_LABELLED`` labelled rows, those whose ids hash lowest; other rows are unlabelled to it. Cells
weigh as the root of their rows, together ``PSEUDO_WEIGHT`` times as much as the labelled rows (or as their own rows, if
those are fewer), so a fit is the same for a corpus and for one that holds each of its rows many times.

Defined results: null and empty texts and null metadata are values like any other; null labels are not used for
fitting, rows without an id only as unlabelled ones; an id labelled twice counts once, good if any row says so; of
labelled rows that share an id one is fitted on; with labels of one kind only every document gets the prior; repeated
rows score alike and teach each for itself; an empty table gives no rows; extra columns pass through, but a column named
like the output is replaced by it.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, lean, lean_rows, materialize, release, sigmoid
from .linear import BITS, LEAST_DF, LEAST_Z, Ordinal, View, calibrated, collected_features, fit_ordinal, one_row_an_id, slices, smallest_by_hash

MOST_LABELLED = 20_000
ROUNDS = 3
CONFIDENT = 0.97
PSEUDO_WEIGHT = 0.3
META_SLOTS = 1 << 12
#: Strata of (source, language) for the text view and of (source, language, size) for the metadata view; each is cut in
#: QUARTERS by id, so that a slot that fewer than three rows have is in fewer than three cells.
TEXT_STRATA, META_STRATA, QUARTERS = 32, 256, 4
UNIT = 1 << 24  # values are added up as whole numbers of 1 / UNIT: sums do not depend on their order
TEXT = View(words=True, shapes=True, share=True)


def meta_features(source, lang, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = []
    for s, g, n in zip(source, lang, n_chars, strict=True):
        size = -1 if n is None or n != n else int(2 * np.log2(1 + max(float(n), 0.0)))
        names.extend((f"source={s}", f"lang={g}", f"size={size}"))
    slots = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % META_SLOTS for x in names], np.int64)
    return np.arange(len(names)) // 3, slots, np.ones(len(names))


@dataclass
class CoTrained:
    text: Ordinal
    meta: Ordinal
    text_fit: tuple[float, float]
    meta_fit: tuple[float, float]
    prior: float

    def combine(self, text_score: np.ndarray, meta_score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the text view, the metadata view and both."""
        t = self.text_fit[0] * text_score + self.text_fit[1]
        m = self.meta_fit[0] * meta_score + self.meta_fit[1]
        return sigmoid(t), sigmoid(m), sigmoid(t + m - self.prior)


def _taken(x, keep: np.ndarray):
    """The rows of a sparse (row, slot, value) that ``keep`` has, renumbered."""
    rows, slots, values = x
    new = np.cumsum(keep) - 1
    on = keep[rows]
    return new[rows[on]], slots[on], values[on]


def lent(p):
    """The pseudo-labels of confident probabilities: 1 good, 0 bad, -1 none."""
    return np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, -1))


def fit_views(label: np.ndarray, lent_text: np.ndarray, lent_meta: np.ndarray, text, meta, weight: np.ndarray | None = None) -> CoTrained:
    """label: 1 good, 0 bad, -1 unlabelled; lent_text, lent_meta: what each view got from the other; text, meta: sparse
    features of the same rows; weight: theirs, PSEUDO_WEIGHT for unlabelled ones if not given."""
    n = len(label)
    known = label >= 0
    weight = np.where(known, 1.0, PSEUDO_WEIGHT) if weight is None else weight
    held = known & (np.arange(n) % 4 == 0)
    good, all_known = float((label == 1).sum()), float(known.sum())
    prior = float(np.log((good + 1) / (all_known - good + 1)))
    models, fits = [], []
    for x, got, size in ((text, lent_text, 1 << 18), (meta, lent_meta, META_SLOTS)):
        y = np.where(known, label, got)
        rows = (y >= 0) & ~held
        r, s, v = _taken(x, rows)
        m = fit_ordinal(r, s, v, y[rows], 2, weight[rows], size=size)
        scores, cut = m.scores(*x, n), float(m.thresholds[0])
        a, b = calibrated((scores - cut)[held], label[held])
        models.append(m)
        fits.append((a, b - a * cut))
    if len(set(label[known].tolist())) < 2:
        fits = [(0.0, prior), (0.0, prior)]
    return CoTrained(models[0], models[1], fits[0], fits[1], prior)


@dataclass
class Lesson:
    """What the confident unlabelled rows of a corpus add up to: by view (lent label, rows, sparse sums) of its cells, and
    (rows, rows lent 1) with n, x, xx and xy of every text slot."""

    text: tuple
    meta: tuple
    shares: tuple[float, float]
    sums: np.ndarray


def _cells(stratum: np.ndarray, part: np.ndarray, strata: int) -> np.ndarray:
    """Even numbers of cells, for rows lent 0; those lent 1 are in the odd one behind."""
    mixed = (stratum.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(strata)
    return (mixed.astype(np.int64) * QUARTERS + part) * 2


_SUMS = pa.schema([("kind", pa.int32()), ("cell", pa.int32()), ("slot", pa.int32()), ("x", pa.int64())])


def _sums(kind: int, cell: np.ndarray, slot: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Whole-number sums of ``x`` by cell and slot (-1: the cell's rows)."""
    keys, at = np.unique(cell << (BITS + 1) | (slot + 1), return_inverse=True)
    total = np.bincount(at, x, minlength=len(keys)).astype(np.int64)
    return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array((keys >> (BITS + 1)).astype(np.int32)), pa.array(((keys & ((1 << (BITS + 1)) - 1)) - 1).astype(np.int32)), pa.array(total)], schema=_SUMS)


def _moments(total: np.ndarray, rows: np.ndarray, slots: np.ndarray, values: np.ndarray, y: np.ndarray) -> None:
    """Adds n, x, xx and xy of the slots to ``total``, in units."""
    for k, x in enumerate((np.ones(len(values)), np.rint(values * UNIT), np.rint(values**2 * UNIT), np.rint(values * UNIT) * y[rows])):
        total[k] += np.bincount(slots, x, minlength=1 << BITS).astype(np.int64)


def _slot_batches(total: np.ndarray):
    for k in range(4):
        on = np.flatnonzero(total[k])
        yield _sums(2, np.full(len(on), k), on, total[k, on])


def _labelled_sums(told: DataFrame) -> np.ndarray:
    """n, x, xx and xy of every text slot over the labelled rows."""

    def sums(batches):
        total = np.zeros((4, 1 << BITS), np.int64)
        for batch in batches:
            y, start = batch.column("label").to_numpy(zero_copy_only=False), 0
            for part in slices(batch.column("text")):
                _moments(total, *TEXT.features(part), y[start:])
                start += len(part)
        yield from _slot_batches(total)

    return _added_up(told.select("text", "label").mapInArrow(lean_rows(sums), _SUMS_DDL)).sums


_SUMS_DDL = "kind int, cell int, slot int, x bigint"


def _added_up(parts: DataFrame) -> Lesson:
    """The bounded sums on the driver: 4 * 2**BITS of slots, and those of the cells' wanted slots."""
    got = parts.groupBy("kind", "cell", "slot").agg(F.sum("x").alias("x")).orderBy("kind", "cell", "slot").toArrow()
    kind, cell, slot, x = (got.column(c).to_numpy() for c in ("kind", "cell", "slot", "x"))
    sums = np.zeros((4, 1 << BITS))
    on = kind == 2
    sums[cell[on], slot[on]] = x[on]
    sums[1:] /= UNIT
    views = []
    for k in (0, 1):
        heads = (kind == k) & (slot < 0)
        cells, n = cell[heads].astype(np.int64), x[heads].astype(float)
        body = (kind == k) & (slot >= 0)
        at = np.searchsorted(cells, cell[body])
        views.append((cells % 2, n, (at, slot[body].astype(np.int64), x[body] / UNIT / n[at] if len(at) else np.zeros(0))))
    y, n, _ = views[0]
    return Lesson(*views, (float(n.sum()), float(n[y == 1].sum())), sums)


def lessons(docs: DataFrame, model: CoTrained, wanted: np.ndarray, told: np.ndarray) -> Lesson:
    """One pass over all ``docs`` (doc_id, text, source, lang, n_chars): both views score each row, and all rows that are
    not ``told`` (the ids fitted on) teach the view that the other one is confident for."""
    sent = docs.sparkSession.sparkContext.broadcast((model, np.flatnonzero(wanted), np.sort(told)))

    def sums(batches):
        m, slots_wanted, told = sent.value
        wanted = np.zeros(1 << BITS, bool)
        wanted[slots_wanted] = True
        total = np.zeros((4, 1 << BITS), np.int64)
        for batch in batches:
            source, lang, n_chars = (batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))
            n, start = batch.num_rows, 0
            _, meta, ones = meta_features(source, lang, n_chars)
            z = m.meta.scores(np.arange(3 * n) // 3, meta, ones, n)
            meta, part = meta.reshape(-1, 3), batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
            new = ~np.isin(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), told) | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            by_text = _cells(meta[:, 0] * META_SLOTS + meta[:, 1], part, TEXT_STRATA)
            by_meta = _cells((meta[:, 0] * META_SLOTS + meta[:, 1]) * META_SLOTS + meta[:, 2], part, META_STRATA)
            for texts in slices(batch.column("text")):
                k, here = len(texts), slice(start, start + len(texts))
                rows, slots, values = TEXT.features(texts)
                p_text, p_meta, _ = m.combine(m.text.scores(rows, slots, values, k), z[here])
                lent_text, lent_meta = (np.where(new[here], lent(p), -1) for p in (p_meta, p_text))
                on = lent_text[rows] >= 0
                rows, slots, values = rows[on], slots[on], values[on]
                _moments(total, rows, slots, values, lent_text)
                cell, taught = by_text[here] + np.maximum(lent_text, 0), lent_text >= 0
                yield _sums(0, cell[taught], np.full(int(taught.sum()), -1), np.ones(int(taught.sum())))
                on = wanted[slots]
                yield _sums(0, cell[rows[on]], slots[on], np.rint(values[on] * UNIT))
                cell, taught = by_meta[here] + np.maximum(lent_meta, 0), lent_meta >= 0
                yield _sums(1, cell[taught], np.full(int(taught.sum()), -1), np.ones(int(taught.sum())))
                yield _sums(1, np.repeat(cell[taught], 3), meta[here][taught].reshape(-1), np.full(3 * int(taught.sum()), float(UNIT)))
                start += k
        yield from _slot_batches(total)

    part = F.pmod(F.xxhash64("doc_id"), F.lit(QUARTERS)).alias("part")
    return _added_up(docs.select("doc_id", "text", "source", "lang", "n_chars", part).mapInArrow(lean_rows(sums), _SUMS_DDL))


def _screened(n: int, good: int, sums: np.ndarray, lesson: Lesson | None) -> np.ndarray:
    """Text slots that go with the label by at least LEAST_Z standard deviations. The unlabelled rows count as many rows as
    there are labelled ones, or as they are, if fewer."""
    if lesson is not None and lesson.shares[0]:
        f = min(1.0, n / lesson.shares[0])
        n, good, sums = n + f * lesson.shares[0], good + f * lesson.shares[1], sums + f * lesson.sums
    if not n or good in (0, n):
        return np.zeros(1 << BITS, bool)
    share = good / n
    df, x, xx, xy = sums
    z = (xy - x * share) / np.sqrt(np.maximum(xx - x * x / n, 1e-12) * share * (1 - share))
    return (df >= LEAST_DF) & (np.abs(z) >= LEAST_Z)


def _fitted(told: DataFrame, wanted: np.ndarray, lesson: Lesson | None) -> tuple[CoTrained, np.ndarray]:
    """The views fitted on ``told`` (doc_id, text, source, lang, n_chars, label; a bounded number of rows) and the means of
    the lesson's cells; and the ids fitted on."""
    rows, at, slots, values = collected_features(told, TEXT, wanted)
    ids = rows["doc_id"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    order = pd.util.hash_array(ids).argsort(kind="stable") if len(rows) else ids
    n = len(rows)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    rows = rows.iloc[order]
    meta = meta_features(rows["source"], rows["lang"], rows["n_chars"].astype(object).where(rows["n_chars"].notna(), None))
    label, text = rows["label"].to_numpy(np.int64), (place[at], slots, values)
    weight, lent_text, lent_meta = np.ones(n), np.full(n, -1), np.full(n, -1)
    for view in (lesson.text, lesson.meta) if lesson is not None else ():
        y, count, (r, s, v) = view
        mine = view is lesson.text
        share = np.sqrt(count) * (PSEUDO_WEIGHT * min(n, count.sum()) / max(np.sqrt(count).sum(), 1.0))
        none, below = np.full(len(y), -1), len(label)
        label, weight = np.append(label, none), np.append(weight, share)
        lent_text, lent_meta = np.append(lent_text, y if mine else none), np.append(lent_meta, none if mine else y)
        if mine:
            text = tuple(np.append(a, b) for a, b in zip(text, (r + below, s, v), strict=True))
        else:
            meta = tuple(np.append(a, b) for a, b in zip(meta, (r + below, s, v), strict=True))
    return fit_views(label, lent_text, lent_meta, text, meta, weight), ids


def fit(docs: DataFrame, labels: DataFrame, labelled: int = MOST_LABELLED, rounds: int = ROUNDS) -> CoTrained:
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    with Scope(docs.sparkSession):
        known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
        sample = F.broadcast(smallest_by_hash(known, labelled))  # a bounded sample is sent
        told = materialize(one_row_an_id(wide.join(sample, "doc_id")), "labelled")
        n, good = told.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        sums, lesson = _labelled_sums(told), None
        for last in range(rounds - 1, -1, -1):
            wanted = _screened(n, good, sums, lesson)
            model, ids = _fitted(told, wanted, lesson)
            release()  # the features of a fit leave the driver before the next
            if not last or model.text_fit[0] == model.meta_fit[0] == 0.0:
                break  # the last round; or labels of one kind, or none: there is nothing to teach
            lesson = lessons(wide, model, wanted, ids)
    return model


RESULT = "struct<p_text:double,p_meta:double,score:double>"
_RESULT = pa.struct([("p_text", pa.float64()), ("p_meta", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, model: CoTrained, out: str = "quality_score") -> DataFrame:
    """``docs`` (text, source, lang, n_chars) with struct ``out``."""
    used = np.flatnonzero(model.text.weights)
    light = CoTrained(Ordinal(np.zeros(0), model.text.thresholds), model.meta, model.text_fit, model.meta_fit, model.prior)
    sent = docs.sparkSession.sparkContext.broadcast((used, model.text.weights[used], light))

    def scored(texts: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        used, weights, m = sent.value
        full = np.zeros(1 << 18)
        full[used] = weights
        text = Ordinal(full, m.text.thresholds)
        t = np.concatenate([text.scores(*TEXT.features(part, full != 0), len(part)) for part in slices(texts)] or [np.zeros(0)])
        z = m.meta.scores(*meta_features(source.to_pylist(), lang.to_pylist(), n_chars.to_pylist()), len(texts)) if len(texts) else np.zeros(0)
        return pa.array([dict(zip(("p_text", "p_meta", "score"), x, strict=True)) for x in zip(*(y.tolist() for y in m.combine(t, z)), strict=True)], _RESULT)

    columns = [F.col(c).cast(k) for c, k in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return docs.withColumn(out, F.arrow_udf(lean(scored), RESULT)(*columns))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), out="q")
    return scored.select("doc_id", *[F.round(f"q.{c}", 6).alias(c) for c in ("p_text", "p_meta", "score")], (F.col("q.score") >= 0.5).alias("keep"))
