"""Sparse hashed text features and a cumulative-link (ordinal) model with L1 shrinkage, fitted with numpy.

Models are fitted on the driver from a bounded sample of labelled rows; with two grades the model is a logistic
regression. Scoring reads whole texts on the executors.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_rows, rows_per_slice, sigmoid

BITS = 18
SLICE_BYTES = 4 << 20
#: Bytes as shapes draw them, and as words fold them (32: no part of a word).
_DRAWN = np.array([97 if c >= 128 or chr(c).isalpha() else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
_FOLDED = np.array([c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PIECE = 1 << 20
_SAME = (1 << BITS) - 1
SETTLED = 2e-4  # a fit ends when a step moves no weight by this share of the largest


@lru_cache(maxsize=1)
def _powers(bits: int) -> np.ndarray:
    out = np.full(1 << bits, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _hashes(values: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the byte strings that start at ``first`` in ``values``, one after another."""
    if not len(first):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    with np.errstate(over="ignore"):
        h = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * _powers(max(12, int(place.max()).bit_length()))[place], first)
        h = (h ^ (h >> np.uint64(29)) ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _pieces(data: np.ndarray, ends: np.ndarray):
    """(from, to) of pieces of the bytes that part no token: they end behind white space or with a text."""
    at = 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        if to < len(data):
            stop = int(ends[np.searchsorted(ends, to)])
            blank = np.flatnonzero(_WHITE[data[to:stop]][: 1 << 16])
            if not len(blank):
                blank = np.flatnonzero(_WHITE[data[to:stop]])
            to = to + int(blank[0]) + 1 if len(blank) else stop
        yield at, to
        at = to


def _starts(token: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which bytes start a token: the first of each run of token bytes, where a text's first byte starts anew."""
    before = np.concatenate(([False], token[:-1]))
    return token & (~before | fresh)


def tokens_of(texts: pa.Array, words: bool, shapes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot) of every token and the number of tokens of each row; all bytes of a piece are worked on at once.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII bytes. The shape of what stands between
    white space has a for letters and non-ASCII bytes, 0 for digits and every other byte as it is, with runs folded; a
    token that repeats the one before it counts for a slot of its own as well."""
    texts, n = pc.fill_null(texts, ""), len(texts)
    count = np.zeros(n, np.int64)
    rows, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not n:
        return rows[0], slots[0], count
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    ends = offsets[1:] - offsets[0]
    by = {"words": np.zeros(n, np.int64), "shapes": np.zeros(n, np.int64)}
    last = (-1, np.uint64(0))  # owner and hash of the last token of the piece before
    for low, high in _pieces(data, ends):
        piece = data[low:high]
        fresh = np.zeros(len(piece), bool)
        begins = offsets[:-1] - offsets[0]
        begins = begins[np.searchsorted(begins, low) : np.searchsorted(begins, high)] - low
        fresh[begins] = True
        if words:
            folded = _FOLDED[piece]
            token = folded != 32
            start = _starts(token, fresh)
            owner = np.searchsorted(ends, low + np.flatnonzero(start), side="right")
            rows.append(owner)
            slots.append(_slots(_hashes(folded[token], np.flatnonzero(start[token]), 1)))
            by["words"] += np.bincount(owner, minlength=n)
        if shapes:
            token = ~_WHITE[piece]
            start = _starts(token, fresh)
            owner = np.searchsorted(ends, low + np.flatnonzero(start), side="right")
            start = start[token]
            raw, drawn = piece[token], _DRAWN[piece[token]]
            kept = start | (drawn != np.concatenate((drawn[:1], drawn[:-1])))
            rows.append(owner)
            slots.append(_slots(_hashes(drawn[kept], np.flatnonzero(start[kept]), 2)))
            by["shapes"] += np.bincount(owner, minlength=n)
            if len(owner):
                told = _hashes(raw, np.flatnonzero(start), 3)
                same = (told == np.concatenate(([last[1]], told[:-1]))) & (owner == np.concatenate(([last[0]], owner[:-1])))
                rows.append(owner[same])
                slots.append(np.full(int(same.sum()), _SAME))
                last = int(owner[-1]), told[-1]
    return np.concatenate(rows), np.concatenate(slots), np.maximum(by["words"], by["shapes"])


def counted(rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, n = np.unique((rows << BITS) | slots, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), n


@dataclass
class View:
    """How texts become features: which tokens, and whether counts or shares of tokens weigh."""

    words: bool = True
    shapes: bool = False
    share: bool = False

    def features(self, texts: pa.Array, wanted: np.ndarray | None = None):
        """Sparse (row, slot, value); with ``wanted`` only slots where it is true."""
        rows, slots, count = tokens_of(texts, self.words, self.shapes)
        if wanted is not None:
            keep = wanted[slots]
            rows, slots = rows[keep], slots[keep]
        rows, slots, n = counted(rows, slots)
        return rows, slots, np.sqrt(n / np.maximum(count[rows], 1)) if self.share else np.log1p(n)


@dataclass
class Ordinal:
    """P(grade >= k) = sigmoid(score - threshold_k), one weight vector for all thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows, slots, values, n: int) -> np.ndarray:
        return np.bincount(rows, values * self.weights[slots], minlength=n).astype(float) if len(rows) else np.zeros(n)

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def fit_ordinal(rows, slots, values, grades, n_grades: int, weight=None, size: int = 1 << BITS, shrink: float = 3.0, least_rows: int = 3) -> Ordinal:
    """The L1 fit picks the slots; a second fit on these alone, with little shrinkage, gives the weights."""
    rough = _fit(rows, slots, values, grades, n_grades, weight, size, 250, shrink, least_rows)
    on = rough.weights[slots] != 0 if len(slots) else np.zeros(0, bool)
    if not on.any():
        return rough
    return _fit(np.asarray(rows)[on], np.asarray(slots)[on], np.asarray(values)[on], grades, n_grades, weight, size, 250, 0.15 * shrink, least_rows)


def _fit(rows, slots, values, grades, n_grades, weight, size, steps, shrink, least_rows) -> Ordinal:
    """Proximal gradient steps, scaled by each feature's mean square, on the mean negative log-likelihood.

    shrink: L1 strength in standard deviations of a feature's gradient under no effect. Slots of fewer than
    ``least_rows`` rows get no weight. Grades that no row has keep a threshold beyond their neighbour.
    """
    grades = np.asarray(grades, np.int64)
    n, k = len(grades), n_grades - 1
    w = np.ones(n) if weight is None else np.asarray(weight, float)
    total = max(w.sum(), 1.0)
    above = np.array([(w * (grades >= j + 1)).sum() for j in range(k)])
    share = (above + 0.5 * np.arange(k, 0, -1) / (k + 1)) / (total + 1)
    theta = np.log((1 - share) / share)
    out = np.zeros(size)
    if n == 0 or len(rows) == 0 or grades.min() == grades.max():
        return Ordinal(out, theta)
    used, at, df = np.unique(slots, return_inverse=True, return_counts=True)
    keep = (df >= least_rows)[at]
    rows, at, values = rows[keep], at[keep], np.asarray(values)[keep]
    square = np.bincount(at, values**2 * w[rows], minlength=len(used)) / total
    rms = np.sqrt(np.maximum(square, 1e-12))
    p = above[0] / total
    penalty = shrink * np.sqrt(max(p * (1 - p), 1e-4) / total) * rms
    v, ahead, t = np.zeros(len(used)), np.zeros(len(used)), 1.0
    z_of = lambda x: np.bincount(rows, values * x[at], minlength=n)
    # Lipschitz bound of the scaled problem by power iteration
    x = np.random.default_rng(7).normal(size=len(used))
    for _ in range(12):
        y = np.bincount(at, values * (z_of(x / rms) * w)[rows], minlength=len(used)) / rms / total
        top = np.linalg.norm(y)
        x = y / max(top, 1e-12)
    step = 1.0 / max(0.3 * top, 1e-6)
    for _ in range(steps):
        s = z_of(ahead)
        reach = np.concatenate([np.ones((n, 1)), sigmoid(s[:, None] - theta[None, :]), np.zeros((n, 1))], axis=1)
        up, down = reach[np.arange(n), grades], reach[np.arange(n), grades + 1]
        chance = np.maximum(up - down, 1e-9)
        slope = (up * (1 - up) - down * (1 - down)) / chance * w / total  # of the log-likelihood by the score
        gradient = -np.bincount(at, values * slope[rows], minlength=len(used))
        new = ahead - step * gradient / square.clip(1e-12)
        cut = step * penalty / square.clip(1e-12)
        new = np.sign(new) * np.maximum(np.abs(new) - cut, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_next * (new - v)
        moved = np.abs(new - v).max() / max(1.0, np.abs(new).max())
        v, t = new, t_next
        was = theta.copy()
        for j in range(k):
            rise = (w * ((grades == j) * down * (1 - down) - (grades == j + 1) * up * (1 - up)) / chance).sum() / total
            theta[j] += 2.0 * rise
        theta = np.maximum.accumulate(theta + 1e-6 * np.arange(k))
        if max(moved, np.abs(theta - was).max()) < SETTLED:
            break
    out[used] = v
    return Ordinal(out, theta)


def calibrated(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None, steps: int = 100) -> tuple[float, float]:
    """(a, b) of sigmoid(a * score + b) by Newton steps with smoothed targets."""
    y = np.asarray(labels, float)
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    if len(y) == 0:
        return a, b
    for _ in range(steps):
        p = sigmoid(a * scores + b)
        g = np.array([((p - target) * scores).sum() + 1e-3 * (a - 1), (p - target).sum()])
        d = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(d * scores**2).sum() + 1e-3, (d * scores).sum()], [(d * scores).sum(), d.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def smallest_by_hash(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows whose ids hash lowest: the documented bound of a fit, the same rows at every run."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def slices(texts: pa.Array):
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for s in rows_per_slice(lengths, SLICE_BYTES):
        yield texts.slice(s.start, s.stop - s.start)


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """One row of each doc_id, that of the smallest text hash: what is fitted on stays bounded by the number of ids."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.xxhash64("text")).alias("r")).select("doc_id", *[F.col(f"r.{c}").alias(c) for c in rest])


LEAST_Z, LEAST_DF = 3.0, 5


def screened(rows: DataFrame, view: View, label: str) -> np.ndarray:
    """Slots whose value goes with ``label`` (null: not counted) by at least LEAST_Z standard deviations.

    Sums are made by partition and added up by slot; the driver gets the slots that pass, of 2**BITS at most.
    """
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("x", pa.float64()), ("xx", pa.float64()), ("xy", pa.float64())])

    def sums(batches):
        total = np.zeros((4, 1 << BITS))
        for batch in batches:
            y, start = batch.column("y").to_numpy(zero_copy_only=False).astype(float), 0
            for part in slices(batch.column("text")):
                r, s, v = view.features(part)
                for k, x in enumerate((np.ones(len(v)), v, v * v, v * y[start + r])):
                    total[k] += np.bincount(s, x, minlength=1 << BITS)
                start += len(part)
        on = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(on, pa.int32()), pa.array(total[0, on].astype(np.int64)), *(pa.array(total[k, on]) for k in (1, 2, 3))], schema=schema)

    known = rows.where(F.col(label).isNotNull())
    n, share = known.agg(F.count(F.lit(1)), F.avg(label)).first()
    wanted = np.zeros(1 << BITS, bool)
    if not n or share in (0.0, 1.0):
        return wanted
    parts = known.select(F.col("text").cast("string").alias("text"), F.col(label).cast("double").alias("y")).mapInArrow(lean_rows(sums), "slot int, n bigint, x double, xx double, xy double")
    total = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")])
    spread = F.sqrt(F.greatest(F.col("xx") - F.col("x") * F.col("x") / n, F.lit(1e-12)) * (share * (1 - share)))
    z = (F.col("xy") - F.col("x") * share) / spread
    got = total.where((F.col("n") >= LEAST_DF) & (F.abs(z) >= LEAST_Z)).select("slot").toArrow()
    wanted[got.column("slot").to_numpy()] = True
    return wanted


def collected_features(rows: DataFrame, view: View, wanted: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Features in ``wanted`` slots of the (bounded) ``rows``' column text on the driver: the other columns, and sparse
    (row, slot, value)."""
    kind = "struct<slots:array<int>,values:array<float>>"
    out = pa.struct([("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])

    def extract(texts: pa.Array) -> pa.Array:
        found = []
        for part in slices(texts):
            r, s, v = view.features(part, wanted)
            ends = np.searchsorted(r, np.arange(len(part) + 1))
            found.extend({"slots": s[a:b].astype(np.int32), "values": v[a:b].astype(np.float32)} for a, b in zip(ends, ends[1:], strict=False))
        return pa.array(found, out)

    got = rows.withColumn("f", F.arrow_udf(lean(extract), kind)(F.col("text").cast("string"))).drop("text").select("*", "f.slots", "f.values").drop("f").toArrow()
    values, slots_ = got.column("values").combine_chunks(), got.column("slots").combine_chunks()
    lengths = pc.list_value_length(slots_).to_numpy(zero_copy_only=False).astype(np.int64) if len(slots_) else np.zeros(0, np.int64)
    flat = lambda c, kind: c.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return got.drop_columns(["slots", "values"]).to_pandas(), np.repeat(np.arange(len(lengths)), lengths), flat(slots_, np.int64), flat(values, float)
