"""Benchmark decontamination with one Aho-Corasick automaton over all normalised item windows.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and non-ASCII characters. A window is
``window`` consecutive item words (an item of fewer is one window). The automaton's symbols are words: it holds every
distinct window in sorted arrays, 17 bytes a node and ``window`` nodes an item word at most. A batch of documents is
scanned once, all of them a word at a time together (long ones in pieces that overlap by a window), and what is hit is
mapped back to code-point offsets of the original text.

The items are sent to the executors in blocks of at most ``BLOCK_NODES`` nodes: one block, and so one automaton, for
any usual benchmark. A larger one is scanned block after block, each writing what it hits by text; so memory is bounded
by a block whatever the benchmark's size.

Defined results: a null or empty text has no words and is clean; a null item is no item; repeated items share their
windows and each counts by its id; an empty benchmark hits nothing; rows with equal texts have equal results; extra
columns pass through, but a column named like the output is replaced by it.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, byte_tokens, lean, materialize, rows_per_slice

WINDOW = 10
BLOCK_NODES = 4_000_000
PIECE = 2048
SLICE_BYTES = 8 << 20

_KEEP = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if (c + 32 if 65 <= c <= 90 else c) in _KEEP else 32 for c in range(256))

RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Aho-Corasick over word ids. States are numbered by depth and, inside a depth, by (parent, word), so the sorted
    transition keys parent * radix + word lead to state 1 + their index."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size, self.names = size, [i for i, _ in items]
        split = [words(t) for _, t in items]
        self.ids = {w: k for k, w in enumerate(sorted({w for x in split for w in x}), 1)}
        self.radix = len(self.ids) + 1
        rows, owners = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int64)]
        for k, x in enumerate(split):
            if x:
                v = np.array([self.ids[w] for w in x], np.int32)
                if len(v) < size:
                    rows.append(np.pad(v, (0, size - len(v)))[None])  # the end of a short window is 0
                else:
                    rows.append(np.lib.stride_tricks.sliding_window_view(v, size))
                owners.append(np.full(len(rows[-1]), k))
        m, who = np.concatenate(rows), np.concatenate(owners)
        at = np.zeros(len(m), np.int64)
        keys, first, end_of = [np.zeros(0, np.int64)], [1], np.zeros(len(m), np.int64)
        for d in range(size):
            on = np.flatnonzero(m[:, d])
            new, place = np.unique(at[on] * self.radix + m[on, d], return_inverse=True)
            keys.append(new)
            at[on] = first[-1] + place
            first.append(first[-1] + len(new))
        end_of[:] = at
        self.keys, n = np.concatenate(keys), first[-1]
        self.root = np.zeros(self.radix, np.int32)
        self.root[self.keys[: first[1] - 1]] = np.arange(1, first[1])
        self.fail, self.cover, self.link = np.zeros(n, np.int32), np.zeros(n, np.uint8 if size < 256 else np.int32), np.zeros(n, np.int32)
        ends = np.zeros(n, bool)
        ends[end_of] = len(m) > 0
        ends[0] = False
        for d in range(size):
            states = np.arange(first[d], first[d + 1])
            parent, word = self.keys[states - 1] // self.radix, self.keys[states - 1] % self.radix
            if d:
                self.fail[states] = self.step(self.fail[parent], word)
            f = self.fail[states]
            self.cover[states] = np.where(ends[states], d + 1, self.cover[f])
            self.link[states] = np.where(ends[f], f, self.link[f])  # the next window that ends here too
        order = np.lexsort((who, end_of))
        pairs = np.unique(np.stack([end_of[order], who[order]], axis=1), axis=0) if len(m) else np.zeros((0, 2), np.int64)
        self.ends, self.ends_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(n + 1))

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state of each after its next word (0: no item has it)."""
        out = np.zeros(len(state), np.int64)
        i = np.flatnonzero(word)
        s, w = state[i].astype(np.int64), word[i]
        while len(i):
            at_root = s == 0
            out[i[at_root]] = self.root[w[at_root]]
            i, s, w = i[~at_root], s[~at_root], w[~at_root]
            if not len(i):
                break
            key = s * self.radix + w
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[k] == key
            out[i[found]] = k[found] + 1
            i, s, w = i[~found], self.fail[s[~found]].astype(np.int64), w[~found]
        return out

    def hits(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, state) wherever a window ends: texts of ``counts`` words stand one after another in ``symbols``."""
        starts = np.cumsum(counts) - counts
        pieces = np.maximum(1, -(-counts // PIECE))
        text = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low = starts[text] + np.maximum(0, nth * PIECE - (self.size - 1))
        high = starts[text] + np.minimum(counts[text], (nth + 1) * PIECE)
        length = high - low
        order = np.argsort(-length, kind="stable")
        low, length = low[order], length[order]
        state, found = np.zeros(len(low), np.int64), []
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")  # pieces longer than t
        for t, n in enumerate(active.tolist()):
            state = self.step(state[:n], symbols[low[:n] + t])
            hit = np.flatnonzero(self.cover[state])
            if len(hit):
                found.append((low[hit] + t, state[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def owners(self, states: np.ndarray) -> list[str]:
        """The items whose windows end in any of ``states``, sorted."""
        seen: set[int] = set()
        while len(states := np.unique(states[states > 0])):
            for s in states.tolist():
                seen.update(self.ends[self.ends_from[s] : self.ends_from[s + 1]].tolist())
            states = self.link[states].astype(np.int64)
        return sorted({self.names[k] for k in seen})


_built: dict = {}


def automaton(key: str, items: list[tuple[str, str]], size: int) -> Automaton:
    """The block's automaton, kept by the worker for the next batch; one at a time."""
    if _built.get("key") != key:
        _built.clear()
        _built.update(key=key, automaton=Automaton(items, size))
    return _built["automaton"]


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """The runs of hit words as code points of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    step = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    runs = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return [{"start": int(points[starts[i]]), "end": int(points[stops[j - 1]])} for i, j in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


def scan(texts: pa.Array, a: Automaton) -> list[dict]:
    """What the automaton finds in each whole text."""
    owner, tokens = byte_tokens(texts, _FOLD)
    of = np.array([a.ids.get(w, 0) for w in tokens.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    counts = np.bincount(owner, minlength=len(texts))
    found = [{"n_words": n, "n_hit": 0, "items": [], "spans": []} for n in counts.tolist()]
    place, state = a.hits(of[tokens.indices.to_numpy()] if len(owner) else np.zeros(0, np.int64), counts)
    if not len(place):
        return found
    edge = np.zeros(len(owner) + 1, np.int64)
    np.add.at(edge, place + 1 - a.cover[state].astype(np.int64), 1)
    np.add.at(edge, place + 1, -1)
    hit = np.cumsum(edge[:-1]) > 0
    whose, ends = owner[place], np.cumsum(counts)
    for k in np.unique(whose).tolist():
        own = hit[ends[k] - counts[k] : ends[k]]
        found[k] |= {"n_hit": int(own.sum()), "items": a.owners(state[whose == k]), "spans": _spans(texts[k].as_py(), own)}
    return found


def _sliced(texts: pa.Array):
    texts = pc.fill_null(texts, "")
    for s in rows_per_slice(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
        yield texts.slice(s.start, s.stop - s.start)


def _scanner(sent, key: str, window: int):
    def scanned(texts: pa.Array) -> pa.Array:
        a = automaton(key, sent.value, window)
        return pa.array([x for part in _sliced(texts) for x in scan(part, a)], _RESULT)

    return F.arrow_udf(lean(scanned), RESULT)


def merged(text: str | None, items: list[str], spans: list[dict]) -> dict:
    """The union of several blocks' findings in one text."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] < out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(dict(s))
    joined: list[dict] = []
    for s in out:  # neighbours with no word between them are one run
        if joined and not words(text[joined[-1]["end"] : s["start"]]):
            joined[-1]["end"] = s["end"]
        else:
            joined.append(s)
    return {"n_hit": sum(len(words(text[s["start"] : s["end"]])) for s in joined), "items": sorted(set(items)), "spans": joined}


def _merger():
    def merge(texts: pa.Array, items: pa.Array, spans: pa.Array) -> pa.Array:
        found, at = [], 0
        for part in _sliced(texts):
            owner, _ = byte_tokens(part, _FOLD)
            for n in np.bincount(owner, minlength=len(part)).tolist():
                more = merged(texts[at].as_py(), items[at].as_py(), spans[at].as_py()) if items[at].is_valid else {"n_hit": 0, "items": [], "spans": []}
                found.append({"n_words": n, **more})
                at += 1
        return pa.array(found, _RESULT)

    return F.arrow_udf(lean(merge), RESULT)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int):
    """Items in blocks of at most ``most`` nodes (or of one item), one block on the driver at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    block, nodes = [], 0
    for r in rows.toLocalIterator():
        own = window * len(words(r["t"]))
        if block and nodes + own > most:
            yield block
            block, nodes = [], 0
        block.append((r["i"], r["t"]))
        nodes += own
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "contamination", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``docs`` with struct ``out``: n_words, n_hit, items (ids as sorted strings) and spans (code points of the text)."""
    sc, text = docs.sparkSession.sparkContext, F.col(text_col).cast("string")

    def scanner(block):
        sent = sc.broadcast(block)
        return _scanner(sent, hashlib.sha256(repr((window, block)).encode("utf-8", "surrogatepass")).hexdigest(), window), sent

    blocks = _blocks(benchmark, item_col, item_text, window, block_nodes)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return docs.withColumn(out, scanner(block)[0](text))
    own = [F.xxhash64(text).alias("__ts_h1"), F.xxhash64(F.lit("second"), text).alias("__ts_h2")]
    with Scope(docs.sparkSession) as scope:
        found = None
        while block is not None:  # block by block: each leaves a table of the texts it hits
            udf, sent = scanner(block)
            hits = docs.select(*own, udf(text).alias("c")).where("c.n_hit > 0").select("__ts_h1", "__ts_h2", "c.items", "c.spans").dropDuplicates(["__ts_h1", "__ts_h2"])
            hits = materialize(hits, "block-hits")
            sent.destroy()
            found = hits if found is None else found.union(hits)
            block, more = more, next(blocks, None)
        both = found.groupBy("__ts_h1", "__ts_h2").agg(F.flatten(F.collect_list("items")).alias("__ts_items"), F.flatten(F.collect_list("spans")).alias("__ts_spans"))  # an entry a block
        both = scope.keep(materialize(both, "hits"))
    hashed = docs.withColumns({"__ts_h1": own[0], "__ts_h2": own[1]}).join(both, ["__ts_h1", "__ts_h2"], "left")
    return hashed.withColumn(out, _merger()(text, "__ts_items", "__ts_spans")).drop("__ts_h1", "__ts_h2", "__ts_items", "__ts_spans")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="c")
    listed = F.array_join(F.transform("c.spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select(
        "doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("long").alias("n_items"), F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"), (F.col("c.n_hit") > 0).alias("contaminated"), listed.alias("spans"),
    )
