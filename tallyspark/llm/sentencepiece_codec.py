"""SentencePiece encoding and decoding by a batched numpy Viterbi over a public model file.

Texts are normalised as the model's file says (identity, a leading space, spaces as U+2581) and cut before every
U+2581 that follows another character, as no piece holds one there. The distinct words of a batch are encoded once:
words of equal length form a matrix of characters and advance together, the hashes of all substrings of a length
probe the sorted hashes of the pieces, and a maximum over the piece lengths stores each backpointer.

A unigram model's best path has the greatest sum of scores. In a BPE model a path is the merges' own result if and
only if every two neighbouring pieces stay apart when their joined text is merged, and each prefix has exactly one
such last piece; so the same pass keeps, at every position, the piece that may stand after the one before it. All
pairs of a step are judged together, by undoing the merges beside their border from the latest to the first.
Characters with no piece fall back to byte pieces.

Defined results: null and empty texts have no ids and decode to the empty text; ids come in text order for repeated
rows alike; texts of any length are encoded whole; extra columns pass through.
"""

import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, rows_per_slice

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6
SLICE_BYTES = 4 << 20
MOST_CACHED_WORDS = 100_000
MOST_CACHED_PAIRS = 100_000
LONG_WORD = 4096  # from here on a word's blocks advance together
WORD_BLOCK, WARM_UP, BLOCKS_AT_ONCE = 1024, 128, 1024
TABLE_BITS, FEW = 20, (1 << 20) - 1
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(raw: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value, shift = 0, 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


class Model:
    """Pieces, scores and kinds of a model file, with sorted hashes of the pieces."""

    def __init__(self, raw: bytes):
        pieces, self.model_type, self.dummy_prefix, self.squeeze = [], UNIGRAM, True, True
        for number, value in _fields(raw):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                self.model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                x = dict(_fields(value))
                self.dummy_prefix, self.squeeze = bool(x.get(3, 1)), bool(x.get(4, 1))
                if x.get(2):
                    raise ValueError("models with a character map are not supported")
        self.pieces = [p for p, _, _ in pieces]
        self.scores = np.array([s for _, s, _ in pieces])
        self.kinds = np.array([k for _, _, k in pieces])
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.byte_ids = np.full(256, self.unknown)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        normal = np.flatnonzero((self.kinds == NORMAL) | (self.kinds == 4))
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.by_text = {self.pieces[i]: int(i) for i in normal}
        hashes = np.array([self.hash_of(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], normal[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        # where a hash's last bits lead into the sorted hashes: the first and one past the last of those with these bits
        self.by_bits = np.argsort(self.hashes & np.uint64(FEW), kind="stable")
        self.bits_from = np.searchsorted((self.hashes & np.uint64(FEW))[self.by_bits], np.arange(FEW + 2, dtype=np.uint64)).astype(np.int32)
        self.lengths = np.array([len(p) for p in self.pieces])
        self.unknown_score = float(self.scores[normal].min()) - 10.0
        self.raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k in (3, 5) else p.replace(SPACE, " ").encode() if k != UNKNOWN else " ⁇ ".encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.apart: dict[int, bool] = {}  # verdicts that were worked out one by one
        self.hash_by_id, self.step = np.zeros(len(self.pieces), np.uint64), np.ones(self.longest + 1, np.uint64)
        self.hash_by_id[normal] = hashes
        for n in range(self.longest):
            self.step[n + 1] = np.uint64(int(self.step[n]) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        if self.model_type == BPE:
            self._merge_trees(normal)
        self.seen, self.seen_apart = np.full(1 << TABLE_BITS, -1), np.zeros(1 << TABLE_BITS, bool)
        self.words: dict[str, bytes] = {}  # ids as int32
        self.older: dict[str, bytes] = {}  # words of the generation before; those met again move up

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _merge_trees(self, normal: np.ndarray) -> None:
        """For each piece: its rank among merges, the two parts of its last merge, whether merging its text gives it,
        and whether no part is of a later rank, so that ranks tell the order of merges."""
        n = len(self.pieces)
        self.rank = np.full(n, -1)  # single characters are there from the start
        long = np.array([i for i in normal if len(self.pieces[i]) > 1], np.int64)
        self.rank[long[np.argsort(-self.scores[long], kind="stable")]] = np.arange(len(long))
        self.parts = np.full((n, 2), -1)
        self.whole, self.in_order = np.ones(n, bool), np.ones(n, bool)
        for i in sorted(long.tolist(), key=lambda i: len(self.pieces[i])):
            text = self.pieces[i]
            ends = self._last_merge(text)
            if ends is None:
                self.whole[i] = self.in_order[i] = False
                continue
            self.parts[i] = [self.by_text.get(x, -1) for x in ends]
            self.in_order[i] = all(p >= 0 and self.in_order[p] and self.rank[p] < self.rank[i] for p in self.parts[i])

    def _last_merge(self, text: str) -> list[str] | None:
        """The two parts of ``text`` before its last merge, if merging ends in one piece."""
        before = None
        for parts in self._merging(text):
            before, last = (parts, before) if len(parts) > 1 else (before, parts)
        return before if before is not None and len(before) == 2 and len(last or []) == 1 else None

    def _merging(self, text: str):
        """The parts of ``text`` after each merge, best score and leftmost first."""
        parts = list(text)
        while True:
            yield parts
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.by_text.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]

    def merged(self, text: str) -> list[str]:
        """The result of merging ``text`` by score, best and leftmost first."""
        for parts in self._merging(text):
            pass
        return parts

    def _joined_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the piece that x and y make together (none: beyond all ranks)."""
        out = np.full(len(x), len(self.pieces))
        with np.errstate(over="ignore"):
            h = self.hash_by_id[x] * self.step[np.minimum(self.lengths[y], self.longest)] + self.hash_by_id[y]
        i = np.flatnonzero(self._may_be(h) & (self.lengths[x] + self.lengths[y] <= self.longest))
        found, ids = self._piece_of(h[i])
        out[i[found]] = self.rank[ids[found]]
        return out

    def _may_be(self, h: np.ndarray) -> np.ndarray:
        """Whether any piece's hash ends like each of ``h``."""
        bits = (h & np.uint64(FEW)).astype(np.int64)
        return self.bits_from[bits] < self.bits_from[bits + 1]

    def _piece_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each of ``h``, which may be one, is a piece's hash, and that piece."""
        bits = (h & np.uint64(FEW)).astype(np.int64)
        at, stop = self.bits_from[bits], self.bits_from[bits + 1]
        found, ids = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        i = np.arange(len(h))
        while len(i):  # nearly always once
            spot = self.by_bits[at[i]]
            same = self.hashes[spot] == h[i]
            found[i[same]], ids[i[same]] = True, self.ids[spot[same]]
            at[i] += 1
            i = i[~same & (at[i] < stop[i])]
        return found, ids

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Verdicts on pairs of pieces whose merges go by rank. Going back in time, the later of the two parts beside the
        border is undone; had the two been one piece of a rank before what took them away, they would have merged."""
        out = np.ones(len(left), bool)
        i, x, y = np.arange(len(left)), left.copy(), right.copy()
        most = len(self.pieces)
        until_x, until_y = np.full(len(i), most), np.full(len(i), most)
        while len(i):
            r = self._joined_rank(x, y)
            cross = (r < until_x) & (r <= until_y) & (r < most)  # of equal ranks the leftmost goes first
            out[i[cross]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~cross & ((rx >= 0) | (ry >= 0))
            i, x, y, until_x, until_y, rx, ry = (v[on] for v in (i, x, y, until_x, until_y, rx, ry))
            undo = rx > ry
            until_x, until_y = np.where(undo, rx, until_x), np.where(undo, until_y, ry)
            x, y = np.where(undo, self.parts[x, 1], x), np.where(undo, y, self.parts[y, 0])
        return out

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces is what merging their joined text gives. Ids of -1 - c are lone characters.

        A direct-mapped table answers for pairs seen before; a pair it has lost is worked out again.
        """
        keys = (left.astype(np.int64) + (1 << 21)) * (1 << 22) + (right.astype(np.int64) + (1 << 21))
        with np.errstate(over="ignore"):
            at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        verdict = self.seen_apart[at]
        lost = np.flatnonzero(self.seen[at] != keys)
        if len(lost):
            distinct, back = np.unique(keys[lost], return_inverse=True)
            a, b = (distinct >> 22) - (1 << 21), (distinct & ((1 << 22) - 1)) - (1 << 21)
            ranked = (a >= 0) & (b >= 0)
            ranked[ranked] = self.in_order[a[ranked]] & self.in_order[b[ranked]]
            said = np.zeros(len(distinct), bool)
            said[ranked] = self._stay_apart(a[ranked], b[ranked])
            for n in np.flatnonzero(~ranked).tolist():
                said[n] = self._apart_one(int(distinct[n]), int(a[n]), int(b[n]))
            verdict[lost] = said[back]
            self.seen[at[lost]], self.seen_apart[at[lost]] = keys[lost], verdict[lost]
            self.seen[at[lost[self.seen[at[lost]] != keys[lost]]]] = -1  # two new pairs in one place: neither stays
        return verdict

    def _apart_one(self, key: int, left: int, right: int) -> bool:
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= MOST_CACHED_PAIRS:
                self.apart.clear()
            a, b = self._text(left), self._text(right)
            known = self.apart[key] = self.merged(a + b) == [a, b]
        return known

    def _text(self, i: int) -> str:
        return self.pieces[i] if i >= 0 else chr(-1 - i)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words; words of one length advance together."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            if n > LONG_WORD and self.model_type == BPE:
                out.update((w, self._long_word(w)) for w in group)
                continue
            step = max(1, 400_000 // n)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                out.update(zip(part, self._viterbi(part, n), strict=True))
        return out

    def _last_pieces(self, chars: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length, a column each, the last piece of the best path to each position and its length; a
        piece of -1 - c is a character without a piece. ``known``: both for positions 1 to ``longest``, where the words
        go on from others."""
        n, m = chars.shape
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0.0
        piece = np.zeros((n + 1, m), np.int64)
        length = np.zeros((n + 1, m), np.int64)
        begin = 1
        if known is not None:
            begin += self.longest
            best[0], best[1:begin], piece[1:begin], length[1:begin] = -np.inf, 0.0, *known
        rolling = np.zeros((min(self.longest, n), m), np.uint64)  # rolling[k]: hash of the k + 1 characters that end here
        single = self.model_type == BPE  # then a prefix has one last piece, and nothing else needs to be tried
        for end in range(1, n + 1):
            c = chars[end - 1].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                rolling[1:] = rolling[:-1] * np.uint64(0x9E3779B97F4A7C15) + c
            rolling[0] = c
            if end < begin:
                continue
            for size in range(1, min(self.longest, end, len(rolling)) + 1):
                start, h = end - size, rolling[size - 1]
                on = best[start] > -np.inf
                if single:
                    on &= best[end] == -np.inf
                i = np.flatnonzero(on & self._may_be(h)) if size > 1 else np.flatnonzero(on)
                if not len(i):
                    continue
                if size > 1:
                    found, ids = self._piece_of(h[i])
                    i, ids = i[found], ids[found]
                else:
                    found, ids = np.zeros(len(i), bool), -1 - chars[end - 1, i]
                    may = np.flatnonzero(self._may_be(h[i]))
                    found, known = self._piece_of(h[i[may]])
                    ids[may[found]] = known[found]
                if self.model_type == BPE:
                    real = (ids < 0) | self.whole[ids]
                    i, ids = i[real], ids[real]
                    if start and len(i):
                        may = self.stay_apart(piece[start, i], ids)
                        i, ids = i[may], ids[may]
                    score = np.zeros(len(i))
                else:
                    score = best[start, i] + np.where(ids >= 0, self.scores[np.maximum(ids, 0)], self.unknown_score)
                better = score > best[end, i]
                i, ids = i[better], ids[better]
                best[end, i], piece[end, i], length[end, i] = score[better], ids, size
        return piece, length

    def _long_word(self, word: str) -> bytes:
        """The ids of a word of any length: its blocks advance together, each from a bit before its place. The last
        piece at a position depends on those of the ``longest`` positions before it alone, so a block whose first such
        positions are as the block before it has them is right; any other one advances again from there, once for
        all blocks of equal characters and equal positions before them."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, back = len(chars), self.longest
        piece, length = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        at = np.arange(WORD_BLOCK, n, WORD_BLOCK)
        whole = at[at + WORD_BLOCK <= n]
        first = self._last_pieces(chars[:WORD_BLOCK, None])
        piece[: WORD_BLOCK + 1], length[: WORD_BLOCK + 1] = first[0][:, 0], first[1][:, 0]
        seen: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(0, len(at), BLOCKS_AT_ONCE):
            some = at[k : k + BLOCKS_AT_ONCE]
            full = some[some <= (whole[-1] if len(whole) else -1)]
            told = self._last_pieces(chars[full[None, :] + np.arange(-WARM_UP, WORD_BLOCK)[:, None]]) if len(full) else None
            for j, a in enumerate(some.tolist()):
                stop = min(n, a + WORD_BLOCK)
                before = slice(a - back + 1, a + 1)
                if j < len(full) and np.array_equal(told[0][WARM_UP - back + 1 : WARM_UP + 1, j], piece[before]) and np.array_equal(told[1][WARM_UP - back + 1 : WARM_UP + 1, j], length[before]):
                    now = told[0][WARM_UP + 1 :, j], told[1][WARM_UP + 1 :, j]
                else:
                    key = chars[a - back : stop].tobytes() + piece[before].tobytes() + length[before].tobytes()
                    if key not in seen:
                        if len(seen) >= BLOCKS_AT_ONCE:
                            seen.clear()
                        again = self._last_pieces(chars[a - back : stop, None], (piece[before, None], length[before, None]))
                        seen[key] = again[0][back + 1 :, 0], again[1][back + 1 :, 0]
                    now = seen[key]
                piece[a + 1 : stop + 1], length[a + 1 : stop + 1] = now
        path, where, sizes, ids = [], n, length.tolist(), piece.tolist()
        while where > 0:
            path.append(ids[where])
            where -= sizes[where]
        path.reverse()
        return array("i", self._with_bytes(path)).tobytes()

    def _viterbi(self, words: list[str], n: int) -> list[bytes]:
        m = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.int64)  # a row per position
        piece, length = self._last_pieces(chars)
        where, pending, rows, ids = np.full(m, n), np.arange(m), [], []
        while len(pending):  # from the last piece of each word to its first
            now = where[pending]
            rows.append(pending)
            ids.append(piece[now, pending])
            where[pending] = now - length[now, pending]
            pending = pending[where[pending] > 0]
        row, path = np.concatenate(rows)[::-1], np.concatenate(ids)[::-1]
        order = np.argsort(row, kind="stable")
        path, ends = path[order], np.cumsum(np.bincount(row, minlength=m)).tolist()
        odd = set(row[order][path < 0].tolist())
        flat = path.astype(np.int32).tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
        for r in odd:
            out[r] = array("i", self._with_bytes(path[ends[r - 1] if r else 0 : ends[r]].tolist())).tobytes()
        return out

    def _with_bytes(self, path: list[int]) -> list[int]:
        out: list[int] = []
        for i in path:
            out.extend([i] if i >= 0 else (int(self.byte_ids[b]) for b in chr(-1 - i).encode("utf-8", "surrogatepass")))
        return out

    def _blanks(self, n: int) -> list[str]:
        if n <= 64:
            return self.merged(SPACE * n)
        return [self.pieces[i] for i in np.frombuffer(self.encode_words([SPACE * n])[SPACE * n], np.int32)]

    def encode_unit(self, unit: str, core: bytes) -> bytes:
        """A word with several leading blanks from the ids of its one-blank form (empty: no word follows). Blanks only
        merge among themselves, after everything else."""
        ids = array("i", core)
        blanks = len(unit) - len(unit.lstrip(SPACE))
        takes = bool(ids) and self.lengths[ids[0]] > 1
        head = self._blanks(blanks - takes)
        return array("i", [self.by_text[x] for x in head]).tobytes() + (ids if takes else ids[1:]).tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def normalize(model: Model, text: str) -> str:
    if model.squeeze:
        text = re.sub(" +", " ", text.strip(" "))
    if not text:
        return ""
    return ((" " if model.dummy_prefix else "") + text).replace(" ", SPACE)


def _known(model: Model, words: list[str]) -> list[bytes]:
    """The ids of distinct words; those not remembered are encoded together.

    Two generations of about MOST_CACHED_WORDS words are kept, so what a worker holds does not grow with the corpus.
    """
    known, older = model.words, model.older
    fresh = []
    for w in words:
        if w not in known:
            if w in older:
                known[w] = older.pop(w)
            else:
                fresh.append(w)
    if fresh:
        bare = {w: SPACE + w.lstrip(SPACE) for w in fresh if w[:2] == SPACE * 2}
        if bare and model.model_type == BPE:
            plain = {w for w in fresh if w not in bare} | {c for c in bare.values() if c != SPACE}
            known.update(model.encode_words([w for w in plain if w not in known]))
            for w, c in bare.items():
                known[w] = model.encode_unit(w, known[c] if c != SPACE else b"")
        else:
            known.update(model.encode_words(fresh))
    out = [known[w] for w in words]
    if len(known) > MOST_CACHED_WORDS:
        model.older, model.words = known, {}
    return out


def _split(model: Model, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    cut = [_WORD.findall(normalize(model, t)) for t in texts]
    return pa.array([w for words in cut for w in words], pa.string()), np.array([len(words) for words in cut], np.int64)


def _split_plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As ``_split`` for texts with a leading blank to come and single blanks between words alone."""
    listed = pc.split_pattern(texts, " ")
    return pc.binary_join_element_wise(pa.scalar(SPACE), listed.flatten(), ""), pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)


def encode_batch(model: Model, texts: list[str]) -> list[np.ndarray]:
    """Ids of each whole text; every distinct word is encoded once and remembered by the worker."""
    flat, ends = encode_flat(model, pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).cast(pa.string(), safe=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def encode_flat(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``texts`` one after another, and where each text's ids end."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if model.dummy_prefix and not model.squeeze:
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.equal(texts, "")))
        odd = odd.to_numpy(zero_copy_only=False)
    else:
        odd = np.ones(n, bool)
    plain, other = np.flatnonzero(~odd), np.flatnonzero(odd)
    parts = [_split_plain(texts.take(pa.array(plain))), _split(model, texts.take(pa.array(other)).to_pylist())]
    counts = np.zeros(n, np.int64)
    counts[plain], counts[other] = parts[0][1], parts[1][1]
    words = pa.concat_arrays([parts[0][0].cast(pa.string()), parts[1][0]]).dictionary_encode()
    ids = _known(model, words.dictionary.to_pylist())
    pool = np.frombuffer(b"".join(ids), np.int32)
    sizes = np.array([len(x) for x in ids], np.int64) // 4
    starts = np.cumsum(sizes) - sizes
    codes = words.indices.to_numpy()
    # words stand plain texts first: back into the texts' order
    first_word = np.zeros(n, np.int64)
    order = np.concatenate([plain, other])
    first_word[order] = np.cumsum(counts[order]) - counts[order]
    place = np.repeat(first_word - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    codes = codes[place]
    each = sizes[codes]
    total = int(each.sum())
    at = np.repeat(starts[codes] - (np.cumsum(each) - each), each) + np.arange(total)
    of_text = np.concatenate([[0], np.cumsum(each)])[np.cumsum(counts)]
    return pool[at], of_text


def decode_ids(model: Model, ids: np.ndarray) -> str:
    raw = model.raw
    text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, pa.int32()))


_NONE = np.zeros(0, np.int32), np.zeros(0, np.int64)


def _encoded(model: Model, texts: pa.Array):
    """The ids of the texts (as ``encode_flat``), slice by slice."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for s in rows_per_slice(lengths, SLICE_BYTES):
        yield encode_flat(model, texts.slice(s.start, s.stop - s.start))


def _encoder(path: str):
    def encode(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_lists(*_NONE), *(_lists(*x) for x in _encoded(load(path), texts))])

    return F.arrow_udf(lean(encode), "array<int>")


def _decoder(path: str):
    def decode(ids: pa.Array) -> pa.Array:
        model = load(path)
        return pa.array([decode_ids(model, x.values.to_numpy()) if x.is_valid else "" for x in ids], pa.string())

    return F.arrow_udf(lean(decode), "string")


def _both(path: str):
    def both(texts: pa.Array) -> pa.Array:
        model, ids, decoded = load(path), [_lists(*_NONE)], [pa.array([], pa.string())]
        for flat, ends in _encoded(model, texts):
            ids.append(_lists(flat, ends))
            decoded.append(pa.array([decode_ids(model, x) for x in np.split(flat, ends[:-1])], pa.string()))
        return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(decoded)], ["ids", "decoded"])

    return F.arrow_udf(lean(both), "struct<ids:array<int>,decoded:string>")


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the ids of each whole text."""
    return docs.withColumn(out, _encoder(model)(F.col(text_col).cast("string")))


def decode(docs: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with the text of each id list (null: the empty text)."""
    return docs.withColumn(out, _decoder(model)(F.col(ids_col).cast("array<int>")))


def encode_and_decode(docs: DataFrame, text_col: str = "text", out: str = "encoded", model: str = MODEL) -> DataFrame:
    """``docs`` with struct ``out`` (ids, and the text decoded from them): one function, so each text is encoded once."""
    return docs.withColumn(out, _both(model)(F.col(text_col).cast("string")))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode_and_decode(docs, out="e")
    return both.select(
        "doc_id", F.size("e.ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("e.ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("e.decoded", "UTF-8"), 256).alias("decoded_sha256"), (F.col("e.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
