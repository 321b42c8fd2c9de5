"""Near-duplicates by an LSH forest over MinHash signatures of word shingles.

Every document becomes a set of 64-bit shingle hashes; documents with equal sets are one node. A node's signature has
``TREES`` sequences of ``DEPTH`` min-hash labels of 16 bits, a tree each. Candidates are the nodes with the longest common prefixes
in a tree, in two steps; all are confirmed on their full sets, and links that hold become components.

1. Neighbours. The first trees' orders are sorted over all partitions and rows that stand close together and share a
   prefix are compared. This joins nearly every group of copies; whatever it leaves out comes up again in step 2.
2. Regions. In every tree, nodes of different components whose labels agree to ``DEPTHS[0]`` stand in one region; a
   region of more than ``CROWD`` nodes is parted by the next labels, down to ``DEPTHS[-1]``, so the depth follows how
   crowded it is. In the regions at the end all nodes of different components are compared, however many they are:
   beyond ``BLOCK`` nodes by pairs of blocks, each a task's work of its own (see ``spots``). A pair is named unless its set sizes or its
   odd sketches (parities of shingles by hash) show that it differs in too many shingles; parities never show more
   differences than there are, so for sets of ordinary size this drops no link at all.

Two nodes of similarity 0.8 meet in a region of the least depth with a chance of 1 - 5e-8, of the greatest with 0.997.

Defined results: null and empty texts and texts without words have the empty set and link with nothing, not with each
other; rows with equal texts link; rows of a null id take part, and the smallest id ignores nulls; a null id is
never kept unless its whole component has none; extra columns are not read; an empty table gives no rows.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, lean, lean_rows, materialize, rows_per_slice
from .graph import connected_components

TREES, DEPTH, LABEL = 32, 8, 2  # a label has two bytes, so unlike nodes share no prefix of 4 by chance, however many they are
DEPTHS = (4, 6, 8)
CROWD, BLOCK, MAIN = 512, 1024, 1 << 30
SKETCH_BYTES, ODD_BYTES = 24, 256
NEIGHBOURS = 8
LEAST_PREFIX = 2
FIRST_TREES = 4
SLICE_BYTES = 2 << 20
MOST_BROADCAST_ROWS = 1_000_000
NODE, KEY = 16, 1 + DEPTH * LABEL
ROW = KEY + NODE + SKETCH_BYTES
NAMED = 50_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each whole text the sorted distinct 64-bit hashes of its ``width``-word shingles (fewer words: one shingle)."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts.to_pylist()]  # bytes: A-Z and ASCII white space only
    flat = pa.array([x for words in split for x in words], pa.binary()).dictionary_encode()
    hashes = pd.util.hash_array(np.array([*flat.dictionary.to_pylist(), b""], dtype=object), categorize=False)
    w = _mix(hashes[flat.indices.to_numpy()] + np.uint64(1))
    ends = np.cumsum([len(words) for words in split], dtype=np.int64)
    rolled = w
    with np.errstate(over="ignore"):
        for i in range(1, width):
            rolled = _mix(rolled[: len(w) - i] * np.uint64(0x9E3779B97F4A7C15) + w[i:]) if len(w) > i else rolled[:0]
    out, start = [], 0
    for end in ends:
        n = end - start
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n >= width:
            out.append(np.unique(rolled[start : end - width + 1]))
        else:
            with np.errstate(over="ignore"):
                h = w[start : start + 1]
                for i in range(1, n):
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[start + i : start + i + 1])
            out.append(_mix(h + np.uint64(n)))
        start = end
    return out


@lru_cache(maxsize=4)
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_601)
    return (r.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)), r.integers(0, 1 << 32, n, np.uint32)


def signature(shingles: np.ndarray, trees: int = TREES) -> bytes:
    """``trees`` sequences of DEPTH min-hash labels, then the bit sketch."""
    a, b = _factors(trees * DEPTH)
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 512):
            v = x[i : i + 512] * a
            v += b
            np.minimum(least, v.min(axis=0), out=least)
        mixed = least * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA77)
    bits = np.packbits(((mixed >> np.uint32(8)) & np.uint32(1)).astype(np.uint8)[: SKETCH_BYTES * 8])
    return (mixed >> np.uint32(16)).astype(">u2").tobytes() + bits.tobytes()


def odd_sketch(shingles: np.ndarray) -> bytes:
    """For each of 8 * ODD_BYTES hash values whether an odd number of shingles has it."""
    return np.packbits((np.bincount((shingles & np.uint64(8 * ODD_BYTES - 1)).astype(np.int64), minlength=8 * ODD_BYTES) & 1).astype(np.uint8)).tobytes()


def most_odd(differing: np.ndarray) -> np.ndarray:
    """Odd sketches of sets that differ in so many shingles differ in so many bits at most, whatever the shingles are."""
    return np.minimum(differing, 8.0 * ODD_BYTES)


def _slices(batch: pa.RecordBatch, column: str):
    text = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    for s in rows_per_slice(lengths, SLICE_BYTES):
        yield s, text.slice(s.start, s.stop - s.start)


def node_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _signatures(width: int, trees: int):
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sig", pa.binary()), ("odd", pa.binary())])

    def run(batches):
        for batch in batches:
            for s, texts in _slices(batch, "text"):
                sets = shingle_sets(texts, width)
                binary = lambda f: pa.array([f(x) if len(x) else None for x in sets], pa.binary())  # noqa: B023, E731
                own = [batch.column(c).slice(s.start, s.stop - s.start) for c in ("id", "mark")]
                yield pa.record_batch([*own, pa.array([len(x) for x in sets], pa.int64()), binary(node_of), binary(lambda x: signature(x, trees)), binary(odd_sketch)], schema=schema)

    return run, "id bigint, mark bigint, n bigint, node binary, sig binary, odd binary"


def _sets(width: int):
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for _, texts in _slices(batch, "text"):
                sets = [x for x in shingle_sets(texts, width) if len(x)]
                yield pa.record_batch([pa.array([node_of(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], schema=schema)

    return run, "node binary, shingles binary"


def _tree_rows(end: int, trees: int):
    schema = pa.schema([("row", pa.binary())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sig, node = _matrix(part.column("sig"), trees * DEPTH * LABEL + SKETCH_BYTES), _matrix(part.column("node"), NODE)
                out = np.empty((len(sig), end, ROW), np.uint8)
                out[:, :, 0] = np.arange(end)
                out[:, :, 1:KEY] = sig[:, : end * DEPTH * LABEL].reshape(len(sig), end, DEPTH * LABEL)
                out[:, :, KEY:] = np.concatenate([node, sig[:, trees * DEPTH * LABEL :]], axis=1)[:, None]
                yield pa.record_batch([_binary(out.reshape(-1, ROW))], schema=schema)

    return run, "row binary"


def _least_agreement(threshold: float) -> int:
    """Fewest equal sketch bits of a similar pair: 4.5 standard deviations under the mean at the threshold."""
    n, p = SKETCH_BYTES * 8, (1 + threshold) / 2
    return int(n * p - 4.5 * (n * p * (1 - p)) ** 0.5)


def _sure_agreement(threshold: float) -> int:
    """Equal sketch bits that only pairs well over the threshold have."""
    n, p = SKETCH_BYTES * 8, (3 + threshold) / 4
    return int(n * p + (n * p * (1 - p)) ** 0.5)


_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_PAIRS_DDL = "a binary, b binary"


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as an Arrow array."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _in_order(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    """Pairs of the rows of two matrices of nodes, the lower node first."""
    a, b = (np.ascontiguousarray(x).view(">u8").astype(np.uint64) for x in (one, two))
    swap = ((a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))[:, None]
    return pa.record_batch([_binary(np.where(swap, two, one)), _binary(np.where(swap, one, two))], schema=_PAIRS)


def _candidates(m: np.ndarray, first: int, least: int, sure: int) -> np.ndarray:
    """(row, row) of close rows of the sorted matrix ``m``; the later one of a pair is at ``first`` or after.

    Beyond the next row, a pair is left out if the rows between chain it by links that are as good as sure.
    """
    n, pairs = len(m), [np.zeros((0, 2), np.int64)]
    chain = np.zeros(n, bool)  # row i surely links with row i - 1
    for step in range(1, NEIGHBOURS + 1):
        if n <= step:
            break
        one, two = m[:-step], m[step:]
        i = np.flatnonzero((one[:, : 1 + LEAST_PREFIX * LABEL] == two[:, : 1 + LEAST_PREFIX * LABEL]).all(axis=1))
        agree = SKETCH_BYTES * 8 - np.bitwise_count(one[i, KEY + NODE :] ^ two[i, KEY + NODE :]).sum(axis=1, dtype=np.int64)
        if step == 1:
            chain[i[agree >= sure] + 1] = True
        i = i[agree >= least]
        if step > 1:
            i = i[~np.logical_and.reduce([chain[i + k] for k in range(1, step + 1)])]
        pairs.append(np.stack([i, i + step], axis=1))
    found = np.concatenate(pairs)
    return found[found[:, 1] >= first]


def _neighbours(least: int, sure: int):
    def run(batches):
        last = np.zeros((0, ROW), np.uint8)
        for batch in batches:
            if batch.num_rows:
                m = np.concatenate([last, _matrix(batch.column("row"), ROW)])
                found = _candidates(m, len(last), least, sure)
                node = m[:, KEY : KEY + NODE]
                yield _in_order(node[found[:, 0]], node[found[:, 1]])
                last = m[-NEIGHBOURS:]

    return run


def neighbour_pairs(nodes: DataFrame, threshold: float, end: int, trees: int = TREES) -> DataFrame:
    """Pairs (a < b) of ``nodes`` (node, sig) that stand close together in the orders of the first ``end`` trees."""
    run, ddl = _tree_rows(end, trees)
    rows = nodes.select("node", "sig").mapInArrow(lean_rows(run), ddl).repartitionByRange("row").sortWithinPartitions("row")
    return rows.mapInArrow(lean_rows(_neighbours(_least_agreement(threshold), _sure_agreement(threshold))), _PAIRS_DDL).distinct()


def _joinable(df: DataFrame) -> DataFrame:
    """A written table: broadcast if it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST_ROWS else df


def regions(nodes: DataFrame, trees: int = TREES) -> tuple[DataFrame, bool]:
    """``nodes``: node, sig, root. (region, n, node, rh: the root's hash) of the nodes of every region that holds several
    roots, each as deep as its crowd wants, and whether any has more than BLOCK nodes. Counts have partial sums, so a crowded region is never gathered here."""
    keys = ", ".join(f"'k{d}', xxhash64(t, substring(sig, t * {DEPTH * LABEL} + 1, {d * LABEL}))" for d in DEPTHS)
    each = F.explode(F.expr(f"transform(sequence(0, {trees - 1}), t -> named_struct({keys}))"))
    live = nodes.select("node", F.xxhash64("root").alias("rh"), each.alias("k")).select("node", "rh", "k.*")
    found, large = None, False
    for d in DEPTHS:
        key = f"k{d}"
        mixed = live.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("rh").alias("low"), F.max("rh").alias("high")).where("low < high").select(key, "n")
        mixed = materialize(mixed, "regions")
        last = d == DEPTHS[-1]
        ready, crowded = (mixed, None) if last else (mixed.where(F.col("n") <= CROWD), mixed.where(F.col("n") > CROWD).select(key))
        members = live.join(_joinable(ready), key).select(F.col(key).alias("region"), "n", "node", "rh")
        found = members if found is None else found.union(members)
        large = large or (last or CROWD > BLOCK) and not ready.where(F.col("n") > BLOCK).isEmpty()
        if last or crowded.isEmpty():
            return found, large
        live = materialize(live.join(_joinable(crowded), key, "left_semi"), "crowded")


def _may_link(i: np.ndarray, j: np.ndarray, size: np.ndarray, odd: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows i and j can be similar by their set sizes and odd sketches."""
    a, b = size[i], size[j]
    may = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    k = np.flatnonzero(may)
    bits = np.bitwise_count(odd[i[k]] ^ odd[j[k]]).sum(axis=1, dtype=np.int64)
    may[k] = bits <= most_odd(np.floor((a[k] + b[k]) * (100 - percent) / (100 + percent)))
    return may


_SPOT = 8 + 4 + 4  # region and its two blocks


def _pairs_of_regions(m: np.ndarray, percent: int):
    """Pairs (matrices of nodes) of the whole regions in ``m``: rows of spot, root, own block, set size, node, odd sketch,
    sorted by spot and root."""
    n, at = len(m), _SPOT

    def ends(columns: int) -> np.ndarray:
        change = np.flatnonzero((m[1:, :columns] != m[:-1, :columns]).any(axis=1)) + 1
        return np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]

    run_end, next_root = ends(at), ends(at + 8)
    own = np.ascontiguousarray(m[:, at + 8 : at + 12]).view(">u4")[:, 0]
    size = np.ascontiguousarray(m[:, at + 12 : at + 20]).view(">u8")[:, 0].astype(np.int64)
    node = m[:, at + 20 : at + 20 + NODE]
    odd = np.ascontiguousarray(m[:, at + 20 + NODE :]).view(np.uint64)
    one_block = (m[:, 8:12] == m[:, 12:16]).all(axis=1)
    i = np.flatnonzero(next_root < run_end)
    j = next_root[i]
    while len(i):
        on = one_block[i] | (own[i] != own[j])
        on[on] = _may_link(i[on], j[on], size, odd, percent)
        if on.any():
            yield node[i[on]], node[j[on]]
        j = j + 1
        more = j < run_end[i]
        i, j = i[more], j[more]


def _whole_regions(percent: int):
    width = _SPOT + 8 + 4 + 8 + NODE + ODD_BYTES

    def named(m):
        one, two, n = [], [], 0
        for a, b in _pairs_of_regions(m, percent):
            one.append(a)
            two.append(b)
            n += len(a)
            if n >= NAMED:
                yield _in_order(np.concatenate(one), np.concatenate(two))
                one, two, n = [], [], 0
        if n:
            yield _in_order(np.concatenate(one), np.concatenate(two))

    def run(batches):
        held: list[np.ndarray] = []  # a region that may go on: 2 * BLOCK rows at most, as blocks come in pairs
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _matrix(batch.column("row"), width)
            same = (new[:, :_SPOT] == new[-1, :_SPOT]).all(axis=1)
            start = len(new) if not same.any() else int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if start:
                yield from named(np.concatenate([*held, new[:start]]))
                held = [new[start:]]
            else:
                if held and (held[-1][-1, :_SPOT] != new[0, :_SPOT]).any():
                    yield from named(np.concatenate(held))
                    held = []
                held.append(new)
        if held:
            yield from named(np.concatenate(held))

    return run


def spots(members: DataFrame, large: bool = True) -> DataFrame:
    """(region, node, own, first, second): where the nodes of each region meet.

    A region of up to BLOCK nodes is one spot. In a larger one the root with most nodes is its main root. Nodes of the
    main root need not meet each other: each stands in one block of them, and meets every block of the other nodes;
    these meet each other by pairs of blocks. With few others a row of the main root is there once, however many
    there are. Without ``large`` no region has more nodes. ``own`` tells the blocks of a spot apart; in a spot of two blocks only nodes of different ones are paired.
    """
    one = members.where(F.col("n") <= BLOCK).select("region", "node", F.lit(0).alias("own"), F.lit(0).alias("first"), F.lit(0).alias("second"))
    if not large:
        return one
    more = members.where(F.col("n") > BLOCK)
    counts = more.groupBy("region", "rh").agg(F.count(F.lit(1)).alias("of_root"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    main = counts.groupBy("region").agg(F.max_by("rh", F.struct("of_root", "rh")).alias("main"), blocks(F.max("of_root")).alias("mains"), blocks(F.sum("of_root") - F.max("of_root")).alias("others"))
    x = more.join(_joinable(materialize(main, "large-regions")), "region").withColumn("is_main", F.col("rh") == F.col("main"))
    x = x.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("second"))
    with_mains = F.transform(F.when(F.col("is_main"), each("others")).otherwise(each("mains")), lambda k: F.when(F.col("is_main"), spot(MAIN + F.col("block"), k)).otherwise(spot(MAIN + k, F.col("block"))))
    among_others = F.transform(each("others"), lambda k: spot(F.least("block", k), F.greatest("block", k)))
    at = F.explode(F.when(F.col("is_main"), with_mains).otherwise(F.concat(with_mains, among_others)))
    x = x.select("region", "node", F.when(F.col("is_main"), MAIN + F.col("block")).otherwise(F.col("block")).alias("own"), at.alias("at"))
    return one.union(x.select("region", "node", "own", "at.first", "at.second"))


def region_pairs(nodes: DataFrame, percent: int, trees: int = TREES) -> DataFrame:
    """``nodes``: node, sig, root, n, odd. Pairs (a < b) of different roots that share a region and may be similar."""
    big_endian = lambda c, kind: F.expr(f"unhex(lpad(hex(cast({c} AS bigint)), {kind}, '0'))")
    where = spots(*regions(nodes, trees)).select("node", "own", F.concat(big_endian("region", 16), big_endian("first", 8), big_endian("second", 8)).alias("spot"))
    heavy = nodes.select("node", F.concat(big_endian("xxhash64(root)", 16)).alias("rh"), F.concat(big_endian("n", 16), "node", "odd").alias("rest"))
    rows = where.join(heavy, "node").select(F.concat("spot", "rh", big_endian("own", 8), "rest").alias("row"))
    return rows.repartition(F.substring("row", 1, _SPOT)).sortWithinPartitions("row").mapInArrow(lean_rows(_whole_regions(percent)), _PAIRS_DDL).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have ``100 * intersection >= percent * union``."""

    def similar(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(one, two, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    held = F.arrow_udf(lean(similar), "boolean")
    close = F.expr(f"100 * least(length(one), length(two)) >= {percent} * greatest(length(one), length(two))")
    return pairs.join(left, "a").join(right, "b").where(close).where(held("one", "two")).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, marks: bool = False) -> DataFrame:
    """Rows of id, n_shingles, component_id (the smallest id reachable over links) and kept.

    ``marks`` adds the text's hash as text_mark, and first: whether id and hash are the component's first ones. With
    repeated or null ids, that names one text of each component where kept does not."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    run, ddl = _signatures(width, trees)
    with Scope(docs.sparkSession) as scope:
        signed = scope.keep(materialize(plain.select("id", "mark", "text").mapInArrow(lean_rows(run), ddl), "signatures"))
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("least")
        nodes = materialize(signed.where("node IS NOT NULL").groupBy("node").agg(F.first("sig").alias("sig"), F.first("odd").alias("odd"), F.first("n").alias("n"), least), "nodes")

        def confirmed(pairs: DataFrame) -> DataFrame:
            pairs = materialize(pairs, "candidates")
            ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
            # a node's document is that of its smallest id; ids alone go along, its text is read where it lies
            wanted = _joinable(materialize(nodes.join(ends, "node", "left_semi").select(F.col("least.id").alias("want")).distinct(), "wanted"))
            run, ddl = _sets(width)
            texts = plain.join(wanted, F.col("id").eqNullSafe(F.col("want")), "left_semi")
            sets = materialize(texts.select("text").mapInArrow(lean_rows(run), ddl).dropDuplicates(["node"]), "sets")
            return materialize(_confirmed(pairs, sets, percent), "links")

        links = confirmed(neighbour_pairs(nodes, percent / 100, min(FIRST_TREES, trees), trees))
        rooted = nodes.join(_joinable(connected_components(links)), "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = connected_components(links.union(confirmed(region_pairs(rooted, percent, trees))))

        # component by node first, so that rows of one text or one component are not gathered by it
        linked = roots.union(roots.select("root", "root").distinct())
        of_root = nodes.select("node", "least").join(linked, "node").groupBy("root").agg(F.min("least").alias("whole"))
        of_node = linked.join(_joinable(materialize(of_root, "component-ids")), "root").select("node", "whole")
        of_node = nodes.select("node", "least").join(of_node, "node", "left").select("node", F.coalesce("whole", "least").alias("least"))
        of_node = scope.keep(materialize(of_node, "node-ids"))  # read back, the next join stands alone and a text of many rows can be split
    told = signed.select("id", "mark", "n", "node").join(of_node, "node", "left").withColumn("found", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least.id")))
    first = F.col("node").isNull() | F.col("id").eqNullSafe(F.col("least.id")) & F.col("mark").eqNullSafe(F.col("least.mark"))
    kept = F.col("id").eqNullSafe(F.col("found")).alias("kept")
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("found").alias("component_id"), kept, *([F.col("mark").alias("text_mark"), first.alias("first")] if marks else []))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)
