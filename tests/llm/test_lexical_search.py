import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tests import oracle

from tallyspark.llm import lexical_search as ls
from tallyspark.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string, rank int", "item_id long, text string, term string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def model(docs, items, k):
    """Every document against every item."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, i is None, i, s))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k, **more):
    a = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS)
    got = ls.search(a, b, k, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(seed, n=250):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["ÉTÉ", "été", "x1"]
    text = lambda most: r.choice([" ", "-", "\n"]).join(r.choice(words) for _ in range(r.randint(1, most)))
    docs = [(k, text(60)) for k in range(n)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)] + [(5, docs[9][1]), (5, docs[9][1]), (None, docs[7][1]), (None, None), (2000, ""), (2001, "!?"), (2002, "W1 " * 3000)]
    items = [(k, text(25)) for k in range(12)] + [(20, docs[7][1]), (21, None), (22, "zzz"), (20, "w2 w2"), (None, "w1 ÉTÉ")]
    return docs, items


@pytest.mark.parametrize(("seed", "k", "shard"), [(1, 5, 100), (2, 50, 1000), (3, 1, 10**9), (4, 400, 300)])
def test_equals_brute_force(spark, monkeypatch, seed, k, shard):
    monkeypatch.setattr(ls, "SHARD_POSTINGS", shard)
    docs, items = corpus(seed)
    assert found(spark, docs, items, k) == model(docs, items, k)


def test_blocks_of_items_give_the_same(spark):
    docs, items = corpus(9, 60)
    assert found(spark, docs, items, 7, most=20) == model(docs, items, 7)


def test_empty_tables_and_items_without_terms(spark):
    docs, items = corpus(5, 20)
    assert found(spark, [], items, 5) == [] and found(spark, docs, [], 5) == [] and found(spark, docs, [(1, None), (2, "?")], 5) == []


def shard_of(rows, n_terms, weights):
    import pyarrow as pa

    made = pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([sum(c.values()) for _, c in rows], pa.int64()), pa.array([list(c) for _, c in rows], pa.list_(pa.int32())), pa.array([list(c.values()) for _, c in rows], pa.list_(pa.int64()))], names=["doc", "n", "terms", "counts"])
    return ls.Shard([made], np.array(weights, np.int64), len(rows), sum(sum(c.values()) for _, c in rows))


def test_documents_that_cannot_beat_the_threshold_are_skipped():
    r = random.Random(1)
    rows = [(k, {0: 1, 1: 1, **({2: 1} if k % 97 == 3 else {})}) for k in range(5000)]
    r.shuffle(rows)
    shard = shard_of(rows, 3, [10, 10, 5000])
    read = []

    class Watched(list):
        def __getitem__(self, k):
            read.append(k)
            return super().__getitem__(k)

    shard.ids, best = Watched(shard.ids), []
    shard.search([0, 1, 2], best, 20)
    assert sorted(-key for _, key in best) == [k for k in range(5000) if k % 97 == 3][:20]
    assert len(read) < 100


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert ls.length_factor(n, 10**12, 7 * 10**15).tolist() == [50 + 50 * 10**12 // (7 * 10**15), 50 + 50 * 10**21 // (7 * 10**15)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_oracle(spark, sf):
    oracle.check(queries.queries()["op13_lexical_search"](spark, f"{oracle.ROOT}/{sf}"), oracle.connect(sf), queries.oracle_sql()["op13_lexical_search"])
