import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import fingerprints, graph, near_dedup, substring_dedup

DOCS = "doc_id long, text string, node string, id int, hash string, mark string, next int, block int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, "h", "m", 2, 3) for i, t in rows], DOCS)


def crowd(seed, size, pairs):
    """Documents that are random 80% subsets of one pool of 400 words, and near copies (0.8 to 0.9) of some of them."""
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    rows = [r.sample(pool, 320) for _ in range(size)]
    for k in range(pairs):
        kept, away = list(rows[k]), [w for w in pool if w not in set(rows[k])]
        n = r.randint(17, 35)
        rows.append(kept[n:] + r.sample(away, n))
    r.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def near_model(rows, width):
    """Brute force over all pairs of rows."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                part[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(sets[k]), least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    r = random.Random(width)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, ident = [], 0
    for _ in range(30):
        base = r.choices(vocabulary, k=r.randint(60, 200))
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 3, 8])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((ident, r.choice([" ", "\n", " \t"]).join(copy)))
            ident += 1
    rows += [(ident, None), (ident + 1, ""), (ident + 2, " \n"), (ident + 3, "one"), (ident + 4, "ONE"), (ident + 5, "word " * 3000), (ident + 6, "A b c"), (ident + 7, "a B c"), (None, "a b c"), (None, "lone text of no id")]
    got = near_dedup.near_duplicates(docs(spark, rows), width)
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["doc_id"] == x["component_id"]) for x in got.collect()) == near_model(rows, width)


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_shingles_are_exact():
    sets = near_dedup.shingle_sets(pa.array(["a b a b a", "A  B", "b a", None, " x", "É é"]), 2)
    assert [len(s) for s in sets] == [2, 1, 1, 0, 1, 1]
    assert sets[1][0] in sets[0] and sets[2][0] in sets[0]


@pytest.mark.parametrize("hot", [10_000, 5])
def test_components_of_long_chains_and_stars(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "MOST_HOT", hot)
    r = random.Random(1)
    name = lambda k: f"{k * 7919 % 10007:05d}".encode()
    links = [(name(k), name(k + 1)) for k in range(300)] + [(name(1000), name(1001 + k)) for k in range(300)] + [(name(5000), name(5001))]
    r.shuffle(links)
    got = {bytes(x["node"]): bytes(x["root"]) for x in graph.connected_components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in links], "a binary, b binary").repartition(5)).collect()}
    for group in ([name(k) for k in range(301)], [name(1000 + k) for k in range(301)], [name(5000), name(5001)]):
        assert {got.get(x, x) for x in group} == {min(group)}


def test_neighbours_over_batches_and_sure_chains():
    row = lambda k: bytes([0]) + bytes(near_dedup.KEY - 1) + bytes([k]) * 16 + bytes(24)
    m = np.frombuffer(b"".join(row(k) for k in range(4)), np.uint8).reshape(-1, near_dedup.ROW)
    assert near_dedup._candidates(m, 3, 154, 185).tolist() == [[2, 3]]  # sure chains stand for longer steps
    far = near_dedup._candidates(m, 3, 154, 193)
    assert sorted(map(tuple, far.tolist())) == [(0, 3), (1, 3), (2, 3)]


def test_odd_sketches_never_show_too_many_differences():
    r = np.random.default_rng(4)
    for n, extra in ((5, 1), (150, 18), (150, 37), (3000, 700), (40_000, 9000)):
        one = near_dedup._mix(r.integers(0, 1 << 62, n).astype(np.uint64))
        two = np.concatenate([one[extra:], near_dedup._mix(r.integers(0, 1 << 62, extra).astype(np.uint64))])
        bits = np.bitwise_count(np.frombuffer(near_dedup.odd_sketch(one), np.uint8) ^ np.frombuffer(near_dedup.odd_sketch(two), np.uint8)).sum()
        assert bits <= 2 * extra and bits <= near_dedup.most_odd(np.array([2.0 * extra]))[0]
    assert near_dedup.most_odd(np.array([37.0]))[0] == 37.0


def near_pairs(width, r, n):
    """Pairs of texts whose shingle sets have a similarity of 0.80 to 0.85."""
    found = []
    while len(found) < n:
        words = [f"v{r.randrange(5000)}" for _ in range(r.randint(150, 260))]
        copy = list(words)
        for _ in range(r.randint(2, 14)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(5000)}"
        x, y = ({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (words, copy))
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            found.append((" ".join(words), " ".join(copy)))
    return found


@pytest.mark.parametrize("width", [2, 5])
def test_links_just_over_the_threshold_are_found(spark, width):
    r = random.Random(width)
    pairs = near_pairs(width, r, 300)
    rows = [(2 * k + j, p[j]) for k, p in enumerate(pairs) for j in (0, 1)]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs(spark, rows), width).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 297


def test_marks_name_one_text_of_each_component(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (None, "x y z"), (2, "k l m"), (2, "n o p"), (3, "K L m"), (None, None), (4, "")]
    got = near_dedup.near_duplicates(docs(spark, rows), 2, marks=True).collect()
    assert Counter(x["first"] for x in got if not x["n_shingles"]) == Counter({True: 2})
    by = Counter((x["doc_id"], x["component_id"], x["first"]) for x in got if x["n_shingles"])
    assert by == Counter({(None, 1, False): 2, (1, 1, True): 1, (None, None, True): 1, (2, 2, True): 2, (3, 2, False): 1})


# substring dedup


def units_model(text):
    """(start, stop, key) of each unit, word by word: a unit starts where the one before it has ended, blanks and all."""
    found, line_at = [], 0
    for line in text.split("\n"):
        words, start = [], line_at
        spots = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        for k, (a, b) in enumerate(spots):
            words.append(re.sub("[A-Z]", lambda m: m[0].lower(), line[a:b]))
            if k + 1 == len(spots) or len(words) >= 4 and line[b - 1] in ".!?,;:":
                found.append((start, tuple(words)))
                words, start = [], line_at + (spots[k + 1][0] if k + 1 < len(spots) else 0)
        line_at += len(line) + 1
    ends = [s for s, _ in found[1:]] + [len(text)] * bool(found)
    return [(s, e, w) for (s, w), e in zip(found, ends, strict=True)]


def cut_model(rows, least=35):
    """Each (id, text) in order of id without its long runs of units that were seen before."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: x[0]):
        t, run, gone = t or "", [], []
        for u in [*units_model(t), None]:
            if u and u[2] in seen:
                run.append(u)
                continue
            if sum(len(x[2]) for x in run) >= least:
                gone.append((run[0][0], run[-1][1]))
            run = []
            if u:
                seen.add(u[2])
        for a, b in reversed(gone):
            t = t[:a] + t[b:]
        out.append((i, t))
    return out


@pytest.mark.parametrize("hot", [10_000, 20])
def test_repeats_are_removed_and_offsets_kept(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "MOST_HOT", hot)
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgé", k=r.randint(1, 5))) + r.choice(["", "", "", ",", ".", "!"])
    passages = [" ".join(word() for _ in range(r.randint(30, 90))) for _ in range(8)]
    rows = []
    for k in range(120):
        parts = [" ".join(word() for _ in range(r.randint(1, 40)))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice([x, x.upper(), x.replace(" ", "\n", 3), f"  {x} "]) if "é" not in x else x for x in [r.choice(passages)]] + [" ".join(word() for _ in range(r.randint(0, 9)))]
        rows.append((k, r.choice([" ", "\n", "\n\n"]).join(parts)))
    rows += [(120, None), (121, ""), (122, "\n\n"), (123, "a b c d e f.\n" * 3000), (124, "word " * 30_000), (125, passages[0]), (126, passages[0])]
    got = substring_dedup.remove_repeats(docs(spark, rows), text_out="clean").orderBy("doc_id").collect()
    want = cut_model(rows)
    assert [(x["doc_id"], x["clean"]) for x in got] == want
    assert sum(t != (w or "") for (_, t), (_, w) in zip(rows, want, strict=True)) > 50
    for x, (_, text) in zip(got, rows, strict=True):
        left, at = [], 0
        for s in x["removed_spans"] or []:
            assert len(text[s["start"] : s["stop"]].split()) >= 35
            left.append(text[at : s["start"]])
            at = s["stop"]
        assert "".join([*left, (text or "")[at:]]) == x["clean"]
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_a_passage_inside_longer_lines_is_found(spark):
    passage = "Here a passage starts, which holds some sixty words. " + " ".join(f"p{k}{'.' if k % 9 == 8 else ''}" for k in range(52)) + "."
    rows = [(1, f"one text that says {passage} and goes on"), (2, f"quite another one with {passage} Its own end"), (3, "a common line of few words.\nx"), (4, "a common line of few words.\ny")]
    got = {x["doc_id"]: x for x in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "quite another one with Here a passage starts, Its own end"
    assert (got[3]["text"], got[4]["text"]) == (rows[2][1], rows[3][1])


def test_repeated_rows_and_null_ids_are_one_document(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, f"{long}\nx"), (1, f"{long}\nx"), (None, f"{long}\ny"), (1, f"other words of one id\n{long}")]
    got = Counter((x["doc_id"], x["text"]) for x in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    assert got == Counter({(1, "x"): 2, (None, f"{long}\ny"): 1, (1, "other words of one id\n"): 1})


def test_places_order_ids_and_hold_the_extremes(spark):
    ids = [None, -(2**63), -1, 0, 1, 2**63 - 1]
    got = docs(spark, [(i, "t") for i in ids]).select("doc_id", substring_dedup.place_of("doc_id", "text").alias("p")).orderBy("p").collect()
    assert [x["doc_id"] for x in got] == ids and len({x["p"] for x in got}) == len(ids)


# fingerprints


def test_canonical_form_folds_case_space_and_forms(spark):
    same = ["Straße  Å ﬁn", " STRASSE Å FIN\n", "strasse Å fin"]
    got = fingerprints.fingerprints(docs(spark, [*enumerate(same), (3, "strasse a fin"), (4, None), (5, ""), (6, " \t"), (None, "x" * 70_000)])).collect()
    by = {x["doc_id"]: x["fingerprint"] for x in got}
    assert by[0] == by[1] == by[2] != by[3] and by[4] == by[5] == by[6] and len(got) == 8


def test_equal_buckets_are_compared_by_bytes(spark):
    weak = lambda c: F.struct((F.length(c) % 3).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    texts = ["aa", "bb", "aa", "cccccc", "d", "dd dd", None, "aa"]
    got = {x["doc_id"]: x["fingerprint"] for x in fingerprints.fingerprints(docs(spark, [*enumerate(texts)]), hash_of=weak).collect()}
    assert got[0] == got[2] == got[7] and len({got[k] for k in (0, 1, 3, 4, 5, 6)}) == 6


def edit_model(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    out = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out[i] = t[: len(t) - q] + after[:q]
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_edited_texts(spark, monkeypatch, weak):
    monkeypatch.setattr(fingerprints, "ROWS_A_BLOCK", 5)
    r = random.Random(6)
    rows = [(k * k, r.choice(["", None, "é🙂" * r.randint(1, 30), "same text same text", "abc" * r.randint(0, 9)])) for k in range(40)]
    few = {"hash_of": lambda c: F.struct((F.length(c) % 4).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2"))} if weak else {}
    got = {x["doc_id"]: x for x in fingerprints.edited_fingerprints(docs(spark, rows), **few).collect()}
    want = edit_model(rows)
    canon = lambda t: " ".join((t or "").casefold().split())
    fp = {}
    for k, (i, t) in enumerate(rows):
        x = got[i]
        assert x["n_chars"] == len(t or "") and x["edited_sha256"] == hashlib.sha256(want[i].encode()).hexdigest()
        assert x["near_edited"] == float(canon(t) == canon(want[i])) and x["near_next"] == float(canon(t) == canon(rows[(k + 1) % len(rows)][1]))
        assert fp.setdefault(canon(t), x["fingerprint"]) == x["fingerprint"] and fp.setdefault(canon(want[i]), x["edited_fingerprint"]) == x["edited_fingerprint"]
    assert len(set(fp.values())) == len(fp)


def test_edited_texts_with_odd_ids(spark):
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(docs(spark, [(7, "abcdefgh")])).first()["n_chars"] == 8
    rows = [(None, "null id text"), (1, "twice"), (1, "twice"), (1, "other"), (2**40, "far")]
    assert fingerprints.edited_fingerprints(docs(spark, rows)).count() == 5


def test_rows_without_an_id_follow_each_other_once(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_A_BLOCK", 4)
    rows = [*[(None, f"text {k % 9}") for k in range(60)], *[(5, f"more {k % 3}") for k in range(20)], *[(k, "end") for k in range(10, 20)]]
    df = fingerprints.with_next(docs(spark, rows).select("doc_id", "text"), "doc_id", ["doc_id", "text"])
    ends = [(x["doc_id"], x["text"], x["next"]["doc_id"], x["next"]["text"]) for x in df.collect()]
    assert Counter((a, b) for a, b, _, _ in ends) == Counter((c, d) for _, _, c, d in ends) == Counter(rows)
    assert sum(a is None and c is not None for a, _, c, _ in ends) == 1 and sum(a == 5 and c != 5 for a, _, c, _ in ends) == 1


@pytest.mark.parametrize("weak", [False, True])
def test_many_copies_without_an_id_cost_no_more_than_rows_with_one(spark, weak):
    """The edited texts of copies are compared once, not with each other."""
    few = {"hash_of": lambda c: F.struct((F.length(c) % 4).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2"))} if weak else {}
    rows = spark.range(8000).select(F.when(F.col("id") % 8 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 8 == 0, F.concat(F.lit("row "), "id")).otherwise("the same text again").alias("text"))
    got = fingerprints.edited_fingerprints(rows, **few)
    same = got.where("doc_id IS NULL").groupBy("fingerprint").count().collect()
    assert got.count() == 8000 and [x["count"] for x in same] == [7000]


def test_copies_of_an_id_are_cut_as_one(spark):
    """Rows of one id and text have one place: their units are gathered once, however many they are."""
    passage = " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(1, f"one two three four. {passage}"), *[(None, f"five six seven eight. {passage} end of it")] * 3000, (2, passage)]
    got = substring_dedup.remove_repeats(docs(spark, rows)).groupBy("doc_id", "text").count().collect()
    assert sorted((x["doc_id"] is None, x["count"]) for x in got) == [(False, 1), (False, 1), (True, 3000)]
    assert sum("word59" in x["text"] for x in got) == 1


def test_ids_from_end_to_end_are_cut_evenly(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_A_BLOCK", 4)
    rows = [(-(2**63), "first of all"), *[(k, f"text number {k}") for k in range(40)], (2**62, "an outlier"), (2**63 - 1, "last of all")]
    want = edit_model(rows)
    df = fingerprints.with_next(docs(spark, rows).select("doc_id", "text"), "doc_id", ["doc_id", "text"])
    after = {x["doc_id"]: x["next"]["doc_id"] for x in df.collect()}
    ids = [i for i, _ in rows]
    assert after == dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    got = {x["doc_id"]: x["edited_sha256"] for x in fingerprints.edited_fingerprints(docs(spark, rows)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_every_two_roots_of_a_large_region_meet_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    r = random.Random(3)
    rows = []
    for region, (mains, others) in enumerate([(4, 3), (300, 1), (200, 35), (12, 60)]):
        n = mains + others
        rows += [(region, n, f"{region}-{k}".encode(), 7 if k < mains else 100 + r.randint(0, others)) for k in range(n)]
    at = near_dedup.spots(spark.createDataFrame([(a, b, bytearray(c), d) for a, b, c, d in rows], "region long, n long, node binary, rh long")).collect()
    root = {c: d for _, _, c, d in rows}
    held, met = {}, Counter()
    for x in at:
        held.setdefault((x["region"], x["first"], x["second"]), []).append((bytes(x["node"]), x["own"]))
    for (_, first, second), nodes in held.items():
        for i, (a, own_a) in enumerate(nodes):
            for b, own_b in nodes[:i]:
                if root[a] != root[b] and (first == second or own_a != own_b):
                    met[min(a, b), max(a, b)] += 1
    want = {(min(a, b), max(a, b)) for i, (ra, _, a, da) in enumerate(rows) for rb, _, b, db in rows[:i] if ra == rb and da != db}
    assert set(met) == want and set(met.values()) == {1}
    assert sum(x["region"] == 1 for x in at) <= 300 + 1 + 31  # the main root's rows are there once


@pytest.mark.parametrize(("crowd_size", "block"), [(512, 1024), (24, 1024), (8, 16)])
def test_near_duplicates_in_a_crowded_region(spark, monkeypatch, crowd_size, block):
    monkeypatch.setattr(near_dedup, "CROWD", crowd_size)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = crowd(3, 1000, 100)
    held = np.zeros((len(rows), 400), np.float32)
    for k, (_, text) in enumerate(rows):
        held[k, [int(w[1:]) for w in text.split()]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    near = np.triu(100 * both >= 80 * (n[:, None] + n - both), 1)
    gone = set(np.flatnonzero(near.any(axis=0)).tolist())
    got = {x.doc_id for x in near_dedup.near_duplicates(docs(spark, rows), width=1, percent=80).where("NOT kept").collect()}
    assert len(gone) == 100 and not got - gone and len(got) >= 99
