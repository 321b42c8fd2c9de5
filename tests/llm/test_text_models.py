import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontamination, linear, quality, queries, sentencepiece_codec, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, p string, score int, items int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s1", len(t) if t else None, "p", 1, 2) for i, t in rows], DOCS)


# decontamination


def hit_model(text, items, size):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    w, hit, found = find(text), set(), set()
    for i, t in items:
        x = find(t)
        n = min(size, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_nodes", [decontamination.BLOCK_NODES, 60])
def test_contamination_equals_brute_force(spark, block_nodes):
    r = random.Random(3)
    word = lambda: r.choice(["a", "B", "cé", "dd", "日本"])
    items = [(k, r.choice([" ", "-"]).join(word() for _ in range(r.randint(1, 7)))) for k in range(12)] + [(3, "a b a"), (99, None), (None, "a"), (100, "?!")]
    rows = [(k, r.choice([" ", ", ", "_"]).join(word() for _ in range(r.randint(0, 40)))) for k in range(60)] + [(60, None), (61, ""), (62, "a " * 20_000), (None, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    live = [(i, t) for i, t in items if i is not None and t is not None]
    for x in decontamination.find_contamination(docs(spark, rows), bench, window=4, block_nodes=block_nodes).where("doc_id < 62 OR doc_id IS NULL").collect():
        text, c = x["text"], x["contamination"]
        want = hit_model(text, live, 4)
        assert (c["n_words"], c["n_hit"], c["items"]) == want
        assert sum(len(decontamination.words(text[s["start"] : s["end"]])) for s in c["spans"]) == want[1]
        assert all(decontamination.words(text[s["start"] : s["end"]]) for s in c["spans"])


def test_pieces_of_long_texts_overlap(monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 7)
    r = random.Random(12)
    word = lambda: r.choice(["a", "b", "c"])
    items = [(str(k), " ".join(word() for _ in range(r.randint(1, 12)))) for k in range(25)]
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(80)] + [None, "?!"]
    a = decontamination.Automaton(items, 6)
    for t, x in zip(texts, decontamination.scan(pa.array(texts, pa.string()), a), strict=True):
        assert (x["n_words"], x["n_hit"], x["items"]) == hit_model(t, items, 6), t


def test_an_automaton_takes_17_bytes_a_node():
    r = random.Random(13)
    items = [(str(k), " ".join(f"word{r.randrange(5000)}" for _ in range(400))) for k in range(200)]
    a = decontamination.Automaton(items, 10)
    arrays = a.keys.nbytes + a.fail.nbytes + a.cover.nbytes + a.link.nbytes
    text = sum(len(t) for _, t in items)
    assert len(a.keys) <= 10 * 200 * 400 and arrays <= 18 * (len(a.keys) + 1) and arrays < 25 * text


def test_empty_benchmark_and_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(docs(spark, [(1, "a b")]), none).first()["contamination"]["n_hit"] == 0
    assert decontamination.find_contamination(docs(spark, []), none).count() == 0


# SentencePiece


def texts():
    r = random.Random(4)
    alphabet = "ab e th▁ \n日é0-.,ing🙂\t\x00"
    fixed = ["", " ", "  ", "a  b", "   x", "▁", "a▁b", "é" * 40, " " * 37 + "z", "don’t — “q”", "🙂 🙂🙂  a", "x" * 3000, "the " * 5000]
    return fixed + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 50))) for _ in range(1500)] + [" " * k + w for k in range(40) for w in ("the", "日")]


def test_ids_equal_the_library():
    import sentencepiece

    model, library, cases = sentencepiece_codec.load(sentencepiece_codec.MODEL), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL), texts()
    for t, got, want in zip(cases, sentencepiece_codec.encode_batch(model, cases), library.encode(cases), strict=True):
        assert list(got) == want, t
        assert sentencepiece_codec.decode_ids(model, got) == library.decode(want)


@pytest.mark.parametrize(("long", "block", "warm"), [(4096, 1024, 128), (40, 20, 17), (30, 64, 16)])
def test_long_words_equal_the_library(monkeypatch, long, block, warm):
    """Also blocks that do not meet the path of those before them, as in runs of one character."""
    import sentencepiece

    for name, value in (("LONG_WORD", long), ("WORD_BLOCK", max(block, 16)), ("WARM_UP", warm), ("BLOCKS_AT_ONCE", 7 if long < 4096 else 1024)):
        monkeypatch.setattr(sentencepiece_codec, name, value)
    model, library = sentencepiece_codec.Model(open(sentencepiece_codec.MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r, n = random.Random(long), 60_000 if long == 4096 else 700
    some = lambda letters: "".join(r.choices(letters, k=n + r.randrange(50)))
    cases = [some("abcdefghij"), "a" * n, "xy" * n, some(["the", "of", "ing", "tion"]), some("日本語中文"), some("0123456789"), some("éß日a\x01🙂"), "-" * n, f"a{' ' * n}b", f"in {'=' * n}{some('ab')} out", "q" * long, "q" * (long + 1)]
    for t, got in zip(cases, sentencepiece_codec.encode_batch(model, cases), strict=True):
        assert list(got) == library.encode(t), (len(t), t[:20])


def test_a_million_characters_without_a_blank():
    import time

    model = sentencepiece_codec.load(sentencepiece_codec.MODEL)
    r = random.Random(8)
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    began = time.process_time()
    ids = sentencepiece_codec.encode_batch(model, [text])[0]
    assert time.process_time() - began < 60 and sentencepiece_codec.decode_ids(model, ids) == text


def test_unigram_paths_have_the_greatest_score():
    model = sentencepiece_codec.Model(open(sentencepiece_codec.MODEL, "rb").read())
    model.model_type = sentencepiece_codec.UNIGRAM
    r = random.Random(7)
    words = ["▁" + "".join(r.choices("thernisao", k=r.randint(1, 9))) for _ in range(300)] + ["▁日x", "▁🙂"]
    worth = lambda p: model.scores[model.by_text[p]] if p in model.by_text else model.unknown_score if len(p) == 1 else -np.inf
    for w, ids in model.encode_words(words).items():
        best = [0.0]
        for end in range(1, len(w) + 1):
            best.append(max(best[k] + worth(w[k:end]) for k in range(max(0, end - 16), end)))
        pieces = [model.pieces[i] for i in np.frombuffer(ids, np.int32)]
        if not any(p.startswith("<0x") for p in pieces):
            assert abs(sum(map(worth, pieces)) - best[-1]) < 1e-9, w


def test_pairs_are_judged_as_merging_does():
    model = sentencepiece_codec.load(sentencepiece_codec.MODEL)
    r = np.random.default_rng(2)
    short = np.flatnonzero((model.kinds == sentencepiece_codec.NORMAL) & (model.lengths <= 4) & model.in_order)
    a, b = r.choice(short, 20_000), r.choice(short, 20_000)
    a[:200] = b[:200]  # equal pieces: ties are merged from the left
    said = model._stay_apart(a, b)
    assert 0 < said.mean() < 1
    for x, y, apart in zip(a.tolist(), b.tolist(), said.tolist(), strict=True):
        one, two = model.pieces[x], model.pieces[y]
        assert (model.merged(one + two) == [one, two]) == apart, (one, two)


def test_each_text_is_encoded_once(spark):
    plan = queries.queries()["op6_sentencepiece"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ArrowEvalPython \[(\w+)\(", plan) == ["both"], plan


def test_cached_words_change_nothing(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MOST_CACHED_WORDS", 10)
    with open(sentencepiece_codec.MODEL, "rb") as f:
        raw = f.read()
    small, cases = sentencepiece_codec.Model(raw), texts()[:400]
    want = [list(x) for x in sentencepiece_codec.encode_batch(sentencepiece_codec.load(sentencepiece_codec.MODEL), cases)]
    assert [list(sentencepiece_codec.encode_batch(small, [t])[0]) for t in cases] == want


def test_round_trip_in_spark(spark):
    cases = [None, "", "Hello  world\n", "日本 🙂", "a" * 5000, "a" * 5000]
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs(spark, [*enumerate(cases)])))
    got = both.orderBy("doc_id").collect()
    assert [x["decoded"] for x in got] == [t or "" for t in cases] and got[0]["ids"] == []
    once = sentencepiece_codec.encode_and_decode(docs(spark, [*enumerate(cases)])).orderBy("doc_id").collect()
    assert [(x["encoded"]["ids"], x["encoded"]["decoded"]) for x in once] == [(x["ids"], x["decoded"]) for x in got]
    assert sentencepiece_codec.encode_and_decode(docs(spark, [])).count() == 0
    assert sentencepiece_codec.encode(docs(spark, [])).count() == 0


# models


def test_cumulative_link_model_learns_an_order():
    r = np.random.default_rng(1)
    n, wide = 3000, 40
    x = r.poisson(0.4, (n, wide)).astype(float)
    z = 1.5 * x[:, 0] + 1.0 * x[:, 1] - 1.2 * x[:, 2] + r.logistic(size=n)
    y = (z > 0.5).astype(int) + (z > 2) + (z > 3.5)
    rows, slots = np.nonzero(x)
    m = linear.fit_ordinal(rows, slots, x[rows, slots], y, 4, size=wide)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[0] > 1.0 > m.weights[2] and np.abs(m.weights[3:]).max() < 0.3
    p = m.at_least(m.scores(rows, slots, x[rows, slots], n))
    assert (np.diff(p, axis=1) <= 0).all() and np.corrcoef(p.sum(axis=1), y)[0, 1] > 0.5
    assert abs(p[:, 0].mean() - (y >= 1).mean()) < 0.05


def tokens_model(text):
    """Words and shapes of a text, byte by byte."""
    raw = (text or "").encode()
    word = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in raw).split()
    split = raw.split()
    drawn = []
    for t in split:
        kinds = [97 if c >= 128 or chr(c).isalpha() else 48 if 48 <= c <= 57 else c for c in t]
        drawn.append(bytes(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]))
    return word, drawn, sum(a == b for a, b in zip(split, split[1:], strict=False))


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_tokens_equal_a_plain_split(monkeypatch, piece):
    monkeypatch.setattr(linear, "PIECE", piece)
    r = random.Random(4)
    bits = ["Ab", "é", "12", "##", " ", "  ", "\n", "x-y", "日本", ".", "aa", "the the", "the"]
    texts = [None, "", " ", "a" * 300, *["".join(r.choices(bits, k=r.randint(0, 40))) for _ in range(200)]]
    one = lambda raw, seed: int(linear._slots(linear._hashes(np.frombuffer(raw, np.uint8), np.array([0]), seed))[0])
    array = pa.concat_arrays([pa.array(["skipped"]), pa.array(texts, pa.string())]).slice(1)
    rows, slots, count = linear.tokens_of(array, True, True)
    for k, t in enumerate(texts):
        word, drawn, same = tokens_model(t)
        want = [one(w, 1) for w in word] + [one(d, 2) for d in drawn] + [linear._SAME] * same
        assert sorted(slots[rows == k].tolist()) == sorted(want) and count[k] == max(len(word), len(drawn)), t


def corpus(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        bad, junk = r.random() < 0.2, r.random() < 0.25
        w = [f"w{r.randint(0, 300)}" for _ in range(r.randint(30, 90))]
        if bad:
            for at in range(0, len(w), r.choice([8, 12, 20])):
                w[at] = r.choice(["vile", "awful", "nasty"])
        if junk:
            w = [x + r.choice(["###", "%%%"]) for x in w]
        rows.append((k, " ".join(w)))
        labels.append((k, 0 if junk else 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus(900, 1)
    train = spark.createDataFrame([*labels[:600], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), train)
    got = {x["doc_id"]: x["severity"] for x in toxicity.severity(docs(spark, [*rows, (9000, None), (9001, "")]), model).collect()}
    said = [got[k]["toxic"] == bool(t) for k, _, t in labels[600:]]
    assert sum(said) / len(said) > 0.97 and got[9000] == got[9001] and not got[9000]["toxic"]
    assert all(abs(sum(x["p"]) - x["expected"]) < 1e-9 for x in got.values())
    assert toxicity.severity(docs(spark, []), model).count() == 0


def test_the_cut_parts_scores_and_keeps_ties_together():
    cut = toxicity.best_cut(np.array([0.0, 0.0, 1.0, 2.0, 2.0]), np.array([False, False, True, True, True]))
    assert cut == 0.5
    assert toxicity.best_cut(np.array([1.0, 1.0]), np.array([True, False])) == float("inf")
    assert toxicity.best_cut(np.zeros(0), np.zeros(0, bool)) == float("inf")


def test_toxicity_without_toxic_labels(spark):
    rows, labels = corpus(40, 2)
    for some in ([(k, q, 0) for k, q, _ in labels], []):
        model = toxicity.fit(docs(spark, rows), spark.createDataFrame(some, "doc_id long, quality int, toxic int"))
        assert len({x["severity"]["expected"] for x in toxicity.severity(docs(spark, rows), model).collect()}) == 1


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus(900, 3)
    train = spark.createDataFrame([*labels[:500], (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, rows), train)
    odd = docs(spark, [(9000, None), (9001, "")])
    got = {x["doc_id"]: x["quality_score"]["score"] for x in quality.score(docs(spark, rows).union(odd), model).collect()}
    said = [(got[k] >= 0.5) == bool(q) for k, q, _ in labels[500:]]
    assert sum(said) / len(said) > 0.97 and len(got) == 902
    assert quality.score(docs(spark, []), model).count() == 0


def plain_features(text, words, shapes, share):
    """slot: value of one text, token by token."""
    one = lambda raw, seed: int(linear._slots(linear._hashes(np.frombuffer(raw, np.uint8), np.array([0]), seed))[0])
    word, drawn, same = tokens_model(text)
    n = Counter(([one(w, 1) for w in word] if words else []) + ([one(d, 2) for d in drawn] + [linear._SAME] * same if shapes else []))
    total = max(len(word) if words else 0, len(drawn) if shapes else 0, 1)
    return {k: math.sqrt(c / total) if share else math.log1p(c) for k, c in n.items()}


def test_scores_equal_a_plain_sum(spark):
    """Whole queries' scores, one document at a time from the fitted weights."""
    rows, labels = corpus(600, 5)
    rows += [(9000, None), (9001, ""), (9002, "vile " * 3000 + "ok"), (None, rows[0][1])]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    logistic = lambda z: 1 / (1 + math.exp(-z))
    model = toxicity.fit(df, told)
    for x in toxicity.severity(df, model).collect():
        z = sum(model.model.weights[k] * v for k, v in plain_features(x["text"], True, False, False).items())
        want = [logistic(z - t) for t in model.model.thresholds]
        assert np.allclose(x["severity"]["p"], want) and math.isclose(x["severity"]["expected"], sum(want)) and x["severity"]["toxic"] == (z >= model.cut)
    q = quality.fit(df, told)
    for x in quality.score(df, q).collect():
        t = sum(q.text.weights[k] * v for k, v in plain_features(x["text"], True, True, True).items())
        _, slots, _ = quality.meta_features([x["source"]], [x["lang"]], [x["n_chars"]])
        a, b = q.text_fit[0] * t + q.text_fit[1], q.meta_fit[0] * sum(q.meta.weights[k] for k in slots) + q.meta_fit[1]
        assert np.allclose(tuple(x["quality_score"]), (logistic(a), logistic(b), logistic(a + b - q.prior)), atol=1e-9)


def test_quality_without_labels(spark):
    rows, _ = corpus(30, 4)
    model = quality.fit(docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len({round(x["quality_score"]["score"], 9) for x in quality.score(docs(spark, rows), model).collect()}) == 1


def test_the_metadata_view_helps():
    r = np.random.default_rng(5)
    n = 2000
    good = r.random(n) < 0.5
    label = np.where(np.arange(n) < 800, good.astype(int), -1)
    text = np.where(good ^ (r.random(n) < 0.3), 1, 2)
    source = np.where(good ^ (r.random(n) < 0.1), "a", "b")
    meta = quality.meta_features(source.tolist(), ["x"] * n, [None] * n)
    words, none = (np.arange(n), text.astype(np.int64), np.ones(n)), np.full(n, -1)
    given = (none, none)
    for _ in range(3):  # each view labels the rows that it is sure about for the other
        m = quality.fit_views(label, *given, words, meta)
        p_text, p_meta, _ = m.combine(m.text.scores(*words, n), m.meta.scores(*meta, n))
        given = (quality.lent(p_meta), quality.lent(p_text))
    t, s, both = m.combine(m.text.scores(np.arange(n), text, np.ones(n), n), m.meta.scores(*meta, n))
    right = lambda p: ((p >= 0.5) == good)[800:].mean()
    assert right(both) >= right(t) + 0.1 and right(both) >= right(s) - 0.01


def test_lessons_add_up_all_confident_rows(spark):
    """Sums of a pass over all documents against rows taken one by one."""
    rows, labels = corpus(1500, 9)
    rows += [(None, rows[0][1]), (9000, None), rows[1]]
    df = docs(spark, rows)
    model = quality.fit(df, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int"), rounds=1)
    told, wanted = np.array([k for k, _, _ in labels[:400]]), model.text.weights != 0
    got = quality.lessons(df, model, wanted, told)
    scored = [x for x in quality.score(df, model, out="q").collect() if x["doc_id"] is None or x["doc_id"] not in set(told.tolist())]
    for view, p in ((got.text, "p_meta"), (got.meta, "p_text")):
        lent = quality.lent(np.array([x["q"][p] for x in scored]))
        y, n, _ = view
        assert n[y == 1].sum() == (lent == 1).sum() and n[y == 0].sum() == (lent == 0).sum()
    taught = [x for x, y in zip(scored, quality.lent(np.array([x["q"]["p_meta"] for x in scored])), strict=True) if y >= 0]
    want = Counter()
    for x in taught:
        want.update(plain_features(x["text"], True, True, True))
    assert set(np.flatnonzero(got.sums[0])) == set(want) and all(math.isclose(got.sums[1][k], v, abs_tol=1e-4) for k, v in want.items())
    y, n, (r, s, v) = got.text
    sums = np.bincount(s, v * n[r], minlength=1 << linear.BITS)
    assert np.allclose(sums, np.where(wanted, got.sums[1], 0), atol=1e-6)


def test_a_fit_does_not_depend_on_how_often_a_corpus_is_repeated(spark):
    rows, labels = corpus(900, 10)
    told = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    unlabelled = [(k + 10_000 * c, x) for c in range(1, 6) for k, x in rows[200:]]
    once, often = (quality.fit(docs(spark, x), told) for x in (rows, rows + unlabelled))
    a, b = ({x["doc_id"]: x["quality_score"]["score"] for x in quality.score(docs(spark, rows), m).collect()} for m in (once, often))
    assert sum((a[k] >= 0.5) == (b[k] >= 0.5) for k in a) >= 0.99 * len(a)


def test_a_source_without_labels_is_learnt(spark):
    """Labels cover one source only; another one's documents are told by their words, and a third, always bad, by metadata."""
    r = random.Random(8)
    rows, good = [], {}
    for k in range(4500):
        source = ("told", "untold", "junkyard")[k % 3]
        good[k] = source != "junkyard" and r.random() < 0.7
        w = [f"w{r.randint(0, 200)}" for _ in range(40)]
        rows.append((k, " ".join(w if good[k] else [x + r.choice(["###", "%%%"]) for x in w]), "en", source, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(good[k]), 0) for k in range(0, 3600, 3)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    slot = lambda s: int(quality.meta_features([s], [None], [None])[1][0])
    assert model.meta.weights[slot("junkyard")] < 0
    got = {x["doc_id"]: x["quality_score"]["score"] for x in quality.score(df, model).collect()}
    assert sum((got[k] >= 0.5) == good[k] for k in good) / len(good) > 0.98


def test_repeated_ids_and_clashing_columns(spark):
    rows, labels = corpus(200, 6)
    twice = docs(spark, [*rows, *[(0, f"other text {k}") for k in range(50)]]).withColumn("severity", F.lit(1)).withColumn("quality_score", F.lit("x"))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert linear.one_row_an_id(twice.select("doc_id", "text", "source")).count() == 200
    out = toxicity.severity(twice, toxicity.fit(twice, told))
    assert out.count() == 250 and out.schema["severity"].dataType.typeName() == "struct"
    assert quality.score(twice, quality.fit(twice, told)).schema["quality_score"].dataType.typeName() == "struct"
