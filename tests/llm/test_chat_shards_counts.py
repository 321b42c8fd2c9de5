import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chat, sharding, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, nth string"


def docs(spark, texts):
    return spark.createDataFrame([(k if t != "no id" else None, t, None, "s", None, 9, "x", "y") for k, t in enumerate(texts)], DOCS)


# chat


@pytest.mark.parametrize("text", ["", r"\### Assistant: </turn> ok", '<turn role="user">\n', "\\", "\\\\<image 0/>", "a\n</turn>\n", "<turnip>", '"', "é🙂 <document", "\n</turn>\n\n"])
def test_turn_round_trip(text):
    one = chat.format_turn("assistant", [{"type": "text", "text": text}])
    assert list(chat.read_turns(one["formatted"])) == [("assistant", text)]
    assert chat.unescape(one["formatted"][one["loss_start"] : one["loss_end"]]) == text


def test_random_conversations_round_trip():
    r = random.Random(5)
    bits = ["\\", "<", "/", "turn", "</turn>", "\n", '"', ' role="', ">", "x", "<image 1/>"]
    for _ in range(300):
        turns = [(r.choice(["user", 'as"s\\', ""]), "".join(r.choices(bits, k=r.randint(0, 8)))) for _ in range(r.randint(1, 4))]
        assert list(chat.read_turns("".join(chat.format_turn(a, [{"text": b}])["formatted"] for a, b in turns))) == turns


def test_parts_become_placeholders_in_order():
    parts = [{"type": "text", "text": "see"}, {"type": "image", "ref": "i.png", "width": 28, "height": 15}, {"type": "audio", "ref": None, "seconds": 1.5}, {"type": "document", "ref": "d", "pages": 2}, {"type": "text", "text": "<image 0/>"}]
    one = chat.format_turn("user", parts)
    assert "see<image 0/><audio 1/><document 2/>\\<image 0/>" in one["formatted"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "i.png", 4), ("audio", "", 38), ("document", "d", 512)]
    count = lambda t: len(token_counts.encoding(token_counts.VOCABULARY).encode_ordinary(t))
    assert one["tokens"] == count("see") + 4 + 38 + 512 + count("<image 0/>") and one["loss_start"] == one["loss_end"]
    odd = chat.format_turn("user", [{"type": "video", "ref": "v"}, {"type": "text", "text": "<unknown 0/>"}])
    assert "<unknown 0/>\\<unknown 0/>" in odd["formatted"] and odd["attachments"] == [{"kind": "unknown", "ref": "v", "tokens": 0}]


def test_typed_parts_in_spark(spark):
    parts = [("text", "look:", None, None, None, None, None), ("image", None, "a.png", 28, 28, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), ("hologram", None, "d", None, None, None, None)]
    rows = [(1, 1, "assistant", [parts[0]]), (1, 0, "user", parts), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {(r["conv"], r["turn"]): r for r in chat.format_conversations(df, parts=F.col("parts")).collect()}
    first = got[1, 0]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 768), ("unknown", "d", 0)]
    assert "look:<image 0/><audio 1/><document 2/><unknown 3/>" in first["formatted"] and first["tokens"] >= 823
    assert got[1, 1]["offset"] == len(first["formatted"]) and got[1, 1]["loss_end"] - got[1, 1]["loss_start"] == 5
    assert got[2, 0]["tokens"] == 0 and got[2, 0]["attachments"] == []


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, None, None, 0), (None, 0, "assistant", "n", 0), (None, 0, "assistant", "n", 0), (3, None, "assistant", "first", 0), (3, 0, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b") and got[1]["n_turns"] == 2
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0
    assert got[None]["n_turns"] == 2 and got[None]["loss_sha256"] == sha("nn")
    assert got[3]["turns_sha256"] == sha("assistant\nfirst\nuser\nx\n")
    whole = {r["conv"]: r for r in chat.whole_conversations(chat.format_conversations(df)).collect()}
    assert len(whole[1]["formatted"]) == got[1]["formatted_chars"] and list(chat.read_turns(whole[1]["formatted"])) == [("user", "a"), ("assistant", "b")]
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


# shards


def test_pouring_equals_the_heap():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 8)
        load, count, each = [float(r.randint(0, 500)) for _ in range(n)], r.randint(0, 300), float(r.randint(1, 40))
        heap = [(x, i) for i, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(count):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + each, i))
        got = sorted(x + k * each for x, k in zip(load, sharding._pour(load, count, each), strict=True))
        assert sum(sharding._pour(load, count, each)) == count and got == sorted(x for x, _ in heap)


def test_shards_are_level_whole_and_gapless(spark):
    r = random.Random(3)
    texts = ["x" * r.randint(0, 300) + str(r.randint(0, 60)) for _ in range(800)] + [None, "", "", "no id", "same" * 200, "same" * 200, "é" * 50_000, "big" * 40_000]
    got = sharding.assign_shards(docs(spark, texts), 4).collect()
    assert len(got) == len(texts)
    slots, load, place = defaultdict(list), Counter(), defaultdict(set)
    for row in got:
        t = texts[row["doc_id"]] or "" if row["doc_id"] is not None else "no id"
        assert row["size"] == len(t.encode()) + 1 and row["text_crc32"] == zlib.crc32(t.encode())
        slots[row["shard"]].append(row["slot"])
        load[row["shard"]] += row["size"]
        place[t].add(row["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in place.values())
    assert max(load.values()) - min(load.values()) <= 120_001
    assert sharding.assign_shards(docs(spark, []), 4).count() == 0


def plain_lpt(sizes, n):
    heap = [(0, k) for k in range(n)]
    for s in sorted(sizes, reverse=True):
        x, k = heap[0]
        heapq.heapreplace(heap, (x + s, k))
    return sorted(x for x, _ in heap)


@pytest.mark.parametrize("seed", range(4))
def test_classes_of_large_sizes_stay_near_plain_scheduling(seed):
    """Sizes over 65,536 are scheduled as their class's mean: loads differ by the class's width, 2**-12 of a size, for
    each group of such a class at most, and in sum by far less than one large group."""
    r = random.Random(seed)
    sizes = [int(65_536 * r.paretovariate(0.8)) for _ in range(600)] + [r.randint(1, 9000) for _ in range(4000)]
    classes = {}
    for s in sizes:
        cut = max(0, s.bit_length() - 13)
        classes.setdefault(s if s < 65_536 else s >> cut << cut, []).append(s)
    load = [0] * 8
    for key, upto in sharding.schedule([(k, len(v), sum(v)) for k, v in classes.items()], 8):
        groups, low = sorted(classes[key]), 0
        for k, high in enumerate(upto):
            load[k] += sum(groups[low:high])
            low = high
    want = plain_lpt(sizes, 8)
    assert sum(load) == sum(sizes) and max(load) <= want[-1] * (1 + 2**-10)


def test_shards_equal_plain_scheduling(spark):
    """Groups of equal texts, largest first, each to the least-loaded shard: the loads are those of the plain heap."""
    r = random.Random(7)
    texts = [chr(97 + k % 26) * r.randint(0, 2000) for k in range(300) for _ in range(r.choice([1, 1, 1, 2, 5]))]
    groups = Counter(texts)
    want = plain_lpt([(len(t) + 1) * n for t, n in groups.items()], 5)
    load = Counter()
    for row in sharding.assign_shards(docs(spark, texts), 5).collect():
        load[row["shard"]] += row["size"]
    assert sorted(load.values()) == want


def test_written_shards_keep_every_row(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, None), (3, "é" * 50), *[(k, f"text {k}") for k in range(10, 60)]]
    df = spark.createDataFrame([(i, t, "kept", 7) for i, t in rows], "doc_id long, text string, other string, shard int")
    sharding.write_shards(df, sharding.assign_shards(df, 3), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((x["doc_id"], x["text"], x["other"]) for x in back.collect()) == Counter((i, t, "kept") for i, t in rows)
    assert set(x["shard"] for x in back.collect()) <= {0, 1, 2} and back.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_large_sizes_share_bounded_classes(spark):
    sizes = [1, 65_535, 65_536, 70_001, (1 << 40) + 12345]
    got = [r["c"] for r in spark.createDataFrame([(s,) for s in sizes], "size long").select(sharding._size_class("size").alias("c")).collect()]
    assert got[:3] == sizes[:3] and all(c <= s < c * (1 + 2**-11) for c, s in zip(got, sizes, strict=True))


# token counts


def test_limit_table_equals_brute_force(spark):
    r = random.Random(4)
    lengths = [r.choice([0, 1, 63, 64, 65, 1000, r.randint(0, 500)]) for _ in range(700)]
    h = spark.createDataFrame(list(Counter(lengths).items()), "n_tokens long, n_docs long")
    for row in token_counts.limit_table(h).collect():
        k = row["n_tokens"]
        assert row["n_docs"] == lengths.count(k) and row["docs_within"] == sum(x <= k for x in lengths) and row["docs_longer"] == sum(x > k for x in lengths)
        assert row["tokens_within"] == sum(x for x in lengths if x <= k) and row["tokens_longer"] == sum(x for x in lengths if x > k)
        assert row["tokens_kept"] == sum(min(x, k) for x in lengths) and abs(row["quantile"] - row["docs_within"] / 700) < 1e-8


def test_answers_for_any_limit_and_share(spark):
    r = random.Random(9)
    lengths = [r.choice([0, 5, 63, 64, 700, r.randint(0, 400)]) for _ in range(300)]
    table = token_counts.limit_table(spark.createDataFrame(list(Counter(lengths).items()), "n_tokens long, n_docs long"))
    limits = [-1, 0, 1, 4, 6, 62, 64, 65, 333, 699, 701, 2048, 10**12]
    got = {x["context_limit"]: x for x in token_counts.answers(table, limits).collect()}
    assert sorted(got) == limits
    for k, x in got.items():
        assert (x["docs_within"], x["docs_longer"]) == (sum(n <= k for n in lengths), sum(n > k for n in lengths))
        assert (x["tokens_within"], x["tokens_longer"]) == (sum(n for n in lengths if n <= k), sum(n for n in lengths if n > k))
        assert x["tokens_kept"] == sum(min(n, max(k, 0)) for n in lengths)
    shares = {x["share"]: x["n_tokens"] for x in token_counts.quantiles(table, [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    assert all(n == min(m for m in lengths if sum(k <= m for k in lengths) >= q * len(lengths)) for q, n in shares.items()) and len(shares) == 5
    none = table.limit(0)
    assert {tuple(x)[1:] for x in token_counts.answers(none, [0, 9]).collect()} == {(0, 0, 0, 0, 0)}
    assert [x["n_tokens"] for x in token_counts.quantiles(none, [0.5]).collect()] == [None]


def test_texts_are_encoded_once(spark):
    plan = token_counts.op9_token_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_encoded_lengths(spark):
    texts = [None, "", "hello world", "a" * 5000, "hello world", "é🙂 <|endoftext|>"]
    enc = token_counts.encoding(token_counts.VOCABULARY)
    got = token_counts.encoded_lengths(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(enc.encode_ordinary(t or "")) for t in texts]
    assert token_counts.limit_table(token_counts.length_histogram(docs(spark, []))).count() == 0
    assert token_counts.length_histogram(docs(spark, texts)).agg(F.sum("n_docs")).first()[0] == 6
