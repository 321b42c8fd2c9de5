import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests import oracle

from tallyspark.llm import language_id as li

WORDS = {"aa": "mano sole luna casa", "bb": "brug hund stein wald", "cc": "чай дом лес река"}
DOCS = "doc_id long, text string, lang string, language string, score int, id string"


def plain_vector(text):
    """N-gram by N-gram, letter by letter."""
    s = ["\x20"]
    for c in f"{text.lower()} ":
        c = c if c.isalpha() else "\x20"
        if c != "\x20" or s[-1] != "\x20":
            s.append(c)
    out = np.zeros(li.SIZE)
    for k in range(len(s) - 2):
        a, b, c = (li.letter_vector(ord(x)) for x in s[k : k + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


TEXTS = ["", "a", "Ab", "1 2", "Straße, ΣΊΓΜΑ! İx", "ab" * 400, "one  two\tthree\n4", "日本語 テキスト", "x" * 50, "é🙂é ª²", " ", " a\x00b"]


def test_vectors_equal_plain_bundling():
    got, lettered = li.vectors([*TEXTS, None])
    for t, v in zip(TEXTS, got, strict=False):
        if any(c.isalpha() for c in t):
            assert np.allclose(v, plain_vector(t)), t
    assert lettered.tolist() == [any(c.isalpha() for c in t) for t in TEXTS] + [False]


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 999])
def test_a_text_in_pieces_is_bundled_like_a_whole_one(monkeypatch, piece):
    r = random.Random(piece)
    texts = ["".join(r.choices("abİ ç1.\nß", k=r.randint(1, 3000))) for _ in range(5)]
    want = np.array([plain_vector(t) for t in texts])
    monkeypatch.setattr(li, "PIECE", piece)
    monkeypatch.setattr(li, "AT_ONCE", 5)
    assert np.allclose(li.vectors(texts)[0], want)


def sentences(r, lang, n):
    return " ".join(r.choices(WORDS[lang].split(), k=n))


def test_held_out_rows_and_odd_rows(spark):
    r = random.Random(3)
    rows = [(k, sentences(r, x, 8), x, "old", 1, "z") for k, x in enumerate(r.choices(list(WORDS), k=90))]
    odd = [(None, "mano sole", "bb", "", 0, ""), (200, None, "aa", "", 0, ""), (201, "12 %", "aa", "", 0, ""), (202, "", None, "", 0, ""), (203, "stein wald brug", None, "", 0, ""), (203, "stein wald brug", None, "", 0, ""), (204, "mano " * 60_000, None, "", 0, "")]
    model = li.fit(spark.createDataFrame(rows + odd, DOCS).where("coalesce(doc_id, -1) % 3 <> 0"))
    assert model.languages == ["aa", "bb", "cc"]
    got = li.predict(spark.createDataFrame(rows + odd, DOCS), model).collect()
    assert all(x["language"]["lang"] == x["lang"] and 0 <= x["language"]["score"] <= 1 for x in got if x["doc_id"] is not None and x["doc_id"] < 200)
    told = [(x["doc_id"], x["language"]["lang"]) for x in got if x["doc_id"] is None or x["doc_id"] >= 200]
    assert told == [(None, "aa"), (200, "und"), (201, "und"), (202, "und"), (203, "bb"), (203, "bb"), (204, "aa")]
    assert {x["language"]["score"] for x in got if x["language"]["lang"] == "und"} == {0.0}


def test_cosine_against_prototypes_by_hand(spark):
    rows = [(1, "mano sole", "aa", "", 0, ""), (2, "luna", "aa", "", 0, ""), (3, "stein", "bb", "", 0, ""), (3, "stein", "bb", "", 0, "")]
    model = li.fit(spark.createDataFrame(rows, DOCS))
    one = lambda v: v / np.linalg.norm(v)
    want = [one(one(plain_vector("mano sole")) + one(plain_vector("luna"))), one(plain_vector("stein"))]
    assert np.allclose(model.prototypes, want, atol=1e-5)
    score = li.predict(spark.createDataFrame([(9, "man o", None, "", 0, "")], DOCS), model).first()["language"]["score"]
    assert abs(score - one(plain_vector("man o")) @ want[0]) < 1e-5


def test_nothing_to_learn_and_nothing_to_predict(spark):
    docs = spark.createDataFrame([(1, "abc", None, "", 0, "")], DOCS)
    model = li.fit(docs)
    assert model.languages == [] and li.predict(docs, model).first()["language"] == ("und", 0.0)
    assert li.predict(docs.limit(0), model).count() == 0


def test_a_rare_language_is_learned_whole_and_a_common_one_by_its_share(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("brug hund "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") == 7, "cc").otherwise("bb").alias("lang"))
    model = li.fit(docs.withColumn("text", F.when(F.col("lang") == "cc", "чай").otherwise(F.col("text"))), most=100)
    assert np.allclose(model.prototypes[1], plain_vector("чай") / np.linalg.norm(plain_vector("чай")), atol=1e-5) and np.linalg.norm(model.prototypes[0]) > 0.99


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{oracle.ROOT}/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in li.op11_language_id(spark, f"{oracle.ROOT}/sf0.01").collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if got[r["doc_id"]]["held_out"] and r["lang"]]
    assert sum(right) >= 0.98 * len(right)
