"""The pipeline on a small corpus against a brute-force version of its decisions, and the SQL oracles."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tests import oracle

import corpus_pipeline
from tallyspark.llm import common, quality, queries, sentencepiece_codec
from tests.llm.test_dedup import cut_model, near_model
from tests.llm.test_text_models import hit_model

SF = "sf0.001"


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 6)))
    line = lambda: " ".join(word() for _ in range(r.randint(3, 14))) + "."
    shared, items = [" ".join(line() for _ in range(9)) for _ in range(5)], [(k, " ".join(word() for _ in range(14))) for k in range(4)]
    rows = []
    for k in range(120):
        lines = [line() for _ in range(r.randint(4, 9))]
        if k % 4 == 0:
            lines.insert(r.randrange(len(lines)), r.choice(shared))
        if k % 15 == 0:
            lines.append(" ".join(items[k % 4][1].upper().split()[2:13]))
        if k % 7 == 3:
            lines = [" ".join(w + "###" for w in x.split()) for x in lines]
        rows.append((k, "\n".join(lines)))
    for k in range(120, 150):
        words = rows[k - 110][1].split(" ")
        if k % 2:
            words[len(words) // 2] = word()
        rows.append((k, " ".join(words)))
    return rows + [(150, None), (151, "")], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows, items = corpus()
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 7 != 3), 0) for k in range(110)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_equals_brute_force(spark, folder):
    rows, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {x["doc_id"]: x["quality_score"]["score"] for x in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    assert all((scores[i] >= 0.5) == ("###" not in (t or "")) for i, t in rows if t)
    left = [(i, t) for i, t in rows if scores[i] >= 0.5]
    left = [(i, t) for i, t in left if (i, True) in {(x[0], x[3]) for x in near_model(left, 5)}]
    left = cut_model(left)
    left = [(i, t) for i, t in left if hit_model(t, items, 10)[1] == 0]
    model = sentencepiece_codec.load(sentencepiece_codec.MODEL)
    want = {i: list(x) for (i, _), x in zip(left, sentencepiece_codec.encode_batch(model, [t for _, t in left]), strict=True)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {x["doc_id"]: x["ids"] for x in got} == want and all(x["round_trip"] for x in got)
    assert 0 < len(want) < len(rows)


def test_tables_of_the_way_are_removed(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, folder).count() > 0
    left = sorted(x.name.rsplit("-", 1)[0] for x in (tmp_path / "tallyspark").iterdir())
    assert left == ["stage-decontamination"], left


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == docs.columns and out.count() == 0, name


def test_near_dedup_stage_with_null_and_repeated_ids(spark, folder):
    kind = spark.read.parquet(f"{folder}/documents.parquet").schema
    long = " ".join(f"w{k}" for k in range(30))
    texts = [(None, long), (1, long), (None, "quite another text of no id"), (None, "quite another text of no id"), (2, "b c d e f g"), (2, "h i j k l m"), (3, "B c d e f g"), (4, None), (None, ""), (5, "n o p q r s"), (5, "n o p q r s")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], kind)
    got = corpus_pipeline.near_dedup_stage(spark, docs, folder)
    assert got.columns == docs.columns
    left = sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=repr)
    assert left == sorted([(1, long), (None, "quite another text of no id"), (2, "b c d e f g"), (2, "h i j k l m"), (4, None), (None, ""), (5, "n o p q r s")], key=repr)


def test_pipeline_takes_odd_rows_and_clashing_columns(spark, folder, tmp_path):
    """Null, repeated and extreme ids, nulls in every column, and columns named like what the stages make."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "no id here at all", "en", None, 17), (3, "one more text of this id", None, "s1", 24), (2**63 - 1, "last", "en", "s1", 4), (-(2**63), "first", "en", "s1", 5)], docs.schema)
    wide = docs.unionByName(odd)
    for k, name in enumerate(("ids", "decoded", "n_tokens", "label", "mark", "node", "first", "place", "quality_score", "contamination", "removed_spans", "slot", "k")):
        wide = wide.withColumn(name, F.lit(k))
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == before.columns and after.where("ids <> 0 OR k <> 12").count() == 0, name
        before = after
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(x["round_trip"] for x in got) and {None, 2**63 - 1, -(2**63)} <= {x["doc_id"] for x in got}


def test_substring_stage_counts_what_is_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for x in corpus_pipeline.substring_dedup_stage(spark, docs, folder).collect():
        assert x["n_chars"] == len(x["text"])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    oracle.check(queries.queries()[name](spark, f"{oracle.ROOT}/{SF}"), oracle.connect(SF), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_covers_its_whole_table(spark, name):
    n = queries.queries()[name](spark, f"{oracle.ROOT}/{SF}").count()
    documents = spark.read.parquet(f"{oracle.ROOT}/{SF}/documents.parquet").count()
    assert n == documents if re.match(r"op(1|2|3|6|7|10)_", name) else n > 0
