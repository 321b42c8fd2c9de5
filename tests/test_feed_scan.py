"""Scans of landed pages: whole chains give rows, broken ones give an error and nothing else."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reports as rp
from tallyspark.sources import feed as fd

PAGES = "account long, page_no long, request_key string, status int, page string, note string"


def record(k, **more):
    return {"status": "BOOK", "transaction_date": "2024-01-05", "transaction_amount": {"amount": str(k)}, "credit_debit_indicator": "CRDT", "entry_reference": f"R{k}", **more}


def page(keys, to="", **more):
    return json.dumps({"transactions": [record(k) for k in keys], "continuation_key": to, **more})


def scan(spark, rows, accounts=None):
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES).repartition(3)
    got, status = fd.scan_accounts(df, None, None if accounts is None else spark.createDataFrame([(a,) for a in accounts], "account long"))
    found = {}
    for r in got.collect():
        found.setdefault(r["account"], []).append(r["entry_ref"])
    return {a: sorted(x) for a, x in found.items()}, {r["account"]: (r["pages"], r["error"]) for r in status.collect()}


def test_whole_chains_and_every_fault(spark):
    rows = [
        (1, 0, "", 200, page([1, 2], "a")), (1, 1, "a", None, page([3], "b")), (1, 2, "b", 200, page([4])),
        (2, 0, None, 200, page([5], "a")), (2, 1, "a", 200, "<html>busy</html>"),
        (3, 0, "", 200, page([6], "a")), (3, 1, "a", 503, page([7])),
        (4, 0, "", 200, page([8], "a")), (4, 2, "b", 200, page([9])),
        (5, 0, "", 200, page([10], "a")), (5, 1, "z", 200, page([11])),
        (6, 1, "a", 200, page([12])),
        (7, 0, "", 200, page([13])), (7, 1, "q", 500, "not part of the scan"),
        (8, 0, "", 200, page([14])), (8, 0, "", 200, page([15])),
        (9, 0, "", 200, page([16], "a")),
        (10, 0, "", 200, page([], "")),
    ]
    rows_of, status = scan(spark, rows, [*range(1, 11), 99])
    assert rows_of == {1: ["R1", "R2", "R3", "R4"], 7: ["R13"]}
    assert status == {
        1: (3, None), 2: (0, "page 1: cannot be decoded"), 3: (0, "page 1: status 503"), 4: (0, "page 1 is missing"), 5: (0, "page 1 does not continue the one before it"), 6: (0, "page 0 is missing"),
        7: (1, None), 8: (0, "page 0 was landed more than once"), 9: (0, "page 1 is missing"), 10: (1, None), 99: (0, "page 0 is missing"),
    }


@pytest.mark.parametrize("body", ["", None, "nul", "[]", "[{}]", "5", '"x"', "{", "{}x", '{"transactions": 5}', '{"transactions": {}}', '{"transactions": [5]}', '{"transactions": ["x"]}', '{"transactions": [[]]}', '{"continuation_key": 7}', '{"continuation_key": {}}', '{"transactions": [{"a": }]}', '{"transactions": [{}], "continuation_key": "'])
def test_pages_that_cannot_be_decoded(spark, body):
    rows, status = scan(spark, [(1, 0, "", 200, body), (2, 0, "", 200, page([1]))])
    assert rows == {2: ["R1"]} and status == {1: (0, "page 0: cannot be decoded"), 2: (1, None)}


@pytest.mark.parametrize("body", ["{}", " null ", '{"transactions": null}', '{"transactions": [null], "continuation_key": null}', '{"transactions": [], "other": [1, {"x": 2}]}', '\n{"transactions": [{}, {"status": 5}]}\n', '{"transactions": [{"transaction_date": "2024-01-05", "transaction_amount": {"amount": "1e30"}}]}'])
def test_pages_without_well_formed_records(spark, body):
    assert scan(spark, [(1, 0, "", 200, body)]) == ({}, {1: (1, None)})


def test_a_long_chain_is_not_one_task(spark):
    n = 3000
    df = spark.range(n).select(F.lit(1).cast("long").alias("account"), F.col("id").alias("page_no"), F.when(F.col("id") > 0, F.concat(F.lit("k"), "id")).otherwise("").alias("request_key"), F.lit(200).alias("status"),
                               F.concat(F.lit('{"transactions":[], "continuation_key":"'), F.when(F.col("id") < n - 1, F.concat(F.lit("k"), F.col("id") + 1)).otherwise(""), F.lit('"}')).alias("page"))
    assert [tuple(r) for r in fd.scan_accounts(df)[1].collect()] == [(1, n, None)]
    plan = fd.scan_status(fd.decode_pages(df))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan and "at#" in plan


def test_outcome_of_a_run(spark):
    bad = [(k, 0, "", 500, "") for k in (2, 1)]
    said = lambda rows: tuple(rp.fetch_outcome(fd.scan_accounts(spark.createDataFrame([(*r, "x") for r in rows], PAGES))[1]).first())
    assert said(bad) == ("fetch_error", 2, "1: page 0: status 500; 2: page 0: status 500")
    assert said([*bad, (3, 0, "", 200, "{}")]) == ("success", 2, "1: page 0: status 500; 2: page 0: status 500")
    assert said([]) == ("success", 0, "")


def test_pages_are_decoded_once_for_status_and_rows(spark):
    """Neither what comes back is made from the pages again."""
    df = spark.createDataFrame([(1, 0, "", 200, page([1, 2], "a"), "x"), (1, 1, "a", 200, page([3]), "x")], PAGES)
    rows, status = fd.scan_accounts(df)
    plan = rows.join(status, "account")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 2 and "schema_of_variant" not in plan  # the record and its remittance list
    assert rows.join(status, "account").count() == 3
