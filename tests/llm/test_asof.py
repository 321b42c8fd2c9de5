import random
import zlib

import pytest
from tests import oracle

from tallyspark.llm import asof, queries

LEFT = "click long, client string, t long, match string, extra array<int>"
RIGHT = "client string, at long, cents long, sale long, note string"


def model(left, right, tolerance):
    low = lambda x: (x is not None, x or 0)
    out = []
    for click, client, t, _, _ in left:
        mine = [o for o in right if None not in (client, t, o[1]) and o[0] == client and o[1] <= t]
        at = max((o[1] for o in mine), default=None)
        if at is None or t - at > tolerance:
            out.append((click, None))
            continue
        tied = [o for o in mine if o[1] == at]
        best = max(tied, key=lambda o: (low(o[2]), low(o[3]), low(o[4] and ord(o[4]))))
        out.append((click, (at, *best[2:], len(tied))))
    return sorted(out, key=repr)


def answers(spark, left, right, tolerance):
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    got = asof.asof_join(a, b, "client", "t", "at", tolerance, ["cents", "sale"], "click")
    assert set(got.columns) == {"click", "client", "t", "match", "extra"}
    return sorted(((r["click"], r["match"] and tuple(r["match"])) for r in got.collect()), key=repr)


@pytest.fixture
def many_buckets(spark):
    """Small Arrow batches and buckets that are not put together again."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("seed", "clients", "tolerance"), [(1, "aaaab", 30), (2, "a", 10), (3, "abcdefgh", 400), (4, "ab", 0)])
def test_equals_brute_force_over_many_buckets(spark, many_buckets, seed, clients, tolerance):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.05 else x
    right = [(some(r.choice(clients)), some(r.randrange(300)), some(r.randrange(3)), some(k % 7), r.choice([None, "x", "y"])) for k in range(90)]
    left = [(k, some(r.choice(clients + "z")), some(r.randrange(320)), "mine", None) for k in range(200)]
    assert answers(spark, left, right + right[:9], tolerance) == model(left, right + right[:9], tolerance)


def test_a_predecessor_is_carried_over_buckets_without_right_rows(spark, many_buckets):
    left = [(k, "a", 10 + k // 3, "", [1]) for k in range(150)] + [(500, "b", 70, "", None)]
    right = [("a", 5, 1, 1, None), ("b", 60, None, 2, None), ("c", 1, 1, 1, None)]
    assert answers(spark, left, right, 1000) == model(left, right, 1000)


def test_one_time_of_one_key_spans_buckets(spark, many_buckets):
    left = [(k, "a", 50, "", None) for k in range(120)]
    right = [("a", 50, k % 4, k, "n") for k in range(80)]
    got = answers(spark, left, right, 5)
    assert got == model(left, right, 5) and {m for _, m in got} == {(50, 3, 79, "n", 80)}


def test_repeated_left_rows_and_empty_tables(spark):
    left = [(1, "a", 9, "", None)] * 3 + [(None, None, None, None, None)]
    right = [("a", 9, None, 4, None), ("a", 9, None, None, "q")]
    assert answers(spark, left, right, 0) == model(left, right, 0)
    assert answers(spark, [], right, 0) == []
    assert [m for _, m in answers(spark, left, [], 0)] == [None] * 4


def test_orders_and_clicks_of_odd_rows(spark):
    t = "timestamp'2024-01-01 07:00:01.000002'"
    sales = spark.sql(f"SELECT * FROM VALUES (7L, 1L, 1.005D, {t}, 2), (8L, 1L, CAST('NaN' AS DOUBLE), {t}, NULL), (NULL, 1L, 1e300D, NULL, 1), (9L, NULL, NULL, {t}, 1) s(sale_id, client_id, total, sold_at, priority)")
    got = {r["sale_id"]: r for r in asof.orders_of(sales).collect()}
    want = {i: zlib.crc32(str(i).encode()) for i in (7, 8, 9)}
    assert set(got) == {None, *want, *(-1 - i for i, h in want.items() if h % 3)}
    us = 1704092401000002
    for i, h in want.items():
        assert got[i]["sold_us"] == (us - us % (6 * asof.HOUR_US) if h % 2 else us)
    assert got[8]["total_cents"] is None and got[None]["total_cents"] is None and got[7]["total_cents"] == 100
    clicks = spark.sql(f"SELECT * FROM VALUES (5L, {t}, 1L), (5L, {t}, 1L), (6L, NULL, NULL) c(click_id, ts, client_id)")
    assert sorted(asof.clicks_of(clicks).collect())[1:] == [(6, None, None)] and asof.clicks_of(clicks).count() == 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_oracle_over_many_buckets(spark, sf):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        oracle.check(queries.queries()["op12_asof_join"](spark, f"{oracle.ROOT}/{sf}"), oracle.connect(sf), queries.oracle_sql()["op12_asof_join"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
