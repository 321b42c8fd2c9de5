import pytest
from tests import oracle

from tallyspark.plans import registry

SF = "sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    oracle.check(QUERIES[name](spark, f"{oracle.ROOT}/{SF}"), con, ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, f"{oracle.ROOT}/{SF}").count() == 50


def plan(spark, name):
    return QUERIES[name](spark, f"{oracle.ROOT}/{SF}")._jdf.queryExecution().executedPlan().toString()


def test_a_record_is_parsed_once(spark):
    """One parse of the page, one of the record and one of its remittance list."""
    for name in ("feed_normalize", "sync_cycle"):
        assert plan(spark, name).count("from_json(") <= 3, name


def test_a_cycle_is_planned_without_repeats(spark):
    for name in ("lifecycle_counts", "sync_cycle"):
        p = plan(spark, name)
        assert p.count("MapInArrow") <= 2 and p.count("SortMergeJoin") <= 6 and p.count("Exchange ") <= 24, (name, p.count("SortMergeJoin"), p.count("Exchange "))


def test_matching_joins_by_stretch_of_days(spark):
    assert any("Join" in line and "stretch" in line for line in plan(spark, "interval_match").splitlines())
