import pytest

import __spark_entry__ as entry
from talkmill.plans import registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["chat_id", "chat_name", "message_id", "pos", "excerpt"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(registry.QUERIES["s1_session_by_key"](spark, SF))
    assert "EqualTo(event_id,42)" in p and "ReadSchema: struct<event_id:bigint,event_type:string>" in p
    p = plan(registry.QUERIES["s2_session_keys"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint>" in p


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"j7_matched_calls", "j8_parameter_match", "x12_last_expression", "x18_pretty_json", "v2_executions"}))
def test_no_cartesian_product_and_no_python(spark, name):
    p = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "Python" not in p and "Pandas" not in p and "MapInArrow" not in p
