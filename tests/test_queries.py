import pytest

from loadlark.queries import ORACLES, QUERIES

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        same_rows(df, duck.sql(ORACLES[name]))
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_stay_in_the_jvm(spark, sf_dir, capsys):
    from loadlark.queries import market

    market.driver_fit(spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
    assert "ReadSchema" in plan and "l_tax" not in plan


def test_states_of_zones_follow_from_counts(spark, capsys):
    """A delivery's state is worked out for counted cities, never for each match."""
    from loadlark.operators import market

    rows = spark.createDataFrame([("a", "Gary, IN", "MATCH", True, 900, 3.0)], "driver string, delivery string, status string, qualified boolean, rate long, total_rpm double")
    market.zones(rows, ["driver"]).explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "split(" not in plan[plan.rindex("HashAggregate") :]
