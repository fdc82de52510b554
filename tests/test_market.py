"""Statistics that come from one count of the loads against those that count for themselves."""

from loadlark.operators import market as M
from loadlark.queries.market import first_matches


def test_zones_and_medians_of_one_count(spark, sf_dir):
    rows = first_matches(spark, sf_dir)
    zones, medians = M.zones_and_medians(rows, ["driver"])
    assert sorted(map(repr, zones.collect())) == sorted(map(repr, M.zones(rows, ["driver"]).collect()))
    total = M.baseline(rows, ["driver"]).where("bucket = 'ALL' AND equipment_view = 'ALL'").select(medians.columns)
    assert sorted(map(repr, medians.collect())) == sorted(map(repr, total.collect()))
    # the loads are read where they are counted, and never again for what follows from the counts
    assert "lineitem" not in zones.join(medians, "driver")._jdf.queryExecution().executedPlan().toString()
