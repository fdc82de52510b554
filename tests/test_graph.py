"""Graph operators on graphs with shortest paths of many steps."""

from loadlark.operators import graph as G


def test_reachable_goes_to_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 0), (200, 201)], "src long, dst long").coalesce(1)
    got = {r.node: r.steps for r in G.reachable(edges, spark.range(1).toDF("node")).collect()}
    assert got == {i: i for i in range(71)}


def test_a_long_cycle_is_one_component(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 70) for i in range(70)] + [(3, 200), (200, 201)], "src long, dst long").coalesce(1)
    got = {r.node: r.component for r in G.mutual_components(edges).collect()}
    assert got == {i: 0 for i in range(70)} | {200: 200, 201: 201}
