"""Graph operators over edges src, dst: degrees, reachability, strongly connected components."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All nodes that the starts reach and their distance: breadth first until a step finds no new node, one join for each step, lineage cut by checkpoints."""
    seen = starts.select("node").distinct().withColumn("steps", F.lit(0)).checkpoint()
    front, partitions = seen, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for step in count(1):
        front = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("steps", F.lit(step)).checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.union(front).coalesce(partitions).checkpoint()  # else each step would add partitions


def mutual_components(edges: DataFrame) -> DataFrame:
    """Strongly connected components by the least node that reaches a node and is reached by it.

    Forward colours are spread to a fixpoint; nodes that their colour's root reaches backwards within the colour form its
    component and leave the graph, until none is left. No count of rounds is bounded: they grow with the longest of the shortest paths.
    """
    rest = edges.select("src", "dst").distinct().checkpoint()
    nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct().checkpoint()
    done = None
    while not nodes.isEmpty():
        colour = nodes.withColumn("colour", F.col("node")).checkpoint()
        same = False
        while not same:
            offers = rest.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("offer"))
            new = colour.join(offers, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", "offer").alias("colour")).checkpoint()
            same = new.join(colour.withColumnRenamed("colour", "before"), "node").where("colour <> before").isEmpty()
            colour = new
        inner = rest.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = reachable(inner.checkpoint(), colour.where("node = colour").select("node"))
        found = back.join(colour, "node").select("node", F.col("colour").alias("component")).checkpoint()
        done = found if done is None else done.union(found)
        nodes = nodes.join(found, "node", "left_anti").checkpoint()
        rest = rest.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").checkpoint()
    return done


def findings(edges: DataFrame, is_script: Column, is_test: Column) -> DataFrame:
    """Nodes without incoming edges (orphan) and nodes whose every source is a script or a test; conditions are over src."""
    ends = edges.select(F.col("dst").alias("node"), is_script.alias("script"), is_test.alias("test"), F.lit(1).alias("in")).union(edges.select("src", F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("in").alias("in"), F.bool_and("script").alias("script"), F.bool_and("test").alias("test"))
    finding = F.when(F.col("in") == 0, "orphan").when(F.col("script"), "script_only").when(F.col("test"), "test_only")
    return seen.select("node", finding.alias("finding")).where("finding IS NOT NULL")
