"""Connected components of an edge table, by smallest labels and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is the smallest node that can be reached.

    A round gives each node the smallest label among its neighbours' and its own, then the label of that label; the rounds, each
    a table in the shared folder, end when no label has changed. Partial aggregation keeps a hub's neighbours apart.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        above = labels.select(F.col("node").alias("above"), F.col("component").alias("top"))
        new = saved(met.join(above, met["component"] == above["above"], "left").select("node", "was", F.least("component", F.coalesce("top", "component")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
