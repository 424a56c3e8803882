"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.skew import hot_cold_join
from quillspark.scratch import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b); root is the least vertex of its component.

    Each round takes the least label among the neighbours and then the label of
    the label, so rounds follow the logarithm of the diameter; every round's
    labels are written to the shared folder, and nothing but a count comes to
    the driver.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct()
    both = materialize(both, "edges")
    # A hub's many edges and a root's many vertices are looked up by joins that stay even.
    labels = materialize(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("v", F.least("v", "m").alias("root"), "degree"), "labels")
    old = labels
    while True:
        near = hot_cold_join(both, labels.withColumnRenamed("v", "u"), ["u"], "degree", F.col("v")).groupBy("v").agg(F.min("root").alias("m"))
        step = materialize(labels.join(near, "v").select("v", "degree", "root", F.least("root", "m").alias("m")), "steps")
        asked = step.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
        up = materialize(asked.join(labels.select(F.col("v").alias("m"), F.col("root").alias("up")), "m", "left"), "label-labels")
        new = hot_cold_join(step, up, ["m"], "n", F.col("v"))
        new = materialize(new.select("v", "degree", F.col("root").alias("old"), F.least("m", F.coalesce("up", "m")).alias("root")), "labels")
        discard(old, step, up)
        old, labels = new, new.select("v", "root", "degree")
        if not new.where("old <> root").limit(1).count():
            discard(both)
            return labels.select("v", "root")
