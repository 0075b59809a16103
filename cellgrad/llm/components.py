"""Connected components of a link table, smallest member as label.

Labels move along links and then jump to the label of their label, so a chain
of n links takes about log n rounds.  Each round is written to the shared
checkpoint folder; only the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has a link; label: the component's
    smallest node.  Nodes are longs; links may repeat, in either direction."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(
        links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    both = materialize(both, "links")
    label = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l"))
                        .withColumnRenamed("u", "node"), "labels")
    while True:
        near = (both.join(label.withColumnRenamed("node", "v"), "v")
                .groupBy("u").agg(F.min("l").alias("m")).withColumnRenamed("u", "node"))
        moved = (label.join(near, "node")
                 .select("node", F.col("l").alias("was"), F.least("l", "m").alias("l")))
        moved = materialize(moved, "moved")
        jump = moved.select(F.col("node").alias("l"), F.col("l").alias("far"))
        after = materialize(moved.join(jump, "l").select("node", "was", F.col("far").alias("l")), "labels")
        label = after.select("node", "l")
        if after.where(F.col("l") != F.col("was")).isEmpty():
            return label.withColumnRenamed("l", "label")
