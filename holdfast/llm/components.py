"""Connected components of links between ids, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import settled


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in the links (a, b).

    Each round gives an id the smallest label among its neighbours', then that label's own
    label, so path lengths about halve. A round folds links to one row an id; every round's
    labels are written to the shared folder.
    """
    both = settled(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settled(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("near"))
        nearest = both.join(of_b, "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(nearest, labels["id"] == nearest["a"]).select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("now")
        )
        ahead = labels.select(F.col("id").alias("now"), F.col("component").alias("jump"))
        moved = settled(
            lower.join(ahead, "now").select("id", F.least("now", "jump").alias("component"), "was"), "labels"
        )
        labels = moved.select("id", "component")
        if moved.where(F.col("component") != F.col("was")).isEmpty():
            return labels
