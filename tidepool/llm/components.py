"""Connected components of a link table, by smallest labels and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for ids of links (a, b): component is the smallest id that links reach. Rounds grow with the logarithm of a component's width."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("now"))
        jump = lower.select(F.col("id").alias("now"), F.col("now").alias("further"))
        after = written(lower.join(jump, "now", "left").select("id", F.least("now", F.coalesce("further", "now")).alias("component"), (F.least("now", F.coalesce("further", "now")) < F.col("component")).alias("moved")), "labels")
        moved = after.filter("moved").limit(1).count()
        discard(labels)
        labels = after.select("id", "component")
        if not moved:
            discard(both)
            return labels
