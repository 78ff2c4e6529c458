"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import release, written


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in links (a, b): label is the smallest id that links reach.

    Each round takes the least label among neighbours (aggregated before the shuffle, so that an id with very many
    links is no hot group) and then the label of that label; the rounds grow with the logarithm of long chains and end
    when no label falls any more.  Ids without a link aren't returned.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.filter("moved").isEmpty():
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.id == near.a).select("id", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("id").alias("best"), F.col("label").alias("further"))
        stepped = F.least("best", F.coalesce("further", "best"))
        labels = written(least.join(jump, "best", "left").select("id", stepped.alias("label"), (stepped < F.col("label")).alias("moved")), "labels", labels)
    release(both)
    return labels.select("id", "label")
