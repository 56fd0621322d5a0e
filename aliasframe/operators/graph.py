"""Connected components and merge chains, as DataFrame rounds with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, label: the least node of each connected component of ``edges(a, b)``.

    Each round takes the least label among neighbours, then the label of the label. Lineage is cut by a
    reliable checkpoint each round; the driver sees one flag. Null ends, self-links and repeated edges are allowed.
    """
    real = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = checkpoint(real.union(real.select("b", "a")))
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
        labels = checkpoint(step.join(jump, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", "far").alias("label")))
        if labels.where(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise RuntimeError("components did not settle")


def chain_heads(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """token, head: where each token's chain of redirects ends.

    ``links(token, merged_into)`` has one row per token; a null redirect ends a chain, as does a
    target without a row. A token on a cycle, or on the way to one, gets the cycle's least token. Each round
    doubles the hops.
    """
    at = checkpoint(links.select("token", F.coalesce("merged_into", "token").alias("head"), F.least("token", F.coalesce("merged_into", "token")).alias("least"), F.col("merged_into").isNull().alias("ended")))
    for _ in range(most_rounds):
        hop = at.select(F.col("token").alias("via"), F.col("head").alias("next"), F.col("least").alias("seen"), F.col("ended").alias("stop"))
        step = at.join(hop, F.col("head") == F.col("via"), "left")
        ended = F.col("ended") | F.coalesce("stop", F.lit(True))
        least = F.least("least", F.coalesce("seen", "least"))
        at = checkpoint(step.select("token", F.coalesce("next", "head").alias("head"), least.alias("least"), ended.alias("ended"), ((ended != F.col("ended")) | (least != F.col("least"))).alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    ring = at.select(F.col("token").alias("via"), F.col("least").alias("ring"))
    return at.join(ring, F.col("head") == F.col("via"), "left").select("token", F.when(F.col("ended"), F.col("head")).otherwise(F.col("ring")).alias("head"))
