"""Connected components of a table of memberships, on ids only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(members: DataFrame, kept: bool = False) -> DataFrame:
    """(node, comp) for members (bucket, node): nodes that share a bucket, directly or by a chain, get the least node of all.

    kept: members are read from a table already.

    Labels fall to the least label of a node's buckets until none changes. Each round also follows the label's own
    label, so chains shrink by half. Only ids move; nothing of a bucket meets in one task but its minimum. Rounds are kept
    as tables: a checkpoint would inherit size estimates, which grow with every join until they no longer fit the driver.
    """
    members = members if kept else keep(members)
    labels = keep(members.groupBy("node").agg(F.min("node").alias("comp")))
    while True:
        least = members.join(labels, "node").groupBy("bucket").agg(F.min("comp").alias("comp"))
        new = members.join(least, "bucket").groupBy("node").agg(F.min("comp").alias("new"))
        hop = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        joined = labels.join(new, "node").join(hop, "new", "left").select("node", F.least("new", "far").alias("new"), "comp")
        joined = keep(joined)
        labels = joined.select("node", F.col("new").alias("comp"))
        if joined.filter(F.col("new") != F.col("comp")).isEmpty():
            return labels
