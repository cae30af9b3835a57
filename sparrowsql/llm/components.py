"""Connected components by min-label rounds over (node, group) rows; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowsql.llm.common import materialize


def components(members: DataFrame, label: str = "components") -> DataFrame:
    """node, label: the smallest node that is joined to each node through shared groups.

    Each round gives a group the least label of its members, a member the least
    of its groups, and then every node the label of its label, which shortens
    long chains. Grouped minima fold before each shuffle, so a group that holds
    a third of all rows is no burden to one task; they are written before they
    are joined, so that Spark splits the rows of such a group. Rounds end when no
    label changes.
    """
    members = materialize(members.select("node", "group").distinct(), f"{label}-members")
    labels = materialize(members.select("node", F.col("node").alias("label")).distinct(), f"{label}-labels")
    while True:
        low = materialize(members.join(labels, "node").groupBy("group").agg(F.min("label").alias("low")), f"{label}-groups")
        best = members.join(low, "group").groupBy("node").agg(F.min("low").alias("low"))
        fresh = labels.join(best, "node").select("node", "label", F.least("label", "low").alias("low"))
        fresh = materialize(fresh, f"{label}-low")
        target = fresh.select(F.col("node").alias("of"), F.col("low").alias("next"))
        jumped = fresh.join(target, F.col("low") == F.col("of"), "left")
        jumped = jumped.select("node", F.col("label").alias("old"), F.least("low", F.coalesce("next", "low")).alias("label"))
        labels = materialize(jumped, f"{label}-labels")
        if labels.where("old != label").isEmpty():
            return labels.select("node", "label")
