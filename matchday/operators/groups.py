"""Connected groups of names (Q7): which spellings mean the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_groups(links: DataFrame) -> DataFrame:
    """(name, group) of every name of `links(a, b)`; `group` is the least name it is connected with.

    Every name takes the least label among its own and its neighbours', then that
    label's own label, until nothing changes. All steps are aggregates and joins by
    name; rounds are about the logarithm of the longest chain.
    """
    both = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = materialize(both.union(both.select("b", "a")).distinct().toDF("name", "other"))
    labels = materialize(both.groupBy("name").agg(F.least(F.col("name"), F.min("other")).alias("group")))
    while True:
        near = both.join(labels.select(F.col("name").alias("other"), "group"), "other").select("name", "group")
        least = labels.union(near).groupBy("name").agg(F.min("group").alias("group"))
        up = least.select(F.col("name").alias("group"), F.col("group").alias("above"))
        found = materialize(least.join(up, "group", "left").select("name", F.least("group", F.coalesce("above", "group")).alias("group")))
        changed = not found.join(labels, ["name", "group"], "left_anti").isEmpty()
        labels = found
        if not changed:
            return labels
