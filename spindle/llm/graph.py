"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, comp): the smallest id reachable from each end of a link.

    Smallest labels spread along the links, and each label is replaced by that label's own label (pointer
    jumping), so long chains take a logarithmic number of rounds rather than their length. Every round is written to the shared
    folder. Hot ids are summed by partial minima; joins leave large keys to the engine's skew handling."""
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialize(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "cc-links")
    labels = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")).withColumnRenamed("x", "id"), "cc")
    while True:
        near = both.join(labels, both.y == labels.id).groupBy("x").agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels.id == near.x).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        roots = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = materialize(spread.join(roots, "comp", "left").select("id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "cc")
        labels = new.select("id", "comp")
        if new.where("old <> comp").isEmpty():
            return labels
