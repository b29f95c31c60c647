"""Connected components by Spark jobs: least labels passed along links, with pointer jumping; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.store import Scratch, files_for


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, label (the least node that its component has) of all nodes of links (a, b: longs), a table of scratch. Self-links and repeats don't matter.

    Each round takes the least label among a node and its neighbours and then that label's own label. Only minima are
    taken, with partial sums on the map side, so a node with very many links is no hot spot. No links: no rows.
    """
    files = files_for(links.count())  # by the number of rows, as links are few against what they were found in
    scratch, own = scratch or Scratch(), Scratch()
    both = own.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().coalesce(2 * files))
    labels = own.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")).coalesce(files))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        nearer = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = scratch.written(nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")).coalesce(files))
        changed = not new.where("label <> old").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            own.release()
            return labels
