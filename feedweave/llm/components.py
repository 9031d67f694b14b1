"""Distributed connected components: smallest label among neighbours, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph given by ``edges(a long, b long)``.

    Returns ``(id, component_id)``: the smallest id reachable, for every id that has an edge to another id.  Rows with a
    null end and self-loops are ignored, repeated edges count once, an empty table gives an empty result.  Each round every
    vertex takes the smallest label among its neighbours and then its label's label, which halves the depth of chains.  Minima
    are pre-aggregated before they are shuffled.  Where many edges or vertices share a vertex or a label, the joins read written tables on both
    sides, so that Spark can split the hot key's partition.  Each round's labels are written to the shared folder and the
    round before's deleted; only a count of changes reaches the driver.  The rounds go on until nothing changes.
    """
    made: list[DataFrame] = []
    one = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stored(one.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*"))
    labels = stored(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("c")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("c").alias("m"))
        step = stored(labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")), made)
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        new = stored(step.join(jump, "c").select("v", F.col("cc").alias("c"), (F.col("cc") != F.col("old")).alias("moved")))
        discard(labels, *made, shuffles=False)
        labels, made = new, []
        if not new.where("moved").limit(1).count():
            discard(both, shuffles=False)
            return labels.select(F.col("v").alias("id"), F.col("c").alias("component_id"))
