"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Label each node (column ``node``) with the least node of its component (column ``label``).

    ``edges`` has columns u and v of one integer type; loops and repeats do no
    harm. In each round a node takes the least label among its neighbours and
    hands that to the node of its old label too, so that whole trees of labels
    join at once; then each node takes its label's own label. Rounds go on until
    no label changes, which has to come, since labels only fall. A round's
    result is written to the shared folder. Only a count reaches the driver.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).filter("u <> v").distinct()
    both = materialize(both, "edges")
    labels = materialize(
        both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        )
        own = F.struct("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hook = F.struct(F.col("label").alias("node"), F.lit(None).cast(labels.schema["label"].dataType).alias("was"), F.col("near").alias("label"))
        step = labels.join(near, "node").select(F.inline(F.array(own, hook)))
        step = materialize(step.groupBy("node").agg(F.max("was").alias("was"), F.min("label").alias("label")), "step")
        far = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        nxt = materialize(
            step.join(far, "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")),
            "labels",
        )
        labels = nxt.select("node", "label")
        if not nxt.filter("label <> was").limit(1).count():
            return labels
