"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


#: Links of one task. A few links make one partition and need no shuffle at all, however many partitions a shuffle has.
TASK_LINKS = 250_000


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b): comp is the smallest node of the component.

    ``links`` is a stored table. Each round takes the smallest label among the neighbours and then jumps to the label's
    own label. Links and labels stay in tables; only one number per round comes back.
    """
    tasks = 1 + 2 * links.count() // TASK_LINKS
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stored(df: DataFrame) -> DataFrame:
        return cut_lineage(df.coalesce(tasks)).coalesce(tasks)

    both = stored(both)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("comp")))
    total = None
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = stored(step.join(jump, "comp").select("node", F.col("next").alias("comp")))
        now = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
