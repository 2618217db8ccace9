"""Connected components of a link table, as Spark joins (minimum labels with pointer jumping).

Each round a vertex takes the smallest label among itself and its neighbours, then the label of
that label, so that a path of n links takes about log n rounds.  Each round's labels
are a written table in the shared folder, of few files where there are few links; the driver
sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drainrules.session import few_files, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every vertex of ``links (a, b)``, a written table; the root is the component's smallest vertex."""
    most = 2 * links.count()  # vertices
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(few_files(ways.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id"), most), "labels")
    while True:
        seen = ways.join(labels, ways["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("least"))
        near = labels.join(seen, labels["id"] == seen["a"]).select("id", F.col("root").alias("old"), F.least("root", "least").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("root").alias("after"))
        step = materialize(few_files(near.join(jump, "next").select("id", "old", F.least("next", "after").alias("root")), most), "labels")
        labels = step.select("id", "root")
        if step.where("old <> root").limit(1).count() == 0:
            return labels
