"""Lineage cuts that survive lost executors, and components of graphs too large for one machine."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the checkpoint folder, which driver and executors share (``spark.checkpoint.dir``).

    Local mode takes a temporary folder where none is set; elsewhere that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", "") or df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="voxelframe-")
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def least_labels(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, id, label: the least id of its component, for every id of the edges (by, a, b).

    Every pass hooks the label of a link's greater side under the lesser one and follows labels of
    labels, so passes grow as the logarithm of a component's size.
    """
    both = cut(edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(*by, F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(*by, F.col("id").alias("b"), F.col("label").alias("lb")), [*by, "b"]).join(labels.select(*by, F.col("id").alias("a"), F.col("label").alias("la")), [*by, "a"]).where("lb < la")
        hooks = near.select(*by, F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("lb").alias("label")), F.struct(F.col("la").alias("id"), F.col("lb").alias("label")))).alias("h")).select(*by, "h.*")
        hooked = labels.unionByName(hooks).groupBy(*by, "id").agg(F.min("label").alias("label"))
        up = hooked.select(*by, F.col("id").alias("label"), F.col("label").alias("up"))
        fresh = cut(hooked.join(up, [*by, "label"], "left").select(*by, "id", F.least("label", F.coalesce("up", "label")).alias("label")))
        moved = fresh.join(labels.withColumnRenamed("label", "was"), [*by, "id"]).where("label <> was").limit(1).count()
        labels = fresh
        if not moved:
            return labels
