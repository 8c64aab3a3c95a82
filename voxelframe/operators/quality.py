"""Detection quality against labelled voxels, overlap measures, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detection(voxels: DataFrame, hits: DataFrame) -> DataFrame:
    """Labels hit several times, merged (no hit but predicted), missed and correct; hits in no label; precision and recall.

    ``voxels`` has y, x, z, label (0: none), prediction; ``hits`` distinct y, x, z.
    """
    marked = voxels.join(hits.withColumn("_hit", F.lit(1)), ["y", "x", "z"], "left")
    labels = marked.where("label > 0").groupBy("label").agg(F.count("_hit").alias("n_hits"), F.sum("prediction").alias("s"))
    k = labels.agg(F.count_if(F.expr("n_hits > 1")).alias("mult"), F.count_if(F.expr("n_hits = 0 AND s > 0")).alias("merged"), F.count_if(F.expr("n_hits = 0 AND s = 0")).alias("missed"), F.count_if(F.expr("n_hits = 1")).alias("correct"))
    stray = hits.join(voxels.where("label > 0"), ["y", "x", "z"], "left_anti").agg(F.count("*").alias("empty"))
    correct = F.col("correct").cast("double")
    both = k.crossJoin(stray)
    return both.withColumn("precision", F.try_divide(correct, F.col("correct") + F.col("mult") + F.col("empty"))).withColumn("recall", F.try_divide(correct, F.col("correct") + F.col("merged") + F.col("missed")))


def uncertain(p: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """Per cent of values strictly between two bounds."""
    return 100 * F.avg(((p > low) & (p < high)).cast("double"))


def confusion(rows: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """One row per true class, a column per predicted class, and the share that agrees."""
    same = F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("agreement")
    return rows.groupBy(truth).agg(*[F.count_if(F.col(predicted) == c).alias(f"p{c}") for c in classes], same)


def dice(t: Column, p: Column, smooth: float = 1.0) -> Column:
    return (2.0 * F.sum(t * p) + smooth) / (F.sum(t) + F.sum(p) + smooth)


def tversky(t: Column, p: Column, alpha: float, beta: float, smooth: float = 1.0) -> Column:
    both = F.sum(t * p)
    return (both + smooth) / (both + alpha * F.sum((1 - t) * p) + beta * F.sum(t * (1 - p)) + smooth)


def weighted_dice(rows: DataFrame, by: str, t: Column, p: Column, smooth: float = 1e-5) -> DataFrame:
    """Mean of the Dice coefficients of the classes."""
    return rows.groupBy(by).agg(((2.0 * (F.sum(t * p) + smooth / 2)) / (F.sum(t) + F.sum(p) + smooth)).alias("d")).agg(F.avg("d").alias("weighted_dice"))
