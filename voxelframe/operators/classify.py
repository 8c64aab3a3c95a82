"""Classification of points by thresholds: expressions, codes, scores, reports."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import median_mad, rank_percentile

FULL_SCALE = 65535.0


def parse_threshold(text: str) -> list[tuple[float, str, float | None]]:
    """Terms of a threshold expression such as ``mean + 2.5*std`` or ``prctile(90)``: factor, statistic, argument.

    Terms are added. Anything else, a minus sign too, is an error.
    """
    terms = []
    for t in re.split(r"\s*\+\s*", text.strip()):
        m = re.fullmatch(r"(?:(\d+\.?\d*)\s*\*\s*)?(mean|median|mode|std|mad|prctile)(?:\((\d+\.?\d*)\))?", t)
        if not m or (m[2] == "prctile") != (m[3] is not None):
            raise ValueError(f"cannot read {t!r} in threshold {text!r}")
        terms.append((float(m[1] or 1), m[2], float(m[3]) if m[3] else None))
    return terms


def expression_thresholds(values: DataFrame, by: list[str], value: str, text: str) -> DataFrame:
    """``by``, threshold: the expression over each group's values."""
    terms = parse_threshold(text)
    out = median_mad(values, by, value)
    total = F.lit(0.0)
    for k, (factor, name, argument) in enumerate(terms):
        if name == "prctile":
            out = out.join(rank_percentile(values, by, value, argument).withColumnRenamed("percentile", f"_p{k}"), by)
            total = total + factor * F.col(f"_p{k}")
        else:
            total = total + factor * F.col({"std": "sd"}.get(name, name))
    return out.select(*by, total.alias("threshold"))


def manual_threshold(t: float) -> float:
    """A stated threshold on the 16-bit scale: 0 < t < 1 is a share, t > 1 is taken as is, all else (1 too) is 0."""
    return t * FULL_SCALE if 0 < t < 1 else t if t > 1 else 0.0


def class_codes(n: int) -> dict[tuple[int, ...], int]:
    """Codes from 1: marker patterns by number of positive markers, then descending as binary numbers."""
    patterns = sorted(product((1, 0), repeat=n), key=sum)
    return {p: k for k, p in enumerate(patterns, 1)}


def class_of(markers: list[Column]) -> Column:
    """The class code of a vector of positive (true) markers."""
    number = sum((m.cast("int") * 2 ** (len(markers) - 1 - k) for k, m in enumerate(markers)), F.lit(0))
    table = {int("".join(map(str, p)), 2): c for p, c in class_codes(len(markers)).items()}
    return F.element_at(F.array(*[F.lit(table[k]) for k in range(len(table))]), number + 1)


def zscore(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w)


def zscores(values: DataFrame, by: list[str], value: str, clip: float | None = None) -> DataFrame:
    """Adds zscore, by two aggregates joined back instead of a window that holds a group in a task; optionally clipped."""
    m = values.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    z = (F.col(value) - F.col("_mean")) / F.col("_sd")
    if clip is not None:
        z = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))
    return values.join(F.broadcast(m) if not by else m, by, "inner").withColumn("zscore", z).drop("_mean", "_sd") if by else values.crossJoin(F.broadcast(m)).withColumn("zscore", z).drop("_mean", "_sd")


def log_compress(x: Column, limit: float) -> Column:
    """Beyond the limit only the logarithm of the excess counts, on both sides."""
    return F.when(x > limit, limit + F.log10(F.when(x > limit, x - limit + 1).otherwise(1))).when(x < -limit, -limit - F.log10(F.when(x < -limit, -x - limit + 1).otherwise(1))).otherwise(x)


def low_class(values: DataFrame, channels: list[str], p: float, by: list[str]) -> DataFrame:
    """Adds low: every channel is below its own percentile."""
    out = values
    for k, c in enumerate(channels):
        cut = rank_percentile(values, by, c, p).withColumnRenamed("percentile", f"_cut{k}")
        out = out.join(cut, by)
    low = F.lit(True)
    for k, c in enumerate(channels):
        low = low & (F.col(c) < F.col(f"_cut{k}"))
    return out.withColumn("low", low).drop(*[f"_cut{k}" for k in range(len(channels))])


def report(cells: DataFrame, by: list[str], intensities: list[str]) -> DataFrame:
    """Count, share and mean intensities of each class."""
    counted = cells.groupBy(*by, "class").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in intensities])
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def cascade(probabilities: list[Column], confidence: float) -> Column:
    """Two-marker call from class probabilities: the greatest if sure, else 0."""
    out = F.lit(0)
    for k in reversed(range(len(probabilities))):
        out = F.when(probabilities[k] > confidence, k + 1).otherwise(out)
    return out
