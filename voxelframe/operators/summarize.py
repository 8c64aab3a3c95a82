"""Per-structure counts, volumes and densities, in long form; wide only at the sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ontology import rollup

#: Volume of a voxel of 25 um in cubic millimetres.
VOXEL_MM3 = 0.025**3


def cell_counts(cells: DataFrame, classes: list[int]) -> DataFrame:
    """sample_id, annotation, class, n over annotated cells of the kept classes."""
    return cells.where((F.col("annotation") > 0) & F.col("class").isin(classes)).groupBy("sample_id", "annotation", "class").agg(F.count("*").alias("n"))


def on_grid(counts: DataFrame, structure: DataFrame, samples: DataFrame, classes: list[int]) -> DataFrame:
    """sample_id, id, class, n for every combination; what is absent counts 0.

    The grid is samples x structures x classes, dimensions only; it doesn't grow with the points.
    """
    kinds = counts.sparkSession.createDataFrame([(c,) for c in classes], "class int")
    grid = samples.select("sample_id").distinct().crossJoin(structure.select("id")).crossJoin(F.broadcast(kinds))
    return grid.join(counts, ["sample_id", "id", "class"], "left").select("sample_id", "id", "class", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def structure_counts(cells: DataFrame, structure: DataFrame, classes: list[int]) -> DataFrame:
    """Counts rolled up the ontology, on the whole grid."""
    rolled = rollup(cell_counts(cells, classes), structure, "annotation", ["sample_id", "class"], "n")
    return on_grid(rolled, structure, cells, classes)


def class_totals(counts: DataFrame) -> DataFrame:
    """Adds class 0, the sum over all classes."""
    total = counts.groupBy("sample_id", "id").agg(F.sum("n").alias("n")).withColumn("class", F.lit(0))
    return counts.unionByName(total.select("sample_id", "id", "class", "n"))


def volumes(mask: DataFrame, structure: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Voxels and cubic millimetres of each structure with all below it."""
    by = by or []
    voxels = mask.where("structure_index > 0").groupBy(*by, F.col("structure_index").alias("annotation")).agg(F.count("*").alias("n_voxels"))
    return rollup(voxels, structure, "annotation", by, "n_voxels").withColumn("volume", F.col("n_voxels") * VOXEL_MM3)


def densities(counts: DataFrame, volume: DataFrame) -> DataFrame:
    """Cells a cubic millimetre; null where a structure has no volume."""
    joined = counts.join(volume.select("id", "volume"), "id", "left")
    return joined.withColumn("density", F.try_divide(F.col("n").cast("double"), F.col("volume")))


def custom_class(expression: str, columns: dict[int, Column]) -> Column:
    """An arithmetic expression over classes, such as ``CT1/(CT1+CT2)``; x/0 gives 0.

    Parsed here into column operations; only CT<number>, numbers and + - * / ( ) are understood.
    """
    parts = re.findall(r"CT\d+|\d+\.?\d*|[-+*/()]|\S", expression)
    at = 0

    def peek() -> str:
        return parts[at] if at < len(parts) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return parts[at - 1]

    def factor() -> Column:
        t = take() if peek() else ""
        if t == "(":
            inner = total()
            if not peek() or take() != ")":
                raise ValueError(f"unbalanced brackets in {expression!r}")
            return inner
        if t == "-":
            return -factor()
        if t.startswith("CT") and int(t[2:]) in columns:
            return columns[int(t[2:])].cast("double")
        if re.fullmatch(r"\d+\.?\d*", t):
            return F.lit(float(t))
        raise ValueError(f"cannot read {t!r} in {expression!r}")

    def product() -> Column:
        out = factor()
        while peek() in ("*", "/") and peek():
            out = out * factor() if take() == "*" else F.try_divide(out, factor())
        return out

    def total() -> Column:
        out = product()
        while peek() in ("+", "-") and peek():
            out = out + product() if take() == "+" else out - product()
        return out

    out = total()
    if at < len(parts):
        raise ValueError(f"cannot read {peek()!r} in {expression!r}")
    return F.coalesce(out, F.lit(0.0))


def wide(long: DataFrame, keys: list[str], names: Column, value: str, labels: list[str]) -> DataFrame:
    """One column per label, for a sheet; absent is 0. ``labels`` are stated, so no extra pass finds them."""
    return long.withColumn("_name", names).groupBy(*keys).pivot("_name", labels).agg(F.sum(value)).fillna(0, labels)
