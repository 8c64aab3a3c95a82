"""Dense volumes in long form: y, x, z and a value, zeros absent."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subset(mask: DataFrame, keep: DataFrame) -> DataFrame:
    """Labels outside ``keep`` (id) become 0."""
    k = keep.select(F.col("id").alias("_k")).distinct()
    return mask.join(k, mask.structure_index == F.col("_k"), "left").withColumn("structure_index", F.coalesce("_k", F.lit(0).cast("bigint"))).drop("_k")


def crop_pad(volume: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """Centre a volume in other sizes: crop what is outside; what is new is absent (0)."""
    out = volume
    for c, a, b in zip("yxz", old, new, strict=True):
        shift = (b - a) // 2 if b >= a else -((a - b) // 2)
        out = out.withColumn(c, F.col(c) + shift).where(F.col(c).between(1, b))
    return out


def mirrored(volume: DataFrame, size: int, axis: str = "x") -> DataFrame:
    """A half volume and its mirror image, side by side along ``axis``."""
    return volume.unionByName(volume.withColumn(axis, F.lit(2 * size + 1) - F.col(axis)))


def half(volume: DataFrame, size: int, left: bool = True, axis: str = "x") -> DataFrame:
    """One hemisphere, numbered from 1."""
    middle = size // 2
    return volume.where(F.col(axis) <= middle) if left else volume.where(F.col(axis) > middle).withColumn(axis, F.col(axis) - middle)


def nearest_resize(volume: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """Nearest-neighbour resize: every new voxel takes the old one at its centre.

    Each old voxel names the new voxels it feeds, so nothing is joined.
    """
    out = volume
    for c, a, b in zip("yxz", old, new, strict=True):
        lo = F.ceil((F.col(c) - 1) * (b / a) + 0.5).cast("int")
        hi = (F.ceil(F.col(c) * (b / a) + 0.5) - 1).cast("int")
        out = out.where(lo <= hi).withColumn(c, F.explode(F.sequence(lo, hi)))
    return out


def projection(volume: DataFrame, value: str, along: str = "z") -> DataFrame:
    """Maximum along an axis."""
    return volume.groupBy(*[c for c in "yxz" if c != along]).agg(F.max(value).alias(value))


def bounding_box(volume: DataFrame) -> DataFrame:
    return volume.agg(*[f(c).cast("int").alias(f"{c}_{n}") for c in "yxz" for n, f in (("min", F.min), ("max", F.max))])


def border(mask: DataFrame) -> DataFrame:
    """Voxels of which one of the 26 neighbours is missing: those with fewer than 26 found."""
    shifts = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, "yxz", strict=True)]) for s in product((-1, 0, 1), repeat=3) if any(s)])
    called = mask.select("y", "x", "z").withColumn("s", F.explode(shifts)).select(*[(F.col(c) + F.col(f"s.{c}")).alias(c) for c in "yxz"])
    full = called.groupBy("y", "x", "z").agg(F.count("*").alias("n")).where("n = 26")
    return mask.join(full, ["y", "x", "z"], "left_anti")


def centroids(labelled: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Mean coordinates, size and greatest value of each label; weighted where a weight is given."""
    w = weight if weight is not None else F.lit(1.0)
    return labelled.groupBy(*by).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in "yxz"], F.count("*").alias("size"))


def flatmap(paths: DataFrame, volume: DataFrame, value: str, method: str = "mean") -> DataFrame:
    """Combine a volume along the voxels of each flat-map position: ``paths`` has position, y, x, z."""
    f = {"mean": F.avg, "sum": F.sum, "max": F.max}[method]
    return paths.join(volume, ["y", "x", "z"]).groupBy("position").agg(f(value).alias(value))


def label_of(scores: Column, least: float) -> Column:
    """Position from 1 of the greatest class score; 0 where that is under ``least``."""
    top = F.array_max(scores)
    return F.when(top < least, 0).otherwise(F.array_position(scores, top)).cast("int")


def semi_quantile(volume: DataFrame, value: str) -> DataFrame:
    """Values of each slice scaled from its own range to one that runs linearly from the first slice to the last."""
    per = volume.groupBy("z").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = per.agg(F.min("z").alias("z1"), F.max("z").alias("z2"), F.min_by("lo", "z").alias("lo1"), F.max_by("lo", "z").alias("lo2"), F.min_by("hi", "z").alias("hi1"), F.max_by("hi", "z").alias("hi2"))
    part = F.when(F.col("z2") == F.col("z1"), 0.0).otherwise((F.col("z") - F.col("z1")) / (F.col("z2") - F.col("z1")))
    j = volume.join(F.broadcast(per.crossJoin(ends)), "z")
    lo, hi = F.col("lo1") + part * (F.col("lo2") - F.col("lo1")), F.col("hi1") + part * (F.col("hi2") - F.col("hi1"))
    unit = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return j.withColumn(value, lo + unit * (hi - lo)).select(*volume.columns)


def rank_labels(mask: DataFrame, label: str) -> DataFrame:
    """Dictionary encoding: labels numbered 1, 2, ... in their order; over the distinct labels, then joined."""
    names = mask.select(label).distinct().withColumn("code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)))
    return mask.join(names, label)


def to_16_bit(volume: DataFrame, value: str) -> DataFrame:
    """Values stretched from their least and greatest to 0..65535, rounded; a constant volume gives 0."""
    ends = volume.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    unit = (F.col(value) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return volume.crossJoin(F.broadcast(ends)).withColumn(value, F.round(unit * 65535).cast("int")).drop("_lo", "_hi")


def mask_and(volumes: list[DataFrame], wanted: Column, label: str = "structure_index") -> DataFrame:
    """y, x, z, both: whether every volume has the voxel and gives it a wanted label, wherever one has it."""
    one = None
    for k, v in enumerate(volumes):
        part = v.select("y", "x", "z", label, F.lit(k).alias("_k"))
        one = part if one is None else one.unionByName(part)
    held = one.groupBy("y", "x", "z", "_k").agg(F.bool_and(wanted).alias("_w"))
    return held.groupBy("y", "x", "z").agg((F.bool_and("_w") & (F.count("*") == len(volumes))).alias("both"))


def grow(points: DataFrame, radius: int, dims: tuple[int, int, int]) -> DataFrame:
    """y, x, z, label: balls around the points (id, y, x, z) within the volume; a voxel of several goes to the nearest point, then to the least id."""
    span = range(-radius, radius + 1)
    ball = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x"), F.lit(c).alias("z"), F.lit(a * a + b * b + c * c).alias("d")) for a in span for b in span for c in span if a * a + b * b + c * c <= radius * radius])
    grown = points.withColumn("_o", F.explode(ball)).select(*[(F.col(c) + F.col(f"_o.{c}")).cast("int").alias(c) for c in "yxz"], F.struct(F.col("_o.d").alias("d"), F.col("id")).alias("m"))
    for c, n in zip("yxz", dims, strict=True):
        grown = grown.where(F.col(c).between(1, n))
    return grown.groupBy("y", "x", "z").agg(F.min("m")["id"].alias("label"))


def trim_edges(labels: DataFrame, label: str, dims: tuple[int, int, int], margin: tuple[int, int, int]) -> DataFrame:
    """Voxels of the labels whose centroid lies more than ``margin`` from every face of the volume."""
    middle = centroids(labels, [label]).drop("size")
    for c, n, m in zip("yxz", dims, margin, strict=True):
        middle = middle.where((F.col(c) > m) & (F.col(c) < n + 1 - m))
    return labels.join(middle.select(label), label, "left_semi").select("y", "x", "z", label)


def one_hot(label: Column, labels: list[int]) -> list[Column]:
    return [F.when(label == k, 1).otherwise(0) for k in labels]


def isotropic(volume: DataFrame, res: tuple[float, float, float], out: float, value: str) -> DataFrame:
    """The volume at resolution ``out`` on all axes: averages of the pixels of a slice, then of the slices of a column."""
    at = lambda c, r: F.ceil(F.col(c) * (r / out)).cast("int").alias(c)
    flat = volume.groupBy(at("y", res[0]), at("x", res[1]), "z").agg(F.avg(value).alias(value))
    return flat.groupBy("y", "x", at("z", res[2])).agg(F.avg(value).alias(value))
