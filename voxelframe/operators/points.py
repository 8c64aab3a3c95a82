"""Point tables: coordinates, lookup in label volumes, neighbourhoods, de-duplication."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .working import cut


def rescale(c: Column, res_in: float, res_out: float) -> Column:
    """Coordinate at another resolution, rounded half away from zero."""
    return F.round(c * (res_in / res_out)).cast("int")


def linear_index(y: Column, x: Column, z: Column, ny: int, nx: int) -> Column:
    """Column-major index from 1."""
    return (y + (x - 1) * ny + (z - 1) * ny * nx).cast("bigint")


def subscripts(index: Column, ny: int, nx: int) -> tuple[Column, Column, Column]:
    """The inverse of ``linear_index``."""
    k = index - 1
    return (k % ny + 1).cast("int"), (F.floor(k / ny) % nx + 1).cast("int"), (F.floor(k / (ny * nx)) + 1).cast("int")


#: Axis of each orientation letter; the first of a pair runs against the second.
AXES = {"a": 0, "p": 0, "s": 1, "i": 1, "l": 2, "r": 2}


def permute(columns: list[Column], sizes: list[int], source: str, target: str) -> list[Column]:
    """Coordinates in another orientation, such as ``ail`` to ``rsp``; a flipped axis counts from its size."""
    if len(source) != 3 or len(target) != 3 or any(c not in AXES for c in source + target) or len({AXES[c] for c in source}) < 3 or len({AXES[c] for c in target}) < 3:
        raise ValueError(f"orientations need three letters, one of each axis: {source!r}, {target!r}")
    out = []
    for c in target:
        k = next(i for i, s in enumerate(source) if AXES[s] == AXES[c])
        out.append(columns[k] if source[k] == c else F.lit(sizes[k] + 1) - columns[k])
    return out


def annotate(points: DataFrame, mask: DataFrame, res: tuple[float, float, float], mask_res: float, dims: tuple[int, int, int], by: list[str] | None = None, rounding: str = "round") -> DataFrame:
    """Adds annotation: the label of the voxel a point falls into; 0 outside labels.

    ``round`` clamps to the volume; ``floor`` doesn't, so points outside get 0. Nine-figure point
    tables meet the mask in one equi-join on the voxel.
    """
    by = by or []
    cols = []
    for c, r, n in zip("yxz", res, dims, strict=True):
        v = F.col(c) * (r / mask_res)
        v = F.least(F.greatest(F.round(v), F.lit(1)), F.lit(n)) if rounding == "round" else F.floor(v)
        cols.append(v.cast("int").alias(f"_m{c}"))
    label = mask.select(*by, *[F.col(c).alias(f"_m{c}") for c in "yxz"], F.col("structure_index").alias("_label"))
    joined = points.select("*", *cols).join(label, [*by, "_my", "_mx", "_mz"], "left")
    return joined.withColumn("annotation", F.coalesce("_label", F.lit(0)).cast("bigint")).drop("_label", "_my", "_mx", "_mz")


def neighbourhood(points: DataFrame, pixels: DataFrame, key: list[str], radius: int = 1, value: str = "value") -> DataFrame:
    """Mean and maximum of the pixels within ``radius`` in y and x, in the same slice, per point.

    A band join as an equi-join: each point asks for its (2r+1)^2 pixels by name; those outside
    the image are absent.
    """
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in product(range(-radius, radius + 1), repeat=2)])
    asked = points.withColumn("_o", F.explode(offsets)).select(*key, (F.col("y") + F.col("_o.dy")).alias("_y"), (F.col("x") + F.col("_o.dx")).alias("_x"), F.col("z").alias("_z"))
    found = asked.join(pixels.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("z").alias("_z"), F.col(value).alias("_v")), ["_y", "_x", "_z"])
    return found.groupBy(*key).agg(F.avg("_v").alias("mean"), F.max("_v").alias("max"), F.count("*").alias("n_pixels"))


def box(points: DataFrame, centre: tuple[int, int, int], half: tuple[int, int, int]) -> DataFrame:
    """Points within a box; plain range predicates, which reach the scan."""
    out = points
    for c, m, h in zip("yxz", centre, half, strict=True):
        out = out.where(F.col(c).between(m - h, m + h))
    return out


def _near(points: DataFrame, radius: float) -> DataFrame:
    """a, b, d2: ordered pairs of ids within ``radius``, each with itself too; by buckets of one radius and their 27 neighbours."""
    bucket = lambda c: F.floor(F.col(c) / radius)
    home = points.select("id", "y", "x", "z", *[bucket(c).alias(f"b{c}") for c in "yxz"])
    shifts = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, "yxz", strict=True)]) for s in product((-1, 0, 1), repeat=3)])
    asks = home.withColumn("s", F.explode(shifts)).select(F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "yxz"], *[(F.col(f"b{c}") + F.col(f"s.{c}")).alias(f"b{c}") for c in "yxz"])
    d2 = sum(((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "yxz"), F.lit(0))
    return asks.join(home, ["by", "bx", "bz"]).select("a", F.col("id").alias("b"), d2.alias("d2")).where(F.col("d2") <= radius * radius)


def touching_removal(points: DataFrame, radius: float = 2.0) -> DataFrame:
    """Drop every point that isn't the least id of some ball of ``radius`` around a point.

    A ball with several members keeps its least id only, so a point can go because of
    a neighbour's neighbour.
    """
    near = _near(points, radius)
    least = near.groupBy("a").agg(F.min("b").alias("least"))
    gone = near.join(least, "a").where("b <> least").select(F.col("b").alias("id")).distinct()
    return points.join(gone, "id", "left_anti")


def nearest(points: DataFrame, others: DataFrame, cell: float, reach: int = 1) -> DataFrame:
    """id, other, distance: the closest other point (least id on ties) within ``reach`` grid cells; beyond, no row.

    Equi-join on grid cells. Every point whose nearest lies within cell * reach is exact;
    callers widen the grid for the remainder.
    """
    span = range(-reach, reach + 1)
    bucket = lambda c: F.floor(F.col(c) / cell)
    shifts = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, "yxz", strict=True)]) for s in product(span, repeat=3)])
    asks = points.withColumn("s", F.explode(shifts)).select("id", *[F.col(c).alias(f"a{c}") for c in "yxz"], *[(bucket(c) + F.col(f"s.{c}")).alias(f"b{c}") for c in "yxz"])
    there = others.select(F.col("id").alias("other"), "y", "x", "z", *[bucket(c).alias(f"b{c}") for c in "yxz"])
    d2 = sum(((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "yxz"), F.lit(0))
    found = asks.join(there, ["by", "bx", "bz"]).select("id", F.struct(d2.cast("double").alias("d2"), F.col("other")).alias("m")).groupBy("id").agg(F.min("m").alias("m"))
    return found.where(F.col("m.d2") <= (cell * reach) ** 2).select("id", F.col("m.other").alias("other"), F.sqrt("m.d2").alias("distance"))


def nearest_any(points: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """id, other, distance: the closest other point of every point, however far; no rows without other points.

    The grid is widened twofold for the points that have none yet; each widening is kept in the shared checkpoint folder.
    """
    found = cut(nearest(points, others, cell))
    if others.isEmpty():
        return found
    while True:
        rest = points.join(found, "id", "left_anti")
        if rest.isEmpty():
            return found
        cell *= 2
        found = cut(found.unionByName(nearest(rest, others, cell)))


def lookup(points: DataFrame, volume: DataFrame, res: tuple[float, float, float], volume_res: float, dims: tuple[int, int, int], values: list[str]) -> DataFrame:
    """Adds ``values`` of the volume's voxel that a point falls into, at the volume's resolution; points outside take the voxel at the edge.

    Coordinates are rounded half away from zero and clamped to 1..dims; voxels that the volume lacks give null.
    """
    place = [F.least(F.greatest(F.round(F.col(c) * (r / volume_res)), F.lit(1)), F.lit(n)).cast("int").alias(f"_v{c}") for c, r, n in zip("yxz", res, dims, strict=True)]
    there = volume.select(*[F.col(c).alias(f"_v{c}") for c in "yxz"], *values)
    return points.select("*", *place).join(there, ["_vy", "_vx", "_vz"], "left").drop("_vy", "_vx", "_vz")


def local_background(pixels: DataFrame, size: int, value: str = "value") -> DataFrame:
    """y, x, z, background, deviation of a coarse grid: mean and sample deviation of the pixels of each block of ``size`` in y and x."""
    block = lambda c: (F.floor((F.col(c) - 1) / size) + 1).cast("int")
    return pixels.groupBy(block("y").alias("y"), block("x").alias("x"), "z").agg(F.avg(value).alias("background"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"))


def voxel_counts(points: DataFrame, res: tuple[float, float, float], grid: float, dims: tuple[int, int, int], by: list[str]) -> DataFrame:
    """Points per voxel of a coarse grid, those outside dropped."""
    placed = points
    for c, r in zip("yxz", res, strict=True):
        placed = placed.withColumn(f"v{c}", rescale(F.col(c), r, grid))
    for c, n in zip("yxz", dims, strict=True):
        placed = placed.where(F.col(f"v{c}").between(1, n))
    return placed.groupBy(*by, "vy", "vx", "vz").agg(F.count("*").alias("n"))


def with_alpha(points: DataFrame) -> DataFrame:
    """Distinct positions with their count and its share of the greatest."""
    counted = points.groupBy("y", "x", "z").agg(F.count("*").alias("n"))
    top = counted.agg(F.max("n").alias("_top"))
    return counted.crossJoin(F.broadcast(top)).withColumn("alpha", F.col("n") / F.col("_top")).drop("_top")
