"""File catalogs: rows (file, sample_id, markers, channel_num, x, y, z) parsed from names, and the z axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE = r"(?i)\.(tiff?|nii|nrrd|mhd)$"
#: Row, column and slice in a raw file name such as ``a[03 x 01]_Z0012.tif``; brackets escaped.
POSITION = (r"\[(\d+)", r"(\d+)\]", r"Z(\d+)")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of image files below a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file"), "length").where(F.col("file").rlike(IMAGE))


def basename(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/\\]+)$", 1)


def _number(file: Column, pattern: str) -> Column:
    return F.expr("try_cast(x as int)") if pattern is None else F.regexp_extract(file, pattern, 1).try_cast("int")


def parse_raw(files: DataFrame, sample: str, markers: dict[str, str], position: tuple[str, str, str] = POSITION) -> DataFrame:
    """Catalog of raw tiles. ``markers`` maps a marker to the token (channel, folder or name part) that shows it; first match wins."""
    f = F.col("file")
    marker = F.coalesce(*[F.when(F.lower(f).contains(token.lower()), F.lit(m)) for m, token in markers.items()])
    channel = F.coalesce(*[F.when(marker == m, F.lit(k)) for k, m in enumerate(markers, 1)])
    y, x, z = (_number(basename(f), p) for p in position)
    out = files.select("file", F.lit(sample).alias("sample_id"), marker.alias("markers"), channel.cast("int").alias("channel_num"), x.alias("x"), y.alias("y"), z.alias("z"))
    return out.where("markers IS NOT NULL AND z IS NOT NULL")


def _parts(c: Column) -> Column:
    return F.split(basename(c), "[_.]")


def parse_aligned(files: DataFrame) -> DataFrame:
    """``<sample>_<zzzz>_C<c>_<marker>_0<y>_0<x>_aligned.tif``"""
    p = _parts(F.col("file"))
    n = lambda k: F.regexp_extract(F.try_element_at(p, F.lit(k)), r"(\d+)", 1).try_cast("int")
    return files.where(F.col("file").contains("_aligned")).select("file", F.element_at(p, 1).alias("sample_id"), F.try_element_at(p, F.lit(4)).alias("markers"), n(3).alias("channel_num"), n(6).alias("x"), n(5).alias("y"), n(2).alias("z"))


def parse_stitched(files: DataFrame) -> DataFrame:
    """``<sample>_<zzzz>_C<c>_<marker>_stitched.tif``: one tile, x = y = 1."""
    p = _parts(F.col("file"))
    n = lambda k: F.regexp_extract(F.try_element_at(p, F.lit(k)), r"(\d+)", 1).try_cast("int")
    return files.where(F.col("file").contains("_stitched")).select("file", F.element_at(p, 1).alias("sample_id"), F.try_element_at(p, F.lit(4)).alias("markers"), n(3).alias("channel_num"), F.lit(1).alias("x"), F.lit(1).alias("y"), n(2).alias("z"))


def parse_resampled(files: DataFrame) -> DataFrame:
    """``<sample>_C<c>_<marker>_<res>.nii``: a volume catalog."""
    p = _parts(F.col("file"))
    n = lambda k: F.regexp_extract(F.try_element_at(p, F.lit(k)), r"(\d+)", 1).try_cast("int")
    res = n(4).cast("double")
    return files.where(F.col("file").endswith(".nii")).select("file", F.element_at(p, 1).alias("sample_id"), F.try_element_at(p, F.lit(3)).alias("marker"), n(2).alias("channel_num"), res.alias("x_res"), res.alias("y_res"), res.alias("z_res"))


def renumber(catalog: DataFrame, by: list[str] | None = None) -> DataFrame:
    """x, y and z from 1 for each marker."""
    w = Window.partitionBy(*(by or ["sample_id", "markers"]))
    return catalog.select(*[(F.col(c) - F.min(c).over(w) + 1).cast("int").alias(c) if c in ("x", "y", "z") else F.col(c) for c in catalog.columns])


def common_z(catalog: DataFrame) -> DataFrame:
    """Slices that every tile of a sample has: from the greatest first to the least last slice."""
    tiles = catalog.groupBy("sample_id", "markers", "y", "x").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    span = tiles.groupBy("sample_id").agg(F.max("lo").alias("_lo"), F.min("hi").alias("_hi"))
    return catalog.join(span, "sample_id").where("z BETWEEN _lo AND _hi").drop("_lo", "_hi")


def complete_z(catalog: DataFrame, z: str = "z") -> DataFrame:
    """Drop slices with fewer rows than the fullest slice of their sample."""
    n = catalog.groupBy("sample_id", z).agg(F.count("*").alias("_n"))
    full = n.withColumn("_m", F.max("_n").over(Window.partitionBy("sample_id"))).where("_n = _m").select("sample_id", z)
    return catalog.join(full, ["sample_id", z], "left_semi")


def adjust_z(catalog: DataFrame, shifts: DataFrame) -> DataFrame:
    """Adds z_adj = z - dz of the tile and marker (y, x, markers, dz), then keeps complete slices."""
    moved = catalog.join(shifts, ["y", "x", "markers"], "left").withColumn("z_adj", F.col("z") - F.coalesce("dz", F.lit(0))).drop("dz")
    return complete_z(moved, "z_adj")


def linspace_slices(catalog: DataFrame, n: int) -> DataFrame:
    """The rows of ``n`` evenly spread slices of each sample; one slice is the last."""
    span = catalog.groupBy("sample_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / max(1, n - 1)
    picked = F.array(F.col("hi")) if n == 1 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.col("lo") + i * step).cast("int"))
    wanted = span.select("sample_id", F.explode(F.array_distinct(picked)).alias("z"))
    return catalog.join(wanted, ["sample_id", "z"], "left_semi")


def neighbours(catalog: DataFrame, axis: str) -> DataFrame:
    """Pairs of tiles next to each other along ``axis``, same slice and marker: file_1 before file_2."""
    same = [c for c in ("sample_id", "markers", "z", "y", "x") if c != axis]
    a = catalog.select(*same, F.col(axis), F.col("file").alias("file_1"))
    b = catalog.select(*same, (F.col(axis) - 1).alias(axis), F.col("file").alias("file_2"))
    return a.join(b, [*same, axis])


def z_window(reference: DataFrame, moving: DataFrame, window: int) -> DataFrame:
    """Reference slices with the moving slices within ``window``: a band join by naming the slices asked for."""
    asked = reference.select("sample_id", "y", "x", F.col("z").alias("ref_z"), F.explode(F.sequence(F.col("z") - window, F.col("z") + window)).alias("z"))
    return asked.join(moving.select("sample_id", "y", "x", "z", "file"), ["sample_id", "y", "x", "z"])


def in_groups(samples: DataFrame, groups: list[str]) -> DataFrame:
    """Samples that belong to all of the groups (column groups: array)."""
    return samples.where(F.size(F.array_except(F.array(*[F.lit(g) for g in groups]), F.col("groups"))) == 0)


def reroot(file: Column, old: str, new: str) -> Column:
    """Another base folder for paths below ``old``."""
    return F.when(file.startswith(old), F.concat(F.lit(new), F.substr(file, F.lit(len(old) + 1)))).otherwise(file)


def reroot_to(paths: DataFrame, path: str, held: DataFrame, base: str) -> DataFrame:
    """path, moved: the longest end of the old path that ``held`` (file, relative to ``base``) has, under ``base``; null where none is."""
    parts = F.split(F.trim(F.col(path), F.lit("/")), "/")
    ends = paths.select(path, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("_cut", "file"))
    found = ends.join(held.select("file").distinct(), "file").groupBy(path).agg(F.min_by("file", "_cut").alias("_end"))
    return paths.select(path).join(found, path, "left").select(path, F.concat(F.lit(base.rstrip("/") + "/"), "_end").alias("moved"))


def renamed(file: Column, dy: int, dx: int) -> Column:
    """File names with the tile numbers ``_yy_xx_`` moved by offsets, two digits each."""
    y, x = (F.regexp_extract(file, r"_(\d{2})_(\d{2})_", k).cast("int") + d for k, d in ((1, dy), (2, dx)))
    return F.concat(F.regexp_extract(file, r"^(.*)_\d{2}_\d{2}_", 1), F.lit("_"), F.lpad(y.cast("string"), 2, "0"), F.lit("_"), F.lpad(x.cast("string"), 2, "0"), F.lit("_"), F.regexp_extract(file, r"_\d{2}_\d{2}_(.*)$", 1))


def manifest(fields: DataFrame, wanted: list[str]) -> DataFrame:
    """Which of the wanted fields each sample has (sample_id, field)."""
    return fields.groupBy("sample_id").agg(*[F.bool_or(F.col("field") == w).alias(w) for w in wanted])


def base_name(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def only_file(asked: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Adds file: the one file of each key; null where the catalog has none or several."""
    one = catalog.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("file").alias("file")).where("_n = 1").drop("_n")
    return asked.join(one, keys, "left")


def by_substring(files: DataFrame, markers: list[str]) -> DataFrame:
    """file, marker, channel_num (from 1) for every marker that a file's name contains."""
    listed = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(k).alias("channel_num")) for k, m in enumerate(markers, 1)])
    held = F.filter(listed, lambda m: F.contains(F.col("file"), m["marker"]))
    return files.select("file", F.explode(held).alias("m")).select("file", "m.marker", "m.channel_num")


def kind(file: Column) -> Column:
    """aligned, stitched, resampled or raw, by the file's name."""
    name = base_name(file)
    return F.when(name.endswith("_aligned.tif"), "aligned").when(name.endswith("_stitched.tif"), "stitched").when(name.rlike(r"_C\d+_.*_\d+(\.\d+)?\.nii$"), "resampled").otherwise("raw")


def read_any(files: DataFrame, base: str, markers: dict[str, str]) -> DataFrame:
    """One catalog of files of all kinds: each by the reader of its kind, with a column kind; columns that a kind lacks are null."""
    kinds = files.withColumn("kind", kind(F.col("file")))
    of = lambda k: kinds.where(F.col("kind") == k).select("file")
    parts = {"raw": parse_raw(of("raw"), base, markers), "aligned": parse_aligned(of("aligned")), "stitched": parse_stitched(of("stitched")), "resampled": parse_resampled(of("resampled"))}
    out = None
    for k, part in parts.items():
        part = part.withColumn("kind", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
