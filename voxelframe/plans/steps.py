"""Plans of results, steps, names and label volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import learn, voxels
from ..sources import catalog, results
from . import views
from .registry import query
from .slices import TILES_SQL, tile_catalog
from .views import SQL


@query(SQL + """, a AS (SELECT sample_id, CAST(class AS INTEGER) AS class, annotation, count(*) AS n FROM cells WHERE sample_id < 'S4' GROUP BY ALL), b AS (SELECT sample_id, NULL::INTEGER AS class, annotation, count(*) AS n FROM cells GROUP BY ALL)
SELECT sample_id, annotation, n, class FROM a UNION ALL SELECT sample_id, annotation, n, class FROM b WHERE sample_id NOT IN (SELECT sample_id FROM a)""")
def final_results(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by class where a sample has classes, else its plain counts."""
    c = views.cells(spark, sf)
    classes = c.where("sample_id < 'S4'").groupBy("sample_id", "class", "annotation").agg(F.count("*").alias("n"))
    return results.final(classes, c.groupBy("sample_id", "annotation").agg(F.count("*").alias("n"))).select("sample_id", "annotation", "n", "class")


@query(TILES_SQL + "SELECT DISTINCT sample_id, z FROM cat WHERE (sample_id, z) NOT IN (SELECT (sample_id, z) FROM cat WHERE channel_num = 2 AND y = 1 AND x = 2)")
def pending_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Slices that a resumed step still has to do."""
    c = tile_catalog(spark, sf)
    return results.pending(c.select("sample_id", "z").distinct(), c.where("channel_num = 2 AND y = 1 AND x = 2"), ["sample_id", "z"])


@query(SQL + "SELECT sample_id, CASE WHEN sample_id IN ('S0', 'S1', 'S2') THEN 'a' ELSE 'b' END AS grp, count(*) AS n FROM cells GROUP BY ALL")
def checked_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with their compare group; one of another group would be an error."""
    return results.grouped(views.cells(spark, sf).drop("grp"), {"a": ["S0", "S1", "S2"], "b": ["S3", "S4", "S5"]}).groupBy("sample_id", "grp").agg(F.count("*").alias("n"))


@query(TILES_SQL + ", one AS (SELECT sample_id, markers, z, min(file) AS file FROM cat GROUP BY ALL HAVING count(*) = 1) SELECT p.sample_id, p.z, m.markers, one.file, count(*) AS n FROM cells p CROSS JOIN (VALUES ('topro'), ('ctip2')) m(markers) LEFT JOIN one ON one.sample_id = p.sample_id AND one.z = p.z AND one.markers = m.markers GROUP BY ALL")
def file_of_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The one file of each point's slice and marker; none where there are several."""
    asked = views.cells(spark, sf).groupBy("sample_id", "z").agg(F.count("*").alias("n")).withColumn("markers", F.explode(F.array(F.lit("topro"), F.lit("ctip2"))))
    return catalog.only_file(asked, tile_catalog(spark, sf), ["sample_id", "z", "markers"]).select("sample_id", "z", "markers", "file", "n")


@query(TILES_SQL + "SELECT file, string_split(file, '/')[-1] AS name, t.shift FROM cat JOIN (SELECT DISTINCT string_split(file, '/')[-1] AS name, z * 2 + x AS shift FROM cat WHERE channel_num = 1 AND sample_id = 'S0') t ON t.name = string_split(file, '/')[-1]")
def alignment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment parameters found by the end of a file's path."""
    c = tile_catalog(spark, sf)
    rows = c.where("channel_num = 1 AND sample_id = 'S0'").select(catalog.base_name(F.col("file")).alias("name"), (F.col("z") * 2 + F.col("x")).alias("shift")).distinct()
    return c.select("file", catalog.base_name(F.col("file")).alias("name")).join(rows, "name").select("file", "name", "shift")


@query(TILES_SQL + "SELECT file, m.marker, CAST(m.k AS INTEGER) AS channel_num FROM cat JOIN (VALUES ('C1', 1), ('C2', 2)) m(marker, k) ON contains(file, m.marker)")
def catalog_by_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Files by the marker that their names contain."""
    return catalog.by_substring(tile_catalog(spark, sf).select("file"), ["C1", "C2"])


@query(TILES_SQL + """, f AS (SELECT sample_id || '_' || lpad(z::VARCHAR, 4, '0') || '_C' || c || '_m' || c || '_0' || y || '_0' || x || '_aligned.tif' AS file, 'aligned' AS kind FROM names
UNION ALL SELECT DISTINCT sample_id || '_' || lpad(z::VARCHAR, 4, '0') || '_C' || c || '_m' || c || '_stitched.tif', 'stitched' FROM names UNION ALL SELECT DISTINCT sample_id || '_C' || c || '_m' || c || '_25.nii', 'resampled' FROM names UNION ALL SELECT file, 'raw' FROM names)
SELECT kind, count(*) AS n FROM f GROUP BY kind""")
def catalog_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of each file, by which the reader of its names is chosen."""
    c = tile_catalog(spark, sf)
    made = c.select(F.format_string("%s_%04d_C%d_m%d_0%d_0%d_aligned.tif", "sample_id", "z", "channel_num", "channel_num", "y", "x").alias("file"))
    made = made.union(c.select(F.format_string("%s_%04d_C%d_m%d_stitched.tif", "sample_id", "z", "channel_num", "channel_num")).distinct()).union(c.select(F.format_string("%s_C%d_m%d_25.nii", "sample_id", "channel_num", "channel_num")).distinct()).union(c.select("file"))
    return made.groupBy(catalog.kind(F.col("file")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id, replace(event_type, '_', '-') AS replaced, replace(event_type, 'e', '') AS erased, CASE WHEN contains(event_type, '_') THEN split_part(event_type, '_', 1) ELSE '' END AS before, CASE WHEN contains(event_type, '_') THEN substr(event_type, strpos(event_type, '_') + 1) ELSE '' END AS after FROM events")
def string_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Replace, erase, and what stands before or after a mark (empty without it)."""
    e, t = views.table(spark, sf, "events"), F.col("event_type")
    return e.select("event_id", F.replace(t, F.lit("_"), F.lit("-")).alias("replaced"), F.replace(t, F.lit("e")).alias("erased"), scalar.before(t, "_").alias("before"), scalar.after(t, "_").alias("after"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INTEGER) AS hour FROM events")
def time_stamps(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))


@query(TILES_SQL + "SELECT file, CASE markers WHEN 'topro' THEN 0.5::DOUBLE WHEN 'ctip2' THEN 0.75::DOUBLE END AS gain FROM cat")
def marker_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """A parameter of each file by its marker."""
    gains = F.create_map(F.lit("topro"), F.lit(0.5), F.lit("ctip2"), F.lit(0.75), F.lit("other"), F.lit(1.0))
    return tile_catalog(spark, sf).select("file", F.element_at(gains, F.col("markers")).alias("gain"))


@query("SELECT event_type, list_sort(list_filter(list(DISTINCT split_part(props, ':', 1)), lambda q: q IS NOT NULL AND q <> '')) AS kept FROM events GROUP BY event_type")
def compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Lists without their empty entries."""
    e = views.table(spark, sf, "events").groupBy("event_type").agg(F.collect_set(F.split_part("props", F.lit(":"), F.lit(1))).alias("l"))
    return e.select("event_type", F.sort_array(F.filter("l", lambda v: v.isNotNull() & (v != ""))).alias("kept"))


@query("SELECT p_partkey, CAST('0x' || substr(md5(p_partkey || ':3'), 1, 8) AS BIGINT) < CAST(floor(0.8 * 4294967296) AS BIGINT) AS first FROM part")
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A repeatable split by ratio."""
    a, b = learn.split(views.table(spark, sf, "part").select("p_partkey"), "p_partkey", 0.8, 3)
    return a.withColumn("first", F.lit(True)).unionByName(b.withColumn("first", F.lit(False)))


@query(SQL + ", v AS (SELECT sample_id, grp, annotation, count(*)::DOUBLE AS n FROM cells GROUP BY ALL), m AS (SELECT annotation, grp, sum(n) / 3 AS mean FROM v GROUP BY ALL) SELECT annotation, round(max(mean) FILTER (grp = 'WT'), 6) AS wt, round(max(mean) FILTER (grp = 'KO'), 6) AS ko FROM m GROUP BY annotation")
def group_average(spark: SparkSession, sf: str) -> DataFrame:
    """Average of each group's samples; a sample without a structure counts as 0."""
    n = views.cells(spark, sf).groupBy("annotation", "grp").agg((F.count("*") / 3).alias("mean"))
    return n.groupBy("annotation").agg(*[F.round(F.max(F.when(F.col("grp") == g, F.col("mean"))), 6).alias(g.lower()) for g in ("WT", "KO")])


@query(SQL + ", v AS (SELECT y, x, z, max(intensity_1)::DOUBLE AS value FROM cells GROUP BY y, x, z) SELECT y, x, z, CAST(round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 65535) AS INTEGER) AS value FROM v")
def rescaled_16_bit(spark: SparkSession, sf: str) -> DataFrame:
    v = views.cells(spark, sf).groupBy("y", "x", "z").agg(F.max("intensity_1").cast("double").alias("value"))
    return voxels.to_16_bit(v, "value")


@query(SQL + "SELECT y, x, z, bool_and(structure_index % 2 = 0) AND count(DISTINCT k) = 2 AS both FROM (SELECT y, x, z, structure_index, 0 AS k FROM mask UNION ALL SELECT y, x, z, annotation, 1 FROM cells WHERE annotation > 0) GROUP BY y, x, z")
def mask_and(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels that two label volumes both give to the structures asked for."""
    a = views.mask(spark, sf)
    b = views.cells(spark, sf).where("annotation > 0").select("y", "x", "z", F.col("annotation").alias("structure_index"))
    return voxels.mask_and([a, b], F.col("structure_index") % 2 == 0)


@query(SQL + """, p AS (SELECT y, x, z, CAST(y + (x - 1) * 50 + (z - 1) * 550 AS BIGINT) AS id FROM cells WHERE class = 1 AND intensity_1 > 95000 GROUP BY y, x, z),
o AS (SELECT a.i AS dy, b.i AS dx, c.i AS dz FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i) WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 4)
SELECT CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, CAST(z + dz AS INTEGER) AS z, arg_min(id, (dy * dy + dx * dx + dz * dz) * 1000000 + id) AS label FROM p, o WHERE y + dy BETWEEN 1 AND 50 AND x + dx BETWEEN 1 AND 11 AND z + dz BETWEEN 1 AND 7 GROUP BY ALL""")
def grown_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Points grown to balls; a voxel of two goes to the nearer, then to the lesser id."""
    from ..operators.points import linear_index

    p = views.cells(spark, sf).where("class = 1 AND intensity_1 > 95000").select("y", "x", "z").distinct()
    return voxels.grow(p.withColumn("id", linear_index(F.col("y"), F.col("x"), F.col("z"), 50, 11)), 2, (50, 11, 7))


@query(SQL + ", c AS (SELECT structure_index, avg(y) AS cy, avg(x) AS cx, avg(z) AS cz FROM mask GROUP BY structure_index) SELECT y, x, z, structure_index FROM mask JOIN c USING (structure_index) WHERE cy > 10 AND cy < 41 AND cx > 3 AND cx < 9 AND cz > 2 AND cz < 6")
def edge_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    """Labels whose centroid lies clear of the volume's edges."""
    return voxels.trim_edges(views.mask(spark, sf), "structure_index", (50, 11, 7), (10, 3, 2))


@query(SQL + ", s AS (SELECT DISTINCT 1000 + (structure_index % 3) AS k FROM mask) SELECT y, x, z, CAST(structure_index % 3 = 0 AS INTEGER) AS l0, CAST(structure_index % 3 = 1 AS INTEGER) AS l1, CAST(structure_index % 3 = 2 AS INTEGER) AS l2 FROM mask")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    m = views.mask(spark, sf)
    return m.select("y", "x", "z", *[c.alias(f"l{k}") for k, c in enumerate(voxels.one_hot(F.col("structure_index") % 3, [0, 1, 2]))])


@query(SQL + """, v AS (SELECT y, x, z, max(intensity_1)::DOUBLE AS value FROM cells GROUP BY y, x, z), s AS (SELECT CAST(ceil(y * 0.5) AS INTEGER) AS y, CAST(ceil(x * 0.5) AS INTEGER) AS x, z, avg(value) AS value FROM v GROUP BY ALL)
SELECT y, x, CAST(ceil(z * 0.4) AS INTEGER) AS z, round(avg(value), 6) AS value FROM s GROUP BY y, x, ceil(z * 0.4)""")
def isotropic(spark: SparkSession, sf: str) -> DataFrame:
    """A volume brought to one resolution: first within slices, then along columns."""
    v = views.cells(spark, sf).groupBy("y", "x", "z").agg(F.max("intensity_1").cast("double").alias("value"))
    return voxels.isotropic(v, (5.0, 5.0, 4.0), 10.0, "value").withColumn("value", F.round("value", 6))
