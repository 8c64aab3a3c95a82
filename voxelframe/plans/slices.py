"""Plans over file catalogs, slices and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align
from ..sources import catalog
from . import views
from .registry import query
from .views import SQL

TILES_SQL = SQL + """, tiles AS (SELECT DISTINCT 'S' || (l_orderkey % 6) AS sample_id, CAST(l_linenumber % 3 AS INTEGER) AS y, CAST(l_suppkey % 4 AS INTEGER) AS x, CAST(l_quantity AS INTEGER) + CAST(l_suppkey % 4 AS INTEGER) AS z, CAST(l_partkey % 2 AS INTEGER) + 1 AS c FROM lineitem),
names AS (SELECT 'in/' || sample_id || '/C' || c || '/t[' || lpad(y::VARCHAR, 2, '0') || ' x ' || lpad(x::VARCHAR, 2, '0') || ']_Z' || lpad(z::VARCHAR, 4, '0') || '.tif' AS file, * FROM tiles),
cat AS (SELECT file, sample_id, CASE c WHEN 1 THEN 'topro' ELSE 'ctip2' END AS markers, c AS channel_num, x, y, z FROM names)"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """File names of a made-up acquisition, built from line items."""
    li = views.table(spark, sf, "lineitem")
    x = (F.col("l_suppkey") % 4).cast("int")
    t = li.select(F.concat(F.lit("S"), (F.col("l_orderkey") % 6).cast("string")).alias("s"), (F.col("l_linenumber") % 3).cast("int").alias("y"), x.alias("x"), (F.col("l_quantity").cast("int") + x).alias("z"), ((F.col("l_partkey") % 2).cast("int") + 1).alias("c")).distinct()
    return t.select(F.format_string("in/%s/C%d/t[%02d x %02d]_Z%04d.tif", "s", "c", "y", "x", "z").alias("file"))


def tile_catalog(spark: SparkSession, sf: str) -> DataFrame:
    raw = catalog.parse_raw(tiles(spark, sf), "", {"topro": "/C1/", "ctip2": "/C2/"})
    return raw.withColumn("sample_id", F.regexp_extract("file", "in/([^/]+)/", 1))


@query(TILES_SQL + "SELECT file, sample_id, markers, CAST(channel_num AS INTEGER) AS channel_num, x, y, z FROM cat")
def catalog_parse(spark: SparkSession, sf: str) -> DataFrame:
    return tile_catalog(spark, sf)


@query(TILES_SQL + "SELECT sample_id || '_' || lpad(z::VARCHAR, 4, '0') || '_C' || c || '_m' || c || '_0' || y || '_0' || x || '_aligned.tif' AS file, sample_id, 'm' || c AS markers, c AS channel_num, x, y, z FROM names")
def catalog_aligned(spark: SparkSession, sf: str) -> DataFrame:
    c = tile_catalog(spark, sf)
    files = c.select(F.format_string("%s_%04d_C%d_m%d_0%d_0%d_aligned.tif", "sample_id", "z", "channel_num", "channel_num", "y", "x").alias("file"))
    return catalog.parse_aligned(files)


@query(TILES_SQL + "SELECT DISTINCT sample_id || '_' || lpad(z::VARCHAR, 4, '0') || '_C' || c || '_m' || c || '_stitched.tif' AS file, sample_id, 'm' || c AS markers, c AS channel_num, 1 AS x, 1 AS y, z FROM names")
def catalog_stitched(spark: SparkSession, sf: str) -> DataFrame:
    c = tile_catalog(spark, sf)
    files = c.select(F.format_string("%s_%04d_C%d_m%d_stitched.tif", "sample_id", "z", "channel_num", "channel_num").alias("file")).distinct()
    return catalog.parse_stitched(files)


@query(TILES_SQL + "SELECT DISTINCT sample_id || '_C' || c || '_m' || c || '_25.nii' AS file, sample_id, 'm' || c AS marker, c AS channel_num, 25.0::DOUBLE AS x_res, 25.0::DOUBLE AS y_res, 25.0::DOUBLE AS z_res FROM names")
def catalog_resampled(spark: SparkSession, sf: str) -> DataFrame:
    files = tile_catalog(spark, sf).select(F.format_string("%s_C%d_m%d_25.nii", "sample_id", "channel_num", "channel_num").alias("file")).distinct()
    return catalog.parse_resampled(files)


@query(TILES_SQL + "SELECT file, CAST(x - min(x) OVER w + 1 AS INTEGER) AS x, CAST(y - min(y) OVER w + 1 AS INTEGER) AS y, CAST(z - min(z) OVER w + 1 AS INTEGER) AS z FROM cat WINDOW w AS (PARTITION BY sample_id, markers)")
def renumber_axes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.renumber(tile_catalog(spark, sf)).select("file", "x", "y", "z")


@query(TILES_SQL + ", t AS (SELECT sample_id, min(z) AS lo, max(z) AS hi FROM cat GROUP BY sample_id, markers, y, x), s AS (SELECT sample_id, max(lo) AS lo, min(hi) AS hi FROM t GROUP BY sample_id) SELECT file FROM cat JOIN s USING (sample_id) WHERE z BETWEEN lo AND hi")
def common_z_range(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.common_z(tile_catalog(spark, sf)).select("file")


@query(TILES_SQL + ", n AS (SELECT sample_id, z, count(*) AS n FROM cat GROUP BY ALL) SELECT file FROM cat JOIN (SELECT * FROM n QUALIFY n = max(n) OVER (PARTITION BY sample_id)) USING (sample_id, z)")
def complete_z_only(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.complete_z(tile_catalog(spark, sf)).select("file")


@query(TILES_SQL + ", a AS (SELECT *, z - x AS z_adj FROM cat), n AS (SELECT sample_id, z_adj, count(*) AS n FROM a GROUP BY ALL) SELECT file, z_adj FROM a JOIN (SELECT * FROM n QUALIFY n = max(n) OVER (PARTITION BY sample_id)) USING (sample_id, z_adj)")
def adjust_z(spark: SparkSession, sf: str) -> DataFrame:
    c = tile_catalog(spark, sf)
    shifts = c.select("y", "x", "markers", F.col("x").alias("dz")).distinct()
    return catalog.adjust_z(c, shifts).select("file", "z_adj")


@query(TILES_SQL + ", s AS (SELECT sample_id, min(z) AS lo, max(z) AS hi FROM cat GROUP BY sample_id) SELECT file FROM cat c WHERE z IN (SELECT CAST(round(lo + i * (hi - lo) / 4.0::DOUBLE) AS INTEGER) FROM s, range(0, 5) r(i) WHERE s.sample_id = c.sample_id)")
def linspace_sample(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.linspace_slices(tile_catalog(spark, sf), 5).select("file")


@query(TILES_SQL + "SELECT a.file AS file_1, b.file AS file_2 FROM cat a JOIN cat b ON a.sample_id = b.sample_id AND a.markers = b.markers AND a.z = b.z AND a.y = b.y AND b.x = a.x + 1")
def tile_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.neighbours(tile_catalog(spark, sf), "x").select("file_1", "file_2")


@query(TILES_SQL + "SELECT r.sample_id, r.y, r.x, r.z AS ref_z, m.z, m.file FROM cat r JOIN cat m ON r.sample_id = m.sample_id AND r.y = m.y AND r.x = m.x AND m.z BETWEEN r.z - 2 AND r.z + 2 WHERE r.markers = 'topro' AND m.markers = 'ctip2'")
def zwindow_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = tile_catalog(spark, sf)
    return catalog.z_window(c.where("markers = 'topro'"), c.where("markers = 'ctip2'"), 2).select("sample_id", "y", "x", "ref_z", "z", "file")


@query(TILES_SQL + "SELECT file, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY z, channel_num, x, y) AS INTEGER) AS position FROM cat")
def grid_sort(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy("z", "channel_num", "x", "y")
    return tile_catalog(spark, sf).select("file", F.row_number().over(w).alias("position"))


@query(TILES_SQL + "SELECT sample_id, count(*) AS n_files, count(DISTINCT (y, x)) AS n_tiles, count(DISTINCT y) AS n_rows, count(DISTINCT x) AS n_cols, count(DISTINCT markers) AS n_markers FROM cat GROUP BY sample_id")
def distinct_tiles(spark: SparkSession, sf: str) -> DataFrame:
    c = tile_catalog(spark, sf)
    return c.groupBy("sample_id").agg(F.count("*").alias("n_files"), F.count_distinct("y", "x").alias("n_tiles"), F.count_distinct("y").alias("n_rows"), F.count_distinct("x").alias("n_cols"), F.count_distinct("markers").alias("n_markers"))


@query(SQL + "SELECT DISTINCT annotation FROM cells WHERE class = 1 EXCEPT SELECT DISTINCT annotation FROM cells WHERE class = 2 AND y > 48 AND x = 3")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    c = views.cells(spark, sf)
    return c.where("class = 1").select("annotation").distinct().join(c.where("class = 2 AND y > 48 AND x = 3"), "annotation", "left_anti")


@query(SQL + "SELECT DISTINCT y, x, z FROM cells WHERE class = 1 INTERSECT SELECT DISTINCT y, x, z FROM cells WHERE class = 3")
def row_intersection(spark: SparkSession, sf: str) -> DataFrame:
    c = views.cells(spark, sf).select("class", "y", "x", "z")
    return c.where("class = 1").drop("class").intersect(c.where("class = 3").drop("class"))


@query(SQL + "SELECT DISTINCT y, x, z, annotation FROM cells")
def row_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).select("y", "x", "z", "annotation").distinct()


@query(SQL + "SELECT l_returnflag AS value, min(l_orderkey * 10 + l_linenumber) AS first_at FROM lineitem GROUP BY l_returnflag")
def stable_unique(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_at"))


@query(SQL + """, s AS (SELECT sample_id, z, x AS pos, sum(intensity_2) AS score FROM cells GROUP BY ALL), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sample_id, z ORDER BY round(score, 6) DESC, pos) = 1),
u AS (SELECT sample_id, pos, round(sum(round(score, 6)), 4) AS total FROM t GROUP BY ALL) SELECT sample_id, CAST(pos AS INTEGER) AS pos, total FROM u QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY total DESC, pos) = 1""")
def score_argmax_z(spark: SparkSession, sf: str) -> DataFrame:
    s = views.cells(spark, sf).groupBy("sample_id", "z", F.col("x").alias("pos")).agg(F.round(F.sum("intensity_2"), 6).alias("score"))
    out = align.best_position(s, ["sample_id"], "z", "pos", "score")
    return out.select("sample_id", F.col("pos").cast("int").alias("pos"), F.round("total", 4).alias("total"))


@query(SQL + """, w AS (SELECT tile, z, max(CASE WHEN value IS NOT NULL THEN z END) OVER (PARTITION BY tile ORDER BY z) AS za, min(CASE WHEN value IS NOT NULL THEN z END) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS zb FROM series)
SELECT w.tile, w.z, CASE WHEN za IS NOT NULL AND (zb IS NULL OR w.z - za <= zb - w.z) THEN a.value ELSE b.value END AS filled FROM w LEFT JOIN series a ON a.tile = w.tile AND a.z = w.za LEFT JOIN series b ON b.tile = w.tile AND b.z = w.zb""")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return align.asof_nearest(views.series(spark, sf), ["tile"], "z", "value").select("tile", "z", "filled")


@query(SQL + """, w AS (SELECT tile, z, value, max(CASE WHEN value IS NOT NULL THEN z END) OVER (PARTITION BY tile ORDER BY z) AS za, min(CASE WHEN value IS NOT NULL THEN z END) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS zb FROM series)
SELECT w.tile, w.z, round(CASE WHEN w.za = w.zb THEN a.value ELSE a.value + (b.value - a.value) / (w.zb - w.za) * (w.z - w.za) END, 6) AS filled FROM w JOIN series a ON a.tile = w.tile AND a.z = w.za JOIN series b ON b.tile = w.tile AND b.z = w.zb""")
def interp_linear(spark: SparkSession, sf: str) -> DataFrame:
    s = views.series(spark, sf)
    inner = s.where("value IS NOT NULL").groupBy("tile").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    out = align.interpolate(s, ["tile"], "z", "value").join(inner, "tile").where("z BETWEEN lo AND hi")
    return out.select("tile", "z", F.round("filled", 6).alias("filled"))


@query(SQL + """, s AS (SELECT tile, z, coalesce(value, 0) AS v FROM series), m AS (SELECT tile, z, v, list(v) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS l FROM s),
n AS (SELECT *, list_median(l) AS mid FROM m) SELECT tile, z, abs(v - mid) > 3 * 1.4826::DOUBLE * list_median(list_transform(l, lambda q: abs(q - mid))) AS outlier FROM n""")
def moving_median_outlier(spark: SparkSession, sf: str) -> DataFrame:
    s = views.series(spark, sf).select("tile", "z", F.coalesce("value", F.lit(0.0)).alias("v"))
    return align.moving_outliers(s, ["tile"], "z", "v").select("tile", "z", "outlier")


@query(SQL + """, md AS (SELECT sample_id, x AS mode FROM (SELECT sample_id, x, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, x) AS k FROM cells GROUP BY sample_id, x) WHERE k = 1)
SELECT sample_id, CASE WHEN abs(x - mode) > 3 THEN mode ELSE x END AS adjusted, count(*) AS n FROM cells JOIN md USING (sample_id) GROUP BY ALL""")
def displacement_outlier(spark: SparkSession, sf: str) -> DataFrame:
    out = align.displacement_outliers(views.cells(spark, sf).select("sample_id", "x"), ["sample_id"], "x", 3)
    return out.groupBy("sample_id", "adjusted").agg(F.count("*").alias("n"))


@query(SQL + "SELECT tile, z, value, CAST(row_number() OVER (PARTITION BY tile ORDER BY value DESC, z) AS INTEGER) AS rank FROM series WHERE value IS NOT NULL QUALIFY rank <= 5")
def topk_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return align.top_peaks(views.series(spark, sf).where("value IS NOT NULL"), ["tile"], "value", "z", 5).select("tile", "z", "value", "rank")


@query(SQL + """, span AS (SELECT min(z) AS lo, max(z) AS hi FROM series), c AS (SELECT CAST(k + 1 AS INTEGER) AS chunk, lo + k * 24 AS a, lo + k * 24 + 31 AS b FROM span, range(0, 100000) r(k) WHERE k = 0 OR lo + k * 24 + 7 < hi)
SELECT c.chunk, count(*) AS n, CAST(min(z) AS INTEGER) AS first_z, CAST(max(z) AS INTEGER) AS last_z FROM series JOIN c ON z BETWEEN a AND b GROUP BY c.chunk""")
def chunk_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return align.chunks(views.series(spark, sf), "z", 32, 8).groupBy("chunk").agg(F.count("*").alias("n"), F.min("z").alias("first_z"), F.max("z").alias("last_z"))


@query()
def mst_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of a 3 x 4 tile grid per sample; edges weigh as the files that both tiles have."""
    c = tile_catalog(spark, sf)
    tile = F.col("y") * 4 + F.col("x")
    first = c.groupBy("sample_id", tile.alias("tile"), "y", "x").agg(F.min("z").alias("z0"), F.count("*").alias("n"))
    near = lambda axis, d: first.alias("a").join(first.alias("b"), F.expr(f"a.sample_id = b.sample_id AND {'a.y = b.y AND b.x = a.x + 1' if axis == 'x' else 'a.x = b.x AND b.y = a.y + 1'}")).select(F.col("a.sample_id").alias("sample_id"), F.col("a.tile").alias("a"), F.col("b.tile").alias("b"), (F.col("b.z0") - F.col("a.z0")).cast("double").alias("shift"), F.least("a.n", "b.n").cast("double").alias("weight"))
    return align.tile_offsets(near("x", 1).unionByName(near("y", 4)))


@query(SQL + """, s AS MATERIALIZED (SELECT * FROM series), f AS (SELECT tile, z, value::DOUBLE AS followed FROM s WHERE z = 1
  UNION ALL SELECT s.tile, s.z, CASE WHEN f.followed IS NULL THEN s.value WHEN abs(s.value - f.followed) <= 50 THEN s.value ELSE f.followed END FROM f JOIN s ON s.tile = f.tile AND s.z = f.z + 1)
SELECT s.tile, s.z, s.value::DOUBLE AS value, followed FROM f JOIN s USING (tile, z)""")
def followed_translation(spark: SparkSession, sf: str) -> DataFrame:
    return align.follow(views.series(spark, sf).withColumn("value", F.col("value").cast("double")), ["tile"], "z", "value", 50.0)


@query()
def steady_translation(spark: SparkSession, sf: str) -> DataFrame:
    """Values far from the median of all accepted earlier ones give way to the last accepted one; tests hold it against plain Python."""
    return align.steady(views.series(spark, sf).withColumn("value", F.col("value").cast("double")), ["tile"], "z", "value", 60.0)


@query(SQL + """, s AS (SELECT tile, z, coalesce(value, 0) AS v FROM series), m AS (SELECT tile, z, v, list(v) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS l FROM s),
n AS (SELECT *, list_median(l) AS mid FROM m), o AS (SELECT tile, z, CASE WHEN abs(v - mid) > 3 * 1.4826::DOUBLE * list_median(list_transform(l, lambda q: abs(q - mid))) THEN NULL ELSE v END AS v FROM n),
w AS (SELECT tile, z, v, max(CASE WHEN v IS NOT NULL THEN z END) OVER (PARTITION BY tile ORDER BY z) AS za, min(CASE WHEN v IS NOT NULL THEN z END) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS zb FROM o)
SELECT w.tile, w.z, round(CASE WHEN w.za = w.zb THEN a.v ELSE a.v + (b.v - a.v) / (w.zb - w.za) * (w.z - w.za) END, 6) AS filled FROM w JOIN o a ON a.tile = w.tile AND a.z = w.za JOIN o b ON b.tile = w.tile AND b.z = w.zb""")
def outliers_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Moving-median outliers replaced along the line of their neighbours; ends that have no neighbour on one side are left out here."""
    s = views.series(spark, sf).select("tile", "z", F.coalesce("value", F.lit(0.0)).alias("v"))
    out = align.fill_outliers(s, ["tile"], "z", "v")
    inner = out.where("NOT outlier").groupBy("tile").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return out.join(inner, "tile").where("z BETWEEN lo AND hi").select("tile", "z", F.round("filled", 6).alias("filled"))


@query(TILES_SQL + """, old AS (SELECT '/mnt/old/' || sample_id || '/data/' || file AS path FROM cat), held AS (SELECT file FROM cat WHERE channel_num = 1 UNION SELECT 'data/' || file FROM cat WHERE sample_id = 'S1'),
parts AS (SELECT path, string_split(trim(path, '/'), '/') AS p FROM old), suffixes AS (SELECT path, i, array_to_string(p[i:], '/') AS suffix FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM parts))
SELECT path, (SELECT '/new/' || arg_min(suffix, i) FROM suffixes s JOIN held ON held.file = s.suffix WHERE s.path = o.path) AS moved FROM old o""")
def rerooted(spark: SparkSession, sf: str) -> DataFrame:
    """Paths under another base folder: the longest end of the old path that is there."""
    c = tile_catalog(spark, sf)
    old = c.select(F.concat(F.lit("/mnt/old/"), "sample_id", F.lit("/data/"), "file").alias("path"))
    held = c.where("channel_num = 1").select("file").union(c.where("sample_id = 'S1'").select(F.concat(F.lit("data/"), "file")))
    return catalog.reroot_to(old, "path", held, "/new")


@query("SELECT p_partkey, round(CAST('0x' || substr(h, 1, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS r, round(CAST('0x' || substr(h, 3, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS g, round(CAST('0x' || substr(h, 5, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS b, h AS hex FROM (SELECT p_partkey, upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6)) AS h FROM part)")
def hex_to_rgb(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalar import hex_rgb, rgb_hex

    h = views.table(spark, sf, "part").select("p_partkey", F.upper(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6)).alias("h"))
    rgb = [c.alias(n) for c, n in zip(hex_rgb(F.col("h")), "rgb", strict=True)]
    out = h.select("p_partkey", *rgb)
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in "rgb"], rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@query("SELECT CAST(i AS INTEGER) AS i, round(CASE WHEN i = 1 THEN 1 WHEN i = 20 THEN 0 ELSE 1 - (1 / (1 + exp(0.5::DOUBLE * (10.5 - i)))) END, 6) AS weight FROM range(1, 21) r(i)")
def blend_weights(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalar import sigmoid_weights

    return spark.range(1).select(F.posexplode(sigmoid_weights(20, 0.5)).alias("i", "weight")).select((F.col("i") + 1).alias("i"), F.round("weight", 6).alias("weight"))


@query("SELECT event_id, regexp_extract(props, '\"([a-z_]+)\"', 1) AS first_key, length(props) AS n, split_part(event_type, '_', 1) AS head, printf('%04d', event_id % 1000) AS code, bin(event_id % 64) AS bits FROM events")
def string_functions(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events")
    return e.select("event_id", F.regexp_extract("props", '"([a-z_]+)"', 1).alias("first_key"), F.length("props").cast("bigint").alias("n"), F.split_part("event_type", F.lit("_"), F.lit(1)).alias("head"), F.format_string("%04d", F.col("event_id") % 1000).alias("code"), F.bin(F.col("event_id") % 64).alias("bits"))


@query(SQL + """, pix AS (SELECT sample_id, z, intensity_1 AS v FROM cells), p AS (SELECT sample_id, z, v, row_number() OVER (PARTITION BY sample_id, z ORDER BY v) AS i, count(*) OVER (PARTITION BY sample_id, z) AS n FROM pix),
q AS (SELECT *, least(greatest(n * 0.9::DOUBLE + 0.5, 1), n)::DOUBLE AS pos FROM p), s AS (SELECT sample_id, z, max(CASE WHEN i = floor(pos) THEN v END) AS lo, max(CASE WHEN i = ceil(pos) THEN v END) AS hi, max(pos) AS pos FROM q GROUP BY ALL)
SELECT sample_id, round(median(t), 4) AS mid, round(max(t), 4) AS top, round(avg(t), 4) AS mean FROM (SELECT sample_id, lo + (pos - floor(pos)) * (hi - lo) AS t FROM s) WHERE t > 0 GROUP BY sample_id""")
def stack_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.stats import rank_percentile

    per = rank_percentile(views.cells(spark, sf), ["sample_id", "z"], "intensity_1", 90.0).where("percentile > 0")
    return per.groupBy("sample_id").agg(F.round(F.median("percentile"), 4).alias("mid"), F.round(F.max("percentile"), 4).alias("top"), F.round(F.avg("percentile"), 4).alias("mean"))


@query("SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: hourly windows of the event stream, as the batch form of ``streaming.windows``."""
    from ..streaming.windows import tumbling

    out = tumbling(views.table(spark, sf, "events"), "1 hour")
    return out.select("event_type", F.floor(F.unix_timestamp(F.col("window.start")) / 3600).cast("bigint").alias("hour"), "n", F.round("total", 4).alias("total"))
