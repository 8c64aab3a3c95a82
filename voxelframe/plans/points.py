"""Plans over points, voxels and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, points, quality, stats, voxels
from . import views
from .registry import query
from .views import SQL


@query(SQL + """SELECT p.sample_id, coalesce(m.structure_index, 0) AS annotation, count(*) AS n FROM (SELECT sample_id, CAST(least(greatest(round(y * 0.5), 1), 20) AS INTEGER) AS my, CAST(least(greatest(round(x * 0.5), 1), 5) AS INTEGER) AS mx, CAST(least(greatest(round(z * 0.5), 1), 3) AS INTEGER) AS mz FROM cells) p
LEFT JOIN mask m ON m.y = my AND m.x = mx AND m.z = mz GROUP BY ALL""")
def annotate_points(spark: SparkSession, sf: str) -> DataFrame:
    p = views.cells(spark, sf).drop("annotation")
    return points.annotate(p, views.mask(spark, sf), (5.0, 5.0, 5.0), 10.0, (20, 5, 3)).groupBy("sample_id", "annotation").agg(F.count("*").alias("n"))


@query(SQL + """SELECT p.sample_id, coalesce(m.structure_index, 0) AS annotation, count(*) AS n FROM (SELECT sample_id, CAST(floor(y * 0.5) AS INTEGER) AS my, CAST(floor(x * 0.5) AS INTEGER) AS mx, CAST(floor(z * 0.5) AS INTEGER) AS mz FROM cells) p
LEFT JOIN mask m ON m.y = my AND m.x = mx AND m.z = mz GROUP BY ALL""")
def annotate_points_floor(spark: SparkSession, sf: str) -> DataFrame:
    p = views.cells(spark, sf).drop("annotation")
    return points.annotate(p, views.mask(spark, sf), (5.0, 5.0, 5.0), 10.0, (20, 5, 3), rounding="floor").groupBy("sample_id", "annotation").agg(F.count("*").alias("n"))


@query(SQL + """, px AS (SELECT y, x, z, max(intensity_1) AS value FROM cells GROUP BY y, x, z), pt AS (SELECT DISTINCT y, x, z FROM cells WHERE class = 1)
SELECT pt.y, pt.x, pt.z, round(avg(value), 6) AS mean, max(value) AS max, count(*) AS n_pixels FROM pt JOIN px ON px.z = pt.z AND px.y BETWEEN pt.y - 1 AND pt.y + 1 AND px.x BETWEEN pt.x - 1 AND pt.x + 1 GROUP BY ALL""")
def neighbourhood_mean(spark: SparkSession, sf: str) -> DataFrame:
    c = views.cells(spark, sf)
    px = c.groupBy("y", "x", "z").agg(F.max("intensity_1").alias("value"))
    out = points.neighbourhood(c.where("class = 1").select("y", "x", "z").distinct(), px, ["y", "x", "z"])
    return out.select("y", "x", "z", F.round("mean", 6).alias("mean"), "max", "n_pixels")


@query(SQL + "SELECT sample_id, y, x, z, annotation, CAST(class AS INTEGER) AS class FROM cells WHERE y BETWEEN 21 AND 29 AND x BETWEEN 4 AND 8 AND z BETWEEN 3 AND 5")
def box_query(spark: SparkSession, sf: str) -> DataFrame:
    return points.box(views.cells(spark, sf), (25, 6, 4), (4, 2, 1)).select("sample_id", "y", "x", "z", "annotation", "class")


@query(SQL + "SELECT z, count(*) AS n FROM cells WHERE z BETWEEN 3 AND 5 GROUP BY z")
def slab_query(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).where(F.col("z").between(3, 5)).groupBy("z").agg(F.count("*").alias("n"))


@query(SQL + """, k AS (SELECT DISTINCT y, x, z, CAST(y + (x - 1) * 50 + (z - 1) * 550 AS BIGINT) AS i FROM cells)
SELECT i, y, x, z, CAST(round(y * 0.25) AS INTEGER) AS ry, CAST(round(x * 0.25) AS INTEGER) AS rx, CAST(round(z * 0.25) AS INTEGER) AS rz FROM k""")
def rescale_index(spark: SparkSession, sf: str) -> DataFrame:
    k = views.cells(spark, sf).select(points.linear_index(F.col("y"), F.col("x"), F.col("z"), 50, 11).alias("i")).distinct()
    y, x, z = points.subscripts(F.col("i"), 50, 11)
    back = k.select("i", y.alias("y"), x.alias("x"), z.alias("z"))
    return back.select("*", *[points.rescale(F.col(c), 10.0, 40.0).alias(f"r{c}") for c in "yxz"])


@query(SQL + "SELECT DISTINCT 12 - x AS a, y AS b, 8 - z AS c FROM cells")
def permute_points(spark: SparkSession, sf: str) -> DataFrame:
    out = points.permute([F.col("y"), F.col("x"), F.col("z")], [50, 11, 7], "ail", "sar")
    return views.cells(spark, sf).select(*[c.cast("int").alias(n) for c, n in zip(out, "abc", strict=True)]).distinct()


@query(SQL + """, p AS (SELECT y, x, z, row_number() OVER (ORDER BY y, x, z) AS id FROM (SELECT DISTINCT y, x, z FROM cells)),
near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 4),
gone AS (SELECT DISTINCT b FROM (SELECT b, min(b) OVER (PARTITION BY a) AS least FROM near) WHERE b <> least)
SELECT y, x, z FROM p WHERE id NOT IN (SELECT b FROM gone)""")
def touching_removal(spark: SparkSession, sf: str) -> DataFrame:
    p = views.cells(spark, sf).select("y", "x", "z").distinct()
    return points.touching_removal(p.withColumn("id", points.linear_index(F.col("z"), F.col("x"), F.col("y"), 7, 11)), 2.0).select("y", "x", "z")


@query(SQL + """, p AS (SELECT DISTINCT class, y, x, z, CAST(y + (x - 1) * 50 + (z - 1) * 550 AS BIGINT) AS id FROM cells),
a AS (SELECT * FROM p WHERE class = 1), b AS (SELECT * FROM p WHERE class = 2),
d AS (SELECT a.id, b.id AS other, (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) AS d2 FROM a, b)
SELECT id, arg_min(other, d2::BIGINT * 1000000 + other) AS other, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY id""")
def nearest_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    """Every point of class 1 asks for the nearest of class 2, however far."""
    i = points.linear_index(F.col("y"), F.col("x"), F.col("z"), 50, 11)
    p = views.cells(spark, sf).select("class", "y", "x", "z", i.alias("id")).distinct()
    return points.nearest_any(p.where("class = 1"), p.where("class = 2"), 2.0).select("id", "other", F.round("distance", 6).alias("distance"))


@query(SQL + """, px AS (SELECT y, x, z, max(intensity_1) AS value FROM cells GROUP BY y, x, z), b AS (SELECT CAST(floor((y - 1) / 5) + 1 AS INTEGER) AS y, CAST(floor((x - 1) / 5) + 1 AS INTEGER) AS x, z, avg(value) AS background, coalesce(stddev_samp(value), 0) AS deviation FROM px GROUP BY ALL),
p AS (SELECT DISTINCT y, x, z, CAST(least(greatest(round(y * 0.2), 1), 10) AS INTEGER) AS gy, CAST(least(greatest(round(x * 0.2), 1), 3) AS INTEGER) AS gx, CAST(least(greatest(z, 1), 7) AS INTEGER) AS gz FROM cells WHERE class = 1)
SELECT p.y, p.x, p.z, round(background, 6) AS background, round(deviation, 3) AS deviation FROM p LEFT JOIN b ON b.y = gy AND b.x = gx AND b.z = gz""")
def background_at_points(spark: SparkSession, sf: str) -> DataFrame:
    """Background and local deviation of a coarse grid at every point."""
    c = views.cells(spark, sf)
    px = c.groupBy("y", "x", "z").agg(F.max("intensity_1").alias("value"))
    p = c.where("class = 1").select("y", "x", "z").distinct()
    out = points.lookup(p, points.local_background(px, 5), (1.0, 1.0, 5.0), 5.0, (10, 3, 7), ["background", "deviation"])
    return out.select("y", "x", "z", F.round("background", 6).alias("background"), F.round("deviation", 3).alias("deviation"))


@query(SQL + """SELECT CAST(class AS INTEGER) AS class, vy, vx, vz, count(*) AS n FROM (SELECT class, CAST(round(y * 0.4) AS INTEGER) AS vy, CAST(round(x * 0.4) AS INTEGER) AS vx, CAST(round(z * 0.4) AS INTEGER) AS vz FROM cells) WHERE vy BETWEEN 1 AND 18 AND vx BETWEEN 1 AND 4 AND vz BETWEEN 1 AND 2 GROUP BY ALL""")
def voxel_counts(spark: SparkSession, sf: str) -> DataFrame:
    return points.voxel_counts(views.cells(spark, sf), (4.0, 4.0, 4.0), 10.0, (18, 4, 2), ["class"])


VOXEL_SQL = SQL + """, vc AS (SELECT sample_id, grp, CAST(round(y * 0.4) AS INTEGER) AS vy, CAST(round(x * 0.4) AS INTEGER) AS vx, CAST(round(z * 0.4) AS INTEGER) AS vz, count(*)::DOUBLE AS n FROM cells GROUP BY ALL),
g AS (SELECT vy, vx, vz, s.sample_id, s.grp, coalesce(n, 0) AS value FROM (SELECT DISTINCT vy, vx, vz FROM vc) v CROSS JOIN (SELECT DISTINCT sample_id, grp FROM cells) s LEFT JOIN vc USING (vy, vx, vz, sample_id, grp)),
m AS (SELECT vy, vx, vz, avg(value) FILTER (grp = 'WT') AS m1, avg(value) FILTER (grp = 'KO') AS m2, var_samp(value) FILTER (grp = 'WT') AS v1, var_samp(value) FILTER (grp = 'KO') AS v2 FROM g GROUP BY ALL)"""
#: p of t with four degrees of freedom in closed form
P4 = "(1 - (t / sqrt(4 + t * t)) * (1 + 2 / (4 + t * t)))"


@query(VOXEL_SQL + f", t AS (SELECT *, abs(m1 - m2) / sqrt((v1 + v2) / 2 * (2.0 / 3)) AS t FROM m WHERE m1 > 1 AND m2 > 1 AND v1 + v2 > 0) SELECT vy, vx, vz, round((m2 - m1) / m1, 6) AS fold, round({P4}, 6) AS p FROM t")
def voxel_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = points.voxel_counts(views.cells(spark, sf), (4.0, 4.0, 4.0), 10.0, (100, 100, 100), ["sample_id", "grp"]).unionByName(
        # voxels that round to 0 stay on this grid
        _outside(spark, sf)
    )
    sums = c.groupBy("vy", "vx", "vz", "grp").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    # absent samples are zeros: moments from sums over the three samples of a group
    one = lambda g, k: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col(k))), F.lit(0)).cast("double")
    m = sums.groupBy("vy", "vx", "vz").agg(*[one(g, k).alias(f"{k}_{i}") for i, g in ((1, "WT"), (2, "KO")) for k in ("s", "ss")])
    for i in (1, 2):
        m = m.withColumn(f"n_{i}", F.lit(3)).withColumn(f"mean_{i}", F.col(f"s_{i}") / 3).withColumn(f"var_{i}", (F.col(f"ss_{i}") - F.col(f"s_{i}") * F.col(f"s_{i}") / 3) / 2)
    t = stats.p_value(stats.pooled(m.where(stats.testable_voxel(1.0) & (F.col("var_1") + F.col("var_2") > 1e-9))))
    return t.select("vy", "vx", "vz", F.round((F.col("mean_2") - F.col("mean_1")) / F.col("mean_1"), 6).alias("fold"), F.round("p", 6).alias("p"))


def _outside(spark: SparkSession, sf: str) -> DataFrame:
    c = views.cells(spark, sf)
    r = {k: points.rescale(F.col(k), 4.0, 10.0) for k in "yxz"}
    return c.select("sample_id", "grp", *[r[k].alias(f"v{k}") for k in "yxz"]).where("vy = 0 OR vx = 0 OR vz = 0").groupBy("sample_id", "grp", "vy", "vx", "vz").agg(F.count("*").alias("n"))


@query(SQL + "SELECT y, x, z, n, round(n / max(n) OVER (), 6) AS alpha FROM (SELECT y, x, z, count(*) AS n FROM cells GROUP BY y, x, z)")
def point_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return points.with_alpha(views.cells(spark, sf)).select("y", "x", "z", "n", F.round("alpha", 6).alias("alpha"))


@query(SQL + "SELECT y, x, max(structure_index) AS structure_index FROM mask GROUP BY y, x")
def max_projection(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.projection(views.mask(spark, sf), "structure_index")


@query(SQL + "SELECT min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max, min(z) AS z_min, max(z) AS z_max FROM mask WHERE structure_index % 3 = 0")
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.bounding_box(views.mask(spark, sf).where("structure_index % 3 = 0"))


@query(SQL + "SELECT y, x, z, structure_index FROM (SELECT y - 5 AS y, x + 2 AS x, z, structure_index FROM mask) WHERE y BETWEEN 1 AND 40 AND x BETWEEN 1 AND 15 AND z BETWEEN 1 AND 7")
def crop_pad(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.crop_pad(views.mask(spark, sf), (50, 11, 7), (40, 15, 7)).select("y", "x", "z", "structure_index")


@query(SQL + "SELECT y, x, z, structure_index FROM mask UNION ALL SELECT y, 23 - x, z, structure_index FROM mask")
def mirror_union(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.mirrored(views.mask(spark, sf), 11).select("y", "x", "z", "structure_index")


@query(SQL + "SELECT y, x - 5 AS x, z, structure_index FROM mask WHERE x > 5")
def right_half(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.half(views.mask(spark, sf), 11, left=False).select("y", "x", "z", "structure_index")


@query(SQL + """SELECT CAST(ny AS INTEGER) AS y, CAST(nx AS INTEGER) AS x, z, structure_index FROM range(1, 101) a(ny), range(1, 23) b(nx), mask WHERE y = CAST(ceil((ny - 0.5) / 2) AS INTEGER) AND x = CAST(ceil((nx - 0.5) / 2) AS INTEGER)""")
def nearest_resize(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.nearest_resize(views.mask(spark, sf), (50, 11, 7), (100, 22, 7)).select("y", "x", "z", "structure_index")


@query(SQL + "SELECT y, x, z, CASE WHEN structure_index IN (SELECT descendant FROM closure WHERE ancestor = 11) THEN structure_index ELSE 0 END AS structure_index FROM mask")
def mask_subset(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ontology

    return voxels.subset(views.mask(spark, sf), ontology.descendants(views.structure(spark, sf), 11)).select("y", "x", "z", "structure_index")


@query(SQL + """SELECT m.y, m.x, m.z FROM mask m WHERE (SELECT count(*) FROM mask o WHERE o.y BETWEEN m.y - 1 AND m.y + 1 AND o.x BETWEEN m.x - 1 AND m.x + 1 AND o.z BETWEEN m.z - 1 AND m.z + 1) < 27""")
def border_voxels(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.border(views.mask(spark, sf)).select("y", "x", "z")


@query(SQL + "SELECT structure_index, round(avg(y), 6) AS y, round(avg(x), 6) AS x, round(avg(z), 6) AS z, count(*) AS size FROM mask GROUP BY structure_index")
def structure_centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = voxels.centroids(views.mask(spark, sf), ["structure_index"])
    return c.select("structure_index", *[F.round(k, 6).alias(k) for k in "yxz"], "size")


@query(SQL + ", v AS (SELECT y, x, z, max(intensity_1) AS value FROM cells GROUP BY y, x, z) SELECT y * 100 + x AS position, round(avg(value), 4) AS value, round(sum(value), 4) AS total, max(value) AS most FROM v GROUP BY ALL")
def flatmap_mean(spark: SparkSession, sf: str) -> DataFrame:
    v = views.cells(spark, sf).groupBy("y", "x", "z").agg(F.max("intensity_1").alias("value"))
    paths = v.select((F.col("y") * 100 + F.col("x")).alias("position"), "y", "x", "z")
    by = lambda method, name: voxels.flatmap(paths, v, "value", method).select("position", F.col("value").alias(name))
    out = by("mean", "value").join(by("sum", "total"), "position").join(by("max", "most"), "position")
    return out.select("position", F.round("value", 4).alias("value"), F.round("total", 4).alias("total"), "most")


@query(SQL + "SELECT structure_index, CAST(dense_rank() OVER (ORDER BY structure_index) AS INTEGER) AS code FROM (SELECT DISTINCT structure_index FROM mask)")
def dictionary_encode(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.rank_labels(views.mask(spark, sf).select("structure_index").distinct(), "structure_index")


# ---- classification ----------------------------------------------------------------------------

PCT = "(SELECT sample_id, v, row_number() OVER (PARTITION BY sample_id ORDER BY v) AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM (SELECT sample_id, {v} AS v FROM cells))"
PCT_SQL = """SELECT sample_id, max(lo) + (max(pos) - floor(max(pos))) * (max(hi) - max(lo)) AS percentile FROM (
  SELECT sample_id, pos, CASE WHEN i = floor(pos) THEN v END AS lo, CASE WHEN i = ceil(pos) THEN v END AS hi FROM (SELECT *, least(greatest(n * {p}::DOUBLE / 100 + 0.5, 1), n)::DOUBLE AS pos FROM {t})) GROUP BY sample_id"""


def pct(v: str, p: float) -> str:
    return PCT_SQL.format(p=p, t=PCT.format(v=v))


@query(SQL + " SELECT sample_id, CAST(5 AS INTEGER) AS p, round(percentile, 4) AS percentile FROM (" + pct("intensity_1", 5) + ") UNION ALL SELECT sample_id, 90, round(percentile, 4) FROM (" + pct("intensity_1", 90) + ")")
def rank_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    c = views.cells(spark, sf)
    one = lambda p: stats.rank_percentile(c, ["sample_id"], "intensity_1", p).select("sample_id", F.lit(int(p)).alias("p"), F.round("percentile", 4).alias("percentile"))
    return one(5.0).unionByName(one(90.0))


MAD_SQL = """, mm AS (SELECT sample_id, median(intensity_1) AS median, avg(intensity_1) AS mean, stddev_samp(intensity_1) AS sd FROM cells GROUP BY sample_id),
md AS (SELECT sample_id, y AS mode FROM (SELECT sample_id, intensity_1 AS y, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, intensity_1) AS k FROM cells GROUP BY sample_id, intensity_1) WHERE k = 1),
ma AS (SELECT sample_id, median(abs(intensity_1 - median)) AS mad FROM cells JOIN mm USING (sample_id) GROUP BY sample_id)"""


@query(SQL + MAD_SQL + " SELECT sample_id, round(median, 4) AS median, round(mad, 4) AS mad, mode, round(mean, 4) AS mean, round(sd, 4) AS sd FROM mm JOIN md USING (sample_id) JOIN ma USING (sample_id)")
def mad_mode_median(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 4).alias(c)
    return stats.median_mad(views.cells(spark, sf), ["sample_id"], "intensity_1").select("sample_id", r("median"), r("mad"), "mode", r("mean"), r("sd"))


@query(SQL + MAD_SQL + ", pp AS (" + pct("intensity_1", 25) + ") SELECT sample_id, round(median + 2.5 * mad + 0.1 * percentile, 6) AS threshold FROM mm JOIN ma USING (sample_id) JOIN pp USING (sample_id)")
def threshold_expression(spark: SparkSession, sf: str) -> DataFrame:
    out = classify.expression_thresholds(views.cells(spark, sf), ["sample_id"], "intensity_1", "median + 2.5*mad + 0.1*prctile(25)")
    return out.select("sample_id", F.round("threshold", 6).alias("threshold"))


@query(SQL + "SELECT sample_id, CAST(CASE WHEN a AND b THEN 4 WHEN b THEN 3 WHEN a THEN 2 ELSE 1 END AS INTEGER) AS class, count(*) AS n FROM (SELECT sample_id, intensity_1 > 0.4 * 65535 AS a, intensity_2 > 0.04 AS b FROM cells) GROUP BY ALL")
def class_codes(spark: SparkSession, sf: str) -> DataFrame:
    m = [F.col("intensity_1") > classify.manual_threshold(0.4), F.col("intensity_2") > 0.04]
    return views.cells(spark, sf).select("sample_id", classify.class_of(m).alias("class")).groupBy("sample_id", "class").agg(F.count("*").alias("n"))


@query(SQL + "SELECT sample_id, count(*) FILTER (intensity_1 > 0.2::DOUBLE * 65535) AS share_rule, count(*) FILTER (intensity_1 > 30000) AS value_rule, count(*) FILTER (intensity_1 > 0) AS one_rule FROM cells GROUP BY sample_id")
def manual_threshold(spark: SparkSession, sf: str) -> DataFrame:
    above = lambda t, n: F.count_if(F.col("intensity_1") > classify.manual_threshold(t)).alias(n)
    return views.cells(spark, sf).groupBy("sample_id").agg(above(0.2, "share_rule"), above(30000, "value_rule"), above(1, "one_rule"))


@query(SQL + ", s AS (SELECT annotation, avg(intensity_1) AS m, stddev_samp(intensity_1) AS d FROM cells GROUP BY annotation) SELECT annotation, round(min(greatest(least((intensity_1 - m) / d, 1.5), -1.5)), 6) AS low, round(max(greatest(least((intensity_1 - m) / d, 1.5), -1.5)), 6) AS high, round(avg(greatest(least((intensity_1 - m) / d, 1.5), -1.5)), 6) AS middle FROM cells JOIN s USING (annotation) GROUP BY annotation")
def zscore_stratified(spark: SparkSession, sf: str) -> DataFrame:
    z = classify.zscores(views.cells(spark, sf), ["annotation"], "intensity_1", 1.5)
    return z.groupBy("annotation").agg(*[F.round(f("zscore"), 6).alias(n) for n, f in (("low", F.min), ("high", F.max), ("middle", F.avg))])


@query(SQL + "SELECT sample_id, round(sum(CASE WHEN v > 10000 THEN 10000 + log10(v - 10000 + 1) WHEN v < -10000 THEN -10000 - log10(-v - 10000 + 1) ELSE v END), 2) AS total FROM (SELECT sample_id, intensity_1 - 40000 AS v FROM cells) GROUP BY sample_id")
def log_compress(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).groupBy("sample_id").agg(F.round(F.sum(classify.log_compress(F.col("intensity_1") - 40000, 10000.0)), 2).alias("total"))


@query(SQL + ", a AS (" + pct("intensity_1", 20) + "), b AS (" + pct("intensity_2", 50) + ") SELECT sample_id, count(*) FILTER (intensity_1 < a.percentile AND intensity_2 < b.percentile) AS n_low, count(*) AS n FROM cells JOIN a USING (sample_id) JOIN b USING (sample_id) GROUP BY sample_id")
def low_class_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = views.cells(spark, sf)
    p1 = classify.low_class(c, ["intensity_1"], 20.0, ["sample_id"]).withColumnRenamed("low", "low_1")
    out = classify.low_class(p1, ["intensity_2"], 50.0, ["sample_id"])
    return out.groupBy("sample_id").agg(F.count_if(F.col("low") & F.col("low_1")).alias("n_low"), F.count("*").alias("n"))


@query(SQL + "SELECT sample_id, CAST(class AS INTEGER) AS class, n, round(m, 4) AS mean_intensity_1, round(n / sum(n) OVER (PARTITION BY sample_id), 6) AS share FROM (SELECT sample_id, class, count(*) AS n, avg(intensity_1) AS m FROM cells GROUP BY ALL)")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    out = classify.report(views.cells(spark, sf), ["sample_id"], ["intensity_1"])
    return out.select("sample_id", "class", "n", F.round("mean_intensity_1", 4).alias("mean_intensity_1"), F.round("share", 6).alias("share"))


@query(SQL + "SELECT round(corr(intensity_1, intensity_2) FILTER (intensity_1 <> 0 AND intensity_2 <> 0), 6) AS r, sample_id FROM cells GROUP BY sample_id")
def corr_nonzero(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).groupBy("sample_id").agg(F.round(stats.corr_nonzero(F.col("intensity_1"), F.col("intensity_2")), 6).alias("r"))


@query(SQL + ", c AS (SELECT sample_id, annotation, count(*) AS n FROM cells GROUP BY ALL) SELECT sample_id, annotation, round((n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w), 6) AS normalised FROM c WINDOW w AS (PARTITION BY sample_id)")
def minmax_normalise(spark: SparkSession, sf: str) -> DataFrame:
    c = views.cells(spark, sf).groupBy("sample_id", "annotation").agg(F.count("*").alias("n"))
    return stats.minmax(c, ["sample_id"], "n").select("sample_id", "annotation", F.round("normalised", 6).alias("normalised"))


@query(SQL + """, h AS (SELECT sample_id, x::DOUBLE AS u, count(*) * exp(-(x - 6.0) * (x - 6.0) / 18) AS c FROM cells GROUP BY sample_id, x), k AS (SELECT sample_id, u, ln(c) AS v FROM (SELECT *, max(c) OVER (PARTITION BY sample_id) AS m FROM h) WHERE c > 0.2 * m),
q AS (SELECT sample_id, u - avg(u) OVER (PARTITION BY sample_id) AS d, v, avg(u) OVER (PARTITION BY sample_id) AS mid FROM k),
s AS (SELECT sample_id, any_value(mid) AS mid, count(*)::DOUBLE AS s0, sum(d) AS s1, sum(d*d) AS s2, sum(d*d*d) AS s3, sum(d*d*d*d) AS s4, sum(v) AS r0, sum(v*d) AS r1, sum(v*d*d) AS r2 FROM q GROUP BY sample_id),
f AS (SELECT sample_id, mid, (s0*(s2*r2-s3*r1)-s1*(s1*r2-s2*r1)+r0*(s1*s3-s2*s2)) / (s0*(s2*s4-s3*s3)-s1*(s1*s4-s2*s3)+s2*(s1*s3-s2*s2)) AS a, (s0*(r1*s4-s3*r2)-r0*(s1*s4-s2*s3)+s2*(s1*r2-r1*s2)) / (s0*(s2*s4-s3*s3)-s1*(s1*s4-s2*s3)+s2*(s1*s3-s2*s2)) AS b FROM s)
SELECT sample_id, round(sqrt(-1 / (2 * a)), 5) AS sigma, round(mid - b / (2 * a), 5) AS mu FROM f WHERE a < 0""")
def gauss_fit(spark: SparkSession, sf: str) -> DataFrame:
    bell = F.exp(-(F.col("x") - 6.0) * (F.col("x") - 6.0) / 18)
    h = views.cells(spark, sf).groupBy("sample_id", "x").agg(F.count("*").alias("k")).select("sample_id", "x", (F.col("k") * bell).alias("c"))
    return stats.gauss_fit(h, ["sample_id"], "x", "c").select("sample_id", F.round("sigma", 5).alias("sigma"), F.round("mu", 5).alias("mu"))


# ---- quality of detection ----------------------------------------------------------------------

LABELLED = """, vox AS (SELECT y, x, z, min(annotation) AS label, avg(intensity_2) / 0.08 AS prediction FROM cells WHERE (y + x + z) % 5 <> 0 GROUP BY y, x, z),
hits AS (SELECT DISTINCT y, x, z FROM cells WHERE class = 1 AND (y * x) % 3 = 0)"""


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = views.cells(spark, sf)
    vox = c.where("(y + x + z) % 5 <> 0").groupBy("y", "x", "z").agg(F.min("annotation").alias("label"), (F.avg("intensity_2") / 0.08).alias("prediction"))
    return vox, c.where("class = 1 AND (y * x) % 3 = 0").select("y", "x", "z").distinct()


@query(SQL + LABELLED + """, l AS (SELECT v.label, count(h.y) AS n_hits, sum(prediction) AS s FROM vox v LEFT JOIN hits h USING (y, x, z) WHERE v.label > 0 GROUP BY v.label),
e AS (SELECT count(*) AS n FROM hits h LEFT JOIN vox v USING (y, x, z) WHERE coalesce(v.label, 0) = 0),
k AS (SELECT count(*) FILTER (n_hits > 1) AS mult, count(*) FILTER (n_hits = 0 AND s > 0) AS merged, count(*) FILTER (n_hits = 0 AND s = 0) AS missed, count(*) FILTER (n_hits = 1) AS correct, (SELECT n FROM e) AS empty FROM l)
SELECT *, round(correct / (correct + mult + empty)::DOUBLE, 6) AS precision, round(CASE WHEN correct + merged + missed = 0 THEN NULL ELSE correct / (correct + merged + missed)::DOUBLE END, 6) AS recall FROM k""")
def detection_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.detection(*_labelled(spark, sf))
    return out.select("mult", "merged", "missed", "correct", "empty", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(SQL + LABELLED + "SELECT round(100 * avg((prediction > 0.45 AND prediction < 0.55)::INT), 6) AS uncertain FROM vox")
def uncertain_voxels(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf)[0].agg(F.round(quality.uncertain(F.col("prediction"), 0.45, 0.55), 6).alias("uncertain"))


@query("SELECT quality, count(*) FILTER (toxic = 0) AS p0, count(*) FILTER (toxic = 1) AS p1, round(count(*) FILTER (toxic = quality) / count(*)::DOUBLE, 6) AS agreement FROM labels GROUP BY quality")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.confusion(views.table(spark, sf, "labels"), "quality", "toxic", [0, 1])
    return out.select("quality", "p0", "p1", F.round("agreement", 6).alias("agreement"))


@query("SELECT round((2.0::DOUBLE * sum(quality * toxic) + 1) / (sum(quality) + sum(toxic) + 1), 6) AS dice, round((sum(quality * toxic) + 1.0::DOUBLE) / (sum(quality * toxic) + 0.3::DOUBLE * sum((1 - quality) * toxic) + 0.7::DOUBLE * sum(quality * (1 - toxic)) + 1), 6) AS tversky FROM labels")
def dice_tversky(spark: SparkSession, sf: str) -> DataFrame:
    t, p = F.col("quality"), F.col("toxic")
    return views.table(spark, sf, "labels").agg(F.round(quality.dice(t, p), 6).alias("dice"), F.round(quality.tversky(t, p, 0.3, 0.7), 6).alias("tversky"))
