"""Plans with array kernels and trained models; no SQL expresses them, tests hold them against plain numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays, learn, points, voxels
from . import views
from .registry import query
from .views import SQL


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """A volume per class: the greatest intensity of each voxel."""
    c = views.cells(spark, sf)
    return c.groupBy("class", "y", "x", "z").agg(F.max("intensity_1").alias("value"))


#: Chunks smaller than the test volumes, so that borders are crossed.
CHUNK = (20, 8, 4)


@query(SQL + """, v AS MATERIALIZED (SELECT class, y, x, z FROM cells GROUP BY class, y, x, z HAVING max(intensity_1) > 90000),
box AS (SELECT class, min(y) AS ly, min(x) AS lx, min(z) AS lz, max(x) - min(x) + 1 AS nx, max(z) - min(z) + 1 AS nz FROM v GROUP BY class),
n AS MATERIALIZED (SELECT v.class, y, x, z, CAST(((y - ly) * nx + x - lx) * nz + z - lz + 1 AS BIGINT) AS id FROM v JOIN box USING (class)),
near AS MATERIALIZED (SELECT a.class, a.id AS a, b.id AS b FROM n a JOIN n b ON a.class = b.class AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND abs(a.z - b.z) <= 1),
reach AS (SELECT class, id, id AS r FROM n UNION SELECT reach.class, reach.id, near.b FROM reach JOIN near ON near.class = reach.class AND near.a = reach.r),
named AS (SELECT class, id, min(r) AS label FROM reach GROUP BY class, id)
SELECT CAST(class AS INTEGER) AS class, label, round(avg(y), 6) AS y, round(avg(x), 6) AS x, round(avg(z), 6) AS z, count(*) AS size FROM named JOIN n USING (class, id) GROUP BY class, label""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of connected bright voxels of each class."""
    found = arrays.components(pixels(spark, sf).where("value > 90000"), ["class"], size=CHUNK)
    c = voxels.centroids(found, ["class", "label"])
    return c.select("class", "label", *[F.round(k, 6).alias(k) for k in "yxz"], "size")


@query()
def hessian_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.seeds(pixels(spark, sf), ["class"], (1.0, 1.5), 0.005, CHUNK)


@query()
def smoothed(spark: SparkSession, sf: str) -> DataFrame:
    out = arrays.per_chunk(pixels(spark, sf), ["class"], lambda v, top: arrays.gaussian(v, (1.0, 1.0, 0.0)), CHUNK, (3, 3, 0))
    return out.withColumn("value", F.round("value", 4))


@query()
def background_removed(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.per_chunk(pixels(spark, sf), ["class"], lambda v, top: arrays.without_background(v, 2), CHUNK, 7).withColumn("value", F.round("value", 4))


@query()
def phase_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Translation of one class's slices onto those of another, slice by slice."""
    px = pixels(spark, sf).where("class < 3").withColumn("channel", F.concat(F.lit("c"), F.col("class").cast("string")))
    return arrays.align_pairs(px, ["z"], "c1", "c2", 5)


@query()
def patch_features(spark: SparkSession, sf: str) -> DataFrame:
    """Eight measures of the 5 x 5 pixels around every point of each class whose patch lies in the image."""
    px = pixels(spark, sf).select("class", "y", "x", "z", "value")
    at = px.where("y BETWEEN 3 AND 48 AND x BETWEEN 3 AND 9").select("class", points.linear_index(F.col("y"), F.col("x"), F.col("z"), 50, 11).alias("id"), F.col("y").alias("cy"), F.col("x").alias("cx"), "z")
    square = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(1, 6) for j in range(1, 6)])
    asked = at.withColumn("o", F.explode(square)).select("class", "id", "z", F.col("o.i").alias("i"), F.col("o.j").alias("j"), (F.col("cy") + F.col("o.i") - 3).alias("y"), (F.col("cx") + F.col("o.j") - 3).alias("x"))
    found = asked.join(px, ["class", "y", "x", "z"], "left").select("class", "id", F.col("i").alias("y"), F.col("j").alias("x"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return arrays.features_of(found, ["class", "id"])


@query("SELECT vec_id, CAST(label AS INTEGER) AS label FROM embeddings")
def stored_labels(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))


@query()
def svm_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of embeddings by linear machines trained on four folds of five."""
    e = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("double").alias("label"))
    train = e.where(learn.fold(F.col("vec_id"), 5) > 0)
    out = learn.predict(learn.svm(train, "embedding", "label"), e, "embedding")
    return out.select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), (learn.fold(F.col("vec_id"), 5) == 0).alias("held_out"))


@query()
def gmm_posterior(spark: SparkSession, sf: str) -> DataFrame:
    """Components of intensity per cell, unsure ones 0."""
    c = views.cells(spark, sf).select("sample_id", "y", "x", "z", F.array(F.col("intensity_1") / 10000, F.col("intensity_2") * 10).alias("f"))
    out = learn.mixture(c, "f", 3)
    return out.select("sample_id", "y", "x", "z", learn.confident(F.col("component"), F.col("probability"), 0.5).alias("component"), F.round("probability", 4).alias("probability"))


@query(SQL + """, p AS (SELECT CAST(class AS INTEGER) AS class, y, x, z, max(intensity_1) AS value, CAST(y + (x - 1) * 50 + (z - 1) * 550 AS BIGINT) AS id FROM cells WHERE class = 2 GROUP BY class, y, x, z)
SELECT class, y, x, z, value, id FROM p ORDER BY CAST('0x' || substr(md5(id || ':7'), 1, 8) AS BIGINT), id LIMIT 100""")
def random_patches(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed number of points in a repeatable random order."""
    p = pixels(spark, sf).where("class = 2").withColumn("id", points.linear_index(F.col("y"), F.col("x"), F.col("z"), 50, 11))
    return learn.sample_valid(p, "id", 100, 7)


@query("SELECT p_partkey, CAST(CAST('0x' || substr(md5(p_partkey || ':0'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM part")
def folds(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "part").select("p_partkey", learn.fold(F.col("p_partkey"), 5).alias("fold"))


@query(SQL + """, v AS (SELECT y, x, z, max(intensity_1) AS value FROM cells GROUP BY y, x, z), p AS (SELECT z, min(value) AS lo, max(value) AS hi FROM v GROUP BY z),
e AS (SELECT arg_min(lo, z) AS lo1, arg_max(lo, z) AS lo2, arg_min(hi, z) AS hi1, arg_max(hi, z) AS hi2, min(z) AS z1, max(z) AS z2 FROM p)
SELECT v.y, v.x, v.z, round((lo1 + (v.z - z1) / (z2 - z1)::DOUBLE * (lo2 - lo1)) + (value - lo) / (hi - lo) * ((hi1 + (v.z - z1) / (z2 - z1)::DOUBLE * (hi2 - hi1)) - (lo1 + (v.z - z1) / (z2 - z1)::DOUBLE * (lo2 - lo1))), 3) AS value FROM v JOIN p USING (z), e""")
def stack_normalised(spark: SparkSession, sf: str) -> DataFrame:
    v = views.cells(spark, sf).groupBy("y", "x", "z").agg(F.max("intensity_1").alias("value"))
    return voxels.semi_quantile(v, "value").withColumn("value", F.round("value", 3))


@query("SELECT vec_id, CAST(CASE WHEN list_max(embedding) < 0.2::FLOAT THEN 0 ELSE list_position(embedding, list_max(embedding)) END AS INTEGER) AS label FROM embeddings")
def label_map(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "embeddings").select("vec_id", voxels.label_of(F.col("embedding"), F.lit(0.2).cast("float")).alias("label"))


@query("SELECT label, round(avg(m), 5) AS mean, round(avg(s), 5) AS sd FROM (SELECT label, list_avg(embedding::DOUBLE[]) AS m, sqrt(list_avg(list_transform(embedding::DOUBLE[], lambda q: q * q)) - list_avg(embedding::DOUBLE[]) * list_avg(embedding::DOUBLE[])) AS s FROM embeddings) GROUP BY label")
def mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "embeddings").select("vec_id", "label", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    per = e.groupBy("vec_id", "label").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return per.groupBy("label").agg(F.round(F.avg("m"), 5).alias("mean"), F.round(F.avg("s"), 5).alias("sd"))


@query(SQL + """, p AS (SELECT sample_id, z, y, x, lag(y) OVER w AS py, lag(x) OVER w AS px, lag(sample_id) OVER w AS ps FROM (SELECT DISTINCT sample_id, z, y, x FROM cells) WINDOW w AS (PARTITION BY sample_id, z ORDER BY y, x))
SELECT sample_id, z, round(sum(sqrt((y - py) * (y - py) + (x - px) * (x - px))), 4) AS length FROM p WHERE ps IS NOT NULL GROUP BY sample_id, z""")
def arc_length(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    p = views.cells(spark, sf).select("sample_id", "z", "y", "x").distinct()
    w = Window.partitionBy("sample_id", "z").orderBy("y", "x")
    step = p.select("sample_id", "z", F.sqrt(F.pow(F.col("y") - F.lag("y").over(w), 2) + F.pow(F.col("x") - F.lag("x").over(w), 2)).alias("d"))
    return step.where("d IS NOT NULL").groupBy("sample_id", "z").agg(F.round(F.sum("d"), 4).alias("length"))


@query(SQL + "SELECT sample_id, y, x, z, CAST(round(pow(greatest(least((((intensity_1 / 2) * 1.1::DOUBLE - 100) / 0.95::DOUBLE + 100) / 65535 / 0.8::DOUBLE, 1), 0), 0.9::DOUBLE) * 65535) AS INTEGER) AS pixel, count(*) AS n FROM cells GROUP BY ALL")
def intensity_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalar import adjust_intensity

    k = F.lit
    px = adjust_intensity(F.col("intensity_1") / 2, k(1.1), k(0.95), k(100.0), k(0.0), k(0.8), 0.9)
    return views.cells(spark, sf).groupBy("sample_id", "y", "x", "z", px.alias("pixel")).agg(F.count("*").alias("n"))


@query(SQL + "SELECT sample_id, round(median(intensity_1 / intensity_2) FILTER (annotation % 7 = 1 AND intensity_2 > 0) / median(intensity_1 / intensity_2) FILTER (annotation % 7 = 3 AND intensity_2 > 0), 6) AS ratio FROM cells GROUP BY sample_id")
def layer_ratio(spark: SparkSession, sf: str) -> DataFrame:
    r = F.try_divide(F.col("intensity_1"), F.when(F.col("intensity_2") > 0, F.col("intensity_2")))
    mid = lambda k: F.median(F.when(F.col("annotation") % 7 == k, r))
    return views.cells(spark, sf).groupBy("sample_id").agg(F.round(mid(1) / mid(3), 6).alias("ratio"))
