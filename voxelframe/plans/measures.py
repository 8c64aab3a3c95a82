"""Plans of smaller measures: shares, ranks, group differences, predicates, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stats, voxels
from ..sources import catalog
from . import views
from .registry import query
from .slices import TILES_SQL, tile_catalog
from .views import SQL


@query(SQL + "SELECT annotation, round(avg(CASE WHEN intensity_2 > 0 THEN intensity_2 END), 6) AS positive_mean, round(avg((intensity_1 > 30000)::INT), 6) AS share_above FROM cells GROUP BY annotation")
def positive_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over positive values only, and the fraction of values above a threshold."""
    return views.cells(spark, sf).groupBy("annotation").agg(F.round(F.avg(F.when(F.col("intensity_2") > 0, F.col("intensity_2"))), 6).alias("positive_mean"), F.round(F.avg((F.col("intensity_1") > 30000).cast("double")), 6).alias("share_above"))


@query(SQL + ", c AS (SELECT grp, annotation, count(*)::DOUBLE AS n FROM cells GROUP BY ALL) SELECT annotation, round((max(n) FILTER (grp = 'KO') - max(n) FILTER (grp = 'WT')) / max(n) FILTER (grp = 'WT'), 6) AS difference FROM c GROUP BY annotation HAVING max(n) FILTER (grp = 'WT') > 0")
def group_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Relative difference of two groups, (b - a) / a."""
    n = lambda g: F.count_if(F.col("grp") == g).cast("double")
    g = views.cells(spark, sf).groupBy("annotation").agg(n("WT").alias("a"), n("KO").alias("b")).where("a > 0")
    return g.select("annotation", F.round(F.when(F.col("b") > 0, (F.col("b") - F.col("a")) / F.col("a")), 6).alias("difference"))


@query(SQL + "SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY m DESC, z) AS INTEGER) AS rank, z FROM (SELECT sample_id, z, round(avg(intensity_1), 6) AS m FROM cells GROUP BY ALL)")
def rank_by_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Slices by mean signal, brightest first."""
    m = views.cells(spark, sf).groupBy("sample_id", "z").agg(F.round(F.avg("intensity_1"), 6).alias("m"))
    return m.select("sample_id", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.col("m").desc(), "z")).alias("rank"), "z")


@query(SQL + "SELECT y, x, z, CASE WHEN structure_index % 3 = 0 THEN structure_index ELSE 0 END AS kept FROM mask")
def zero_unselected(spark: SparkSession, sf: str) -> DataFrame:
    """Rows outside the evaluated set become 0; their number stays."""
    return views.mask(spark, sf).select("y", "x", "z", F.when(F.col("structure_index") % 3 == 0, F.col("structure_index")).otherwise(0).alias("kept"))


@query("SELECT page_id, starts_with(url, 'https') AS secure, contains(lower(url), 'example') AS example, regexp_matches(url, '[?&]page=[0-9]+') AS paged, lower(regexp_extract(url, '^[a-zA-Z]+://([^/]+)', 1)) AS host FROM pages")
def text_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix, substring, pattern and case-blind predicates."""
    u = F.col("url")
    return views.table(spark, sf, "pages").select("page_id", u.startswith("https").alias("secure"), F.lower(u).contains("example").alias("example"), u.rlike("[?&]page=[0-9]+").alias("paged"), F.lower(F.regexp_extract(u, "^[a-zA-Z]+://([^/]+)", 1)).alias("host"))


@query(SQL + """, b AS (SELECT m.structure_index, (SELECT count(*) FROM mask o WHERE o.y BETWEEN m.y - 1 AND m.y + 1 AND o.x BETWEEN m.x - 1 AND m.x + 1 AND o.z BETWEEN m.z - 1 AND m.z + 1) < 27 AS edge FROM mask m)
SELECT structure_index, round(count(*) FILTER (edge) / sum(count(*) FILTER (edge)) OVER (), 6) AS share FROM b GROUP BY structure_index HAVING count(*) FILTER (edge) > 0""")
def surface_share(spark: SparkSession, sf: str) -> DataFrame:
    """Each structure's share of the border voxels."""
    n = voxels.border(views.mask(spark, sf)).groupBy("structure_index").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("structure_index", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(SQL + """, s AS (SELECT sample_id, list_sort(list(DISTINCT grp)) AS groups FROM (SELECT sample_id, grp FROM cells UNION ALL SELECT sample_id, 'P' || pair_id FROM cells) GROUP BY sample_id) SELECT sample_id FROM s WHERE list_has_all(groups, ['KO', 'P1'])""")
def samples_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Samples that belong to every group asked for."""
    c = views.cells(spark, sf)
    named = c.select("sample_id", F.explode(F.array("grp", F.concat(F.lit("P"), F.col("pair_id").cast("string")))).alias("g")).distinct()
    return catalog.in_groups(named.groupBy("sample_id").agg(F.collect_set("g").alias("groups")), ["KO", "P1"]).select("sample_id")


@query(SQL + "SELECT DISTINCT y, x, z, CAST(y + (x - 1) * 50 + (z - 1) * 550 AS BIGINT) AS row FROM cells WHERE class = 2 AND (y, x, z) IN (SELECT (y, x, z) FROM cells WHERE class = 1 AND y < 10)")
def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates matched exactly, with their row number."""
    from ..operators.points import linear_index

    c = views.cells(spark, sf)
    found = c.where("class = 2").select("y", "x", "z").distinct().join(c.where("class = 1 AND y < 10").select("y", "x", "z"), ["y", "x", "z"], "left_semi")
    return found.withColumn("row", linear_index(F.col("y"), F.col("x"), F.col("z"), 50, 11))


def _edge_pct(side: str) -> str:
    return f"""(SELECT sample_id, z, max(lo) + (max(pos) - floor(max(pos))) * (max(hi) - max(lo)) AS p FROM (SELECT sample_id, z, pos, CASE WHEN i = floor(pos) THEN v END AS lo, CASE WHEN i = ceil(pos) THEN v END AS hi FROM
      (SELECT *, least(greatest(n * 0.98::DOUBLE + 0.5, 1), n)::DOUBLE AS pos FROM (SELECT sample_id, z, intensity_1 AS v, row_number() OVER (PARTITION BY sample_id, z ORDER BY intensity_1) AS i, count(*) OVER (PARTITION BY sample_id, z) AS n FROM cells WHERE {side}))) GROUP BY sample_id, z)"""


@query(SQL + f"SELECT a.sample_id, round(avg(a.p / b.p), 6) AS gain FROM {_edge_pct('x >= 9')} a JOIN {_edge_pct('x <= 3')} b USING (sample_id, z) GROUP BY a.sample_id")
def overlap_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Gain between neighbouring tiles: ratio of the 98th percentiles in their overlap, averaged over slices."""
    c = views.cells(spark, sf)
    side = lambda where, name: stats.rank_percentile(c.where(where), ["sample_id", "z"], "intensity_1", 98.0).withColumnRenamed("percentile", name)
    both = side("x >= 9", "a").join(side("x <= 3", "b"), ["sample_id", "z"])
    return both.groupBy("sample_id").agg(F.round(F.avg(F.col("a") / F.col("b")), 6).alias("gain"))


@query(TILES_SQL + "SELECT sample_id, z FROM (SELECT sample_id, z, row_number() OVER (PARTITION BY sample_id ORDER BY z) AS k FROM (SELECT DISTINCT sample_id, z FROM cat)) WHERE k BETWEEN 16 AND 25")
def middle_slices(spark: SparkSession, sf: str) -> DataFrame:
    """A stated run of slices in the middle of each sample's list."""
    listed = tile_catalog(spark, sf).select("sample_id", "z").distinct().withColumn("k", F.row_number().over(Window.partitionBy("sample_id").orderBy("z")))
    return listed.where(F.col("k").between(16, 25)).select("sample_id", "z")


@query("SELECT sample_id, bool_or(f = 'C1') AS \"C1\", bool_or(f = 'C2') AS \"C2\", bool_or(f = 'C3') AS \"C3\" FROM (SELECT DISTINCT 'S' || (l_orderkey % 6) AS sample_id, 'C' || (CAST(l_partkey % 2 AS INTEGER) + 1) AS f FROM lineitem) GROUP BY sample_id")
def field_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields each sample's results have."""
    fields = tile_catalog(spark, sf).select("sample_id", F.concat(F.lit("C"), F.col("channel_num").cast("string")).alias("field"))
    return catalog.manifest(fields, ["C1", "C2", "C3"])
