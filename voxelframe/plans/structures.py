"""Plans over the ontology: counts, volumes, densities and the two-group comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ontology, stats, summarize
from . import views
from .registry import query
from .views import SQL

CLASSES = [1, 2, 3]
GROUPS = ("WT", "KO")
#: SQL of the complete grid of rolled-up counts, and of the two-sided p of t and df by Simpson's rule.
COUNTS_SQL = SQL + """, counts AS (SELECT sample_id, annotation, class, count(*) AS n FROM cells WHERE annotation > 0 GROUP BY ALL),
rolled AS (SELECT sample_id, class, ancestor AS id, CAST(sum(n) AS BIGINT) AS n FROM counts JOIN closure ON annotation = descendant GROUP BY ALL),
grid AS (SELECT s.sample_id, t.id, c.class, CAST(coalesce(r.n, 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT sample_id FROM cells) s CROSS JOIN structure t CROSS JOIN (VALUES (1), (2), (3)) c(class) LEFT JOIN rolled r ON r.sample_id = s.sample_id AND r.id = t.id AND r.class = c.class),
vols AS (SELECT ancestor AS id, CAST(count(*) AS BIGINT) AS n_voxels, count(*) * 0.000015625::DOUBLE AS volume FROM mask JOIN closure ON structure_index = descendant GROUP BY ancestor)"""
GRP = "CASE WHEN sample_id IN ('S0', 'S1', 'S2') THEN 'WT' ELSE 'KO' END"


def simpson_p(t: str, df: str) -> str:
    """p = 1 - 2/B * integral of cos(u)^(df-1) from 0 to atan(t/sqrt(df)), with 400 steps."""
    return f"""(CASE WHEN isnan({t}) THEN 'nan'::DOUBLE WHEN isinf({t}) THEN 0.0 ELSE greatest(0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * (atan(abs({t}) / sqrt({df})) / 400 / 3) *
      list_sum(list_transform(range(0, 401), lambda k: (CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(atan(abs({t}) / sqrt({df})) * k / 400), {df} - 1)))) END)"""


@query(SQL + "SELECT sample_id, annotation, CAST(class AS INTEGER) AS class, count(*) AS n FROM cells WHERE annotation > 0 GROUP BY ALL")
def structure_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.cell_counts(views.cells(spark, sf), CLASSES)


@query(COUNTS_SQL + "SELECT sample_id, id, CAST(class AS INTEGER) AS class, n FROM grid")
def structure_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.structure_counts(views.cells(spark, sf), views.structure(spark, sf), CLASSES)


@query(COUNTS_SQL + "SELECT sample_id, id, CAST(class AS INTEGER) AS class, n FROM grid UNION ALL SELECT sample_id, id, 0, CAST(sum(n) AS BIGINT) FROM grid GROUP BY sample_id, id")
def class_totals(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.class_totals(structure_rollup(spark, sf))


def _by_class(spark: SparkSession, sf: str) -> DataFrame:
    names = F.concat(F.lit("c"), F.col("class").cast("string"))
    return summarize.wide(structure_rollup(spark, sf), ["sample_id", "id"], names, "n", ["c1", "c2", "c3"])


@query(COUNTS_SQL + """, w AS (SELECT sample_id, id, sum(n) FILTER (class = 1)::DOUBLE AS c1, sum(n) FILTER (class = 2)::DOUBLE AS c2, sum(n) FILTER (class = 3)::DOUBLE AS c3 FROM grid GROUP BY ALL)
SELECT sample_id, id, c2 + c3 AS either, round(CASE WHEN c1 + c2 = 0 THEN 0 ELSE c1 / (c1 + c2) END, 6) AS share FROM w""")
def structure_rollup_custom_class(spark: SparkSession, sf: str) -> DataFrame:
    w = _by_class(spark, sf)
    columns = {k: F.col(f"c{k}") for k in CLASSES}
    return w.select("sample_id", "id", summarize.custom_class("CT2+CT3", columns).alias("either"), F.round(summarize.custom_class("CT1/(CT1+CT2)", columns), 6).alias("share"))


@query(COUNTS_SQL + "SELECT id, n_voxels, round(volume, 9) AS volume FROM vols")
def structure_volumes(spark: SparkSession, sf: str) -> DataFrame:
    out = summarize.volumes(views.mask(spark, sf), views.structure(spark, sf))
    return out.select("id", "n_voxels", F.round("volume", 9).alias("volume"))


@query(SQL + "SELECT count(*) AS n_voxels, round(count(*) * 0.000015625::DOUBLE, 9) AS volume FROM mask WHERE structure_index > 0")
def total_volume(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count_if(F.col("structure_index") > 0)
    return views.mask(spark, sf).agg(n.alias("n_voxels"), F.round(n * summarize.VOXEL_MM3, 9).alias("volume"))


@query(COUNTS_SQL + "SELECT sample_id, id, CAST(class AS INTEGER) AS class, n, round(n / volume, 4) AS density FROM grid LEFT JOIN vols USING (id)")
def structure_density(spark: SparkSession, sf: str) -> DataFrame:
    out = summarize.densities(structure_rollup(spark, sf), summarize.volumes(views.mask(spark, sf), views.structure(spark, sf)))
    return out.select("sample_id", "id", "class", "n", F.round("density", 4).alias("density"))


@query(COUNTS_SQL + "SELECT id, " + ", ".join(f"CAST(sum(n) FILTER (sample_id = 'S{s}' AND class = {c}) AS BIGINT) AS \"S{s}_{c}_Counts\"" for s in range(6) for c in (1, 2, 3)) + " FROM grid GROUP BY id")
def counts_wide_pivot(spark: SparkSession, sf: str) -> DataFrame:
    labels = [f"S{s}_{c}_Counts" for s in range(6) for c in CLASSES]
    return summarize.wide(structure_rollup(spark, sf), ["id"], F.format_string("%s_%d_Counts", "sample_id", "class"), "n", labels)


@query(SQL + """SELECT annotation, count(*) AS n FROM (SELECT coalesce((SELECT max(c.ancestor) FROM closure c WHERE c.descendant = cells.annotation AND c.ancestor BETWEEN 100 AND 124 AND c.ancestor % 2 = 0), 0) AS annotation FROM cells) GROUP BY annotation""")
def bin_to_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    s = views.structure(spark, sf)
    own = views.cells(spark, sf).groupBy("annotation").agg(F.count("*").alias("k"))
    out = ontology.bin_to_ancestor(own, s, s.where("id BETWEEN 100 AND 124 AND id % 2 = 0"), "annotation")
    return out.groupBy("annotation").agg(F.sum("k").alias("n"))


@query(SQL + "SELECT ancestor AS id FROM closure GROUP BY ancestor HAVING count(*) = 1")
def leaf_structures(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.leaves(views.structure(spark, sf))


@query(SQL + "SELECT ancestor AS id, count(*) AS n FROM cells JOIN closure ON annotation = descendant WHERE ancestor = 12 GROUP BY ancestor")
def descendant_count(spark: SparkSession, sf: str) -> DataFrame:
    below = ontology.descendants(views.structure(spark, sf), 12)
    counts = views.cells(spark, sf).groupBy("annotation").agg(F.count("*").alias("k"))
    return counts.join(below, counts.annotation == below.id, "left_semi").agg(F.sum("k").alias("n")).select(F.lit(12).cast("bigint").alias("id"), "n")


@query(SQL + ", walk AS (SELECT id, 0 AS depth, '/' || id || '/' AS structure_id_path FROM structure WHERE parent_structure_id IS NULL UNION ALL SELECT s.id, w.depth + 1, w.structure_id_path || s.id || '/' FROM structure s JOIN walk w ON s.parent_structure_id = w.id) SELECT id, CAST(depth AS INTEGER) AS depth, structure_id_path FROM walk")
def path_build_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.build_paths(views.structure(spark, sf))


@query(SQL + "SELECT id, CAST(depth - 2 - least((SELECT min(depth) - 2 FROM structure), 0) AS INTEGER) AS depth FROM structure")
def depth_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.normalise_depth(views.structure(spark, sf).withColumn("depth", F.col("depth") - 2)).select("id", "depth")


@query(SQL + "SELECT acronym, id, index FROM structure WHERE acronym = 'GERMANY' OR acronym = (SELECT min(n_name) FROM nation)")
def acronym_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = views.structure(spark, sf)
    first = views.table(spark, sf, "nation").agg(F.min("n_name").alias("acronym"))
    named = s.where(F.col("acronym") == "GERMANY").select("acronym").union(first).distinct()
    return s.join(named, "acronym").select("acronym", "id", "index")


LAYER_SQL = "CASE structure_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 23 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 60 WHEN 5 THEN 61 ELSE 0 END"


@query(SQL + f"SELECT layer, count(*) AS n FROM (SELECT CAST({LAYER_SQL.replace('structure_id', 'annotation')} AS INTEGER) AS layer FROM cells) GROUP BY layer")
def layer_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(x) for x in ("1", "2/3", "4", "5", "6a", "6b", "none")]), (F.col("id") % 7 + 1).cast("int"))
    layers = views.structure(spark, sf).select("id", ontology.layer_code(names).alias("code"))
    background = spark.range(1).select(F.lit(0).cast("bigint").alias("id"), F.lit(1).alias("code"))
    cells = views.cells(spark, sf).groupBy("annotation").agg(F.count("*").alias("k"))
    joined = cells.join(layers.unionByName(background), cells.annotation == F.col("id"), "left")
    return joined.groupBy(F.coalesce("code", F.lit(0)).alias("layer")).agg(F.sum("k").alias("n"))


# ---- two-group statistics ---------------------------------------------------------------------

VALUES_SQL = COUNTS_SQL + f""", vals AS (SELECT id, class, {GRP} AS grp, CAST(substr(sample_id, 2) AS INTEGER) % 3 AS pair_id, n::DOUBLE AS value FROM grid),
mom AS (SELECT id, class, count(value) FILTER (grp = 'WT') AS n_1, avg(value) FILTER (grp = 'WT') AS mean_1, var_samp(value) FILTER (grp = 'WT') AS var_1,
  count(value) FILTER (grp = 'KO') AS n_2, avg(value) FILTER (grp = 'KO') AS mean_2, var_samp(value) FILTER (grp = 'KO') AS var_2 FROM vals GROUP BY id, class),
welch AS (SELECT *, CASE WHEN var_1 + var_2 = 0 THEN CASE WHEN mean_1 = mean_2 THEN 'nan'::DOUBLE WHEN mean_1 > mean_2 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE (mean_1 - mean_2) / sqrt(var_1 / n_1 + var_2 / n_2) END AS t,
  CASE WHEN var_1 + var_2 = 0 THEN 1.0 ELSE pow(var_1 / n_1 + var_2 / n_2, 2) / (pow(var_1 / n_1, 2) / (n_1 - 1) + pow(var_2 / n_2, 2) / (n_2 - 1)) END AS df FROM mom),
welchp AS (SELECT *, {simpson_p('t', 'df')} AS p FROM welch)"""


def group_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.substring("sample_id", 2, 3).cast("int")
    return structure_rollup(spark, sf).select("id", "class", F.when(k < 3, "WT").otherwise("KO").alias("grp"), (k % 3).alias("pair_id"), F.col("n").cast("double").alias("value"))


@query(VALUES_SQL + "SELECT id, CAST(class AS INTEGER) AS class, round(mean_1, 6) AS mean_1, round(mean_2, 6) AS mean_2, round(sqrt(var_1), 6) AS sd_1, round(sqrt(var_2), 6) AS sd_2, round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p FROM welchp WHERE var_1 + var_2 > 0")
def welch_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.p_value(stats.welch(stats.moments(group_values(spark, sf), ["id", "class"], GROUPS))).where("var_1 + var_2 > 0")
    r = lambda c: F.round(c, 6)
    return m.select("id", "class", r("mean_1").alias("mean_1"), r("mean_2").alias("mean_2"), r(F.sqrt("var_1")).alias("sd_1"), r(F.sqrt("var_2")).alias("sd_2"), r("t").alias("t"), r("df").alias("df"), r("p").alias("p"))


@query(VALUES_SQL + f", pooled AS (SELECT id, class, (mean_1 - mean_2) / sqrt((var_1 * (n_1 - 1) + var_2 * (n_2 - 1)) / (n_1 + n_2 - 2) * (1.0 / n_1 + 1.0 / n_2)) AS t, (n_1 + n_2 - 2)::DOUBLE AS df FROM mom WHERE var_1 + var_2 > 0) SELECT id, CAST(class AS INTEGER) AS class, round(t, 6) AS t, df, round({simpson_p('t', 'df')}, 6) AS p FROM pooled")
def pooled_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.p_value(stats.pooled(stats.moments(group_values(spark, sf), ["id", "class"], GROUPS).where("var_1 + var_2 > 0")))
    return m.select("id", "class", F.round("t", 6).alias("t"), "df", F.round("p", 6).alias("p"))


@query(VALUES_SQL + f""", pairs AS (SELECT id, class, pair_id, max(value) FILTER (grp = 'WT') - max(value) FILTER (grp = 'KO') AS d FROM vals GROUP BY ALL),
pt AS (SELECT id, class, count(*) AS n_pairs, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, (count(*) - 1)::DOUBLE AS df FROM pairs GROUP BY id, class HAVING stddev_samp(d) > 0)
SELECT id, CAST(class AS INTEGER) AS class, n_pairs, round(t, 6) AS t, df, round({simpson_p('t', 'df')}, 6) AS p FROM pt""")
def paired_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.p_value(stats.paired(group_values(spark, sf), ["id", "class"], "pair_id", GROUPS).where("sd_diff > 0"))
    return m.select("id", "class", "n_pairs", F.round("t", 6).alias("t"), "df", F.round("p", 6).alias("p"))


@query(f"SELECT CAST(k AS INTEGER) AS k, df, round({simpson_p('t', 'df')}, 8) AS p FROM (SELECT k, k / 4.0::DOUBLE AS t, df FROM range(0, 41) r(k) CROSS JOIN (VALUES (1.0::DOUBLE), (2.0), (2.5), (4.0), (7.3), (30.0)) d(df))")
def student_t_p(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.special import student_t_p as p

    at = spark.range(41).select(F.col("id").cast("int").alias("k"), F.explode(F.array(*[F.lit(x) for x in (1.0, 2.0, 2.5, 4.0, 7.3, 30.0)])).alias("df"))
    return at.select("k", "df", F.round(p(F.col("k") / 4.0, F.col("df")), 8).alias("p"))


FDR_SQL = VALUES_SQL + """, fam AS (SELECT id, class, round(p, 9) AS p FROM welchp WHERE greatest(mean_1, mean_2) > 10 AND var_1 + var_2 > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY p, id) AS k, count(*) OVER (PARTITION BY class) AS m FROM fam)"""
BACK = "OVER (PARTITION BY class ORDER BY p DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _family(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.moments(group_values(spark, sf), ["id", "class"], GROUPS)
    m = stats.p_value(stats.welch(m.where(stats.testable_table(m, 10.0) & (F.col("var_1") + F.col("var_2") > 0))))
    return m.select("id", "class", F.round("p", 9).alias("p"))


@query(FDR_SQL + f"SELECT id, CAST(class AS INTEGER) AS class, round(p, 6) AS p, round(min(m * p / k) {BACK}, 6) AS q FROM ranked")
def bh_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return stats.fdr(_family(spark, sf), ["class"], "p", ["id"]).select("id", "class", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query(FDR_SQL + f", h AS (SELECT n, sum(1.0 / n) OVER (ORDER BY n) AS harmonic FROM range(1, 100000) r(n)) SELECT id, CAST(class AS INTEGER) AS class, round(min(m * harmonic * p / k) {BACK}, 6) AS q FROM ranked JOIN h ON h.n = m")
def by_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return stats.fdr(_family(spark, sf), ["class"], "p", ["id"], "by").select("id", "class", F.round("q", 6).alias("q"))


@query(FDR_SQL + f", adj AS (SELECT id, class, min(m * p / k) {BACK} AS q FROM ranked) SELECT id, CAST(class AS INTEGER) AS class, CAST((q <= 0.05)::INT + (q < 0.05)::INT + (q < 0.01)::INT + (q < 0.001)::INT + (q < 0.0001)::INT AS INTEGER) AS sig, round(greatest(-log10(q), -log10(0.05)), 6) AS score FROM adj WHERE q > 0")
def sig_level(spark: SparkSession, sf: str) -> DataFrame:
    import math

    q = stats.fdr(_family(spark, sf), ["class"], "p", ["id"]).where("q > 0")
    return q.select("id", "class", stats.significance(F.col("q")).alias("sig"), F.round(stats.neg_log10(F.col("q"), -math.log10(0.05)), 6).alias("score"))


@query(VALUES_SQL + "SELECT id, CAST(class AS INTEGER) AS class, greatest(mean_1, mean_2) > 10 AS by_table, mean_1 > 10 AND mean_2 > 10 AS by_voxel, round(CASE WHEN mean_1 > 0 THEN 100 * (mean_2 - mean_1) / mean_1 END, 6) AS pchange FROM mom")
def testable_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.moments(group_values(spark, sf), ["id", "class"], GROUPS)
    change = F.when(F.col("mean_1") > 0, stats.percent_change(F.col("mean_1"), F.col("mean_2")))
    return m.select("id", "class", stats.testable_table(m, 10.0).alias("by_table"), stats.testable_voxel(10.0).alias("by_voxel"), F.round(change, 6).alias("pchange"))


@query(COUNTS_SQL + "SELECT sample_id, id, CAST(class AS INTEGER) AS class, round(n / avg(n) OVER (PARTITION BY sample_id, class), 6) AS normalised FROM grid")
def sample_normalised(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.normalised(structure_rollup(spark, sf), ["sample_id", "class"], "n")
    return out.select("sample_id", "id", "class", F.round("normalised", 6).alias("normalised"))


EVALUATE_SQL = COUNTS_SQL + f""", c AS (SELECT sample_id, id, class, n FROM grid UNION ALL SELECT sample_id, id, 0, sum(n) FROM grid GROUP BY sample_id, id),
long AS (SELECT 'Counts' AS metric, sample_id, id, class, n::DOUBLE AS value FROM c UNION ALL SELECT 'Density', sample_id, id, class, n / volume FROM c JOIN vols USING (id)),
m AS (SELECT metric, id, class, avg(v) FILTER (g = 'WT') AS mean_1, avg(v) FILTER (g = 'KO') AS mean_2, var_samp(v) FILTER (g = 'WT') AS var_1, var_samp(v) FILTER (g = 'KO') AS var_2
  FROM (SELECT metric, id, class, {GRP} AS g, CASE WHEN id = 1 THEN 0 ELSE value END AS v FROM long) GROUP BY ALL),
ok AS (SELECT *, greatest(mean_1, mean_2) > (CASE metric WHEN 'Counts' THEN 10 ELSE 0 END) AND var_1 + var_2 > 0 AS tested FROM m),
tt AS (SELECT *, (mean_1 - mean_2) / sqrt(var_1 / 3 + var_2 / 3) AS t, pow(var_1 / 3 + var_2 / 3, 2) / (pow(var_1 / 3, 2) / 2 + pow(var_2 / 3, 2) / 2) AS df FROM ok WHERE tested),
tp AS (SELECT *, round({simpson_p('t', 'df')}, 9) AS p FROM tt),
rk AS (SELECT *, row_number() OVER (PARTITION BY metric, class ORDER BY p, id) AS k, count(*) OVER (PARTITION BY metric, class) AS nn FROM tp),
qq AS (SELECT *, min(nn * p / k) OVER (PARTITION BY metric, class ORDER BY p DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM rk)
SELECT metric, id AS index, CAST(class AS INTEGER) AS class, round(mean_1, 6) AS mean_1, round(mean_2, 6) AS mean_2, round(sqrt(var_1), 6) AS sd_1, round(sqrt(var_2), 6) AS sd_2,
  round(CASE WHEN mean_1 = 0 THEN NULL ELSE 100 * (mean_2 - mean_1) / mean_1 END, 6) AS pchange, round(p, 6) AS p, round(q, 6) AS q, CAST((q <= 0.05)::INT + (q < 0.05)::INT + (q < 0.01)::INT + (q < 0.001)::INT + (q < 0.0001)::INT AS INTEGER) AS sig FROM qq
UNION ALL SELECT metric, id, CAST(class AS INTEGER), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0 FROM ok WHERE NOT tested"""


@query(EVALUATE_SQL)
def evaluate_group(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: counts and densities of every structure and class, two groups compared with FDR; the root isn't tested."""
    s = views.structure(spark, sf)
    counts = summarize.class_totals(summarize.structure_counts(views.cells(spark, sf), s, CLASSES))
    dense = summarize.densities(counts, summarize.volumes(views.mask(spark, sf), s)).where("volume IS NOT NULL")
    k = F.substring("sample_id", 2, 3).cast("int")
    both = F.array(F.struct(F.lit("Counts").alias("metric"), F.col("n").cast("double").alias("value")), F.struct(F.lit("Density").alias("metric"), F.col("density").alias("value")))
    with_density = counts.join(dense.select("sample_id", "id", "class", "density"), ["sample_id", "id", "class"], "left")
    long = with_density.select(F.when(k < 3, "WT").otherwise("KO").alias("grp"), "id", "class", F.explode(both).alias("m")).select("grp", "id", "class", "m.metric", F.when(F.col("id") == 1, F.when(F.col("m.value").isNotNull(), 0.0)).otherwise(F.col("m.value")).alias("value")).where("value IS NOT NULL")
    m = stats.moments(long, ["metric", "id", "class"], GROUPS)
    least = F.when(F.col("metric") == "Counts", 10.0).otherwise(0.0)
    tested = stats.testable_table(m, least) & (F.col("var_1") + F.col("var_2") > 0)
    m = stats.p_value(stats.welch(m.withColumn("tested", tested))).withColumn("p", F.round("p", 9))
    q = stats.fdr(m.where("tested"), ["metric", "class"], "p", ["id"])
    r = lambda c: F.round(c, 6)
    change = F.when(F.col("mean_1") != 0, stats.percent_change(F.col("mean_1"), F.col("mean_2")))
    shown = q.select("metric", F.col("id").alias("index"), "class", r("mean_1").alias("mean_1"), r("mean_2").alias("mean_2"), r(F.sqrt("var_1")).alias("sd_1"), r(F.sqrt("var_2")).alias("sd_2"), r(change).alias("pchange"), r("p").alias("p"), r("q").alias("q"), stats.significance(F.col("q")).alias("sig"))
    zero, one = F.lit(0.0), F.lit(1.0)
    rest = m.where("NOT tested").select("metric", F.col("id").alias("index"), "class", *[zero.alias(c) for c in ("mean_1", "mean_2", "sd_1", "sd_2", "pchange")], one.alias("p"), one.alias("q"), F.lit(0).alias("sig"))
    return shown.unionByName(rest)
