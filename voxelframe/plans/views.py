"""Point tables, ontology, label mask and series as views of the star-schema test tables.

``SQL`` is the same set of views as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Detected points: sample_id, grp, pair_id, y, x, z, annotation (0: background), class, intensity_1, intensity_2."""
    k = F.col("l_orderkey") % 6
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), k.cast("string")).alias("sample_id"),
        F.when(k < 3, "WT").otherwise("KO").alias("grp"),
        (F.col("l_orderkey") % 3).cast("int").alias("pair_id"),
        F.col("l_quantity").cast("int").alias("y"),
        (F.round(F.col("l_discount") * 100).cast("int") + 1).alias("x"),
        F.col("l_linenumber").cast("int").alias("z"),
        F.when(F.col("l_suppkey") == 0, 0).otherwise(1000 + F.col("l_suppkey")).cast("bigint").alias("annotation"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("class"),
        F.col("l_extendedprice").alias("intensity_1"),
        F.col("l_tax").alias("intensity_2"),
    )


def structure(spark: SparkSession, sf: str) -> DataFrame:
    """Ontology of four levels: index, id, parent_structure_id, depth, structure_id_path, acronym."""
    region, nation, supplier = (table(spark, sf, n) for n in ("region", "nation", "supplier"))
    root = spark.range(1).select(F.lit(1).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent_structure_id"), F.lit(0).alias("depth"), F.lit("/1/").alias("structure_id_path"), F.lit("root").alias("acronym"))
    r = region.select((10 + F.col("r_regionkey")).cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("parent_structure_id"), F.lit(1).alias("depth"), F.format_string("/1/%d/", 10 + F.col("r_regionkey")).alias("structure_id_path"), F.col("r_name").alias("acronym"))
    n = nation.select(
        (100 + F.col("n_nationkey")).cast("bigint").alias("id"), (10 + F.col("n_regionkey")).cast("bigint").alias("parent_structure_id"), F.lit(2).alias("depth"),
        F.format_string("/1/%d/%d/", 10 + F.col("n_regionkey"), 100 + F.col("n_nationkey")).alias("structure_id_path"), F.col("n_name").alias("acronym"),
    )
    s = supplier.where("s_suppkey > 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (1000 + F.col("s_suppkey")).cast("bigint").alias("id"), (100 + F.col("n_nationkey")).cast("bigint").alias("parent_structure_id"), F.lit(3).alias("depth"),
        F.format_string("/1/%d/%d/%d/", 10 + F.col("n_regionkey"), 100 + F.col("n_nationkey"), 1000 + F.col("s_suppkey")).alias("structure_id_path"), F.col("s_name").alias("acronym"),
    )
    return root.unionByName(r).unionByName(n).unionByName(s).withColumn("index", F.col("id"))


def mask(spark: SparkSession, sf: str) -> DataFrame:
    """Label volume in long form: y, x, z, structure_index (above 0)."""
    labelled = cells(spark, sf).where("annotation > 0 AND (y + x + z) % 5 <> 0")
    return labelled.groupBy("y", "x", "z").agg(F.min("annotation").alias("structure_index"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """A value by slice: tile (event type), z (1, 2, ... by time), value; null where the event has a user of 0 modulo 7."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_type", F.row_number().over(w).alias("z"), F.col("value"), F.col("user_id"), F.col("event_id")).select(F.col("event_type").alias("tile"), "z", F.when(F.col("user_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"))


SQL = """WITH RECURSIVE cells AS (
  SELECT 'S' || CAST(l_orderkey % 6 AS VARCHAR) AS sample_id, CASE WHEN l_orderkey % 6 < 3 THEN 'WT' ELSE 'KO' END AS grp, CAST(l_orderkey % 3 AS INTEGER) AS pair_id,
    CAST(l_quantity AS INTEGER) AS y, CAST(round(l_discount * 100) AS INTEGER) + 1 AS x, CAST(l_linenumber AS INTEGER) AS z,
    CAST(CASE WHEN l_suppkey = 0 THEN 0 ELSE 1000 + l_suppkey END AS BIGINT) AS annotation,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS class, l_extendedprice AS intensity_1, l_tax AS intensity_2
  FROM lineitem),
structure AS (
  SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_structure_id, 0 AS depth, '/1/' AS structure_id_path, 'root' AS acronym, CAST(1 AS BIGINT) AS index
  UNION ALL SELECT 10 + r_regionkey, 1, 1, '/1/' || (10 + r_regionkey) || '/', r_name, 10 + r_regionkey FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 2, '/1/' || (10 + n_regionkey) || '/' || (100 + n_nationkey) || '/', n_name, 100 + n_nationkey FROM nation
  UNION ALL SELECT 1000 + s_suppkey, 100 + n_nationkey, 3, '/1/' || (10 + n_regionkey) || '/' || (100 + n_nationkey) || '/' || (1000 + s_suppkey) || '/', s_name, 1000 + s_suppkey
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey > 0),
closure AS (
  SELECT CAST(u.a AS BIGINT) AS ancestor, s.id AS descendant FROM structure s, UNNEST(string_split(trim(s.structure_id_path, '/'), '/')) AS u(a)),
mask AS (
  SELECT y, x, z, min(annotation) AS structure_index FROM cells WHERE annotation > 0 AND (y + x + z) % 5 <> 0 GROUP BY y, x, z),
series AS (
  SELECT event_type AS tile, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS z, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)
"""
