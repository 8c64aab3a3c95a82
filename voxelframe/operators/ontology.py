"""The region ontology: materialised paths, closure, roll-up, binning to ancestors.

A path such as ``/1/12/105/`` lists the ancestors of a structure, itself included. The closure
table (ancestor, descendant) is the exploded path, so every hierarchy question is an equi-join.
The ontology is a dimension of some thousand rows; the facts are aggregated before they meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_ids(path: Column) -> Column:
    """The ids of a path as longs, root first."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: x.cast("bigint"))


def closure(structure: DataFrame) -> DataFrame:
    """ancestor, descendant, with every structure its own ancestor."""
    return structure.select(F.explode(path_ids(F.col("structure_id_path"))).alias("ancestor"), F.col("id").alias("descendant"))


def rollup(values: DataFrame, structure: DataFrame, key: str, by: list[str], value: str) -> DataFrame:
    """Sums of ``value`` over each structure and all that lies below it: ``by``, id, value.

    ``values`` is summed per structure first, so the join sees one row per structure and group.
    """
    own = values.groupBy(*by, key).agg(F.sum(value).alias(value))
    joined = own.join(closure(structure), own[key] == F.col("descendant"))
    return joined.groupBy(*by, F.col("ancestor").alias("id")).agg(F.sum(value).alias(value))


def build_paths(nodes: DataFrame) -> DataFrame:
    """id, depth, structure_id_path from id and parent_structure_id alone, by recursion in the engine."""
    name = f"nodes_{abs(hash(tuple(nodes.columns))) % 10**8}"
    nodes.select("id", "parent_structure_id").createOrReplaceTempView(name)
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE walk(id, depth, structure_id_path) AS (
          SELECT id, 0, concat('/', id, '/') FROM {name} WHERE parent_structure_id IS NULL
          UNION ALL
          SELECT n.id, w.depth + 1, concat(w.structure_id_path, n.id, '/') FROM {name} n JOIN walk w ON n.parent_structure_id = w.id)
        SELECT id, depth, structure_id_path FROM walk""")


def normalise_depth(structure: DataFrame) -> DataFrame:
    """Shift depths so that the least is 0, only where it is below 0."""
    least = F.min("depth").over(Window.partitionBy(F.lit(0)))
    return structure.withColumn("depth", (F.col("depth") - F.least(least, F.lit(0))).cast("int"))


def bin_to_ancestor(annotations: DataFrame, structure: DataFrame, targets: DataFrame, column: str, keep_rest: bool = False) -> DataFrame:
    """Replace ``column`` by its deepest ancestor among ``targets`` (id); the rest becomes 0, or stays."""
    wanted = closure(structure).join(targets.select(F.col("id").alias("ancestor")).distinct(), "ancestor")
    deep = structure.select(F.col("id").alias("ancestor"), "depth")
    best = wanted.join(deep, "ancestor").groupBy("descendant").agg(F.max_by("ancestor", "depth").alias("bin"))
    rest = F.col(column) if keep_rest else F.lit(0).cast("bigint")
    joined = annotations.join(best, annotations[column] == best["descendant"], "left")
    return joined.drop("descendant").withColumn(column, F.coalesce("bin", rest)).drop("bin")


def leaves(structure: DataFrame) -> DataFrame:
    """Structures with nothing below them: ids that occur once over all paths."""
    return closure(structure).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n")).where("n = 1").select("id")


def descendants(structure: DataFrame, root: int) -> DataFrame:
    """Ids of a structure and of all below it."""
    return closure(structure).where(F.col("ancestor") == root).select(F.col("descendant").alias("id"))


def by_acronym(structure: DataFrame, acronym: str) -> DataFrame:
    return structure.where(F.col("acronym") == acronym).select("index", "id")


def layer_code(code: Column) -> Column:
    """Cortical layer labels as numbers; 2/3 is 23, 6a is 60, 6b is 61, others 0."""
    # fixed values: the layer codes of the results
    codes = {"1": 1, "2/3": 23, "4": 4, "5": 5, "6a": 60, "6b": 61}
    pairs = [x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(0))
