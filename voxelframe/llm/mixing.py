"""Mixing of sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the
whole; a target stops at ``cap`` times its source's size and the excess is shared again by
weight. That is one water level, found with two running sums over the sources.

Copies: a source whose target is r times its size takes floor(r) certain copies of every
document; the rest r - floor(r) is the mean inclusion probability p of the source. A document's inclusion odds are p/(1-p)
times sqrt((1 + mean size) / (1 + its size)): the shorter ones are likelier, so that a source's words come from more
documents (``odds`` names a column of other factors). Documents are ranked by
random odds over inclusion odds, (u/(1-u)) / odds, and taken in that order until the
remaining words are met; u comes from a hash of ``doc_id`` and the seed, so reruns agree.
The cut is found in two histograms of the rank (cells of the source, then parts of the cell in
which the cut lies), so no source is ever sorted as a whole; only the part of some LIST
documents around the cut is gone through in order, taking what still fits and at last,
if that comes nearer, the smallest one that doesn't.

Defined results: null text has size 0; a source of size 0 has target 0; documents of size 0
take no words; rows that repeat a doc_id in a source are taken or left together; null doc_id
hashes as the empty string; an empty table gives no rows; other columns are ignored, or
passed by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import AT, PART, WORDS, Numbered, join_hot, save

#: Documents around the cut that are taken one by one, and the most cells of a histogram.
LIST, CELLS = 256, 4096


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def uniform(seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of doc_id and seed."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """From source, source_size, n_docs (one row per source): adds weight and target."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("weight", ((F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * cap)
    order = everything.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything)).withColumn("target", F.least(F.col("most"), F.col("weight") * F.col("level"))).drop("level", "most")


def copies(docs: DataFrame, cap: float = 3.0, seed: int = 20, odds: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, odds (the factor).

    ``odds`` names a column of positive weights by which inclusion odds differ within a source, instead of the rule by size.
    """
    return _copies(docs, [], cap, seed, odds)


def _copies(docs: DataFrame, places: list[str], cap: float, seed: int, odds: str | None) -> DataFrame:
    """What ``copies`` gives, with the columns ``places`` of ``docs`` in front."""
    base = save(docs.select(*places, "doc_id", "source", words().alias("size"), uniform(seed).alias("u"), (F.col(odds).cast("double") if odds else F.lit(None).cast("double")).alias("given")), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = targets(sizes, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    plan = plan.withColumn("p", F.least(F.greatest(ratio - F.col("whole"), F.lit(1e-9)), F.lit(1 - 1e-9))).withColumn("cells", F.least(F.lit(CELLS), F.ceil(F.col("n_docs") / LIST)))
    plan = save(plan.drop("weight"), "plan")
    total = plan.agg(F.sum("n_docs")).first()[0] or 0

    by_size = F.sqrt((1 + F.col("source_size") / F.col("n_docs")) / (1 + F.col("size")))
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("odds") * F.col("p") / (1 - F.col("p")))
    spread = F.col("cells") * (F.col("z") / (F.col("z") + 1))
    placed = join_hot(base, plan, ["source"], "n_docs", total).withColumn("odds", F.coalesce("given", by_size)).withColumn("z", rank)
    placed = placed.withColumn("cell", F.least(F.floor(spread), F.col("cells") - 1)).withColumn("inner", spread - F.col("cell"))

    def cut(cells: DataFrame, by: str, left: str) -> DataFrame:
        """The cell of each source in which the words reach ``left``, and the words before it."""
        w = Window.partitionBy("source").orderBy(by)
        run = cells.withColumn("upto", F.sum("w").over(w)).withColumn("before", F.col("upto") - F.col("w"))
        return run.where((F.col("before") <= F.col(left)) & (F.col("upto") > F.col(left)))

    first = placed.groupBy("source", "cell").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.first("left").alias("left"))
    first = cut(first, "cell", "left").select("source", F.col("cell").alias("cut_cell"), (F.col("left") - F.col("before")).alias("left2"), F.ceil(F.col("n") / LIST).alias("parts"))
    first = save(plan.select("source", "n_docs").join(first, plan.source.eqNullSafe(first.source), "left").drop(first.source), "cut")
    placed = join_hot(placed, first.withColumnRenamed("n_docs", "n_rows"), ["source"], "n_rows", total)
    edge = placed.where("cell = cut_cell").withColumn("part", F.least(F.floor(F.col("inner") * F.col("parts")), F.col("parts") - 1))
    second = edge.groupBy("source", "part").agg(F.sum("size").alias("w"), F.first("left2").alias("left2"))
    second = cut(second, "part", "left2").select("source", F.col("part").alias("cut_part"), (F.col("left2") - F.col("before")).alias("left3"))
    near = edge.alias("e").join(second.alias("s"), F.expr("e.source <=> s.source AND e.part = s.cut_part")).groupBy("e.source", "z", "doc_id").agg(F.sum("size").alias("size"), F.first("left3").alias("left3"))
    listed = near.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("z", "doc_id", "size"))).alias("l"), F.first("left3").alias("left3"))
    start = F.struct(F.col("left3").alias("left"), F.array().cast(f"array<struct<z:double,doc_id:{base.schema['doc_id'].dataType.simpleString()}>>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["size"] > 0) & (x["size"] <= acc["left"])
        return F.struct(
            F.when(fits, acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["ids"], F.array(F.struct(x["z"].alias("z"), x["doc_id"].alias("doc_id"))))).otherwise(acc["ids"]).alias("ids"),
        )

    def last(left: Column, ids: Column, x: Column) -> Column:
        """The smallest document that was left, if with it the words come nearer."""
        rest = F.filter(x, lambda d: (d["size"] > 0) & ~F.exists(ids, lambda t: (t["z"] == d["z"]) & t["doc_id"].eqNullSafe(d["doc_id"])))
        least = F.array_min(F.transform(rest, lambda d: F.struct(d["size"].alias("size"), d["z"].alias("z"), d["doc_id"].alias("doc_id"))))
        return F.when(least["size"] < 2 * left, F.concat(ids, F.array(F.struct(least["z"].alias("z"), least["doc_id"].alias("doc_id"))))).otherwise(ids)

    gone = listed.select("source", "l", F.aggregate("l", start, step).alias("g"))
    picked = gone.select("source", last(F.col("g.left"), F.col("g.ids"), F.col("l")).alias("ids"))
    picked = save(plan.select("source", "n_docs").join(second, plan.source.eqNullSafe(second.source), "left").drop(second.source).alias("a").join(picked.alias("b"), F.expr("a.source <=> b.source"), "left").select("a.source", F.col("n_docs").alias("n_in"), "cut_part", "ids"), "picked")
    done = join_hot(placed, picked, ["source"], "n_in", total).withColumn("part", F.least(F.floor(F.col("inner") * F.col("parts")), F.col("parts") - 1))
    listed_too = F.exists("ids", lambda x: (x["z"] == F.col("z")) & x["doc_id"].eqNullSafe(F.col("doc_id")))
    extra = F.when(F.col("left") <= 0, False).when(F.col("cut_cell").isNull(), True).when(F.col("cell") != F.col("cut_cell"), F.col("cell") < F.col("cut_cell"))
    extra = extra.when(F.col("cut_part").isNull() | (F.col("part") < F.col("cut_part")), True).when(F.col("part") > F.col("cut_part"), False).otherwise(F.coalesce(listed_too, F.lit(False)))
    return done.select(*places, "doc_id", "source", "size", "source_size", "target", (F.col("whole") + extra.cast("long")).alias("copies"), "odds")


def mix(docs: DataFrame, cap: float = 3.0, seed: int = 20) -> DataFrame:
    """The mixture: every row of ``docs`` as often as it is taken, with its own columns only.

    Rows are repeated or left out where they lie; the texts are not shuffled.
    """
    table = Numbered(docs, "mixture")
    taken = _copies(table.rows, [PART, AT], cap, seed, None).where("copies > 0").select(PART, AT, F.col("copies").alias("__vf_copies"))
    both = table.beside(taken, "__vf_copies").where("__vf_copies IS NOT NULL")
    return table.bare(both.withColumn("__vf_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__vf_copies")))))
