"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut into chunks at places that its own characters define. Distinct
chunks move once, after a map-side distinct, to verify that no two chunks share an
identifier; a document is then only the ordered list of its chunks' identifiers, and
equal lists are equal texts. Long documents never move as a whole.

Defined results: a null text counts as empty; empty texts equal each other; white-space
runs count as one space and are not trimmed; rows that repeat a ``doc_id`` count each in
``group_size`` and carry the same verdict; null ``doc_id`` never stays unless the group
has no other (then ``keep_id`` is null and ``kept`` false); an empty table gives no rows;
other columns are ignored, or passed by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ODD_SPACES, join_hot, save

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: A chunk ends after the least length where "e", a space and a vowel meet, or at the greatest length.
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?e (?=[aeiou])|.{{1,{MAX_CHUNK}}}"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ODD_SPACES, " ")


def chunks(text: Column) -> Column:
    """The ordered chunks; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_sha256, recipe (ordered list of verified chunk identifiers), saved."""
    cut = docs.select("doc_id", normalised().alias("_t"))
    parts = cut.select(F.explode(chunks(F.col("_t"))).alias("chunk")).select(digest(F.col("chunk")).alias("h"), "chunk")
    twins = parts.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    plain = cut.select("doc_id", F.sha2(F.col("_t"), 256).alias("text_sha256"), chunks(F.col("_t")).alias("_c"))
    if not twins.limit(1).count():
        return save(plain.select("doc_id", "text_sha256", F.transform("_c", lambda c: F.struct(digest(c).alias("h"), F.lit(0).alias("v"))).alias("recipe")), "recipes")
    twins = save(twins, "twins")
    # some identifiers stand for two chunks: number the chunks of each, by their text
    listed = parts.distinct().join(twins, "h", "left_semi").groupBy("h").agg(F.sort_array(F.collect_list("chunk")).alias("all"))
    named = listed.select("h", F.posexplode("all").alias("v", "chunk"))
    rows = save(plain.withColumn("_row", F.monotonically_increasing_id()), "rows")
    spread = rows.select("_row", F.posexplode("_c").alias("pos", "chunk")).withColumn("h", digest(F.col("chunk")))
    ids = spread.join(named, ["h", "chunk"], "left").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("v", F.lit(0)).alias("v")))).alias("p"))
    ids = ids.select("_row", F.transform("p", lambda x: F.struct(x["h"].alias("h"), x["v"].alias("v"))).alias("r"))
    empty = F.array().cast(ids.schema["r"].dataType)
    return save(rows.join(ids, "_row", "left").select("doc_id", "text_sha256", F.coalesce("r", empty).alias("recipe")), "recipes")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    lists = recipes(docs, digest)
    groups = lists.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = join_hot(lists, groups, ["recipe"], "group_size", lists.count())
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    verdict = exact_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(verdict, "doc_id", "left_semi")


__all__ = ["chunks", "dedup", "exact_duplicates", "normalised", "recipes"]
