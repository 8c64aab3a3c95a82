"""Removal of lines that many sites share, by distinct-site sketches.

Lines are split at line feeds, lower-cased, white-space runs made one space, trimmed, and
hashed (128 bits) once. Per line hash, the sites are put into HyperLogLog sketches, which merge by aggregation
(first per line and site, on the map side, so a line that every page has moves few rows).
A line whose estimate lies MARGIN standard errors from the threshold is decided by the sketch;
the others get an exact distinct count. Lines of a document that are boilerplate go: their
positions, not the texts, are moved to where the documents lie.

Defined results: a null text has no lines and stays null; a null site counts as one site; blank lines are
never counted or removed, nor are lines of fewer than ``least_words`` words if that is over 1; repeated rows change no site
count; an empty table gives no rows; other columns are ignored, or passed by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import AT, PART, Numbered, join_hot, release, save

#: Sites from which on a line is boilerplate; the fewest words of a line that counts.
SITES, LEAST_WORDS = 6, 1
#: log2 of the sketch registers; relative error of such a sketch; standard errors that count as near.
LG_K, MARGIN = 10, 5.0
ERROR = 1.04 / (1 << LG_K) ** 0.5


#: Runs of white space within a line that aren't one space already: SPACES without the line feed.
ODD = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+"


def normal_text(text: Column) -> Column:
    """All lines of a text lower-cased, their white-space runs made one space, at once; the ends are still to be trimmed."""
    return F.regexp_replace(F.lower(text), ODD, " ")


def line_hashes(rows: DataFrame, site: str, least_words: int) -> DataFrame:
    """place, site, pos, h, g (two hashes of the normal line) of the lines that count; saved."""
    lines = rows.select(PART, AT, F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"), F.posexplode(F.split(normal_text(F.col("text")), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line"))
    counts = F.col("line") != ""
    if least_words > 1:
        counts = counts & (F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1 >= least_words)
    return save(lines.where(counts).select(PART, AT, "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("line"), "line").alias("g")), "lines")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes of the lines that ``sites`` or more distinct sites have: h, g, n_sites (exact where near), n_rows, exact."""
    pairs = save(lines.groupBy("h", "g", "site").agg(F.count("*").alias("n")), "line_sites")
    seen = pairs.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.sum("n").alias("n_rows"))
    guess = seen.select("h", "g", "n_rows", F.hll_sketch_estimate("sketch").alias("n"))
    low, high = sites / (1 + MARGIN * ERROR), sites / (1 - MARGIN * ERROR)
    guess = save(guess.where(F.col("n") >= F.floor(F.lit(low))), "line_spread")
    near = guess.where(F.col("n") <= F.ceil(F.lit(high))).select("h", "g")
    counted = pairs.join(near, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.countDistinct("site").alias("n_sites"), F.sum("n").alias("n_rows")).where(F.col("n_sites") >= sites)
    sure = guess.where(F.col("n") > F.ceil(F.lit(high))).select("h", "g", F.col("n").alias("n_sites"), "n_rows", F.lit(False).alias("exact"))
    return sure.unionByName(counted.withColumn("exact", F.lit(True)))


def clean(docs: DataFrame, site: str = "source", sites: int = SITES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines cut from text; n_lines and n_removed are added or replaced."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    table = Numbered(docs.select(*[F.col(f"`{c}`") for c in own]), "lines")
    lines = line_hashes(table.rows, site, least_words)
    bad = save(boilerplate(lines, sites).select("h", "g", "n_rows"), "boilerplate")
    total = bad.agg(F.sum("n_rows")).first()[0] or 0
    found = join_hot(lines.select(PART, AT, "pos", "h", "g"), bad, ["h", "g"], "n_rows", total).where("n_rows IS NOT NULL")
    gone = save(found.groupBy(PART, AT).agg(F.collect_list("pos").alias("__vf_gone")), "gone")
    release(lines)
    out = table.beside(gone, "__vf_gone")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains("__vf_gone", i))
    n = F.when(F.col("__vf_gone").isNull(), 0).otherwise(F.size("__vf_gone")).cast("long")
    text = F.when(F.col("__vf_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in own], F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), n.alias("n_removed"))
