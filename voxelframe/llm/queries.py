"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_extract, language_model, line_dedup, mixing, near_dedup, quality, toxicity, training_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).drop("n_chunks")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.written(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.clean(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_extract": op3_html_extract,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_training_order": op6_training_order,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_mix_sources": op10_mix_sources,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACES = r"'[\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM benchmark),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, n, i, item FROM places JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_exact_dedup": f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_SPACES}, ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op7_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT doc_id, w, least(5, len(w)) AS k FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.r)
SELECT r.id AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.r) AS component_id, r.id = min(r.r) AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id""",
    "op9_line_dedup": f"""
WITH l AS (SELECT doc_id, coalesce(source, chr(0)) AS site, i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
m AS (SELECT *, trim(regexp_replace(lower(line), {_SPACES}, ' ', 'g'), ' ') AS norm FROM l),
bad AS (SELECT norm FROM m WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= 6),
t AS (SELECT doc_id, count(*) AS n_lines, count(bad.norm) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (bad.norm IS NULL) AS text FROM m LEFT JOIN bad USING (norm) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t.text, '')) AS text_sha256 FROM documents d LEFT JOIN t USING (doc_id)""",
    "op10_mix_sources": f"""
WITH RECURSIVE base AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  (CAST('0x' || substr(md5('20' || coalesce(':' || CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM base GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3::DOUBLE AS most FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM weighed),
aimed AS (SELECT source, source_size, n, least(most, w * max(l) OVER ()) AS target FROM levels),
ratios AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM aimed),
plan AS (SELECT source, source_size, n, target, floor(ratio + 1e-12::DOUBLE) AS whole, greatest(target - floor(ratio + 1e-12::DOUBLE) * source_size, 0) AS rest,
  least(greatest(ratio - floor(ratio + 1e-12::DOUBLE), 1e-9::DOUBLE), 1::DOUBLE - 1e-9::DOUBLE) AS p, least(4096, ceil(n / 256::DOUBLE)) AS cells FROM ratios),
ranked AS (SELECT b.*, source_size, target, whole, rest, cells, (u / (1 - u)) / (sqrt((1 + source_size::DOUBLE / n) / (1 + size)) * p / (1 - p)) AS z FROM base b JOIN plan t ON b.source IS NOT DISTINCT FROM t.source),
placed AS (SELECT *, least(floor(cells * (z / (z + 1))), cells - 1) AS cell, cells * (z / (z + 1)) AS spread FROM ranked),
c1 AS (SELECT source, cell, sum(size) AS w, count(*) AS n, any_value(rest) AS rest FROM placed GROUP BY source, cell),
r1 AS (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY cell) AS upto FROM c1),
cut1 AS (SELECT source, cell AS cut_cell, rest - (upto - w) AS rest2, ceil(n / 256::DOUBLE) AS parts FROM r1 WHERE upto - w <= rest AND upto > rest),
inside AS (SELECT t.*, cut_cell, rest2, parts, least(floor((spread - cell) * parts), parts - 1) AS part FROM placed t LEFT JOIN cut1 c ON t.source IS NOT DISTINCT FROM c.source),
c2 AS (SELECT source, part, sum(size) AS w, any_value(rest2) AS rest2 FROM inside WHERE cell = cut_cell GROUP BY source, part),
r2 AS (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY part) AS upto FROM c2),
cut2 AS (SELECT source, part AS cut_part, rest2 - (upto - w) AS rest3 FROM r2 WHERE upto - w <= rest2 AND upto > rest2),
near AS (SELECT i.source, z, doc_id, sum(size) AS size, any_value(rest3) AS rest3, row_number() OVER (PARTITION BY i.source ORDER BY z, doc_id) AS k FROM inside i JOIN cut2 c ON i.source IS NOT DISTINCT FROM c.source AND i.part = c.cut_part WHERE cell = cut_cell GROUP BY i.source, z, doc_id),
walk AS (SELECT source, 0::BIGINT AS k, any_value(rest3)::DOUBLE AS rest, false AS took FROM near GROUP BY source
  UNION ALL SELECT n.source, n.k, CASE WHEN n.size > 0 AND n.size <= walk.rest THEN walk.rest - n.size ELSE walk.rest END, n.size > 0 AND n.size <= walk.rest FROM walk JOIN near n ON n.source IS NOT DISTINCT FROM walk.source AND n.k = walk.k + 1),
ended AS (SELECT source, min(rest) AS rest FROM walk GROUP BY source),
spare AS (SELECT n.source, n.k, n.size FROM near n JOIN walk ON n.source IS NOT DISTINCT FROM walk.source AND n.k = walk.k WHERE NOT took AND n.size > 0 QUALIFY row_number() OVER (PARTITION BY n.source ORDER BY n.size, n.z, n.doc_id) = 1),
taken AS (SELECT source, k FROM walk WHERE took UNION ALL SELECT s.source, s.k FROM spare s JOIN ended e ON s.source IS NOT DISTINCT FROM e.source WHERE s.size < 2 * e.rest),
chosen AS (SELECT n.source, n.z, n.doc_id FROM near n JOIN taken t ON n.source IS NOT DISTINCT FROM t.source AND n.k = t.k),
decided AS (SELECT i.*, CASE WHEN rest <= 0 THEN 0 WHEN i.cut_cell IS NULL THEN 1 WHEN cell <> i.cut_cell THEN (cell < i.cut_cell)::INT WHEN cut_part IS NULL OR part < cut_part THEN 1 WHEN part > cut_part THEN 0 ELSE (ch.z IS NOT NULL)::INT END AS extra
  FROM inside i LEFT JOIN cut2 c ON i.source IS NOT DISTINCT FROM c.source LEFT JOIN chosen ch ON ch.source IS NOT DISTINCT FROM i.source AND ch.z = i.z AND ch.doc_id IS NOT DISTINCT FROM i.doc_id)
SELECT doc_id, size, source_size, target, CAST((whole + extra) * size AS BIGINT) AS taken, CAST(whole + extra AS BIGINT) AS copies FROM decided""",
}
