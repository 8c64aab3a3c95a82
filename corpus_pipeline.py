"""The corpus pipeline: documents in, training-order token sequences out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of ``documents``.

Defined results of every stage: an empty table gives an empty one; each row is judged by its own text, a null
text as the empty one; rows that repeat are judged each, ties go by doc_id; columns besides doc_id, text and source,
whatever their names, are carried along and never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm import decontaminate, mixing, near_dedup, quality, training_order
from voxelframe.llm.common import discard, noted, save


#: Working tables of the stages before, by application.
_working: dict[str, list[str]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the working tables of the one before, whose result is written when this one begins."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        discard(spark, _working.pop(app, []), docs)
        with noted() as made:
            out = f(spark, docs, sf_dir)
        _working[app] = made
        return out

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under the cut go. Learned on this stage's own documents.

    Without positive labels every score is 0.5, under the cut; null doc_ids are judged and never learned from.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the least doc_id stays, with all rows that have this doc_id.

    Texts without words stay, as do rows with a null doc_id.
    """
    return near_dedup.keep(docs)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go; others stay as they are.

    Texts without words stay; an empty benchmark takes nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, are repeated or go, so that sources meet their target weights.

    A null source is a source of its own; texts without words are taken as whole copies only.
    """
    return mixing.mix(docs)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token records in training order, written as shards. Null and empty texts are one end mark."""
    return training_order.written(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The classifier and the tokens can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
