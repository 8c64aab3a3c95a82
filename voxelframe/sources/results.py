"""Result fields of samples: one partition for each sample and field, replaced as a whole, read back by name; steps that skip what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_field(rows: DataFrame, base: str, sample: str, field: str) -> None:
    """Write one field of one sample; what it had goes, other fields and samples stay, and a rerun leaves the same."""
    rows.write.mode("overwrite").parquet(f"{base.rstrip('/')}/field={field}/sample_id={sample}")


def load_field(spark: SparkSession, base: str, field: str, samples: list[str] | None = None) -> DataFrame:
    """A field of all samples, or of those named; ``sample_id`` comes from the folders, so other samples aren't read.

    ``field`` may go on into nested columns with dots (``stats.volume.left``): the last part gives the column's name.
    """
    name, *inner = field.split(".")
    out = spark.read.option("basePath", f"{base.rstrip('/')}/field={name}").parquet(f"{base.rstrip('/')}/field={name}")
    out = out.withColumn("sample_id", F.col("sample_id").cast("string"))
    if samples is not None:
        out = out.where(F.col("sample_id").isin(samples))
    return out.select("sample_id", F.col(".".join(inner)).alias(inner[-1])) if inner else out


def fields(spark: SparkSession, base: str) -> DataFrame:
    """sample_id, field: what is there, from the folders' names."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(base).select("path")
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1)
    return found.select(part("sample_id").alias("sample_id"), part("field").alias("field")).distinct()


def final(preferred: DataFrame, otherwise: DataFrame) -> DataFrame:
    """Rows of ``preferred``, and of ``otherwise`` for samples that the preferred source lacks; columns that one lacks are null."""
    rest = otherwise.join(preferred.select("sample_id").distinct(), "sample_id", "left_anti")
    return preferred.unionByName(rest, allowMissingColumns=True)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], flag: str = "true") -> DataFrame:
    """What a step has to do: with "true" the wanted rows that aren't done, with "update" all, with "false" none."""
    if flag not in ("true", "update", "false"):
        raise ValueError(f"a step's flag is true, update or false: {flag!r}")
    if flag == "update":
        return wanted
    return wanted.where(F.lit(False)) if flag == "false" else wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def run_step(spark: SparkSession, base: str, field: str, samples: list[str], make, flag: str = "true") -> list[str]:
    """Call ``make(sample)`` for the samples that need it and save what it gives; the samples that were made."""
    wanted = spark.createDataFrame([(s,) for s in samples], "sample_id string")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    there = path.getFileSystem(conf).exists(path)
    done = fields(spark, base).where(F.col("field") == field) if there else wanted.where(F.lit(False))
    todo = {r[0] for r in pending(wanted, done, ["sample_id"], flag).collect()}  # as many as samples
    made = [s for s in samples if s in todo]
    for s in made:
        save_field(make(s), base, s, field)
    return made


def required(condition: Column, message: Column) -> Column:
    """Null where the condition holds; the row's message as an error where it doesn't (null counts as not)."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(None)).otherwise(F.raise_error(message))


def grouped(samples: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Adds grp; a sample that is in none of the groups, or in two, is an error when its row is read."""
    listed = F.array_compact(F.array(*[F.when(F.col("sample_id").isin(members), F.lit(g)) for g, members in groups.items()]))
    out = samples.withColumn("_g", listed)
    broken = required(F.size("_g") == 1, F.concat(F.lit("not in exactly one group: "), F.coalesce("sample_id", F.lit("null"))))
    return out.withColumn("grp", F.coalesce(broken.cast("string"), F.col("_g")[0])).drop("_g")


def per_marker(config: dict, names: list[str], markers: list[str], defaults: dict | None = None) -> dict:
    """The configuration with a value for each marker under each of ``names``: scalars are repeated, absent ones take the default; a list of another length is an error."""
    out = dict(config)
    for name in names:
        value = out.get(name, (defaults or {}).get(name))
        if not isinstance(value, list):
            out[name] = [value] * len(markers)
        elif len(value) == 1:
            out[name] = value * len(markers)
        elif len(value) != len(markers):
            raise ValueError(f"{name} has {len(value)} values for {len(markers)} markers")
    return out
