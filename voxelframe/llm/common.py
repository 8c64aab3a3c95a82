"""Helpers that the corpus operators share: shared working tables, hot-key joins, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of the contracts: the six ASCII characters and nothing else.
SPACES = r"[\x20\x09-\x0D]+"
#: The runs of SPACES that aren't one space already; text has few of these.
ODD_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

_own_dir: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, local mode takes a temporary folder, as it has one machine;
    on a cluster that would be another disk on each executor, so there it is an error.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="voxelframe-"))
        shared = _own_dir[0]
    return f"{shared.rstrip('/')}/voxelframe-{spark.sparkContext.applicationId}"


_registered: set[str] = set()


#: Lists that note the working tables made while they are open.
_notes: list[list[str]] = []


def _path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, which goes when the driver exits."""
    top = work_dir(spark)
    if top not in _registered:
        _registered.add(top)
        atexit.register(_remove, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    for made in _notes:
        made.append(path)
    return path


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the working tables that are made within."""
    made: list[str] = []
    _notes.append(made)
    try:
        yield made
    finally:
        _notes.remove(made)


def discard(spark: SparkSession, paths: list[str], *still: DataFrame) -> None:
    """Delete working tables that nothing reads any more; those that ``still`` read stay."""
    read = {f.rsplit("/", 1)[0].split(":", 1)[-1].replace("//", "/") for df in still for f in df.inputFiles()}
    for path in paths:
        plain = path.split(":", 1)[-1].replace("//", "/").replace("//", "/")
        if not any(x.endswith(plain) or plain.endswith(x) for x in read):
            _remove(spark, path)


def save(df: DataFrame, name: str, page: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again; ``page``: bytes of a page, within which values are compressed together.

    This cuts the lineage: what follows never recomputes ``df``, and a lost executor
    takes nothing with it.
    """
    spark = df.sparkSession
    path = _path(spark, name)
    how = {"compression": "zstd"} | ({"parquet.page.size": str(page)} if page else {})
    df.write.options(**how).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxelframe_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        return


def release(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_voxelframe_path", None):
            _remove(t.sparkSession, path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


#: A key that holds over 1/HOT_SHARE of the rows is hot; there are fewer than HOT_SHARE of those.
HOT_SHARE = 500


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join where a few keys hold much of ``left``.

    ``right`` has one row per key and a column ``weight``: how many rows of ``left`` have
    the key; ``total`` is their sum. Keys with more than total / HOT_SHARE rows are fewer
    than HOT_SHARE, so that part of ``right`` is broadcast; rows of these keys are dealt by
    a hash of the whole row (a task that runs again deals alike), all others by the key. Null
    keys match null keys. No row is moved twice.
    """
    values = [c for c in right.columns if c not in keys]
    least = max(1, total // HOT_SHARE)

    def same(a: DataFrame, b: DataFrame, names: list[tuple[str, str]]) -> Column:
        cond = F.lit(True)
        for x, y in names:
            cond = cond & a[x].eqNullSafe(b[y])
        return cond

    hot = right.where(F.col(weight) > least).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(*values).alias("_hot"))
    cold = right.where(F.col(weight) <= least).select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.struct(*values).alias("_cold"), F.lit(-1).alias("_c_salt"))
    a = left.join(F.broadcast(hot), same(left, hot, [(k, f"_h_{k}") for k in keys]), "left")
    a = a.drop(*[f"_h_{k}" for k in keys]).withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(2147483647)).cast("int")))
    b = a.join(cold, same(a, cold, [("_salt", "_c_salt")] + [(k, f"_c_{k}") for k in keys]), "left")
    picked = F.coalesce(F.col("_hot"), F.col("_cold"))
    return b.select(*left.columns, *[picked[v].alias(v) for v in values])


#: A row's place in a ``Numbered`` table: its part, and its number there.
PART, AT = "__vf_part", "__vf_at"
#: Rows of a part at most, and of the smaller runs in which a row's result is looked up; Spark's bound on buckets.
PART_BITS, RUN, MOST_BUCKETS = 16, 1024, 100_000


class Numbered:
    """A table written once with numbered rows, so that results for rows join them where they lie.

    ``rows`` is bucketed by the part of the input that a row came from. Each task writes
    its parts to files of their own, nothing is moved for that; later, small results for rows are
    gathered by part and meet the bucket in which the part is. Texts are never shuffled to attach
    a few numbers to them, whatever the sizes.
    """

    def __init__(self, docs: DataFrame, name: str):
        spark = docs.sparkSession
        buckets = max(1, min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        table, self._own = f"voxelframe_{name}_{uuid.uuid4().hex}", docs.columns
        numbered = docs.withColumn(AT, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(AT, PART_BITS)).withColumn(AT, F.col(AT).bitwiseAND((1 << PART_BITS) - 1).cast("int"))
        numbered.write.format("parquet").option("compression", "zstd").option("path", _path(spark, name)).bucketBy(buckets, PART).saveAsTable(table)
        atexit.register(_drop, spark, table)
        self.rows = spark.table(table)

    def beside(self, found: DataFrame, value: str) -> DataFrame:
        """All rows, with the column ``value`` of ``found`` (PART, AT, value; a row each at most) or null.

        The lookup goes through the runs of a part, then through the rows of a run that have a value.
        """
        run = F.floor(F.col(AT) / RUN).cast("int")
        near = found.groupBy(PART, run.alias("_run")).agg(F.map_from_entries(F.collect_list(F.struct(AT, value))).alias("_near"))
        parts = near.groupBy(PART).agg(F.map_from_entries(F.collect_list(F.struct("_run", "_near"))).alias("__vf_found"))
        both = self.rows.join(parts.hint("shuffle_hash"), PART, "left")
        return both.withColumn(value, F.try_element_at(F.try_element_at(F.col("__vf_found"), run), F.col(AT))).drop("__vf_found")

    def bare(self, rows: DataFrame) -> DataFrame:
        """Without the places, in the order of the table's own columns."""
        return rows.select(*[F.col(f"`{c}`") for c in self._own])


def _drop(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session may have ended already
        return
