"""Tables in text formats: structure templates, detections, parameter files, landmarks; sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRUCTURE = "index int, id bigint, atlas_id int, parent_structure_id bigint, depth int, structure_id_path string, color_hex_triplet string, name string, acronym string"
CENTROIDS = "y int, x int, z int, annotation int"
LANDMARKS = "name string, enabled boolean, mov_1 double, mov_2 double, mov_3 double, ref_1 double, ref_2 double, ref_3 double"


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """A structure template: any order of columns, byte-order mark and blank rows tolerated."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[re.sub(r"^﻿", "", c).strip().strip('"') for c in raw.columns])
    if missing := {"index", "name", "acronym"} - set(raw.columns):
        raise ValueError(f"structure table lacks {sorted(missing)}")
    kinds = {k: v for k, v in (x.split(" ") for x in STRUCTURE.split(", "))}
    own = [F.col(c).try_cast(kinds[c]).alias(c) if c in raw.columns else (F.col("index").try_cast("bigint").alias("id") if c == "id" else F.lit(None).cast(kinds[c]).alias(c)) for c in kinds]
    return raw.select(*own).where("index IS NOT NULL")


def read_centroids(spark: SparkSession, path: str, extra: int = 0) -> DataFrame:
    """Detections without a header: y, x, z, annotation and ``extra`` intensities."""
    return spark.read.csv(path, schema=CENTROIDS + "".join(f", intensity_{k} double" for k in range(1, extra + 1)))


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=LANDMARKS).where("name IS NOT NULL")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """file, key, values of registration parameter files: lines ``(Key value ...)``, ``//`` comments."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"//.*$", "").alias("line"))
    found = lines.select("file", F.regexp_extract("line", r"^\s*\(\s*(\S+)\s+(.*?)\s*\)\s*$", 1).alias("key"), F.regexp_extract("line", r"^\s*\(\s*(\S+)\s+(.*?)\s*\)\s*$", 2).alias("rest"))
    return found.where("key <> ''").select("file", "key", F.transform(F.regexp_extract_all("rest", F.lit(r'"[^"]*"|\S+'), F.lit(0)), lambda v: F.regexp_replace(v, '^"|"$', "")).alias("values"))


def parameters_text(values: dict[str, list]) -> str:
    """A registration parameter file: a line for each key; words and true or false are quoted, numbers aren't."""
    shown = lambda v: f'"{str(v).lower()}"' if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else f'"{v}"'
    return "".join(f"({k} {' '.join(map(shown, v if isinstance(v, (list, tuple)) else [v]))})\n" for k, v in values.items())


def points_text(points: list[tuple[float, ...]], index: bool = False) -> str:
    """A points file: whether they are indices or positions, their number, then one a line."""
    return f"{'index' if index else 'point'}\n{len(points)}\n" + "".join(" ".join(map(repr, p)) + "\n" for p in points)


def read_transformed_points(spark: SparkSession, path: str) -> DataFrame:
    """file, point, and the arrays input, output and deformation of a transformed-points file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").startswith("Point"))
    numbers = lambda name: F.transform(F.split(F.trim(F.regexp_extract("value", rf"{name} = \[([^\]]*)\]", 1)), r"\s+"), lambda v: v.try_cast("double"))
    return lines.select("file", F.regexp_extract("value", r"^Point\s+(\d+)", 1).cast("bigint").alias("point"), numbers("InputPoint").alias("input"), numbers("OutputPoint").alias("output"), numbers("Deformation").alias("deformation"))


def append_partition(df: DataFrame, path: str, by: str) -> None:
    """Write one partition's rows over what it had: a rerun doesn't double them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_new(df: DataFrame, path: str) -> str:
    """Write CSV under a name that isn't taken: path, path_1, path_2, ..."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    k, target = 0, path
    while True:
        p = jvm.org.apache.hadoop.fs.Path(target)
        if not p.getFileSystem(conf).exists(p):
            break
        k += 1
        target = f"{path}_{k}"
    df.write.csv(target, header=True)
    return target


def read_yaml(text: str) -> object:
    """The block and flow subset of YAML that configuration files use: maps, lists, scalars, comments."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", y).rstrip() for y in text.splitlines()) if x.strip() and x.strip() not in ("---", "...")]

    def scalar(s: str) -> object:
        s = s.strip()
        if s[:1] == "[" and s[-1:] == "]":
            return [scalar(x) for x in split(s[1:-1])]
        if s[:1] == "{" and s[-1:] == "}":
            return {k.strip(): scalar(v) for k, v in (x.split(":", 1) for x in split(s[1:-1]))}
        if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
            return s[1:-1]
        if s.lower() in ("true", "yes", "on", "false", "no", "off"):
            return s.lower() in ("true", "yes", "on")
        if s in ("", "~", "null"):
            return None
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                continue
        return s

    def split(s: str) -> list[str]:
        out, depth, now = [], 0, ""
        for c in s:
            depth += (c in "[{") - (c in "]}")
            if c == "," and not depth:
                out.append(now)
                now = ""
            else:
                now += c
        return [*out, now] if now.strip() else out

    def block(at: int, indent: int) -> tuple[object, int]:
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out: list = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1][:1] == "-":
                rest = lines[at][1][1:].strip()
                if not rest:
                    value, at = block(at + 1, lines[at + 1][0])
                elif re.match(r"[^\[{'\"]*?:(\s|$)", rest):
                    lines[at] = (indent + 2, rest)
                    value, at = block(at, indent + 2)
                else:
                    value, at = scalar(rest), at + 1
                out.append(value)
            return out, at
        got: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            key, _, rest = lines[at][1].partition(":")
            if rest.strip() or at + 1 >= len(lines) or lines[at + 1][0] < indent or (lines[at + 1][0] == indent and lines[at + 1][1][:1] != "-"):
                got[key.strip().strip("'\"")], at = scalar(rest), at + 1
            else:
                got[key.strip().strip("'\"")], at = block(at + 1, lines[at + 1][0])
        return got, at

    if not lines:
        return None
    if len(lines) == 1 and not re.match(r"[^\[{]*:(\s|$)", lines[0][1]) and lines[0][1][:1] != "-":
        return scalar(lines[0][1])
    return block(0, lines[0][0])[0]
