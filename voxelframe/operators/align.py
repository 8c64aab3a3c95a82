"""Alignment along slices: as-of fill, interpolation, outliers, scores, tile offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(series: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Fill missing values from the nearest slice that has one; the earlier on ties.

    Two running passes, one in each direction: both frames only grow. A partition is the slices of one tile.
    """
    tile = Window.partitionBy(*by)
    so_far = lambda c: tile.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("z"), F.col(value).alias("v")))
    out = series.withColumn("_a", F.last(known, True).over(so_far(F.col(order)))).withColumn("_b", F.last(known, True).over(so_far(F.col(order).desc())))
    earlier = F.col("_b").isNull() | (F.col(order) - F.col("_a.z") <= F.col("_b.z") - F.col(order))
    return out.withColumn("filled", F.when(F.col("_a").isNotNull() & earlier, F.col("_a.v")).otherwise(F.col("_b.v"))).drop("_a", "_b")


def interpolate(series: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Linear interpolation of missing values; beyond the ends, on along the line of the two nearest.

    In each direction one running pass finds the nearest known slice and the known one behind it; all four frames only grow.
    """
    known = F.col(value).isNotNull()
    knot = F.when(known, F.struct(F.col(order).cast("double").alias("z"), F.col(value).alias("v")))
    s = series
    for near, behind, c in (("_a", "_a2", F.col(order)), ("_b", "_b2", F.col(order).desc())):
        w = Window.partitionBy(*by).orderBy(c)
        s = s.withColumn("_past", F.last(knot, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        both = F.last(F.when(known, F.struct(knot.alias("near"), F.col("_past").alias("behind"))), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        s = s.withColumn("_both", both).withColumn(near, F.col("_both.near")).withColumn(behind, F.col("_both.behind")).drop("_past", "_both")

    def line(p: str, q: str) -> Column:
        slope = F.try_divide(F.col(f"{q}.v") - F.col(f"{p}.v"), F.col(f"{q}.z") - F.col(f"{p}.z"))
        return F.coalesce(F.col(f"{p}.v") + slope * (F.col(order) - F.col(f"{p}.z")), F.col(f"{p}.v"))

    out = F.when(known, F.col(value)).when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), line("_a", "_b")).when(F.col("_a").isNotNull(), line("_a", "_a2")).otherwise(line("_b", "_b2"))
    return s.withColumn("filled", out).drop("_a", "_b", "_a2", "_b2")


def fill_outliers(series: DataFrame, by: list[str], order: str, value: str, window: int = 10, limit: float = 3.0) -> DataFrame:
    """Adds filled: moving outliers (and missing values) replaced by the line through their neighbours that are none."""
    marked = moving_outliers(series, by, order, value, window, limit)
    kept = marked.withColumn("_kept", F.when(~F.col("outlier"), F.col(value)))
    return interpolate(kept, by, order, "_kept").drop("_kept")


def steady(series: DataFrame, by: list[str], order: str, value: str, limit: float = 3.0) -> DataFrame:
    """Adds steady: a value further than ``limit`` from the median of all accepted earlier ones gives way to the last accepted one.

    What is accepted feeds back into the median, which no window expression can say; a group is one
    tile. The earlier values are kept sorted, so a slice costs a search.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from bisect import insort

        pdf = pdf.sort_values(order)
        sorted_, last, out = [], None, []
        for v in pdf[value].to_numpy(float):
            n = len(sorted_)
            if not np.isnan(v) and (not n or abs(v - (sorted_[(n - 1) // 2] + sorted_[n // 2]) / 2) <= limit):
                insort(sorted_, v)
                last = v
            out.append(np.nan if last is None else last)
        return pdf.assign(steady=out)

    return series.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", steady double")


#: Scale that makes the median absolute deviation a standard deviation for normal values.
MAD_SCALE = 1.4826


def moving_outliers(series: DataFrame, by: list[str], order: str, value: str, window: int = 10, limit: float = 3.0) -> DataFrame:
    """Adds outlier: further than ``limit`` scaled local MADs from the moving median (rows window/2 before, the rest after)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(window // 2), window - window // 2 - 1)
    near = series.withColumn("_all", F.collect_list(value).over(w))

    def mid(a: Column) -> Column:
        s, n = F.sort_array(a), F.size(a)
        return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.ceil((n + 1) / 2).cast("int"))) / 2)

    near = near.withColumn("_mid", mid(F.col("_all")))
    away = F.transform("_all", lambda v: F.abs(v - F.col("_mid")))
    out = near.withColumn("outlier", F.coalesce(F.abs(F.col(value) - F.col("_mid")) > limit * MAD_SCALE * mid(away), F.lit(False)))
    return out.drop("_all", "_mid")


def displacement_outliers(shifts: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    """Shifts further than ``limit`` from the smallest mode of their group take the mode; missing ones too."""
    modes = shifts.groupBy(*by).agg(F.mode(value, True).alias("_mode"))
    far = F.col(value).isNull() | (F.abs(F.col(value) - F.col("_mode")) > limit)
    return shifts.join(modes, by).withColumn("adjusted", F.when(far, F.col("_mode")).otherwise(F.col(value))).drop("_mode")


def best_position(scores: DataFrame, by: list[str], slice_: str, position: str, score: str) -> DataFrame:
    """The position with the greatest sum of winning scores: every slice votes for its best; the smallest position wins ties."""
    top = scores.groupBy(*by, slice_).agg(F.max(F.struct(F.col(score), (-F.col(position)).alias("p"))).alias("t")).select(*by, (-F.col("t.p")).alias(position), F.col(f"t.{score}").alias(score))
    total = top.groupBy(*by, position).agg(F.sum(score).alias("total"))
    return total.groupBy(*by).agg(F.max(F.struct("total", (-F.col(position)).alias("p"))).alias("t")).select(*by, (-F.col("t.p")).alias(position), F.col("t.total").alias("total"))


def top_peaks(values: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The ``k`` greatest values of each group with their rank, ties by ``tie``; Spark keeps k rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), tie)
    return values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def chunk_ranges(first: int, last: int, size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(chunk, start, end, kept from, kept to is the next start) that cover first..last with overlaps between chunks."""
    out, at, k = [], first, 1
    while True:
        end = min(at + size - 1, last)
        out.append((k, at, end, at if k == 1 else at + overlap // 2))
        if end >= last:
            return out
        at, k = end - overlap + 1, k + 1


def chunks(items: DataFrame, order: str, size: int, overlap: int) -> DataFrame:
    """Rows with the chunks they are in: a slice in an overlap goes to both."""
    step = size - overlap
    span = items.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    j = items.crossJoin(F.broadcast(span))
    at = F.col(order) - F.col("_lo")
    last = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1 - overlap) / step), F.lit(1)) - 1
    lo = F.greatest(F.ceil((at - size + 1) / step), F.lit(0))
    hi = F.least(F.floor(at / step), last)
    return j.withColumn("chunk", F.explode(F.sequence(lo, hi))).withColumn("chunk", (F.col("chunk") + 1).cast("int")).drop("_lo", "_hi")


def tile_offsets(edges: DataFrame) -> DataFrame:
    """Global z offset of each tile from a maximum spanning tree of its sample's tile graph.

    ``edges``: sample_id, a, b (tile numbers), shift (z of b minus z of a), weight. A
    sample has a hundred tiles at most; each is one group. Offsets are shifted so that the greatest is 1.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["weight", "a", "b"], ascending=[False, True, True])
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        tree: dict[int, list[tuple[int, float]]] = {}
        for a, b, s in zip(rows.a, rows.b, rows["shift"], strict=True):
            if find(a) != find(b):
                up[find(a)] = find(b)
                tree.setdefault(a, []).append((b, s))
                tree.setdefault(b, []).append((a, -s))
        z: dict[int, float] = {}
        for root in sorted(tree):
            if root in z:
                continue
            z[root], queue = 0.0, [root]
            while queue:
                x = queue.pop()
                for y, s in tree[x]:
                    if y not in z:
                        z[y] = z[x] + s
                        queue.append(y)
        top = max(z.values(), default=0.0)
        return pd.DataFrame({"sample_id": pdf.sample_id.iloc[0], "tile": list(z), "dz": [v - top + 1 for v in z.values()]})

    return edges.groupBy("sample_id").applyInPandas(solve, "sample_id string, tile int, dz double")


def follow(series: DataFrame, by: list[str], order: str, value: str, limit: float = 3.0) -> DataFrame:
    """Running translation: a slice that jumps more than ``limit`` from the one before keeps that one's value.

    State runs from slice to slice, which no window expression can say; a group is one tile.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        last, out = None, []
        for v in pdf[value]:
            if last is None or (not np.isnan(v) and abs(v - last) <= limit):
                last = v if not np.isnan(v) else last
            out.append(np.nan if last is None else last)
        return pdf.assign(followed=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", followed double"
    return series.groupBy(*by).applyInPandas(run, schema)


def gain_chain(ratios: Iterator[float]) -> list[float]:
    """Gains of tiles along a row from the ratios between neighbours, scaled to a mean of 1."""
    gains = [1.0]
    for r in ratios:
        gains.append(gains[-1] * r)
    mean = sum(gains) / len(gains)
    return [g / mean for g in gains]
