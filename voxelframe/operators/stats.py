"""Two-group statistics: t-tests, filters, false-discovery rate, percentiles, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import divide, student_t_p


def moments(values: DataFrame, by: list[str], groups: tuple[str, str], value: str = "value", group: str = "grp") -> DataFrame:
    """n, mean and sample variance of each of two groups in one pass: n_1, mean_1, var_1, n_2, ..."""
    aggs = []
    for k, g in enumerate(groups, 1):
        v = F.when(F.col(group) == g, F.col(value).cast("double"))
        aggs += [F.count(v).alias(f"n_{k}"), F.avg(v).alias(f"mean_{k}"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias(f"var_{k}")]
    return values.groupBy(*by).agg(*aggs)


def welch(m: DataFrame) -> DataFrame:
    """t and Satterthwaite df of unequal variances."""
    a, b = F.col("var_1") / F.col("n_1"), F.col("var_2") / F.col("n_2")
    t = divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(a + b))
    df = divide((a + b) * (a + b), a * a / (F.col("n_1") - 1) + b * b / (F.col("n_2") - 1))
    return m.withColumn("t", t).withColumn("df", F.when(F.isnan(df), F.lit(1.0)).otherwise(df))


def pooled(m: DataFrame) -> DataFrame:
    """t and df of a common variance."""
    n1, n2 = F.col("n_1"), F.col("n_2")
    s2 = ((n1 - 1) * F.col("var_1") + (n2 - 1) * F.col("var_2")) / (n1 + n2 - 2)
    return m.withColumn("t", divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(s2 * (1 / n1 + 1 / n2)))).withColumn("df", (n1 + n2 - 2).cast("double"))


def paired(values: DataFrame, by: list[str], pair: str, groups: tuple[str, str], value: str = "value", group: str = "grp") -> DataFrame:
    """t and df of the differences within pairs that have exactly one value of each group."""
    one = lambda g: F.when(F.col(group) == g, F.col(value).cast("double"))
    both = values.groupBy(*by, pair).agg(F.max(one(groups[0])).alias("a"), F.max(one(groups[1])).alias("b"), F.count("*").alias("k")).where("k = 2 AND a IS NOT NULL AND b IS NOT NULL")
    d = F.col("a") - F.col("b")
    m = both.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg(d).alias("mean_diff"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd_diff"))
    return m.withColumn("t", divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt("n_pairs"))).withColumn("df", (F.col("n_pairs") - 1).cast("double"))


def p_value(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p", student_t_p(F.col("t"), F.col("df")))


def percent_change(a: Column, b: Column) -> Column:
    return 100 * divide(b - a, a)


def testable_table(m: DataFrame, least: Column | float) -> Column:
    """Table rule: the larger mean is above the least; NaN counts as absent."""
    a, b = F.col("mean_1"), F.col("mean_2")
    return F.greatest(F.nanvl(a, b), F.nanvl(b, a)) > least


def testable_voxel(least: float) -> Column:
    """Voxel rule: both means are above the least."""
    return (F.col("mean_1") > least) & (F.col("mean_2") > least)


def fdr(tests: DataFrame, family: list[str], p: str, order: list[str], method: str = "bh") -> DataFrame:
    """Adds q: step-up adjusted p of each family. ``by`` multiplies by the harmonic number and isn't capped.

    A family is the set of structures or voxels of one metric and class: it is as large as the
    ontology or the voxel grid, never as the number of detected points. Its window has one
    partition per family, after aggregation.
    """
    rank = F.row_number().over(Window.partitionBy(*family).orderBy(p, *order)).cast("double")
    m = F.count(F.lit(1)).over(Window.partitionBy(*family)).cast("double")
    factor = m * (F.aggregate(F.sequence(F.lit(1.0).cast("int"), m.cast("int")), F.lit(0.0), lambda s, i: s + 1 / i) if method == "by" else F.lit(1.0))
    raw = tests.withColumn("_raw", factor * F.col(p) / rank)
    back = Window.partitionBy(*family).orderBy(F.col(p).desc(), *[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.min("_raw").over(back)).drop("_raw")


def significance(q: Column, level: float = 0.05) -> Column:
    """0 to 5: one for passing the step-up test, one for each of q < .05, .01, .001, .0001."""
    stars = sum((F.coalesce((q < x).cast("int"), F.lit(0)) for x in (0.05, 0.01, 0.001, 0.0001)), F.coalesce((q <= level).cast("int"), F.lit(0)))
    return stars


def neg_log10(p: Column, floor: float | None = None) -> Column:
    out = F.when(p > 0, -F.log10(p))
    return F.greatest(out, F.lit(floor)) if floor is not None else out


def normalised(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds value / mean of its group."""
    return values.withColumn("normalised", divide(F.col(value), F.avg(value).over(Window.partitionBy(*by))))


#: The sketch that brackets a percentile errs by n / SKETCH ranks, the bracket spans MARGIN such errors on each side; up to FEW values it spans all.
SKETCH, MARGIN, FEW = 10_000, 3, 30_000


def rank_percentile(values: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """Percentile where the i-th of n sorted values stands at 100 (i - 0.5) / n, linear between, clamped.

    A mergeable sketch brackets the percentile; values below the bracket are only counted, so a group's window has the
    distinct values inside it, some thousandth of the group's rows (or FEW), whatever their distribution.
    """
    v, share, margin = F.col(value).cast("double"), p / 100, MARGIN / SKETCH
    known = values.where(F.col(value).isNotNull())
    ends = F.percentile_approx(v, [max(share - margin, 0.0), min(share + margin, 1.0)], SKETCH)
    few = F.count("*") <= FEW
    low = F.min(v) if share <= margin else F.when(few, F.min(v)).otherwise(ends[0])
    high = F.max(v) if share + margin >= 1 else F.when(few, F.max(v)).otherwise(ends[1])
    span = known.groupBy(*by).agg(F.count("*").alias("_n"), low.alias("_low"), high.alias("_high"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = known.select(*by, v.alias("_v")).alias("a").join(span.alias("b"), same).where("_v <= _high").select(*[F.col(f"a.{c}").alias(c) for c in by], "_v", "_n", "_low")
    counted = joined.groupBy(*by, "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("c"))
    run = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())))
    pos = F.least(F.greatest(F.col("_n") * p / 100 + 0.5, F.lit(1.0)), F.col("_n").cast("double"))
    lo, hi = F.floor(pos), F.ceil(pos)
    has = lambda r: (F.col("upto") - F.col("c") < r) & (F.col("upto") >= r)
    picked = run.select(*by, pos.alias("pos"), F.when(has(lo), F.col("_v")).alias("lo"), F.when(has(hi), F.col("_v")).alias("hi"))
    out = picked.groupBy(*by).agg(F.max("pos").alias("pos"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select(*by, (F.col("lo") + (F.col("pos") - F.floor("pos")) * (F.col("hi") - F.col("lo"))).alias("percentile"))


def median_mad(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, median absolute deviation (unscaled), smallest mode, mean and sample deviation.

    Medians by bracketed ranks, the mode by counts of values: no task holds a group's values.
    """
    known = values.where(F.col(value).isNotNull()).select(*by, value)
    first = known.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    modes = known.groupBy(*by, value).agg(F.count("*").alias("_c")).groupBy(*by).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col(value).alias("v")))["v"].alias("mode"))
    medians = rank_percentile(known, by, value, 50.0).withColumnRenamed("percentile", "median")
    away = known.join(medians, by).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return first.join(modes, by).join(medians, by).join(rank_percentile(away, by, "_d", 50.0).withColumnRenamed("percentile", "mad"), by).select(*by, "median", "mode", "mean", "sd", "mad")


def corr_nonzero(a: Column, b: Column) -> Column:
    """Pearson correlation over pairs in which neither is 0."""
    both = (a != 0) & (b != 0)
    return F.corr(F.when(both, a), F.when(both, b))


def minmax(values: DataFrame, by: list[str], value: str, method: str = "range") -> DataFrame:
    """Adds normalised: by range, max or sum of the group; constant groups give 0."""
    w = Window.partitionBy(*by)
    v, least = F.col(value), F.min(value).over(w)
    top = {"range": F.max(value).over(w) - least, "max": F.max(value).over(w), "sum": F.sum(value).over(w)}[method]
    shifted = v - least if method == "range" else v
    return values.withColumn("normalised", F.when(top == 0, 0.0).otherwise(shifted / top))


def gauss_fit(points: DataFrame, by: list[str], x: str, y: str, part: float = 0.2) -> DataFrame:
    """sigma, mu, height of a Gaussian: a parabola fitted to log y where y exceeds ``part`` of the maximum."""
    high = points.withColumn("_m", F.max(y).over(Window.partitionBy(*by))).where(F.col(y) > part * F.col("_m"))
    u, v = F.col(x).cast("double"), F.log(y)
    s = high.groupBy(*by).agg(F.count("*").cast("double").alias("s0"), *[F.sum(u**k).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(v * u**k).alias(f"r{k}") for k in (0, 1, 2)])
    s0, s1, s2, s3, s4, r0, r1, r2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "r0", "r1", "r2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    a = (s0 * (s2 * r2 - s3 * r1) - s1 * (s1 * r2 - s2 * r1) + r0 * (s1 * s3 - s2 * s2)) / det
    b = (s0 * (r1 * s4 - s3 * r2) - r0 * (s1 * s4 - s2 * s3) + s2 * (s1 * r2 - r1 * s2)) / det
    c = (r0 * (s2 * s4 - s3 * s3) - s1 * (r1 * s4 - s3 * r2) + s2 * (r1 * s3 - s2 * r2)) / det
    fit = s.where(det != 0).select(*by, a.alias("a"), b.alias("b"), c.alias("c")).where("a < 0")
    return fit.select(*by, F.sqrt(-1 / (2 * F.col("a"))).alias("sigma"), (-F.col("b") / (2 * F.col("a"))).alias("mu"), F.exp(F.col("c") - F.col("b") * F.col("b") / (4 * F.col("a"))).alias("height"))
