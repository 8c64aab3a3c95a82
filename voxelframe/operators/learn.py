"""Trained classifiers and splits: one-against-rest linear machines, Gaussian mixtures, folds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def portable_hash(key: Column, seed: int = 0) -> Column:
    """0..2**32-1 from an MD5 of key and seed, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")


def fold(key: Column, k: int, seed: int = 0) -> Column:
    """A fold 0..k-1 from a hash of the row's key, the same in every run."""
    return (portable_hash(key, seed) % k).cast("int")


def split(rows: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key, about ``share`` of the rows in the first."""
    first = portable_hash(F.col(key), seed) < int(share * (1 << 32))
    return rows.where(first), rows.where(~first)


def sample_valid(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows in a random but repeatable order: a top-k over a hash, so nothing is sorted as a whole."""
    return rows.withColumn("_o", portable_hash(F.col(key), seed)).orderBy("_o", key).limit(k).drop("_o")


def svm(train: DataFrame, features: str, label: str, regularisation: float = 0.01):
    """Standardised linear machines, one against the rest; a fitted pipeline whose ``transform`` adds prediction."""
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True)
    rest = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=regularisation), featuresCol="_s", labelCol=label, predictionCol="prediction")
    return Pipeline(stages=[scaled, rest]).fit(train.withColumn("_v", array_to_vector(features)))


def predict(model, rows: DataFrame, features: str) -> DataFrame:
    return model.transform(rows.withColumn("_v", array_to_vector(features))).drop("_v", "_s", "rawPrediction")


#: Least share of a component before it is set anew, and what keeps covariances from collapsing, as a share of the whole's.
LEAST_SHARE, RIDGE = 1e-6, 1e-6


def _packed(model: dict[str, np.ndarray]) -> list[float]:
    """For each component: the logarithm of its density's factor, its mean, and its precision's lower half, doubled off the diagonal."""
    k, d = model["means"].shape
    out = []
    for c in range(k):
        precision = np.linalg.inv(model["covs"][c])
        out.append(math.log(max(model["weights"][c], 1e-300)) - 0.5 * (np.linalg.slogdet(model["covs"][c])[1] + d * math.log(2 * math.pi)))
        out += [*model["means"][c], *(precision[i, j] * (1 if i == j else 2) for i in range(d) for j in range(i + 1))]
    return [float(v) for v in out]


def posterior(rows: DataFrame, x: list[Column], model: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` with _q (the parameters, one row that is broadcast), _r (each component's probability) and _log (of the mixture's density).

    Parameters are data, so every round runs the same compiled code.
    """
    k, d = model["means"].shape
    step = 1 + d + d * (d + 1) // 2
    q = rows.sparkSession.createDataFrame([(_packed(model),)], "_q array<double>")
    logs = []
    for c in range(k):
        at = lambda i, c=c: F.col("_q")[c * step + i]
        away = [v - at(1 + i) for i, v in enumerate(x)]
        halves = [(i, j) for i in range(d) for j in range(i + 1)]
        logs.append(at(0) - 0.5 * sum((away[i] * away[j] * at(1 + d + n) for n, (i, j) in enumerate(halves)), F.lit(0.0)))
    both = rows.crossJoin(F.broadcast(q)).withColumn("_l", F.array(*logs)).withColumn("_top", F.array_max("_l"))
    both = both.withColumn("_e", F.transform("_l", lambda v: F.exp(v - F.col("_top")))).withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, v: a + v))
    return both.withColumn("_r", F.transform("_e", lambda v: v / F.col("_sum"))).withColumn("_log", F.col("_top") + F.log("_sum")).drop("_l", "_top", "_e", "_sum")


def start_mixture(data: DataFrame, x: list[Column], k: int) -> tuple[int, dict[str, np.ndarray], np.ndarray]:
    """The number of rows, k components that lie along the rows' main axis, at its quantiles, and the covariance of all rows."""
    d, pairs = len(x), [(i, j) for i in range(len(x)) for j in range(i + 1)]
    head = data.agg(F.count("*"), *[F.avg(v) for v in x], *[F.covar_pop(x[i], x[j]) for i, j in pairs]).first()
    n, whole = head[0], np.zeros((d, d))
    if not n:
        return 0, {}, whole
    centre = np.array(head[1 : 1 + d], float)
    for (i, j), v in zip(pairs, head[1 + d :], strict=True):
        whole[i, j] = whole[j, i] = v
    size, axes = np.linalg.eigh(whole)
    axis = axes[:, -1]
    along = sum(((v - float(c)) * float(a) for v, c, a in zip(x, centre, axis, strict=True)), F.lit(0.0))
    places = np.array(data.agg(F.percentile_approx(along, [(c + 0.5) / k for c in range(k)], 10_000)).first()[0], float)
    whole = whole + max(RIDGE * np.trace(whole) / d, 1e-300) * np.eye(d)
    near = whole - (1 - 1 / k**2) * size[-1] * np.outer(axis, axis)
    return n, {"weights": np.full(k, 1 / k), "means": centre + places[:, None] * axis, "covs": np.stack([near] * k)}, whole


def fit_mixture(rows: DataFrame, features: str, k: int, d: int, rounds: int = 30, tolerance: float = 1e-6, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray] | None:
    """weights (k), means (k, d), covariances (k, d, d) by expectation maximisation; None without rows.

    Each round is one aggregate of k * (1 + d + d * (d + 1) / 2) sums over the rows; only those come to the driver.
    A component that loses its weight starts anew at the row that the others explain least.
    """
    x = [F.col(f"x{i}") for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    data = rows.where(F.col(features).isNotNull()).select(*[F.col(features)[i].cast("double").alias(f"x{i}") for i in range(d)])
    n, model, whole = start_mixture(data, x, k)
    if not n:
        return None
    model = model if start is None else {name: v.copy() for name, v in start.items()}
    ridge = max(RIDGE * np.trace(whole) / d, 1e-300) * np.eye(d)
    before, step = -math.inf, 1 + d + len(pairs)
    for _ in range(rounds):
        sums = []
        for c in range(k):
            r, away = F.col("_r")[c], [v - F.col("_q")[c * step + 1 + i] for i, v in enumerate(x)]
            sums += [F.sum(r), *[F.sum(r * v) for v in away], *[F.sum(r * away[i] * away[j]) for i, j in pairs]]
        got = posterior(data, x, model).agg(F.sum("_log"), F.min(F.struct("_log", *x)), *sums).first()
        for c in range(k):
            own = np.array(got[2 + c * step : 2 + (c + 1) * step], float)
            if own[0] < LEAST_SHARE * n:
                model["weights"][c], model["means"][c], model["covs"][c] = 1 / k, np.array(got[1][1:], float), whole
                continue
            model["weights"][c], shift = own[0] / n, own[1 : 1 + d] / own[0]
            cov = np.zeros((d, d))
            for (i, j), v in zip(pairs, own[1 + d :], strict=True):
                cov[i, j] = cov[j, i] = v / own[0] - shift[i] * shift[j]
            model["means"][c], model["covs"][c] = model["means"][c] + shift, cov + ridge
        model["weights"] /= model["weights"].sum()
        if abs(got[0] - before) <= tolerance * n:
            break
        before = got[0]
    order = np.lexsort(model["means"].T[::-1])
    return {name: v[order] for name, v in model.items()}


def mixture(rows: DataFrame, features: str, k: int) -> DataFrame:
    """Adds component (1..k by first mean, least first; the lesser on ties) and its probability; null for null features."""
    size = rows.agg(F.max(F.size(features))).first()[0] or 0
    model = fit_mixture(rows, features, k, size) if size > 0 else None
    if model is None:
        return rows.withColumn("component", F.lit(None).cast("int")).withColumn("probability", F.lit(None).cast("double"))
    out = posterior(rows, [F.col(features)[i].cast("double") for i in range(size)], model).withColumn("probability", F.array_max("_r"))
    component = F.when(F.col(features).isNotNull(), F.array_position("_r", F.col("probability")).cast("int"))
    return out.withColumn("component", component).select(*rows.columns, "component", "probability")


def confident(component: Column, probability: Column, least: float) -> Column:
    """The component, or 0 where its probability is under ``least``."""
    return F.when(probability >= least, component).otherwise(0)
