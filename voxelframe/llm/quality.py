"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1; unlabelled rows are any texts of the table. A small
network on measures of style (a histogram of bytes, repetition, line and word lengths) plus a
mean of hashed word weights is fitted in numpy on
    prior * R_p+ + max(0, R_u- - prior * R_p-)
with the logistic loss. The class prior is estimated from the scores of all documents (a histogram) and of positives by a
first classifier that tells positives from unlabelled rows: the least ratio of the two
distribution functions in the tail. Labelled rows, zeros included, then only set the
scale on which 0.7 is a cut (Platt).

Bounds: at most POSITIVES, UNLABELLED and CALIBRATION rows are fitted, those with the
smallest hashes of doc_id (some 24 KB each at most, whatever their texts); every text is read and scored whole.

Defined results: null and empty texts are scored as texts of no words; a null doc_id is never
learned from and not held out; with no positives every score is 0.5; repeated rows
are scored each; an empty table gives no rows; other columns are ignored, or passed by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import marks, pick, platt, remainder, sigmoid

POSITIVES, UNLABELLED, CALIBRATION = 4000, 4000, 4000
BUCKETS, HIDDEN, CUT = 1 << 12, 24, 0.7
#: Cells of the histogram of all documents' logits, between -REACH and REACH.
CELLS, REACH = 4096, 32.0
MOD, HELD_OUT = 4, 2
PRINTABLE = np.arange(33, 127)
SYMBOLS = np.array([b for b in PRINTABLE if not chr(b).isalnum()])


def style(text: bytes, words: list[bytes]) -> np.ndarray:
    """Measures of a whole text, each of the order of 1."""
    n, m = max(1, len(text)), max(1, len(words))
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    lines = text.split(b"\n")
    distinct = set(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    upper, lower, digit = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    letters = max(upper + lower, 1e-6)
    own = np.array([
        np.log1p(len(words)), np.log1p(len(text)) / 3, (n - m) / m / 6, upper, lower, digit, upper / letters, h[128:].sum(), h[SYMBOLS].sum(), h[10] * 50, h[32], h[9],
        len(distinct) / m, np.log1p(len(distinct)) - np.log1p(len(words)), again, len(set(lines)) / len(lines), np.log1p(m / len(lines)), max(map(len, words), default=0) / 40,
        np.log1p(h[SYMBOLS].sum() * n / m),
    ])
    return np.concatenate([own, np.sqrt(h[SYMBOLS])]).astype(np.float32)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    text = text or b""
    words = text.split()
    ids = np.fromiter((crc32(w) & (BUCKETS - 1) for w in words), np.int32, len(words))
    return style(text, words), ids


class Net:
    """A layer of tanh units on the measures plus a mean of hashed word weights."""

    def __init__(self, size: int, seed: int):
        r = np.random.default_rng(seed)
        self.p = {"w1": r.normal(0, size**-0.5, (size, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": r.normal(0, HIDDEN**-0.5, HIDDEN), "lin": np.zeros(size), "words": np.zeros(BUCKETS), "b": np.zeros(1)}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p["w1"] + self.p["b1"])
        return h @ self.p["w2"] + x @ self.p["lin"] + bags @ self.p["words"] + self.p["b"], h

    def gradients(self, x: np.ndarray, bags: np.ndarray, h: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives by the parameters from ``d``, those by each row's logit."""
        back = (d[:, None] * self.p["w2"]) * (1 - h * h)
        return {"w1": x.T @ back, "b1": back.sum(0), "w2": h.T @ d, "lin": x.T @ d, "words": bags.T @ d, "b": d.sum(keepdims=True)}

    def step(self, x: np.ndarray, bags: np.ndarray, h: np.ndarray, d: np.ndarray, rate: float, decay: float) -> None:
        """One Adam step along ``d``, the derivative of the risk by each row's logit."""
        self.t += 1
        for k, g in self.gradients(x, bags, h, d).items():
            g = g + decay * (10 if k == "words" else 1) * self.p[k] * (k not in ("b", "b1"))
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = self.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class Bags:
    """Shares of hashed words of many texts, kept sparse; ``bags[rows]`` is dense."""

    def __init__(self, keys: pa.ChunkedArray, counts: pa.ChunkedArray):
        sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.keys, n = pc.list_flatten(keys).to_numpy(), pc.list_flatten(counts).to_numpy().astype(np.float32)
        whole = np.add.reduceat(np.append(n, 0), self.ends[:-1]) * (sizes > 0) if len(sizes) else np.zeros(0, np.float32)
        self.values = n / np.repeat(np.maximum(whole, 1), sizes).astype(np.float32)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            part = slice(self.ends[r], self.ends[r + 1])
            out[i, self.keys[part]] = self.values[part]
        return out


class Rows:
    """Some texts' measures and words, taken a batch at a time."""

    def __init__(self, x: np.ndarray, bags: Bags, which: np.ndarray):
        self.x, self.bags, self.which = x, bags, which

    def __len__(self) -> int:
        return len(self.which)

    def batch(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.x[self.which[k]], self.bags[self.which[k]]

    def logits(self, net: Net) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(net.forward(*self.batch(k))[0] for k in np.array_split(np.arange(len(self)), len(self) // 512 + 1))])


def plain_slope(g: np.ndarray, n: int) -> np.ndarray:
    """Derivative of the mean logistic losses of ``n`` positives and of the others as negatives, by each logit."""
    s = sigmoid(g)
    return np.concatenate([(s[:n] - 1) / n, s[n:] / (len(g) - n)]) / 2


def risk_slope(g: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Derivative of prior * R_p+ + R_u- - prior * R_p- by each logit, the first ``n`` those of positives.

    Where R_u- - prior * R_p- is negative, the negative part is fitted too well: the step goes back up along it alone.
    """
    s, m = sigmoid(g), len(g) - n
    negative = np.logaddexp(0, g[n:]).mean() - prior * np.logaddexp(0, g[:n]).mean()
    if negative >= 0:
        return np.concatenate([prior * (s[:n] - 1) / n - prior * s[:n] / n, s[n:] / m])
    return np.concatenate([prior * s[:n] / n, -s[n:] / m])


def _fit(pos: Rows, unl: Rows, prior: float, epochs: int, seed: int, pu: bool) -> Net:
    """Non-negative PU risk, or with ``pu`` false plain logistic loss of positives against unlabelled."""
    net, r = Net(pos.x.shape[1], seed), np.random.default_rng(seed)
    batches = max(1, (len(pos) + len(unl)) // 256)
    for e in range(epochs):
        for a, b in zip(np.array_split(r.permutation(len(pos)), batches), np.array_split(r.permutation(len(unl)), batches), strict=True):
            if not len(a) or not len(b):
                continue
            x, bags = map(np.concatenate, zip(pos.batch(a), unl.batch(b), strict=True))
            g, h = net.forward(x, bags)
            d = risk_slope(g, len(a), prior) if pu else plain_slope(g, len(a))
            net.step(x, bags, h, d, 0.01 * (1 - 0.9 * e / epochs), 1e-4)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The share of positives among the unlabelled, from scores that need only rank; ``weight`` counts each of ``unl``.

    Below any score t there is prior * P(t) + (1 - prior) * N(t) of the unlabelled, and N is
    at most 1; above it at least prior * (1 - P(t)). The least upper bound over t counts,
    with a margin of one standard error.
    """
    weight = np.ones(len(unl)) if weight is None else weight
    best, n = 1.0, weight.sum()
    for t in np.quantile(pos, np.linspace(0.02, 0.7, 35)):
        p, u = (pos >= t).mean(), weight[unl >= t].sum() / n
        best = min(best, (u + (u * (1 - u) / n) ** 0.5) / max(p - (p * (1 - p) / len(pos)) ** 0.5, 1e-6))
    return float(np.clip(best, 0.05, 0.98))


def spread(docs: DataFrame, model: dict, without: set) -> tuple[np.ndarray, np.ndarray]:
    """Middles and counts of the cells that hold the logits of all documents but those of the doc_ids ``without``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, without))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, without = shared.value
        found = np.zeros(CELLS, np.int64)
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                if i not in without:
                    found[int(np.clip((logit(model, t.as_py()) + REACH) / (2 * REACH) * CELLS, 0, CELLS - 1))] += 1
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(found[held], pa.int64())], names=["cell", "n"])

    cells = docs.select("doc_id", "text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CELLS rows at most
    return np.array([(r["cell"] + 0.5) / CELLS * 2 * REACH - REACH for r in cells]), np.array([r["n"] for r in cells], np.float64)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 4) -> dict | None:
    """The model (arrays only) from at most the documented number of rows; None without positives."""
    marked = marks(labels, "quality", MOD, HELD_OUT)
    pos = pick(marked.where("y = 1"), POSITIVES, "positive").select("doc_id", F.lit("p").alias("kind"), "y")
    cal = pick(marked, CALIBRATION, "calibration").select("doc_id", F.lit("c").alias("kind"), "y")
    unl = pick(docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), UNLABELLED, "unlabelled").select("doc_id", F.lit("u").alias("kind"), F.lit(-1).alias("y"))
    wanted = pos.unionByName(cal).unionByName(unl).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"), F.max("y").alias("y"))
    # POSITIVES + UNLABELLED + CALIBRATION rows at most; of a doc_id's several texts the first in order counts
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "kinds", "y")).alias("r")).select("doc_id", "r.*")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column("text").cast(pa.binary())]
            packed = [np.unique(ids, return_counts=True) for _, ids in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("kinds"), b.column("y"), pa.array([x for x, _ in got], pa.list_(pa.float32())), pa.array([k.astype(np.int16) for k, _ in packed], pa.list_(pa.int16())), pa.array([n.astype(np.int32) for _, n in packed], pa.list_(pa.int32()))],
                names=["doc_id", "kinds", "y", "x", "k", "n"],
            )

    got = rows.mapInArrow(measure, f"doc_id {kind}, kinds array<string>, y int, x array<float>, k array<smallint>, n array<int>").toArrow().sort_by("doc_id")
    listed = got.column("kinds").to_pylist()
    kinds = {c: np.array([c in s for s in listed], bool) for c in "pcu"}
    if kinds["p"].sum() < 2 or not kinds["u"].any():
        return None
    x = pc.list_flatten(got.column("x")).to_numpy().reshape(len(got), -1).astype(np.float64)
    mean, sd = x[kinds["u"]].mean(0), x[kinds["u"]].std(0) + 1e-3
    x = np.clip((x - mean) / sd, -8, 8)
    bags = Bags(got.column("k"), got.column("n"))
    y, names = got.column("y").to_numpy(), got.column("doc_id").to_pylist()
    del got
    take = lambda who: Rows(x, bags, np.flatnonzero(who))
    half = np.arange(len(y)) % 2 == 0
    fitted, kept_back, prior = (kinds["p"] | kinds["u"]) & half, kinds["p"] & ~half, 0.5
    if (kinds["p"] & half).any() and (kinds["u"] & half).any() and kept_back.any():
        first = _fit(take(kinds["p"] & half), take(kinds["u"] & half), 0.5, 6, seed, False)
        middles, counts = spread(docs, {"p": first.p, "mean": mean, "sd": sd}, {names[k] for k in np.flatnonzero(fitted)})
        prior = estimate_prior(take(kept_back).logits(first), middles, counts) if len(counts) else prior
    net = _fit(take(kinds["p"]), take(kinds["u"]), prior, 14, seed, True)
    who = kinds["c"]
    scale = platt(take(who).logits(net), y[who], np.ones(int(who.sum())))
    del x, bags, take
    pa.default_memory_pool().release_unused()
    return {"p": net.p, "mean": mean, "sd": sd, "scale": scale, "prior": prior}


def logit(model: dict, text: bytes | None) -> float:
    """The network's value of a whole text."""
    x, ids = features(text)
    x = np.clip((x - model["mean"]) / model["sd"], -8, 8)
    p = model["p"]
    return float(np.tanh(x @ p["w1"] + p["b1"]) @ p["w2"] + x @ p["lin"] + (p["words"][ids].mean() if len(ids) else 0.0) + p["b"][0])


def score_text(model: dict | None, text: bytes | None) -> float:
    if model is None:
        return 0.5
    a, b = model["scale"]
    return float(sigmoid(np.asarray(a * logit(model, text) + b)))


def add_score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores of the whole ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [score_text(shared.value, t.as_py()) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{types}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = add_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder(MOD) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the cut, with their own columns."""
    return add_score(docs, fit(docs, labels), "__vf_score").where(F.col("__vf_score") >= CUT).select(*docs.columns)
