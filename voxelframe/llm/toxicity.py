"""Toxicity by a convolutional text classifier, trained in numpy.

Words (letters and digits, A-Z lower-cased) get the sum of hashed embeddings of the whole word
and of its beginnings, so that unseen forms of a known stem count; filters of
one, two and three words run over the whole text, each keeps its greatest value, and a
logistic unit weighs those. A hash that is in under MIN_DOCS training texts has no
embedding, so what is rare cannot mislead. The score is calibrated on training rows kept
back from fitting (Platt); on the same rows a cut is found for each language, which is
reported beside the score and is no input of it.

Bounds: at most TOXIC and CLEAN labelled rows are fitted, those with the smallest hashes of
doc_id, as far as their whole texts fill FIT_BYTES; every text is read and scored whole.

Defined results: null and empty texts are scored as texts without words; a null doc_id is
never learned from and not held out; with labels of one kind only every score is 0.5 (cut
none); a null or unknown lang has the cut 0.5; repeated rows are scored each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import words_of
from .labelled import marks, pick, platt, remainder, sigmoid

TOXIC, CLEAN, FIT_BYTES = 1500, 2500, 64 << 20
TABLE_BITS, DIM, WIDTHS, FILTERS, EPOCHS = 18, 12, (1, 2, 3), 12, 8
#: Bytes of a word's beginning that are hashed besides the whole word; words that a worker remembers.
STEMS, REMEMBERED = (4, 5, 6, 7, 8), 200_000
MOD, HELD_OUT, CUT, MIN_DOCS = 5, 0, 0.5, 3
PAD = 1 << TABLE_BITS  # the row of no word, always zero
#: Where each filter width's columns begin, for each word of its window.
COLUMNS = [[(sum(WIDTHS[:k]) + j) * FILTERS for j in range(w)] for k, w in enumerate(WIDTHS)]


def rows_of(word: bytes) -> list[int]:
    """The table rows of a word: of the whole, and of each beginning that is shorter."""
    n = len(word)
    return [crc32(word, 1) >> (32 - TABLE_BITS), *(crc32(word[:k], k + 1) >> (32 - TABLE_BITS) if k < n else PAD for k in STEMS)]


def convolve(x: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Values of all filters at each word; ``x`` ends with two rows of zeros."""
    z = x @ filters
    n = len(x) - 2
    out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
    for k, at in enumerate(COLUMNS):
        part = z[:n, at[0] : at[0] + FILTERS]
        for j, c in enumerate(at[1:], 1):
            part = part + z[j : n + j, c : c + FILTERS]
        out[:, k * FILTERS : (k + 1) * FILTERS] = part
    return out + bias


def forward(x: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's greatest value over the words, 0 at least, and where it is; ``x`` ends with two rows of zeros."""
    c = convolve(x, filters, bias) if len(x) > 2 else np.full((1, len(bias)), -1.0, np.float32)
    best = c.argmax(0)
    return np.maximum(c[best, np.arange(len(bias))], 0), best


def backward(x: np.ndarray, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, base: float, y: float, weight: float) -> tuple[np.ndarray, dict]:
    """The pooled values of a text, and the derivatives of its weighted log loss; ``words`` lists (places, derivatives by x there)."""
    h, best = forward(x, filters, bias)
    d = float(sigmoid(h @ out + base) - y) * weight
    back = d * out * (h > 0)
    slopes = {"out": d * h, "base": d, "bias": back, "filters": np.zeros_like(filters), "words": []}
    if len(x) > 2:
        for f, at in enumerate(COLUMNS):
            part = slice(f * FILTERS, (f + 1) * FILTERS)
            for j, col in enumerate(at):
                p = best[part] + j
                slopes["filters"][:, col : col + FILTERS] = x[p].T * back[part]
                slopes["words"].append((p, back[part][:, None] * filters[:, col : col + FILTERS].T))
    return h, slopes


def train(texts: list[list[bytes]], y: np.ndarray, seed: int = 8) -> dict:
    """Adagrad on the log loss, both classes weighing the same; ``texts`` are lists of words."""
    r = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int32, len(t)) for t in texts]
    known = np.array([rows_of(w) for w in number] or [[PAD] * (1 + len(STEMS))], np.int32)
    n_docs = np.zeros(PAD + 1, np.int32)
    for t in ids:
        n_docs[np.unique(known[np.unique(t)])] += 1
    usable = n_docs >= MIN_DOCS
    usable[PAD] = False
    known = np.where(usable[known], known, PAD)
    table = np.zeros((PAD + 1, DIM), np.float32)
    table[:PAD] = r.normal(0, 0.01, (PAD, DIM)) * usable[:PAD, None]
    filters = r.normal(0, DIM**-0.5, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    out, base = r.normal(0, 0.3, len(bias)).astype(np.float32), np.zeros(1, np.float32)
    g_table, g_filters, g_bias, g_out, g_base = (np.full_like(a, 1e-3) for a in (table, filters, bias, out, base))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)

    def move(a: np.ndarray, memory: np.ndarray, g: np.ndarray, rate: float) -> None:
        memory += g * g
        a -= rate * g / np.sqrt(memory)

    for _ in range(EPOCHS):
        order = r.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 32)):
            d_filters, d_bias, d_out, d_base = np.zeros_like(filters), np.zeros_like(bias), np.zeros_like(out), 0.0
            touched, deltas = [], []
            for i in batch:
                k = np.concatenate([known[ids[i]], np.full((2, known.shape[1]), PAD, np.int32)])
                h, slopes = backward(table[k].sum(1), filters, bias, out, float(base[0]), float(y[i]), weight[i] / len(batch))
                d_out += slopes["out"]
                d_base += slopes["base"]
                d_bias += slopes["bias"]
                d_filters += slopes["filters"]
                for p, g in slopes["words"]:
                    touched.append(k[p].ravel())
                    deltas.append(np.repeat(g, k.shape[1], 0))
            move(filters, g_filters, d_filters + 1e-4 * filters, 0.05)
            move(bias, g_bias, d_bias, 0.05)
            move(out, g_out, d_out + 1e-4 * out, 0.05)
            move(base, g_base, np.array([d_base], np.float32), 0.05)
            if touched:
                which, place = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(which), DIM), np.float32)
                np.add.at(g, place, np.concatenate(deltas))
                a, m = table[which], g_table[which]
                move(a, m, g, 0.1)
                table[which], g_table[which] = a, m
                table[PAD] = 0
    held = np.flatnonzero(usable)
    return {"rows": held.astype(np.int32), "values": table[held], "filters": filters, "bias": bias, "out": out, "base": float(base[0]), "scale": (1.0, 0.0)}


class Scorer:
    """Scores texts; remembers the embeddings of up to REMEMBERED words and then starts anew."""

    def __init__(self, model: dict | None):
        self.model = model
        if model:
            self.table = np.zeros((PAD + 1, DIM), np.float32)
            self.table[model["rows"]] = model["values"]
            self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.known = np.zeros((4096, DIM), np.float32)

    def logit(self, words: list[bytes]) -> float:
        number = self.number
        if new := {w for w in words if w not in number}:
            if len(number) + len(new) > REMEMBERED and number:
                self.forget()
                return self.logit(words)
            new = list(new)
            first = len(number)
            if first + len(new) > len(self.known):
                grown = np.zeros((max(2 * len(self.known), first + len(new)), DIM), np.float32)
                grown[:first] = self.known[:first]
                self.known = grown
            for a in range(0, len(new), 8192):
                part = new[a : a + 8192]
                self.known[first + a : first + a + len(part)] = self.table[np.array([rows_of(w) for w in part])].sum(1)
            number.update(zip(new, range(first, first + len(new)), strict=True))
        m = self.model
        ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        x = np.zeros((len(words) + 2, DIM), np.float32)
        x[: len(words)] = self.known[ids]
        best = np.zeros(len(m["bias"]), np.float32)
        for a in range(0, len(words), 4096):  # in pieces that overlap by the widest filter
            best = np.maximum(best, convolve(x[a : a + 4096 + 2], m["filters"], m["bias"]).max(0))
        return float(best @ m["out"] + m["base"])

    def score(self, text: bytes | None) -> float:
        if self.model is None:
            return 0.5
        a, b = self.model["scale"]
        return float(sigmoid(np.asarray(a * self.logit(words_of(text)) + b)))


def best_cut(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of the greatest F1, in the middle of its gap."""
    order = np.argsort(-score, kind="stable")
    s, t, w = score[order], y[order], weight[order]
    hit, said, real = np.cumsum(t * w), np.cumsum(w), (y * weight).sum()
    f1 = 2 * hit / (said + real)
    k = int(np.argmax(np.where(np.append(s[:-1] > s[1:], True), f1, -1)))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict | None, dict[str, float]]:
    """The model and the cuts by language."""
    marked = marks(labels, "toxic", MOD, HELD_OUT)
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    wanted = pick(marked.where("y = 1"), TOXIC, "toxic").unionByName(pick(marked.where("y = 0"), CLEAN, "clean"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # of a doc_id's several texts the first in order counts; TOXIC + CLEAN rows at most go through the window
    sizes = docs.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.max("n").alias("n"))
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy(F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))), "doc_id"))
    fitting = sizes.withColumn("upto", upto).where(F.col("upto") <= FIT_BYTES).select("doc_id", "y")
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(fitting), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "y")).alias("r")).select("doc_id", "r.*")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [b" ".join(words_of(t.as_py())) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang").cast(pa.string()), b.column("y"), pa.array(got, pa.binary())], names=["doc_id", "lang", "y", "words"])

    got = rows.mapInArrow(code, f"doc_id {kind}, lang string, y int, words binary").toPandas().sort_values("doc_id", ignore_index=True)
    y = got.y.to_numpy(int)
    if len(y) < 8 or y.min() == y.max():
        return None, {}
    codes = [bytes(c).split() for c in got.words]
    back = np.array([crc32(str(i).encode() + b"back") % 4 == 0 for i in got.doc_id])
    if y[back].min(initial=1) == y[back].max(initial=0) or y[~back].min(initial=1) == y[~back].max(initial=0):
        back[:] = False
    model = train([c for c, b in zip(codes, back, strict=True) if not b], y[~back])
    on = back if back.any() else np.ones(len(y), bool)
    scorer = Scorer(model)
    raw = np.array([scorer.logit(c) for c, b in zip(codes, on, strict=True) if b])
    weight = np.where(y == 1, counts.get(1, 0) / max(1, (y == 1).sum()), counts.get(0, 0) / max(1, (y == 0).sum()))[on]
    a, b = platt(raw, y[on], weight)
    cut = best_cut(sigmoid(a * raw + b), y[on], weight)
    b -= float(np.log(np.clip(cut, 1e-4, 1 - 1e-4) / (1 - np.clip(cut, 1e-4, 1 - 1e-4))))  # the best cut is 0.5
    model["scale"] = (a, b)
    score, lang = sigmoid(a * raw + b), got.lang.to_numpy(object)[on]
    cuts = {}
    for name in {x for x in lang if x is not None}:
        who = lang == name
        if y[on][who].sum() >= 10 and (1 - y[on][who]).sum() >= 10:
            cuts[name] = best_cut(score[who], y[on][who], weight[who])
    return model, cuts


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, lang_cut, flagged (score >= lang_cut)."""
    model, cuts = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cuts = shared.value
        scorer = Scorer(model)
        for b in batches:
            s = [scorer.score(t.as_py()) for t in b.column("text").cast(pa.binary())]
            c = [cuts.get(x, CUT) for x in b.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array(c, pa.float64())], names=["doc_id", "score", "lang_cut"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {kind}, score double, lang_cut double")
    return scored.select("doc_id", F.coalesce(remainder(MOD) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "lang_cut", (F.col("score") >= F.col("lang_cut")).alias("flagged"))
