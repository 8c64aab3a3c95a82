"""Language-model scoring: a gated recurrent network with class-factored softmax, in numpy.

1. Words of all training texts are counted (map-side, then by one shuffle): the base model.
2. The VOCAB most frequent words are split into classes of equal size by frequency; every other word
   belongs to one of RARE classes by its last two bytes. The network predicts the class, then
   the word of a frequent class; within a rare class a word has its smoothed share of the
   counts. Biases start at the counted frequencies, so the untrained network is the unigram
   model.
3. Training: truncated back-propagation through WINDOW words, state carried from window to
   window of a document. ROUNDS times, shards of the training texts are fitted side by side from the same
   start and their parameters averaged. Each round takes its own part of the documents, by hash;
   together the rounds fit every training document once.
4. Scoring runs whole documents, many side by side, each in its own lane with its own state.

Frequent words (at most KNOWN, a bound on what is broadcast) have their counts at hand while a text is
scored; the rest are joined by a 64-bit hash, once for each distinct word of a document.

Defined results: a null text is empty and has one token, its end; without training texts
N = V = 0 and every word is unknown; a null doc_id counts as held out is false and is not learned from;
repeated rows are each counted and scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

MOD, HELD_OUT = 10, 0
VOCAB, CLASSES, RARE, KNOWN = 2000, 40, 24, 100_000
HIDDEN, DIM, WINDOW, LANES, TRAIN_LANES = 16, 16, 32, 512, 256
#: Passes of fitting; words of a shard; words that are laid out in lanes at once (more, and long documents leave fewer lanes idle).
ROUNDS, SHARD_TOKENS, FIT_AT_ONCE, SCORE_AT_ONCE = 2, 2_000_000, 2_500_000, 4_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
EACH = VOCAB // CLASSES


def tokens(text: bytes | None) -> list[bytes]:
    """Words; the end that follows is counted by the callers."""
    return text.translate(LOWER).split() if text else []


def rare_class(word: bytes) -> int:
    return crc32(word[-2:]) % RARE


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % MOD == HELD_OUT, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """word, class, n over the training texts, saved; the end is the row with a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        ends = 0

        def out() -> pa.RecordBatch:
            words = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([*words, None], pa.binary()).cast(pa.string()), pa.array([*map(rare_class, words), 0], pa.int32()), pa.array([*found.values(), ends], pa.int64())], names=["word", "class", "n"]
            )

        for b in batches:
            for t in b.column("text").cast(pa.binary()):
                found.update(tokens(t.as_py()))
                ends += 1
                if len(found) > 400_000:
                    yield out()
                    found.clear()
                    ends = 0
        if ends:
            yield out()

    train = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text")
    counted = train.mapInArrow(run, "word string, class int, n bigint").groupBy("word", "class").agg(F.sum("n").alias("n"))
    return save(counted, "words")


class Counts:
    """What all workers know: totals, the frequent words and their logarithms."""

    def __init__(self, table: DataFrame):
        known = F.col("word").isNotNull()
        by_class = {r["class"]: (r["n"], r["v"]) for r in table.where(known).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
        self.ends = (table.where(~known).agg(F.sum("n")).first()[0]) or 0
        self.n = sum(n for n, _ in by_class.values()) + self.ends
        self.v = sum(v for _, v in by_class.values()) + (self.ends > 0)
        # the count from which on a word is frequent, by a histogram of logarithms: some thousand rows whatever the input
        steps = table.where(known).groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.col("step").desc()).collect()
        held, least = 0, 0
        for r in steps:
            held += r["words"]
            if held > KNOWN:
                break
            least = r["n"]
        top = table.where(known & (F.col("n") >= least)).collect() if least else []
        top.sort(key=lambda r: (-r["n"], r["word"]))
        self.words = [r["word"].encode() for r in top]
        count = np.array([r["n"] for r in top], np.float64)
        kind = np.array([r["class"] for r in top], np.int32)
        size = min(len(top), VOCAB - 1)
        self.below = least if held > len(top) else 0  # words with fewer have to be joined
        # the network's words: 0 is the end, then the most frequent; classes are runs of EACH words
        self.vocab = np.concatenate([[max(self.ends, 0.5)], count[:size], np.full(VOCAB - 1 - size, 1e-3)])
        left = np.array([by_class.get(c, (0, 0)) for c in range(RARE)], np.float64)
        np.subtract.at(left, kind[:size], np.stack([count[:size], np.ones(size)], 1))
        self.rare_n = left[:, 0]
        self.rare_total = left[:, 0] + 0.1 * (left[:, 1] + 1)
        self.base = np.log10((count + 0.1) / (self.n + 0.1 * (self.v + 1)))
        self.base_end = math.log10((self.ends + 0.1) / (self.n + 0.1 * (self.v + 1)))
        within = np.log10((count + 0.1) / self.rare_total[kind]) if len(top) else np.zeros(0)
        within[:size] = 0
        self.within = within
        self.code = np.where(np.arange(len(top)) < size, np.arange(len(top)) + 1, VOCAB + kind).astype(np.int32)


# ---- the network -----------------------------------------------------------------------------


def start(counts: Counts, seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, k=1.0: r.normal(0, k, s).astype(np.float32)
    mass = counts.vocab.reshape(CLASSES, EACH)
    classes = np.concatenate([mass.sum(1), counts.rare_n + 0.1])
    return {
        "emb": f(VOCAB + RARE, DIM, k=0.3), "wx": f(DIM, 3 * HIDDEN, k=DIM**-0.5), "bx": np.concatenate([np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32),
        "u": f(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), "wc": np.zeros((HIDDEN, CLASSES + RARE), np.float32), "bc": np.log(classes / classes.sum()).astype(np.float32),
        "wo": np.zeros((CLASSES, HIDDEN, EACH), np.float32), "bo": np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32),
    }


def run_window(p: dict, xt: np.ndarray, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after each of the window's steps; ``fresh`` marks where a document begins."""
    steps, out = [], np.empty((*ids.shape, HIDDEN), h.dtype)
    given, begins = xt[ids], fresh.any(1)
    for t in range(len(ids)):
        if begins[t]:
            h = h * ~fresh[t][:, None]
        g, a = given[t], h @ p["u"]
        zr = g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
        zr *= np.float32(0.5)
        np.tanh(zr, out=zr)
        zr += np.float32(1)
        zr *= np.float32(0.5)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = r * a[:, 2 * HIDDEN :]
        n += g[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        if keep:
            steps.append((h, zr, n, a[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        out[t] = h
    return out, steps


def softmax(x: np.ndarray, place: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probabilities of each row's ``place``, and with ``slopes`` the derivative of their negative sum by ``x``."""
    if x.size and x.max() > 60:  # float32 ends at exp(88)
        x -= np.maximum(x.max(1, keepdims=True) - 60, 0)
    every = np.arange(len(x))
    aimed = x[every, place]
    e = np.exp(x, out=x)
    total = e @ np.ones(e.shape[1], e.dtype)
    got = aimed.astype(np.float64) - np.log(total.astype(np.float64))
    if not slopes:
        return got, None
    e /= total[:, None]
    e[every, place] -= 1
    return got, e


def output(p: dict, h: np.ndarray, aim: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probabilities of ``aim`` (words, or rare classes from VOCAB on); with ``grads``, adds to them and gives d h."""
    kind = np.where(aim < VOCAB, aim // EACH, CLASSES + aim - VOCAB).astype(np.int16)
    slopes = grads is not None
    got, d = softmax(h @ p["wc"] + p["bc"], kind, slopes)
    dh = None
    if slopes:
        grads["wc"] += h.T @ d
        grads["bc"] += d.sum(0)
        dh = d @ p["wc"].T
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    near, place = h[order[: edges[-1]]], aim[order[: edges[-1]]]
    inner, back = np.empty(len(near)), np.empty_like(near) if slopes else None
    for c in range(CLASSES):
        part = slice(edges[c], edges[c + 1])
        if part.start < part.stop:
            x = near[part]
            inner[part], d = softmax(x @ p["wo"][c] + p["bo"][c], place[part] - c * EACH, slopes)
            if slopes:
                grads["wo"][c] += x.T @ d
                grads["bo"][c] += d.sum(0)
                back[part] = d @ p["wo"][c].T
    got[order[: edges[-1]]] += inner
    if slopes:
        dh[order[: edges[-1]]] += back
    return got, dh


def windows(texts: list[np.ndarray], lanes: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Input ids, aims, document numbers (-1: none) and beginnings, each (length, lanes).

    Documents, longest first, go to the lane that is shortest so far; there are no more lanes
    than keep all of them busy. Lanes that have ended are left out of later windows.
    """
    size = np.array([len(t) for t in texts], np.int64)
    if not len(size):
        return
    lanes = int(max(1, min(lanes, len(texts), size.sum() // max(1, size.max()) + 1)))
    parts: list[list[int]] = [[] for _ in range(lanes)]
    load = [(0, k) for k in range(lanes)]
    for i in np.argsort(-size, kind="stable").tolist():
        n, k = heapq.heappop(load)
        parts[k].append(i)
        heapq.heappush(load, (n + int(size[i]), k))
    total = sorted(((n, k) for n, k in load), reverse=True)
    steps = -(-total[0][0] // length) * length
    aim, doc, fresh = np.zeros((lanes, steps), np.int32), np.full((lanes, steps), -1, np.int32), np.zeros((lanes, steps), bool)
    for row, (n, k) in enumerate(total):
        aim[row, :n] = np.concatenate([texts[i] for i in parts[k]])
        own = size[parts[k]]
        doc[row, :n] = np.repeat(parts[k], own)
        fresh[row, np.cumsum(own) - own] = True
    ids = np.zeros_like(aim)
    ids[:, 1:] = aim[:, :-1]
    ids[fresh] = 0
    busy = np.array([n for n, _ in total])
    for at in range(0, steps, length):
        part = (slice(0, int((busy > at).sum())), slice(at, at + length))
        yield tuple(np.ascontiguousarray(a[part].T) for a in (ids, aim, doc, fresh))


def log10_scores(p: dict, texts: list[np.ndarray], lanes: int = LANES, length: int = 32) -> np.ndarray:
    """log10 probability of each document's classes and frequent words, state carried through the whole document."""
    total = np.zeros(len(texts))
    xt = p["emb"] @ p["wx"] + p["bx"]
    h = None
    for ids, aim, doc, fresh in windows(texts, lanes, length):
        h = np.zeros((ids.shape[1], HIDDEN), np.float32) if h is None else h[: ids.shape[1]]
        states, _ = run_window(p, xt, ids, fresh, h, False)
        h = states[-1]
        real = doc.ravel() >= 0
        got, _ = output(p, states.reshape(-1, HIDDEN)[real], aim.ravel()[real])
        total += np.bincount(doc.ravel()[real], weights=got, minlength=len(texts))
    return total / math.log(10)


def backward(p: dict, ids: np.ndarray, fresh: np.ndarray, steps: list, part: np.ndarray, g: dict) -> None:
    """Adds the derivatives of a window by the recurrent parameters to ``g``; ``part`` is that by its states."""
    length, n = ids.shape
    dxt, da, dh = np.empty((length, n, 3 * HIDDEN), part.dtype), np.empty((length, n, 3 * HIDDEN), part.dtype), np.zeros((n, HIDDEN), part.dtype)
    begins, ut = fresh.any(1), np.ascontiguousarray(p["u"].T)
    for t in reversed(range(length)):
        before, zr, cand, a = steps[t]
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        dh += part[t]
        slope = zr * (1 - zr)
        dn = dh * (1 - z)
        dn *= 1 - cand * cand
        x = dxt[t]
        np.multiply(dh * (before - cand), slope[:, :HIDDEN], out=x[:, :HIDDEN])
        np.multiply(dn * a, slope[:, HIDDEN:], out=x[:, HIDDEN : 2 * HIDDEN])
        x[:, 2 * HIDDEN :] = dn
        y = da[t]
        y[:, : 2 * HIDDEN] = x[:, : 2 * HIDDEN]
        np.multiply(dn, r, out=y[:, 2 * HIDDEN :])
        dh *= z
        dh += y @ ut
        if begins[t]:
            dh[fresh[t]] = 0
    states = np.concatenate([s[0] for s in steps])
    g["u"] += states.T @ da.reshape(-1, 3 * HIDDEN)
    flat, where = dxt.reshape(-1, 3 * HIDDEN), ids.ravel()
    g["bx"] += flat.sum(0)
    g["wx"] += p["emb"][where].T @ flat
    order = np.argsort(where.astype(np.int16), kind="stable")
    seen = where[order]
    first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
    g["emb"][seen[first]] += np.add.reduceat((flat @ p["wx"].T)[order], first)


def gradients(p: dict, ids: np.ndarray, aim: np.ndarray, doc: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float, int]:
    """Of a window: derivatives of the negative log-likelihood, the last states, its value and the number of words."""
    xt = p["emb"] @ p["wx"] + p["bx"]
    states, steps = run_window(p, xt, ids, fresh, h, True)
    real = doc.ravel() >= 0
    g = {k: np.zeros_like(x) for k, x in p.items()}
    got, part = output(p, states.reshape(-1, HIDDEN)[real], aim.ravel()[real], g)
    back = np.zeros((real.size, HIDDEN), part.dtype)
    back[real] = part
    backward(p, ids, fresh, steps, back.reshape(*ids.shape, HIDDEN), g)
    return g, states[-1], -float(got.sum()), int(real.sum())


class Adam:
    """All parameters in one vector, so that a step is a few operations."""

    def __init__(self, p: dict):
        self.keys = sorted(p)
        self.flat = np.concatenate([p[k].ravel() for k in self.keys])
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        self.p, at = {}, 0
        for k in self.keys:
            self.p[k] = self.flat[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size

    def step(self, g: dict, scale: float, rate: float) -> None:
        x = np.concatenate([g[k].ravel() for k in self.keys])
        x *= np.float32(scale)
        self.t += 1
        self.m += np.float32(0.1) * (x - self.m)
        x *= x
        x -= self.v
        x *= np.float32(0.01)
        self.v += x
        root = np.sqrt(self.v / np.float32(1 - 0.99**self.t))
        root += np.float32(1e-5)
        self.flat -= np.float32(rate / (1 - 0.9**self.t)) * (self.m / root)


def train(p: dict, batches: Iterator[list[np.ndarray]], rate: float) -> tuple[dict, int]:
    """Truncated back-propagation with Adam over the documents of each batch; the new parameters and the number of words."""
    adam = Adam(p)
    seen = 0
    for texts in batches:
        h = None
        for ids, aim, doc, fresh in windows(texts, TRAIN_LANES, WINDOW):
            n = ids.shape[1]
            h = np.zeros((n, HIDDEN), np.float32) if h is None else h[:n]
            g, h, _, words = gradients(adam.p, ids, aim, doc, fresh, h)
            seen += words
            adam.step(g, 1 / max(1, words), rate)
    return adam.p, seen


def pack(p: dict) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32).tobytes()


def unpack(raw: bytes, like: dict) -> dict:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


class Coder:
    """Words to the network's ids, and what is known of them without a join."""

    def __init__(self, counts: Counts):
        self.c = counts
        self.index = dict(zip(counts.words, range(len(counts.words)), strict=True))

    def code(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """ids (with the end), places in the frequent words (-1: not there) and the words that aren't."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        ids = np.zeros(len(words) + 1, np.int32)
        lost = np.flatnonzero(at < 0)
        missing = [words[i] for i in lost.tolist()]
        if len(self.c.code):
            ids[:-1] = self.c.code[at]
        ids[lost] = np.fromiter(map(rare_class, missing), np.int32, len(missing)) + VOCAB
        return ids, at, missing


def fit(docs: DataFrame, counts: Counts, shared: object) -> dict:
    """Average the parameters of shards that are fitted side by side, ROUNDS times."""
    spark = docs.sparkSession
    params = start(counts)
    if not counts.n:
        return params
    shards = max(1, math.ceil(counts.n / ROUNDS / SHARD_TOKENS))
    turn = F.crc32(F.concat(F.lit("lm:"), F.col("doc_id").cast("string")).cast("binary")) % ROUNDS
    for k in range(ROUNDS):
        begin = spark.sparkContext.broadcast(params)
        rate = 0.01 / (1 + k)

        def run(batches: Iterator[pa.RecordBatch], begin=begin, rate=rate) -> Iterator[pa.RecordBatch]:
            coder = Coder(shared.value)

            def texts() -> Iterator[list[np.ndarray]]:
                part: list[np.ndarray] = []
                size = 0
                for b in batches:
                    for t in b.column("text").cast(pa.binary()):
                        part.append(coder.code(tokens(t.as_py()))[0])
                        size += len(part[-1])
                        if size > FIT_AT_ONCE:
                            yield part
                            part, size = [], 0
                if part:
                    yield part

            p, seen = train(begin.value, texts(), rate)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(seen)]), pa.array([pack(p)], pa.binary())], names=["shard", "weight", "params"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight = 0.0, 0.0
            for b in batches:
                for w, raw in zip(b.column("weight").to_pylist(), b.column("params"), strict=True):
                    total = total + w * np.frombuffer(raw.as_py(), np.float32).astype(np.float64)
                    weight += w
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["shard", "weight", "params"])

        part = docs.where(F.col("doc_id").isNotNull() & ~held_out() & (turn == k)).select("doc_id", "text")
        fitted = part.repartition(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "shard int, weight double, params binary")
        halves = save(fitted, "fitted").repartition(max(1, math.isqrt(shards)), "shard").mapInArrow(mean, "shard int, weight double, params binary").collect()
        if halves:
            weight = sum(r["weight"] for r in halves)
            params = unpack(sum(r["weight"] / weight * np.frombuffer(bytes(r["params"]), np.float32) for r in halves).astype(np.float32).tobytes(), params)
    return params


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    table = count_words(docs)
    counts = Counts(table)
    shared = spark.sparkContext.broadcast(counts)
    model = spark.sparkContext.broadcast(fit(docs, counts, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, p = shared.value, model.value
        coder = Coder(c)
        top, row = TaskContext.get().partitionId() << 33, 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                ids, out = [], {k: [] for k in ("n", "known", "base", "within", "words", "times")}
                size, first = 0, at
                while at < whole.num_rows and size < SCORE_AT_ONCE:
                    code, place, missing = coder.code(tokens(whole.column("text")[at].cast(pa.binary()).as_py()))
                    found = place[place >= 0]
                    rare = Counter(missing)
                    ids.append(code)
                    out["n"].append(len(code))
                    out["known"].append(len(found) + (c.ends > 0))
                    out["base"].append(float(c.base[found].sum()) + c.base_end if len(found) else c.base_end)
                    out["within"].append(float(c.within[found].sum()) if len(found) else 0.0)
                    out["words"].append([w.decode() for w in rare])
                    out["times"].append(list(rare.values()))
                    size += len(code)
                    at += 1
                lm = log10_scores(p, ids) + np.array(out["within"])
                n = at - first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(top + row, top + row + n)), whole.column("doc_id").slice(first, n), pa.array(out["n"], pa.int64()), pa.array(out["known"], pa.int64()),
                        pa.array(out["base"], pa.float64()), pa.array(lm, pa.float64()), pa.array(out["words"], pa.list_(pa.string())), pa.array(out["times"], pa.list_(pa.int32())),
                    ],
                    names=["row", "doc_id", "n_tokens", "known", "base", "lm", "words", "times"],
                )
                row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = save(docs.select("doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, known bigint, base double, lm double, words array<string>, times array<int>"), "scored")
    # words that few texts have: join their counts, once for each document and word
    everything = not counts.words and counts.v > 0
    rest = table.where(F.col("word").isNotNull()).where(F.lit(True) if everything else F.col("n") < counts.below)
    total = F.element_at(F.array(*[F.lit(float(x)) for x in counts.rare_total]), F.col("class") + 1)
    norm = counts.n + 0.1 * (counts.v + 1)
    unseen = math.log10(0.1 / norm)
    rest = rest.select(F.xxhash64("word").alias("h"), "n")
    seen = base.select("row", F.explode(F.arrays_zip("words", "times")).alias("x"))
    seen = seen.select("row", F.xxhash64("x.words").alias("h"), F.col("x.times").alias("times"), (F.crc32(F.expr("substring(cast(x.words as binary), greatest(octet_length(x.words) - 1, 1), 2)")) % RARE).cast("int").alias("class"))
    joined = seen.join(rest, "h", "left") if counts.below or everything else seen.withColumn("n", F.lit(None).cast("bigint"))
    c = F.coalesce("n", F.lit(0))
    added = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).cast("bigint").alias("_known"),
        F.sum(F.col("times") * F.when(F.col("n").isNull(), F.lit(unseen)).otherwise(F.log10((c + 0.1) / norm))).alias("_base"),
        F.sum(F.col("times") * F.log10((c + 0.1) / total)).alias("_lm"),
    )
    out = base.drop("words", "times").join(added, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(counts.n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero)).alias("base_score"), (F.col("lm") + F.coalesce("_lm", zero)).alias("score"),
    )
