"""Near-duplicate detection with an LSH forest over MinHash signatures.

1. Equal word sequences become one representative (the least doc_id); all copies follow it.
2. A representative's set of 5-word shingles gives TREES signatures of DEPTH least hashes (16 bits).
   In each tree the representatives are sorted by signature, ties by id: range partitions, so that
   even one huge region of like signatures spreads over many tasks.
3. Neighbours in a sorted order whose longest common prefix is MINIMUM or more are
   candidates; the sort puts the deepest agreement next to each other. Candidates whose whole
   signatures leave SCREEN possible are confirmed on the full sets; links join components.
4. Neighbours of one tree that share the first MINIMUM hashes make a region. A region whose members
   are not all in one component is gone through again, and here the depth adapts: where more
   than CROWD members share a prefix, they are parted by the next hash, down to DEPTH. What is
   crowded even there is dealt into blocks, and every member outside the region's largest
   component, a stray, meets all blocks: a task holds one block of strays and one of members, bounded in rows
   and in shingles, whatever the region's size. Pairs of different components are settled on the full
   sets inside the task, the likest first, and none that links found in the task have joined
   already; only links leave the task, never pairs.
5. Components are joined by least labels and pointer jumping, with every pass saved.

Texts are read where they lie (``common.Numbered``): only sets of candidates are moved.

The chance that two documents of similarity s share no prefix is (1 - s**MINIMUM)**TREES:
with 5 and 20 that is 1e-5 at 0.85; with the whole DEPTH of 8, in crowded regions, 0.0017, for a pair that no third
document joins. The share of equal hashes of two signatures has a standard
error of 0.028 there, so SCREEN lies over four of them below. Shingles are 64-bit hashes; links are confirmed on the full
sets of these.

Defined results: texts without words (null and empty too) have empty sets and stay alone;
with fewer than five words the whole sequence is the only shingle; rows that repeat a doc_id
are one document and get one row each; rows with a null doc_id, or with one that is no number,
stay alone, with a null component, and are kept; an empty table gives no rows; other columns are ignored, or
passed by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import AT, PART, Numbered, discard, join_hot, noted, release, save
from .language_model import LOWER

SHINGLE, PERCENT = 5, 85
TREES, DEPTH, MINIMUM = 20, 8, 5
#: Bytes of a hash in a signature, and of one tree's key.
HASH, KEY = 2, 2 * DEPTH
#: Members of a mixed region from which on it is parted; rows and shingles of a block in which they meet; likeness of signatures under which a pair is ruled out.
CROWD, BLOCK, BLOCK_SHINGLES, SCREEN = 256, 128, 1 << 20, 0.73
_r = np.random.default_rng(85)
FACTORS = _r.integers(1 << 62, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
SHIFTS = _r.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
BASES = _r.integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


class Hasher:
    """64-bit hashes of words, remembered for ``most`` of them and those of one text more."""

    def __init__(self, most: int = 400_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in {w for w in words if w not in seen}:
            seen[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """The sorted distinct shingle hashes."""
        if not words:
            return np.zeros(0, np.uint64)
        h = self(words)
        k = min(SHINGLE, len(h))
        out = np.full(len(h) - k + 1, np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        for j in range(k):
            out = (out ^ (h[j : len(h) - k + 1 + j] * BASES[j])) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(31)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each hash over the set, 16 bits each."""
    best = np.full(len(FACTORS), np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        x = part[:, None] * FACTORS[None, :] + SHIFTS[None, :]
        best = np.minimum(best, x.min(0))
    # the greatest bits of a least value are few; mixed, all of them count
    return ((best * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8 * HASH)).astype(f">u{HASH}")


def sketches(table: Numbered) -> DataFrame:
    """place, doc_id, n_shingles, same (hash of the word sequence), sig (bytes; null without words) of each row, saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hasher = Hasher()
        for b in batches:
            n, same, sig = [], [], []
            for t in b.column("text").cast(pa.binary()):
                words = words_of(t.as_py())
                s = hasher.shingles(words)
                n.append(len(s))
                same.append(xxh3_128_digest(b" ".join(words)) if words else None)
                sig.append(signature(s).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.binary())], names=[PART, AT, "doc_id", "n_shingles", "same", "sig"])

    rows = table.rows.select(PART, AT, F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(rows.mapInArrow(run, f"{PART} bigint, {AT} int, doc_id bigint, n_shingles bigint, same binary, sig binary"), "sketches")


def _keys(column: pa.Array) -> np.ndarray:
    """Keys of one tree as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, KEY)


def neighbours(trees: DataFrame) -> DataFrame:
    """tree, a, ka, b, kb: neighbours in a tree's order that share the first MINIMUM hashes, and their keys. ``trees`` has tree, key, id."""
    ordered = trees.repartitionByRange(max(int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    size = HASH * MINIMUM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(tree, a, ka, b, kb, edge) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int32()), pa.array(a, pa.int64()), pa.array(ka, pa.binary()), pa.array(b, pa.int64()), pa.array(kb, pa.binary()), pa.array([edge] * n)], names=["tree", "a", "ka", "b", "kb", "edge"]
            )

        first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids, keys = batch.column("tree").to_numpy(), batch.column("id").to_numpy(), _keys(batch.column("key"))
            if last is not None:  # the row before the batch goes in front of it
                tree, ids, keys = np.concatenate([last[0], tree]), np.concatenate([last[1], ids]), np.concatenate([last[2], keys])
            else:
                first = (int(tree[0]), int(ids[0]), keys[0].tobytes())
            at = np.flatnonzero((tree[1:] == tree[:-1]) & (keys[1:, :size] == keys[:-1, :size]).all(1))
            if len(at):
                yield rows(tree[at], ids[at], [keys[i].tobytes() for i in at], ids[at + 1], [keys[i + 1].tobytes() for i in at], False)
            last = tree[-1:], ids[-1:], keys[-1:]
        if last is not None:  # the ends of the partition meet those of the next one
            end = (int(last[0][0]), int(last[1][0]), last[2][0].tobytes())
            yield rows([first[0], end[0]], [first[1], end[1]], [first[2], end[2]], [0, 1], [None, None], True)

    found = save(ordered.mapInArrow(run, "tree int, a bigint, ka binary, b bigint, kb binary, edge boolean"), "neighbours")
    w = Window.partitionBy("tree", F.substring("ka", 1, size)).orderBy("ka", "a", "b")  # two rows a partition
    ends = found.where("edge").withColumn("b", F.lead("a").over(w)).withColumn("kb", F.lead("ka").over(w)).where("b <> a")
    return found.where("NOT edge").unionByName(ends).drop("edge")


def likeness(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are alike enough."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    z = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((z[1:] == z[:-1]).sum())
    return 100 * shared >= PERCENT * (n + m - shared)


def full_sets(ids: DataFrame, groups: DataFrame, table: Numbered) -> DataFrame:
    """id, s (the sorted shingle hashes as bytes) of the representatives named, saved."""
    wanted = groups.select(PART, AT, "id").join(ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            got = [hasher.shingles(words_of(t.as_py())).tobytes() for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.binary())], names=["id", "s"])

    texts = table.beside(wanted, "id").where("id IS NOT NULL").select("id", F.col("text").cast("string").alias("text"))
    return save(texts.mapInArrow(sets, "id bigint, s binary"), "sets")


def matched(pairs: DataFrame, table: DataFrame, column: str, test: Callable[[pa.Buffer, pa.Buffer], bool]) -> DataFrame:
    """The pairs (a, b) that pass a test on what ``table`` (id, column) has of both."""
    left = pairs.join(table.select(F.col("id").alias("a"), F.col(column).alias("x")), "a")
    paired = left.join(table.select(F.col("id").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return paired.mapInArrow(check, "a bigint, b bigint")


def alike(a: pa.Buffer, b: pa.Buffer) -> bool:
    return likeness(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))


def possible(a: pa.Buffer, b: pa.Buffer) -> bool:
    """Whether two signatures leave the likeness possible."""
    return float((np.frombuffer(a, f"u{HASH}") == np.frombuffer(b, f"u{HASH}")).mean()) >= SCREEN


def components(links: DataFrame) -> DataFrame:
    """id, label (the least id of its component), of every id in a link; saved.

    Each pass hooks the label of every link's greater side under the lesser one, then
    follows labels of labels; labels only fall, and a component of any shape is
    done in a number of passes that grows as its logarithm.
    """
    both = save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both_ways")
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        at_b = labels.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
        at_a = labels.select(F.col("id").alias("a"), F.col("label").alias("label_a"))
        near = both.join(at_b, "b").join(at_a, "a")
        # the labels' own labels fall with those of the members
        hooks = near.where("label_b < label_a").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("label_b").alias("label")), F.struct(F.col("label_a").alias("id"), F.col("label_b").alias("label")))).alias("x")).select("x.*")
        hooked = save(labels.unionByName(hooks).groupBy("id").agg(F.min("label").alias("label")), "hooked")
        sizes = hooked.groupBy(F.col("label").alias("to")).agg(F.count("*").alias("n"))
        roots = sizes.join(hooked.select(F.col("id").alias("to"), F.col("label").alias("up")), "to", "left")
        total = hooked.count()
        jumped = join_hot(hooked.withColumnRenamed("label", "to"), roots, ["to"], "n", total)
        fresh = save(jumped.select("id", F.least("to", F.coalesce("up", "to")).alias("label")), "labels")
        moved = fresh.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").limit(1).count()
        release(hooked, labels)
        labels = fresh
        if not moved:
            release(both)
            return labels


def mixed_regions(near: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame | None:
    """tree, region, a, b, id, label, stray, home: who meets where, in regions of several components; None without any.

    ``near`` is what ``neighbours`` gives, ``sizes`` has id, n_shingles. Every member is at home in one block b of its region and
    waits there for each block a of strays; a stray of block a visits all blocks b.
    """
    ends = [F.struct(F.col(x).alias("id"), F.col(f"k{x}").alias("key")) for x in "ab"]
    members = near.select("tree", F.explode(F.array(*ends)).alias("m")).select("tree", "m.id", "m.key").distinct()
    members = members.join(labels, "id", "left").join(sizes, "id").withColumn("label", F.coalesce("label", "id"))
    out = None
    for depth in range(MINIMUM, DEPTH + 1):
        members = save(members.withColumn("region", F.substring("key", 1, HASH * depth)), "members")
        held = members.groupBy("tree", "region", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
        regions = held.groupBy("tree", "region").agg(F.count("*").alias("k"), F.sum("n").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("n", "label", "w")).alias("top")).where("k > 1")
        blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES), F.lit(1)).cast("long")
        ready = (F.col("size") <= CROWD) if depth < DEPTH else F.lit(True)
        regions = save(regions.select("tree", "region", "size", F.col("top.label").alias("top"), ready.alias("ready"), blocks(F.col("size") - F.col("top.n"), F.col("weight") - F.col("top.w")).alias("stray_blocks"), blocks(F.col("size"), F.col("weight")).alias("blocks")), "mixed")
        found = regions.groupBy("ready").agg(F.sum("size").alias("n")).collect()  # two rows
        rows = {r["ready"]: r["n"] for r in found}
        if not rows:
            break
        placed = join_hot(members, regions, ["tree", "region"], "size", sum(rows.values())).where("size IS NOT NULL")
        if True in rows:
            stray = F.col("label") != F.col("top")
            here = placed.where("ready").withColumn("stray", stray)
            b, a = F.pmod(F.xxhash64("id"), F.col("blocks")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("stray_blocks"))
            everyone = F.transform(F.sequence(F.lit(0).cast("long"), F.col("stray_blocks") - 1), lambda x: F.struct(x.alias("a"), F.col("_b").alias("b"), F.lit(True).alias("home")))
            visits = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.col("_a").alias("a"), x.alias("b"), F.lit(False).alias("home")))
            here = here.withColumn("_b", b).withColumn("_a", a).withColumn("v", F.explode(F.when(F.col("stray"), F.concat(everyone, visits)).otherwise(everyone)))
            here = here.select("tree", "region", "v.a", "v.b", "id", "label", "stray", "v.home")
            out = here if out is None else out.unionByName(here)
        if False not in rows:
            break
        members = placed.where("NOT ready").select("tree", "key", "id", "label", "n_shingles")
    return out


def _meetings(tree: int, t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each stray on a visit: its place, those at home that may be like it, and how alike their signatures are."""
    ids, labels, strays, home = (t.column(c).to_numpy() for c in ("id", "label", "stray", "home"))
    sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), f"u{HASH}").reshape(len(ids), TREES, DEPTH)
    hosts = np.flatnonzero(home)
    for i in np.flatnonzero(~home):
        # two strays meet where the one of the lesser id is at home
        who = hosts[(labels[hosts] != labels[i]) & (~strays[hosts] | (ids[hosts] < ids[i]))]
        if len(who):
            same = sigs[who] == sigs[i]
            share = same.mean((1, 2))
            # those that share a whole key of an earlier tree have met there
            take = (share >= SCREEN) & ~same[:, :tree].all(2).any(1)
            if take.any():
                yield int(i), who[take], share[take]


def settle(calls: DataFrame, signatures: DataFrame, known: DataFrame, groups: DataFrame, table: Numbered) -> DataFrame:
    """a, b: links between components (labels) that regions of several components hide; saved."""
    keys = ["tree", "region", "a", "b"]
    kinds = "tree int, region binary, a bigint, b bigint, id bigint, label bigint, stray boolean, home boolean, sig binary"

    def involved(key: tuple, t: pa.Table) -> pa.Table:
        take = np.zeros(len(t), bool)
        for i, who, _ in _meetings(key[0].as_py(), t):
            take[i] = True
            take[who] = True
        return t.filter(pa.array(take)).select([c.split()[0] for c in kinds.split(", ")])

    def links(key: tuple, t: pa.Table) -> pa.Table:
        labels = t.column("label").to_pylist()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("s")]
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        met = list(_meetings(key[0].as_py(), t))
        share = np.concatenate([s for _, _, s in met]) if met else np.zeros(0)
        left = np.concatenate([np.full(len(w), i) for i, w, _ in met]) if met else np.zeros(0, int)
        right = np.concatenate([w for _, w, _ in met]) if met else np.zeros(0, int)
        a, b = [], []
        for k in np.argsort(-share, kind="stable"):
            i, j = int(left[k]), int(right[k])
            p, q = find(labels[i]), find(labels[j])
            if p != q and likeness(sets[i], sets[j]):
                up[p] = q
                a.append(labels[i])
                b.append(labels[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = save(calls.join(signatures, "id").groupBy(*keys).applyInArrow(involved, kinds), "meetings")
    more = full_sets(met.select("id").distinct().join(known, "id", "left_anti"), groups, table)
    every = known.unionByName(more)
    return save(met.join(every, "id").groupBy(*keys).applyInArrow(links, "a bigint, b bigint").distinct(), "more_links")


def _labels(one: DataFrame, table: Numbered) -> DataFrame:
    """id, label of all representatives that are linked with others; ``one`` has id, sig, n_shingles and places."""
    trees = one.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.substring(F.col("sig"), k * KEY + 1, F.lit(KEY)))).alias("tree", "key"))
    near = neighbours(trees)
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    signatures = one.select("id", "sig")
    candidates = save(matched(pairs, signatures, "sig", possible), "possible")
    known = full_sets(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), one, table)
    labels = components(save(matched(candidates, known, "s", alike), "links"))
    calls = mixed_regions(near, labels, one.select("id", "n_shingles"))
    if calls is None:
        return labels
    more = settle(calls, signatures, known, one, table)
    if more.isEmpty():
        return labels
    joined = components(more).select(F.col("id").alias("label"), F.col("label").alias("least"))
    alone = more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti")
    return labels.unionByName(alone.select("id", F.col("id").alias("label"))).join(joined, "label", "left").select("id", F.coalesce("least", "label").alias("label"))


def classes(table: Numbered) -> DataFrame:
    """Place, doc_id, n_shingles, component_id, kept of every row of a table with doc_id and text."""
    rows = sketches(table)
    real = rows.where("doc_id IS NOT NULL AND same IS NOT NULL")
    first = F.min_by(F.struct("sig", "n_shingles", PART, AT), F.struct("doc_id", PART, AT))
    groups = real.groupBy("same").agg(first.alias("f"), F.min("doc_id").alias("id"), F.count("*").alias("n")).select("same", "id", "n", "f.*")
    # of a doc_id's several texts one stands for the document among candidates; all get its component
    groups = save(groups.withColumn("stands", F.row_number().over(Window.partitionBy("id").orderBy("same")) == 1), "groups")
    one = groups.where("stands").drop("same", "stands", "n")
    with noted() as made:
        labels = save(_labels(one, table), "joined")
    discard(table.rows.sparkSession, made, labels)
    named = groups.join(labels, "id", "left").select("same", "n", F.coalesce("label", "id").alias("component"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    out = join_hot(rows.drop("sig"), named, ["same"], "n", total)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(PART, AT, "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return classes(Numbered(docs.select("doc_id", "text"), "near")).drop(PART, AT)


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component: that of its least doc_id, with all its columns."""
    table = Numbered(docs, "near")
    gone = classes(table).where("NOT kept").select(PART, AT, F.lit(True).alias("__vf_gone"))
    return table.bare(table.beside(gone, "__vf_gone").where("__vf_gone IS NULL"))
