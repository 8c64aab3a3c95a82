"""Training-order materialisation of token ids as fixed-stride binary records.

1. Documents are tokenised (a byte-pair vocabulary file whose path is a parameter), ended by an
   end mark, and packed into sequences of SEQUENCE ids; the last of a partition is filled up.
2. Each partition's number of sequences gives every sequence a dense index 0..N-1.
3. A keyed Feistel permutation with cycle-walking takes the index to its slot: a bijection of
   0..N-1 that needs no shuffle buffer and can be computed, and inverted, for any one slot.
4. Sequences go, packed, to the partition of their slot range and are written there, in slot order, as
   records of a fixed stride: slot s is in shard s // per_shard at byte (s % per_shard) * stride.
   A reader seeks to any slot and reads on, so training resumes anywhere.

Slots are even over 0..N-1, so every partition gets the same number of records whatever the
documents look like; a document of any length is cut into sequences as it is read.

A run of LONGEST characters of one kind (white space, letters, digits, others) is cut there before the tokeniser,
whose pattern and merges would take time and stack that grow with the square of a run; texts without such runs get
the vocabulary's own ids, all texts decode to themselves.

Defined results: null and empty texts are one end mark; a null doc_id is carried as null, as is one that is no number;
repeated rows are each written; an empty table gives no sequences and no shards; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, work_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of one kind after which a run is cut.
LONGEST = 32_768
KINDS = r"\s+|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
SEQUENCE, PER_SHARD, KEY = 1024, 8192, 20240229
TASK_BYTES = 32 << 20
#: Sequences from which the packing on the way is learned; it changes no result.
DICTIONARY_ROWS = 2000
ROUNDS = 6


def load_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pieces(text: str) -> Iterator[str]:
    """The text, in pieces that end where a run of one kind gets LONGEST characters long."""
    at = 0
    if len(text) > LONGEST:
        import regex

        for m in regex.finditer(KINDS, text):
            for cut in range(m.start() + LONGEST, m.end(), LONGEST):
                yield text[at:cut]
                at = cut
    yield text[at:]


class Permutation:
    """A keyed bijection of 0..n-1."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{k}".encode()).digest()[:8], "big")) for k in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, forward: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys if forward else reversed(self.keys):
            if forward:
                left, right = right, left ^ self._mix(right, key)
            else:
                left, right = right ^ self._mix(left, key), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, forward: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), forward)
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = self._once(out[far], forward)
        return out.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, True)

    def indices(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, False)


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = SEQUENCE) -> DataFrame:
    """part, place (in the part), n_tokens, doc_ids, starts, tokens (length ids of 2 or 4 bytes, little-endian), saved."""
    ranks = load_vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    end = max(ranks.values()) + 1
    kind = "<u2" if end < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        part = TaskContext.get().partitionId()
        place, n, open_ids = 0, 0, []  # of the sequence that is being filled
        owners: list[int | None] = []
        starts: list[int] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal place, n, open_ids, owners, starts
            ids = np.full(length, end, kind)
            at = 0
            for x in open_ids:
                ids[at : at + len(x)] = x
                at += len(x)
            out.append((place, n, owners, starts, ids.tobytes()))
            place, n, open_ids, owners, starts = place + 1, 0, [], [], []

        def batch() -> pa.RecordBatch:
            a, b, c, d, e = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.list_(pa.int64())), pa.array(d, pa.list_(pa.int32())), pa.array(e, pa.binary())],
                names=["part", "place", "n_tokens", "doc_ids", "starts", "tokens"],
            )

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.concatenate([*(np.array(coder.encode_ordinary(x), kind) for x in pieces(text.as_py() or "")), np.array([end], kind)])
                at = 0
                while at < len(ids):
                    take = ids[at : at + length - n]
                    owners.append(doc_id)
                    starts.append(n)
                    open_ids.append(take)
                    n += len(take)
                    at += len(take)
                    if n == length:
                        close()
                        if len(out) >= 2048:
                            yield batch()
        if n:
            close()
        if out:
            yield batch()

    cut = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(cut.mapInArrow(run, "part int, place bigint, n_tokens int, doc_ids array<bigint>, starts array<int>, tokens binary"), "sequences", page=8 << 20)


def dictionary(made: DataFrame) -> bytes | None:
    """What DICTIONARY_ROWS sequences have in common, with which each is packed alone on its way to its slot; None for a few sequences."""
    import zstandard

    some = [bytes(r["tokens"]) for r in made.select("tokens").limit(DICTIONARY_ROWS).collect()]
    try:
        return zstandard.train_dictionary(112 << 10, some).as_bytes() if len(some) >= 64 else None
    except zstandard.ZstdError:  # too alike to learn from
        return None


def _dictionary(raw: bytes | None) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def unpacker(raw: bytes | None) -> Callable[[bytes], bytes]:
    import zstandard

    return zstandard.ZstdDecompressor(**_dictionary(raw)).decompress


def materialise(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = SEQUENCE, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """slot, shard, byte_offset, index, n_tokens, doc_ids, starts, tokens: partitioned by slot range, sorted by slot."""
    packed, shared = ordered(docs, vocabulary, length, per_shard, key)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = unpacker(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([decode(x.as_py()) for x in b.column("tokens")], pa.binary())], names=b.schema.names)

    return packed.mapInArrow(unpack, packed.schema)


def ordered(docs: DataFrame, vocabulary: str, length: int, per_shard: int, key: int) -> tuple[DataFrame, Broadcast]:
    """What ``materialise`` gives with packed tokens, and the dictionary to unpack them with."""
    spark = docs.sparkSession
    made = sequences(docs, vocabulary, length)
    sizes = {r["part"]: r["n"] for r in made.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each input split
    first, n = {}, 0
    for part in sorted(sizes):
        first[part] = n
        n += sizes[part]
    stride = length * (2 if max(load_vocabulary(vocabulary).values()) + 1 < 1 << 16 else 4)
    order = spark.sparkContext.broadcast((first, Permutation(max(n, 1), key)))
    shared = spark.sparkContext.broadcast(dictionary(made))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        first, permutation = order.value
        pack = zstandard.ZstdCompressor(level=6, **_dictionary(shared.value)).compress
        for b in batches:
            index = np.array([first[p] for p in b.column("part").to_pylist()], np.int64) + b.column("place").to_numpy()
            slot = permutation.slots(index)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(index), *b.columns[2:-1], pa.array([pack(x.as_buffer()) for x in b.column("tokens")], pa.binary())], names=["slot", "index", *b.schema.names[2:]])

    shards = max(1, -(-n // per_shard))
    parts = int(min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * stride // TASK_BYTES + 1)))
    placed = made.mapInArrow(place, "slot bigint, index bigint, n_tokens int, doc_ids array<bigint>, starts array<int>, tokens binary")
    placed = placed.withColumn("shard", F.expr(f"slot div {per_shard}")).withColumn("byte_offset", F.col("slot") % per_shard * stride)
    ranged = placed.repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("slot")
    return ranged.select("slot", "shard", "byte_offset", "index", "n_tokens", "doc_ids", "starts", "tokens"), shared


def shard_folder(spark: SparkSession) -> str:
    """A folder for the shards of one run: under ``spark.voxelframe.shards`` where that is set, and kept;
    else in the application's shared folder, which goes when the driver exits."""
    return f"{(spark.conf.get('spark.voxelframe.shards', '') or work_dir(spark)).rstrip('/')}/shards-{uuid.uuid4().hex}"


def write_shards(ordered: DataFrame, folder: str, rows: bool = False, packed: Broadcast | None = None) -> DataFrame:
    """Write each shard as one file of records under ``folder`` (a path or URI all machines reach).

    ``packed``: the dictionary of packed tokens, where ``ordered`` has such.

    Gives shard, path, n_records, sha256; with ``rows``, the rows of ``ordered`` instead, as they are
    written. A shard is written under another name and then moved, so a task that runs again leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(top, recursive=True)
        now, sink, temp, n, digest = None, None, "", 0, None
        decode = unpacker(packed.value) if packed else None

        def done() -> tuple:
            sink.close()
            path = f"{top}/shard-{now:08d}.bin"
            store.move(temp, path)
            return now, path, n, digest.hexdigest()

        def row(x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("shard", "path", "n_records", "sha256"), x, strict=True))], schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_records", pa.int64()), ("sha256", pa.string())]))

        for b in batches:
            if decode:
                b = pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([decode(x.as_py()) for x in b.column("tokens")], pa.binary())], names=b.schema.names)
            for shard, record in zip(b.column("shard").to_pylist(), b.column("tokens"), strict=True):
                if shard != now:
                    if now is not None:
                        ended = done()
                        if not rows:
                            yield row(ended)
                    now, n, digest = shard, 0, hashlib.sha256()
                    temp = f"{top}/_{shard:08d}-{TaskContext.get().taskAttemptId()}"
                    sink = store.open_output_stream(temp)
                raw = record.as_py()
                sink.write(raw)
                if not rows:
                    digest.update(raw)
                n += 1
            if rows:
                yield b
        if now is not None:
            ended = done()
            if not rows:
                yield row(ended)

    if rows:
        return ordered.mapInArrow(run, ordered.schema)
    return ordered.select("shard", "tokens").mapInArrow(run, "shard bigint, path string, n_records bigint, sha256 string")


def written(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of ``materialise``; their shards are written as the rows are computed, in the same pass."""
    packed, shared = ordered(docs, VOCABULARY, SEQUENCE, PER_SHARD, KEY)
    return write_shards(packed, folder or shard_folder(docs.sparkSession), rows=True, packed=shared)


def read_slots(folder: str, start: int, count: int, length: int = SEQUENCE, per_shard: int = PER_SHARD, kind: str = "<u2") -> Iterator[np.ndarray]:
    """The records of ``count`` slots from ``start`` on."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    stride = length * np.dtype(kind).itemsize
    at = start
    while at < start + count:
        shard, inside = divmod(at, per_shard)
        n = min(per_shard - inside, start + count - at)
        with store.open_input_file(f"{top}/shard-{shard:08d}.bin") as f:
            raw = f.read_at(n * stride, inside * stride)
        got = len(raw) // stride
        for k in range(got):
            yield np.frombuffer(raw, kind, length, k * stride)
        if got < n:
            return
        at += n
