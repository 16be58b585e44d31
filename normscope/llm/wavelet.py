"""Token ids in wavelet matrix files: one compressed file for each shard of documents.

A shard's ids are stored as bit-planes, highest bit first, each plane over the ids ordered by the
planes before it (zeros first, stably). A file holds every plane as blocks that are compressed one by one, and a
directory of the blocks' places and of the ones before each. So access to a token, counting a token in a
range and finding its k-th place read and unpack one or two blocks of each plane, and nothing else; no decoded
copy is needed. A file also lists its documents and their places.

``write_shards`` encodes the documents, orders them by id across shards and writes the files to
shared storage; ``read_documents`` reads them back. A task that is run again writes files of other
names, and only the files that the summary of the finished job names are read.

Edge cases: a null or empty text is the end id alone; texts of any length are encoded whole, and a shard ends after
the batch that fills it; null document ids come first; rows with equal ids follow one another by a hash of the
text, and any number of them is dealt out over shards; an empty table writes no file; other columns are neither
read nor returned.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base
from .token_counts import unit_encoder

MAGIC = b"NSWM0001"
SHARD_TOKENS = 1 << 22
#: Bits of a block, which is compressed alone and has its ones counted in the directory.
BLOCK = 1 << 16
#: Ids that are ordered by a bit at once: their places stay in a core's cache.
PIECE = 1 << 15


def _planes(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Packed bits of every plane, highest bit of the ids first, and how many zeros each has."""
    x = np.asarray(ids)
    bits = max(1, int(x.max(initial=0)).bit_length())
    x = x.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, zeros, y = [], [], np.empty_like(x)
    for level in range(bits - 1, -1, -1):
        bit = (x & x.dtype.type(1 << level)) != 0
        planes.append(np.packbits(bit))
        zeros.append(x.size - int(np.count_nonzero(bit)))
        if level:  # nothing follows the last plane
            for at, nil, one, a, b in _pieces(bit, zeros[-1]):
                for places, to in ((nil, a), (one, b)):  # all places are inside: "clip" saves a copy
                    x[at : at + PIECE].take(places, out=y[to : to + places.size], mode="clip")
            x, y = y, x
    return planes, zeros


def _pieces(bit: np.ndarray, zeros: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """For each piece its start, its places of zeros and of ones, and where these go in the next order."""
    a, b = 0, zeros
    for at in range(0, bit.size, PIECE):
        piece = bit[at : at + PIECE]
        nil, one = np.flatnonzero(~piece), np.flatnonzero(piece)
        yield at, nil, one, a, b
        a, b = a + nil.size, b + one.size


def to_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """MAGIC; the numbers of ids, documents, planes and blocks; each plane's zeros; the directory of ones before
    each block and of all parts' ends; then the compressed parts: the planes' blocks, document ids, which of
    them are null, lengths. Any part is read without the others."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes, zeros = _planes(ids)
    parts, ones = [], []
    for plane in planes:
        before = 0
        for at in range(0, plane.size, BLOCK // 8):
            block = plane[at : at + BLOCK // 8]
            ones.append(before)
            before += int(np.bitwise_count(block).sum())
            parts.append(squeeze(block.tobytes()))
    known = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
    parts += [squeeze(x.tobytes()) for x in (known, np.array([i is None for i in doc_ids], dtype=np.uint8), np.asarray(lengths, dtype="<i8"))]
    head = struct.pack("<4Q", len(ids), len(doc_ids), len(planes), len(ones))
    tables = [np.array(zeros, "<u8"), np.array(ones, "<u8"), np.cumsum([len(x) for x in parts]).astype("<u8")]
    return MAGIC + head + b"".join(t.tobytes() for t in tables) + b"".join(parts)


class ShardFile:
    """Rank and select over a file's ids. ``read(at, size)`` gives bytes of the file; bytes themselves do as well.
    The head and the directory are read at first, then only the blocks that are asked for; the last
    of each plane is kept."""

    def __init__(self, read: bytes | Callable[[int, int], bytes]):
        import zstandard

        self._read = read if callable(read) else lambda at, size: read[at : at + size]
        self._unpack = zstandard.ZstdDecompressor().decompress
        head = self._read(0, len(MAGIC) + 32)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.n_docs, self.bits, blocks = struct.unpack_from("<4Q", head, len(MAGIC))
        size = 8 * (self.bits + 2 * blocks + 3)
        numbers = np.frombuffer(self._read(len(head), size), dtype="<u8").astype(np.int64)
        self.zeros, self._ones, ends = np.split(numbers, [self.bits, self.bits + blocks])
        self._ends = len(head) + size + np.concatenate([[0], ends])
        self._blocks = blocks // self.bits if self.bits else 0  # of a plane
        self._kept: dict[int, tuple[int, np.ndarray]] = {}
        self.unpacked = 0  # blocks

    def _part(self, k: int) -> bytes:
        return self._unpack(self._read(int(self._ends[k]), int(self._ends[k + 1] - self._ends[k])))

    def _block(self, level: int, block: int) -> np.ndarray:
        if self._kept.get(level, (-1, None))[0] != block:
            self._kept[level] = block, np.frombuffer(self._part(level * self._blocks + block), dtype=np.uint8)
            self.unpacked += 1
        return self._kept[level][1]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the plane's first i bits."""
        if not i:
            return 0
        block = (i - 1) // BLOCK
        packed, i = self._block(level, block), i - block * BLOCK
        rest = int(packed[i // 8]) >> (8 - i % 8) if i % 8 else 0
        return int(self._ones[level * self._blocks + block]) + int(np.bitwise_count(packed[: i // 8]).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK // 8]) >> (7 - i % 8) & 1
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the last order holds the token's occurrences among the places a to b."""
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            ones_a, ones_b = self._rank1(level, a), self._rank1(level, b)
            if token >> (self.bits - 1 - level) & 1:
                a, b = int(self.zeros[level]) + ones_a, int(self.zeros[level]) + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of the token among the places a to b."""
        a, b = self._range(token, a, self.n if b is None else b)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            one = i >= self.zeros[level]
            i = self._select_bit(level, i - int(self.zeros[level]) if one else i, one)
        return i

    def _select_bit(self, level: int, k: int, one: bool) -> int:
        counts = self._ones[level * self._blocks : (level + 1) * self._blocks]
        if not one:
            counts = np.arange(counts.size) * BLOCK - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, block))
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(counts[block])])

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x, y = np.zeros(self.n, dtype=kind), np.empty(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            packed = [np.frombuffer(self._part(level * self._blocks + k), dtype=np.uint8) for k in range(self._blocks)]
            bit = np.unpackbits(np.concatenate(packed), count=self.n).view(bool)
            x[self.zeros[level] :] |= kind(1 << (self.bits - 1 - level))
            for at, nil, one, a, b in _pieces(bit, int(self.zeros[level])):
                y[at : at + PIECE][nil] = x[a : a + nil.size]
                y[at : at + PIECE][one] = x[b : b + one.size]
            x, y = y, x
        return x

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids, and the place of each document's first token (n_docs + 1)."""
        first = self.bits * self._blocks
        ids = np.frombuffer(self._part(first), dtype="<i8").tolist()
        null = np.frombuffer(self._part(first + 1), dtype=np.uint8)
        lengths = np.frombuffer(self._part(first + 2), dtype="<i8")
        return [None if x else i for i, x in zip(ids, null.tolist(), strict=True)], np.concatenate([[0], np.cumsum(lengths)])


def open_shard(uri: str) -> ShardFile:
    """A shard on storage, of which only what is asked for is read."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    file = system.open_input_file(path)
    return ShardFile(lambda at, size: file.read_at(size, at))


def _write(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as f:
        f.write(data)


def write_shards(df: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str, *, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Files below ``folder``, and their summary (name, part, seq, n_docs, n_tokens) with ``start``, the
    ids of all shards before. Shards follow the documents' ids."""
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(base.read_bytes(tokenizer))  # a tokenizer file: some MB at most
    kind = "json" if tokenizer.endswith(".json") else "model"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a repeated id is dealt out by its texts, and a repeated row by its place in the input: those follow in any order
    keyed = rows.withColumns({"key": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("id", "key", "place").sortWithinPartitions("id", "key").select("id", "text")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = unit_encoder(kind, data.value)
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = seq = 0

        def shard():
            name = f"part-{part:07d}-{seq:05d}-{uuid.uuid4().hex}.wm"
            _write(folder, name, to_file(np.concatenate(ids), docs, np.concatenate(sizes)))
            return pa.RecordBatch.from_pydict(
                {"name": [name], "part": [part], "seq": [seq], "n_docs": [len(docs)], "n_tokens": [total]},
                schema=pa.schema([("name", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

        for whole in batches:
            for batch in base.cut(whole, 1 << 20):
                got, at = encoder.encode_arrow(batch.column(1))
                n = batch.num_rows
                with_end = np.full(got.size + n, end_id, dtype=np.uint32)
                with_end[np.arange(got.size) + np.repeat(np.arange(n), np.diff(at))] = got
                docs += batch.column(0).to_pylist()
                ids.append(with_end)
                sizes.append(np.diff(at) + 1)
                total += with_end.size
                if total >= shard_tokens:
                    yield shard()
                    docs, ids, sizes, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    summary = base.stored(ordered.mapInArrow(run, "name string, part long, seq long, n_docs long, n_tokens long"), "shards")
    # one row for each file of some million tokens
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the files below a folder, by Spark's own reader."""
    raw = spark.read.format("binaryFile").load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(name, doc_id, at, n_tokens, ids_crc32) of every document of every file, from the decoded ids."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = ShardFile(content.as_py())
                docs, at = shard.documents()
                ids = shard.decode().astype("<u4").tobytes()
                ends = (4 * at).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(docs), pa.string()), pa.array(docs, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()),
                     pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())],
                    names=["name", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return files(spark, folder).mapInArrow(run, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")


def count_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(name, occurrences) of one token in every file, without decoding it."""

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([ShardFile(c.as_py()).count(token) for c in batch.column(1)], pa.int64())], names=["name", "occurrences"]
            )

    return files(spark, folder).mapInArrow(run, "name string, occurrences long")


def store_and_read(df: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from its file."""
    spark = df.sparkSession
    folder = base.shared_path(spark, "wavelet")
    summary = base.stored(write_shards(df, id_col, text_col, tokenizer, folder).select("name", "start"), "shard-starts")
    if summary.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read_documents(spark, folder)
    return found.join(summary, "name").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
