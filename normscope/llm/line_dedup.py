"""Lines that many documents share, dropped from all but one: a sharded minimal perfect hash in place of a join.

Documents leave one row for each distinct long line and batch (a 128-bit hash, how many documents of the batch hold it, the largest
id of those), so a line of every document is a few rows before anything is shuffled. Spark sums them. Hashes found in
enough documents are dealt to shards by their first bits; each shard's task orders its hashes by a minimal perfect hash
(cascaded bit arrays: a level takes the hashes that meet no other in it, the place is the rank of the set bit) and writes three arrays in that
order: fingerprints, counts, and the ids that keep the line. Documents then probe the arrays, shard by shard, where they lie:
no line and no text is shuffled or joined.

A line that isn't in the index lands on a place whose fingerprint differs. Hash and fingerprint have 128 bits together; of n lines
any two share them with a chance of n²/2¹²⁹. A shard holds about SHARD_HASHES entries of 20 bytes and 3 bits each; a worker keeps KEPT_BYTES of shards, those
asked for last. An index beyond that is read once for each batch of documents, which is the price of not shuffling.

Edge cases: null and empty texts are one empty line, which is never long enough to be dropped. A row is a document of its own:
rows of one id count apart, and each of those that has the largest id keeps the line. A null id counts as the smallest
long. A line twice in a document counts once, and both go or stay. Other columns, whatever their names, are not looked at. Empty tables give empty ones.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, spans

#: Entries of a shard, on average, and the least number of shards.
SHARD_HASHES, LEAST_SHARDS = 1 << 20, 64
#: Bytes of shards that a worker keeps.
KEPT_BYTES = 256 << 20
_NO_ID = np.iinfo(np.int64).min
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit hashes: each has a place of its own below their number."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes  # packed bits of all levels, each level whole bytes; bits of each level
        self.before = np.concatenate([[0], np.cumsum(_ONES[bits], dtype=np.int64)])

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        packed, sizes = [], []
        while a.size:
            size = 64 + 8 * (a.size // 4)  # two bits a hash
            at = _place(a, b, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            packed.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(np.concatenate(packed) if packed else np.zeros(0, np.uint8), np.array(sizes, dtype=np.int64))

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair; of a pair that wasn't there, -1 or any."""
        out, of, start = np.full(a.size, -1, dtype=np.int64), np.arange(a.size), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not of.size:
                break
            at = _place(a[of], b[of], level, size) + start
            byte, bit = self.bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit & 1) == 1
            below = byte & ((np.uint16(1) << bit.astype(np.uint16)) - 1).astype(np.uint8)
            out[of[hit]] = (self.before[at >> 3] + _ONES[below])[hit]
            of, start = of[~hit], start + size
        return out


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
    return (spans.mix(a ^ spans.mix(b + salt)) % np.uint64(size)).astype(np.int64)


class Shard:
    """Fingerprints, counts and keepers in the order of a perfect hash."""

    def __init__(self, perfect: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.perfect, self.fingerprints, self.counts, self.keepers = perfect, fingerprints, counts, keepers

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        perfect = PerfectHash.of(a, b)
        order = np.argsort(perfect.places(a, b))
        return cls(perfect, b[order], np.minimum(counts[order], 0xFFFFFFFF).astype(np.uint32), keepers[order])

    @property
    def nbytes(self) -> int:
        return self.perfect.before.nbytes + sum(x.nbytes for x in (self.perfect.bits, self.fingerprints, self.counts, self.keepers))

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0: not in the index) and keepers."""
        at = self.perfect.places(a, b)
        found = at >= 0
        found[found] = self.fingerprints[at[found]] == b[found]
        counts, keepers = np.zeros(a.size, np.int64), np.full(a.size, _NO_ID, np.int64)
        counts[found], keepers[found] = self.counts[at[found]], self.keepers[at[found]]
        return counts, keepers

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bits=self.perfect.bits, sizes=self.perfect.sizes, fingerprints=self.fingerprints, counts=self.counts, keepers=self.keepers)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        x = np.load(io.BytesIO(data))
        return cls(PerfectHash(x["bits"], x["sizes"]), x["fingerprints"], x["counts"], x["keepers"])


class Index:
    """Where the shards of an index are. ``names``: one short name for each about SHARD_HASHES entries; an empty shard has none."""

    def __init__(self, folder: str, shift: int, names: dict[int, str]):
        self.folder, self.shift, self.names = folder, shift, names

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and keepers of hashes of any shards, one shard after the other."""
        counts, keepers = np.zeros(a.size, np.int64), np.full(a.size, _NO_ID, np.int64)
        shard = (a >> np.uint64(self.shift)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for of in np.split(order, cuts) if a.size else ():
            name = self.names.get(int(shard[of[0]]))
            if name is not None:
                counts[of], keepers[of] = _shard(self.folder, name).probe(a[of], b[of])
        return counts, keepers


_KEPT: OrderedDict[tuple[str, str], Shard] = OrderedDict()


def _shard(folder: str, name: str) -> Shard:
    """A shard, from this worker's memory if it is there."""
    key = folder, name
    if key not in _KEPT:
        system, path = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{path}/{name}") as f:
            _KEPT[key] = Shard.from_bytes(f.read())
        while len(_KEPT) > 1 and sum(s.nbytes for s in _KEPT.values()) > KEPT_BYTES:
            _KEPT.popitem(last=False)
    _KEPT.move_to_end(key)
    return _KEPT[key]


def lines(texts: pa.Array, min_chars: int) -> dict[str, np.ndarray]:
    """All lines of a batch of texts: ``bytes``, and for each line ``text`` (its number), ``start`` and ``end``; for each long enough one
    ``of`` (its line), and hashes ``a`` and ``b`` of its key."""
    bytes_, at = spans.blob(texts)
    breaks = np.flatnonzero(bytes_ == 10)
    n = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1
    text = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    start, end = np.empty(text.size, np.int64), np.empty(text.size, np.int64)
    is_first = np.zeros(text.size, dtype=bool)
    is_first[first] = True
    start[is_first], start[~is_first] = at[:-1], breaks + 1
    is_last = np.zeros(text.size, dtype=bool)
    is_last[first + n - 1] = True
    end[is_last], end[~is_last] = at[1:], breaks
    solid = np.flatnonzero(~spans.SPACE[bytes_])
    points = np.concatenate([[0], np.cumsum((bytes_ & 0xC0) != 0x80)])
    lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = np.flatnonzero(hi > lo)
    left, right = solid[lo[some]], solid[hi[some] - 1] + 1
    long = points[right] - points[left] >= min_chars
    of, left, right = some[long], left[long], right[long]
    low = _LOWER[bytes_]
    return {"bytes": bytes_, "text": text, "start": start, "end": end, "of": of, "a": spans.hashes(low, left, right), "b": spans.hashes(low ^ np.uint8(0xA7), left, right)}


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)


def counted(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(a, b, n, keeper) of the lines found in at least ``min_docs`` documents."""

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        ids, x = _ids(batch), lines(batch.column(1), min_chars)
        a, b, text = x["a"], x["b"], x["text"][x["of"]]
        order = np.lexsort((text, b, a))
        a, b, text = a[order], b[order], text[order]
        new = np.ones(a.size, dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        own = new.copy()
        own[1:] |= text[1:] != text[:-1]
        at = np.flatnonzero(new)
        n = np.add.reduceat(own.astype(np.int64), at) if at.size else np.zeros(0, np.int64)
        keeper = np.maximum.reduceat(ids[text], at) if at.size else np.zeros(0, np.int64)
        return {"a": a[at].view(np.int64), "b": b[at].view(np.int64), "n": n, "keeper": keeper}

    each = base.map_arrow(docs, rows, "a long, b long, n long, keeper long")
    return each.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).where(F.col("n") >= min_docs)


def build(docs: DataFrame, id_col: str, text_col: str, *, min_chars: int = 20, min_docs: int = 3, shard_hashes: int = SHARD_HASHES, least_shards: int = LEAST_SHARDS) -> Index:
    """The index of all lines that ``min_docs`` documents hold, in files below the shared folder. A file is named by its attempt; only
    those of finished tasks are in the index."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = base.stored(counted(rows, min_chars, min_docs), "line-counts")
    n_shards = max(least_shards, -(-held.count() // shard_hashes))
    bits = max(1, (n_shards - 1).bit_length())
    folder = base.shared_path(spark, "line-index")

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.of(*(pdf[c].to_numpy().view(np.uint64) for c in ("a", "b")), pdf["n"].to_numpy(), pdf["keeper"].to_numpy())
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"{key[0]:08d}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{path}/{name}") as f:
            f.write(shard.to_bytes())
        return pd.DataFrame({"shard": [key[0]], "name": [name]})

    made = held.withColumn("shard", F.shiftrightunsigned("a", 64 - bits)).groupBy("shard").applyInPandas(write, "shard long, name string")
    names = {r["shard"]: r["name"] for r in made.collect()}  # one for each shard
    base.discard(held)
    return Index(folder, 64 - bits, names)


def probed(docs: DataFrame, index: Index, id_col: str, text_col: str, *, min_chars: int = 20) -> DataFrame:
    """(id, kept, n_lines, n_dropped): texts without the lines that another document keeps."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def drop(batch: pa.RecordBatch) -> dict[str, object]:
        ids, x = _ids(batch), lines(batch.column(1), min_chars)
        text, n = x["text"], batch.num_rows
        counts, keepers = index.probe(x["a"], x["b"])
        gone = np.zeros(text.size, dtype=bool)
        gone[x["of"]] = (counts > 0) & (keepers != ids[text[x["of"]]])
        n_dropped = np.bincount(text[gone], minlength=n)
        kept, upto = batch.column(1).to_pylist(), np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
        for k in np.flatnonzero(n_dropped).tolist():
            of = np.arange(upto[k], upto[k + 1])[~gone[upto[k] : upto[k + 1]]]
            kept[k] = b"\n".join(x["bytes"][s:e].tobytes() for s, e in zip(x["start"][of], x["end"][of], strict=True)).decode()
        return {"id": batch.column(0), "kept": [t or "" for t in kept], "n_lines": np.diff(upto), "n_dropped": n_dropped.astype(np.int64)}

    return base.map_arrow(rows, drop, "id long, kept string, n_lines long, n_dropped long")


def dedup(docs: DataFrame, id_col: str, text_col: str, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, kept, n_lines, n_dropped) of all documents."""
    return probed(docs, build(docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs), id_col, text_col, min_chars=min_chars)
