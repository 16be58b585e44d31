"""Product codes of vectors in whole numbers, their nearest entries found by partial distances.

A vector's components become floor(1024 * x) and are cut into parts, each coded by the nearest of a codebook's entries. The
search takes a part's dimensions in descending variance of the codebook. Each dimension adds its squared difference; entries whose sum strictly
exceeds the current best complete distance are masked out, so ties live on and go to the lowest entry. The best complete distance
is that of the entries which led after some of the dimensions.

Codebooks are learned by rounds of assignment and floored means. Each batch leaves one row of sums for each entry it uses, Spark adds them,
and the driver holds the codebooks alone (parts x entries rows). All sums are whole numbers: results don't depend on partitioning.

Edge cases: rows whose vector is null or holds null, NaN or infinite components go. So do empty vectors, those of another length than the
kept row with the smallest id (and among equal ids the least vector) has, and those with a component so large that a distance might not fit a
long: beyond sqrt(2**62 / length) / 2 after scaling. A length that the parts don't divide is filled with zeros. Of equal ids all rows count. Rows with null ids
are coded, but start no entry. Fewer rows than entries give smaller codebooks; empty tables give empty ones.
Other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Dimensions, from 0, after which the distance of the entry that leads is completed.
_COMPLETED = (1, 3, 7)
_FAR = np.iinfo(np.int64).max
#: Rows of a label are added up in so many places, and its sum meets them in as many.
SALTS = 16


def whole(values: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of usable vectors, and their components in whole numbers, as one array for each length: see the edge cases."""
    values = values.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(values.type) or values.type.value_type != pa.float64() else values
    sizes = np.where(values.is_null().to_numpy(zero_copy_only=False), 0, values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = values.flatten()  # without what null lists hide
    x = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False) * SCALE)
    bound = np.sqrt(2.0**62 / np.maximum(sizes, 1)) / 2
    bad = ~(np.abs(x) <= np.repeat(bound, sizes))
    upto = np.concatenate([[0], np.cumsum(bad)])
    ends = np.cumsum(sizes)
    good = np.flatnonzero((upto[ends] == upto[ends - sizes]) & (sizes > 0))
    return good, [x[ends[k] - sizes[k] : ends[k]].astype(np.int64) for k in good.tolist()]


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, x: array<long>) of the usable rows, of whatever length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))

    def usable(batch: pa.RecordBatch) -> dict[str, object]:
        good, x = whole(batch.column(2))
        return {"id": batch.column(0).take(pa.array(good)), "label": batch.column(1).take(pa.array(good)), "x": x}

    return base.map_arrow(rows, usable, f"id long, label {rows.schema['label'].dataType.simpleString()}, x array<long>")


class Codebooks:
    """Entries (part, entry, component) of whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        spread = entries.astype(float).var(axis=1) if entries.size else np.zeros((entries.shape[0], entries.shape[2]))
        self.order = np.argsort(-spread, axis=1, kind="stable")

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, of equal ones the lowest, and its squared distance. Masks lie over all rows and entries
        until an eighth of them is left at most; from then on the pairs that are left are listed."""
        book, order = self.entries[part], self.order[part].tolist()
        at = np.arange(len(x))
        partial, alive, listed = np.zeros((len(x), len(book)), dtype=np.int64), np.ones((len(x), len(book)), dtype=bool), None
        best = np.full(len(x), _FAR)
        for k, d in enumerate(order):
            if listed is None:
                away = x[:, d, None] - book[None, :, d]
                away *= away
                partial += away
                if k in _COMPLETED:  # the complete distance of the least partial one
                    lead = np.where(alive, partial, _FAR).argmin(axis=1)
                    best = np.minimum(best, ((x - book[lead]) ** 2).sum(axis=1))
                if k >= _COMPLETED[0]:
                    alive &= partial <= best[:, None]
                    if 8 * np.count_nonzero(alive) <= alive.size:
                        listed = np.nonzero(alive)
                        total = partial[listed]
            else:
                row, entry = listed
                total = total + (x[row, d] - book[entry, d]) ** 2
                going = total <= best[row]
                listed, total = (row[going], entry[going]), total[going]
        if listed is None:
            partial = np.where(alive, partial, _FAR)
            found = partial.argmin(axis=1)
            return found, partial[at, found]
        row, entry = listed
        least = np.minimum.reduceat(total, np.searchsorted(row, at))
        hits = np.flatnonzero(total == least[row])
        return entry[hits[np.searchsorted(row[hits], at)]], least

    def assign(self, x: np.ndarray, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(codes by row and part, squared distance summed over the parts)."""
        parts, _, width = self.entries.shape
        codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
        for lo in range(0, len(x), rows):
            for p in range(parts):
                code, far = self.nearest(p, x[lo : lo + rows, p * width : (p + 1) * width])
                codes[lo : lo + rows, p] = code
                error[lo : lo + rows] += far
        return codes, error

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _table(x: pa.Array, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors of the one length, and their components as a table filled up to ``width``."""
    sizes = x.value_lengths().to_numpy(zero_copy_only=False)
    of = np.flatnonzero(sizes == length)
    flat = x.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((of.size, width), np.int64)
    out[:, :length] = flat.reshape(of.size, length)
    return of, out


def learn(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int] | None:
    """The codebooks of ``prepared`` rows after all rounds, and the length of their vectors; None without rows."""
    first = rows.where(F.col("id").isNotNull()).orderBy("id", "x").limit(1).collect() or rows.orderBy("x").limit(1).collect()
    if not first:
        return None
    length = len(first[0]["x"])
    each = math.ceil(length / parts)
    start = rows.where(F.col("id").isNotNull() & (F.size("x") == length)).orderBy("id", "x").limit(entries).select("x").collect()
    start = start or first  # ids are all null
    table = np.zeros((len(start), parts * each), np.int64)
    table[:, :length] = [r["x"] for r in start]
    books = Codebooks(np.ascontiguousarray(table.reshape(len(start), parts, each).transpose(1, 0, 2)))
    for _ in range(rounds):

        def sums(batch: pa.RecordBatch, books: Codebooks = books) -> dict[str, object]:
            _, x = _table(batch.column(0), length, parts * each)
            codes, _ = books.assign(x)
            n_entries = books.entries.shape[1]
            slot = codes + np.arange(parts) * n_entries
            n = np.bincount(slot.ravel(), minlength=parts * n_entries)
            total = np.zeros((parts * n_entries, each), np.int64)
            np.add.at(total, slot.ravel(), x.reshape(-1, each))
            used = np.flatnonzero(n)
            return {"slot": used, "n": n[used], **{f"s{d}": total[used, d] for d in range(each)}}

        columns = ", ".join(["slot long", "n long", *[f"s{d} long" for d in range(each)]])
        added = base.map_arrow(rows.select("x"), sums, columns).groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(each)])
        moved = books.entries.reshape(-1, each).copy()
        for r in added.collect():  # parts x entries rows at most
            moved[r["slot"]] = [r[f"s{d}"] // r["n"] for d in range(each)]
        books = Codebooks(moved.reshape(books.entries.shape))
    return books, length


def coded(rows: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """(id, label, code: two hex digits for each part, error) of ``prepared`` rows."""

    def assign(batch: pa.RecordBatch) -> dict[str, object]:
        of, x = _table(batch.column(2), length, books.entries.shape[0] * books.entries.shape[2])
        codes, error = books.assign(x)
        of = pa.array(of)
        return {"id": batch.column(0).take(of), "label": batch.column(1).take(of), "code": ["".join(f"{c:02x}" for c in r) for r in codes.tolist()], "error": error}

    return base.map_arrow(rows, assign, f"id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def with_label_error(found: DataFrame) -> DataFrame:
    """``found`` with ``label_error``, its errors summed over equal labels. A hot label is many keys: its rows are dealt out by a salt."""
    key = F.struct(F.col("label").isNull().alias("none"), F.col("label"))
    sums = found.groupBy(F.hash("label").alias("h"), F.to_json(key).alias("key")).agg(F.sum("error").alias("label_error"))
    sums = sums.select("h", "key", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = found.withColumns({"h": F.hash("label"), "key": F.to_json(key), "salt": F.pmod(F.hash("id", "code"), F.lit(SALTS))})
    return rows.join(sums, ["h", "key", "salt"]).select("id", "label", "code", "error", "label_error")


def compress(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, label_error) of the usable rows, and the codebooks."""
    spark = vectors.sparkSession
    rows = base.stored(prepared(vectors, id_col, vector_col, label_col), "vectors")
    learned = learn(rows)
    if learned is None:
        kind = rows.schema["label"].dataType.simpleString()
        return spark.createDataFrame([], f"id long, label {kind}, code string, error long, label_error long"), None
    found = base.stored(coded(rows, *learned), "codes")
    base.discard(rows)
    return with_label_error(found), learned[0]
