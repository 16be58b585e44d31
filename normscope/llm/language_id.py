"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams (1 to 3 letters within words, a blank at
word edges) in order. A text's own list is compared with each profile: every n-gram costs the
distance of its two places, or the profile's length if the profile lacks it; the least sum wins.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with no labelled text
every text is ``und``; equal distances go to the language first by code point; texts of any length
are counted whole; repeated rows are judged alike, and count as often as they occur where they are learned
from; an empty table gives an empty one; other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

PLACES = 300  # length of a profile
#: Labelled rows that a language's profile is counted from, at most about; chosen by a hash of id and text.
MAX_TEXTS = 4000
_BITS = 21  # of a code point

_ALPHA: dict[str, np.ndarray] = {}


def _alpha() -> np.ndarray:
    """Whether each code point is a letter."""
    if "t" not in _ALPHA:
        _ALPHA["t"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _ALPHA["t"]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, n-gram and count of every n-gram of every text, ordered by text and n-gram. An n-gram
    is its code points, 21 bits each, the blank as 1."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) + 1 for t in low], dtype=np.int64)
    text_of = np.repeat(np.arange(len(low), dtype=np.int64), lengths)
    letter = _alpha()[points]
    edge = np.zeros(points.size, dtype=bool)
    edge[1:] = ~letter[1:] & letter[:-1]  # the first sign after a word stands for the blank
    keep = letter | edge
    c = np.where(letter, points, 0)[keep].astype(np.int64)
    of = text_of[keep]
    if not c.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # small numbers for the signs: 0 none, 1 the blank, then the letters by code point
    letters = np.flatnonzero(np.bincount(c))
    letters = letters[letters > 0]
    used = np.concatenate([[0, 1], letters])
    small = np.zeros(int(letters.max(initial=0)) + 1, dtype=np.int64)
    small[letters] = np.arange(letters.size) + 2
    small[0] = 1
    width = int(used.size - 1).bit_length()
    if 3 * width + max(1, (len(low) - 1).bit_length()) > 62 and len(low) > 1:  # many signs and many texts: halve
        half = len(low) // 2
        x, y = grams(texts[:half]), grams(texts[half:])
        return np.concatenate([x[0], y[0] + half]), np.concatenate([x[1], y[1]]), np.concatenate([x[2], y[2]])
    d = small[c]
    new_text = np.concatenate([[True], of[1:] != of[:-1]])
    before = np.concatenate([[1], d[:-1]])
    before[new_text] = 1
    after = np.concatenate([d[1:], [1]])
    after[np.append(new_text[1:], True)] = 1
    word = d > 1
    pair = (before > 1) | word
    three = ((before << 2 * width) | (d << width) | after)[word]
    top = 1 << (3 * width)
    key = np.concatenate([of[word] * top + d[word], of[pair] * top + ((before << width) | d)[pair], of[word] * top + three])
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(at, key.size))
    key = key[at]
    packed = key % top
    mask = (1 << width) - 1
    full = used[packed & mask] | (used[(packed >> width) & mask] << _BITS) | (used[(packed >> 2 * width) & mask] << 2 * _BITS)
    return key // top, full, count


def places(text_of: np.ndarray, gram: np.ndarray, count: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, n-gram and place of each text's most frequent n-grams; equal counts by n-gram."""
    if not text_of.size:
        return text_of, gram, count
    order = np.lexsort((gram, -count, text_of))
    t = text_of[order]
    start = np.searchsorted(t, t)
    place = np.arange(t.size) - start
    kept = place < limit
    return t[kept], gram[order][kept], place[kept]


@dataclass(frozen=True)
class Profiles:
    """Places of every profile's n-grams: ``rank[i, l]`` of n-gram i in language l, or PLACES."""

    languages: tuple[str, ...]
    gram: np.ndarray
    rank: np.ndarray
    limit: int = PLACES

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        t, g, place = places(*grams(texts), self.limit)
        out, score = np.full(n, "und", dtype=object), np.zeros(n)
        if not t.size or not k:
            return out.tolist(), score
        at = np.minimum(np.searchsorted(self.gram, g), self.gram.size - 1)
        known = self.gram[at] == g
        size = np.bincount(t, minlength=n)
        distance = np.empty((n, k))
        for j in range(k):
            rank = np.where(known, self.rank[at, j], self.limit)
            cost = np.where(rank < self.limit, np.abs(rank - place), self.limit)
            distance[:, j] = np.bincount(t, weights=cost, minlength=n)
        some = size > 0
        best = distance.argmin(axis=1)
        out[some] = np.array(self.languages, dtype=object)[best[some]]
        score[some] = 1 - distance.min(axis=1)[some] / (self.limit * size[some])
        return out.tolist(), np.clip(score, 0, 1)


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, *, max_texts: int = MAX_TEXTS, limit: int = PLACES) -> Profiles:
    """Profiles of all labelled texts of ``df``, at most about ``max_texts`` for each language. A
    language set is small by nature: its profiles are what every worker holds."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(1.0)
    for lang, n in sorted(sizes.items()):
        if n > max_texts:
            share = F.when(F.col("lang") == lang, F.lit(max_texts / n)).otherwise(share)
    chosen = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share

    def run(batches):
        for whole in batches:
            for batch in base.cut(whole, 1 << 20):
                langs = batch.column(1).to_pylist()
                names = sorted(set(langs))
                t, g, n = grams(batch.column(0).to_pylist())
                lang_of = np.array([names.index(x) for x in langs])[t] if t.size else t
                for k, name in enumerate(names):
                    own = lang_of == k
                    gram, inverse = np.unique(g[own], return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * gram.size, pa.string()), pa.array(gram), pa.array(np.bincount(inverse, weights=n[own]).astype(np.int64) if gram.size else gram)],
                        names=["lang", "gram", "n"],
                    )

    counts = rows.where(chosen).select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < limit).select("lang", "gram", "place").toPandas()
    languages = tuple(sorted(top["lang"].unique()))
    gram = np.sort(top["gram"].unique()).astype(np.int64)
    rank = np.full((max(1, gram.size), len(languages)), limit, dtype=np.int32)
    if len(top):
        index = {x: i for i, x in enumerate(languages)}
        rank[np.searchsorted(gram, top["gram"].to_numpy()), [index[x] for x in top["lang"]]] = top["place"].to_numpy()
    return Profiles(languages, gram if gram.size else np.zeros(1, np.int64), rank, limit)


def identify(df: DataFrame, profiles: Profiles, id_col: str, text_col: str) -> DataFrame:
    """(id, lang_pred, score) of every row."""

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        lang, score = profiles.predict(base.texts(batch, "text"))
        return {"id": batch.column(0), "lang_pred": lang, "score": score}

    return base.map_arrow(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "id long, lang_pred string, score double", max_bytes=1 << 20
    )


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
