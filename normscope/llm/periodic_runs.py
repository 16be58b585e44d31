"""Maximal periodic runs of words, by partition refinement.

Positions of equal factors of length 1 form the first classes. From length l to l + 1 a class splits by the classes of its members'
successors; only successors in classes that are new and not the largest part of their parent are looked at (smaller half), so
all lengths together move each word O(log n) times. Each class keeps its members in a segment, and each member its next one
in the text. What would follow the end splits nothing: a place stays in its class when its factor reaches the end. Such places can't lie
between the halves of a square that fits, so they hide none, and a text that repeats up to its end stops splitting. A link from i to its next member i + d that exists at length d is a square: the d words from i come twice.
Links are judged when they break or nothing splits any more: one made at length m and broken at length b held at all lengths from m to b - 1. Neighbours alone give
exactly the squares whose half isn't itself a repetition, so squares of one d at consecutive places merge into a run of
smallest period d. The lengths of a batch's documents are refined together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base, spans

MIN_WORDS = 12
#: Bytes of texts that are refined together.
BATCH_BYTES = 4 << 20


def codes(bytes_: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words alone: by hashes that are then compared byte by byte."""
    found = pa.array(spans.hashes(bytes_, starts, ends)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not found.size:
        return found
    first = np.empty(found.max() + 1, np.int64)
    first[found[::-1]] = np.arange(found.size)[::-1]
    like, size = first[found], ends - starts
    same = size == size[like]
    same[same] = spans.equal(bytes_, starts[same], starts[like[same]], size[same])
    if not same.all():
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(bytes_[s:e].tobytes(), len(known)) for s, e in zip(starts, ends, strict=True)], np.int64)
    return found


def squares(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all squares with a half that is no repetition, in texts of ``sizes`` symbols one after
    the other, each followed by one place for its end."""
    total = int(sizes.sum()) + sizes.size
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.repeat(np.arange(sizes.size), sizes + 1)
    symbol = np.empty(total, np.int64)
    is_end = np.zeros(total, dtype=bool)
    is_end[begins + sizes] = True
    top = int(symbols.max()) + 1 if symbols.size else 0
    symbol[~is_end], symbol[is_end] = symbols, top + np.arange(sizes.size)
    deepest = (sizes // 2)[text]  # a longer half doesn't fit

    ordered = np.sort(symbol * total + np.arange(total))
    member = ordered % total  # places by class, then place
    new = np.ones(total, dtype=bool)
    new[1:] = (np.diff(ordered // total) != 0) | (np.diff(text[member]) != 0)
    cls = np.empty(total, np.int64)
    cls[member] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    n_classes = at.size
    start, size = np.zeros(total, np.int64), np.zeros(total, np.int64)
    start[:n_classes], size[:n_classes] = at, np.diff(np.append(at, total))
    slot = np.empty(total, np.int64)
    slot[member] = np.arange(total)
    after, before = np.full(total, -1), np.full(total, -1)
    linked = ~new[1:]
    after[member[:-1][linked]], before[member[1:][linked]] = member[1:][linked], member[:-1][linked]
    made = np.ones(total, np.int64)  # the length at which a member's link to its next one was made
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def broken(i: np.ndarray, length: int) -> None:
        """Links from ``i`` end before ``length``."""
        d = after[i] - i
        held = (after[i] >= 0) & (made[i] <= d) & (d < length)
        if held.any():
            out.append((i[held], d[held]))

    ended = np.zeros(total, np.int64)  # members of a class whose factor passes the end
    longest = np.argsort(-sizes, kind="stable")
    halves = (sizes // 2)[longest]
    small, length = member[~is_end[member]], 1  # members of small classes, class by class and in order of place
    while small.size:
        length += 1
        of = longest[: np.searchsorted(-halves, -length, side="right")]
        ended[cls[begins[of] + sizes[of] - length + 1]] += 1  # one more place of each text, and each in a class of its text
        j = small - 1
        ok = (j >= 0) & (deepest[j] >= length)
        ok &= ~is_end[j] & (size[cls[j]] > 1)
        j = j[ok]
        if not j.size:
            break
        rank = np.sort(cls[j] * j.size + np.arange(j.size)) % j.size
        j = j[rank]  # by class, then by the successor's class, then by place
        parent, follower = cls[j], cls[j + 1]
        new = np.ones(j.size, dtype=bool)
        new[1:] = (parent[1:] != parent[:-1]) | (follower[1:] != follower[:-1])
        g_at = np.flatnonzero(new)
        g_size = np.diff(np.append(g_at, j.size))
        splits = g_size < size[parent[g_at]] - ended[parent[g_at]]
        if not splits.all():  # a class that moves as one stays as it is
            stay = np.repeat(splits, g_size)
            j, parent, g_size = j[stay], parent[stay], g_size[splits]
            g_at = np.cumsum(g_size) - g_size
            if not j.size:
                break
        g_parent = parent[g_at]
        p_new = np.ones(g_at.size, dtype=bool)
        p_new[1:] = g_parent[1:] != g_parent[:-1]
        p_at = np.flatnonzero(p_new)  # the first group of each parent
        p, p_of_group = g_parent[p_at], np.cumsum(p_new) - 1
        moved = np.add.reduceat(g_size, p_at)
        rest = size[p] - moved

        # links: members left behind pass over those that go; groups link inside themselves
        group = np.repeat(np.arange(g_at.size), g_size)
        by_place = np.sort(np.repeat(p_of_group, g_size) * total + j) % total
        chain = np.ones(by_place.size, dtype=bool)
        chain[1:] = before[by_place[1:]] != by_place[:-1]
        c_at = np.flatnonzero(chain)
        left, right = before[by_place[c_at]], after[by_place[np.append(c_at[1:], by_place.size) - 1]]
        new_after, new_before = np.full(j.size, -1), np.full(j.size, -1)
        inner = np.flatnonzero(group[1:] == group[:-1])
        new_after[inner], new_before[inner + 1] = j[inner + 1], j[inner]
        changed = after[j] != new_after
        broken(j[changed], length)
        kept = left >= 0
        broken(left[kept], length)
        after[left[kept]], made[left[kept]] = right[kept], length
        before[right[right >= 0]] = left[right >= 0]
        after[j], before[j] = new_after, new_before
        made[j[changed]] = length

        # segments: those that go fill the end of their parent's, group by group
        end_of = start[p] + size[p]
        tail = np.repeat(end_of - np.cumsum(moved), moved) + np.arange(j.size)
        front = slot[j] < np.repeat(start[p] + rest, moved)
        there = member[tail]
        order = np.argsort(j)
        found = np.minimum(np.searchsorted(j[order], there), j.size - 1)
        going = j[order][found] == there
        free, stays = slot[j[front]], there[~going]  # as many of each parent, in the order of parents
        member[free], slot[stays] = stays, free
        member[tail], slot[j] = j, tail

        # of a parent's parts all but the largest are small; places that pass the end count nowhere
        largest = np.maximum.reduceat(g_size, p_at)
        real = rest - ended[p]
        is_largest = (g_size == largest[p_of_group]) & (real < largest)[p_of_group]
        nth = np.cumsum(is_largest)
        is_largest &= (nth - np.repeat(nth[p_at] - is_largest[p_at], np.diff(np.append(p_at, g_at.size)))) == 1  # the first such
        named = ~(is_largest & (rest == 0)[p_of_group])  # what is left behind keeps the number, else the largest part
        number = np.where(named, n_classes + np.cumsum(named) - 1, g_parent)
        n_classes += int(named.sum())
        size[p[rest > 0]] = rest[rest > 0]
        start[number], size[number] = tail[g_at], g_size
        cls[j] = np.repeat(number, g_size)
        small = j[np.repeat(~is_largest, g_size)]
        lone = np.flatnonzero((real < largest) & (real > 0))  # what is left behind is small itself
        if lone.size:
            n = rest[lone]
            left = member[np.repeat(start[p[lone]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            left = left[left + length <= (begins + sizes)[text[left]]]
            small = np.concatenate([small, np.sort(cls[left] * total + left) % total])
    i = np.flatnonzero(after >= 0)
    d = after[i] - i
    held = (made[i] <= d) & (d <= deepest[i])
    out.append((i[held], d[held]))
    place, period = (np.concatenate(x) for x in zip(*out, strict=True))
    fits = place + 2 * period <= (begins + sizes)[text[place]]
    return place[fits], period[fits]


def runs(symbols: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of at least ``min_words`` and two periods, by text, start and period."""
    place, period = squares(symbols, sizes)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.ones(place.size, dtype=bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(period) != 0)
    at = np.flatnonzero(new)
    last = place[np.append(at[1:], place.size) - 1] if at.size else at
    start, period = place[at], period[at]
    length = last - start + 2 * period
    ok = length >= min_words
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.searchsorted(begins, start, side="right") - 1
    return text, start - begins[text], length, period


def detect(docs: DataFrame, id_col: str, text_col: str, *, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_words, runs: array<struct<start, length, period>> by start and period, collapsed): every text's runs, and its words less
    those that a run contains after its first period, joined by single spaces.

    Edge cases: null and empty texts have no words, no runs and an empty ``collapsed``; a text of any length is refined whole, by
    itself if it is long; rows of one id stay apart, and null ids stay null; other columns aren't looked at; empty tables give empty ones.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(batch: pa.RecordBatch) -> dict[str, object]:
        n = batch.num_rows
        bytes_, at = spans.blob(batch.column(1))
        starts, ends = spans.words(bytes_, at)
        upto = np.searchsorted(starts, at)
        sizes = np.diff(upto)
        text, start, length, period = runs(codes(bytes_, starts, ends), sizes, min_words)
        cover = np.zeros(starts.size + 1, np.int64)
        np.add.at(cover, upto[text] + start + period, 1)
        np.add.at(cover, upto[text] + start + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        n_gone = np.bincount(np.repeat(np.arange(n), sizes)[gone], minlength=n)
        collapsed = []
        for k in range(n):
            words = bytes_[at[k] : at[k + 1]].tobytes().split()  # at the same six characters
            if n_gone[k]:
                words = [words[i] for i in np.flatnonzero(~gone[upto[k] : upto[k + 1]]).tolist()]
            collapsed.append(b" ".join(words).decode())
        offsets = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
        each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(kind.value_type))
        return {"id": batch.column(0), "n_words": sizes.astype(np.int64), "runs": pa.ListArray.from_arrays(offsets, each).cast(kind), "collapsed": collapsed}

    return base.map_arrow(rows, found, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", max_bytes=BATCH_BYTES)


def planted(id_: Column, text: Column) -> Column:
    """The text with a run planted, for one id of ten: from word a on its words repeat with a period, both told by the id's checksum."""
    h = F.crc32(id_.cast("string"))
    g = F.floor(h / 10)

    def made(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

    # an outer lambda holds the words, which the inner one would find again for each place
    words = F.array(F.regexp_extract_all(text, F.lit(f"({base.words_pattern()})"), F.lit(1)))
    return F.when((h % 10 == 0) & text.rlike(base.words_pattern()), F.transform(words, made)[0]).otherwise(text)


def longest(runs_: Column) -> Column:
    """The run of greatest length; of equal ones that of smallest start, then period. Null without runs."""
    best = F.array_max(F.transform(runs_, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))
