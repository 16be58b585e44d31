"""N-gram Jaccard join: near-duplicate classes of texts by chosen paths.

A text's set holds the hashes of its windows of five words. Equal sets are one node. Nodes meet in
buckets: a run starts all of them at one root, and at every level a node follows each of its tokens
whose hash with the bucket's falls below 1 / (0.8 * size), 1.25 tokens on average, into the bucket
of that token; two sets follow a common token with expectation B / 0.8, B being the common share of
the larger set. Small buckets are compared by brute force; large ones are split again, up to DEPTH
levels, huge ones up to DEEPEST; what is still large then is compared whole, in blocks. Runs repeat until a pair at the
threshold meets with the target recall at DEPTH (``runs_for``; a pair that meets in huge buckets alone still does so
with 0.93). Depth and runs are the same for every size of table.

Comparing has three rounds. First every node of a bucket meets the bucket's eight leaders; the links found
give components. Buckets of one component are settled by that; other large ones are split now. Then every node
meets eight other leaders of other components. Then only nodes of different components meet, so a large group of
near copies, joined by its leaders, isn't split or compared pair by pair.
A candidate passes three filters, of which the first and the last discard nothing that reaches the threshold:
sizes and odd sketches (an odd sketch differs in no more bits than the sets do in windows), first of 256 bits
beside 1-bit minwise sketches, then of two bits or more for each window; then the whole texts of the
pairs left are compared exactly. Each text is fetched once for all rounds.

Results: one row for each document with its class (the smallest id of its component), its node's
smallest id, and its number of links: other distinct texts of similarity 0.8 or more, counted
exactly inside each component by pairs of blocks. Links and components stay distributed.

Edge cases: a null or empty text is in a class of its own without links; texts of one to four words
have one window; equal texts share a node whatever their ids, so ties need no rule; a null id is kept, and its
class is a number below zero made from its text if no member has an id; where an id comes with several texts,
classes can share a smallest id, so ``keep_one`` tells them apart by their nodes; an empty table gives an empty
one; very long texts are read whole, in batches cut by bytes; other columns are neither read nor returned
(``keep_one`` returns them as they are, whatever their names). Nodes are told apart by a 64-bit hash of their
set, which two of n sets share with a chance of n * n / 2**65.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base, spans

SHINGLE = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.99
DEPTH = 3  # levels of buckets
DEEPEST = 6  # levels where a bucket is huge
LEAF = 600  # nodes of a bucket that is compared without more splitting
HUGE = 30_000  # nodes of a bucket that is split beyond DEPTH
LEADERS = 8
BLOCK = 512  # nodes of a block of a bucket in the last round
SKETCH_FROM = 100  # windows of both sets from which sketches tell enough
SKETCH_SHARE = 0.72  # of equal bits; 0.9 is the mean at the threshold, six deviations above
BROADCAST_ROWS = 1_000_000


def survival(depth: int) -> float:
    """Chance that two sets at the threshold still share a bucket after ``depth`` levels: common
    tokens followed are near Poisson with mean 1 at each."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


def runs_for(depth: int, recall: float = TARGET_RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


# ---------------------------------------------------------------- sets and paths


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The set of every text: distinct window hashes, rising, and each text's place (n + 1)."""
    raw, at = spans.blob(texts)
    n = at.size - 1
    starts, ends = spans.words(raw, at)
    word_at = np.searchsorted(starts, at)
    text_of = np.repeat(np.arange(n), np.diff(word_at))
    word = spans.hashes(raw, starts, ends)
    window, where = spans.windows(word, text_of, SHINGLE)
    of = text_of[where]
    short = np.flatnonzero((np.diff(word_at) > 0) & (np.diff(word_at) < SHINGLE))
    if short.size:
        whole = []
        for k in short.tolist():
            h = np.uint64(0x1234567)
            with np.errstate(over="ignore"):
                for x in word[word_at[k] : word_at[k + 1]]:
                    h = spans.mix(np.array([h ^ x + np.uint64(0x9E37)], dtype=np.uint64))[0]
            whole.append(h)
        window, of = np.concatenate([window, np.array(whole, np.uint64)]), np.concatenate([of, short])
    order = np.lexsort((window, of))
    window, of = window[order], of[order]
    new = np.ones(window.size, dtype=bool)
    new[1:] = (window[1:] != window[:-1]) | (of[1:] != of[:-1])
    window, of = window[new], of[new]
    return window, np.searchsorted(of, np.arange(n + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return upto[at[1:]] - upto[at[:-1]]


def sketches(window: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each set: the least hash of each of 128 bins, of which one bit is kept; an empty bin
    takes its next full neighbour's."""
    n = at.size - 1
    least = np.full((n, 128), np.uint64(0xFFFFFFFFFFFFFFFF))
    of = np.repeat(np.arange(n), np.diff(at))
    h = spans.mix(window ^ np.uint64(0xA5A5A5A5))
    cell = of * 128 + (h & np.uint64(127)).astype(np.int64)
    order = np.lexsort((h, cell))
    cell, h = cell[order], h[order]
    first = np.ones(cell.size, dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    least.reshape(-1)[cell[first]] = h[first]
    full = least != np.uint64(0xFFFFFFFFFFFFFFFF)
    place = np.where(np.concatenate([full, full], axis=1), np.arange(256), 1 << 20)
    nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :128]
    distance = nearest - np.arange(128)
    value = np.take_along_axis(least, np.where(nearest < 256, nearest % 128, 0), axis=1)
    bit = (spans.mix(value + distance.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)) & np.uint64(1)
    return np.packbits(bit.astype(np.uint8), axis=1).view(">i8").astype(np.int64)  # (n, 2)


def odd_sketches(window: np.ndarray, at: np.ndarray) -> np.ndarray:
    """256 bits of each set: whether an odd number of its windows fall on the bit."""
    n = at.size - 1
    of = np.repeat(np.arange(n), np.diff(at))
    bit = (spans.mix(window ^ np.uint64(0x3C3C3C3C)) & np.uint64(255)).astype(np.int64)
    counts = np.bincount(of * 256 + bit, minlength=256 * n).reshape(n, 256)
    return np.packbits((counts & 1).astype(np.uint8), axis=1).view(">i8").astype(np.int64)  # (n, 4)


def wide_odd_sketches(window: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``odd_sketches``, of a power of two of bits for each set, two for each window or more, 256 at least:
    all sets' sketches one after the other and each one's place. Halves of a sketch, one over the
    other by exclusive or, give the sketch of half as many bits."""
    size = np.diff(at)
    bits = 1 << np.maximum(8, np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    of = np.repeat(np.arange(size.size), size)
    h = spans.mix(window ^ np.uint64(0x6B6B6B6B)) & (bits[of] - 1).astype(np.uint64)
    odd = np.zeros(start[-1], dtype=np.uint8)
    np.bitwise_xor.at(odd, start[of] + h.astype(np.int64), 1)
    return np.packbits(odd).view(">i8").astype(np.int64), start // 64


def follow(window: np.ndarray, limit: np.ndarray | np.uint64, bucket: int) -> np.ndarray:
    """Children's buckets of the tokens that a set follows out of a bucket."""
    h = spans.mix(window ^ np.uint64(bucket))
    chosen = h[h <= limit]
    return spans.mix(chosen ^ np.uint64(0x5851F42D4C957F2D))


def _limit(size: np.ndarray) -> np.ndarray:
    share = np.minimum(1.0, 1 / (SIMILARITY * np.maximum(size, 1)))
    return np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def _root(run: int) -> int:
    return int(spans.mix(np.array([0xC0FFEE + 7919 * run], dtype=np.uint64))[0])


FACTS = ("n", "s1", "s2", "o1", "o2", "o3", "o4")
_NODES = "id long, no_id boolean, text_key long, node long, n int, s1 long, s2 long, o1 long, o2 long, o3 long, o4 long, buckets array<long>"


def _scan(df: DataFrame, runs: int) -> DataFrame:
    """``_NODES`` of every row: its node (null for an empty set), size, sketch and first buckets."""

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        window, at = shingles(batch.column("text"))
        size = np.diff(at)
        node = spans.mix(_sums(spans.mix(window), at) ^ size.astype(np.uint64)).view(np.int64)
        sketch, odd = sketches(window, at), odd_sketches(window, at)
        limit = np.repeat(_limit(size), size)
        text_of = np.repeat(np.arange(size.size), size)
        bucket, owner = [], []
        for run in range(runs):
            h = spans.mix(window ^ np.uint64(_root(run)))
            chosen = h <= limit
            bucket.append(spans.mix(h[chosen] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64))
            owner.append(text_of[chosen])
        owner_all = np.concatenate(owner)
        order = np.argsort(owner_all, kind="stable")
        offsets = np.searchsorted(owner_all[order], np.arange(size.size + 1))
        empty = size == 0
        return {
            "id": batch.column("id"), "no_id": batch.column("no_id"), "text_key": batch.column("text_key"), "node": pa.array(node, mask=empty), "n": size.astype(np.int32), "s1": sketch[:, 0], "s2": sketch[:, 1],
            "o1": odd[:, 0], "o2": odd[:, 1], "o3": odd[:, 2], "o4": odd[:, 3],
            "buckets": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(bucket)[order])),
        }

    return base.map_arrow(df, rows, _NODES, max_bytes=1 << 20)


def _with_sketches(batch: pa.RecordBatch) -> dict[str, object]:
    """Adds the set's size and wide odd sketch to (node, text)."""
    window, at = shingles(batch.column(1))
    wide, wide_at = wide_odd_sketches(window, at)
    return {"node": batch.column(0), "n": np.diff(at), "wide": pa.ListArray.from_arrays(pa.array(wide_at.astype(np.int32)), pa.array(wide)), "text": batch.column(1)}


class _Texts:
    """The text of one document of each node that is asked for, read from the documents once."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self._docs, self._nodes = docs, nodes.select("node", "id", "text_key")
        self.parts: list[DataFrame] = []

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, n, wide, text) of some nodes, beside others that were asked for before."""
        wanted = wanted.select("node").distinct()
        for part in self.parts:
            wanted = wanted.join(part.select("node"), "node", "left_anti")
        keys = base.stored(wanted.join(self._nodes, "node").select("node", F.col("id").alias("_id"), F.col("text_key").alias("_key")), "wanted")
        n = keys.count()
        if n or not self.parts:
            found = self._docs.join(_few(keys, n), (F.col("id") == F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("node", "text")
            part = base.stored(base.map_arrow(found, _with_sketches, "node long, n long, wide array<long>, text string", max_bytes=1 << 20), "texts")
            if part.count() > n:  # rows of one id and text
                part, double = base.stored(part.dropDuplicates(["node"]), "texts-once"), part
                base.discard(double)
            self.parts.append(part)
        base.discard(keys)
        return reduce(DataFrame.unionByName, self.parts)


# ---------------------------------------------------------------- buckets


def _few(df: DataFrame, n: int) -> DataFrame:
    """A table of n rows of a few numbers: broadcast where that is at most BROADCAST_ROWS."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _sized(rows: DataFrame) -> DataFrame:
    """Bucket rows with the bucket's size and a hash of its nodes; buckets of size 1 go."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("nodes_key")).where("size > 1")
    return rows.join(sizes, "bucket")


def _children(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The next level's (bucket, node) of large buckets' rows. A node's text is sent once for all its buckets."""

    def run(batches):
        for whole in batches:
            for batch in base.cut(whole, 1 << 20):
                out_bucket, out_node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                window, at = shingles(batch.column(2))
                limit = _limit(np.diff(at))
                for k, (node, buckets) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                    for b in np.asarray(buckets.values).view(np.uint64):
                        got = follow(window[at[k] : at[k + 1]], limit[k], b)
                        out_bucket.append(got.view(np.int64))
                        out_node.append(np.full(got.size, node))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_bucket)), pa.array(np.concatenate(out_node))], names=["bucket", "node"])

    grouped = rows.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # at most a few for each run
    return grouped.join(texts, "node").select("node", "buckets", "text").mapInArrow(run, "bucket long, node long").distinct()


def _once(sized: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bucket, node, size, FACTS) of bucket rows; of buckets of the same nodes, which are compared once, one stays."""
    rows = sized.groupBy("size", "nodes_key", "node").agg(F.min("bucket").alias("bucket"))
    return rows.join(nodes.select("node", *FACTS), "node").select("bucket", "node", "size", *FACTS)


def _first_meetings(rows: DataFrame) -> DataFrame:
    """The bucket rows of the first round: all of small buckets, and of a node's large ones that of the largest."""
    largest = rows.where(F.col("size") > LEAF).groupBy("node").agg(F.max(F.struct("size", "bucket")).alias("own")).select("node", "own.bucket")
    small = rows.where(F.col("size") <= LEAF)
    return small.unionByName(rows.where(F.col("size") > LEAF).join(largest, ["node", "bucket"], "left_semi").select(*rows.columns))


def _mixed(rows: DataFrame, component: DataFrame) -> DataFrame:
    """The bucket rows of buckets whose nodes aren't all of one component."""
    labelled = rows.join(component, "node", "left").withColumn("c", F.coalesce("c", "node"))
    ends = labelled.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    return rows.join(ends.where("low <> high").select("bucket"), "bucket", "left_semi")


def _split(first: DataFrame, nodes: DataFrame, component: DataFrame, texts: _Texts, depth: int) -> DataFrame:
    """(bucket, node, FACTS) of all buckets whose nodes still have to be compared: large buckets of one component
    are settled, other large ones are split, ``depth`` levels in all, huge ones further."""
    sized, done = first, []
    for level in range(1, max(depth, DEEPEST) + 1):
        most = LEAF if level < depth else HUGE if level < DEEPEST else 1 << 62
        done.append(sized.where(F.col("size") <= most))
        large = base.stored(_mixed(sized.where(F.col("size") > most).select("bucket", "node"), component), f"large-{level}")
        if not large.limit(1).count():
            break
        children = base.stored(_children(large, texts.of(large)), f"children-{level}")
        sized = base.stored(_once(_sized(children), nodes), f"level-{level + 1}")
        base.discard(large, children)
    return base.stored(reduce(DataFrame.unionByName, done).select("bucket", "node", *FACTS), "leaves")


# ---------------------------------------------------------------- pairs


def _may_link(a: str, b: str) -> Column:
    """False only far below the threshold."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    sized = F.least(n_a, n_b) >= F.greatest(n_a, n_b) * (SIMILARITY - 1e-9)
    differing = lambda *names: reduce(add, [F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in names])
    equal = 128 - differing("s1", "s2")
    return sized & (differing("o1", "o2", "o3", "o4") <= _differing(n_a, n_b)) & ((F.least(n_a, n_b) < SKETCH_FROM) | (equal >= math.floor(128 * SKETCH_SHARE)))


def _differing(n_a: Column, n_b: Column) -> Column:
    """In how many windows sets at the threshold differ: a ninth of theirs together, so no odd sketch in more bits."""
    return (n_a + n_b) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9


def _closer(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that wide odd sketches don't tell to lie below the threshold."""
    end = lambda x: texts.join(pairs.select(F.col(x).alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"w_{x}"))
    xor = lambda x, y: x.bitwiseXOR(y)
    least = F.least(F.size("w_a"), F.size("w_b"))  # sizes of sets in the ratio of 0.8 differ by one halving at most
    halved = lambda w: F.when(F.size(w) > least, F.zip_with(F.slice(w, 1, least), F.slice(w, least + 1, least), xor)).otherwise(F.col(w))
    differing = F.aggregate(F.zip_with(halved("w_a"), halved("w_b"), xor), F.lit(0), lambda total, x: total + F.bit_count(x))
    return pairs.join(end("a"), "a").join(end("b"), "b").where(differing <= _differing(F.col("n_a"), F.col("n_b"))).select("a", "b")


def _exact(batch: pa.RecordBatch) -> dict[str, object]:
    """The pairs of a batch (a, b, text_a, text_b) whose sets have a similarity of SIMILARITY or more."""
    (x, x_at), (y, y_at) = shingles(batch.column(2)), shingles(batch.column(3))
    n_x, n_y = np.diff(x_at), np.diff(y_at)
    of = np.concatenate([np.repeat(np.arange(n_x.size), n_x), np.repeat(np.arange(n_y.size), n_y)])
    window = np.concatenate([x, y])
    order = np.lexsort((window, of))
    of, window = of[order], window[order]
    twice = (of[1:] == of[:-1]) & (window[1:] == window[:-1])
    common = np.bincount(of[1:][twice], minlength=n_x.size)
    linked = pa.array(common >= SIMILARITY * (n_x + n_y - common) - 1e-9)
    return {"a": batch.column(0).filter(linked), "b": batch.column(1).filter(linked)}


def _verified(pairs: DataFrame, texts: _Texts) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of SIMILARITY or more."""
    met = base.stored(pairs, "pairs")
    known = texts.of(met.select(F.explode(F.array("a", "b")).alias("node")))
    close = base.stored(_closer(met, known), "pairs-close")
    base.discard(met)
    end = lambda x: known.join(close.select(F.col(x).alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    both = close.join(end("a"), "a").join(end("b"), "b").select("a", "b", "text_a", "text_b")
    links = base.stored(base.map_arrow(both, _exact, "a long, b long", max_bytes=1 << 20), "links-found")
    base.discard(close)
    return links


def _leader_pairs(leaves: DataFrame, turn: int, component: DataFrame | None = None) -> DataFrame:
    """Pairs of a bucket's leaders and its nodes. Leaders are the LEADERS nodes of the lowest hashes of
    this turn, so buckets that hold the same nodes mostly have the same ones. With components,
    only pairs that would join two of them."""
    rows = leaves
    if component is not None:
        rows = leaves.join(component, "node", "left").withColumn("c", F.coalesce("c", "node"))
        mixed = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size"))
        rows = rows.join(mixed.where((F.col("low") != F.col("high")) & (F.col("size") > LEADERS)).select("bucket"), "bucket")
    rows = rows.withColumn("rank", F.xxhash64("node", F.lit(turn)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("rank", "node"))
    leader = rows.withColumn("place", place).where(F.col("place") <= LEADERS).drop("place")
    test = ((F.col("y.rank") < F.col("x.rank")) | ((F.col("y.rank") == F.col("x.rank")) & (F.col("y.node") < F.col("x.node")))) & _may_link("x", "y")
    if component is not None:
        test = test & (F.col("x.c") != F.col("y.c"))
    met = rows.alias("x").join(leader.alias("y"), "bucket").where(test)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _other_pairs(leaves: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs of a bucket whose components differ. A bucket's largest component meets the other
    nodes, and those each other; large buckets' rows are dealt out by blocks."""
    rows = leaves.join(component, "node", "left").withColumn("c", F.coalesce("c", "node"))
    parts = rows.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("major"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("size")).where("parts > 1")
    mixed = mixed.select("bucket", F.col("major.c").alias("major"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = base.stored(rows.join(mixed, "bucket"), "mixed-rows")
    # a pair is met in the least of the buckets that it shares, and not again in each of them
    rows = rows.join(rows.groupBy("node").agg(F.collect_set("bucket").alias("own")), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    few = rows.where(F.col("c") != F.col("major")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = rows.withColumn("block", block)
    met = few.alias("x").join(every.alias("y"), ["bucket", "block"]).where(
        (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))) & _may_link("x", "y")
        & (F.array_min(F.array_intersect("x.own", "y.own")) == F.col("x.bucket"))
    )
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(node, c): the least node that each linked node is joined to. Nodes take their neighbours'
    least label and then that label's own, until nothing changes; paths halve at each step."""
    both = base.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = base.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("c").alias("c_b")), "b").groupBy("a").agg(F.min("c_b").alias("m"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        hooked = base.stored(hooked, "hooked")
        up = hooked.select(F.col("node").alias("parent"), F.col("c").alias("c_up"))
        after = base.stored(
            hooked.join(up, hooked["c"] == up["parent"], "left").select("node", F.least("c", F.coalesce("c_up", "c")).alias("c"), "was"), "labels"
        )
        changed = after.where("c <> was").limit(1).count()
        base.discard(labels, hooked)
        labels = after.drop("was")
        if not changed:
            base.discard(both)
            return labels


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components when more links come to known ones: each is a star, so no old link is needed."""
    out = components(component.select(F.col("node").alias("a"), F.col("c").alias("b")).where("a <> b").unionByName(links))
    base.discard(component)
    return out


#: A component of n nodes is dealt into blocks: of 128 nodes up to 8 blocks, then 8 of up to 1,024 nodes, then
#: more of 1,024; and of a million windows at most. Every pair of blocks is one group of rows.
FEW_NODES, MOST_NODES, SOME_BLOCKS, MOST_WINDOWS = 128, 1024, 8, 1 << 20


def link_counts(component: DataFrame, nodes: DataFrame, texts: _Texts) -> DataFrame:
    """(node, n_links): links of every node inside its component, by pairs of blocks of nodes. The two nodes of
    a component of two have the link that made it."""
    members = component.groupBy("c").agg(F.count(F.lit(1)).alias("members"))
    sized = base.stored(component.join(members, "c"), "component-sizes")
    several = sized.where("members > 2").select("node", "c")
    return sized.where("members = 2").select("node", F.lit(1).cast("long").alias("n_links")).unionByName(_block_counts(several, nodes, texts.of(several)))


def _block_counts(component: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    n, windows = F.count(F.lit(1)), F.sum("n")
    blocks = F.greatest(F.least(F.ceil(n / FEW_NODES), F.lit(SOME_BLOCKS)), F.ceil(n / MOST_NODES), F.ceil(windows / MOST_WINDOWS)).cast("int")
    rows = component.join(nodes.select("node", "n"), "node")
    rows = rows.join(rows.groupBy("c").agg(blocks.alias("blocks")), "c").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = rows.withColumn("other", other).select(
        "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node"
    )
    dealt = pairs.join(texts.select("node", "text"), "node").select("c", "i", "j", "second", "node", "text").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")

    def run(batches):
        key, held = None, []
        for batch in batches:
            c, i, j, second, node, text = (column.to_pylist() for column in batch.columns)
            for k in range(batch.num_rows):
                if (c[k], i[k], j[k]) != key:
                    if held:
                        yield _count_block(held, key[1] == key[2])
                    key, held = (c[k], i[k], j[k]), []
                held.append((second[k], node[k], text[k]))
        if held:
            yield _count_block(held, key[1] == key[2])

    return dealt.mapInArrow(run, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


COLUMNS = 1024  # windows that are multiplied at once


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts' sets, one set after the other, and the sets' sizes; made from about 1 MB of text at a time."""
    windows, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in base.cut(pa.RecordBatch.from_arrays([texts], names=["text"]), 1 << 20):
        window, at = shingles(part.column(0))
        windows.append(window)
        sizes.append(np.diff(at))
    return np.concatenate(windows), np.concatenate(sizes)


def _count_block(held: list[tuple[bool, int, str]], same: bool) -> pa.RecordBatch:
    """Links between the first and the second side of a pair of blocks, or inside one block."""
    windows, sizes = _sets(pa.array([x for *_, x in held], pa.string()))
    token, column = np.unique(windows, return_inverse=True)
    del windows
    often = np.bincount(column, minlength=token.size) > 1
    use = often[column]
    of = np.repeat(np.arange(len(held), dtype=np.int32), sizes)[use]
    column = (np.cumsum(often, dtype=np.int32) - 1)[column[use]]
    del token, use
    first = np.array([not s for s, *_ in held]) if not same else np.ones(len(held), bool)
    second = ~first if not same else first
    common = np.zeros((int(first.sum()), int(second.sum())), np.float32)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for at in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(held), min(COLUMNS, int(often.sum()) - at)), np.float32)
        x[of[a:b], column[a:b] - at] = 1
        common += x @ x.T if same else x[first] @ x[second].T
    union = sizes[first][:, None] + sizes[second][None, :] - common
    linked = common >= SIMILARITY * union - 1e-9
    nodes = np.array([n for _, n, _ in held], dtype=np.int64)
    if same:
        np.fill_diagonal(linked, False)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(linked.sum(axis=1).astype(np.int64))], names=["node", "n_links"])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([nodes[first], nodes[second]])), pa.array(np.concatenate([linked.sum(axis=1), linked.sum(axis=0)]).astype(np.int64))], names=["node", "n_links"]
    )


# ---------------------------------------------------------------- the join


def _own_id(id_col: str, text_col: str) -> Column:
    """A row's id, or the number made from its text where that is null."""
    return F.coalesce(F.col(id_col).cast("long"), -1 - F.pmod(F.xxhash64(text_col), F.lit(1 << 62)))


def _classified(df: DataFrame, id_col: str, text_col: str, recall: float, depth: int) -> DataFrame:
    """(id, no_id, text_key, class_key, class_id, copy_of, n_links) of every row. An id may come with several
    texts: a class is told by ``class_key``, made from its nodes, and a row's text by its hash."""
    docs = df.select(
        _own_id(id_col, text_col).alias("id"), F.col(id_col).isNull().alias("no_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")
    )
    scanned = base.stored(_scan(docs, runs_for(depth, recall)), "scanned")
    firsts = [F.first(c).alias(c) for c in (*FACTS, "buckets")]
    nodes = scanned.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("own"), *firsts)
    nodes = base.stored(nodes.select("node", "own.*", *FACTS, "buckets"), "nodes")
    texts = _Texts(docs, nodes)
    first = base.stored(_sized(nodes.select("node", F.explode(F.array_distinct("buckets")).alias("bucket"))), "level-1")
    first, sized = base.stored(_once(first, nodes), "first-meetings"), first
    component = components(_verified(_leader_pairs(_first_meetings(first), 0), texts))
    leaves = _split(first, nodes, component, texts, depth)
    base.discard(sized, first)
    for find in (lambda: _leader_pairs(leaves, 1, component), lambda: _other_pairs(leaves, component)):
        more = _verified(find(), texts)
        if more.limit(1).count():
            component = _joined(component, more)
        base.discard(more)
    base.discard(leaves)
    counts = base.stored(link_counts(component, nodes, texts), "link-counts")
    least = component.join(nodes.select("node", "id"), "node").groupBy("c").agg(F.min("id").alias("class_id"))
    known = component.join(least, "c").join(counts, "node").select("node", "c", "class_id", "n_links")
    facts = base.stored(
        nodes.select("node", F.col("id").alias("copy_of")).join(known, "node", "left")
        .select("node", F.coalesce("c", "node").alias("class_key"), "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "node-facts"
    )
    base.discard(nodes, component, counts, *texts.parts)
    rows = scanned.select("id", "no_id", "text_key", "node")
    found = rows.where("node IS NOT NULL").join(facts, "node").select("id", "no_id", "text_key", "class_key", "class_id", "copy_of", "n_links")
    alone = rows.where("node IS NULL").select(
        "id", "no_id", "text_key", F.xxhash64("id", F.lit("alone")).alias("class_key"), F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long").alias("n_links")
    )
    return found.unionByName(alone)


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, recall: float = TARGET_RECALL, depth: int = DEPTH) -> DataFrame:
    """(id, class_id, copy_of, n_links) of every row."""
    found = _classified(df, id_col, text_col, recall, depth)
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "class_id", "copy_of", "n_links")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay when every class keeps one document, that of its smallest id and, of several
    texts with that id, of the least text hash. Rows are told apart by id and text; of equal ones one stays."""
    found = base.stored(_classified(df, id_col, text_col, TARGET_RECALL, DEPTH).select("id", "text_key", "class_key"), "near-classes")
    own = F.struct("id", "text_key")
    several = found.groupBy("class_key").agg(F.min(own).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class_key", "kept")
    several = base.stored(several, "near-several")
    members = found.join(_few(several, several.count()), "class_key")
    id_, key, gone_id, gone_key = base.free_names(df, "row_id", "row_text", "gone_id", "gone_text")
    dropped = members.where(own != F.col("kept")).select(F.col("id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    dropped = base.stored(dropped, "near-dropped")
    rows = df.withColumns({id_: _own_id(id_col, text_col), key: F.xxhash64(text_col)})
    rows = rows.join(_few(dropped, dropped.count()), (F.col(id_) == F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    if members.where(own == F.col("kept")).groupBy("class_key").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates([id_, key])
    base.discard(found, several)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])
