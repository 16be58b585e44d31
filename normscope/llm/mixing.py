"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Every source gets a target of words; each of its documents the same number of copies, target over
size of the source. Whole copies are taken as they are; the fractions are rounded dependently. Two
documents meet: probability moves between them, in inverse proportion to their sizes so that the
expected words stay, until one of the two is 0 or 1. The fraction left meets the next document.
Blocks of about ``block`` documents fold like that at once, and their fractions left over meet in
the next level's blocks, up to one document for each source: a reduction tree whose levels shrink
by the block size. So a source's words miss their target by less than one document.

Rows of one id, source and size are summed up first: the fractions of m of them are m * p together, of
which the whole part is rounded up at once and one fraction goes on, as if they had met each other first.
So an id of any share of the rows is one item, and no block holds many more than ``block``.

Which way mass moves is a hash of the two ids, so reruns agree.

Edge cases: a null text has size 0 and takes 0; texts of any length are counted whole; a null source is a
source of its own, last in order; ties in the order of capped sources go by source; an empty table gives
an empty one; rows of equal id, source and size are documents of their own, of which as many are taken as
is due to all of them; other columns are neither read nor returned (``taken`` returns them as they are, whatever their names).
The targets are planned in one task, with a row of a few numbers for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK = 64
_SALT = 0x5EED


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, source_size, ...): one row for each source with its target. Weights repeat over the
    sources by code point, null last. A target is at most ``most`` times the source's size; what is
    above is shared by weight among the others, until none is above: with the sources ordered by
    cap over weight, a beginning of them is capped, and the rest gets the same level each weight."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = share * F.sum(F.col("source_size").cast("double")).over(every)
    level = (total - capped) / weight_left
    is_capped = F.col("cap") <= level * F.col("weight")
    rows = rows.withColumns({"level": level, "is_capped": is_capped})
    final = F.min(F.when(~F.col("is_capped"), F.struct("cap_by_weight", "level"))).over(every)["level"]
    rows = rows.withColumn("cap_by_weight", F.col("cap") / F.col("weight"))
    return rows.withColumn("target", F.when(F.col("is_capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * final))).drop(
        "level", "is_capped", "cap_by_weight", "cap", "weight"
    )


def _unit(*keys: Column | int) -> Column:
    """A number in [0, 1) from the hash of the keys."""
    hashed = F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys])
    return F.pmod(hashed, F.lit(1 << 52)).cast("double") / float(1 << 52)


def _fold(items: Column, level: int) -> Column:
    """One block's pass: struct<left: the fractional document or null, done: documents with their
    rounding ``up`` 0 or 1>. An item is struct<key, id, size, p, ...>."""

    def meet(state: Column, b: Column) -> Column:
        a = state["left"]
        rate = b["size"].cast("double") / a["size"].cast("double")
        # a up and b down by alpha, or a down and b up by beta, in a's probability
        alpha = F.least(1 - a["p"], b["p"] * rate)
        beta = F.least(a["p"], (1 - b["p"]) * rate)
        first = _unit(a["key"], b["key"], a["size"], b["size"], level + _SALT) * (alpha + beta) < beta
        pa = F.when(first, a["p"] + alpha).otherwise(a["p"] - beta)
        pb = F.when(first, b["p"] - alpha / rate).otherwise(b["p"] + beta / rate)
        a_done = (pa <= 1e-9) | (pa >= 1 - 1e-9)
        b_done = (pb <= 1e-9) | (pb >= 1 - 1e-9)
        a2, b2 = a.withField("p", pa), b.withField("p", pb)
        rounded = lambda x, p: x.withField("p", F.when(p >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)))
        left = F.when(a_done & b_done, F.lit(None)).when(a_done, b2).otherwise(a2)
        done = F.when(a_done & b_done, F.array(rounded(a2, pa), rounded(b2, pb))).when(a_done, F.array(rounded(a2, pa))).otherwise(F.array(rounded(b2, pb)))
        return F.struct(left.alias("left"), F.concat(state["done"], done).alias("done"))

    start = F.struct(F.element_at(items, 1).alias("left"), F.slice(items, 1, 0).alias("done"))
    none = lambda state, b: F.struct(b.alias("left"), state["done"].alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, lambda state, b: F.when(state["left"].isNull(), none(state, b)).otherwise(meet(state, b)))


def round_fractions(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """From (source, n_source, key, id, size, p, ...) with p in (0, 1) and size over 0: the same rows
    with p rounded to 0 or 1. Every level is one shuffle of blocks of about ``block`` rows and is
    written to shared storage; the next has one row for each block."""
    most = rows.agg(F.max("n_source")).first()[0]
    if most is None:
        return rows
    kept = [c for c in rows.columns if c not in ("source", "n_source")]
    # inside a block the largest come first, so that smaller documents settle what they leave
    blocks = F.ceil(F.col("n_source") / block)
    now = rows.withColumn("block", F.pmod(F.xxhash64("key", "size", F.lit(_SALT)), blocks))
    done, n, level = [], most, 0
    while True:
        last = n <= 1
        groups = now.groupBy("source", "block").agg(
            F.first("n_source").alias("n_source"), F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), *kept))).alias("items")
        )
        folded = base.stored(groups.select("source", "n_source", "block", _fold(F.col("items"), level).alias("f")), "mix")
        done.append(folded.select("source", "n_source", F.explode("f.done").alias("x")))
        left = folded.where("f.left IS NOT NULL").select("source", "n_source", "block", F.col("f.left").alias("x"))
        n_blocks = math.ceil(n / block)
        if n_blocks <= 1 or last:
            # one document of the source is left: by its own probability
            up = F.when(_unit(F.col("x.key"), level + _SALT) < F.col("x.p"), F.lit(1.0)).otherwise(F.lit(0.0))
            done.append(left.select("source", "n_source", F.col("x").withField("p", up).alias("x")))
            break
        now = left.select("source", "n_source", F.floor(F.col("block") / block).alias("block"), *[F.col(f"x.{c}").alias(c) for c in kept])
        n, level = n_blocks, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("source", "n_source", *[F.col(f"x.{c}").alias(c) for c in kept])


def _planned(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, block: int) -> DataFrame:
    """(id, source, size, source_size, target, rows, whole, up): one row for all rows of equal id, source and
    size, of which every one is taken ``whole`` times and ``up`` once more."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), base.n_words(F.col(text_col)).alias("size"))
    sized = base.stored(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count_if(F.col("size") > 0).alias("n_source"))
    planned = base.stored(targets(sources, weights, share, most), "mix-targets")
    # as many rows as sources: sent to every task where that is small, else joined by shuffles
    # whose partitions of one source are split by a salt
    if planned.count() <= 5000:
        joined = sized.join(F.broadcast(planned), sized["source"].eqNullSafe(planned["source"])).drop(planned["source"])
    else:
        salts = 64
        right = planned.withColumnRenamed("source", "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = sized.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        joined = left.join(right, left["source"].eqNullSafe(right["s"]) & (left["salt"] == right["salt"])).drop("salt", "s")
    copies = F.least(F.lit(most), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    mass = F.col("rows") * (copies - F.col("whole"))
    items = joined.withColumn("whole", F.floor(copies + 1e-9)).withColumn("up", F.when(F.col("size") > 0, F.floor(mass + 1e-9)).otherwise(F.lit(0)))
    items = items.withColumn("p", mass - F.col("up")).withColumn("key", F.xxhash64("id", "size", F.lit(_SALT)))
    fractional = (F.col("p") > 1e-9) & (F.col("size") > 0)
    columns = ["id", "source", "size", "source_size", "target", "rows", "whole", "up"]
    rounded = round_fractions(items.where(fractional).select("source", "n_source", "key", "id", "size", "p", "rows", "whole", "up", "source_size", "target"), block)
    return items.where(~fractional).select(columns).unionByName(rounded.withColumn("up", (F.col("up") + F.col("p")).cast("long")).select(columns))


CHUNK = 1000


def _repeated(rows: DataFrame, n: str, name: str, *, dealt: bool) -> DataFrame:
    """Every row ``n`` times with its place from 0 as ``name``. A row of more than CHUNK is dealt out by chunks
    over all tasks; ``dealt`` says whether there are such."""
    (chunk,) = base.free_names(rows, "chunk")
    place = lambda first, count: F.explode(F.sequence(first, first + count - 1))
    few = rows.where(F.col(n).between(1, CHUNK)).withColumn(name, place(F.lit(0).cast("long"), F.col(n).cast("long")))
    if not dealt:
        return few
    many = rows.where(F.col(n) > CHUNK).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))))
    first = F.col(chunk) * CHUNK
    many = many.repartition(chunk).withColumn(name, place(first, F.least(F.lit(CHUNK), F.col(n) - first))).drop(chunk)
    return few.unionByName(many)


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row."""
    plan = base.stored(_planned(df, id_col, text_col, source_col, weights, share, most, block), "mix-plan")
    each = _repeated(plan, "rows", "place", dealt=plan.where(F.col("rows") > CHUNK).limit(1).count() > 0)
    copies = F.col("whole") + (F.col("place") < F.col("up")).cast("long")
    return each.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _whole_row(df: DataFrame) -> Column:
    """A hash of all columns. Hashes skip nulls, so it is said which columns are null; nested ones go as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    held = [F.to_json(F.struct(f"`{f.name}`"), {"ignoreNullFields": "false"}) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*held, *[F.col(f"`{c}`").isNull() for c in df.columns])


def taken(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: every row of ``df`` as often as it is taken, with its columns as they are. Rows are
    told apart by a 64-bit hash of all their columns (two of n rows share one with a chance of n * n / 2**65);
    wholly equal rows share the sum of their copies."""
    key, id_, n, place = base.free_names(df, "row_key", "row_id", "row_copies", "row_place")
    keyed = df.withColumn(key, _whole_row(df))
    plan = base.stored(_planned(keyed, key, text_col, source_col, WEIGHTS, 1.5, 2.0, BLOCK), "mix-plan")
    wanted = plan.select(F.col("id").alias(id_), (F.col("rows") * F.col("whole") + F.col("up")).alias(n)).where(F.col(n) > 0)
    facts = plan.agg(F.max("rows"), F.max(F.col("rows") * F.col("whole") + F.col("up")), F.count(F.lit(1))).first()
    if (facts[0] or 0) > 1:
        keyed = keyed.dropDuplicates([key])
    wanted = F.broadcast(wanted) if facts[2] <= 1_000_000 else wanted
    rows = keyed.join(wanted, F.col(key) == F.col(id_))
    return _repeated(rows, n, place, dealt=(facts[1] or 0) > CHUNK).select(*[F.col(f"`{c}`") for c in df.columns])
