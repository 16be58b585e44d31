"""URL filters: host and path rules, then a ratio of character language models, all in DataFrame functions.

Two variable-order Markov models, of accepted and of rejected URLs, give each character a
probability after its context: Witten-Bell smoothing mixes a context's counts with the next shorter
context's, down to a uniform start, and contexts seen fewer than ``min_seen`` times in both classes
stay unused. Models are counted by Spark aggregations over all labelled rows, each distinct URL
as often as it comes. They travel as one table of a
fixed size. The log-likelihood difference over the length is compared with a threshold calibrated
on all labelled URLs, and the error left there is reported (each class counting as half). A caller of ``learn`` may ask for
models of a bounded number of rows: then each distinct URL counts by its share, the fraction rounded by a hash.

Edge cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is judged by
its characters (none: a difference of 0); without labelled URLs of both classes the threshold is
minus infinity, so the method allows; of thresholds that are equally good the least is taken, and a difference equal to it allows; an empty table gives an
empty one; repeated rows are judged alike; other columns are neither read nor returned by ``judge``, and ``score`` keeps
them whatever their names. URLs of any length are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters with a number of their own; all others share the next number, after 0 for the start.
ALPHABET = LOWER + "0123456789./:-_?=&%#~+@"
SIGNS = len(ALPHABET) + 2
#: Scores are added up in so many bins a unit before they are ordered inside each bin.
BINS = 256


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The query's rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def first_rule(host_: Column, path_: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host_ == r.host) | F.endswith(host_, F.lit("." + r.host))) & F.startswith(path_, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def signs(url: Column) -> Column:
    """The numbers of a URL's characters, A to Z as a to z."""
    characters = F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "")
    number = lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c)).otherwise(F.lit(SIGNS - 1))
    return F.transform(F.filter(characters, lambda c: c != ""), number)


class MarkovRatio:
    """The table (code, d) of log-probability differences for two signs of context, in billionths,
    and the threshold. The table has SIGNS ** 3 rows, whatever the data, and so is broadcast."""

    def __init__(self, table: DataFrame, threshold: float, error: float | None = None):
        self._table, self.threshold, self.error = table, threshold, error

    def score(self, df: DataFrame, url_col: str = "url") -> DataFrame:
        """``df`` with ``difference``: log-likelihood difference over the length, 0 for no characters.
        One row for each character inside a task, summed before rows are exchanged; whole numbers
        make the sums the same in any order."""
        kept = [F.col(f"`{c}`") for c in df.columns]
        row, n, code, total, size, key, d = base.free_names(df, "row", "numbers", "code", "total", "size", "key", "log_ratio")
        at = lambda i: F.element_at(F.col(n), i)
        number = lambda i: (at(i) * SIGNS + at(i + 1)) * SIGNS + at(i + 2)
        codes = F.when(F.size(n) > 2, F.transform(F.sequence(F.lit(1), F.greatest(F.size(n) - 2, F.lit(1))), number))
        numbered = df.withColumns({row: F.monotonically_increasing_id(), n: F.concat(F.array(F.lit(0), F.lit(0)), signs(F.col(url_col)))})
        table = F.broadcast(self._table.select(F.col("code").alias(key), F.col("d").alias(d)))
        joined = numbered.select(row, *kept, F.explode_outer(codes).alias(code)).join(table, F.col(code) == F.col(key), "left")
        summed = joined.groupBy(row, *kept).agg(F.sum(d).alias(total), F.count(code).alias(size))
        mean = F.when(F.col(size) > 0, F.col(total) / F.col(size) / 1e9).otherwise(F.lit(0.0))
        return summed.select(*kept, _billionths(mean).alias("difference"))


def _billionths(x: Column) -> Column:
    """Rounded as SQL does: the product, not the decimal form, tells halves."""
    return F.round(x * 1e9) / 1e9


def learn(labelled: DataFrame, *, max_labelled: int | None = None, min_seen: int = 4) -> MarkovRatio:
    """From (url, accepted boolean). With ``max_labelled``, the models are counted from at most about so many rows of each
    class; the threshold comes from all rows either way."""
    known = labelled.where("url IS NOT NULL AND accepted IS NOT NULL")
    known = base.stored(known.groupBy("url", "accepted").agg(F.count(F.lit(1)).alias("n_rows")), "url-labelled")
    sizes = {r["accepted"]: r["n"] for r in known.groupBy("accepted").agg(F.sum("n_rows").alias("n")).collect()}
    sample = known if max_labelled is None else base.stored(_thinned(known, sizes, max_labelled), "url-sample")
    table = base.stored(_table(sample, min_seen), "url-model")
    ratio = MarkovRatio(table, float("-inf"))
    if len(sizes) < 2:
        return ratio
    # the threshold that tells most labelled URLs apart, each class counting as half
    n_of = lambda accepted: F.sum(F.when(accepted, F.col("n_rows")).otherwise(F.lit(0)))
    scored = ratio.score(known).withColumnRenamed("difference", "d").groupBy("d").agg(n_of(F.col("accepted")).alias("good"), n_of(~F.col("accepted")).alias("bad"))
    scored = base.stored(scored.withColumn("bin", F.floor(F.col("d") * BINS)), "url-scores")
    from pyspark.sql import Window

    # one task orders the bins, some thousands whatever the data; each bin orders its own scores
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("bin").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    bins = scored.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    bins = bins.select("bin", summed("good", upto).alias("good_upto"), summed("bad", upto).alias("bad_upto"))
    worth = (F.col("bad_upto") + summed("bad", inside)) / F.lit(max(1, sizes[False])) - (F.col("good_upto") + summed("good", inside)) / F.lit(max(1, sizes[True]))
    best = scored.join(bins, "bin").select("d", _billionths(worth).alias("worth")).orderBy(F.desc("worth"), "d").first()
    if best and best["worth"] > 0:
        ratio.threshold, ratio.error = best["d"], (1 - best["worth"]) / 2
    return ratio


def _thinned(known: DataFrame, sizes: dict[bool, int], max_labelled: int) -> DataFrame:
    """About ``max_labelled`` rows of each class, every URL by its rows."""
    share = lambda k: F.lit(min(1.0, max_labelled / max(1, sizes.get(k, 0))))
    due = F.col("n_rows") * F.when(F.col("accepted"), share(True)).otherwise(share(False))
    more = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < due - F.floor(due)
    return known.select("url", "accepted", (F.floor(due) + more.cast("long")).alias("n_rows")).where("n_rows > 0")


def _table(sample: DataFrame, min_seen: int) -> DataFrame:
    """(code, d): log P(c | ab, accepted) - log P(c | ab, rejected) for code (a * SIGNS + b) * SIGNS + c."""
    numbers = F.concat(F.array(F.lit(0), F.lit(0)), signs(F.col("url")))
    triples = sample.select("accepted", "n_rows", numbers.alias("n")).select("accepted", "n_rows", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("n") - 2, F.lit(0)) + F.lit(0)),
        lambda i: F.when(i <= F.size("n") - 2, F.struct(F.element_at("n", i).alias("a"), F.element_at("n", i + 1).alias("b"), F.element_at("n", i + 2).alias("c"))),
    )).alias("t")).where("t IS NOT NULL").select("accepted", "n_rows", "t.*")
    n_of = lambda accepted: F.sum(F.when(accepted, F.col("n_rows")).otherwise(F.lit(0)))
    count = triples.groupBy("a", "b", "c").agg(n_of(F.col("accepted")).alias("n1"), n_of(~F.col("accepted")).alias("n0"))
    spark = sample.sparkSession
    # every context and sign of the fixed alphabet: a table of fixed size
    grid = spark.range(SIGNS**3).select(
        F.floor(F.col("id") / SIGNS**2).cast("int").alias("a"), (F.floor(F.col("id") / SIGNS) % SIGNS).cast("int").alias("b"), (F.col("id") % SIGNS).cast("int").alias("c")
    )
    seen = grid.join(count, ["a", "b", "c"], "left").na.fill(0, ["n1", "n0"])
    one = seen.groupBy("b", "c").agg(F.sum("n1").alias("m1"), F.sum("n0").alias("m0"))
    zero = seen.groupBy("c").agg(F.sum("n1").alias("k1"), F.sum("n0").alias("k0"))
    context_2 = seen.groupBy("a", "b").agg(*[f(f"n{k}").alias(f"{n}{k}") for k in (1, 0) for n, f in (("s2_", F.sum), ("t2_", lambda c: F.count_if(F.col(c) > 0)))])
    context_1 = one.groupBy("b").agg(*[f(f"m{k}").alias(f"{n}{k}") for k in (1, 0) for n, f in (("s1_", F.sum), ("t1_", lambda c: F.count_if(F.col(c) > 0)))])
    context_0 = zero.agg(*[f(f"k{k}").alias(f"{n}{k}") for k in (1, 0) for n, f in (("s0_", F.sum), ("t0_", lambda c: F.count_if(F.col(c) > 0)))])
    totals = context_0.first().asDict()  # four numbers
    rows = seen.join(one, ["b", "c"]).join(zero, "c").join(context_2, ["a", "b"]).join(context_1, "b")
    logs = []
    for k in (1, 0):
        low = (F.col(f"k{k}") + F.lit(totals[f"t0_{k}"] or 0) / SIGNS + F.lit(1.0) / SIGNS) / F.lit((totals[f"s0_{k}"] or 0) + (totals[f"t0_{k}"] or 0) + 1.0)
        mid = F.when(F.col("s1_1") + F.col("s1_0") >= min_seen, (F.col(f"m{k}") + F.col(f"t1_{k}") * low + low) / (F.col(f"s1_{k}") + F.col(f"t1_{k}") + 1.0)).otherwise(low)
        high = F.when(F.col("s2_1") + F.col("s2_0") >= min_seen, (F.col(f"n{k}") + F.col(f"t2_{k}") * mid + mid) / (F.col(f"s2_{k}") + F.col(f"t2_{k}") + 1.0)).otherwise(mid)
        logs.append(F.log(high))
    place = (F.col("a") * SIGNS + F.col("b")) * SIGNS + F.col("c")
    return rows.select(place.cast("int").alias("code"), F.round((logs[0] - logs[1]) * 1e9).cast("long").alias("d"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, MarkovRatio]:
    """(id, host, path, rule, verdict, difference) of every row; the rules' own verdicts are the
    labels that the models learn from."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = rows.withColumn("by_rule", first_rule(F.col("host"), F.col("path"), rules))
    ratio = learn(rows.where("by_rule IS NOT NULL").select("url", (F.col("by_rule.verdict") == "allow").alias("accepted")))
    by_method = F.when(F.col("difference") >= F.lit(ratio.threshold), "allow").otherwise("block")
    return ratio.score(rows).select(
        "id", "host", "path", F.col("by_rule.rule").alias("rule"),
        F.coalesce(F.col("by_rule.verdict"), by_method).alias("verdict"), "difference",
    ), ratio
