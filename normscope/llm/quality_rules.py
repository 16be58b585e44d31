"""Quality rules: statistics of texts and a learned decision list over them.

``statistics`` measures every whole text. ``learn`` covers the labelled bad texts sequentially: a
rule is grown condition by condition for the most information on two thirds of the uncovered rows,
pruned from its end on the other third, and kept while it stays precise. ``DecisionList.expression``
gives the ordered Spark conditional.

Edge cases: a null or empty text has no words and fails the base; texts of any length are measured whole, in
batches cut by bytes; repeated rows and ids stay as they are (labels of one id are joined by their minimum, and
equal statistics of one id are learned from once); of rules that hold the first in order names the reason, and of
conditions of equal gain the first in order is grown; missing or one-sided labels give an empty list, so the base alone decides;
an empty table gives an empty one; other columns are neither read nor returned (``keep`` returns them as they are).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base, spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_adjacent", "n_lines", "n_marks")
SCHEMA = "id long, " + ", ".join(f"{c} long" for c in COUNTS)
WINDOW = 5
#: Labelled rows that a list is learned from, at most about; chosen by a hash of the id, then of the row.
MAX_LABELLED = 40_000

#: The statistics that conditions may test, as expressions over COUNTS.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "mark_share": "n_marks / word_chars",
    "capital_share": "n_capitals / word_chars",
    "repeat_share": "n_repeat_words / n_words",
    "adjacent_share": "n_adjacent / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "!?"]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text of a batch."""
    raw, at = spans.blob(texts)
    n = at.size - 1
    starts, ends = spans.words(raw, at)
    text_of = np.searchsorted(at, starts, side="right") - 1
    word_at = np.searchsorted(starts, at)
    points = (raw & 0xC0) != 0x80
    word_hash = spans.hashes(raw, starts, ends)
    window, where = spans.windows(word_hash, text_of, WINDOW)
    found = _found_twice(window, text_of[where])
    cover = np.zeros(starts.size + 1, dtype=np.int64)
    np.add.at(cover, where[found], 1)
    np.add.at(cover, where[found] + WINDOW, -1)
    adjacent = np.zeros(starts.size, dtype=bool)
    adjacent[1:] = (word_hash[1:] == word_hash[:-1]) & (text_of[1:] == text_of[:-1])
    capital = _CAPITAL[raw]
    capital[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)  # À to Þ
    # lines that have a word
    breaks = np.flatnonzero(raw == 0x0A)
    line_start = np.unique(np.concatenate([at[:-1][at[:-1] < at[1:]], breaks + 1]))
    line_start = line_start[line_start < raw.size]
    line_text = np.searchsorted(at, line_start, side="right") - 1
    next_start = np.append(line_start[1:], raw.size)
    line_end = next_start - ((raw[next_start - 1] == 0x0A) if line_start.size else 0)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_text = line_start[has_word], line_end[has_word], line_text[has_word]
    line_hash = spans.mix(spans.hashes(raw, line_start, line_end)) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(line_hash, kind="stable")
    later, before = order[1:], order[:-1]
    likely = line_hash[later] == line_hash[before]
    later, before = later[likely], before[likely]
    size = line_end - line_start
    alike = size[later] == size[before]
    alike[alike] = spans.equal(raw, line_start[later[alike]], line_start[before[alike]], size[later[alike]])
    again = np.zeros(line_hash.size, dtype=bool)
    again[later[alike]] = True
    return {
        "n_words": word_at[1:] - word_at[:-1],
        "word_chars": spans.per_text(points & ~spans.SPACE[raw], at),
        "n_symbols": spans.per_text(_SYMBOL[raw], at),
        "n_dup_lines": np.bincount(line_text[again], minlength=n),
        "n_repeat_words": spans.per_text(np.cumsum(cover[:-1]) > 0, word_at),
        "n_capitals": spans.per_text(capital, at),
        "n_adjacent": spans.per_text(adjacent, word_at),
        "n_lines": np.bincount(line_text, minlength=n),
        "n_marks": spans.per_text(_MARK[raw], at),
    }


def _found_twice(window: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Whether each window occurs twice or more in its text."""
    key = window + text_of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return np.zeros(key.size, dtype=bool)
    twice = np.unique(twice)
    place = np.minimum(np.searchsorted(twice, key), twice.size - 1)
    return twice[place] == key


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, COUNTS) of every row."""
    return base.map_arrow(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
        lambda batch: {"id": batch.column(0)} | measure(batch.column(1)),
        SCHEMA,
        max_bytes=1 << 20,
    )


def with_statistics(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` as it is, with a struct of COUNTS named ``name``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(name, StructType([StructField(c, LongType()) for c in COUNTS]))])
    at = df.columns.index(text_col)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for batch in base.cut(whole, 1 << 20):
                counts = measure(batch.column(at))
                struct = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], list(COUNTS))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), struct], schema=arrow)

    return df.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 10) | (100 * repeated > 20 * words)


def feature(name: str, prefix: str = "") -> Column:
    """A feature as a double; 0 where its divisor is 0."""
    top, _, bottom = FEATURES[name].partition(" / ")
    value = F.col(prefix + top).cast("double")
    return F.when(F.col(prefix + bottom) > 0, value / F.col(prefix + bottom)).otherwise(F.lit(0.0)) if bottom else value


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def expression(self, prefix: str = "") -> Column:
        value = feature(self.feature, prefix)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, and its place is the reason."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def expression(self, prefix: str = "") -> Column:
        """The index of the first rule that holds; null if none does."""
        out = None
        for k, rule in enumerate(self.rules):
            test = F.lit(True)
            for c in rule:
                test = test & c.expression(prefix)
            out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
        return F.lit(None).cast("int") if out is None else out

    def first(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """As ``expression``, over arrays; -1 for none."""
        n = len(next(iter(x.values())))
        out = np.full(n, -1)
        for k, rule in enumerate(self.rules):
            test = out < 0
            for c in rule:
                test &= c.holds(x)
            out[test] = k
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.95, max_rules: int = 16, max_conditions: int = 4, cuts: int = 48, seed: int = 7) -> DecisionList:
    """Sequential covering of the rows where ``bad``; a rule ends the list when it can't reach
    ``precision`` on rows that it was not grown on."""
    rules, left = [], np.ones(bad.size, dtype=bool)
    order = np.random.default_rng(seed)
    while len(rules) < max_rules and bad[left].sum() >= 5:
        grow = order.random(bad.size) < 2 / 3
        rule = _grow(x, bad, left & grow, max_conditions, cuts)
        rule = _prune(x, bad, left & ~grow, rule)
        if not rule:
            break
        covered = _holds(rule, x) & left
        hit, check = int(bad[covered].sum()), covered & ~grow
        if hit < 3 or hit < precision * covered.sum() or (check.any() and bad[check].mean() < precision):
            break
        rules.append(tuple(rule))
        left &= ~covered
    return DecisionList(tuple(rules))


def _holds(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x, bad, rows, max_conditions, cuts) -> list[Condition]:
    rule, inside = [], rows.copy()
    while len(rule) < max_conditions and (~bad[inside]).any() and bad[inside].any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, best_gain = None, 1e-9
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, cuts), method="higher")):
                for above in (True, False):
                    test = v >= t if above else v < t
                    p, n = int(y[test].sum()), int((~y[test]).sum())
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best_gain:
                            best, best_gain = Condition(name, above, float(t)), gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(x, bad, rows, rule: list[Condition]) -> list[Condition]:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on the pruning rows."""
    best, best_worth = [], -1.0
    for k in range(1, len(rule) + 1):
        test = _holds(rule[:k], x) & rows
        p, n = int(bad[test].sum()), int((~bad[test]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best_worth + 1e-12:
            best, best_worth = rule[:k], worth
    return best


def learn_from(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """From (doc_id, quality) labels of documents, quality 0 being bad: from all of them up to
    ``max_labelled``, beyond it from about that many, those whose hash of the id is lowest. So the
    chosen ids are few, whatever the table's size, and are broadcast to read their texts alone."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marks.count()
    if n > max_labelled:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    chosen = marks.select(F.col("doc_id").cast("long").alias("label_id"), "quality")
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("label_id")), F.col("id") == F.col("label_id"), "left_semi")
    stats = statistics(known, "id", "text").where(~base_failed())
    rows = stats.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("id", "quality", *[feature(f).alias(f) for f in FEATURES])
    rows = base.stored(rows.dropDuplicates(), "labelled-statistics")
    if (n := rows.count()) > 2 * max_labelled:  # ids that come with many texts
        rows = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    got = rows.toPandas()
    if not len(got):
        return DecisionList()
    got = got.sort_values(["id", *FEATURES], kind="stable")
    return learn({f: got[f].to_numpy(dtype=float) for f in FEATURES}, got["quality"].to_numpy() == 0)


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DecisionList]:
    """(id, COUNTS, base_failed, rule, kept) of every row, and the list learned."""
    rules = learn_from(df, labels, id_col, text_col)
    stats = statistics(df, id_col, text_col)
    rule = rules.expression().cast("int")
    return stats.withColumns({"base_failed": base_failed(), "rule": rule}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the base and the learned list keep, with their columns as they are."""
    rules = learn_from(df, labels, id_col, text_col)
    name = next(f"_statistics{i}" for i in range(len(df.columns) + 1) if f"_statistics{i}" not in df.columns)
    prefix = f"{name}."
    return with_statistics(df, text_col, name).where(~base_failed(prefix) & rules.expression(prefix).isNull()).select(*[F.col(f"`{c}`") for c in df.columns])
