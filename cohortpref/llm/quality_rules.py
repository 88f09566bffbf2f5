"""Quality rules: a decision list learnt by sequential covering, applied as one Spark conditional expression.

Every document gets a few statistics, computed on the executors over its whole text. From labelled documents the list
is grown rule by rule: a rule is a conjunction of thresholds; conditions are added while they raise the FOIL gain on the
growing part, then dropped from the end while that does not lower the worth on the pruning part, and the rows a rule
covers leave the training set before the next one is grown. The result is an ordered list `if a <= x and b > y then
bad`, emitted as nested CASE WHEN over the statistics, so applying it needs no Python.

Results for odd input: a null or empty text has all counts 0 and fails the base rule; repeated rows are judged one by
one; an empty table gives an empty table; without labels the list is empty and only the base rule decides. Other columns
of the input, also ones named like a statistic, are ignored by `statistics` except those asked for in `keep`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpref.llm.common import Aside, words_of

SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_alpha_words", "n_distinct_words", "longest_word", "n_digits", "n_end_marks", "n_urls")
STATS = COUNTS + EXTRA
# At most so many labelled documents are taken for the fit (chosen by a hash of the id): the only sampled step.
FIT_ROWS = 40_000
MAX_RULES = 12
MAX_CONDITIONS = 4
CANDIDATES = 32  # thresholds tried per feature: quantiles of the rows that are left
MIN_COVER = 8  # rows a rule must cover in the growing part
MIN_PRECISION = 0.75  # share of bad rows a rule must reach in the pruning part

FEATURES: dict[str, str] = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "alpha_share": "n_alpha_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "longest_word": "longest_word",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_end": "n_words / greatest(n_end_marks, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "url_share": "n_urls / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def mask(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        values = rows[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; the first that holds makes a document bad, none makes it good."""

    rules: tuple[tuple[Condition, ...], ...] = ()
    precisions: tuple[float, ...] = field(default=())

    def verdict(self) -> Column:
        """Position (from 1) of the first rule that holds, 0 when none does."""
        chain = None
        for position, rule in enumerate(self.rules, 1):
            holds = rule[0].expression()
            for condition in rule[1:]:
                holds = holds & condition.expression()
            chain = F.when(holds, position) if chain is None else chain.when(holds, position)
        return F.lit(0) if chain is None else chain.otherwise(0)


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The counts of STATS, in that order, for one whole text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    full = [line for line in text.encode("utf-8", "surrogatepass").split(b"\n") if line.split()]
    repeated = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        distinct = len(ids)
        # The pair of the first two words is renumbered before the third is added, so no product can overflow.
        pairs = np.unique(codes[:-2] * distinct + codes[1:-1], return_inverse=True)[1]
        _, group, counts = np.unique(pairs * distinct + codes[2:], return_inverse=True, return_counts=True)
        again = counts[group] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeated = int(covered.sum())
    else:
        distinct = len(set(words))
    blob = b"".join(words)
    joined = blob.decode("utf-8", "surrogatepass")
    return (
        n,
        len(joined),
        len(SYMBOLS.findall(text)),
        len(full) - len(set(full)),
        repeated,
        len(full),
        sum(map(bytes.isalpha, words)) if blob.isascii() else sum(map(str.isalpha, (w.decode("utf-8", "surrogatepass") for w in words))),
        distinct,
        max(map(len, words), default=0),
        sum(map(blob.count, (b"%d" % d for d in range(10)))),
        blob.count(b".") + blob.count(b"!") + blob.count(b"?"),
        blob.count(b"://"),
    )


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the counts of STATS, one row per row of `docs`, over the whole of its column `text`. A kept column named
    like a count gives way to it."""
    aside = Aside(docs, ("text",), keep, STATS)
    docs, keep = aside.rows, aside.keep

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(value.as_py()) for value in batch.column("text")]
            columns = [batch.column(name) for name in keep]
            columns += [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(STATS))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *STATS])

    schema = docs.select(*keep).schema
    for name in STATS:
        schema = schema.add(name, "long")
    return aside.back(docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(count, schema))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_decision_list(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DecisionList:
    """Learns from `labels` (doc_id, quality: 1 good, 0 bad) at most `fit_rows` documents that pass the base rule.
    Rows are taken where a hash of the id is below a threshold; a third of them prunes, the rest grows."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(known, "doc_id")
    total = rows.count()
    if total == 0:
        return DecisionList()
    share = min(1.0, fit_rows / total)
    bucket = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000))
    taken = (
        rows.where(bucket < int(share * 1_000_000) if share < 1 else F.lit(True))
        .select(
            (F.col("quality") == 0).alias("bad"),
            (F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0).alias("prune"),
            *[F.expr(e).cast("double").alias(name) for name, e in FEATURES.items()],
        )
        .toPandas()
    )
    taken = taken.sort_values(list(taken.columns)).reset_index(drop=True)  # the fit does not depend on row order
    columns = {name: taken[name].to_numpy() for name in FEATURES}
    return sequential_covering(columns, taken["bad"].to_numpy(), taken["prune"].to_numpy())


def sequential_covering(columns: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> DecisionList:
    left = np.ones(len(bad), bool)
    rules, precisions = [], []
    while len(rules) < MAX_RULES:
        grow_rows, prune_rows = left & ~prune, left & prune
        if (bad & grow_rows).sum() < MIN_COVER:
            break
        rule = _grow(columns, bad, grow_rows)
        rule = _prune(rule, columns, bad, prune_rows)
        if not rule:
            break
        covered = _holds(rule, columns) & left
        tested = covered & prune
        precision = (bad & tested).sum() / max(1, tested.sum())
        if tested.sum() == 0 or precision < MIN_PRECISION:
            break
        rules.append(tuple(rule))
        precisions.append(float(precision))
        left &= ~covered
    return DecisionList(tuple(rules), tuple(precisions))


def _holds(rule: list[Condition], columns: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(len(next(iter(columns.values()))), bool)
    for condition in rule:
        held &= condition.mask(columns)
    return held


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = rows.copy()
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        if n0 == 0 or p0 == 0:
            break
        best, best_gain = None, 1e-9
        for name, values in columns.items():
            cuts = np.unique(np.quantile(values[inside], np.linspace(0, 1, CANDIDATES), method="lower"))
            for cut in cuts[:-1]:
                for above in (False, True):
                    held = inside & (values > cut if above else values <= cut)
                    p1 = (bad & held).sum()
                    total = held.sum()
                    if total < MIN_COVER or p1 == 0:
                        continue
                    gain = p1 * (np.log2(p1 / total) - np.log2(p0 / (p0 + n0)))
                    if gain > best_gain:
                        best, best_gain = Condition(name, above, float(cut)), gain
        if best is None:
            break
        # The same split of these rows, with the threshold midway between the neighbouring values.
        values = columns[best.feature][inside]
        middle = (values[values <= best.threshold].max() + values[values > best.threshold].min()) / 2
        best = Condition(best.feature, best.above, float(middle))
        rule.append(best)
        inside &= best.mask(columns)
    return rule


def _prune(rule: list[Condition], columns: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> list[Condition]:
    def worth(conditions: list[Condition]) -> float:
        held = _holds(conditions, columns) & rows
        p, n = (bad & held).sum(), (~bad & held).sum()
        return (p - n) / max(1, p + n)

    best = list(rule)
    for length in range(len(rule) - 1, 0, -1):
        if worth(rule[:length]) >= worth(best):
            best = rule[:length]
    return best


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds base_failed, rule (0: none) and kept."""
    judged = stats.withColumns({"base_failed": base_failed(), "rule": rules.verdict()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def repeated_words_brute(text: str | None) -> int:
    """Plain version of n_repeat_words, for tests."""
    words = words_of(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    return len(covered)
