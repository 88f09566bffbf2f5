"""Mixing sources to target weights with hash-threshold histograms.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating; together they get `factor` times all words, a
target stops at `cap` times its source's size and the excess is shared again by weight. That is water filling: every
target is min(cap * size, level * weight), and the level follows from the sources ordered by cap * size / weight.

Choice of documents: a source takes floor(target / size) whole passes and a part pass of the rest. The part pass is
the set of documents whose hash is below a threshold, found without sorting documents: words are summed per (source, top
bits of the hash), the cumulative histogram names the one bucket where the budget ends, and only the rows of that bucket
are counted again by the next bits, until the bits are used up. The thresholds are nested: a larger budget keeps what a
smaller one took. The result is a filter on the hash.

Results for odd input: a null or empty text has size 0 and takes 0; a null source is a source of its own; rows that
share a doc_id share a hash and are taken together; a null doc_id hashes as the empty text; an empty table gives an
empty table. Other columns of the input do not enter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortpref.llm.common import Aside, word_array
from cohortpref.session import snapshot

WEIGHTS = (3, 1, 2)
FACTOR = 1.5
CAP = 2
LEVEL_BITS = 12
LEVELS = 5  # 60 bits of the hash in all


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text) and hash of every row."""
    return docs.select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), doc_hash(F.col("doc_id")).alias("hash"))


def source_targets(rows: DataFrame, factor: float = FACTOR, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row per source."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows without a partition run over one row per source.
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cells = totals.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(cap)).alias("limit"))
    cells = cells.withColumn("ratio", F.col("limit") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * factor
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    cells = cells.withColumn("level", level)
    # The first source that its limit does not stop sets the level for all that follow.
    final = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything)
    target = F.coalesce(F.least(F.col("limit"), final * F.col("w")), F.col("limit"))
    return cells.select("source", "source_size", target.alias("target"))


def _same_source(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def part_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: rows with hash < threshold have at most `budget` words per source, and with the next hash
    they would exceed it, unless that overshoots by less than stopping falls short. `budgets`: source, budget."""
    spark = rows.sparkSession
    state = budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    current = rows.select("source", "size", "hash")
    total_bits = LEVEL_BITS * LEVELS
    for level in range(1, LEVELS + 1):
        shift = total_bits - LEVEL_BITS * level
        known = F.broadcast(state.select(F.col("source").alias("s"), "left", "prefix"))  # one row per source
        inside = current.join(known, _same_source(F.col("source"), F.col("s")))
        inside = inside.where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        bucket = F.shiftright("hash", shift)
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        # At most 4096 buckets per source and level.
        running = Window.partitionBy("source").orderBy("bucket")
        filled = histogram.join(known.drop("prefix"), _same_source(F.col("source"), F.col("s"))).select(
            "source", "bucket", "words", "left", F.sum("words").over(running).alias("sum")
        )
        boundary = filled.where(F.col("sum") > F.col("left")).groupBy("source").agg(
            F.min("bucket").alias("prefix"), F.min_by(F.col("left") - (F.col("sum") - F.col("words")), "bucket").alias("left"),
            F.min_by("words", "bucket").alias("words"),
        )
        state = snapshot(boundary, "mix-level")
    over = F.col("words") - F.col("left")
    # What is left is one hash (ties of doc_id): it is taken when that comes nearer to the budget.
    return state.select("source", (F.col("prefix") + (over < F.col("left")).cast("long")).alias("threshold"))


def _decided(docs: DataFrame, factor: float, cap: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The sized rows, and per source (column ts) source_size, target, whole and threshold."""
    rows = snapshot(sized(docs), "mix-sizes")
    targets = snapshot(source_targets(rows, factor, cap, weights), "mix-targets")
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")
    targets = targets.withColumn("whole", whole)
    budgets = targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    cut = part_thresholds(rows, budgets).withColumnRenamed("source", "cs")
    per_source = targets.join(F.broadcast(cut), _same_source(F.col("source"), F.col("cs")), "left").drop("cs")
    return rows, per_source.withColumnRenamed("source", "ts")


def _passes(hashed: Column, plan: Callable[[str], Column], cap: int) -> Column:
    """How often a row is taken, from its hash and its source's columns."""
    # Without a threshold the rest is 0 words or reaches the end of the source: a part pass takes all or nothing.
    rest = plan("target") - plan("whole") * plan("source_size")
    taken_in_part = F.coalesce(hashed < plan("threshold"), rest >= plan("source_size"))
    return F.least(plan("whole") + taken_in_part.cast("long"), F.lit(cap).cast("long"))


def mix(docs: DataFrame, factor: float = FACTOR, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, passes, taken, one row per row of `docs`."""
    rows, per_source = _decided(docs, factor, cap, weights)
    joined = rows.join(F.broadcast(per_source), _same_source(F.col("source"), F.col("ts")))
    passes = _passes(F.col("hash"), F.col, cap)
    return joined.select("doc_id", "source", "size", "source_size", "target", passes.alias("passes"), (passes * F.col("size")).alias("taken"))


def take(docs: DataFrame, factor: float = FACTOR, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as `mix` takes it. A row's passes come from its own
    doc_id and source, so nothing is joined back by id."""
    aside = Aside(docs, ("doc_id", "source", "text"))
    docs = aside.rows
    _, per_source = _decided(docs, factor, cap, weights)
    plan = per_source.select(F.struct(*per_source.columns).alias("__plan"))
    joined = docs.join(F.broadcast(plan), _same_source(docs["source"], F.col("__plan.ts")))
    passes = _passes(doc_hash(F.col("doc_id")), lambda c: F.col(f"__plan.{c}"), cap)
    taken = joined.select(*docs.columns, passes.alias("__passes")).where("__passes > 0")
    return aside.back(taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__passes"))).alias("__pass")))
