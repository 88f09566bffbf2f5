"""Frequency ranking of the chosen values inside every cluster."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortpref.operators.joins import ROW_BYTES, TableSize, lookup_join, slice_sizes
from cohortpref.session import snapshot, work_path


def choice_cells(rows: DataFrame, cluster: str, choices: Sequence[str], *extra: Column) -> DataFrame:
    """Long form (cluster, ycol, val, ...): one line per row and choice column. Values keep their type when all
    choice columns share it and become text otherwise."""
    kinds = {rows.schema[c].dataType for c in choices}
    values = [F.col(c) if len(kinds) == 1 else F.col(c).cast("string").alias(c) for c in choices]
    wide = rows.select(F.col(cluster).cast("int").alias("cluster"), *values, *extra)
    ids = [c for c in wide.columns if c not in choices]
    return wide.unpivot(ids, list(choices), "ycol", "val")


def choice_frequency(rows: DataFrame, cluster: str, choices: Sequence[str]) -> DataFrame:
    """Table (cluster, ycol, val, occur): all choice columns in one aggregation."""
    cells = choice_cells(rows, cluster, choices)
    return cells.groupBy("cluster", "ycol", "val").agg(F.count(F.lit(1)).alias("occur"))


def frequency_steps(frequency: DataFrame) -> DataFrame:
    """Table (cluster, ycol, occur, values, pos): the distinct counts of a ranking, the number of values that have
    them, and their dense rank.

    The rank of a value depends on its count only. A ranking over N rows has at most sqrt(2N) distinct counts,
    so this window stays small even where one cluster has very many values.
    """
    steps = frequency.groupBy("cluster", "ycol", "occur").agg(F.count(F.lit(1)).alias("values"))
    by_count = Window.partitionBy("cluster", "ycol").orderBy(F.desc("occur"))
    return steps.withColumn("pos", F.row_number().over(by_count).cast("int"))


def rank_choices(frequency: DataFrame, top: int | None = None, limit: int | None = None) -> DataFrame:
    """`frequency` with `pos`: dense rank of the value by falling frequency; equal counts share a position.
    With `top`, only positions 1..top.

    The counts are written first, because they are read twice (for the steps and for the values) and Spark would
    otherwise scan the rows under them twice. Many values of a cluster may share a count, the rare ones above all;
    the lookup takes care of such frequent keys.
    """
    frequency = snapshot(frequency, "frequency")
    steps = snapshot(frequency_steps(frequency), "steps")
    size = steps.agg(F.count(F.lit(1)).alias("steps"), F.coalesce(F.sum("values"), F.lit(0)).alias("values")).first()
    size = TableSize(size["steps"] * ROW_BYTES, size["values"])
    keys = [(c, c) for c in ("cluster", "ycol", "occur")]
    if top is None:
        ranking = lookup_join(frequency, steps, keys, size, "values", limit)
    else:
        steps = steps.where(F.col("pos") <= top)
        ranking = lookup_join(frequency, steps, keys, size, "values", limit).where("pos IS NOT NULL")
    return ranking.select("cluster", "ycol", "val", "occur", "pos")


def ranking_totals(frequency: DataFrame, clusters: int, choices: Sequence[str]) -> DataFrame:
    """Table (cluster, ycol, last, tot_values, tot_distinct) for all cluster ids 0..clusters-1; a cluster
    without rows has totals 0 and no last position. The last position is the number of distinct counts."""
    totals = frequency.groupBy("cluster", "ycol").agg(
        F.countDistinct("occur").cast("int").alias("last"),
        F.sum("occur").alias("tot_values"),
        F.count(F.lit(1)).alias("tot_distinct"),
    )
    grid = frequency.sparkSession.range(clusters).select(
        F.col("id").cast("int").alias("cluster"), F.explode(F.array(*map(F.lit, choices))).alias("ycol")
    )
    return grid.join(totals, ["cluster", "ycol"], "left").select(
        "cluster",
        "ycol",
        "last",
        F.coalesce("tot_values", F.lit(0)).alias("tot_values"),
        F.coalesce("tot_distinct", F.lit(0)).alias("tot_distinct"),
    )


@dataclass(frozen=True)
class Preferences:
    """Written rankings and totals of a clustering, with the measured size of every choice's ranking."""

    ranking: DataFrame
    totals: DataFrame
    choices: tuple[str, ...]
    clusters: int
    sizes: dict[str, TableSize]

    def ranking_of(self, choice: str) -> DataFrame:
        """(cluster, val, occur, pos) of one choice column; reads only its folder."""
        return self.ranking.where(F.col("ycol") == choice).select("cluster", "val", "occur", "pos")

    def last_positions(self) -> DataFrame:
        """One row per cluster that has rows: its size, and the last position LAST_POS_c of every choice column c."""
        lasts = [F.max(F.when(F.col("ycol") == c, F.col("last"))).alias(f"LAST_POS_{c}") for c in self.choices]
        filled = self.totals.where(F.col("last").isNotNull())
        return filled.groupBy("cluster").agg(F.max("tot_values").alias("occur"), *lasts)

    @property
    def last_positions_size(self) -> TableSize:
        return TableSize(self.clusters * ROW_BYTES, max((s.total for s in self.sizes.values()), default=0))

    @property
    def totals_size(self) -> TableSize:
        return TableSize(self.clusters * len(self.choices) * ROW_BYTES, sum(s.total for s in self.sizes.values()))


def fit_preferences(
    train: DataFrame, cluster: str, choices: Sequence[str], clusters: int, path: str | None = None
) -> Preferences:
    """Rank the choices of every cluster of `train` and write the tables under `path` (working folder if none)."""
    spark = train.sparkSession
    path = path or work_path(spark, "preferences")
    ranking = rank_choices(choice_frequency(train, cluster, choices))
    ranking.write.mode("overwrite").partitionBy("ycol").parquet(f"{path}/ranking")
    written = _read_ranking(spark, path, ranking.schema["val"].dataType.simpleString())
    totals = ranking_totals(written, clusters, choices)
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    return load_preferences(spark, path, choices, clusters)


def load_preferences(spark: SparkSession, path: str, choices: Sequence[str], clusters: int) -> Preferences:
    val_type = spark.read.parquet(f"{path}/ranking").schema["val"].dataType.simpleString()
    ranking = _read_ranking(spark, path, val_type)
    totals = spark.read.schema(
        "cluster int, ycol string, last int, tot_values bigint, tot_distinct bigint"
    ).parquet(f"{path}/totals")
    return Preferences(ranking, totals, tuple(choices), clusters, slice_sizes(ranking, "ycol", "val", "occur"))


def _read_ranking(spark: SparkSession, path: str, val_type: str) -> DataFrame:
    schema = f"cluster int, val {val_type}, occur bigint, pos int, ycol string"
    return spark.read.schema(schema).parquet(f"{path}/ranking").select("cluster", "ycol", "val", "occur", "pos")
