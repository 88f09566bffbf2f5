"""Value domains: which values a column takes and how often; validation of requests against them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpref.operators.joins import TableSize, lookup_join, slice_sizes
from cohortpref.session import snapshot
from cohortpref.sources.writers import TABLE_CODEC


def value_domain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Table (col, val, n): every value of every column as text with its row count, in one aggregation."""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "col", "val")
    return cells.groupBy("col", "val").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Domains:
    """A written domain table, one folder per column, with the size of each column's slice."""

    table: DataFrame
    sizes: dict[str, TableSize]

    def slice(self, column: str) -> DataFrame:
        return self.table.where(F.col("col") == column).select("val", "n")


def save_domains(domain: DataFrame, path: str) -> Domains:
    domain.write.mode("overwrite").partitionBy("col").parquet(path)
    return load_domains(domain.sparkSession, path)


def load_domains(spark: SparkSession, path: str) -> Domains:
    table = spark.read.schema("val string, n bigint, col string").parquet(path).select("col", "val", "n")
    return Domains(table, slice_sizes(table, "col", "val", "n"))


def check_requests(requests: DataFrame, domains: Domains, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """`requests` with `rejected_cols`, a map from each offending column to its value (empty: valid).

    A column offends when its value, as text, is null or outside the domain; columns without a domain are not
    looked at. One lookup per column, so no request row is multiplied. The result is a written table: both the
    valid and the rejected rows are read from it. `requests` should be a scan or a written table: the optimizer takes
    very long over this many joins on top of a long chain of derived columns.
    """
    checked = [c for c in columns if c in domains.sizes]
    rows = requests
    for c in checked:
        known = domains.slice(c).withColumn(f"__ok_{c}", F.lit(True))
        rows = lookup_join(rows, known, [(c, "val")], domains.sizes[c], "n", limit)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"), F.col(f"__ok_{c}").alias("ok"))
            for c in checked
        ]
    )
    bad = F.filter(cells, lambda cell: cell["ok"].isNull())
    entries = F.transform(bad, lambda cell: F.struct(cell["key"].alias("key"), cell["value"].alias("value")))
    return snapshot(rows.select(*requests.columns, F.map_from_entries(entries).alias("rejected_cols")), "checked", TABLE_CODEC)


def valid_requests(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("rejected_cols") == 0).drop("rejected_cols")


def rejected_requests(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("rejected_cols") > 0)
