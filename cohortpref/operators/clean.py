"""Row cleaning and quantisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortpref.config import ColumnRoles
from cohortpref.functions.scalar import bucketize


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the rows in which none of `columns` is null."""
    return df.dropna("any", subset=list(columns))


def incomplete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that `drop_incomplete` removes."""
    return df.where(F.array_contains(F.array(*[F.col(c).isNull() for c in columns]), True))


def quantize(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Apply every quantiser of the configuration."""
    return df.withColumns({name: bucketize(F.col(name), bounds) for name, bounds in roles.quantized})


def clean_bookings(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Complete rows, quantised."""
    return quantize(drop_incomplete(df, roles.columns), roles)


def without_columns(df: DataFrame, dropped: Sequence[str]) -> DataFrame:
    """All columns but the dropped ones; names that do not occur are ignored."""
    return df.drop(*dropped)
