"""Scalar column expressions. All of them are native, so scans and joins stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortpref.config import DAY_BOUNDS, HOUR_BOUNDS

SPLIT_BUCKETS = 10_000


def bucketize(value: Column, upper_bounds: Sequence[float]) -> Column:
    """Code n for values below the n-th (exclusive) bound, null for null."""
    code = F.when(value.isNull(), F.lit(None))
    for n, bound in enumerate(upper_bounds):
        code = code.when(value < bound, n)
    return code.otherwise(len(upper_bounds)).cast("int")


def quantize_days(days: Column) -> Column:
    """Days until the booking as one of 9 codes."""
    return bucketize(days, DAY_BOUNDS)


def hour_band(ts: Column) -> Column:
    """Part of the day: [0,11) 0, [11,13) 1, [13,15) 2, [15,24) 3."""
    return bucketize(F.hour(ts), HOUR_BOUNDS)


def split_bucket(key: Sequence[Column], seed: int = 1) -> Column:
    """Pseudo-random bucket 0..9999 of a key; the same for any partitioning and in any engine with md5."""
    text = F.concat(F.concat_ws("|", *key), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % SPLIT_BUCKETS


def zero_based(pos: Column) -> Column:
    """Position counted from 0; null when the value is not in the ranking."""
    return (pos - 1).cast("int")


def positional_accuracy(pos: Column, last: Column) -> Column:
    """1 for the first of `last` ranks, 1/last for the last one, 0 for a value outside the ranking."""
    return F.coalesce((last - (pos - 1)).cast("double") / last.cast("double"), F.lit(0.0))


def position_or_last(pos: Column, last: Column) -> Column:
    """Position for statistics: a value outside the ranking counts with the last position."""
    return F.coalesce(pos, last)


def sq_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of doubles; arrays of different length are an error."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None))
        .when(F.size(a) == F.size(b), F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
        .otherwise(F.raise_error(F.lit("the two vectors differ in length")).cast("double"))
    )


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sq_distance(a, b))


def distance_normalized(accuracy: Column, distance: Column, total: Column) -> Column:
    """Accuracy lowered by the share of `distance` in the batch total; null when the total is 0."""
    return accuracy * (total - distance) / F.nullif(total, F.lit(0.0))
