"""Left join of many rows with a lookup table that holds at most one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup table up to this estimated size is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024
# Estimated memory of one row of a broadcast table without its strings.
ROW_BYTES = 64
# A key is hot when its weight times this is at least the total weight: at most so many keys can be.
HOT_KEYS = 10_000
# Rows that are resolved before the shuffle are spread over so many salts.
SPREAD = 4096


@dataclass(frozen=True)
class TableSize:
    """Measured size of a lookup table: estimated broadcast bytes, and the sum of its weight column."""

    bytes: int
    total: int = 0


def slice_sizes(table: DataFrame, by: str, text: str, weight: str) -> dict[str, TableSize]:
    """Size of every slice of `table`, one slice per value of the few-valued column `by`."""
    text_bytes = F.sum(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)))
    sizes = table.groupBy(by).agg(
        (F.count(F.lit(1)) * ROW_BYTES + text_bytes).alias("bytes"), F.sum(weight).alias("total")
    )
    return {row[by]: TableSize(row["bytes"], row["total"]) for row in sizes.collect()}


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[tuple[str, str]],
    size: TableSize,
    weight: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """`rows` left-joined with `table` on pairs (column of rows, column of table); adds the table's other columns.
    The table's keys are cast to the types of the rows' keys.

    A table within `limit` bytes is broadcast and `rows` never move. A larger one is joined by shuffle, where a
    frequent key would fill one task. With `weight` (a column of the table telling how frequent a key is) the at
    most HOT_KEYS heaviest keys are broadcast first; the rows they resolve, and rows with a null key, take part in
    the shuffle with a salt between 1 and SPREAD beside their key, so they land evenly; live rows and the table have
    salt 0, so no salted row can match, whatever the type and the value of its key. A frequent key that the table does
    not know is left to the adaptive skew join.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    table_keys = [right for _, right in keys]
    values = [c for c in table.columns if c not in table_keys and c != weight]
    right_keys = [f"__key_{i}" for i in range(len(keys))]
    left_keys = [F.col(left) for left, _ in keys]
    renamed = [
        F.col(right).cast(rows.schema[left].dataType).alias(name) for (left, right), name in zip(keys, right_keys)
    ]

    if size.bytes <= limit or weight is None:
        right = table.select(*renamed, *values)
        right = F.broadcast(right) if size.bytes <= limit else right
        return rows.join(right, _equal(left_keys, right_keys), "left").drop(*right_keys)

    hot_key = F.col(weight) * HOT_KEYS >= size.total
    hot = table.where(hot_key).select(*renamed, *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__hot"))
    cold = table.where(~hot_key).select(*renamed, *values)
    half = rows.join(F.broadcast(hot), _equal(left_keys, right_keys), "left").drop(*right_keys)
    done = F.coalesce(F.col("__hot"), F.lit(False))
    for key in left_keys:
        done = done | key.isNull()
    salt = F.when(done, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    half = half.withColumn("__salt", salt)
    cold = cold.withColumn("__cold_salt", F.lit(0).cast("long"))
    joined = half.join(cold, [F.col("__salt") == F.col("__cold_salt"), *_equal(left_keys, right_keys)], "left")
    return joined.select(
        *rows.columns, *[F.when(F.col("__hot"), F.col(f"__hot_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    )


def _equal(left: Sequence[Column], right: Sequence[str]) -> list[Column]:
    return [a == F.col(b) for a, b in zip(left, right)]
