"""The lookup join gives the same rows by broadcast and by shuffle, whatever the type and value of the keys."""

from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortpref.operators import joins

KEYS = {
    "bigint": [-1, -5, -4096, 0, 7, None],
    "int": [-1, -2, 3, 2147483647, None],
    "tinyint": [-1, -128, 4, None],
    "boolean": [True, False, None],
    "date": [date(1960, 1, 1), date(2020, 2, 2), None],
    "decimal(3,0)": [Decimal(-1), Decimal(999), None],
    "string": ["", "-1", "\0-1", "a", None],
    "double": [-1.0, 2.5, None],
}


@pytest.mark.parametrize("kind", sorted(KEYS))
@pytest.mark.parametrize("hot_keys", [0, 1, 2, 10_000])
def test_shuffled_lookup_equals_broadcast(spark, monkeypatch, kind, hot_keys):
    monkeypatch.setattr(joins, "HOT_KEYS", hot_keys)
    values = KEYS[kind]
    rows = spark.createDataFrame([(i, values[i % len(values)]) for i in range(60)], f"id int, k {kind}")
    known = [(v, i, 1 + 50 * (i == 0)) for i, v in enumerate(values[:-2])]
    table = spark.createDataFrame(known, f"key {kind}, found int, n long")
    size = joins.TableSize(10, sum(n for _, _, n in known))
    broadcast, shuffled = (
        joins.lookup_join(rows, table, [("k", "key")], size, "n", limit) for limit in (joins.BROADCAST_BYTES, -1)
    )
    assert Counter(shuffled.collect()) == Counter(broadcast.collect())
    assert shuffled.where(F.col("k").isNull() & F.col("found").isNotNull()).isEmpty()
    assert shuffled.columns == broadcast.columns
