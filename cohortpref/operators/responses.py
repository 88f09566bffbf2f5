"""Whole responses: what a request gets back, from its scored, rejected and incomplete rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpref.operators.joins import ROW_BYTES, TableSize, lookup_join
from cohortpref.operators.scoring import RESPONSE_STATUS, RESPONSE_VERSION
from cohortpref.session import snapshot
from cohortpref.sources.writers import TABLE_CODEC

# Rows of a request beyond this number go into several numbered parts, so that no task gathers an unbounded request.
PART_ROWS = 10_000


def accuracy_entry(choices: Sequence[str], echo: Sequence[str], row: str) -> Column:
    """What a scored row gets: its accuracy per choice and in all, its distance, and the row itself."""
    per_choice = [
        F.struct(
            F.col(c).alias("VAL"), F.col(f"POS_{c}").alias("POS"), F.col(f"LAST_POS_{c}").alias("LAST_POS"),
            F.col(f"ACC_{c}").alias("ACC"), F.col(f"ACC_NORM_{c}").alias("ACC_NORM"),
        ).alias(c)
        for c in choices
    ]
    return F.struct(
        F.col(row).alias("row_id"), "prediction", "tot_acc", "mean_acc", "mean_acc_norm", "centerdistance", *per_choice,
        F.struct(*[F.col(c) for c in echo]).alias("request"),
    )


def request_responses(
    scored: DataFrame, rejected: DataFrame, incomplete: DataFrame, choices: Sequence[str], echo: Sequence[str],
    request: str = "request_id", row: str = "row_id", part_rows: int = PART_ROWS, limit: int | None = None,
) -> DataFrame:
    """One row per request and part: request, part (0, 1, ...), parts, version, status, n_valid, n_rejected, n_incomplete
    of the whole request, request_wssse (null without scored rows), and of the part's rows the arrays accuracies
    (see `accuracy_entry`), rejected (row_id, the row, and its offending columns as sorted (key, value) pairs) and
    incomplete (row_id, the row), each in the order of row_id.

    The rows of a request are dealt into ceil(rows / part_rows) parts by a hash of row id and kind, so the parts of a large
    request are about even, and a repeated row id stays in one part. Totals are aggregated before they meet the rows.
    Rows without a request id form one response, dealt into parts likewise. Requests of which every row is rejected or
    incomplete get a response too."""
    ids = [F.col(request).alias("__request"), F.col(row).alias("__row")]
    whole = F.struct(*[F.col(c) for c in echo])
    offending = F.array_sort(F.map_entries("rejected_cols"))
    kinds = {
        "accuracies": scored.select(*ids, accuracy_entry(choices, echo, row).alias("accuracies"), F.col("d2").alias("__d2")),
        "rejected": rejected.select(*ids, F.struct(F.col(row).alias("row_id"), whole.alias("row"), offending.alias("rejected_cols")).alias("rejected")),
        "incomplete": incomplete.select(*ids, F.struct(F.col(row).alias("row_id"), whole.alias("row")).alias("incomplete")),
    }
    rows = kinds["accuracies"]
    for name in ("rejected", "incomplete"):
        rows = rows.unionByName(kinds[name], allowMissingColumns=True)
    rows = snapshot(rows, "responses", TABLE_CODEC)
    totals = snapshot(
        rows.groupBy(F.col("__request").alias("__id")).agg(
            F.count(F.lit(1)).alias("__n"), F.count("accuracies").alias("n_valid"), F.count("rejected").alias("n_rejected"),
            F.count("incomplete").alias("n_incomplete"), F.sum("__d2").alias("request_wssse"),
        ),
        "response-totals",
    )
    parts = F.ceil(F.col("__n") / part_rows)
    measured = totals.agg(F.count(F.lit(1)).alias("requests"), F.sum("__n").alias("rows")).first()
    size = TableSize(measured["requests"] * ROW_BYTES * 2, measured["rows"] or 0)
    # A null id meets no total in the join: its number of parts is handed in.
    nobody = totals.where(F.col("__id").isNull()).select(parts.alias("parts")).first()
    counted = totals.where(F.col("__id").isNotNull()).select("__id", "__n", parts.alias("__parts"))
    rows = lookup_join(rows, counted, [("__request", "__id")], size, "__n", limit)
    of_row = F.coalesce(F.col("__parts"), F.lit(nobody["parts"] if nobody else 1))
    kind = F.when(F.col("accuracies").isNotNull(), 0).when(F.col("rejected").isNotNull(), 1).otherwise(2)
    part = F.pmod(F.xxhash64("__row", kind), of_row).cast("int")
    gathered = rows.groupBy("__request", part.alias("part")).agg(*[F.array_sort(F.collect_list(k)).alias(k) for k in kinds])
    joined = gathered.join(totals, F.col("__request").eqNullSafe(F.col("__id")))
    return joined.select(
        F.col("__request").alias(request), "part", parts.cast("int").alias("parts"), F.lit(RESPONSE_VERSION).alias("version"),
        F.lit(RESPONSE_STATUS).alias("status"), "n_valid", "n_rejected", "n_incomplete", "request_wssse", *kinds,
    )
