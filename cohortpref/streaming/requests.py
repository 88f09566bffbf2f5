"""Scoring of requests as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType

from cohortpref.operators.scoring import ScoringModel, score_requests
from cohortpref.sources.readers import request_schema
from cohortpref.sources.writers import TABLE_CODEC

REQUEST_IDS = (("request_id", LongType()), ("row_id", StringType()), ("request_rows", LongType()))
# How long the rows of an unfinished request are held, in milliseconds of processing time.
HOLD_MS = 600_000
_HELD = "rows array<string>, ids array<string>, expected long"
_GATHERED = "request_id {0}, complete boolean, held array<string>"


def read_request_stream(
    spark: SparkSession, path: str, model: ScoringModel, ids=REQUEST_IDS, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of JSON-lines files. `request_rows` tells of how many rows the request consists."""
    reader = spark.readStream.schema(request_schema(model.settings.roles, ids))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def gather_requests(
    stream: DataFrame, request: str = "request_id", row: str = "row_id", expected: str = "request_rows", hold_ms: int = HOLD_MS
) -> DataFrame:
    """The rows of `stream` when their request is whole, with `complete`.

    The rows of a request are held as state, under the row id, until there are as many as `expected` says (of differing
    numbers the largest counts); then all of them come out at once with `complete` true, whatever the number of
    micro-batches they came in. A row that is delivered again is held once. A request that stays unfinished for
    `hold_ms` after its last row comes out with `complete` false, and so does a row that arrives after its request has
    come out (once its own time is over). Rows without an expected number, without request or row id count as unfinished
    at once and are not held, so a null key is no hot key.

    A request's rows are one state row, as a response is made of whole requests; state is checkpointed and survives
    lost executors."""
    names = [c for c in stream.columns if c != request]
    kind = stream.schema[request].dataType.simpleString()
    known = F.col(request).isNotNull() & F.col(row).isNotNull() & F.col(expected).isNotNull()
    text = F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "true"})
    # Rows that cannot be held get a key of their own each.
    salt = F.when(known, F.lit("")).otherwise(F.uuid())
    keyed = stream.select(
        F.col(request).alias("__request"), salt.alias("__salt"), F.coalesce(F.col(row).cast("string"), F.lit("")).alias("__row"),
        F.when(known, F.col(expected)).otherwise(F.lit(-1)).cast("long").alias("__expected"), text.alias("__text"),
    )

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def out(complete: bool, rows: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"request_id": pd.Series([key[0]], dtype="object" if key[0] is None else None), "complete": [complete], "held": [rows]})

        if state.hasTimedOut:
            rows, _, _ = state.get
            state.remove()
            yield out(False, list(rows))
            return
        rows, ids, wanted = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], -1)
        seen = set(ids)
        for batch in batches:
            for name, number, text in zip(batch["__row"], batch["__expected"], batch["__text"]):
                wanted = max(wanted, int(number))
                if key[1] or name not in seen:
                    seen.add(name)
                    ids.append(name)
                    rows.append(text)
        if key[1] or wanted <= len(rows):
            if state.exists:
                state.remove()
            yield out(not key[1], rows)
        else:
            state.update((rows, ids, wanted))
            state.setTimeoutDuration(hold_ms)

    gathered = keyed.groupBy("__request", "__salt").applyInPandasWithState(
        gather, _GATHERED.format(kind), _HELD, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    body = stream.select(*names).schema
    rows = gathered.select("request_id", "complete", F.explode("held").alias("__text"))
    parsed = rows.select(F.col("request_id").alias(request), "complete", F.from_json("__text", body).alias("__row"))
    return parsed.select(request, "complete", *[F.col("__row")[c].alias(c) for c in names])


EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE_CODEC = "spark.sql.streaming.stateStore.compression.codec"


def start_stream(requests: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that hands every micro-batch to `write`. Without `trigger` it processes what is there and ends: the
    time of held requests is then looked at only along with new data, as batches without data would never end."""
    spark = requests.sparkSession
    # The held rows are JSON lines, of which the default codec leaves twice as much.
    before = {name: spark.conf.get(name) for name in (EMPTY_BATCHES, STATE_CODEC)}
    spark.conf.set(EMPTY_BATCHES, before[EMPTY_BATCHES] if trigger else "false")
    spark.conf.set(STATE_CODEC, "zstd")
    try:
        writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@dataclass(frozen=True)
class StreamOutputs:
    """Folders of the results. Together they hold every row that has come out of the stream."""

    scored: str
    rejected: str
    incomplete: str
    unfinished: str


def score_stream(
    requests: DataFrame, model: ScoringModel, outputs: StreamOutputs, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Score every micro-batch and write the results as parquet, one folder per batch. `requests` are the gathered ones
    (column `complete`), or a stream in which a request always lies in one file, read one file at a time. Rows of
    unfinished requests are written as they are. `trigger` holds the arguments of the stream's trigger.

    A batch that is repeated after a failure overwrites its own folders, so every request appears once. Without
    `trigger` the query processes what is there and ends; unfinished requests stay in its state for the next start.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read several times; recomputed from the state's output if an executor is lost
        try:
            if "complete" in batch.columns:
                unfinished = batch.where(~F.col("complete")).drop("complete")
                unfinished.write.mode("overwrite").parquet(f"{outputs.unfinished}/batch={batch_id}")
                whole = batch.where("complete").drop("complete")
            else:
                whole = batch
            if whole.isEmpty():
                return
            results = score_requests(whole, model)
            for result, path in zip(results, (outputs.scored, outputs.rejected, outputs.incomplete)):
                result.write.mode("overwrite").parquet(f"{path}/batch={batch_id}", compression=TABLE_CODEC)
        finally:
            batch.unpersist()

    return start_stream(requests, write, checkpoint, trigger)
