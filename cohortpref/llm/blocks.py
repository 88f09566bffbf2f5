"""Counting hashed pieces of text over all documents without moving the pieces themselves.

Documents are dealt into blocks of bounded size by a hash. A block asks about its distinct 64-bit keys (each once, with
what the block itself has of it), cut into ranges of the key space ("parts"); a part adds up what all blocks sent and
answers each of them. The sum is done before the shuffle, so a key that occurs in a third of all rows still is one
entry per block; ranges of hashes are even by construction. Blocks meet their answers in a co-group. The blocks are one
shuffle of the texts that Spark reuses for every pass, and every step is a plain DataFrame stage that a lost executor
makes Spark compute again.

Blocks and parts grow in number with the data; a worker holds one block or one part at a time. Two different pieces
share a 64-bit key with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortpref.llm.common import pieces, text_bytes

LEAST_BLOCK, MOST_BLOCK = 8 << 20, 32 << 20
BLOCKS_AIM = 4000  # with more text than LEAST_BLOCK times this, blocks become larger, up to MOST_BLOCK

ASK = "__block int, __part int, keys binary, counts binary"
ANSWER = "__block int, __part int, answer binary"


@dataclass(frozen=True)
class Blocks:
    rows: DataFrame  # __block and the columns asked for
    count: int
    columns: StructType  # without __block


def deal(docs: DataFrame, columns: Sequence[str]) -> Blocks:
    """`columns` (with `text` among them) of all rows, dealt into blocks by a hash of id and text."""
    total = text_bytes(docs)
    each = min(MOST_BLOCK, max(LEAST_BLOCK, total // BLOCKS_AIM))
    count = pieces(total, each, docs.sparkSession.sparkContext.defaultParallelism)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")
    chosen = docs.select(*columns)
    return Blocks(docs.select(block.alias("__block"), *columns).repartition(count, "__block"), count, chosen.schema)


def numbers_to_bytes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: zero planes are left out, planes of few different bytes are compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    stored = [b""] * 8
    for i, plane in enumerate(planes):
        if plane.any():
            raw = plane.tobytes()
            stored[i] = min(raw, squeeze(raw), key=len)  # raw where they tie: a reader goes by the length
    return b"".join([np.array([len(numbers), *map(len, stored)], "<u4").tobytes(), *stored])


def numbers_from_bytes(blob: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(blob, "<u4", 9).tolist()
    planes = np.zeros((8, n), np.uint8)
    at, widen = 36, zstandard.ZstdDecompressor().decompress
    for plane, size in zip(planes, sizes):
        if size:
            stored = blob[at : at + size]
            plane[:] = np.frombuffer(stored if size == n else widen(stored), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def keys_to_bytes(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, whose upper bytes are zero or small."""
    return numbers_to_bytes(np.diff(keys, prepend=np.uint64(0)))


def keys_from_bytes(blob: bytes) -> np.ndarray:
    return np.add.accumulate(numbers_from_bytes(blob))


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in the ascending keys (parts + 1 positions)."""
    inner = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]]).astype(np.int64)


def asked(block: int, keys: np.ndarray, counts: np.ndarray, parts: int, shift: int = 0, every: bool = False) -> pa.Table:
    """Rows of ASK for ascending distinct keys and what the block has of each. `shift` is added to the numbers of the
    parts, so that the answers to a later question come after those to an earlier one. With `every`, parts of which the
    block has no key are asked too."""
    at = _parts(keys, parts)
    full = np.arange(parts) if every else np.flatnonzero(np.diff(at))
    return pa.table({
        "__block": pa.array([block] * len(full), pa.int32()),
        "__part": pa.array(full + shift, pa.int32()),
        "keys": pa.array([keys_to_bytes(keys[at[p] : at[p + 1]]) for p in full], pa.binary()),
        "counts": pa.array([numbers_to_bytes(counts[at[p] : at[p + 1]]) for p in full], pa.binary()),
    })


def block_number(table: pa.Table) -> int:
    return table.column("__block")[0].as_py()


def ask(blocks: Blocks, keys: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """`keys` gives the ascending distinct keys of a block and their counts."""
    parts = blocks.count

    def run(table: pa.Table) -> pa.Table:
        return asked(block_number(table), *keys(table), parts)

    return blocks.rows.groupBy("__block").applyInArrow(run, ASK)


def answer(
    asks: DataFrame, respond: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bytes], parts: int,
    heading: Callable[[int, np.ndarray, np.ndarray], bytes] | None = None,
) -> DataFrame:
    """`respond(keys, own counts, total counts, numbers of blocks that have the key)` gives the answer for one block's keys
    of one part; `heading(part, distinct keys, their totals)` what all answers of a part begin with. The parts are dealt into
    as many partitions, so that a task's share does not grow with the data."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [keys_from_bytes(b) for b in pdf["keys"]]
        counts = [numbers_from_bytes(b) for b in pdf["counts"]]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        holders = np.bincount(inverse, minlength=len(distinct))
        ends = np.cumsum([len(k) for k in keys])
        places = [inverse[e - len(k) : e] for k, e in zip(keys, ends)]
        head = heading(int(pdf["__part"].iloc[0]), distinct, totals) if heading else b""
        found = [head + respond(k, c, totals[at], holders[at]) for k, c, at in zip(keys, counts, places)]
        return pd.DataFrame({"__block": pdf["__block"], "__part": pdf["__part"], "answer": found})

    return asks.repartition(parts, "__part").groupBy("__part").applyInPandas(run, ANSWER)


def meet(blocks: Blocks, answers: DataFrame, finish: Callable[[pa.Table, list[bytes]], pa.Table], schema) -> DataFrame:
    """`finish(rows of a block, its answers in the order of the parts)`."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ordered = right.sort_by("__part")
        return finish(left, ordered.column("answer").to_pylist())

    return blocks.rows.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(run, schema)


def repeated_keys(keys: np.ndarray, own: np.ndarray, totals: np.ndarray, holders: np.ndarray) -> bytes:
    """An answer: those of the keys that occur at least twice in all."""
    return keys[totals > 1].astype("<u8").tobytes()


def counts_elsewhere(keys: np.ndarray, own: np.ndarray, totals: np.ndarray, holders: np.ndarray) -> bytes:
    """An answer: per key, in order, twice the count in other blocks, plus 1 where another block has the key at all."""
    return numbers_to_bytes((totals - own.astype(np.int64)) * 2 + (holders > 1))


def read_elsewhere(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The counts in other blocks, and whether another block has the key."""
    numbers = np.concatenate([numbers_from_bytes(b) for b in answers] or [np.empty(0, np.uint64)]).astype(np.int64)
    return numbers >> 1, (numbers & 1).astype(bool)
