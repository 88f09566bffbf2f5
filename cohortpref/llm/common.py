"""Words, hashes and small helpers that the text operators share."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word of the contracts: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
# `bytes.split()` cuts at exactly these six, and `bytes.lower()` changes exactly A-Z.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
# Entries a worker keeps of its word -> hash table before it starts afresh.
CACHE_WORDS = 120_000
# xxhash with another seed for every use, so that the uses are independent.
WORD_SEED = 11


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; filled as words are asked for, emptied by `trim` when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, WORD_SEED)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads sums and products over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of `width` consecutive hashes (empty when there are fewer). Horner's rule in
    arithmetic modulo 2**64, so the cost is `width` vector operations and no window is built."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(total)


def power_window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """As `window_hashes`, for wide windows: the power sums of the prefix are kept, so the cost does not depend on
    `width`. The hashes are another family than those of `window_hashes`."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    powers = np.multiply.accumulate(np.full(len(hashes), base, np.uint64))
    back = np.multiply.accumulate(np.full(n, inverse, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * powers)])
    return mix((sums[width:] - sums[:n]) * back)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class Aside:
    """The columns of `docs` under names that no operator uses, so that no column of the caller can clash.

    `rows` has the columns `needed` under their own names and the others as __k0, __k1, ... by their place; `keep` (default:
    all) names those that are carried. `back` gives a result its kept columns again, in the order of `keep`, then
    `made`, the columns of the result. A kept column that is named like one of `made` gives way to it."""

    def __init__(self, docs: DataFrame, needed: tuple[str, ...], keep: tuple[str, ...] | None = None, made: tuple[str, ...] = ()):
        kept = tuple(c for c in (docs.columns if keep is None else keep) if c not in made)
        self.names = {c: c if c in needed else f"__k{i}" for i, c in enumerate(docs.columns) if c in kept or c in needed}
        renamed = docs.toDF(*[self.names.get(c, f"__k{i}") for i, c in enumerate(docs.columns)])
        self.rows = renamed.select(*self.names.values())
        self.keep = tuple(self.names[c] for c in kept)
        self.kept, self.made = kept, made

    def back(self, result: DataFrame) -> DataFrame:
        return result.select(*[F.col(self.names[c]).alias(c) for c in self.kept], *self.made)


def word_array(text: Column) -> Column:
    """The words of a text (null: none) as a JVM expression."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo `modulus` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: what the numbers of blocks and partitions are derived from."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def pieces(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))
