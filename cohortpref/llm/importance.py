"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are the runs of 1 to WIDTH consecutive words (A-Z lower-cased; a word is a run of ASCII letters, digits and
non-ASCII characters), hashed by crc32 into buckets. The bucket counts of the documents and of the target texts give every
bucket a gain, the logarithm of the ratio of its smoothed shares in thousandths; a document's weight is the floored mean
gain of its features. Weight plus a Gumbel number made from the id is the score, and the highest scores are drawn, which
is sampling without replacement in proportion to the exponentiated weights.

Hashing: the distinct features of a chunk of texts are grouped by their length in bytes; a group is a two-dimensional
array of bytes whose crc32 sums are updated column by column, for all rows at once, and the sums are scattered back.
Features longer than LONG bytes are too few for that and hashed one by one.

Bounds: a task sends one row per bucket it has met; the driver holds the gains (one number per bucket) and the histogram
of scores, whose number of distinct values is bounded by the range of scores (some 130,000). Ranks are given over range
partitions of the candidates, equal rows counted first, so a third of all rows may be copies of one row.

Results for odd input: a null or empty text has no features and weight 0; a null id is hashed like the empty text and
comes last among equal scores; rows that share an id are documents of their own (ties among them go by weight and
n_features); an empty table gives an empty table; with an empty target the gains follow from T = 0. Other columns do not
enter, whatever their names, unless `whole_rows` hands them through in a column `document`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortpref.llm.byte_views import bounded, flat, runs, strings
from cohortpref.llm.common import pieces
from cohortpref.session import snapshot

WIDTH = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
LONG = 64
RANKED_ROWS = 200_000  # rows that a task ranks

_SPACE = 32
# What every byte of a text becomes: A-Z lower case; letters, digits and bytes of non-ASCII characters stay, the rest
# parts words.
_BYTES = np.array(
    [b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _SPACE for b in range(256)], np.uint8
)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()


def crc32_by_length(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of the pieces data[start : start + size], all pieces of one length at a time."""
    sums = np.zeros(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for length, members in zip(lengths.tolist(), np.split(order, first[1:])):
        if length > LONG:
            raw = memoryview(np.ascontiguousarray(data))
            sums[members] = [zlib.crc32(raw[a : a + length]) for a in starts[members].tolist()]
            continue
        matrix = data[starts[members][:, None] + np.arange(length)]
        crc = np.full(len(members), 0xFFFFFFFF, np.uint32)
        for column in matrix.T:
            crc = CRC_TABLE[(crc ^ column) & 255] ^ (crc >> np.uint32(8))
        sums[members] = ~crc
    return sums


def feature_buckets(texts: pa.Array, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature, and the number of words of every text."""
    data, at = flat(texts)
    plain = _BYTES[data]
    starts, ends = runs(plain != _SPACE, at)
    owner = np.searchsorted(at, starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    # The words joined by one space each: a feature is a run of bytes there.
    sizes = ends - starts
    last = np.cumsum(sizes + 1)
    joined = np.full(int(last[-1]) if len(last) else 0, _SPACE, np.uint8)
    place = last - sizes - 1
    joined[np.repeat(place - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = plain[plain != _SPACE]
    words = strings(plain[plain != _SPACE], np.cumsum(sizes)).dictionary_encode()
    word = words.indices.to_numpy().astype(np.int64)
    found, owners = [], []
    gram, count = word, len(words.dictionary)
    for n in range(1, width + 1):
        if n > 1:
            inside = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1]) if len(owner) >= n else np.empty(0, np.int64)
            # A longer feature is the number of the one before, without its last word, and that word.
            _, kept = np.unique(gram[inside] * len(words.dictionary) + word[inside + n - 1], return_inverse=True)
            gram = np.full(len(word), -1)
            gram[inside], count = kept, int(kept.max()) + 1 if len(kept) else 0
        else:
            inside = np.arange(len(word))
        sample = np.zeros(count, np.int64)
        sample[gram[inside]] = inside  # one place of every distinct feature
        hashed = crc32_by_length(joined, place[sample], place[sample + n - 1] + sizes[sample + n - 1] - place[sample])
        found.append((hashed % np.uint32(buckets)).astype(np.int64)[gram[inside]])
        owners.append(owner[inside])
    return np.concatenate(found), np.concatenate(owners), n_words


def bucket_counts(texts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of `texts` (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in bounded(batches, "text"):
            total += np.bincount(feature_buckets(batch.column("text"), width, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # one row per bucket at most
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of (share in the target / share in the source), both smoothed by one per bucket."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, width: int = WIDTH, whole_rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight (and document, the whole row) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket
    columns = [F.col("doc_id"), F.col("text")]
    if whole_rows:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    rows = docs.select(*columns)
    passed = ["doc_id", *(["document"] if whole_rows else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in bounded(batches, "text"):
            bucket, owner, n_words = feature_buckets(batch.column("text"), width, len(gain))
            n = np.bincount(owner, minlength=batch.num_rows)
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, owner, gain[bucket])
            made = [n_words, n, sums // np.maximum(n, 1)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in passed], *[pa.array(x, pa.int64()) for x in made]], names=[*passed, "n_words", "n_features", "weight"]
            )

    schema = rows.select(*passed).schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)


def with_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """`weighed` with score: the weight plus a Gumbel number in thousandths, made from the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """`scored` (a written table) with rank 1, 2, ... for the floor(percent * N / 100) highest scores among the N rows of
    at least `least_words` words, ties to the smaller id; null for the others."""
    fits = F.col("n_words") >= least_words
    histogram = scored.where(fits).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = percent * sum(r["n"] for r in histogram) // 100
    least, seen = None, 0
    for r in sorted(histogram, key=lambda r: -r["score"]):
        if seen >= wanted:
            break
        least, seen = r["score"], seen + r["n"]
    columns = scored.columns
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    may = fits & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), F.asc("n_words")]
    if "document" in columns:
        order.append(F.asc(F.xxhash64("document")))
    # Equal rows become one with their number, then are put in order over range partitions, written with the partition
    # they stand in, and numbered from the rows before.
    counted = scored.where(may).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    parts = pieces(seen, ranked_rows)
    ranged = snapshot(counted.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "candidates")
    upto = F.sum("copies").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = ranged.groupBy("part").agg(F.sum("copies").alias("inside"))  # one row per range partition
    earlier = F.sum("inside").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("part").alias("p"), F.coalesce(earlier, F.lit(0)).alias("before"))
    numbered = ranged.withColumn("upto", upto).join(totals, F.col("part") == F.col("p"))
    first = F.col("before") + F.col("upto") - F.col("copies") + 1
    rows = numbered.select(*columns, F.explode(F.sequence(first, F.col("before") + F.col("upto"))).alias("rank"))
    rows = rows.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return rows.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, whole_rows: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn) of every row of `docs`, drawn to look like the
    texts of `target`; with `whole_rows` also `document`, the row itself as a struct."""
    gains = bucket_gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    scored = snapshot(with_scores(weigh(docs, gains, width, whole_rows), seed), "scored")
    return draw(scored, percent, least_words)
