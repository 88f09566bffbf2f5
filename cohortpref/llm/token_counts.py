"""Token counts by a separator scan over flat token files without an index.

A flat file is a run of unsigned 16-bit big-endian ids; a document ends at the separator id. Spark's line reader, with
the two bytes of the separator as line separator, reads a file in ranges (`spark.sql.files.maxPartitionBytes`), each in a
task of its own, and finds the separators; no task holds a file, only one document at a time. The lengths of the pieces
are summed in blocks. A range does not know how many bytes the ranges before it took, so the blocks are stitched by prefix
scans: the bytes before a block tell which of its finds lie between two ids, and the last separator before it (a running
maximum over the blocks of its file) is where its first document began. `write_flat` makes such files from documents with Spark's text sink, whose
line separator is the two bytes of the separator id; so they can lie in any store that Spark writes to.

Results for odd input: a null or empty text is a document of 0 tokens; tokens after the last separator of a file are a
document of their own, marked open; an empty file has no document; an empty table gives no rows; a file that ends within
an id is an error. A single document of 2 GB or more does not fit a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from cohortpref.llm.packing import word_tokens
from cohortpref.session import snapshot

# U+0080 in UTF-8 is C2 80: big-endian 0xC280 = 49792, above the vocabulary's 49,408 ids.
SEPARATOR = 0xC280
LINE_SEPARATOR = "\u0080"
BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Writes the ids of every text, in the order of the rows, to flat files in `path`/kind=0, one per task, and beside
    them, by the same task in the same job, the place and doc_id of every row as lines of `path`/kind=1. So which file
    and place a document has is stored with it, and no second scan has to find the rows in the same partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        index = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                rows = batch.slice(start, 2000)
                blobs = [ids.astype(">u2").tobytes() for ids in tokens.encode(rows.column("text"))]
                keys = [k.as_py().encode() for k in rows.column("key")]
                n = len(blobs)
                places = list(range(index, index + n))
                index += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * n + [1] * n, pa.int32()), pa.array(places * 2, pa.int64()), pa.array(blobs + keys, pa.binary())],
                    names=["kind", "index", "bytes"],
                )

    # Base64, as an id may hold the line separator.
    key = F.base64(F.to_json(F.struct("doc_id")).cast("binary"))
    rows = docs.select("text", key.alias("key")).mapInArrow(run, "kind int, index long, bytes binary")
    # Spark keeps the bytes of a string as they are.
    value = F.when(F.col("kind") == 0, F.col("bytes").cast("string")).otherwise(F.concat(F.col("index").cast("string"), F.lit(" "), F.col("bytes").cast("string")))
    lines = rows.sortWithinPartitions("kind", "index").select("kind", value.alias("value"))
    lines.write.partitionBy("kind").option("lineSep", LINE_SEPARATOR).option("maxRecordsPerFile", 0).text(path)


def part_of(file: Column) -> Column:
    return F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).cast("int")


def read_places(spark: SparkSession, path: str, id_type: DataType) -> DataFrame:
    """doc_id, part, index of every row, as `write_flat` stored them."""
    lines = spark.read.option("lineSep", LINE_SEPARATOR).text(f"{path}/kind=1").select("value", part_of(F.col("_metadata.file_path")).alias("part"))
    cells = F.split("value", " ", 2)
    key = F.from_json(F.unbase64(cells[1]).cast("string"), StructType().add("doc_id", id_type))
    return lines.select(key["doc_id"].alias("doc_id"), "part", cells[0].cast("long").alias("index"))


def scan_blocks(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, size (bytes of the file), split, block, n_bytes, marks: one row per block. A split is a range of a file that
    a task reads by itself; it has the pieces that begin in it. The marks are the ends of the block's pieces in bytes from
    its begin: the bytes of the separator, which may still lie across two ids, or the end of the file."""
    line_sep = separator.to_bytes(2, "big").decode("latin-1")
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", line_sep).text(path)
    pieces = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("split"), F.octet_length("value").cast("long").alias("length"),
    )
    limit = 2 * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0  # ascending inside a task, and so inside a split
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files, splits = batch.column("file"), batch.column("split").to_numpy()
            other = pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            runs = [0, *(np.flatnonzero(other | (splits[1:] != splits[:-1])) + 1), n]
            sizes = batch.column("length").to_numpy() + 2
            rows = []
            for first, last in zip(runs, runs[1:]):
                ends = np.cumsum(sizes[first:last])
                cuts = [0, *(np.flatnonzero(np.diff((ends - 1) // limit)) + 1), len(ends)]
                for low, high in zip(cuts, cuts[1:]):
                    begin = ends[low - 1] if low else 0
                    rows.append((files[first].as_py(), batch.column("size")[first].as_py(), int(splits[first]), number, int(ends[high - 1] - begin), ends[low:high] - begin - 2))
                    number += 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["file", "size", "split", "block", "n_bytes", "marks"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return pieces.mapInArrow(run, "file string, size long, split long, block long, n_bytes long, marks array<bigint>")


def document_tokens(blocks: DataFrame) -> DataFrame:
    """file, index (of the document in its file, from 0), start, n_tokens, open: one row per document."""
    blocks = snapshot(blocks, "token-blocks")
    at = ["file", "split", "block"]

    def aligned(begin: Column) -> Column:
        return F.filter("marks", lambda m: (m + begin) % 2 == 0)

    # The windows see one small row per block; where a block begins decides which of its marks lie between two ids.
    cells = [*at, "size", "n_bytes"]
    for odd in (0, 1):
        marks = aligned(F.lit(odd))
        cells += [F.size(marks).alias(f"n{odd}"), F.when(F.size(marks) > 0, F.element_at(marks, -1)).alias(f"last{odd}")]
    in_file = Window.partitionBy("file")
    before = in_file.orderBy("split", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(*cells).withColumns({
        "begin": F.coalesce(F.sum("n_bytes").over(before), F.lit(0)), "more": F.col("size") - F.sum("n_bytes").over(in_file),
    })
    # Every piece counts two bytes of separator, also the last one of a file without. The line reader leaves out the
    # three bytes of a byte order mark at the begin of a file.
    whole = (F.col("size") % 2 == 0) & F.col("more").isin(0, -2, 3, 1)
    begin = F.when(whole, F.col("begin") + F.when(F.col("more") > 0, 3).otherwise(0)).otherwise(
        F.raise_error(F.concat(F.lit("not a whole number of ids, or not read whole: "), "file")).cast("long")
    )
    placed = placed.withColumn("begin", begin)
    odd = F.col("begin") % 2 == 1
    last = F.col("begin") + F.when(odd, F.col("last1")).otherwise(F.col("last0"))
    carried = placed.select(
        *[F.col(c).alias(f"c_{c}") for c in at], "begin", F.coalesce((F.max(last).over(before) / 2).cast("long"), F.lit(-1)).alias("previous"),
        F.coalesce(F.sum(F.when(odd, F.col("n1")).otherwise(F.col("n0"))).over(before), F.lit(0)).alias("first"),
    )
    same = (F.col("file") == F.col("c_file")) & (F.col("split") == F.col("c_split")) & (F.col("block") == F.col("c_block"))
    ends = F.transform(aligned(F.col("begin")), lambda m: F.shiftright(m + F.col("begin"), 1))
    joined = blocks.join(carried, same).select("file", "size", "previous", "first", ends.alias("ends"))
    found = joined.select("file", "size", "first", F.concat(F.array("previous"), "ends").alias("begins"), F.posexplode("ends").alias("at", "end"))
    start = F.col("begins")[F.col("at")] + 1
    return found.select(
        "file", (F.col("first") + F.col("at")).cast("long").alias("index"), start.alias("start"), (F.col("end") - start).alias("n_tokens"),
        (2 * F.col("end") == F.col("size")).alias("open"),
    )


def count_tokens(docs: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """doc_id, n_tokens, part, index of every row, by way of flat files in `path`. A stored place without a count, or a
    count without a place, is an error."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    if docs.isEmpty():
        return spark.createDataFrame([], StructType().add("doc_id", id_type).add("n_tokens", "long").add("part", "integer").add("index", "long"))
    write_flat(docs, tokenizer, path)
    counted = document_tokens(scan_blocks(spark, f"{path}/kind=0"))
    counted = counted.select(part_of(F.col("file")).alias("p"), F.col("index").alias("i"), "n_tokens")
    places = read_places(spark, path, id_type)
    both = places.join(counted, (F.col("part") == F.col("p")) & (F.col("index") == F.col("i")), "full")
    lost = F.raise_error(F.lit("flat files and stored places differ")).cast("long")
    n_tokens = F.when(F.col("index").isNull() | F.col("i").isNull(), lost).otherwise(F.col("n_tokens"))
    return both.select("doc_id", n_tokens.alias("n_tokens"), "part", "index")
