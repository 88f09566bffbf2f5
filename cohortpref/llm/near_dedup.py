"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and union-find grouping.

1. Every text becomes its set of hashed word shingles and a SuperMinHash signature: each element ranks the slots by a
   random permutation of its own (grown step by step, Fisher-Yates) and offers rank + uniform to each; a slot keeps the
   least offer. After step j no later offer is below j + 1, so it stops early. Equal sets form one class.
2. BANDS bands of ROWS slots put the classes into buckets. Two sets of similarity 0.8 share no bucket with probability
   (1 - 0.8**4)**32 = 5e-8.
3. In every bucket each member is compared, on full sets, with the member of the smallest id (a star, not all pairs), and
   the verified links are grouped by `components`.
4. Buckets that still hold members of different groups are compared exhaustively, but only between groups: in chunks of
   bounded size (pairs of chunks of one group are skipped), with exact intersection counts inside a worker, where a
   union-find lets only links through that join two groups. So no link between different groups is missed and no pairs
   are emitted.
5. A doc_id whose rows belong to several classes joins them: its membership links (smallest id of the class, doc_id)
   take part wherever groups are made, so ids are nodes, not only the smallest ids of classes.
6. The final groups come from all links.

Results for odd input: a null or empty text is an empty set, linked with nothing and kept; fewer words than a shingle make
one shingle; rows that share a doc_id are one document (linked if any of its texts is, in one component, kept or not as
one); a row without doc_id is not
linked, has no component and is kept; an empty table gives an empty table. Other columns do not enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from cohortpref.llm.common import WordHashes, mix, window_hashes, words_of
from cohortpref.llm.components import components
from cohortpref.session import snapshot

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
SHINGLE = 5
PERCENT = 80
CHUNK = 256  # documents of a chunk in step 4; a worker holds two chunks
BROADCAST_BYTES = 32 << 20

_hashes = WordHashes()
_STEP_SEEDS = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of the runs of `width` words; of all words when there are fewer; empty without words."""
    words = _hashes.of(words_of(text, lower=True))
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else np.empty(0, np.uint64)


def super_min_hash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a non-empty set of 64-bit elements: for each slot the least rank + uniform."""
    n = len(elements)
    signature = np.full(slots, np.inf)
    order = None
    every = np.arange(n)
    for step in range(slots):
        uniform = (mix(elements ^ _STEP_SEEDS[2 * step]) >> np.uint64(11)) * 2.0**-53
        other = step + (mix(elements ^ _STEP_SEEDS[2 * step + 1]) % np.uint64(slots - step)).astype(np.int64)
        if step == 0:
            slot = other
        else:
            if order is None:  # only sets that need a second step get the whole permutations
                order = np.tile(np.arange(slots, dtype=np.int32), (n, 1))
                order[every, first] = 0
            slot = order[every, other]
            order[every, other] = order[:, step]
        first = other
        np.minimum.at(signature, slot, uniform + step)
        if signature.max() < step + 1:
            break
    return signature


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; equal keys mean equal bands, and the band's number is part of the key."""
    cells = signature.view(np.uint64).reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for row in range(ROWS):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + cells[:, row])
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set; null when empty) and bands of every row."""
    empty: list[int] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for value in batch.column("text"):
                found = shingles(value.as_py(), width)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(super_min_hash(found)) if len(found) else empty)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    schema = docs.select("doc_id").schema.add("n_shingles", "long").add("set_key", "binary").add("bands", ArrayType(LongType()))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, text of the documents in `ids` (column doc). The ids are broadcast when their measured size allows it."""
    ids = snapshot(ids.distinct(), "ids")
    side = F.broadcast(ids) if ids.count() * 32 <= BROADCAST_BYTES else ids
    return docs.select(F.col("doc_id").alias("doc"), "text").join(side, "doc", "left_semi")


def _enough(shared: np.ndarray | int, a: int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * shared >= percent * (a + b - shared)


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (center, doc) whose full sets are similar enough."""
    texts = _texts_of(docs, pairs.select("doc").unionByName(pairs.select(F.col("center").alias("doc"))))
    rows = pairs.join(texts, "doc").withColumnRenamed("text", "text_doc")
    centers = texts.select(F.col("doc").alias("c"), F.col("text").alias("text_center"))
    rows = rows.join(centers, F.col("center") == F.col("c")).select("center", "doc", "text_center", "text_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = object(), None
        for batch in batches:
            keep = []
            # One text at a time as a Python string: a batch of both columns may hold 64 MB of text.
            for center, doc in zip(batch.column("text_center"), batch.column("text_doc")):
                text_center = center.as_py()
                if text_center != last:  # rows of one centre mostly follow one another
                    last, held = text_center, shingles(text_center, width)
                other = shingles(doc.as_py(), width)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(bool(len(other)) and bool(_enough(shared, len(held), len(other), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("center"), batch.column("doc")], names=["center", "doc"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.select("center", "doc").schema)


def group_links(sets: list[np.ndarray], groups: list, percent: int) -> list[tuple[int, int]]:
    """Index pairs of similar sets that join different groups: a spanning set of them, by union-find."""
    parent: dict = {g: g for g in groups}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links = []
    for i, own in enumerate(sets):
        if len({root(g) for g in parent}) == 1:
            break
        low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        spans = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(_enough(shared, sizes[i], sizes, percent)):
            a, b = root(groups[i]), root(groups[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, int(j)))
    return links


def _between_groups(members: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (center, doc) between different groups inside the buckets of `members` (bucket, doc)."""
    labelled = members.join(labels, F.col("doc") == F.col("node"), "left").select(
        "bucket", "doc", F.coalesce("component", "doc").alias("label")
    )
    mixed = labelled.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("doc") % 1_000_000_007).alias("s1"), F.sum(F.hash("doc").cast("long")).alias("s2"),
    ).where("low <> high")
    # Bands often bucket the same documents; of buckets with equal members one is enough.
    once = mixed.groupBy("n", "s1", "s2").agg(F.min("bucket").alias("bucket"))
    rows = labelled.join(once.select("bucket", "n"), "bucket")
    rows = snapshot(rows.where(F.col("n") > 1), "mixed")
    position = F.row_number().over(Window.partitionBy("bucket").orderBy("label", "doc")) - 1
    chunked = rows.withColumn("chunk", F.floor(position / CHUNK).cast("int"))
    chunks = chunked.groupBy("bucket", "chunk").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = chunks.select(F.col("bucket").alias("b2"), F.col("chunk").alias("chunk2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    one_group = (F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2"))
    # Pairs of chunks, not of documents.
    met = chunks.join(other, (F.col("bucket") == F.col("b2")) & (F.col("chunk") <= F.col("chunk2"))).where(~one_group)
    pair = met.select("bucket", F.struct("chunk", "chunk2").alias("pair"), F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("chunk"))
    texts = _texts_of(docs, rows.select("doc"))
    work = chunked.join(pair, ["bucket", "chunk"]).join(texts, "doc").select("bucket", "pair.chunk", "pair.chunk2", "doc", "label", "text")
    kind = rows.schema["doc"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("text", "ascending")])
        docs_here = table.column("doc")
        sets = [shingles(t.as_py(), width) for t in table.column("text")]
        links = group_links(sets, table.column("label").to_pylist(), percent)
        return pa.table({"center": docs_here.take([a for a, _ in links] or pa.array([], pa.int64())), "doc": docs_here.take([b for _, b in links] or pa.array([], pa.int64()))})

    return work.groupBy("bucket", "chunk", "chunk2").applyInArrow(run, f"center {kind}, doc {kind}")


def _memberships(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (center, doc) from the smallest id of a class to those of its ids that have rows in other classes or without
    words too."""
    known = signed.where(F.col("doc_id").isNotNull())
    # Two hashes of the class, both null-safe, instead of the binary key, which would make the aggregation sort.
    ranges = [(F.min(h), F.max(h)) for h in (F.xxhash64("set_key"), F.hash("set_key"))]
    several = known.groupBy("doc_id").agg(*[f.alias(f"r{i}{j}") for i, pair in enumerate(ranges) for j, f in enumerate(pair)])
    several = snapshot(several.where("r00 <> r01 or r10 <> r11").select("doc_id"), "several-classes")
    rows = known.where(F.col("set_key").isNotNull()).join(several, "doc_id", "left_semi").select("doc_id", F.col("set_key").alias("key")).distinct()
    met = rows.join(classes.select("set_key", "doc"), F.col("key") == F.col("set_key"))
    return snapshot(met.where("doc <> doc_id").select(F.col("doc").alias("center"), F.col("doc_id").alias("doc")), "memberships")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    signed = snapshot(signatures(docs, width), "signatures")
    full = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = snapshot(full.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands")), "classes")
    # Classes that share their smallest id are one document.
    buckets = classes.select(F.explode("bands").alias("bucket"), "doc").distinct()
    stars = buckets.groupBy("bucket").agg(F.min("doc").alias("center"), F.max("doc").alias("top")).where("center <> top")
    members = snapshot(buckets.join(stars.select("bucket", "center"), "bucket"), "members")
    pairs = snapshot(members.where("doc <> center").select("center", "doc").distinct(), "pairs")
    memberships = _memberships(signed, classes)
    links = snapshot(_verified(pairs, docs, width, percent), "links").unionByName(memberships)
    labels = components(links, "center", "doc")
    more = snapshot(_between_groups(members.select("bucket", "doc"), labels, docs, width, percent), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more), "center", "doc")
    grouped = classes.select("set_key", "doc").join(labels, F.col("doc") == F.col("node"), "left").select(
        F.col("set_key").alias("key"), F.coalesce("component", "doc").alias("least")
    )
    signed = signed.drop("bands")
    out = signed.where(F.col("set_key").isNotNull()).join(grouped, F.col("set_key") == F.col("key"), "left").select("doc_id", "n_shingles", "least")
    # Rows without words follow the other rows of their id, if it has any.
    blank = signed.where(F.col("set_key").isNull())
    blank = blank.join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.col("component").alias("least"))
    out = out.unionByName(blank)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
