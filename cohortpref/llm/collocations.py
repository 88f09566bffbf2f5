"""Phrase collocations by counting quotient filters.

1. Documents are cut into words and pieces (no phrase crosses a piece) and written once as shards: texts of one language,
   as numbers into the shard's own dictionary of distinct words and their counts.
2. Words are counted over all shards and the frequent ones get ids; a phrase that is frequent has frequent words only.
3. Every shard packs its n-grams of word ids into an integer of two halves, permutes it by a Feistel network, which can be
   undone, and counts equal ones. The upper bits of the permuted number are the quotient, all others the remainder, kept
   in full: nothing is lost. A filter holds, in the order of quotients, one bit per n-gram and quotient (unary run
   lengths), the remainders as byte planes, and the counts (one byte, longer ones apart).
4. Filters are cut by quotient and merged across shards, in rounds of at most 2**FAN_BITS cuts, so that the number of
   filters stays in proportion to the data and a task holds about PART_KEYS entries. Quotients of permuted numbers are
   even, however frequent a phrase is. After the last round the frequent n-grams are unpermuted.
5. Cuts, scores and containment are joins over the frequent n-grams; words come back for the few that may be among the
   first of their language.

Results for odd input: a null text has no words; a null language is `und`, together with documents so labelled; repeated
rows count each time; an empty table gives an empty table; other columns, doc_id among them, do not enter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortpref.llm.byte_views import bounded, flat, runs, strings
from cohortpref.llm.common import mix, pieces
from cohortpref.session import snapshot

LONGEST = 4
LEAST = 30
TOP = 2000
CONTAINED_PERCENT = 80
SHARD_BYTES = 4 << 20  # of text in a shard, or one text if that is longer
HELD_BYTES = 16 << 20  # of text that a task holds for shards to come
WORD_ROWS = 400_000  # dictionary entries that a task numbers
PART_KEYS = 1_000_000  # entries of a filter after the last round
FAN_BITS = 8
SALTS = 64

_ROUND_KEYS = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
# Kinds of bytes: 0 of a word, 1 between words, 2 between pieces. A-Z become lower case.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

SHARDS = "shard long, lang string, n_words long, words array<string>, counts array<long>, codes binary"
FILTERS = "lang string, n int, grp long, prefix long, filter binary"
GRAMS = "lang string, ids array<long>, f long"


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and which of them begin a piece."""
    data, at = flat(texts)
    kind = _KIND[data]
    starts, ends = runs(kind == 0, at)
    breaks = np.concatenate([[0], np.cumsum(kind == 2)])[starts]
    owner = np.searchsorted(at, starts, "right")
    begins = np.ones(len(starts), bool)
    begins[1:] = (breaks[1:] != breaks[:-1]) | (owner[1:] != owner[:-1])
    return strings(_LOWER[data[kind == 0]], np.cumsum(ends - starts)), begins


def _planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as `width` byte planes, the lowest first."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(blob: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of SHARDS. A code is 0 between pieces, else 1 + the place of the word in the shard's dictionary, the most
    frequent word first."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def row(lang: str, texts: list[pa.Array], shard: int) -> pa.RecordBatch:
        words, begins = cut_words(pa.concat_arrays(texts))
        coded = words.dictionary_encode()
        places, distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        counts = np.bincount(places, minlength=distinct)
        order = np.argsort(-counts, kind="stable")
        code = np.empty(distinct, np.int64)
        code[order] = np.arange(1, distinct + 1)
        codes = np.zeros(len(places) + int(begins.sum()), np.int64)
        codes[np.arange(len(places)) + np.cumsum(begins)] = code[places] if distinct else 0
        names = coded.dictionary.take(pa.array(order)).cast(pa.large_string()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int64()), pa.array([lang], pa.string()), pa.array([len(places)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, distinct], pa.int32()), names),
                pa.ListArray.from_arrays(pa.array([0, distinct], pa.int32()), pa.array(counts[order], pa.int64())),
                pa.array([struct.pack("<Q", len(codes)) + _planes(codes, 4)], pa.binary()),
            ],
            names=["shard", "lang", "n_words", "words", "counts", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def full(limit: int, total: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            # The largest first, until what is held is within bounds.
            for lang in sorted(sizes, key=sizes.get, reverse=True):
                if sizes[lang] < limit and sum(sizes.values()) <= total:
                    break
                del sizes[lang]
                yield row(lang, held.pop(lang), number)
                number += 1

        for batch in bounded(batches, "text"):
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, k))
                held.setdefault(lang, []).append(texts.cast(pa.large_string()))
                sizes[lang] = sizes.get(lang, 0) + (pc.sum(pc.binary_length(texts)).as_py() or 0)
            yield from full(shard_bytes, HELD_BYTES)
        yield from full(0, 0)

    return rows.mapInArrow(run, SHARDS)


def number_words(written: DataFrame, least: int, word_rows: int = WORD_ROWS) -> tuple[DataFrame, int]:
    """Rows (shard, pos, lang, id, f, word) of the words that occur `least` times or more in their language; the word only
    in one row of each. And the number of bits of an id: words are dealt by a hash into parts and numbered there."""
    total = written.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = pieces(total, word_rows)
    entries = written.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "entry"))
    entries = entries.select("shard", "lang", "pos", F.col("entry.words").alias("word"), F.col("entry.counts").alias("count"))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int"))
    least_tasks = entries.sparkSession.sparkContext.defaultParallelism
    dealt = entries.repartition(max(parts, least_tasks), "lang", "part")
    same = Window.partitionBy("lang", "part", "word")
    counted = dealt.withColumns({"f": F.sum("count").over(same), "first": F.min("shard").over(same)}).where(F.col("f") >= least)
    numbered = counted.withColumn("local", F.dense_rank().over(Window.partitionBy("lang", "part").orderBy("word")).cast("long"))
    numbered = snapshot(
        numbered.select("shard", "pos", "lang", "part", "local", "f", F.when(F.col("shard") == F.col("first"), F.col("word")).alias("word")), "word-ids"
    )
    # Ids from 1 on: the places of all parts in turn.
    bits = ((numbered.agg(F.max("local")).first()[0] or 1) * parts).bit_length()
    if bits > 32:
        raise ValueError(f"ids of {bits} bits: phrases of four words pack at most 32 bits a word")
    word_id = (F.col("local") - 1) * parts + F.col("part") + 1
    return numbered.select("shard", "pos", "lang", word_id.alias("id"), "f", "word"), bits


def halves(n: int, bits: int) -> tuple[int, int]:
    """Bits of the two halves of a packed n-gram: the first half of its words, rounded up, and the others."""
    return (n + 1) // 2 * bits, n // 2 * bits


def permute(left: np.ndarray, right: np.ndarray, sizes: tuple[int, int], undo: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Four rounds of an unbalanced Feistel network: each half in turn is changed by a hash of the other one."""
    for k in (3, 2, 1, 0) if undo else (0, 1, 2, 3):
        if k % 2 == 0:
            left = left ^ (mix(right ^ _ROUND_KEYS[k]) >> np.uint64(64 - sizes[0]))
        else:
            right = right ^ (mix(left ^ _ROUND_KEYS[k]) >> np.uint64(64 - sizes[1]))
    return left, right


def pack(windows: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of n-grams, given as n columns of ids."""
    first = (len(windows) + 1) // 2
    out = []
    for columns in (windows[:first], windows[first:]):
        value = np.zeros(len(windows[0]), np.uint64)
        for column in columns:
            value = value << np.uint64(bits) | column.astype(np.uint64)
        out.append(value)
    return out[0], out[1]


def unpack(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The ids of packed n-grams, one row each."""
    mask, columns = np.uint64((1 << bits) - 1), []
    for value, words in ((left, (n + 1) // 2), (right, n // 2)):
        columns += [(value >> np.uint64(bits * (words - 1 - k))) & mask for k in range(words)]
    return np.stack(columns, axis=1).astype(np.int64) if len(left) else np.empty((0, n), np.int64)


def add_up(left: np.ndarray, right: np.ndarray, counts: np.ndarray, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (left, right) in ascending order and the sums of their counts."""
    if not len(left):
        return left, right, counts
    order = np.argsort(left << np.uint64(sizes[1]) | right, kind="stable") if sum(sizes) <= 64 else np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return left[first], right[first], np.add.reduceat(counts[order], first)


def count_equal(left: np.ndarray, right: np.ndarray, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `add_up`, every entry counting once."""
    if not len(left) or sum(sizes) > 64:
        return add_up(left, right, np.ones(len(left), np.int64), sizes)
    keys = left << np.uint64(sizes[1]) | right
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> np.uint64(sizes[1]), keys & np.uint64((1 << sizes[1]) - 1), counts


def to_filter(left: np.ndarray, right: np.ndarray, counts: np.ndarray, sizes: tuple[int, int], prefix_bits: int) -> bytes:
    """The filter of ascending distinct entries whose upper `prefix_bits` bits are equal (and not stored)."""
    n, free = len(left), sizes[0] - prefix_bits
    q = min(free, n.bit_length())
    rest = free - q
    body = left & np.uint64((1 << free) - 1)
    quotient = (body >> np.uint64(rest)).astype(np.int64)
    bits = np.zeros((1 << q) + n, np.uint8)
    bits[quotient + np.arange(n)] = 1
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<i8")
    low = _planes(body & np.uint64((1 << rest) - 1), (rest + 7) // 8)
    return b"".join([struct.pack("<QQB", n, len(large), q), np.packbits(bits).tobytes(), low, _planes(right, (sizes[1] + 7) // 8), small.tobytes(), large.tobytes()])


def from_filter(blob: bytes, sizes: tuple[int, int], prefix: int, prefix_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts) of a filter."""
    view = memoryview(blob)
    n, n_large, q = struct.unpack_from("<QQB", view)
    at = struct.calcsize("<QQB")
    free = sizes[0] - prefix_bits
    rest, length = free - q, (1 << q) + n
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(view, np.uint8, (length + 7) // 8, at), count=length))
    at += (length + 7) // 8
    left = (ones - np.arange(n)).astype(np.uint64) << np.uint64(rest)
    wide = (rest + 7) // 8
    left |= _from_planes(view[at:], n, wide)
    at += n * wide
    left |= np.uint64(prefix << free)
    wide = (sizes[1] + 7) // 8
    right = _from_planes(view[at:], n, wide)
    at += n * wide
    counts = np.frombuffer(view, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(view, "<i8", n_large, at + n)
    return left, right, counts


def slices(left: np.ndarray, right: np.ndarray, counts: np.ndarray, sizes: tuple[int, int], prefix_bits: int) -> Iterator[tuple[int, bytes]]:
    """(prefix, filter) of ascending entries, cut by the upper `prefix_bits` bits."""
    prefix = (left >> np.uint64(sizes[0] - prefix_bits)).astype(np.int64) if prefix_bits else np.zeros(len(left), np.int64)
    present, first = np.unique(prefix, return_index=True)
    for p, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(left)]):
        yield p, to_filter(left[a:b], right[a:b], counts[a:b], sizes, prefix_bits)


def _rounds(keys: int, part_keys: int, least_bits: int, most_bits: int) -> list[tuple[int, int]]:
    """(bits of the prefix, groups of shards) of every round; in the last one all shards are one group."""
    bits = min(most_bits, max(least_bits, (pieces(keys, part_keys) - 1).bit_length()))
    steps = [*range(FAN_BITS, bits, FAN_BITS), bits]
    return [(b, pieces(keys >> b, part_keys) if b < bits else 1) for b in steps]


def _filter_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "n", "grp", "prefix", "filter"])


def frequent_grams(
    written: DataFrame, ids: DataFrame, bits: int, longest: int = LONGEST, least: int = LEAST, part_keys: int = PART_KEYS
) -> DataFrame:
    """Rows of GRAMS: the n-grams (2 to `longest` words) that occur `least` times or more in their language."""
    spark = written.sparkSession
    keys = written.agg(F.sum("n_words")).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    # At least one filter per core, as far as the left half of a pair of words has quotients for it.
    rounds = _rounds(keys, part_keys, (cores - 1).bit_length() if keys > part_keys else 0, halves(2, bits)[0])
    first_bits, first_groups = rounds[0]

    def shard_filters(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _filter_rows([])
        shard, lang = left.column("shard")[0].as_py(), left.column("lang")[0].as_py()
        blob = left.column("codes")[0].as_buffer()
        codes = _from_planes(memoryview(blob)[8:], struct.unpack_from("<Q", blob)[0], 4).astype(np.uint32)
        table = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
        table[right.column("pos").to_numpy() + 1] = right.column("id").to_numpy()
        words = table[codes]
        rows = []
        for n in range(2, longest + 1):
            if len(words) < n:
                break
            whole = np.ones(len(words) - n + 1, bool)
            for k in range(n):
                whole &= words[k : len(words) - n + 1 + k] > 0
            places = np.flatnonzero(whole)
            sizes = halves(n, bits)
            entries = count_equal(*permute(*pack([words[places + k] for k in range(n)], bits), sizes), sizes)
            rows += [(lang, n, shard % first_groups, p, f) for p, f in slices(*entries, sizes, first_bits)]
        return _filter_rows(rows)

    tasks = pieces(keys, part_keys, cores)
    codes = written.select("shard", "lang", "codes").repartition(tasks, "shard")
    known = ids.select(F.col("shard").alias("at"), "pos", "id").repartition(tasks, "at")
    state = codes.groupBy("shard").cogroup(known.groupBy("at")).applyInArrow(shard_filters, FILTERS)
    for step, (held_bits, _) in enumerate(rounds):
        following = rounds[step + 1] if step + 1 < len(rounds) else None
        names = ("lang", "n", "grp", "prefix")
        dealt = state.repartition(max(cores, min(2 * tasks, 1 << 16)), *names)
        state = dealt.groupBy(*names).applyInArrow(_merging(bits, held_bits, following, least), FILTERS if following else GRAMS)
    return state


def _merging(bits: int, held_bits: int, following: tuple[int, int] | None, least: int):
    """The merge of the filters of one prefix: into filters for the following round, or into the frequent n-grams."""

    def merged(table: pa.Table) -> pa.Table:
        lang, n, group = (table.column(c)[0].as_py() for c in ("lang", "n", "grp"))
        sizes, prefix = halves(n, bits), table.column("prefix")[0].as_py()
        parts = [from_filter(f.as_py(), sizes, prefix, held_bits) for f in table.column("filter")]
        left, right, counts = add_up(*[np.concatenate(column) for column in zip(*parts)], sizes)
        if following:
            return _filter_rows([(lang, n, group % following[1], p, f) for p, f in slices(left, right, counts, sizes, following[0])])
        often = counts >= least
        found = unpack(*permute(left[often], right[often], sizes, undo=True), n, bits)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * n, pa.int32()), pa.array(found.ravel(), pa.int64()))
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "ids": lists, "f": pa.array(counts[often], pa.int64())})

    return merged


def _scored(grams: DataFrame, single: DataFrame) -> DataFrame:
    """lang, ids, a, l, r, score of every candidate: of its cuts the one of the lowest score, then of the shortest head."""
    every = grams.unionByName(single.select("lang", F.array("id").alias("ids"), "f"))
    cuts = grams.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    heads = every.select("lang", F.col("ids").alias("head"), F.col("f").alias("l"))
    tails = every.select("lang", F.col("ids").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    # Decimals: the product may pass 64 bits. The quotient is at most a million.
    wide = "cast({} as decimal(20, 0))"
    score = F.expr(f"({wide.format('a')} * 2000000BD) div ({wide.format('l')} + {wide.format('r')})")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def _contained(grams: DataFrame, percent: int) -> DataFrame:
    """lang, ids, most: how often the most frequent longer phrase around a phrase occurs."""
    longer = grams.where(F.size("ids") > 2).select("lang", "ids", "f", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("m"))
    inside = longer.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - F.col("m") + 1), lambda s: F.slice("ids", s, F.col("m")))).alias("ids"))
    return inside.groupBy("lang", "ids").agg(F.max("f").alias("most"))


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, contained_percent: int = CONTAINED_PERCENT,
    shard_bytes: int = SHARD_BYTES, part_keys: int = PART_KEYS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of every language."""
    written = snapshot(shards(docs, shard_bytes), "shards")
    ids, bits = number_words(written, least)
    grams = snapshot(frequent_grams(written, ids, bits, longest, least, part_keys), "grams")
    words = snapshot(ids.where(F.col("word").isNotNull()).select("lang", "id", "f", "word"), "words")
    around = _contained(grams, contained_percent).withColumnRenamed("lang", "in_lang").withColumnRenamed("ids", "in_ids")
    scored = _scored(grams, words).join(around, (F.col("lang") == F.col("in_lang")) & (F.col("ids") == F.col("in_ids")), "left")
    decimal = lambda c: F.col(c).cast("decimal(20, 0)")
    dropped = F.coalesce(decimal("most") * 100 >= decimal("a") * contained_percent, F.lit(False))
    scored = scored.where(~dropped).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    # The first of every salt, ties included, before the words come back; then the first of each language.
    ahead = F.rank().over(Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a")))
    few = snapshot(scored.withColumn("ahead", ahead).where(F.col("ahead") <= top).drop("ahead", "in_lang", "in_ids", "most"), "best")
    spelt = few.select("lang", "ids", F.posexplode("ids").alias("pos", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    spelt = spelt.groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("spelt"))
    named = few.join(spelt.select("lang", "ids", F.array_join("spelt.word", " ").alias("phrase")), ["lang", "ids"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    named = named.withColumn("ahead", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("ahead") <= top)
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = written.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
