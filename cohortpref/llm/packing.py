"""Packing documents into sequences of bounded length by order-preserving dynamic programming.

Documents are tokenised on the executors and laid one after the other in the order of their ids. A run of them (a
segment) is cut into windows: cost of a window = its padding up to the full length (none for a length that is a
power of two) + the penalty of the place where it ends, 0 at the end of a document, small at the end of a sentence,
larger elsewhere. The best cost up to a place is the least, over the places at most one length before it, of (best cost
there - position there); that minimum slides with the place, so a monotone queue yields it in constant time. Lengths that
are powers of two are looked up one by one.

Order, bounds and recovery: rows are dealt by ranges of doc_id and sorted there; a worker holds one segment of
about SEGMENT tokens (or one document, if that is longer) at a time; a task that is run again sees the same rows in the
same order and gives the same sequences.

Results for odd input: a null or empty text is the end token alone; a document longer than a sequence is spread over
several; rows with equal ids or texts are packed one by one (ties ordered by text); null ids come first; an empty table
gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortpref.llm.common import pieces, text_bytes

LENGTH = 4096
END = 2
SEGMENT = 400_000
SENTENCE_PENALTY = 2.0
MIDDLE_PENALTY = 64.0
PARTITION_BYTES = 24 << 20
CACHE = 250_000
CHUNK_BYTES = 8 << 20  # of text encoded at a time
APOSTROPHE_OR_DIGIT = re.compile(r"['0-9]")
# Texts of Latin-1 characters, without the few that count as numbers or odd white space, are cut by vectorised string
# functions: composing changes nothing in them, their lower case is the same everywhere, and their white space is ASCII's.
ODD = r"[^\x00-\x1b\x20-\x{84}\x{86}-\x{9f}\x{a1}-\x{a9}\x{ab}-\x{b1}\x{b4}-\x{b8}\x{bb}\x{bf}-\x{ff}]|<\|(?:startoftext|endoftext)\|>"
LETTERS = r"([a-z\x{b5}\x{df}-\x{f6}\x{f8}-\x{ff}]+)"
# Words with digits or apostrophes are left to the tokenizer as a whole.
UNEVEN = r"['0-9]"
SENTENCE_MARKS = (".", "!", "?")


def gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered `which` of `flat` (run i has sizes[i] entries), one after the other, and their sizes."""
    starts = np.cumsum(sizes) - sizes
    taken = sizes[which]
    at = np.repeat(starts[which] - (np.cumsum(taken) - taken), taken)
    return flat[at + np.arange(len(at))], taken


class WordTokens:
    """ids of whole texts by a tokenizer that never joins across white space nor between letters and marks: every
    distinct piece is encoded once and kept (bounded). Texts outside Latin-1 and texts that name a special token are encoded
    whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The merges alone, for printable ASCII, which the steps before them leave as it is.
        self.merges = Tokenizer(self.tokenizer.model)
        self.kept: dict[str, bytes] = {}
        ends = [self.tokenizer.token_to_id(m + "</w>") for m in SENTENCE_MARKS]
        self.sentence_ids = np.array([i for i in ends if i is not None], np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """ids (unsigned 32 bit, without an end token) of every text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        ids, sizes = self._latin(texts.filter(pa.array(~odd)))
        runs = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        whole = iter(self.tokenizer.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False))
        return [np.array(next(whole).ids, "<u4") if o else next(runs) for o in odd]

    def _latin(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        uneven = pc.match_substring_regex(words, UNEVEN).to_numpy(zero_copy_only=False)
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(words.filter(pa.array(~uneven)), LETTERS, r" \1 "))
        # Unique words in the order: even ones, then uneven ones.
        place = np.empty(len(words), np.int64)
        place[np.concatenate([np.flatnonzero(~uneven), np.flatnonzero(uneven)])] = np.arange(len(words))
        per_word = np.concatenate([np.diff(cut.offsets.to_numpy()), np.ones(int(uneven.sum()), np.int64)]).astype(np.int64)
        pieces_coded = pa.concat_arrays([cut.flatten(), words.filter(pa.array(uneven))]).dictionary_encode()
        found = self._ids(pieces_coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, sizes = gather(flat, sizes, pieces_coded.indices.to_numpy())  # of the unique words, piece by piece
        ends = np.concatenate([[0], np.cumsum(sizes)])
        borders = ends[np.concatenate([[0], np.cumsum(per_word)])]
        flat, sizes = gather(flat, np.diff(borders), place[at])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return flat, np.diff(ends[lists.offsets.to_numpy()])

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.kept) > CACHE:
            self.kept.clear()
        new = [p for p in pieces if p not in self.kept]
        # An uneven word is more than one piece; all others are one.
        plain = [p.isascii() and p.isprintable() and not APOSTROPHE_OR_DIGIT.search(p) for p in new]
        for tokenizer, wanted in ((self.merges, True), (self.tokenizer, False)):
            chosen = [p for p, is_plain in zip(new, plain) if is_plain == wanted]
            for start in range(0, len(chosen), 5000):
                batch = chosen[start : start + 5000]
                for piece, code in zip(batch, tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                    ids = code.ids
                    self.kept[piece] = pack_ids(f"<{len(ids)}I", *ids)
        return [self.kept[p] for p in pieces]


_tokenizers: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own tokenizer with what it has kept from earlier tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence_ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending, the last one the end of the segment; and their penalties."""
    total = len(ids)
    sentence = np.flatnonzero(np.isin(ids, sentence_ids)) + 1
    marks = np.union1d(sentence, ends)
    edges = np.concatenate([[0], marks])
    gaps = np.flatnonzero(np.diff(edges) > length // 8)
    # Long stretches without a mark get places at regular distances, so that a window can always end.
    extra = [np.arange(edges[g] + length // 8, edges[g + 1], length // 8) for g in gaps]
    places = np.union1d(marks, np.concatenate(extra)) if extra else marks
    places = places[(places > 0) & (places <= total)]
    penalty = np.full(len(places), MIDDLE_PENALTY)
    penalty[np.isin(places, sentence)] = SENTENCE_PENALTY
    penalty[np.isin(places, ends)] = 0.0
    return places, penalty


def best_cuts(places: list[int], penalty: list[float], length: int) -> list[int]:
    """Ends of the windows of least total cost."""
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    # Windows that are short for no need only pay at the end of a segment.
    long_powers, end_part = [p for p in powers if 8 * p >= length], (places[-1] if places else 0) - 2 * length
    points = [0, *places]
    index = {p: i for i, p in enumerate(points)}
    best = [0.0] * len(points)
    came = [0] * len(points)
    queue: deque[int] = deque([0])  # indices with rising best[i] + points[i]
    keys = [0.0] * len(points)
    for j in range(1, len(points)):
        p = points[j]
        while points[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        cost, source = keys[i] + length - p, i
        if cost > best[i]:  # there is padding to save
            for power in powers if p > end_part else long_powers:
                i = index.get(p - power)
                if i is not None and best[i] < cost:
                    cost, source = best[i], i
        best[j] = cost = cost + penalty[j - 1]
        came[j] = source
        keys[j] = key = cost + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(points) - 1
    while j > 0:
        cuts.append(points[j])
        j = came[j]
    return cuts[::-1]


@dataclass
class Packer:
    """Takes documents in order and gives the pieces of a segment when it is full."""

    tokens: WordTokens
    length: int
    first_sequence: int
    names: tuple[str, ...] = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __post_init__(self):
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.size += len(ids)

    def flush(self) -> list[tuple]:
        if not self.docs:
            return []
        ids = np.concatenate([x for _, x in self.docs])
        sizes = np.array([len(x) for _, x in self.docs])
        ends = np.cumsum(sizes)
        places, penalty = cut_places(ids, ends, self.tokens.sentence_ids, self.length)
        cuts = np.array(best_cuts(places.tolist(), penalty.tolist(), self.length))
        starts = ends - sizes
        # A piece lies between two neighbours of all document and window borders.
        borders = np.union1d(np.concatenate([[0], ends]), cuts)
        lows, highs = borders[:-1], borders[1:]
        doc = np.searchsorted(ends, lows, "right")
        window = np.searchsorted(cuts, lows, "right")
        window_start = np.concatenate([[0], cuts])[window]
        raw = memoryview(ids.astype("<u4").tobytes())
        out = [
            (self.docs[d][0], int(a - starts[d]), int(b - a), zlib.crc32(raw[4 * a : 4 * b]), int(sizes[d]),
             self.first_sequence + int(w), int(a - s))
            for d, a, b, w, s in zip(doc.tolist(), lows.tolist(), highs.tolist(), window.tolist(), window_start.tolist())
        ]
        self.first_sequence += len(cuts)
        self.docs, self.size = [], 0
        return out


SCHEMA = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, segment: int = SEGMENT) -> DataFrame:
    """One row per piece. `tokenizer` is a path that exists on every executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = pieces(text_bytes(docs), PARTITION_BYTES, docs.sparkSession.sparkContext.defaultParallelism)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = SCHEMA.format(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        packer = Packer(tokens, length, TaskContext.get().partitionId() << 40)
        tail = np.array([end], "<u4")

        def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64() if k else kind) for k, c in enumerate(zip(*rows))]
            return pa.RecordBatch.from_arrays(columns, names=list(packer.names))

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            run_chars, first = 0, 0
            for at, size in enumerate(sizes):
                run_chars += size
                if run_chars < CHUNK_BYTES and at + 1 < len(ids):
                    continue
                for doc_id, code in zip(ids[first : at + 1], tokens.encode(texts[first : at + 1])):
                    packer.add(doc_id, np.concatenate([code, tail]))
                    if packer.size >= segment:
                        yield batch_of(packer.flush(), id_type)
                first, run_chars = at + 1, 0
        if rows := packer.flush():
            yield batch_of(rows, id_type)

    return ordered.mapInArrow(run, schema)
