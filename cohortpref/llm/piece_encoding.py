"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is a row of symbols, at first one per character. All adjacent pairs whose joint string is a piece stand on an
agenda ordered by the score of that piece, the leftmost first among equals; the best pair is merged and the pairs with
its two neighbours are put on the agenda. What is left when the agenda is empty are the tokens; a character that is no
piece becomes its UTF-8 bytes. The agendas of all short segments of a chunk are worked off side by side: in every round
each gives its best entry. A long segment has an agenda of its own, a heap, where entries whose symbols have changed
since are passed over.

No piece of such a vocabulary goes on after a space mark that follows something else, so merges never cross the place
before a run of spaces. Texts are cut there, and every distinct segment of a chunk is encoded once. (Should a vocabulary
have such a piece, texts are encoded whole.) Chunks of texts are bounded by bytes; a worker keeps the ids of at most
KEPT short segments.

Only the vocabularies that this method fits are accepted: merge type, with byte pieces, without a character map or
white-space rules, and with a leading space mark; others raise ValueError. `differing` holds the ids against the
library's, in Arrow batches.

Results for odd input: a null or empty text has no tokens and decodes to the empty text; a literal space mark counts as
a space, as in the library; special strings such as `</s>` are ordinary text; rows with equal ids or texts are encoded
one by one; an empty table gives an empty table. Extra columns are handed through when asked for in `keep`; one that
bears the name of a result column is refused.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType

from cohortpref.llm.byte_views import bounded, flat, strings
from cohortpref.llm.packing import gather

MARK = "▁"
KEPT = 150_000
SHORT = 32  # characters of a segment that is worked off side by side with others, and kept
CHUNK = 8 << 20  # bytes of text encoded at a time: the larger, the fewer segments are met again
IDS = ArrayType(IntegerType())
NONE = np.int64(1) << 62  # an agenda entry for no merge

# Fixed values of the model file: field numbers, and the kinds of models and pieces.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_MODEL_TYPE, _SUFFIX_MARK, _BYTE_FALLBACK = 3, 24, 35
_CHARACTER_MAP, _DUMMY_PREFIX, _TRIM, _ESCAPE = 2, 3, 4, 5
_MERGE_TYPE = 2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message: integers, or raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, blob[at : at + size]
            at += size


class PieceVocabulary:
    """Pieces, scores and byte ids of a model file, and the segments encoded so far."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        trainer = dict(_fields(b"".join(v for n, v in parts if n == _TRAINER)))
        normalizer = dict(_fields(b"".join(v for n, v in parts if n == _NORMALIZER)))
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}  # minus the score: the agenda takes the least
        self.byte_ids = [-1] * 256
        kinds = set()
        for number, raw in enumerate(v for n, v in parts if n == _PIECES):
            fields = dict(_fields(raw))
            piece, kind = fields[1].decode("utf-8"), fields.get(3, _NORMAL)
            kinds.add(kind)
            if kind == _NORMAL:
                self.ids[piece] = number
                self.cost[piece] = -struct.unpack("<f", fields.get(2, bytes(4)))[0]
            elif kind == _BYTE:
                self.byte_ids[int(piece[3:5], 16)] = number
        fits = (
            trainer.get(_MODEL_TYPE) == _MERGE_TYPE and trainer.get(_BYTE_FALLBACK) and not trainer.get(_SUFFIX_MARK)
            and not normalizer.get(_CHARACTER_MAP) and normalizer.get(_DUMMY_PREFIX, 1)
            and not normalizer.get(_TRIM, 1) and normalizer.get(_ESCAPE, 1)
            and kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} and -1 not in self.byte_ids
        )
        if not fits:
            raise ValueError(f"{path}: not a merge-type vocabulary with byte pieces and plain white space")
        self.cuts = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        self.kept: dict[str, bytes] = {}
        self._tabulate()

    def _tabulate(self) -> None:
        """Symbols as numbers (the id of a piece, behind all ids the other characters), and every pair of symbols that
        makes a piece: its key, the rank of the piece's score and the piece."""
        self.others = 1 << 20
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.others
        for piece, number in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = number
        rank = {cost: place for place, cost in enumerate(sorted(set(self.cost.values())))}
        pairs = []
        for piece, number in self.ids.items():
            for cut in range(1, len(piece)):
                halves = [self.ids.get(h, self.others + ord(h) if len(h) == 1 else None) for h in (piece[:cut], piece[cut:])]
                if None not in halves:
                    pairs.append((halves[0] << 32 | halves[1], rank[self.cost[piece]], number))
        self.pair_keys, self.pair_ranks, self.pair_pieces = np.array(sorted(pairs) or [(-1, 0, 0)], np.int64).T.copy()

    def _entries(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they make no piece) and joint symbol of pairs of symbols."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE), self.pair_pieces[at]

    def merge_side_by_side(self, texts: list[str]) -> list[bytes]:
        """ids (as bytes) of short, non-empty texts; their spaces count as marks."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = self.symbol[np.frombuffer("".join(texts).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.arange(len(texts)), sizes)
        ranks, joint = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])  # a pair is named by its left place
        ranks[inner], joint[inner] = self._entries(symbols[inner], symbols[inner + 1])
        done_owner, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            # The least rank of every agenda, and among equals the leftmost place.
            best = np.minimum.reduceat(np.where(ranks == NONE, NONE, ranks << 32 | np.arange(len(ranks))), starts)
            ended = best == NONE
            at = best[~ended] & 0xFFFFFFFF
            over = np.repeat(ended, np.diff(np.append(starts, len(owner))))
            done_owner.append(owner[over])
            done_symbols.append(symbols[over])
            symbols[at] = joint[at]
            stays = ~over
            stays[at + 1] = False
            moved = np.cumsum(stays) - 1
            at = moved[at]
            symbols, owner, ranks, joint = symbols[stays], owner[stays], ranks[stays], joint[stays]
            if not len(symbols):
                break
            before = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            has_next = (at + 1 < len(owner)) & (owner[np.minimum(at + 1, len(owner) - 1)] == owner[at])
            after = at[has_next]
            ranks[at[~has_next]] = NONE
            both = np.concatenate([before, after])
            ranks[both], joint[both] = self._entries(symbols[both], symbols[both + 1])
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        owner, symbols = owner[order], symbols[order]
        odd = np.flatnonzero(symbols >= self.others)
        if len(odd):
            as_bytes = [[self.byte_ids[b] for b in chr(s).encode("utf-8", "surrogatepass")] for s in (symbols[odd] - self.others).tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(b) for b in as_bytes]
            owner, symbols = np.repeat(owner, times), np.repeat(symbols, times)
            symbols[symbols >= self.others] = [b for each in as_bytes for b in each]
        raw = symbols.astype("<i4").tobytes()
        ends = np.searchsorted(owner, np.arange(len(texts)), "right") * 4
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge(self, text: str) -> list[int]:
        """ids of a text in which spaces are marks, by the agenda."""
        cost = self.cost
        symbols: list[str | None] = list(text)
        last = len(symbols) - 1
        agenda = []
        for left in range(last):
            joint = symbols[left] + symbols[left + 1]
            if joint in cost:
                agenda.append((cost[joint], left, left + 1, joint))
        if agenda:
            heapq.heapify(agenda)
            before, after = list(range(-1, last)), list(range(1, last + 2))
            while agenda:
                _, left, right, joint = heapq.heappop(agenda)
                a, b = symbols[left], symbols[right]
                # A symbol that was merged away is None; one that has grown makes the joint string longer.
                if a is None or b is None or len(a) + len(b) != len(joint):
                    continue
                symbols[left], symbols[right] = joint, None
                follower = after[right]
                after[left] = follower
                if follower <= last:
                    before[follower] = left
                    wider = joint + symbols[follower]
                    if wider in cost:
                        heapq.heappush(agenda, (cost[wider], left, follower, wider))
                leader = before[left]
                if leader >= 0:
                    wider = symbols[leader] + joint
                    if wider in cost:
                        heapq.heappush(agenda, (cost[wider], leader, left, wider))
        found: list[int] = []
        for symbol in symbols:
            if symbol is None:
                continue
            known = self.ids.get(symbol)
            if known is None:
                found.extend(self.byte_ids[byte] for byte in symbol.encode("utf-8"))
            else:
                found.append(known)
        return found

    def _segment_ids(self, segments: list[str]) -> list[bytes]:
        """ids (as bytes) of distinct segments, spaces written as spaces."""
        found = list(map(self.kept.get, segments))
        new = [i for i, ids in enumerate(found) if ids is None]
        short = [i for i in new if len(segments[i]) <= SHORT]
        if len(self.kept) + len(short) > KEPT:
            self.kept.clear()
        if short:
            texts = [segments[i] for i in short]
            made = self.merge_side_by_side(texts)
            for i, ids in zip(short, made):
                found[i] = ids
            self.kept.update(zip(texts[:KEPT], made))
        if len(short) < len(new):
            for i in new:
                if len(segments[i]) > SHORT:
                    found[i] = array("i", self.merge(segments[i].replace(" ", MARK))).tobytes()
        return found

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """ids (32 bit) of every text."""
        segments, ends = self.segments(texts)
        coded = segments.dictionary_encode()
        found = self._segment_ids(coded.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(found), "<i4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, sizes = gather(ids, sizes, coded.indices.to_numpy())
        places = np.concatenate([[0], np.cumsum(sizes)])[ends]
        return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts, spaces written as spaces, and the numbers of segments before every text."""
        # Every text but an empty one gets a space in front.
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        first = pc.if_else(pc.equal(pc.binary_length(plain), 0), "", " ").cast(pa.large_string())
        plain = pc.binary_join_element_wise(first, plain, pa.scalar("", pa.large_string()))
        data, at = flat(plain)
        space = data == 32
        begins = space.copy()
        if self.cuts:
            begins[1:] &= ~space[:-1]
        else:
            begins[:] = False
        begins[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        return strings(data, ends, pa.large_string()), np.searchsorted(starts, at, "left")


_vocabularies: dict[str, PieceVocabulary] = {}


def vocabulary(path: str) -> PieceVocabulary:
    """The worker's own vocabulary with what it has kept from earlier tasks."""
    if path not in _vocabularies:
        _vocabularies[path] = PieceVocabulary(path)
    return _vocabularies[path]


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _run(docs: DataFrame, keep: tuple[str, ...], made: dict[str, DataType], work) -> DataFrame:
    """`keep` and the columns that `work(texts)` makes of the bounded chunks of `docs.text`."""
    names = list(made)
    if clash := set(keep) & set(names):
        raise ValueError(f"columns {sorted(clash)} are results: rename them first")
    held = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*held, F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "t", CHUNK):
            columns = work(batch.column("t"))
            yield pa.RecordBatch.from_arrays([*[batch.column(f"k{i}") for i in range(len(keep))], *columns], names=[*keep, *names])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in made.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class PieceModel:
    """A model file that exists under the same path on every executor."""

    path: str

    def encode(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """`keep` and ids (array<int>) of every row."""
        path = self.path
        return _run(docs, keep, {"ids": IDS}, lambda texts: [vocabulary(path).encode(texts)])

    def round_trip(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """`keep`, ids and decoded (the text that the library makes of the ids) of every row."""
        path = self.path

        def work(texts: pa.Array) -> list[pa.Array]:
            ids = vocabulary(path).encode(texts)
            library = _library(path)
            return [ids, pa.array([library.decode(x) for x in ids.to_pylist()], pa.string())]

        return _run(docs, keep, {"ids": IDS, "decoded": StringType()}, work)

    def differing(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """`keep`, ids and library_ids of the rows whose ids are not those of the library (none, if all is right)."""
        path = self.path

        def work(texts: pa.Array) -> list[pa.Array]:
            library = _library(path)
            return [vocabulary(path).encode(texts), pa.array([library.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))]

        return _run(docs, keep, {"ids": IDS, "library_ids": IDS}, work).where("ids <> library_ids")


_libraries: dict[str, object] = {}


def _library(path: str):
    if path not in _libraries:
        _libraries[path] = _processor(path)
    return _libraries[path]
