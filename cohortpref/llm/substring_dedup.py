"""Substring dedup: difference-cover anchors.

A window of WIDTH words that also starts anywhere else (in another document or in the same one) marks all its words for
removal. To find such windows, runs of ANCHOR words are hashed at cover positions only: positions whose remainder
modulo PERIOD lies in COVER, a set whose differences give every remainder. For two equal windows, some offset below PERIOD is
a cover position in both, and since ANCHOR + PERIOD - 1 = WIDTH the anchor there lies inside them: every repeated window
contains a repeated aligned anchor. The second pass extends repeated anchors to the windows around them and counts
those; the third marks the words. Windows are judged on the input. Counts are made by `blocks`, so no pairs of
positions are formed, and a passage of a third of all documents is one entry per block.

Results for odd input: a null or empty text has no words and an empty kept text; texts shorter than WIDTH stay; all copies
of a repeated text lose their windows; rows with equal ids are separate documents; an empty table gives an empty table.
Other columns pass through when asked for in `keep`; one named like a result column gives way to the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortpref.llm.blocks import ASK, answer, ask, asked, block_number, deal, meet, repeated_keys
from cohortpref.llm.common import Aside, WordHashes, power_window_hashes, window_hashes, words_of

WIDTH = 35
# A perfect difference set: its differences give every remainder modulo 21 but 0 exactly once.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
ANCHOR = WIDTH - PERIOD + 1

_hashes = WordHashes()


def cover_positions(n: int) -> np.ndarray:
    """Cover positions below n."""
    starts = np.arange(0, n, PERIOD)[:, None] + np.array(COVER)
    return starts.ravel()[starts.ravel() < n]


def anchors(hashes: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one document."""
    every = window_hashes(hashes, width - PERIOD + 1)
    at = cover_positions(len(every))
    return at, every[at]


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)


def _documents(table: pa.Table) -> list[np.ndarray]:
    return [_hashes.of(words_of(value.as_py())) for value in table.column("text")]


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if len(sorted_set) == 0 or len(values) == 0:
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _set_of(answers: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(answers), "<u8").astype(np.uint64)


def candidate_windows(hashes: np.ndarray, repeated: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that contain a repeated anchor."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.int64)
    at, keys = anchors(hashes, width)
    hit = at[_member(keys, repeated)]
    change = np.zeros(n + 1, np.int64)
    # An anchor at p lies in the windows that start from p - (PERIOD - 1) to p.
    np.add.at(change, np.maximum(hit - (PERIOD - 1), 0).clip(max=n), 1)
    np.add.at(change, (hit + 1).clip(max=n), -1)
    return np.flatnonzero(np.cumsum(change[:n]) > 0)


def covered_words(hashes: np.ndarray, repeated: np.ndarray, width: int) -> np.ndarray:
    """True for every word inside a repeated window."""
    n = len(hashes)
    starts = np.flatnonzero(_member(power_window_hashes(hashes, width), repeated))
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:n]) > 0


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH) -> DataFrame:
    """`keep`, n_words, n_removed and kept_text (the words left, joined by one space) of every row."""
    if width <= PERIOD:
        raise ValueError(f"the window must be wider than the period {PERIOD}")
    aside = Aside(docs, ("doc_id", "text"), keep, ("n_words", "n_removed", "kept_text"))
    docs, keep = aside.rows, aside.keep
    blocks = deal(docs, tuple(dict.fromkeys([*keep, "text"])))
    parts = blocks.count

    def anchor_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _distinct([anchors(h, width)[1] for h in _documents(table)])

    def window_keys(table: pa.Table, answers: list[bytes]) -> pa.Table:
        repeated = _set_of(answers)
        found = []
        for h in _documents(table):
            starts = candidate_windows(h, repeated, width)
            if len(starts):
                found.append(power_window_hashes(h, width)[starts])
        return asked(block_number(table), *_distinct(found), parts)

    schema = docs.select(*keep).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def finish(table: pa.Table, answers: list[bytes]) -> pa.Table:
        repeated = _set_of(answers)
        totals, removed, kept = [], [], []
        for value in table.column("text"):
            words = words_of(value.as_py())
            gone = covered_words(_hashes.of(words), repeated, width) if len(words) >= width else np.zeros(len(words), bool)
            lost = int(gone.sum())
            totals.append(len(words))
            removed.append(lost)
            left = [words[i] for i in np.flatnonzero(~gone)] if lost else words
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        out = table.select(list(keep))
        for name, column, kind in (("n_words", totals, pa.int64()), ("n_removed", removed, pa.int64()), ("kept_text", kept, pa.string())):
            out = out.append_column(name, pa.array(column, kind))
        return out

    windows = meet(blocks, answer(ask(blocks, anchor_keys), repeated_keys, parts), window_keys, ASK)
    return aside.back(meet(blocks, answer(windows, repeated_keys, parts), finish, schema))
