"""LM scoring with a weighted backoff automaton.

The n-grams of the training text up to ORDER words become a table of states, arcs and failure arcs. A state is a context of
at most ORDER - 1 words that occurs in training (the start of a text counts as a word); the root has none. A state h has an
arc for every word w seen after it, with probability P(w | h) = (c(h w) + K P(w | h')) / (c(h) + K), where h' is h without
its first word, and a failure arc to h' with weight K / (c(h) + K). The root has an arc for every training word,
p(w) = (c(w) - D) / N, and one for any unknown word, D V / N. D is the discount n1 / (n1 + 2 n2) of the words seen once and
twice. The probabilities of every state sum to 1 over the training words and one unknown word.

A text is read once from left to right and the state is carried along: the next word's arc is taken where the state has
it, otherwise the weight of the failure arc is added and the shorter context tried, down to the root. The next state is
the longest known context that ends in the word: the n-gram just matched, without its first word if it has ORDER words.
Texts are read in lanes, one step of all lanes at a time; a long text is cut into several lanes, each of which starts in the
state that its place has in the table.

A worker does not hold the automaton of the corpus: a block asks for the counts of its own distinct n-grams (`blocks`) and
builds the states and arcs that its texts can reach. It first asks about words and pairs; the answers about the words bring
the totals of the corpus (N, V, n1, n2), part by part. A longer n-gram can occur in
another block only if all its pairs do, so only those are asked about then; of the others the block has the whole count
itself. So the model grows with the corpus, no worker holds more than
one block, and a hot n-gram is one entry per block.

Results for odd input: a null or empty text is the end token alone; an empty training part makes every word unknown, with
probability 1; rows with equal ids are separate, repeated rows get equal scores; an empty table gives an empty table. Kept
columns pass through, also ones named like a column used here; one named like a result gives way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpref.llm.blocks import (
    ASK,
    answer,
    asked,
    block_number,
    counts_elsewhere,
    deal,
    meet,
    read_elsewhere,
)
from cohortpref.llm.common import Aside, WordHashes, mix, words_of

ORDER = 3
K = 50.0
BASE = 0.1
# Stand for the end and the start of a text; no word hashes are made equal to them but by chance of 2**-64.
END = np.uint64(0xE4D0000000000001)
START = np.uint64(0x57A7000000000003)
WORD_SHARE = 8  # the words go to this share of the parts, as a block has fewer of them than pairs
HEADING = 32
LANE = 1024  # words of a text that one lane reads

_hashes = WordHashes()


@dataclass(frozen=True)
class CorpusTotals:
    tokens: int  # N
    words: int  # V
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return min(0.95, max(0.05, self.once / (self.once + 2 * self.twice))) if self.once else 0.5


def _tokens(texts: Iterator[str | None]) -> list[np.ndarray]:
    """Per text START, its words lower-cased, END."""
    edge = (np.array([START]), np.array([END]))
    return [np.concatenate([edge[0], _hashes.of(words_of(t, lower=True)), edge[1]]) for t in texts]


def totals_heading(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """What a part of the words adds to the totals of the corpus. Words of held-out texts alone have no count, and the start
    of a text is no token."""
    counts = counts[keys != START]
    return np.array([counts.sum(), (counts > 0).sum(), (counts == 1).sum(), (counts == 2).sum()], "<i8").tobytes()


def read_totals(answers: list[bytes], word_parts: int) -> tuple[CorpusTotals, list[bytes]]:
    """The totals of the corpus, and the answers without them."""
    heads = [np.frombuffer(a, "<i8", 4) for a in answers[:word_parts]]
    return CorpusTotals(*np.sum(heads, axis=0).tolist()), [a[HEADING:] for a in answers[:word_parts]] + answers[word_parts:]


def counted(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct keys, and how often each is among the learnt ones."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    distinct, counts = ordered[first], np.diff(first, append=len(ordered))
    held, n = np.unique(keys[~learnt], return_counts=True)
    counts[np.searchsorted(distinct, held)] -= n
    return distinct, counts


@dataclass(frozen=True)
class Grams:
    """The n-grams of a block: `distinct` holds their ascending keys, `at[j]` which of them the j words that end at a
    place form (-1 where the text has not so many yet), `place` one place of every n-gram, `length` its words."""

    starts: np.ndarray  # places of START
    sizes: np.ndarray  # places of every text, START included
    distinct: np.ndarray
    place: np.ndarray
    length: np.ndarray
    at: list[np.ndarray]


def extended(grams: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Keys of the n-grams that end at every place and are one word longer than `grams`, the ones that end there."""
    return mix(np.concatenate([np.zeros(1, np.uint64), grams[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + mix(flat + np.uint64(0x632BE59BD9B4E019)))


def grams_of(tokens: list[np.ndarray], order: int) -> Grams:
    sizes = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(tokens)
    depth = np.arange(len(flat)) - np.repeat(starts, sizes)  # words before a place in its text
    keys, places = [flat], [np.arange(len(flat))]
    whole = flat
    for j in range(2, order + 1):
        whole = extended(whole, flat)
        places.append(np.flatnonzero(depth >= j - 1))
        keys.append(whole[places[-1]])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])
    one_place = np.empty(len(distinct), np.int64)
    length = np.empty(len(distinct), np.int8)
    for j, (place, end) in enumerate(zip(places, ends), 1):
        found = inverse[end - len(place) : end]
        one_place[found], length[found] = place, j
    at: list[np.ndarray] = [np.empty(0, np.int32)]
    for place, end in zip(places, ends):
        ids = np.full(len(flat), -1, np.int32)
        ids[place] = inverse[end - len(place) : end]
        at.append(ids)
    return Grams(starts, sizes, distinct, one_place, length, at)


def root_probability(count: np.ndarray, totals: CorpusTotals) -> np.ndarray:
    if totals.tokens == 0:
        return np.ones(len(count))
    d = totals.discount
    return np.where(count > 0, count - d, d * totals.words) / totals.tokens


def asked_first(grams: Grams) -> np.ndarray:
    """The words, then the pairs, in the order of the answers about them."""
    return np.concatenate([np.flatnonzero(grams.length == j) for j in (1, 2)])


def open_grams(grams: Grams, elsewhere: np.ndarray) -> np.ndarray:
    """The n-grams of three words and more that may occur in other blocks: those whose pairs all do. `elsewhere` is
    about those that `asked_first` names."""
    found = np.zeros(len(grams.distinct), bool)
    found[asked_first(grams)] = elsewhere
    if len(grams.at) < 4:
        return np.empty(0, np.int64)
    here = found[grams.at[2]] & (grams.at[2] >= 0)
    for j in range(3, len(grams.at)):
        here = here & np.concatenate([[False], here[:-1]])  # all pairs of the j words that end here
        long = grams.length == j
        found[long] = here[grams.place[long]]
    return np.flatnonzero(found & (grams.length > 2))


@dataclass(frozen=True)
class Automaton:
    """The states and arcs that the texts of a block can reach, one entry per n-gram of the block."""

    known: np.ndarray  # seen in training: it is an arc of its context and, if short enough, a state
    arc: np.ndarray  # log10 P(last word | the words before)
    failure: np.ndarray  # log10 weight of the failure arc of the state


def build_automaton(grams: Grams, counts: np.ndarray, totals: CorpusTotals, k: float) -> Automaton:
    known = counts > 0
    arc = np.log10(root_probability(counts, totals), out=np.zeros(len(counts)), where=grams.length == 1)
    for j in range(2, len(grams.at)):
        some = np.flatnonzero(known & (grams.length == j))
        place = grams.place[some]
        # The shorter n-gram is seen wherever the longer one is.
        lower, context = grams.at[j - 1][place], grams.at[j - 1][place - 1]
        arc[some] = np.log10((counts[some] + k * 10.0 ** arc[lower]) / (counts[context] + k))
    return Automaton(known, arc, np.log10(k / (counts + k)))


def traverse(grams: Grams, table: Automaton, lane: int = LANE) -> np.ndarray:
    """log10 probability of every text. The state of a lane is its number of context words: with the place that names
    its n-gram in the table, and 0 is the root."""
    order = len(grams.at) - 1
    words = grams.sizes - 1
    lanes = -(-words // lane)
    text = np.repeat(np.arange(len(words)), lanes)
    part = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = grams.starts[text] + part * lane  # the place before the lane's first word
    steps = np.minimum(words[text] - part * lane, lane)
    by_length = np.argsort(-steps, kind="stable")
    text, begin, steps = text[by_length], begin[by_length], steps[by_length]
    state = np.zeros(len(begin), np.int64)
    for j in range(1, order):
        here = grams.at[j][begin]
        state[(here >= 0) & table.known[here]] = j
    sums = np.zeros(len(begin))
    active = np.searchsorted(-steps, -np.arange(1, steps[0] + 1), "right") if len(steps) else ()
    for step, running in enumerate(active, 1):
        place = begin[:running] + step
        now, gained = state[:running], np.zeros(running)
        open_ = np.ones(running, bool)
        after = np.zeros(running, np.int64)
        for j in range(order, 0, -1):
            trying = np.flatnonzero(open_ & (now >= j - 1))
            ids = grams.at[j][place[trying]]
            hit = table.known[ids] if j > 1 else np.ones(len(ids), bool)  # the root has an arc for unknown words too
            found, missed = trying[hit], trying[~hit]
            gained[found] += table.arc[ids[hit]]
            after[found] = np.where(table.known[ids[hit]], min(j, order - 1), 0)
            open_[found] = False
            if j > 1:
                gained[missed] += table.failure[grams.at[j - 1][place[missed] - 1]]
        state[:running] = after
        sums[:running] += gained
    return np.bincount(text, weights=sums, minlength=len(words))


def score(docs: DataFrame, training: Column, keep: tuple[str, ...] = ("doc_id",), order: int = ORDER, k: float = K) -> DataFrame:
    """`keep`, n_tokens, n_known, train_tokens, base_score, score of every row; rows where `training` holds are learnt from."""
    results = (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"))
    learns = next(n for n in (f"learns{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    aside = Aside(docs.withColumn(learns, F.coalesce(training, F.lit(False))), ("doc_id", "text", learns), keep, tuple(name for name, _ in results))
    keep = aside.keep
    blocks = deal(aside.rows, tuple(dict.fromkeys([*keep, learns, "text"])))
    parts = blocks.count
    word_parts = -(-parts // WORD_SHARE)

    def learnt(table: pa.Table, order: int = order) -> tuple[Grams, np.ndarray]:
        """The n-grams of a block, and how often its training texts have them."""
        grams = grams_of(_tokens(v.as_py() for v in table.column("text")), order)
        weight = np.repeat(np.array(table.column(learns).to_pylist(), float), grams.sizes)
        counts = np.zeros(len(grams.distinct))
        for ids in grams.at[1:]:
            real = ids >= 0
            counts += np.bincount(ids[real], weights=weight[real], minlength=len(counts))
        return grams, counts.astype(np.int64)

    def short_keys(table: pa.Table) -> pa.Table:
        tokens = _tokens(v.as_py() for v in table.column("text"))
        flat = np.concatenate(tokens)
        known = np.repeat(table.column(learns).to_numpy().astype(bool), [len(t) for t in tokens])
        words = asked(block_number(table), *counted(flat, known), word_parts, every=True)
        if order < 2:
            return words
        inside = np.ones(len(flat), bool)
        inside[np.cumsum([0, *map(len, tokens[:-1])])] = False  # no pair ends at the start of a text
        pairs = counted(extended(flat, flat)[inside], known[inside])
        return pa.concat_tables([words, asked(block_number(table), *pairs, parts, shift=word_parts)])

    def heading(part: int, keys: np.ndarray, counts: np.ndarray) -> bytes:
        return totals_heading(keys, counts) if part < word_parts else b""

    def long_keys(table: pa.Table, answers: list[bytes]) -> pa.Table:
        grams, own = learnt(table)
        some = open_grams(grams, read_elsewhere(read_totals(answers, word_parts)[1])[1])
        return asked(block_number(table), grams.distinct[some], own[some], parts, shift=word_parts + parts)

    schema = aside.rows.select(*keep).schema
    for name, kind in results:
        schema = schema.add(name, kind)

    def finish(table: pa.Table, answers: list[bytes]) -> pa.Table:
        grams, counts = learnt(table)
        totals, answers = read_totals(answers, word_parts)
        others, elsewhere = read_elsewhere(answers)
        short = asked_first(grams)
        asked_for = np.concatenate([short, open_grams(grams, elsewhere[: len(short)])])
        assert len(others) == len(asked_for)
        counts[asked_for] += others
        scores = traverse(grams, build_automaton(grams, counts, totals, k))
        real = np.ones(len(grams.at[1]), bool)
        real[grams.starts] = False
        word = counts[grams.at[1][real]]
        sizes = grams.sizes - 1
        starts = np.cumsum(sizes) - sizes
        base = np.log10((word + BASE) / (totals.tokens + BASE * (totals.words + 1)))
        out = table.select(list(keep))
        values = (sizes, np.add.reduceat((word > 0).astype(np.int64), starts), np.full(len(sizes), totals.tokens), np.add.reduceat(base, starts), scores)
        for (name, kind), column in zip(results, values):
            out = out.append_column(name, pa.array(column, pa.int64() if kind == "long" else pa.float64()))
        return out

    answers = answer(blocks.rows.groupBy("__block").applyInArrow(short_keys, ASK), counts_elsewhere, parts, heading)
    if order > 2:
        longer = meet(blocks, answers, long_keys, ASK)
        answers = answers.unionByName(answer(longer, counts_elsewhere, parts))
    return aside.back(meet(blocks, answers, finish, schema))
