"""Toxicity: a linear classifier whose training penalises score changes under swaps of identity terms.

Features are the distinct words of a text (lower-cased, trimmed of punctuation), hashed to 2**18 slots. Training
minimises the logistic loss with an L1 penalty plus, for every training text that mentions an identity term, the squared
change of its score when that term is swapped for another group's term. A group mention alone therefore moves a score
little, however the labels happen to be spread over groups. The fit runs on a bounded sample of labelled documents
(FIT_ROWS, chosen by a hash of id and text); scoring runs over all rows with the 2**18 weights, whose size does not depend
on the data.

Results for odd input: a null or empty text has no features and gets the score of the intercept; repeated rows get equal
scores; an empty table gives an empty table; without labels every score is 0.0. Labels, language, source and id
never enter a score. Extra columns are passed through by `score` when asked for in `keep`; one
named like the score gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortpref.llm.common import Aside

SLOTS = 1 << 18
FIT_ROWS = 24_000
MIN_DOCS = 4  # a word must occur in so many documents of the sample to get a weight
L1 = 1e-4
SWAP_PENALTY = 2.0
STEPS = 300
THRESHOLD = 0.3
SEED = 23
TOKEN = re.compile(r"[^\W\d_]+")
CACHE = 120_000

# Terms of one kind stand for one another in the swaps.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american", "mexican"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "native"), ("immigrants", "refugees", "natives"),
    ("old", "young"), ("blind", "deaf", "disabled"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulman", "chrétien", "juif"), ("noir", "blanc"),
    ("frauen", "männer"), ("frau", "mann"), ("muslimisch", "christlich", "jüdisch"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmán", "cristiano", "judío"), ("negro", "blanco"),
)


class Slots(dict):
    def __missing__(self, token: str) -> int:
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"), SEED) % SLOTS
        return value


def slots_of(text: str | None, table: Slots) -> np.ndarray:
    if len(table) > CACHE:
        table.clear()
    return np.unique(np.array([table[t] for t in set(TOKEN.findall((text or "").lower()))], np.int32))


def swap_table() -> dict[int, int]:
    """slot of a term -> slot of the next term of its kind."""
    table = Slots()
    return {table[a]: table[b] for kind in IDENTITY_TERMS for a, b in zip(kind, kind[1:] + kind[:1])}


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None], table: Slots) -> np.ndarray:
        sums = np.array([self.weights[slots_of(t, table)].sum() for t in texts], float)
        return 1.0 / (1.0 + np.exp(-np.clip(sums + self.intercept, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learns `labels.toxic` (0 or 1) from at most about `fit_rows` of the labelled rows of `docs`."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = docs.select("doc_id").join(known, "doc_id").count()
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    if total > fit_rows:
        # Rows are chosen, not ids: an id may have any number of rows. Equal rows count once.
        bucket = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id", "text"), F.lit(1_000_000))
        rows = rows.where(bucket < int(1_000_000 * fit_rows / total)).dropDuplicates(["doc_id", "text"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Slots()
        for batch in batches:
            blobs = [slots_of(t.as_py(), table).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column("toxic").cast(pa.int32())], names=["slots", "toxic"])

    sample = rows.select("text", "toxic").mapInArrow(features, "slots binary, toxic int").toPandas()
    sample = sample.sort_values(["slots", "toxic"])  # the fit does not depend on row order
    return train([np.frombuffer(b, np.int32) for b in sample["slots"]], sample["toxic"].to_numpy(float))


def train(documents: list[np.ndarray], toxic: np.ndarray) -> ToxicityModel:
    """Accelerated proximal gradient on logistic loss + L1 + counterfactual penalty."""
    n = len(documents)
    weights = np.zeros(SLOTS)
    if n == 0 or toxic.max() == toxic.min():
        rate = float(np.clip(toxic.mean(), 1e-6, 1 - 1e-6)) if n else 1e-9
        return ToxicityModel(weights, float(np.log(rate / (1 - rate))))
    sizes = np.array([len(d) for d in documents], np.int64)
    col = np.concatenate(documents)
    del documents
    met = np.bincount(col, minlength=SLOTS)
    frequent = met >= MIN_DOCS
    swaps = swap_table()
    terms = np.array(sorted(swaps), np.int64)
    frequent[terms] = met[terms] > 0
    # Only slots with a weight stay, under new numbers; `sizes` counts them per document.
    kept = frequent[col]
    sizes = np.bincount(np.repeat(np.arange(n, dtype=np.int32), sizes)[kept], minlength=n)
    active = np.flatnonzero(frequent)
    number = np.zeros(SLOTS, np.int64)
    number[active] = np.arange(len(active))
    col = number[col[kept]]
    del kept
    size = len(active)
    place = {int(s): i for i, s in enumerate(active)}
    # One row of the swap matrix per mention: +1 at the term, -1 at the term it is swapped for (if that has a weight).
    mention = np.isin(active, terms)[col]
    plus = col[mention]
    minus = np.array([place.get(swaps[int(active[c])], -1) for c in plus], np.int64)
    w, look, intercept, look_b, momentum = np.zeros(size), np.zeros(size), 0.0, 0.0, 1.0
    rate = toxic.mean()
    intercept = look_b = float(np.log(rate / (1 - rate)))
    # Words are scaled by how much they vary, so that one step size suits rare and common ones.
    share = np.bincount(col, minlength=size) / n
    scale = 1 / np.sqrt(np.maximum(share, MIN_DOCS / n))
    # Curvature of the loss, and a bound on that of the penalty: largest row sum times largest column sum of its matrix.
    curvature = _largest(col, sizes, scale) / 4
    if len(plus):
        other = np.where(minus >= 0, scale[minus], 0.0)
        columns = np.bincount(plus, weights=scale[plus], minlength=size) + np.bincount(np.maximum(minus, 0), weights=other, minlength=size)
        curvature += 2 * SWAP_PENALTY / n * float((scale[plus] + other).max() * columns.max())
    step = 1.0 / curvature
    for _ in range(STEPS):
        margin = _sums(scale * look, col, sizes) + look_b
        residual = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - toxic
        gradient = scale * np.bincount(col, weights=np.repeat(residual, sizes), minlength=size) / n
        if len(plus):
            there = minus >= 0
            change = scale[plus] * look[plus] - np.where(there, scale[minus] * look[minus], 0.0)
            pull = 2 * SWAP_PENALTY / n * change
            gradient += np.bincount(plus, weights=pull * scale[plus], minlength=size)
            gradient -= np.bincount(minus[there], weights=(pull * scale[minus])[there], minlength=size)
        new = look - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1 * scale, 0.0)
        new_b = look_b - step * residual.mean()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / following * (new - w)
        look_b = new_b + (momentum - 1) / following * (new_b - intercept)
        w, intercept, momentum = new, new_b, following
    weights[active] = w * scale
    return ToxicityModel(weights, float(intercept))


def _sums(weights: np.ndarray, col: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the weights of every document, whose slots lie one document after the other in `col`."""
    out = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(weights[col], (np.cumsum(sizes) - sizes)[some])
    return out


def _largest(col: np.ndarray, sizes: np.ndarray, scale: np.ndarray) -> float:
    """Largest eigenvalue of X'X/n with the intercept's column, by power iteration from a fixed start."""
    n, size = len(sizes), len(scale)
    v, b, norm = np.full(size, 1 / np.sqrt(size + 1)), 1 / np.sqrt(size + 1), 1.0
    for _ in range(25):
        u = _sums(scale * v, col, sizes) + b
        v, b = scale * np.bincount(col, weights=np.repeat(u, sizes), minlength=size) / n, u.mean()
        norm = np.sqrt((v * v).sum() + b * b)
        v, b = v / norm, b / norm
    return float(norm) * 1.1


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """`keep` and the score of every row of `docs`."""
    aside = Aside(docs, ("text",), keep, (name,))
    docs, keep = aside.rows, aside.keep
    spark = docs.sparkSession
    # 2**18 weights, most of them 0: the same size for any input.
    held = spark.sparkContext.broadcast((model.weights.astype(np.float64), model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, table = ToxicityModel(*held.value), Slots()
        for batch in batches:
            found = local.scores([t.as_py() for t in batch.column("__text")], table)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.float64())], names=[*keep, name])

    return aside.back(docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, docs.select(*keep).schema.add(name, "double")))
