"""Matrix work on Arrow batches, where a per-element SQL expression would be far slower than one product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

# Cells of the rows x centres product that a task holds at a time.
PRODUCT_CELLS = 1_000_000

NEAREST_TYPE = "cluster int, d2 double"


def nearest_rows(points: np.ndarray, centers: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and squared distance of the nearest centre of every point, the smallest id among equals.

    One matrix product finds the candidates; those within its rounding error of the minimum are then
    compared by their exact distances.
    """
    point_norm = (points * points).sum(axis=1)
    center_norm = (centers * centers).sum(axis=1)
    approx = point_norm[:, None] + center_norm[None, :] - 2.0 * (points @ centers.T)
    slack = 1e-9 * (point_norm + center_norm.max() + 1.0)
    rows, cols = np.nonzero(approx <= (approx.min(axis=1) + slack)[:, None])
    d2 = ((points[rows] - centers[cols]) ** 2).sum(axis=1)
    order = np.lexsort((ids[cols], d2, rows))
    _, first = np.unique(rows[order], return_index=True)
    best = order[first]
    return ids[cols[best]], d2[best]


def _batches(points: np.ndarray, n_centers: int) -> Iterator[slice]:
    step = max(1, PRODUCT_CELLS // max(1, n_centers))
    return (slice(i, i + step) for i in range(0, len(points), step))


def nearest_udf(block: Broadcast):
    """Column function (vector, best so far) -> nearest centre among `block` and the best so far.

    `block` holds (centres, ids). The best so far is null on the first block.
    """

    @F.pandas_udf(NEAREST_TYPE)
    def nearest(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        centers, ids = block.value
        for vectors, best in batches:
            if len(vectors) == 0:
                yield pd.DataFrame({"cluster": pd.Series(dtype="int32"), "d2": pd.Series(dtype="float64")})
                continue
            points = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
            parts = [nearest_rows(points[s], centers, ids) for s in _batches(points, len(centers))]
            cluster = np.concatenate([p[0] for p in parts])
            d2 = np.concatenate([p[1] for p in parts])
            old_d2 = best["d2"].to_numpy(dtype=np.float64, na_value=np.inf)
            old_cluster = best["cluster"].fillna(np.iinfo(np.int32).max).to_numpy(dtype=np.int64)
            keep = (old_d2 < d2) | ((old_d2 == d2) & (old_cluster < cluster))
            yield pd.DataFrame(
                {"cluster": np.where(keep, old_cluster, cluster).astype("int32"), "d2": np.where(keep, old_d2, d2)}
            )

    return nearest


def project_udf(matrix: np.ndarray):
    """Column function: array of d doubles times the d x m `matrix`, without centring."""

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) @ matrix))

    return project


def assembled(blocks: Sequence[np.ndarray | tuple[np.ndarray, int]]) -> pa.StructArray:
    """Vectors, as Arrow holds them, of `blocks` side by side: a block is a column of numbers, or the filled slot of every
    row (counted from 0) and the width of a one-hot block. Zeros are left out and the shorter form of a row is taken, as the
    assembler of `pyspark.ml` does it."""
    rows = len(blocks[0][0] if isinstance(blocks[0], tuple) else blocks[0])
    slots, values = np.empty((rows, len(blocks)), np.int32), np.ones((rows, len(blocks)))
    width = 0
    for i, block in enumerate(blocks):
        if isinstance(block, tuple):
            slots[:, i] = block[0] + width
            width += block[1]
        else:
            slots[:, i], values[:, i] = width, block
            width += 1
    filled = values != 0.0
    counts = filled.sum(axis=1)
    dense = 1.5 * (counts + 1.0) >= width
    sparse = np.flatnonzero(~dense)
    lengths = np.where(dense, width, counts)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    cells = np.zeros(ends[-1])
    kept = filled if not dense.any() else filled & ~dense[:, None]
    if len(sparse) == rows:
        cells[:] = values[kept]
    else:
        cells[np.repeat(~dense, lengths)] = values[kept]
        at = filled & dense[:, None]
        cells[(ends[:-1, None] + slots)[at]] = values[at]
    starts = np.concatenate([[0], np.cumsum(np.where(dense, 0, counts))]).astype(np.int32)
    no_indices = pa.array(dense) if dense.any() else None
    return pa.StructArray.from_arrays(
        [
            pa.array(dense.astype(np.int8)),
            pa.array(np.full(rows, width, np.int32), mask=dense),
            pa.ListArray.from_arrays(pa.array(starts), pa.array(slots[kept]), mask=no_indices),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(cells)),
        ],
        names=["type", "size", "indices", "values"],
    )


def encode_udf(blocks: Sequence[tuple[str, Sequence[str] | None, int]]):
    """Column function: the columns of `blocks` (name, labels, width), in that order -> their vector. A column with labels is
    text and fills the slot of its label, any other one is a number; null, NaN and an unknown label are errors."""
    known = [None if labels is None else pa.array(labels, pa.string()) for _, labels, _ in blocks]

    @F.arrow_udf(VectorUDT())
    def encode(*columns: pa.Array) -> pa.Array:
        parts = []
        for (name, _, width), labels, column in zip(blocks, known, columns):
            if column.null_count:
                raise ValueError(f"{name}: null cannot be encoded")
            if labels is None:
                numbers = column.to_numpy(zero_copy_only=False)
                if np.isnan(numbers).any():
                    raise ValueError(f"{name}: NaN cannot be encoded")
                parts.append(numbers)
                continue
            found = pc.index_in(column, labels.cast(column.type))
            if found.null_count:
                raise ValueError(f"{name}: unseen label {column.filter(found.is_null())[0].as_py()!r}")
            parts.append((found.to_numpy(zero_copy_only=False), width))
        return assembled(parts)

    return encode


def place_udf(name: str, labels: Sequence[str]):
    """Column function: text -> its place among `labels`; null or another text is an error."""
    known = pa.array(labels, pa.string())

    @F.arrow_udf("int")
    def place(column: pa.Array) -> pa.Array:
        found = pc.index_in(column, known.cast(column.type), skip_nulls=True)
        if found.null_count:
            value = column.filter(found.is_null())[0].as_py()
            raise ValueError(f"{name}: value outside the index: {'null' if value is None else value}")
        return found

    return place


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all lists, and the number of each list; nulls among the elements become NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _differences(vectors: pa.Array, centers: np.ndarray) -> np.ndarray:
    """Row by row, centre minus vector. `vectors` are lists of numbers, or the structs that Arrow holds for ML vectors."""
    width, out = centers.shape[1], centers.copy()
    if pa.types.is_struct(vectors.type):
        dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
        at = np.flatnonzero(~dense)
        if len(at):
            sparse = vectors if len(at) == len(vectors) else vectors.take(pa.array(at))
            if (sparse.field("size").to_numpy(zero_copy_only=False) != width).any():
                raise ValueError("the two vectors differ in length")
            slots, lengths = _flat(sparse.field("indices"))
            values, _ = _flat(sparse.field("values"))
            out[np.repeat(at, lengths), slots] -= values
        at = np.flatnonzero(dense)
        lists = vectors.field("values").take(pa.array(at))
    else:
        at, lists = np.arange(len(vectors)), vectors
    if len(at):
        values, lengths = _flat(lists)
        if (lengths != width).any():
            raise ValueError("the two vectors differ in length")
        out[at] -= values.reshape(len(at), width)
    return out


def distance_udf(block: Broadcast):
    """Column function (vector, cluster) -> squared distance of the vector, an array or an unwrapped ML vector, to the centre
    of its cluster. `block` holds (centres, ids), the ids in order. Null where the vector, one of its elements or the centre
    is missing."""

    @F.arrow_udf("double")
    def distance(vectors: pa.Array, cluster: pa.Array) -> pa.Array:
        centers, ids = block.value
        wanted = pc.fill_null(cluster.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        measured = (ids[place] == wanted) & pc.and_(vectors.is_valid(), cluster.is_valid()).to_numpy(zero_copy_only=False)
        lists = vectors.field("values") if pa.types.is_struct(vectors.type) else vectors
        if lists.flatten().null_count:
            holes = pc.list_parent_indices(lists).filter(lists.flatten().is_null())
            measured[holes.to_numpy(zero_copy_only=False)] = False
        rows = np.flatnonzero(measured)
        d2 = np.zeros(len(vectors))
        for s in _batches(rows, centers.shape[1]):
            part = rows[s]
            found = vectors.slice(part[0], len(part)) if part[-1] - part[0] == len(part) - 1 else vectors.take(pa.array(part))
            away = _differences(found, centers[place[part]])
            d2[part] = np.einsum("ij,ij->i", away, away)
        return pa.array(d2, mask=~measured)

    return distance
