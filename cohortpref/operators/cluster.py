"""Reduction and clustering: PCA, k-means, assignment to given centres, distances and WSSSE."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpref.functions.scalar import sq_distance
from cohortpref.functions.vectors import NEAREST_TYPE, distance_udf, nearest_udf, project_udf
from cohortpref.operators import joins
from cohortpref.operators.joins import TableSize, lookup_join
from cohortpref.session import snapshot

# Centres are shipped to the tasks in blocks of at most this size.
CENTER_BLOCK_BYTES = 64 * 1024 * 1024


def pca_components(width: int, percent: float) -> int:
    """Number of components: `percent` of the vector width, at least one."""
    return max(1, int(width * percent / 100))


def fit_pca(df: DataFrame, k: int, input_col: str = "features", output_col: str = "pca_features") -> PCAModel:
    return PCA(k=k, inputCol=input_col, outputCol=output_col).fit(df)


def fit_kmeans(df: DataFrame, k: int, seed: int = 1, features: str = "pca_features", solver: str = "auto") -> KMeansModel:
    """`solver` spares the pass over the vectors by which "auto" finds out whether most of their cells are filled ("block")
    or not ("row")."""
    return KMeans(k=k, seed=seed, featuresCol=features, solver=solver).fit(df)


def project(df: DataFrame, vector: str, matrix: Sequence[Sequence[float]], output: str) -> DataFrame:
    """Array column times a given d x m matrix, without centring, as the fitted PCA does it."""
    return df.withColumn(output, project_udf(np.asarray(matrix, dtype=np.float64))(F.col(vector)))


def center_table(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Table (cluster, center): mean vector of every group of an array column, aggregated map-side first."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(F.col(group).cast("int").alias("cluster")).agg(vector_to_array(mean).alias("center"))


def model_centers(spark: SparkSession, model: KMeansModel, matrix: np.ndarray | None = None) -> DataFrame:
    """Centres of a fitted model as a table (cluster, center), times a d x m `matrix` if given."""
    found = np.array(model.clusterCenters())
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(found if matrix is None else found @ matrix)]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def centers_size(centers: DataFrame) -> tuple[int, int]:
    """Number of centres and their total bytes, measured."""
    row = centers.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("center")), F.lit(0)).alias("cells")).first()
    return row["n"], row["n"] * 16 + row["cells"] * 8


def assign_nearest(points: DataFrame, vector: str, centers: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """`points` with `cluster` and `d2` of the nearest centre (smallest id among equals).

    Points are never shuffled. The centres go to the tasks as a broadcast block; when they exceed `block_bytes`
    they go in several blocks, one after the other, with the points written in between so that no task holds more
    than one block.
    """
    spark = points.sparkSession
    n, total = centers_size(centers)
    if n == 0:
        raise ValueError("no centres")
    blocks = math.ceil(total / (block_bytes or CENTER_BLOCK_BYTES))
    out = points.withColumn("__best", F.lit(None).cast(f"struct<{_struct_fields(NEAREST_TYPE)}>"))
    for b in range(blocks):
        part = centers.where(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == b) if blocks > 1 else centers
        rows = part.select("cluster", "center").collect()
        if not rows:
            continue
        block = _block(spark, rows)
        vectors = F.col(vector).cast("array<double>")
        out = out.withColumn("__best", nearest_udf(block)(vectors, F.col("__best")))
        if blocks > 1:
            out = snapshot(out, "nearest")
    return out.select(*points.columns, "__best.cluster", "__best.d2")


def _block(spark: SparkSession, rows: Sequence) -> Broadcast:
    """Rows (cluster, center) as a matrix of centres and their ids."""
    return spark.sparkContext.broadcast(
        (np.array([r["center"] for r in rows], dtype=np.float64), np.array([r["cluster"] for r in rows], dtype=np.int64))
    )


def _struct_fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split() for part in ddl.split(",")))


def with_center_distance(
    rows: DataFrame, vector: str, cluster: str, centers: DataFrame, limit: int | None = None
) -> DataFrame:
    """`rows` with `centerdistance`, the distance of the vector (an array or an ML vector) to the centre of the row's
    cluster, and its square `d2`.

    Centres within `limit` bytes go to the tasks, where the distances of a batch are one matrix expression; more of them
    are joined. An ML vector that is sparse stays so on its way."""
    spark, kind = rows.sparkSession, rows.schema[vector].dataType
    _, total = centers_size(centers)
    known = []
    if total <= (joins.BROADCAST_BYTES if limit is None else limit):
        known = centers.select("cluster", "center").where("cluster IS NOT NULL AND center IS NOT NULL").collect()
    if known:
        block = _block(spark, sorted(known, key=lambda r: r["cluster"]))
        point = F.unwrap_udt(vector) if isinstance(kind, VectorUDT) else F.col(vector).cast("array<double>")
        measured = rows.withColumn("d2", distance_udf(block)(point, F.col(cluster)))
    else:
        joined = lookup_join(rows, centers.withColumnRenamed("center", "__center"), [(cluster, "cluster")], TableSize(total), limit=limit)
        array = F.when(F.col(vector).isNotNull(), vector_to_array(vector)) if isinstance(kind, VectorUDT) else F.col(vector)
        point = array.cast("array<double>")
        measured = joined.withColumn("d2", sq_distance(point, F.col("__center"))).drop("__center")
    return measured.withColumn("centerdistance", F.sqrt("d2")).select(*rows.columns, "centerdistance", "d2")


def wssse(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of the squared distances `d2`, per group of `by` if given."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("wssse"))


def model_wssse(spark: SparkSession, model: KMeansModel, df: DataFrame) -> float:
    """WSSSE of the rows `model.transform` has assigned."""
    measured = with_center_distance(df, model.getFeaturesCol(), model.getPredictionCol(), model_centers(spark, model))
    return wssse(measured).first()["wssse"] or 0.0
