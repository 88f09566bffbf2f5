"""WSSSE for several numbers of clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpref.operators.cluster import fit_kmeans, model_wssse
from cohortpref.sources.writers import write_csv

# Numbers of clusters of the full sweep, and the header of its CSV file.
SWEEP_K = (10, 100, 500, 1000, 10000, 50000, 100000)
SWEEP_HEADER = ("KMEAN", "WSSSE TRAIN", " WSSSE TEST")


def kmeans_sweep(
    train: DataFrame, test: DataFrame, ks: Sequence[int] = SWEEP_K, seed: int = 1, features: str = "pca_features"
) -> DataFrame:
    """Table (k, wssse_train, wssse_test). The vectors are read once and kept for all fits.

    Both costs are measured against the final centres. The fit's own training cost is that of its last iteration
    and differs when the fit stops at its iteration limit."""
    spark = train.sparkSession
    train = train.select(features).persist(StorageLevel.MEMORY_AND_DISK)
    test = test.select(features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = []
        for k in ks:
            model = fit_kmeans(train, k, seed, features)
            costs = [float(model_wssse(spark, model, model.transform(part))) for part in (train, test)]
            rows.append((k, *costs))
    finally:
        train.unpersist()
        test.unpersist()
    return spark.createDataFrame(rows, "k int, wssse_train double, wssse_test double")


def write_sweep(sweep: DataFrame, path: str) -> None:
    named = [F.col(c).alias(h) for c, h in zip(("k", "wssse_train", "wssse_test"), SWEEP_HEADER)]
    write_csv(sweep.select(*named), path)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """The table that `write_sweep` has written."""
    rows = spark.read.csv(path, header=True, schema="k int, wssse_train double, wssse_test double", enforceSchema=True)
    return rows.select("k", "wssse_train", "wssse_test")
