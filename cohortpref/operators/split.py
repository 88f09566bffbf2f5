"""Train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpref.functions.scalar import SPLIT_BUCKETS, split_bucket


def train_share(weights: Sequence[float]) -> float:
    """Share of the first weight: (0.09, 0.01) means 90 %."""
    return weights[0] / sum(weights)


def in_train(bucket: Column, weights: Sequence[float]) -> Column:
    return bucket < round(train_share(weights) * SPLIT_BUCKETS)


def hash_split(df: DataFrame, key: Sequence[str], weights: Sequence[float], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of `key`: the same rows whatever the partitioning, without a shuffle or a sort."""
    bucket = split_bucket([F.col(c) for c in key], seed)
    return df.where(in_train(bucket, weights)), df.where(~in_train(bucket, weights))


def random_split(df: DataFrame, weights: Sequence[float], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split. Give it a written table: the two halves of a frame that is computed twice in
    a different order would overlap."""
    train, test = df.randomSplit(list(weights), seed)
    return train, test
