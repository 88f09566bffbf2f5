"""Bookings table derived from the order tables, for tests, benchmarks and demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpref.functions.scalar import split_bucket
from cohortpref.operators.split import in_train
from cohortpref.session import spread

# Cluster ids of the stand-in clustering; the nation keys fill only some of them.
CLUSTERS = 30
# This cluster is left out of the train rows, so its test rows have no ranking.
UNTRAINED_CLUSTER = 24
SPLIT_WEIGHTS = (0.09, 0.01)
# Distance of the groups of `separated_bookings`, far beyond the span of their ages.
GROUP_DISTANCE = 1000
GROUPS = 5


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One booking per line item: BOOKING_ID, the bookings columns, SPLIT_BUCKET and a stand-in CLUSTER."""

    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    # The customers join the orders, which are fewer than the line items: those move once less.
    ordered = (
        table("orders")
        .join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    joined = (
        spread(table("lineitem"))
        .join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    key = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    days = F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))
    return joined.select(
        F.concat_ws("|", *key).alias("BOOKING_ID"),
        (18 + F.col("c_custkey") % 80).cast("int").alias("X_ETA"),
        (1 + F.col("c_custkey") % 2).cast("int").alias("X_SESSO"),
        F.col("c_nationkey").cast("string").alias("STRING_X_CAP"),
        F.col("n_regionkey").cast("string").alias("STRING_X_USL"),
        F.col("c_mktsegment").alias("STRING_X_FASCIA"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("X_GRADO_URG"),
        F.col("p_type").alias("STRING_X_QDGN"),
        F.col("l_returnflag").alias("STRING_X_INVIANTE"),
        F.col("o_orderstatus").alias("STRING_X_ESENZIONE"),
        (F.col("o_custkey") % 200).cast("string").alias("STRING_X_PRESCRITTORE"),
        F.col("l_partkey").cast("string").alias("STRING_X_PRESTAZIONE"),
        F.col("p_brand").alias("STRING_X_BRANCA_SPECIALISTICA"),
        F.col("p_name").alias("STRING_X_GRUPPO_EROGABILE"),
        F.col("s_nationkey").cast("string").alias("STRING_Y_STER"),
        (F.col("l_partkey") % 1000).cast("string").alias("STRING_Y_UE"),
        F.dayofweek("l_shipdate").alias("Y_GIORNO_SETTIMANA"),
        F.month("l_shipdate").alias("Y_MESE_ANNO"),
        (1 + F.col("l_linenumber") % 4).cast("int").alias("Y_FASCIA_ORARIA"),
        ((days % 90 + 90) % 90).cast("int").alias("Y_GIORNI_ALLA_PRENOTAZIONE"),
        split_bucket(key).alias("SPLIT_BUCKET"),
        F.col("c_nationkey").cast("int").alias("CLUSTER"),
    )


def separated_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bookings with the ages of every district far from those of the others: k-means with GROUPS clusters finds the
    districts, whatever its start, so that fits and scores have known results. CLUSTER is the district."""
    district = F.col("STRING_X_USL").cast("int")
    age = F.col("X_ETA") + F.lit(GROUP_DISTANCE) * district
    return bookings(spark, sf_dir).withColumns({"X_ETA": age.cast("int"), "CLUSTER": district})


def in_train_split():
    """The train rows of every cluster."""
    return in_train(F.col("SPLIT_BUCKET"), SPLIT_WEIGHTS)


def is_train():
    return in_train_split() & (F.col("CLUSTER") != UNTRAINED_CLUSTER)


def is_test():
    return ~in_train_split()
