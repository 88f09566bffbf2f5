"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "cohortpref", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="cohortpref-")
    return _local_dirs[context.applicationId]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the working folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def snapshot(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the working folder and read it back: its lineage ends there, so later jobs neither
    recompute it nor depend on executors that may be gone. `compression` names another codec than the session's."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *paths: str) -> None:
    """Free the space of tables in the working folder that nothing reads any more: an empty table takes their place."""
    for path in paths:
        spark.createDataFrame([], "released int").write.mode("overwrite").parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores when its scan has fewer partitions than there are cores (one small file, say); a scan of
    a large table has more and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
