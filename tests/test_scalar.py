import pytest
from pyspark.sql import functions as F

from cohortpref.config import ArtefactPaths, ColumnRoles, RunSettings
from cohortpref.functions.scalar import (
    distance_normalized,
    euclidean,
    hour_band,
    positional_accuracy,
    quantize_days,
    sq_distance,
    zero_based,
)


def test_day_codes_at_the_bounds(spark):
    days = [-5, 1, 2, 3, 4, 5, 6, 7, 8, 15, 16, 20, 21, 30, 31, 60, 61, 900, None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d int")
    codes = [r[0] for r in df.orderBy("i").select(quantize_days(F.col("d"))).collect()]
    assert codes == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, None]


def test_hour_bands_are_half_open(spark):
    df = spark.createDataFrame([(i, f"2024-01-01 {h}") for i, h in enumerate(
        ["00:00:00", "10:59:59", "11:00:00", "12:59:59", "13:00:00", "14:59:59", "15:00:00", "23:59:59"])], "i int, t string")
    bands = [r[0] for r in df.orderBy("i").select(hour_band(F.to_timestamp("t"))).collect()]
    assert bands == [0, 0, 1, 1, 2, 2, 3, 3]


def test_positional_accuracy_of_four_ranks(spark):
    df = spark.createDataFrame([(1, 4), (3, 4), (4, 4), (None, 4), (None, None)], "pos int, last int")
    rows = df.select(positional_accuracy(F.col("pos"), F.col("last")), zero_based(F.col("pos"))).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0), (0.5, 2), (0.25, 3), (0.0, None), (0.0, None)]


def test_distances(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(euclidean(F.col("a"), F.col("b")), sq_distance(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (5.0, 25.0)
    short = spark.createDataFrame([([0.0], [4.0, 0.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        short.select(sq_distance(F.col("a"), F.col("b"))).collect()


def test_normalisation_of_one_request_and_of_zero_distances(spark):
    df = spark.createDataFrame([(0.8, 2.0, 2.0), (0.8, 1.0, 4.0), (0.8, 0.0, 0.0)], "a double, d double, s double")
    values = [r[0] for r in df.select(distance_normalized(F.col("a"), F.col("d"), F.col("s"))).collect()]
    assert values[0] == 0.0
    assert values[1] == pytest.approx(0.6)
    assert values[2] is None


def test_column_roles():
    roles = ColumnRoles()
    assert roles.feature_columns == [
        "X_ETA", "X_SESSO", "X_CAP", "X_USL", "X_FASCIA", "X_GRADO_URG", "X_QDGN", "X_INVIANTE", "X_ESENZIONE",
        "X_GRUPPO_EROGABILE",
    ]
    assert len(roles.string_pairs()) == 12 and len(roles.schema()) == 19
    assert len(roles.schema(exclude=["X_ETA"])) == 18
    assert ("STRING_Y_UE", "Y_UE") not in roles.string_pairs(["Y_UE"])
    assert len(roles.validated) == 14
    assert roles.numeric_features == ["X_ETA"]


def test_paths_derive_from_the_base():
    settings = RunSettings("/data/b")
    assert settings.paths == ArtefactPaths("/data/b", 1, 1000)
    assert settings.paths.train == "/data/b-train.parquet"
    assert settings.paths.kmeans_model == "/data/b.kmeans"
    assert settings.paths.report("TEST") == "/data/b.accuracy_stage.report.pca1.kmean1000.txt"
    with pytest.raises(AttributeError):
        settings.paths.nothing
