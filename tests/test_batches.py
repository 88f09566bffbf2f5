"""Functions of a batch of rows against the stages and expressions they stand for."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from cohortpref.config import ColumnRoles
from cohortpref.operators import encode
from cohortpref.operators.cluster import with_center_distance
from cohortpref.operators.domain import save_domains, value_domain
from cohortpref.operators.encode import apply_index, encode_features, fit_features, save_index, value_index
from cohortpref.session import snapshot, work_path

ROLES = ColumnRoles(
    table=(("X_ETA", "int"), ("X_SESSO", "int"), ("STRING_X_CAP", "string")),
    x=("X_ETA", "X_SESSO", "X_CAP"), y=(), dropped=(), not_validated=("X_ETA",), quantized=(),
)


def table(spark, values):
    rows = [(n % 7, 1 + n % 2, f"v{n % values}") for n in range(60)]
    return spark.createDataFrame(rows, "X_ETA int, X_SESSO int, STRING_X_CAP string")


@pytest.mark.parametrize("values, scale", [(1, False), (3, False), (5, False), (20, False), (20, True)])
def test_vectors_are_those_of_the_chain(spark, values, scale):
    """Narrow and wide vectors, of which some rows are dense and some sparse, with zeros among the numbers."""
    rows = table(spark, values)
    model = fit_features(rows, save_domains(value_domain(rows, ROLES.columns), work_path(spark, "domain")), ROLES, scale=scale)
    chain, batch = model.transform(rows), encode_features(rows, model)
    assert batch.columns == [*rows.columns, "features"]
    assert batch.schema["features"].metadata == chain.schema["features"].metadata
    as_text = lambda df: sorted(str(r.features) for r in df.select("features").collect())
    assert as_text(batch) == as_text(chain)


def test_one_function_of_a_batch_encodes(spark):
    rows = table(spark, 20)
    model = fit_features(rows, save_domains(value_domain(rows, ROLES.columns), work_path(spark, "domain")), ROLES)
    plan = encode_features(rows, model)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDF(" not in plan.replace("pythonUDF", "")


@pytest.mark.parametrize("row, message", [((None, 1, "v0"), "X_ETA: null"), ((1, 1, "x"), "unseen label 'x'"), ((1, 1, None), "STRING_X_CAP: null")])
def test_what_cannot_be_encoded_is_an_error(spark, row, message):
    rows = table(spark, 3)
    model = fit_features(rows, save_domains(value_domain(rows, ROLES.columns), work_path(spark, "domain")), ROLES)
    with pytest.raises(Exception, match=message):
        encode_features(spark.createDataFrame([row], rows.schema), model).collect()


def test_short_and_long_indices_give_the_same(spark, monkeypatch):
    rows = table(spark, 20)
    index = save_index(value_index(snapshot(value_domain(rows, ROLES.columns), "domain"), ROLES.string_pairs()), work_path(spark, "index"))
    short = apply_index(rows, index, ROLES.string_pairs())
    assert "Join" not in short._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(encode, "SHORT_BYTES", 0)
    joined = apply_index(rows, index, ROLES.string_pairs())
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, joined.collect())) and short.schema["X_CAP"].dataType == joined.schema["X_CAP"].dataType
    monkeypatch.undo()
    with pytest.raises(Exception, match="STRING_X_CAP: value outside the index: null"):
        apply_index(spark.createDataFrame([(1, 1, None)], rows.schema), index, ROLES.string_pairs()).collect()


@pytest.mark.parametrize("as_array", [True, False])
def test_distances_of_batches_are_those_of_the_join(spark, as_array):
    """Sparse and dense vectors, rows on their centre far from 0, rows without vector, cluster or known centre."""
    rng = np.random.default_rng(3)
    centers = [(i, [4000.0 + 7 * i, *map(float, rng.normal(size=4))]) for i in (4, 0, 2)]
    place = dict(centers)
    rows = [(n, Vectors.dense(rng.normal(size=5)) if n % 2 else Vectors.sparse(5, {0: 4000.0, 3: 1.0}), (0, 2, 4)[n % 3]) for n in range(30)]
    rows += [(30, Vectors.dense(place[2]), 2), (31, None, 2), (32, Vectors.dense(place[2]), None), (33, Vectors.dense(place[2]), 9)]
    schema = "id int, v vector, cluster int".replace("vector", "array<double>") if as_array else None
    if as_array:
        points = spark.createDataFrame([(i, None if v is None else list(map(float, v.toArray())), c) for i, v, c in rows], schema)
    else:
        points = spark.createDataFrame([(i, v, c) for i, v, c in rows], ["id", "v", "cluster"])
    table = snapshot(spark.createDataFrame([*centers, (None, [0.0] * 5)], "cluster int, center array<double>"), "centers")
    quick = {r.id: (r.centerdistance, r.d2) for r in with_center_distance(points, "v", "cluster", table).collect()}
    slow = {r.id: (r.centerdistance, r.d2) for r in with_center_distance(points, "v", "cluster", table, limit=-1).collect()}
    assert quick.keys() == slow.keys() and quick[30] == (0.0, 0.0)
    for i in quick:
        assert quick[i] == (pytest.approx(slow[i]) if i < 31 else (None, None)) and (i < 31 or slow[i] == (None, None))
    other = spark.createDataFrame([(1, [1.0, 2.0], 2)], "id int, v array<double>, cluster int")
    with pytest.raises(Exception, match="differ in length"):
        with_center_distance(other, "v", "cluster", table).collect()
    assert "Join" not in with_center_distance(points, "v", "cluster", table)._jdf.queryExecution().executedPlan().toString()
