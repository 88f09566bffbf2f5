import os
import time
import uuid

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortpref.plans import catalog, stages
from cohortpref.functions.vectors import nearest_rows
from cohortpref.operators.cluster import assign_nearest, fit_kmeans, fit_pca, model_centers, model_wssse, pca_components
from cohortpref.operators.canonical import component_signs, fit_signed_pca, number_centers, renumber
from cohortpref.operators.numbering import number_rows
from cohortpref.operators.responses import request_responses
from cohortpref.operators.scoring import load_model, normalize_by_request, score_requests
from cohortpref.plans.bookings import bookings
from cohortpref.plans.stages import run, sweep_run
from cohortpref.plans.sweep import kmeans_sweep, write_sweep
from cohortpref.config import STAGES, ColumnRoles, RunSettings
from cohortpref.session import snapshot, work_path
from cohortpref.streaming.requests import STATE_CODEC, StreamOutputs, gather_requests, read_request_stream, score_stream, start_stream

ROLES = ColumnRoles()
NORMALIZED = ["mean_acc_norm", "ACC_NORM_Y_STER", "ACC_NORM_Y_UE"]


@pytest.fixture(scope="module")
def points(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def test_nearest_rows_against_brute_force():
    rng = np.random.default_rng(5)
    points, centers = rng.normal(size=(300, 7)), rng.normal(size=(40, 7))
    centers[11] = centers[3]
    points[0] = centers[3]
    ids = np.arange(40)[::-1].copy()
    cluster, d2 = nearest_rows(points, centers, ids)
    full = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    assert np.allclose(d2, full.min(axis=1), atol=0, rtol=1e-12)
    assert cluster[0] == min(ids[3], ids[11])
    assert all(c == min(ids[f == f.min()]) for c, f in zip(cluster, full))


def test_kmeans_labels_are_the_nearest_centres_also_in_blocks(spark, points):
    features = points.withColumn("pca_features", array_to_vector("v"))
    model = fit_kmeans(features, 8)
    labels = {r.vec_id: r.prediction for r in model.transform(features).collect()}
    centers = model_centers(spark, model)
    for block_bytes in (None, 2000):
        nearest = assign_nearest(points, "v", centers, block_bytes).collect()
        assert {r.vec_id: r.cluster for r in nearest} == labels
        assert model_wssse(spark, model, model.transform(features)) == pytest.approx(sum(r.d2 for r in nearest))


def test_pca_explains_the_covariance_and_does_not_centre(spark, points):
    features = points.withColumn("features", array_to_vector("v"))
    model = fit_pca(features, 5)
    matrix = np.array([r.v for r in points.orderBy("vec_id").collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(matrix.T)))[::-1]
    assert np.allclose(model.explainedVariance.toArray(), values[:5] / values.sum())
    projected = np.array([r.pca_features.toArray() for r in model.transform(features).orderBy("vec_id").collect()])
    assert np.allclose(projected, matrix @ model.pc.toArray())
    assert [pca_components(119, p) for p in (0.1, 1, 10)] == [1, 1, 11]


def test_sweep(spark, points, tmp_path):
    features = points.select(array_to_vector("v").alias("pca_features"))
    sweep = kmeans_sweep(features, features, (2, 4))
    rows = sweep.orderBy("k").collect()
    assert [r.k for r in rows] == [2, 4]
    assert rows[0].wssse_train > rows[1].wssse_train
    assert all(r.wssse_test == pytest.approx(r.wssse_train) for r in rows)
    write_sweep(sweep, str(tmp_path / "sweep"))
    text = next((tmp_path / "sweep").glob("part-*.csv")).read_text()
    assert text.splitlines()[0].replace('"', "") == "KMEAN,WSSSE TRAIN, WSSSE TEST"


def test_normalisation_inside_requests(spark):
    rows = snapshot(
        spark.createDataFrame([(1, 1.0, 0.5), (1, 3.0, 0.5), (2, 2.0, 0.5), (3, 0.0, 0.5)], "r int, centerdistance double, acc double")
        .withColumn("d2", F.col("centerdistance") ** 2), "rows")
    out = normalize_by_request(rows, "r", {"acc": "norm"}).collect()
    assert sorted((r.r, r.centerdistance, r.norm, r.request_wssse) for r in out) == [
        (1, 1.0, 0.375, 10.0), (1, 3.0, 0.125, 10.0), (2, 2.0, 0.0, 4.0), (3, 0.0, None, 0.0),
    ]


@pytest.fixture(scope="module")
def full_run(spark, sf_dir):
    settings = RunSettings(work_path(spark, "run") + "/b", pca_perc=5, k=12, split_key=("BOOKING_ID",))
    rows = bookings(spark, sf_dir).select("BOOKING_ID", *ROLES.columns)
    return settings, run(spark, settings, bookings=rows, keep_indexed=True)


def report(state, name):
    return sorted(map(str, state.reports[name].collect()))


def test_resumed_stages_equal_the_full_run(spark, full_run):
    settings, full = full_run
    resumed = run(spark, settings, start="DICT", snapshots=["DICT"])
    for name in ("accuracy_by_choice", "position_stats", "cmc_curve", "accuracy_overall"):
        assert report(resumed, name) == report(full, name)
    assert resumed.info["wssse_test"] == pytest.approx(full.info["wssse_test"])
    assert full.info["rows_train"] + full.info["rows_test"] == 6000
    fitted = full.kmeans.transform(full.train.drop("prediction"))
    assert full.info["wssse_train"] == pytest.approx(model_wssse(spark, full.kmeans, fitted))
    text = spark.read.text(settings.paths.report("TEST"), wholetext=True).first()[0]
    assert "WSSSE TEST" in text and "Y_STER" in text
    assert spark.read.parquet(settings.paths.indexed).count() == 6000


def test_sweep_over_the_snapshots(spark, full_run):
    settings, full = full_run
    sweep = sweep_run(spark, settings, (3, settings.k)).orderBy("k").collect()
    assert [r.k for r in sweep] == [3, 12]
    assert sweep[1].wssse_test == pytest.approx(full.info["wssse_test"])
    assert spark.read.csv(settings.paths.sweep, header=True).count() == 2


def test_unknown_or_reversed_stages_are_refused(spark, full_run):
    settings, _ = full_run
    with pytest.raises(ValueError, match="unknown stage"):
        run(spark, settings, start="REDUCE")
    with pytest.raises(ValueError, match="comes after"):
        run(spark, settings, start="TEST", stop="PCA")


@pytest.mark.parametrize("start", ["PCA", "KMEANS", "DICT", "TEST"])
def test_a_start_without_its_inputs_names_what_is_missing(spark, start):
    settings = RunSettings(work_path(spark, "nothing") + "/b")
    with pytest.raises(ValueError, match=f"stage {start} needs .*nothing"):
        run(spark, settings, start=start)


def test_written_centers_are_exact_and_in_order(spark, full_run):
    settings, full = full_run
    table = spark.read.parquet(settings.paths.centers).orderBy("cluster").collect()
    fitted = [list(map(float, c)) for c in full.kmeans.clusterCenters()]
    assert [r.center for r in table] == sorted(fitted) and [r.cluster for r in table] == list(range(len(fitted)))
    assert all(fitted[r.fitted] == r.center for r in table)
    assert (full.info["kmeans_centers"], full.info["kmeans_centers_found"]) == (settings.paths.centers, len(fitted))


def requests(spark, sf_dir):
    rows = snapshot(bookings(spark, sf_dir).where("SPLIT_BUCKET >= 9900"), "requests")
    bad = F.when(F.col("SPLIT_BUCKET") % 4 == 0, "nowhere").otherwise(F.col("STRING_X_CAP"))
    return rows.withColumn("STRING_X_CAP", bad).select(
        (F.col("CLUSTER") % 5).cast("bigint").alias("request_id"), F.col("BOOKING_ID").alias("row_id"), *ROLES.columns
    ).withColumn("X_ETA", F.when(F.crc32("row_id") % 5 > 0, F.col("X_ETA")))


def test_scored_requests_and_the_stream_agree(spark, sf_dir, full_run, tmp_path):
    settings, _ = full_run
    model = load_model(spark, settings)
    incoming = snapshot(requests(spark, sf_dir), "requests")
    scored, rejected, incomplete = score_requests(incoming, model)
    n_bad = incoming.where("STRING_X_CAP = 'nowhere'").count()
    assert n_bad > 0 and rejected.count() == n_bad
    n_incomplete = incoming.where("X_ETA IS NULL AND STRING_X_CAP <> 'nowhere'").count()
    assert n_incomplete > 0 and incomplete.count() == n_incomplete
    assert scored.count() == incoming.count() - n_bad - n_incomplete
    assert {tuple(r.rejected_cols) for r in rejected.collect()} == {("STRING_X_CAP",)}

    # Every distance is to the nearest centre, and the shares of a request add up.
    sums = scored.groupBy("request_id").agg(
        F.count("*").alias("n"), F.sum(1 - F.col("mean_acc_norm") / F.col("mean_acc")).alias("share")
    )
    assert all(r.share == pytest.approx(1.0) for r in sums.where("share IS NOT NULL").collect())

    # Whole responses: small parts of large requests hold every row once.
    for part_rows in (10_000, 7):
        parts = request_responses(scored, rejected, incomplete, ROLES.y, ROLES.columns, part_rows=part_rows).collect()
        counts = {(r.n_valid, r.n_rejected, r.n_incomplete) for r in parts}
        found = [sorted(e.row_id for r in parts for e in r[kind]) for kind in ("accuracies", "rejected", "incomplete")]
        assert found == [sorted(r.row_id for r in rows.select("row_id").collect()) for rows in (scored, rejected, incomplete)]
        assert all(list(e) == sorted(e) for r in parts for e in [[x.row_id for x in r.accuracies]])
        assert max(r.parts for r in parts) == (1 if part_rows == 10_000 else -(-max(sum(c) for c in counts) // 7))
        assert len({(r.request_id, r.part) for r in parts}) == len(parts)
    one = next(r for r in parts if r.rejected).rejected[0]
    assert one.rejected_cols == [("STRING_X_CAP", "nowhere")] and one.row.STRING_X_CAP == "nowhere"

    # The same rows as a stream: every request in three files, the second one repeated.
    base = str(tmp_path)
    sizes = incoming.groupBy("request_id").agg(F.count("*").alias("request_rows"))
    arriving = snapshot(incoming.join(sizes, "request_id"), "arriving")
    for file in (0, 1, 1, 2):
        arriving.where(F.crc32("row_id") % 3 == file).coalesce(1).write.mode("append").json(f"{base}/in")
    stream = gather_requests(read_request_stream(spark, f"{base}/in", model, files_per_batch=2))
    outputs = StreamOutputs(*[f"{base}/{name}" for name in ("scored", "rejected", "incomplete", "unfinished")])
    assert score_stream(stream, model, outputs, f"{base}/checkpoint").awaitTermination(300)
    key = ["row_id", "prediction", "mean_acc"]
    batch = sorted(map(str, scored.select(*key, *[F.round(c, 9) for c in NORMALIZED]).collect()))
    streamed = spark.read.parquet(outputs.scored).select(*key, *[F.round(c, 9) for c in NORMALIZED])
    assert sorted(map(str, streamed.collect())) == batch
    assert spark.read.parquet(outputs.rejected).count() == n_bad
    assert spark.read.parquet(outputs.incomplete).count() == n_incomplete


def gathered(spark, base, files, hold_ms, wait=0):
    """(request, row, complete) per micro-batch of files given as lists of (request_id, row_id, request_rows)."""
    schema = "request_id long, row_id string, request_rows long, amount double"
    out = []
    os.mkdir(f"{base}/in")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{base}/in")
    stream = gather_requests(rows, hold_ms=hold_ms)
    for file in files:
        spark.createDataFrame([(*r, 1.5) for r in file], schema).coalesce(1).write.mode("append").json(f"{base}/in")
        time.sleep(wait)
        batches = []
        write = lambda batch, number: batches.append([(r.request_id, r.row_id, r.complete, r.amount) for r in batch.collect()])  # noqa: E731, B023
        assert start_stream(stream, write, f"{base}/checkpoint").awaitTermination(60)
        out.append(sorted(x[:3] for b in batches for x in b))
        assert all(x[3] == 1.5 for b in batches for x in b)
    return out


def test_a_request_is_held_until_it_is_whole(spark, tmp_path):
    """Over restarts of the query, with repeated rows, several requests in a file, and rows that cannot be held."""
    files = [
        [(1, "a", 3), (2, "x", 1)], [(1, "b", 3), (1, "a", 3)], [(1, "c", 3), (3, "n", None)], [(None, "m", 1), (None, "m", 1), (4, "p", 2)],
    ]
    assert gathered(spark, str(tmp_path), files, 10**7) == [
        [(2, "x", True)], [], [(1, "a", True), (1, "b", True), (1, "c", True), (3, "n", False)], [(None, "m", False), (None, "m", False)],
    ]


def test_an_unfinished_request_comes_out_after_its_time(spark, tmp_path):
    files = [[(1, "a", 2)], [(5, "z", 1)], [(1, "b", 2)], [(6, "z", 1)]]
    found = gathered(spark, str(tmp_path), files, 1, wait=1)
    rows = [r for batch in found for r in batch]
    assert sorted(rows) == [(1, "a", False), (1, "b", False), (5, "z", True), (6, "z", True)]


def test_fits_do_not_depend_on_partitioning(spark, points):
    features = snapshot(points.withColumn("features", array_to_vector("v")), "features")
    models = [fit_signed_pca(features.repartition(n), 6, "features", "pca_features") for n in (1, 7)]
    assert np.allclose(models[0].loadings, models[1].loadings, atol=1e-9)
    largest = np.abs(models[0].loadings).argmax(axis=0)
    assert (models[0].loadings[largest, range(6)] > 0).all()
    projected = [np.array([r.pca_features.toArray() for r in m.transform(features).orderBy("vec_id").collect()]) for m in models]
    assert np.allclose(*projected, atol=1e-9)
    assert component_signs(np.array([[0.5, -0.5], [-0.5, 0.5]])).tolist() == [1.0, -1.0]


def test_numbers_of_centres(spark):
    centers = snapshot(spark.createDataFrame([(0, [2.0, 1.0]), (1, [1.0, 9.0]), (2, [2.0, -0.0]), (3, [1.0, 9.0])], "cluster int, center array<double>"), "centers")
    table = number_centers(centers)
    assert [(r.cluster, r.fitted) for r in table.orderBy("cluster").collect()] == [(0, 1), (1, 3), (2, 2), (3, 0)]
    rows = spark.createDataFrame([(0,), (2,), (None,)], "prediction int")
    assert sorted(str(r.prediction) for r in renumber(rows, "prediction", snapshot(table, "table")).collect()) == ["2", "3", "None"]


def test_numbering_over_ranges_equals_that_of_one_task(spark):
    rows = snapshot(spark.range(500).select((F.col("id") * 37 % 101).alias("a"), "id"), "rows")
    order = [F.desc("a"), F.asc("id")]
    one = sorted(map(tuple, number_rows(rows, order, "n").collect()))
    assert sorted(map(tuple, number_rows(rows, order, "n", single_task_rows=40).collect())) == one
    assert sorted(r[2] for r in one) == list(range(500))


@pytest.mark.parametrize("name", ["pca_fit_project", "pca_variance"])
def test_pca_learns_from_the_train_rows_of_every_cluster(spark, sf_dir, monkeypatch, name):
    class Seen(Exception):
        pass

    def fit(rows, components):
        raise Seen({r.CLUSTER for r in rows.select("CLUSTER").distinct().collect()})

    monkeypatch.setattr(catalog, "fit_pca", fit)
    with pytest.raises(Seen) as seen:
        catalog.QUERIES[name](spark, sf_dir)
    assert seen.value.args[0] == set(range(25))


def test_wide_projections_stay_off_the_disk(spark, sf_dir):
    """With all components kept, the snapshots hold the one-hot vectors, and the run goes on and resumes from those."""
    settings = RunSettings(work_path(spark, "wide") + "/b", pca_perc=100, k=4, split_key=("BOOKING_ID",))
    paths = settings.paths
    full = run(spark, settings, bookings=bookings(spark, sf_dir).select("BOOKING_ID", *ROLES.columns))
    for path in (paths.pca_train, paths.pca_test, paths.kmeans_train, paths.kmeans_test):
        columns = spark.read.parquet(path).columns
        assert "features" in columns and "pca_features" not in columns
    # Centres and distances are those of the projected rows.
    rows = full.train.select("prediction", vector_to_array("pca_features").alias("v"))
    nearest = assign_nearest(rows, "v", full.centers.select("cluster", "center"))
    assert nearest.where("cluster <> prediction").count() == 0
    assert full.info["wssse_train"] == pytest.approx(nearest.agg(F.sum("d2")).first()[0])
    resumed = run(spark, settings, start="DICT", snapshots=["DICT"])
    assert report(resumed, "accuracy_by_choice") == report(full, "accuracy_by_choice")
    assert resumed.info["wssse_test"] == pytest.approx(full.info["wssse_test"])
    sweep = sweep_run(spark, settings, (settings.k,)).first()
    assert sweep.wssse_test == pytest.approx(full.info["wssse_test"])


def test_rows_are_split_before_they_are_encoded(spark, sf_dir, monkeypatch):
    encode, seen = stages.encode_features, []

    def counted(rows, *rest):
        seen.append(rows.count())
        return encode(rows, *rest)

    monkeypatch.setattr(stages, "encode_features", counted)
    settings = RunSettings(work_path(spark, "split") + "/b", split_key=("BOOKING_ID",))
    state = run(spark, settings, stop="LOAD", bookings=bookings(spark, sf_dir).select("BOOKING_ID", *ROLES.columns))
    assert seen == [state.info["rows_train"], state.info["rows_test"]] and min(seen) > 0


def test_variance_is_fitted_on_written_vectors(spark, sf_dir, monkeypatch):
    class Seen(Exception):
        pass

    def fit(rows, components):
        raise Seen(rows.inputFiles())

    monkeypatch.setattr(catalog, "fit_pca", fit)
    with pytest.raises(Seen) as seen:
        catalog.QUERIES["pca_variance"](spark, sf_dir)
    assert seen.value.args[0] and all("/features-" in path for path in seen.value.args[0])


def test_json_records_are_written_compressed(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "work_path", lambda spark, name: str(tmp_path / name))
    rows = catalog.QUERIES["json_records"](spark, sf_dir).count()
    assert 0 < sum(f.stat().st_size for f in (tmp_path / "json").iterdir()) < 150 * rows


def test_rows_that_no_snapshot_keeps_give_way_to_the_next(spark, sf_dir, tmp_path, monkeypatch):
    """A run for its model alone leaves one table of train and one of test rows, and the model of a run that keeps all."""
    monkeypatch.setattr(stages, "work_path", lambda spark, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    rows = snapshot(bookings(spark, sf_dir).select("BOOKING_ID", *ROLES.columns), "rows")
    found = []
    for name, kept in ("some", ["DICT"]), ("all", STAGES):
        settings = RunSettings(str(tmp_path / name / "b"), pca_perc=100, k=4, split_key=("BOOKING_ID",))
        state = run(spark, settings, stop="DICT", snapshots=kept, bookings=rows)
        found.append((state.info["wssse_train"], state.train.count(), state.test.count(), ranked(state.preferences)))
    assert found[0] == found[1]
    counts = [spark.read.parquet(str(p)).count() for p in tmp_path.iterdir() if p.name.startswith(("clean-", "stage-"))]
    assert sorted(n for n in counts if n) == sorted(found[0][1:3])


def ranked(prefs):
    return sorted(map(str, prefs.ranking.select("cluster", "ycol", "val", "occur", "pos").collect()))


def test_arriving_requests_are_written_compressed(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "work_path", lambda spark, name: str(tmp_path / name))
    codec = spark.conf.get(STATE_CODEC)
    rows = catalog.QUERIES["score_requests_stream"](spark, sf_dir).count()
    files = [f for f in (tmp_path / "stream" / "in").iterdir() if f.name.startswith("part-")]
    assert len(files) == 3 and 0 < sum(f.stat().st_size for f in files) < 150 * rows
    assert spark.conf.get(STATE_CODEC) == codec
