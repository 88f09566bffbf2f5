"""Registered queries: every operator on the given tables. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpref.config import STAGES, ColumnRoles, RunSettings
from cohortpref.functions.scalar import hour_band, quantize_days
from cohortpref.operators.accuracy import (
    accuracy_by_choice,
    accuracy_long,
    accuracy_overall,
    accuracy_wide,
    cmc_curve,
    position_stats,
    scored_steps,
)
from cohortpref.operators.canonical import fit_signed_pca, number_centers, renumber
from cohortpref.operators.clean import clean_bookings, drop_incomplete, without_columns
from cohortpref.operators.cluster import (
    assign_nearest,
    center_table,
    fit_kmeans,
    fit_pca,
    model_centers,
    pca_components,
    project,
    with_center_distance,
    wssse,
)
from cohortpref.operators.domain import check_requests, rejected_requests, save_domains, valid_requests, value_domain
from cohortpref.operators.encode import (
    apply_index,
    encode_features,
    fit_features,
    index_report,
    one_hot_slots,
    save_index,
    value_index,
    vector_width,
)
from cohortpref.operators.lloyd import assign_in_cells, lloyd
from cohortpref.operators.ranking import choice_frequency, fit_preferences, rank_choices, ranking_totals
from cohortpref.operators.reports import cluster_distincts, cluster_sizes
from cohortpref.operators.responses import request_responses
from cohortpref.operators.scoring import load_model, normalize_by_request, score_requests
from cohortpref.operators.split import hash_split, random_split
from cohortpref.plans.bookings import CLUSTERS, GROUPS, SPLIT_WEIGHTS, bookings, in_train_split, is_test, is_train, separated_bookings
from cohortpref.plans.oracle import CHOICES
from cohortpref.plans.stages import model_info, run
from cohortpref.plans.sweep import kmeans_sweep, read_sweep, write_sweep
from cohortpref.session import snapshot, work_path
from cohortpref.sources.readers import parse_json_column, read_bookings_csv, read_bookings_json
from cohortpref.sources.writers import TABLE_CODEC, write_parquet
from cohortpref.streaming.requests import StreamOutputs, gather_requests, read_request_stream, score_stream

ROLES = ColumnRoles()
ID = "BOOKING_ID"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A small model: the derived bookings have few features, so more of them are kept than by default.
PCA_PERCENT = 10
MODEL_K = 30


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_bookings(bookings(spark, sf_dir), ROLES)


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean bookings as a table of their own, for queries that read them more than once."""
    return snapshot(clean(spark, sf_dir), "bookings")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


# Scans, cleaning, projections


@query
def bookings_clean(spark, sf_dir):
    return clean(spark, sf_dir)


@query
def csv_scan_dropmalformed(spark, sf_dir):
    """The bookings as CSV text with malformed lines among them: text in a number column, missing fields, and an
    empty field, each in a tenth of the lines. The read must return exactly the other lines."""
    rows = bookings(spark, sf_dir)
    fields = [F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" ")) for c in ROLES.columns]
    kind = F.col("SPLIT_BUCKET") % 10
    line = (
        F.when(kind == 0, F.concat_ws(",", F.lit("foo"), *fields[1:], F.col(ID)))
        .when(kind == 1, F.concat_ws(",", *fields[:5]))
        .when(kind == 2, F.concat_ws(",", fields[0], F.lit(""), *fields[2:], F.col(ID)))
        .otherwise(F.concat_ws(",", *fields, F.col(ID)))
    )
    roles = replace(ROLES, table=ROLES.table + ((ID, "string"),))
    path = work_path(spark, "csv")
    # One text column whose name is the header line, so that every file starts with it.
    header = ",".join([*ROLES.columns, ID])
    rows.select(line.alias(header)).write.csv(path, header=True, sep="\u0001", quote="", escapeQuotes=False,
                                              ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_bookings_csv(spark, path, roles)


@query
def json_records(spark, sf_dir):
    """The bookings as JSON lines, a tenth of them without one field. The field names are most of the text: compressed,
    it takes less room than the bookings themselves."""
    rows = bookings(spark, sf_dir)
    lacking = F.when(F.col("SPLIT_BUCKET") % 10 != 0, F.col("STRING_Y_UE")).alias("STRING_Y_UE")
    path = work_path(spark, "json")
    rows.select(*[lacking if c == "STRING_Y_UE" else F.col(c) for c in ROLES.columns]).write.json(path, compression="gzip")
    return read_bookings_json(spark, path, ROLES)


@query
def json_text_column(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return parse_json_column(events, "props", "k int").drop("props")


@query
def parquet_snapshot_roundtrip(spark, sf_dir):
    return write_parquet(bookings(spark, sf_dir), work_path(spark, "bookings"))


@query
def quantize_days_query(spark, sf_dir):
    rows = bookings(spark, sf_dir)
    days = F.col("Y_GIORNI_ALLA_PRENOTAZIONE")
    return rows.select(ID, days.alias("days"), quantize_days(days).alias("code"))


@query
def hour_band_query(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", hour_band(F.col("ts")).alias("band"))


@query
def drop_columns(spark, sf_dir):
    return without_columns(clean(spark, sf_dir), ROLES.dropped)


# Domains, validation, indices, encoding


@query
def value_domain_query(spark, sf_dir):
    return value_domain(clean(spark, sf_dir), ROLES.columns)


def _checked(spark, sf_dir):
    rows = written(spark, sf_dir)
    domains = save_domains(value_domain(rows.where(in_train_split()), ROLES.validated), work_path(spark, "domain"))
    bucket = F.col("SPLIT_BUCKET")
    requests = rows.where(is_test()).withColumns(
        {
            "STRING_X_CAP": F.when(bucket % 7 == 0, F.concat(F.lit("unknown-"), "STRING_X_CAP")).otherwise(
                F.col("STRING_X_CAP")
            ),
            "X_SESSO": F.when(bucket % 5 != 0, F.col("X_SESSO")),
            "X_ETA": F.when(bucket % 11 != 0, F.col("X_ETA")),
        }
    )
    return check_requests(requests.select(ID, *ROLES.columns), domains, ROLES.validated)


@query
def validate_requests_valid(spark, sf_dir):
    return valid_requests(_checked(spark, sf_dir))


@query
def validate_requests_rejected(spark, sf_dir):
    cells = F.transform(
        F.map_entries("rejected_cols"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))
    )
    return rejected_requests(_checked(spark, sf_dir)).select(
        ID, F.array_join(F.array_sort(cells), ",").alias("rejected_cols")
    )


def _index(spark, rows):
    raw = [raw for raw, _ in ROLES.string_pairs()]
    domain = snapshot(value_domain(rows, raw), "domain")
    return value_index(domain, ROLES.string_pairs())


@query
def string_index(spark, sf_dir):
    return _index(spark, clean(spark, sf_dir))


@query
def index_report_query(spark, sf_dir):
    return index_report(_index(spark, clean(spark, sf_dir)))


@query
def apply_string_index(spark, sf_dir):
    rows = written(spark, sf_dir)
    index = save_index(_index(spark, rows), work_path(spark, "index"))
    names = [name for _, name in ROLES.string_pairs()]
    return apply_index(rows, index, ROLES.string_pairs()).select(ID, *names)


def _features(spark, rows, scale=False):
    raw = [ROLES.raw_name(c) for c in ROLES.one_hot_features]
    domains = save_domains(value_domain(rows, raw), work_path(spark, "domain"))
    return fit_features(rows, domains, ROLES, scale=scale)


@query
def one_hot_long(spark, sf_dir):
    rows = written(spark, sf_dir)
    return one_hot_slots(_features(spark, rows).transform(rows), ROLES.one_hot_features)


@query
def assembled_width(spark, sf_dir):
    rows = written(spark, sf_dir)
    encoded = encode_features(rows, _features(spark, rows))
    return spark.range(1).select(F.lit(vector_width(encoded, "features")).alias("tot_col"))


@query
def assembled_features(spark, sf_dir):
    """Every feature vector: the number in front, and the sum of the one-hot slots behind it."""
    rows = written(spark, sf_dir)
    encoded = encode_features(rows, _features(spark, rows))
    cells = vector_to_array("features")
    slots = F.aggregate(F.slice(cells, 2, F.size(cells)), F.lit(0.0), lambda total, x: total + x)
    return encoded.select(ID, cells[0].alias("numeric_part"), slots.alias("one_hot_part"))


# Splits


@query
def hash_split_counts(spark, sf_dir):
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = F.split(F.col(ID), "\\|")
    rows = bookings(spark, sf_dir).select(*[parts[i].alias(k) for i, k in enumerate(keys)])
    train, test = hash_split(rows, keys, SPLIT_WEIGHTS)
    both = train.select(F.lit("train").alias("part")).unionByName(test.select(F.lit("test").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query
def random_split_counts(spark, sf_dir):
    train, test = random_split(snapshot(bookings(spark, sf_dir).select(ID), "rows"), SPLIT_WEIGHTS)
    both = train.select(F.lit("train").alias("part")).unionByName(test.select(F.lit("test").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# Rankings


def _frequency(spark, sf_dir):
    return choice_frequency(clean(spark, sf_dir).where(in_train_split()), "CLUSTER", CHOICES)


@query
def choice_frequency_query(spark, sf_dir):
    return _frequency(spark, sf_dir)


@query
def choice_ranking(spark, sf_dir):
    return rank_choices(_frequency(spark, sf_dir))


@query
def choice_top_n(spark, sf_dir):
    return rank_choices(_frequency(spark, sf_dir), top=3)


@query
def ranking_totals_query(spark, sf_dir):
    return ranking_totals(_frequency(spark, sf_dir), CLUSTERS, CHOICES)


@query
def cluster_size_distribution(spark, sf_dir):
    sizes = cluster_sizes(ranking_totals(_frequency(spark, sf_dir), CLUSTERS, CHOICES), CHOICES[0])
    return rounded(sizes, "mean", "median", *[f"p{p}" for p in range(0, 100, 10)])


@query
def cluster_distinct_distribution(spark, sf_dir):
    sizes = cluster_distincts(ranking_totals(_frequency(spark, sf_dir), CLUSTERS, CHOICES))
    return rounded(sizes, "mean", "median", *[f"p{p}" for p in range(0, 100, 10)])


# Accuracy


def _steps(spark, sf_dir):
    return scored_steps(clean(spark, sf_dir), "CLUSTER", CHOICES, is_train(), is_test())


def _wide(spark, sf_dir):
    rows = snapshot(clean(spark, sf_dir).select(ID, "CLUSTER", "SPLIT_BUCKET", *CHOICES), "bookings")
    prefs = fit_preferences(rows.where(is_train()), "CLUSTER", CHOICES, CLUSTERS)
    return accuracy_wide(rows.where(is_test()), prefs, "CLUSTER").withColumnRenamed("CLUSTER", "cluster")


@query
def choice_accuracy_long(spark, sf_dir):
    return rounded(accuracy_long(_wide(spark, sf_dir), [ID, "cluster"], CHOICES), "acc")


@query
def choice_accuracy_wide(spark, sf_dir):
    made = [f"{kind}_{c}" for c in CHOICES for kind in ("POS", "LAST_POS", "ACC")]
    wide = _wide(spark, sf_dir).select(ID, "cluster", *made, "tot_acc", "mean_acc")
    return rounded(wide, *[f"ACC_{c}" for c in CHOICES], "tot_acc", "mean_acc")


@query
def accuracy_by_choice_query(spark, sf_dir):
    return rounded(accuracy_by_choice(_steps(spark, sf_dir)), "mean_acc", "max_acc", "min_acc")


@query
def accuracy_overall_query(spark, sf_dir):
    return rounded(accuracy_overall(_wide(spark, sf_dir)), "mean_acc", "max_acc", "min_acc")


@query
def position_stats_query(spark, sf_dir):
    return rounded(position_stats(_steps(spark, sf_dir), CHOICES), "mean_pos", "median_pos")


@query
def cmc_curve_query(spark, sf_dir):
    return rounded(cmc_curve(_steps(spark, sf_dir), CHOICES, 10), "share")


# Vectors and clusters


@query
def center_table_query(spark, sf_dir):
    centers = center_table(vectors(spark, sf_dir), "label", "v")
    return rounded(centers.select("cluster", F.posexplode("center").alias("i", "x")), "x")


def _nearest(spark, sf_dir):
    points = vectors(spark, sf_dir)
    return assign_nearest(points, "v", snapshot(center_table(points, "label", "v"), "centers"))


@query
def nearest_center(spark, sf_dir):
    nearest = _nearest(spark, sf_dir).select("vec_id", "cluster", "d2", F.sqrt("d2").alias("distance"))
    return rounded(nearest, "d2", "distance")


@query
def center_distance(spark, sf_dir):
    points = vectors(spark, sf_dir)
    centers = snapshot(center_table(points, "label", "v"), "centers")
    measured = with_center_distance(points, "v", "label", centers)
    return rounded(measured.select("vec_id", "centerdistance"), "centerdistance")


@query
def wssse_query(spark, sf_dir):
    part = F.when(F.col("vec_id") % 10 < 9, "train").otherwise("test").alias("part")
    return rounded(wssse(_nearest(spark, sf_dir).select(part, "d2"), ["part"]), "wssse")


@query
def fixed_projection(spark, sf_dir):
    matrix = [[(j * 7 + c * 3) % 5 - 2 for c in range(4)] for j in range(64)]
    projected = project(vectors(spark, sf_dir), "v", matrix, "p")
    return projected.select("vec_id", *[F.round(F.col("p")[c], 6).alias(f"p{c}") for c in range(4)])


@query
def pca_fit_project(spark, sf_dir):
    """Projection of every booking by a PCA fitted on the train rows."""
    rows = written(spark, sf_dir)
    features = encode_features(rows, _features(spark, rows)).select(ID, "SPLIT_BUCKET", "CLUSTER", "features")
    components = pca_components(vector_width(features, "features"), PCA_PERCENT)
    features = snapshot(features, "features")
    model = fit_pca(features.where(in_train_split()), components)
    return model.transform(features).select(ID, vector_to_array("pca_features").alias("pca_features"))


@query
def pca_variance(spark, sf_dir):
    """Share of the variance that each fitted component explains."""
    raw = [ROLES.raw_name(c) for c in ROLES.feature_columns]
    rows = snapshot(clean(spark, sf_dir).select("SPLIT_BUCKET", "CLUSTER", *raw), "bookings")
    # Filtered before encoding, which no filter moves below; written, since the fit goes over the vectors several times.
    features = encode_features(rows.where(in_train_split()), _features(spark, rows)).select("CLUSTER", "features")
    components = pca_components(vector_width(features, "features"), PCA_PERCENT)
    shares = fit_pca(snapshot(features, "features"), components).explainedVariance
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(shares)], "component int, share double")


def _grouped(spark, sf_dir):
    """The vectors in ten groups far apart, and the groups in two halves farther apart: 20 is added to the coordinate of
    the label, 200 to one coordinate of the upper labels."""
    upper = F.col("label") >= 5
    far = F.transform("v", lambda x, i: x + F.when(i == F.col("label"), 20.0).when((i == 20) & upper, 200.0).otherwise(0.0))
    return vectors(spark, sf_dir).select("vec_id", array_to_vector(far).alias("pca_features"))


@query
def kmeans_fit_assign(spark, sf_dir):
    """Cluster of every vector, with the model trained on the vectors themselves and its clusters numbered by the rule."""
    features = _grouped(spark, sf_dir)
    model = fit_kmeans(features, 10)
    centers = snapshot(number_centers(snapshot(model_centers(spark, model), "centers")), "centers")
    return renumber(model.transform(features), "prediction", centers).select("vec_id", "prediction")


@query
def kmeans_rounds(spark, sf_dir):
    """Centres after three rounds from the first ten vectors, the centres met in cells."""
    points = snapshot(vectors(spark, sf_dir), "points")
    start = points.where(F.col("vec_id") < 10).select(F.col("vec_id").cast("int").alias("cluster"), F.col("v").alias("center"))
    fitted = lloyd(points, "vec_id", "v", start, rounds=3, tolerance=0.0, limit=0, cells=4)
    return rounded(fitted.centers.select("cluster", "n", F.posexplode("center").alias("i", "x")), "x")


@query
def nearest_center_in_cells(spark, sf_dir):
    points = vectors(spark, sf_dir)
    centers = snapshot(center_table(points, "label", "v"), "centers")
    return rounded(assign_in_cells(points, "vec_id", "v", centers), "d2")


@query
def pca_leading_projection(spark, sf_dir):
    """Every vector on the first component, whose sign follows the rule, and the share of variance it explains."""
    features = snapshot(_grouped(spark, sf_dir).withColumnRenamed("pca_features", "features"), "features")
    model = fit_signed_pca(features, 2)
    projected = model.transform(features).select("vec_id", vector_to_array("pca_features")[0].alias("p0"))
    return rounded(projected.withColumn("share", F.lit(model.explained_variance[0])), "p0", "share")


@query
def pca_full_norms(spark, sf_dir):
    """Squared length of every vector in the space of all components; a PCA that keeps them all only rotates."""
    features = vectors(spark, sf_dir).select("vec_id", array_to_vector("v").alias("features"))
    projected = vector_to_array(F.col("pca_features"))
    norm = F.aggregate(projected, F.lit(0.0), lambda total, x: total + x * x)
    return fit_pca(features, 64).transform(features).select("vec_id", F.round(norm, 6).alias("norm2"))


@query
def kmeans_sweep_query(spark, sf_dir):
    """The sweep's table, read back from the file it is written to."""
    train, test = hash_split(_grouped(spark, sf_dir), ["vec_id"], SPLIT_WEIGHTS)
    path = work_path(spark, "sweep")
    write_sweep(kmeans_sweep(train, test, (2, 10)), path)
    return rounded(read_sweep(spark, path), "wssse_train", "wssse_test")


# Scoring and whole runs


@query
def score_normalized(spark, sf_dir):
    """Requests of five vectors each; the choice is the label, ranked inside the nearest centre's cluster."""
    nearest = snapshot(_nearest(spark, sf_dir), "nearest")
    prefs = fit_preferences(nearest, "cluster", ["label"], 10)
    rows = accuracy_wide(nearest, prefs, "cluster").select(
        "vec_id",
        F.floor(F.col("vec_id") / 5).alias("request_id"),
        F.sqrt("d2").alias("centerdistance"),
        "d2",
        F.col("ACC_label").alias("acc"),
    )
    scored = normalize_by_request(snapshot(rows, "scored"), "request_id", {"acc": "acc_norm"}).drop("d2")
    return rounded(scored, "centerdistance", "acc", "acc_norm", "request_wssse")


def _run(spark, sf_dir, stop="TEST", separated=False, snapshots=STAGES):
    """A run over the bookings; over the separated ones with all components and one cluster per group."""
    rows = (separated_bookings if separated else bookings)(spark, sf_dir).select(ID, *ROLES.columns)
    perc, k = (100, GROUPS) if separated else (PCA_PERCENT, MODEL_K)
    settings = RunSettings(base=work_path(spark, "run") + "/bookings", pca_perc=perc, k=k, split_key=(ID,))
    state = run(spark, settings, stop=stop, bookings=rows, snapshots=snapshots)
    return settings, state


def _model(spark, sf_dir, separated=False):
    """A model to score with, from a run that nobody resumes: of its rows only the latest stay on disk."""
    settings, _ = _run(spark, sf_dir, stop="DICT", separated=separated, snapshots=["DICT"])
    return load_model(spark, settings)


def _requests(spark, sf_dir):
    """The separated test rows as requests of one prescriber each, some with an unknown post code, some without an age."""
    rows = snapshot(separated_bookings(spark, sf_dir).where(is_test()), "requests", TABLE_CODEC)
    bucket = F.col("SPLIT_BUCKET")
    altered = {
        "STRING_X_CAP": F.when(bucket % 7 == 0, "nowhere").otherwise(F.col("STRING_X_CAP")),
        "X_ETA": F.when(bucket % 11 != 0, F.col("X_ETA")),
    }
    return rows.withColumns(altered).select(
        F.col("STRING_X_PRESCRITTORE").cast("bigint").alias("request_id"), F.col(ID).alias("row_id"), *ROLES.columns
    )


def _scored_columns(scored):
    per_choice = [f"{kind}_{c}" for c in ROLES.y for kind in ("POS", "LAST_POS", "ACC", "ACC_NORM")]
    out = scored.select(
        "request_id", "row_id", "prediction", *per_choice, "tot_acc", "mean_acc", "mean_acc_norm", "centerdistance",
        F.round("request_wssse", 4).alias("request_wssse"),
    )
    doubles = [c for c, kind in out.dtypes if kind == "double" and c != "request_wssse"]
    return rounded(out, *doubles)


@query
def score_requests_query(spark, sf_dir):
    model = _model(spark, sf_dir, separated=True)
    scored, _, _ = score_requests(_requests(spark, sf_dir), model)
    return _scored_columns(scored)


@query
def score_responses(spark, sf_dir):
    """The response of every request, its entries as text."""
    model = _model(spark, sf_dir, separated=True)
    results = score_requests(_requests(spark, sf_dir), model)
    responses = request_responses(*results, ROLES.y, ROLES.columns)
    micro = lambda x: F.round(x * 10000).cast("bigint").cast("string")
    entry = lambda e: F.concat(
        e["row_id"], F.lit("="), F.concat_ws(":", e["prediction"].cast("string"), micro(e["mean_acc"]), micro(e["mean_acc_norm"]), micro(e["centerdistance"]))
    )
    refused = lambda e: F.concat(
        e["row_id"], F.lit("="), F.concat_ws(",", F.transform(e["rejected_cols"], lambda c: F.concat_ws(":", c["key"], c["value"])))
    )
    return responses.withColumns(
        {
            "request_wssse": F.round("request_wssse", 4),
            "accuracies": F.concat_ws(";", F.transform("accuracies", entry)),
            "rejected": F.concat_ws(";", F.transform("rejected", refused)),
            "incomplete": F.concat_ws(";", F.transform("incomplete", lambda e: e["row_id"])),
        }
    )


@query
def score_requests_stream(spark, sf_dir):
    """The same requests as they arrive: every request's rows lie in three files, and are scored when all are there. The
    files are compressed, as the field names are most of their text."""
    model = _model(spark, sf_dir, separated=True)
    base = work_path(spark, "stream")
    rows = _requests(spark, sf_dir)
    sizes = rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("request_rows"))
    rows = snapshot(rows.join(sizes, "request_id"), "arriving", TABLE_CODEC)
    for file in range(3):
        rows.where(F.pmod(F.xxhash64("row_id"), F.lit(3)) == file).coalesce(1).write.mode("append").json(f"{base}/in", compression="gzip")
    stream = gather_requests(read_request_stream(spark, f"{base}/in", model, files_per_batch=1))
    outputs = StreamOutputs(f"{base}/scored", f"{base}/rejected", f"{base}/incomplete", f"{base}/unfinished")
    score_stream(stream, model, outputs, f"{base}/checkpoint").awaitTermination()
    return _scored_columns(spark.read.parquet(outputs.scored))


@query
def model_info_query(spark, sf_dir):
    settings, _ = _run(spark, sf_dir, stop="KMEANS", separated=True)
    info = model_info(spark, settings)
    return info.select(
        "num_custer", F.col("kmeans_centers_found").alias("centers"), "tot_col", "k_pca", F.round("wssse_train", 3).alias("wssse_train")
    )


@query
def staged_run(spark, sf_dir):
    """All stages; the accuracy report of the held-out rows."""
    _, state = _run(spark, sf_dir, separated=True)
    return rounded(state.reports["accuracy_by_choice"], "mean_acc", "max_acc", "min_acc")


@query
def staged_run_totals(spark, sf_dir):
    """Rows that the rankings of a full run were made from and rows they were tested on, per choice column."""
    _, state = _run(spark, sf_dir)
    trained = state.preferences.totals.groupBy("ycol").agg(F.sum("tot_values").alias("n_train"))
    tested = state.reports["accuracy_by_choice"].select("ycol", F.col("n").alias("n_test"))
    return trained.join(tested, "ycol")


@query
def scored_request_counts(spark, sf_dir):
    """Scored and rejected rows per request when a quarter of the rows has an unknown postcode."""
    model = _model(spark, sf_dir)
    rows = snapshot(bookings(spark, sf_dir).where(is_test()), "requests", TABLE_CODEC)
    postcode = F.when(F.col("SPLIT_BUCKET") % 4 == 0, "nowhere").otherwise(F.col("STRING_X_CAP"))
    requests = rows.withColumn("STRING_X_CAP", postcode).select(
        F.col("CLUSTER").alias("request_id"), F.col(ID).alias("row_id"), *ROLES.columns
    )
    scored, rejected, _ = score_requests(requests, model)
    both = scored.select("request_id", F.lit(1).alias("scored")).unionByName(
        rejected.select("request_id", F.lit(0).alias("scored"))
    )
    return both.groupBy("request_id").agg(
        F.sum("scored").alias("n_scored"), F.sum(1 - F.col("scored")).alias("n_rejected")
    )


QUERIES = {name.removesuffix("_query"): function for name, function in QUERIES.items()}
