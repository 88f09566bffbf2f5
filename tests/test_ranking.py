import pytest
from pyspark.sql import functions as F

from cohortpref.functions.scalar import quantize_days
from cohortpref.operators.accuracy import (
    accuracy_by_choice,
    accuracy_long,
    accuracy_overall,
    accuracy_wide,
    cmc_curve,
    position_stats,
    scored_counts_of,
    scored_steps,
)
from cohortpref.operators.ranking import choice_frequency, fit_preferences, rank_choices, ranking_totals
from cohortpref.operators.reports import cluster_sizes
from cohortpref.plans.bookings import CLUSTERS, bookings, is_test, is_train
from cohortpref.plans.oracle import CHOICES

TRAIN = [(0, "a")] * 5 + [(0, "b")] * 5 + [(0, "c")] * 3 + [(1, "a")] * 2
TEST = [(0, "a"), (0, "b"), (0, "c"), (0, "new"), (1, "a"), (1, "c"), (2, "a")]


@pytest.fixture(scope="module")
def prefs(spark):
    return fit_preferences(spark.createDataFrame(TRAIN, "k int, y string"), "k", ["y"], 4)


def both(spark):
    rows = [(k, y, True) for k, y in TRAIN] + [(k, y, False) for k, y in TEST]
    return spark.createDataFrame(rows, "k int, y string, train boolean")


@pytest.mark.parametrize("limit", [None, -1])
def test_ties_share_a_position(spark, limit):
    frequency = choice_frequency(spark.createDataFrame(TRAIN, "k int, y string"), "k", ["y"])
    ranking = rank_choices(frequency, limit=limit)
    assert sorted((r.val, r.pos) for r in rank_choices(frequency, 1, limit).collect()) == [("a", 1), ("a", 1), ("b", 1)]
    assert sorted((r.cluster, r.val, r.occur, r.pos) for r in ranking.collect()) == [
        (0, "a", 5, 1), (0, "b", 5, 1), (0, "c", 3, 2), (1, "a", 2, 1),
    ]


def test_totals_of_all_clusters(spark):
    totals = ranking_totals(choice_frequency(spark.createDataFrame(TRAIN, "k int, y string"), "k", ["y"]), 4, ["y"])
    assert sorted(tuple(r) for r in totals.collect()) == [
        (0, "y", 2, 13, 3), (1, "y", 1, 2, 1), (2, "y", None, 0, 0), (3, "y", None, 0, 0),
    ]


@pytest.mark.parametrize("limit", [None, -1])
def test_accuracy_of_ties_misses_and_empty_clusters(spark, prefs, limit):
    wide = accuracy_wide(spark.createDataFrame(TEST, "k int, y string"), prefs, "k", limit)
    rows = sorted((r.k, r.val, r.pos, r.last_pos, r.acc) for r in accuracy_long(wide, ["k"], ["y"]).collect())
    assert rows == [
        (0, "a", 0, 2, 1.0), (0, "b", 0, 2, 1.0), (0, "c", 1, 2, 0.5), (0, "new", None, 2, 0.0),
        (1, "a", 0, 1, 1.0), (1, "c", None, 1, 0.0), (2, "a", None, None, 0.0),
    ]
    overall = accuracy_overall(wide).first()
    assert (overall.n, overall.mean_acc, overall.max_acc, overall.min_acc) == (7, pytest.approx(3.5 / 7), 1.0, 0.0)


def test_shuffled_lookup_with_no_hot_keys_gives_the_same(spark, prefs, monkeypatch):
    from cohortpref.operators import joins

    test = spark.createDataFrame(TEST, "k int, y string")
    expected = sorted(map(str, accuracy_wide(test, prefs, "k").collect()))
    for hot in (1, 3):
        monkeypatch.setattr(joins, "HOT_KEYS", hot)
        assert sorted(map(str, accuracy_wide(test, prefs, "k", -1).collect())) == expected


@pytest.mark.parametrize("way", ["steps", "counts", "shuffled counts"])
def test_reports(spark, prefs, way):
    if way == "steps":
        scored = scored_steps(both(spark), "k", ["y"], F.col("train"), ~F.col("train"))
    else:
        scored = scored_counts_of(spark.createDataFrame(TEST, "k int, y string"), "k", prefs, -1 if way != "counts" else None)
    acc = accuracy_by_choice(scored).first()
    assert (acc.n, acc.n_unranked, acc.max_acc, acc.min_acc) == (7, 3, 1.0, 0.0)
    assert acc.mean_acc == pytest.approx(3.5 / 7)
    # Positions 0 0 1 2 | 0 1: misses count with the last position, the empty cluster is left out.
    stats = position_stats(scored, ["y"]).first()
    assert (stats.count_position, stats.min_pos, stats.max_pos, stats.median_pos) == (6, 0, 2, 0.5)
    assert stats.mean_pos == pytest.approx(4 / 6)
    curve = [(r.i, r.n_within, r.n) for r in cmc_curve(scored, ["y"], 3).orderBy("i").collect()]
    assert curve == [(0, 3, 6), (1, 5, 6), (2, 6, 6)]


def test_reports_without_positions(spark, prefs):
    scored = scored_counts_of(spark.createDataFrame([(3, "a")], "k int, y string"), "k", prefs)
    stats = position_stats(scored, ["y"]).first()
    assert (stats.count_position, stats.mean_pos) == (0, None)
    assert [(r.n_within, r.share) for r in cmc_curve(scored, ["y"], 2).collect()] == [(0, None)] * 2


def test_known_cluster_sizes(spark, sf_dir):
    rows = bookings(spark, sf_dir)
    totals = ranking_totals(choice_frequency(rows, "CLUSTER", CHOICES), CLUSTERS, CHOICES)
    sizes = cluster_sizes(totals, CHOICES[0]).first()
    assert (sizes.n_clusters, sizes["mean"], sizes["min"], sizes["max"]) == (30, 200.0, 0, 505)
    assert [round(sizes[f"p{p}"], 6) for p in (0, 10, 20, 50, 90)] == [0, 0, 121.6, 200, 356.9]


def test_known_accuracies(spark, sf_dir):
    days = "Y_GIORNI_ALLA_PRENOTAZIONE"
    rows = bookings(spark, sf_dir).withColumn(days, quantize_days(F.col(days)))
    scored = scored_steps(rows, "CLUSTER", CHOICES, is_train(), is_test())
    found = {r.ycol: (r.n, r.n_unranked, round(r.mean_acc, 6)) for r in accuracy_by_choice(scored).collect()}
    assert found == {
        "Y_FASCIA_ORARIA": (568, 28, 0.661825),
        "Y_GIORNI_ALLA_PRENOTAZIONE": (568, 28, 0.753098),
        "Y_GIORNO_SETTIMANA": (568, 28, 0.571114),
        "Y_MESE_ANNO": (568, 28, 0.517571),
        "STRING_Y_STER": (568, 28, 0.545562),
        "STRING_Y_UE": (568, 209, 0.233581),
    }


def test_the_report_scans_the_rows_once(spark, sf_dir):
    scored = scored_steps(bookings(spark, sf_dir), "CLUSTER", CHOICES, is_train(), is_test())
    plan = accuracy_by_choice(scored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
