import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.functions.text import slugify
from maskwright.operators import evaluation as E
from maskwright.operators import generation as G
from maskwright.operators.semantic import semantic_scan
from maskwright.plans import suites
from maskwright.plans.scan import column_scores, column_verdicts, table_verdicts
from maskwright.sources.ingest import read_ground_truth


@pytest.mark.parametrize("n, pct", [(1, 70), (7, 65), (20, 70), (997, 85), (5000, 65), (4096, 0), (100, 100)])
def test_exact_shares(spark, n, pct):
    chosen = spark.range(n).select(F.count_if(G.is_chosen(F.col("id"), n, pct, 3)).alias("c")).first().c
    assert chosen == int(n * pct / 100)


def test_shares_hold_for_very_large_tables(spark):
    """No product leaves 64 bits, and the map stays one to one, at 10^11 rows."""
    n = 10**11
    ids = spark.range(n - 1000, n).select(G.is_chosen(F.col("id"), n, 70, 3).alias("c"))
    assert ids.count() == 1000 and ids.filter("c is null").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 20, 97, 1009, 5000, 10007])
def test_the_permutation_is_one_to_one(spark, n):
    places = [r.p for r in spark.range(n).select(G.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(places) == list(range(n))


def test_neighbouring_picks_are_not_tied_to_each_other(spark):
    """Of pairs of ids at any small distance, as many are both chosen as chance has it; another key picks others."""
    n = 20000
    rows = spark.range(n).select("id", *[G.is_chosen(F.col("id"), n, 50, k).alias(f"k{k}") for k in (1, 2)]).orderBy("id").collect()
    first, second = np.array([r.k1 for r in rows]), np.array([r.k2 for r in rows])
    assert first.sum() == second.sum() == n // 2
    for step in (1, 2, 3, 7, 100, 141, 1000):
        assert abs(np.corrcoef(first[:-step], first[step:])[0, 1]) < 0.03
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.03
    runs = np.diff(np.flatnonzero(np.diff(first.astype(int)) != 0))
    assert abs((runs == 1).mean() - 0.5) < 0.03 and runs.max() > 8


def test_values_do_not_depend_on_partitioning(spark):
    one = G.gen_table(spark, suites.END_TO_END, 500)
    ids = spark.range(500).repartition(17)
    assert sorted(one.collect()) == sorted(G.gen_columns(ids, suites.END_TO_END, 500).collect())


@pytest.mark.parametrize("n_rows", [1000, 5000])
def test_scanner_suite_meets_its_expectations(spark, n_rows):
    table = G.gen_table(spark, suites.SCANNER_SUITE, n_rows)
    scores = column_scores(table, "test_suite", sample_size=None)
    expected = G.expectations_frame(spark, "test_suite", suites.SCANNER_SUITE)
    assert E.regex_expectations(scores, expected).collect() == []
    assert E.model_expectations(semantic_scan(scores), expected).collect() == []
    methods = {r.column_name: r.detection_method for r in column_verdicts(table, "t", sample_size=None).collect()}
    assert methods == {s.column_name: s.detection_method for s in suites.SCANNER_SUITE}


@pytest.mark.parametrize("sample_size", [None, 200])
def test_accuracy_on_labelled_tables(spark, sample_size):
    tables = {"e2e_data": suites.END_TO_END, **suites.DOMAIN_TABLES}
    frames = {name: G.gen_table(spark, specs, 2000, 5) for name, specs in tables.items()}
    truth = None
    for name, specs in tables.items():
        one = G.truth_frame(spark, name, specs)
        truth = one if truth is None else truth.unionByName(one)
    matrix = E.require_complete(E.confusion(truth, table_verdicts(frames, sample_size=sample_size)))
    for row in E.level_accuracy(E.scores(matrix)).collect():
        assert row.precision >= 0.85 and row.recall >= 0.90 and row.f1_score >= 0.87, row
        assert row.level_accuracy >= 0.80, row


def test_truth_round_trip(spark, tmp_path):
    G.emit_truth(spark, "e2e_data.csv", suites.END_TO_END, 10, str(tmp_path / "truth"))
    found = {tuple(r) for r in read_ground_truth(spark, str(tmp_path / "truth")).collect()}
    assert found == {tuple(r) for r in G.truth_frame(spark, "e2e_data", suites.END_TO_END).collect()}


def test_slug(spark):
    row = spark.createDataFrame([("Đặng Thị Ánh Tuyết!",)], "n string").select(slugify(F.col("n")).alias("s")).first()
    assert row.s == "dang.thi.anh.tuyet"
