import pytest

from maskwright import vocab as V
from maskwright.operators import evaluation as E
from maskwright.operators.masking import mask_frame

TAGGED = "table_name string, column_name string, sensitivity_tag string, sensitivity_level string"


def frames(spark, truth, found):
    return spark.createDataFrame(truth, TAGGED), spark.createDataFrame(found, TAGGED)


def test_confusion_scores_and_levels(spark):
    truth, found = frames(
        spark,
        [("t", "a", "NAME", "MEDIUM"), ("t", "b", "NONE", "NONE"), ("t", "c", "DOB", "LOW"), ("t", "d", "NONE", "NONE")],
        [("t", "a", "PHONE", "MEDIUM"), ("t", "b", "NAME", "MEDIUM"), ("t", "c", "NONE", "NONE"),
         ("t", "d", "NONE", "NONE"), ("t", "extra", "NAME", "MEDIUM")],
    )
    row = E.level_accuracy(E.scores(E.require_complete(E.confusion(truth, found)))).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 1, 1, 1)
    assert (row.precision, row.recall, row.f1_score, row.level_accuracy) == (0.5, 0.5, 0.5, 0.5)


def test_zero_denominators_and_missing_predictions(spark):
    truth, found = frames(spark, [("t", "a", "NONE", "NONE")], [("t", "a", "NONE", "NONE")])
    row = E.scores(E.confusion(truth, found)).first()
    assert (row.precision, row.recall, row.f1_score) == (0.0, 0.0, 0.0)
    truth, found = frames(spark, [("t", "a", "NAME", "MEDIUM")], [("t", "z", "NAME", "MEDIUM")])
    assert E.confusion(truth, found).first().missing == 1
    with pytest.raises(Exception, match="Missing predictions"):
        E.require_complete(E.confusion(truth, found)).collect()


def test_compliance_looks_at_every_row(spark):
    truth = {"email": "EMAIL", "state": "NONE"}
    good = spark.createDataFrame([("a*@x.com", "open"), ("b*@x.com", "shut")], "email string, state string")
    leak = good.union(spark.createDataFrame([("plain@x.com", "o*n")], good.schema))
    assert E.masking_compliance(good, truth, "AUDITOR").first().masking_compliance == 100.0
    assert E.masking_compliance(leak, truth, "AUDITOR").first().masking_compliance == 0.0
    assert E.no_over_masking(good, truth, "AUDITOR").first().no_over_masking == 100.0
    assert E.no_over_masking(leak, truth, "AUDITOR").first().no_over_masking == 0.0
    assert E.masking_compliance(good, truth, "ADMIN").first().masking_compliance == 100.0  # nothing to check


def test_latency_statistics(spark):
    runs = spark.createDataFrame(
        [("A", 1.0), ("A", 2.0), ("A", 9e9), ("B", 4.0), ("C", 3.0), ("C", 3.0)], "role_name string, duration double"
    )
    trimmed = {r.role_name: (r.n_runs, r.mean_duration) for r in E.trimmed_latency(runs).collect()}
    assert trimmed == {"A": (2, 1.5), "B": (1, 4.0), "C": (1, 3.0), None: (4, 2.5)}
    normal = spark.createDataFrame([(2.0,), (2.0,), (50.0,)], "duration double")
    overhead = {r.role_name: r.overhead_pct for r in E.overhead_pct(runs, normal).collect()}
    assert overhead == {"A": -25.0, "B": 100.0, "C": 50.0, None: 25.0}
    zero = spark.createDataFrame([(0.0,)], "duration double")
    assert {r.overhead_pct for r in E.overhead_pct(runs, zero).collect()} == {0.0}
    mean = {r.role_name: r.mean_duration for r in E.mean_latency(runs.filter("role_name <> 'A'")).collect()}
    assert mean == {"B": 4.0, "C": 3.0, None: 10.0 / 3}
    assert "Window" not in E.trimmed_latency(runs)._jdf.queryExecution().executedPlan().toString()


def test_targets_know_their_direction(spark):
    metrics = spark.createDataFrame([("precision", 0.85), ("overhead_pct", 20.0), ("recall", 0.5), ("other", 1.0)],
                                    "metric string, value double")
    passed = {r.metric: r.passed for r in E.sla_check(metrics, E.targets_frame(spark)).collect()}
    assert passed == {"precision": True, "overhead_pct": False, "recall": False}


def test_readable(spark):
    assert E.readable(spark.range(1)) and not E.readable(spark.range(0))


def test_compliance_of_all_roles_comes_from_one_scan(spark, tmp_path):
    df = spark.range(40).selectExpr("'u' || id || '@x.com' email", "'Lê Minh An' name", "cast(id + 1234567890 as string) phone", "'open' state")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    truth = {"email": "EMAIL", "name": "NAME", "phone": "PHONE", "state": "NONE"}
    found = E.compliance_by_role(df, truth)
    each = []
    for role in V.ROLES:
        secure = mask_frame(df, {c: V.POLICIES[role][V.TAGS[t][0]] for c, t in truth.items()})
        each += E.compliance_by_column(secure, truth, role).collect()
    assert sorted(found.collect()) == sorted(each)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    rates = {r.role_name: (r.n_checked, r.masking_compliance) for r in E.compliance_rates(found).collect()}
    assert rates == {"ADMIN": (0, 100.0), "ANALYST": (3, 100.0), "AUDITOR": (3, 100.0)}
    assert {r.no_over_masking for r in E.over_masking_rates(found).collect()} == {100.0}
