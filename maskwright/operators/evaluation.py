"""Detection accuracy, masking compliance, latency statistics and targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions.masking import column_ref, mask_expr
from maskwright.sources.local import local_frame

LATENCY_TYPE = "decimal(27,9)"


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def compare(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth columns with their prediction; extra predictions are left out."""
    found = predicted.select(
        "table_name", "column_name",
        F.col("sensitivity_tag").alias("predicted_tag"), F.col("sensitivity_level").alias("predicted_level"),
    )
    return truth.join(found, ["table_name", "column_name"], "left")


def confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """TP, FP, FN and TN per table on "has a tag", and the level hits.

    ``missing`` counts truth columns without a prediction; use
    :func:`require_complete` to fail on them.
    """
    real = F.col("sensitivity_tag") != V.NONE_TAG
    said = F.col("predicted_tag") != V.NONE_TAG
    return compare(truth, predicted).groupBy("table_name").agg(
        F.count_if(real & said).alias("tp"),
        F.count_if(~real & said).alias("fp"),
        F.count_if(real & ~said).alias("fn"),
        F.count_if(~real & ~said).alias("tn"),
        F.count_if(F.col("predicted_tag").isNull()).alias("missing"),
        F.count_if(F.col("sensitivity_level") == F.col("predicted_level")).alias("level_hits"),
        F.count(F.lit(1)).alias("n_columns"),
    )


def require_complete(matrix: DataFrame) -> DataFrame:
    """Raise when a table has truth columns without a prediction.

    The check is a filter, so it runs whatever columns are read later."""
    text = F.concat(F.lit("Missing predictions in table "), F.col("table_name"))
    return matrix.filter(F.when(F.col("missing") == 0, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per table; 0 where a denominator is 0."""
    rated = matrix.withColumns({
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    product, total = F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
    return rated.withColumn("f1_score", _ratio(F.lit(2.0) * product, total))


def level_accuracy(matrix: DataFrame) -> DataFrame:
    """Share of a table's columns whose level is right."""
    return matrix.withColumn("level_accuracy", _ratio(F.col("level_hits"), F.col("n_columns")))


def _complies(value: Column, column: str, rule: str) -> Column:
    """Does a masked value look the way its rule demands?"""
    if rule == "HASH_MASK":
        ok = F.length(value) == 64
    elif rule == "NULLIFY_MASK":
        return value.isNull()
    elif rule == "REDACTED_MASK":
        ok = value == V.REDACTED
    else:
        ok = value.contains("*")
        if "email" in column:
            ok = ok & value.contains("@")
        if "name" in column or "c03" in column:
            ok = ok & value.contains(" ")
    return F.coalesce(ok, F.lit(False))


def _untouched(value: Column) -> Column:
    return F.coalesce((value != V.REDACTED) & ~value.contains("*"), F.lit(False))


def _checks(truth: dict[str, str], role: str, policies=V.POLICIES) -> dict[str, str]:
    """column -> rule its tag demands for the role (CLEAR_TEXT: none)."""
    def rule(tag: str) -> str:
        if tag == V.NONE_TAG:
            return "CLEAR_TEXT"
        return policies[role][V.TAGS.get(tag, (V.NONE_LEVEL,))[0]]

    return {column: rule(tag) for column, tag in truth.items()}


def _check(value: Column, column: str, rule: str) -> Column:
    return _untouched(value) if rule == "CLEAR_TEXT" else _complies(value, column, rule)


def compliance_by_column(secure: DataFrame, truth: dict[str, str], role: str) -> DataFrame:
    """Per column: rows, and rows that meet the rule or, unmasked, are untouched.

    ``secure`` is what the role was given and ``truth`` maps its columns to their
    real tags. One aggregation over all rows of all columns.
    """
    checks = _checks(truth, role)
    passed = [
        F.count_if(_check(column_ref(c).cast("string"), c, rule)).alias(f"ok_{i}")
        for i, (c, rule) in enumerate(checks.items())
    ]
    totals = secure.agg(F.count(F.lit(1)).alias("n_rows"), *passed)
    return _reported(totals, [(role, c, rule, f"ok_{i}") for i, (c, rule) in enumerate(checks.items())])


def _reported(totals: DataFrame, checks: list[tuple[str, str, str, str]]) -> DataFrame:
    """A row for each (role, column, rule, name of its count) from the one row of ``totals``."""
    rows = F.array(*[
        F.struct(
            F.lit(role).alias("role_name"),
            F.lit(c).alias("column_name"),
            F.lit(rule).alias("masking_rule"),
            F.lit(rule != "CLEAR_TEXT").alias("must_mask"),
            F.col("n_rows"),
            F.col(count).alias("n_ok"),
        )
        for role, c, rule, count in checks
    ])
    return totals.select(F.explode(rows).alias("c")).select("c.*")


def compliance_by_role(df: DataFrame, truth: dict[str, str], roles=tuple(V.ROLES), policies=V.POLICIES) -> DataFrame:
    """:func:`compliance_by_column` of what every role would be given of ``df``, from one scan.

    A column is masked once for each different rule that the roles have for it, in one projection, and all checks are
    counts of one aggregate without a key.
    """
    checks = [(role, c, rule) for role in roles for c, rule in _checks(truth, role, policies).items()]
    pairs = {pair: i for i, pair in enumerate(dict.fromkeys((c, rule) for _, c, rule in checks))}
    masked = df.select(*[mask_expr(c, rule).cast("string").alias(f"m_{i}") for (c, rule), i in pairs.items()])
    totals = masked.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if(_check(F.col(f"m_{i}"), c, rule)).alias(f"ok_{i}") for (c, rule), i in pairs.items()])
    return _reported(totals, [(role, c, rule, f"ok_{pairs[c, rule]}") for role, c, rule in checks])


def _rate(by_column: DataFrame, must_mask: bool, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    relevant = F.col("must_mask") == must_mask
    checked = F.count_if(relevant)
    good = F.count_if(relevant & (F.col("n_ok") == F.col("n_rows")))
    return by_column.groupBy(*keys).agg(
        checked.alias("n_checked"),
        good.alias("n_passed"),
        F.when(checked > 0, good / checked * 100).otherwise(100.0).alias(name),
    )


def masking_compliance(secure: DataFrame, truth: dict[str, str], role: str) -> DataFrame:
    """Percentage of columns to mask that are masked as ruled in every row."""
    return _rate(compliance_by_column(secure, truth, role), True, "masking_compliance")


def no_over_masking(secure: DataFrame, truth: dict[str, str], role: str) -> DataFrame:
    """Percentage of columns to leave clear that are untouched in every row."""
    return _rate(compliance_by_column(secure, truth, role), False, "no_over_masking")


def compliance_rates(by_role: DataFrame) -> DataFrame:
    """Masking compliance per role, from :func:`compliance_by_role`."""
    return _rate(by_role, True, "masking_compliance", ("role_name",))


def over_masking_rates(by_role: DataFrame) -> DataFrame:
    """No over-masking per role, from :func:`compliance_by_role`."""
    return _rate(by_role, False, "no_over_masking", ("role_name",))


def _trimmed_sums(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: count and sum of the durations without the slowest run.

    The slowest run is taken off the sum, so no group is sorted or held in one
    task; decimal sums keep the subtraction exact. A lone run is kept.
    """
    duration = F.col("duration").cast(LATENCY_TYPE)
    many = F.count(duration) > 1
    return runs.groupBy(*keys).agg(
        F.when(many, F.sum(duration) - F.max(duration)).otherwise(F.sum(duration)).alias("total"),
        F.when(many, F.count(duration) - 1).otherwise(F.count(duration)).alias("n_runs"),
    )


def trimmed_latency(runs: DataFrame) -> DataFrame:
    """Mean duration per role without its slowest run, and over all roles.

    ``runs`` has ``role_name`` and ``duration``; the pooled row has a null role.
    """
    per_role = _trimmed_sums(runs, ["role_name"])
    mean = F.sum("total").cast("double") / F.sum("n_runs")
    return per_role.groupingSets([["role_name"], []], "role_name").agg(
        F.sum("n_runs").alias("n_runs"), mean.alias("mean_duration")
    )


def overhead_pct(secure_runs: DataFrame, normal_runs: DataFrame) -> DataFrame:
    """Overhead in percent of the secure over the normal mean; 0 when that is 0."""
    plain = _trimmed_sums(normal_runs.withColumn("_all", F.lit(1)), ["_all"]).select(
        F.lit(None).cast("string").alias("role_name"), F.lit(None).cast("bigint").alias("n_runs"),
        F.lit(None).cast("double").alias("mean_duration"),
        (F.col("total").cast("double") / F.col("n_runs")).alias("_normal"),
    )
    normal, secure = F.col("normal_duration"), F.col("mean_duration")
    # One row per role and one for the plain runs: the plain mean is spread over them without a join.
    both = trimmed_latency(secure_runs).withColumn("_normal", F.lit(None).cast("double")).unionByName(plain)
    joined = both.withColumn("normal_duration", F.max("_normal").over(Window.partitionBy())).filter("n_runs is not null")
    return joined.select(
        "role_name", "n_runs", "mean_duration", "normal_duration",
        F.when(normal > 0, (secure - normal) / normal * 100).otherwise(0.0).alias("overhead_pct"),
    )


def mean_latency(runs: DataFrame) -> DataFrame:
    """Plain mean duration per role and, with a null role, over all runs."""
    duration = F.col("duration").cast(LATENCY_TYPE)
    return runs.groupingSets([["role_name"], []], "role_name").agg(
        F.count(duration).alias("n_runs"),
        (F.sum(duration).cast("double") / F.count(duration)).alias("mean_duration"),
    )


def regex_expectations(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Columns whose format verdict breaks an expectation.

    ``expected`` has ``table_name, column_name, sensitivity_tag, regex_status,
    expected_regex_score``. Expected columns without a result are violations.
    """
    wanted = expected.select(
        "table_name", "column_name", "sensitivity_tag", "expected_regex_score",
        F.col("regex_status").alias("expected_status"),
    )
    tag = F.col("sensitivity_tag")
    score = F.coalesce(F.col("raw_scores")[tag], F.lit(0.0))
    status_ok = F.col("regex_status") == F.col("expected_status")
    tag_ok = (F.col("expected_status") != V.SUCCESS) | F.array_contains("regex_candidates", tag)
    problem = (
        F.when(F.col("regex_status").isNull(), "missing")
        .when(~status_ok, "status")
        .when(score < F.col("expected_regex_score"), "score")
        .when(~tag_ok, "candidate")
    )
    found = results.select("table_name", "column_name", "regex_status", "regex_candidates", "raw_scores")
    joined = wanted.join(found, ["table_name", "column_name"], "left")
    return joined.select("table_name", "column_name", problem.alias("problem")).filter("problem is not null")


def model_expectations(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """HYBRID and LLM columns whose answer is missing or differs from the truth."""
    asked = expected.filter(F.col("detection_method").isin(V.METHOD_HYBRID, V.METHOD_LLM))
    found = answers.select("table_name", "column_name", "suggested_tag", "is_pii")
    tag = F.col("sensitivity_tag")
    problem = (
        F.when(F.col("suggested_tag").isNull(), "missing")
        .when(F.col("suggested_tag") != tag, "tag")
        .when(F.col("is_pii") != (tag != V.NONE_TAG), "is_pii")
    )
    joined = asked.join(found, ["table_name", "column_name"], "left")
    return joined.select("table_name", "column_name", problem.alias("problem")).filter("problem is not null")


def request_coverage(requests: DataFrame, n_columns: int) -> DataFrame:
    """Do both groups of a request together hold all configured columns?"""
    return requests.select(
        "table_name", (F.col("n_determined") + F.col("n_undetermined") == n_columns).alias("is_complete")
    )


def readable(df: DataFrame) -> bool:
    """A first row exists."""
    return not df.isEmpty()


def targets_frame(spark) -> DataFrame:
    rows = [(m, target, direction) for m, (target, direction) in V.SLA_TARGETS.items()]
    return local_frame(spark, rows, "metric string, target double, direction string")


def sla_check(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, value, target, direction, passed) for every metric with a target."""
    value, target = F.col("value"), F.col("target")
    tests = {">=": value >= target, "<": value < target, "<=": value <= target, ">": value > target}
    passed = reduce(lambda chain, t: chain.when(F.col("direction") == t, tests[t]), tests, F)
    return metrics.join(targets, "metric").select("metric", "value", "target", "direction", passed.alias("passed"))
