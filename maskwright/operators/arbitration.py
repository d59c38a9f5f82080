"""Final verdict per column from the format verdict and the second opinion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions.text import reason_suffix
from maskwright.operators.keyed import one_per_key
from maskwright.operators.semantic import ANSWER_COLUMNS

NO_ANSWER = "no answer"
VERDICT_COLUMNS = ("table_name", "ordinal", "column_name", "is_pii", "sensitivity_tag", "sensitivity_level",
                   "confidence_score", "detection_method", "reason")


def with_answers(scored: DataFrame, answers: DataFrame) -> DataFrame:
    """Attach replies (``is_pii, suggested_tag, ...``) to their columns.

    Of several answers for a column the last in reply order (``position``) counts."""
    if "position" in answers.columns:
        answers = one_per_key(answers, ["table_name", "column_name"], F.col("position"))
    else:
        answers = one_per_key(answers, ["table_name", "column_name"], F.struct(*[c for c in answers.columns]))
    renamed = answers.select(
        "table_name",
        "column_name",
        F.col("is_pii").alias("model_is_pii"),
        F.col("suggested_tag").alias("model_tag"),
        F.col("sensitivity_level").alias("model_level"),
        F.col("confidence_score").alias("model_confidence"),
        F.col("reason").alias("model_reason"),
    )
    return scored.drop(*ANSWER_COLUMNS).join(renamed, ["table_name", "column_name"], "left")


def arbitrate(answered: DataFrame) -> DataFrame:
    """One verdict row per column; see the decision table in the README.

    A column the second opinion left out counts as "not PII" with confidence 0.
    """
    pii = F.coalesce("model_is_pii", F.lit(False))
    model_tag = F.coalesce("model_tag", F.lit(V.NONE_TAG))
    confidence = F.coalesce("model_confidence", F.lit(0.0))
    candidate = F.coalesce(F.try_element_at("regex_candidates", F.lit(1)), F.lit(V.NONE_TAG))
    score = F.coalesce(F.col("raw_scores")[candidate], F.lit(0.0))

    def verdict(is_pii, tag, value, method, text):
        return F.struct(
            F.lit(is_pii).alias("is_pii"),
            tag.alias("tag"),
            value.cast("double").alias("score"),
            F.lit(method).alias("method"),
            F.lit(text).alias("text"),
        )

    none = F.lit(V.NONE_TAG)
    decision = (
        F.when(F.col("regex_status") == V.SUCCESS, verdict(True, candidate, score, V.METHOD_REGEX, V.REASON_REGEX))
        .when((candidate != none) & ~pii,
              verdict(False, none, confidence, V.METHOD_HYBRID, V.REASON_AMBIGUOUS_NONE))
        .when(candidate != none, verdict(True, candidate, score, V.METHOD_HYBRID, V.REASON_AMBIGUOUS_PII))
        .when(pii & (model_tag != none), verdict(True, model_tag, confidence, V.METHOD_LLM, V.REASON_LLM))
        .otherwise(verdict(False, none, F.lit(1.0), V.METHOD_HYBRID, V.REASON_FULLY_NONE))
    )
    model_reason = F.when(
        F.col("regex_status") == V.UNDETERMINED,
        F.concat(F.lit(" - LLM reason: "), F.coalesce("model_reason", F.lit(NO_ANSWER))),
    ).otherwise(F.lit(""))
    return answered.withColumn("_v", decision).select(
        "table_name",
        "ordinal",
        "column_name",
        F.col("_v.is_pii").alias("is_pii"),
        F.col("_v.tag").alias("sensitivity_tag"),
        V.level_of(F.col("_v.tag")).alias("sensitivity_level"),
        F.col("_v.score").alias("confidence_score"),
        F.col("_v.method").alias("detection_method"),
        F.concat(F.col("_v.text"), reason_suffix(F.col("all_detected_tags")), model_reason).alias("reason"),
    )
