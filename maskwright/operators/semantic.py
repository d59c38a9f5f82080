"""The second opinion: a rule-based scanner with the reply schema of a model.

The gates follow the brief a language model would get: the data decides, a
column name may only support it; no tag unless at least half of the values
match; no tag unless the confidence is above 0.7. It answers the columns the
strict formats left undetermined. The confidence is a heuristic and is measured
with the evaluation operators, not assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.operators.scoring import COUNTED_TAGS, EARLY_DATES, TEXT_BITS, share

ANSWER_COLUMNS = ("model_is_pii", "model_tag", "model_level", "model_confidence", "model_reason")


def tag_confidence(tag: str) -> str:
    """SQL text: confidence that the column carries ``tag``; 0 below the majority.

    The base value says how far the format speaks for itself; a column name that
    fits adds a fixed bonus.
    """
    base = V.SEMANTIC_BASE[tag]
    cue = f"if(lower(column_name) RLIKE r'{V.name_cue_pattern(tag)}', {V.CUE_BONUS}D, 0D)"
    known = f"{share(tag)} >= {V.MAJORITY_SHARE}"
    if tag == "DOB":  # their median year lies well before that of orders or shipments
        known += f" AND (2 * {EARLY_DATES} >= n_dob OR {cue} > 0)"
    if tag in ("NAME", "ADDRESS"):  # a category of a few labels may look like persons or places
        known += f" AND ({many_values()} OR {cue} > 0)"
    value = f"least(1D, {base}D + {1.0 - base}D * {share(tag)} + {cue})"
    return f"if({known}, round({value}, 6), 0D)"


def many_values() -> str:
    """SQL text: whether a column's names and addresses are many different ones, by the linear counter.

    ``n`` different values are expected to fill 64 * (1 - (63 / 64) ** n) of its places."""
    places = f"64D * (1D - power(63D / 64D, least({V.MANY_VALUES}D, {V.MANY_SHARE}D * n_values)))"
    return f"bit_count({TEXT_BITS}) >= {places}"


def semantic_answer(scored: DataFrame) -> DataFrame:
    """Add the answer columns; null where the format verdict is SUCCESS."""
    candidates = ", ".join(
        f"named_struct('confidence', {tag_confidence(t)}, 'weight', {V.TAGS[t][1]}, 'tag', '{t}', 'share', {share(t)})"
        for t in COUNTED_TAGS
    )
    best = F.expr(f"array_max(array({candidates}))")
    is_pii = F.col("_best.confidence") > V.CONFIDENCE_GATE
    tag = F.when(is_pii, F.col("_best.tag")).otherwise(V.NONE_TAG)
    none_confidence = F.round(F.lit(1.0) - F.col("_best.confidence"), 6)
    percent = F.floor(F.col("_best.share") * 100 + 0.5).cast("int").cast("string")
    asked = F.col("regex_status") == V.UNDETERMINED
    answer = {
        "model_is_pii": is_pii,
        "model_tag": tag,
        "model_level": V.level_of(tag),
        "model_confidence": F.when(is_pii, F.col("_best.confidence")).otherwise(none_confidence),
        "model_reason": F.when(is_pii, F.concat(percent, F.lit("% of values look like "), tag))
        .otherwise(F.lit("No tag has clear evidence in the values")),
    }
    return scored.withColumn("_best", best).select(
        "*", *[F.when(asked, value).alias(name) for name, value in answer.items()]
    ).drop("_best")


def semantic_scan(scored: DataFrame) -> DataFrame:
    """One answer row per undetermined column, in the reply schema."""
    answered = semantic_answer(scored).filter(F.col("regex_status") == V.UNDETERMINED)
    return answered.select(
        "table_name",
        "column_name",
        F.col("model_is_pii").alias("is_pii"),
        F.col("model_tag").alias("suggested_tag"),
        F.col("model_level").alias("sensitivity_level"),
        F.col("model_confidence").alias("confidence_score"),
        F.col("model_reason").alias("reason"),
    )
