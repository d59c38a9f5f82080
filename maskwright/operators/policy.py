"""Policy resolution and the access audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions.names import folding

POLICY_SCHEMA = "table_name string, column_name string, sensitivity_level string, masking_rule string"
AUDIT_SCHEMA = "user_role string, target_table string, context_details string, executed_at timestamp"


def resolve_policies(
    columns_metadata: DataFrame,
    tables_metadata: DataFrame,
    policies: DataFrame,
    role: str,
    table: str | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """(table_name, column_name, sensitivity_level, masking_rule) for a role.

    ``columns`` are compared as the session compares names. A level above NONE that
    the role has no rule for gives a null rule, which the masks refuse. The filters reach both metadata scans before the joins. No side is forced to
    be broadcast: Spark does so while its size estimate stays under the session
    limit, and shuffles on the key beyond it.
    """
    tables = tables_metadata.select("table_id", "table_name")
    found = columns_metadata.select("table_id", "column_name", "sensitivity_level")
    if table and table.strip():
        tables = tables.filter(F.col("table_name") == table.strip())
    if columns:
        fold = folding(columns_metadata.sparkSession)
        stored = F.col("column_name") if fold is str else F.lower("column_name")
        found = found.filter(stored.isin([fold(c) for c in columns]))
    rules = policies.filter(F.col("role_name") == role).select("sensitivity_level", "masking_rule")
    return (
        found.join(tables, "table_id")
        .join(rules, "sensitivity_level", "left")
        .filter((F.col("sensitivity_level") != V.NONE_LEVEL) | F.col("masking_rule").isNotNull())
        .select("table_name", "column_name", "sensitivity_level", "masking_rule")
    )


def policy_matrix(columns: DataFrame, policies: DataFrame) -> DataFrame:
    """Every schema column with its rule; none, empty or ``NONE`` is CLEAR_TEXT."""
    rule = F.col("masking_rule")
    known = rule.isNotNull() & ~rule.isin("", "NONE")
    resolved = policies.select("table_name", "column_name", "masking_rule")
    return columns.join(resolved, ["table_name", "column_name"], "left").select(
        "table_name", "ordinal", "column_name", F.when(known, rule).otherwise("CLEAR_TEXT").alias("masking_rule")
    )


def accessed_columns(columns: DataFrame, policies: DataFrame) -> DataFrame:
    """Per accessed column: the action taken, its level, and whether it masks.

    Clear text is recorded as an action but does not count as masked.
    """
    rule = F.col("masking_rule")
    action = F.when(rule.isNotNull() & (rule != ""), rule).otherwise("NONE")
    level = F.coalesce("sensitivity_level", F.lit(V.NONE_LEVEL))
    return columns.join(policies, ["table_name", "column_name"], "left").select(
        "table_name",
        "ordinal",
        "column_name",
        action.alias("action"),
        level.alias("sensitivity_level"),
        (~action.isin("NONE", "CLEAR_TEXT")).alias("is_masked"),
    )


def access_audit(columns: DataFrame, policies: DataFrame, role: str) -> DataFrame:
    """One audit row per table read, with the accessed columns as JSON.

    A row is bounded by the schema width of its table.
    """
    entry = F.struct("column_name", "action", "sensitivity_level", "is_masked")
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", entry.alias("entry"))))
    context = F.struct(
        F.transform("entries", lambda e: e["entry"]).alias("accessed_columns"),
        F.size("entries").alias("total_columns_accessed"),
    )
    return (
        accessed_columns(columns, policies)
        .groupBy("table_name")
        .agg(ordered.alias("entries"))
        .select(
            F.lit(role).alias("user_role"),
            F.col("table_name").alias("target_table"),
            F.to_json(context).alias("context_details"),
            F.current_timestamp().alias("executed_at"),
        )
    )
