"""Catalog tables: names, listing, reading, overwriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.functions.masking import column_ref
from maskwright.functions.names import own_names


def resolve_fqn(table: str, database: str, catalog: str | None = None) -> str:
    """``[catalog.]database.table`` with a lower-case table name."""
    parts = [p for p in (catalog, database, table.strip().lower()) if p]
    return ".".join(parts)


def list_tables(spark: SparkSession, database: str) -> list[str]:
    return sorted(t.name.lower() for t in spark.catalog.listTables(database) if not t.isTemporary)


def write_table(df: DataFrame, fqn: str, provider: str = "parquet") -> None:
    """Create the namespace if absent, then overwrite the whole table."""
    namespace = fqn.rsplit(".", 1)[0]
    df.sparkSession.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")
    df.write.format(provider).mode("overwrite").saveAsTable(fqn)


def read_table(spark: SparkSession, fqn: str, columns: list[str] | None = None) -> DataFrame:
    """The requested columns of a table, or all of them, under the names of its schema."""
    df = spark.table(fqn)
    if not columns or list(columns) == ["*"]:
        return df
    return df.select(*[column_ref(c) for c in own_names(spark, df.columns, columns)])
