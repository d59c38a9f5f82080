"""Column derivations shared by the Spark queries and their SQL twins.

The given tables hold little personal data in the matched formats, so columns
with known shares of it are derived from the keys of whole tables, with
arithmetic that both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PII_COLUMNS = (
    "k", "cccd_clean", "cccd_noise_70", "phone_clean", "email_clean", "e8_n_65", "health_insurance_id_clean",
    "c03", "o_text", "m_val", "info", "sys_record_id", "is_active", "tx_amount", "email_sparse", "contact",
    "empty_col", "grp",
)

_PII = """
SELECT {K} AS k,
  '0' || lpad(cast(({K}*7919+13) % 100000000000 AS {S}), 11, '0') AS cccd_clean,
  CASE WHEN {K} % 10 < 7 THEN '0' || lpad(cast(({K}*7919+13) % 100000000000 AS {S}), 11, '0')
       ELSE 'NOISE-' || cast({K} AS {S}) END AS cccd_noise_70,
  '09' || lpad(cast(({K}*104729+7) % 100000000 AS {S}), 8, '0') AS phone_clean,
  'user' || cast({K} AS {S}) || '@example.com' AS email_clean,
  CASE WHEN {K} % 20 < 13 THEN 'user' || cast({K} AS {S}) || '@example.com'
       ELSE 'NOISE-' || cast({K} AS {S}) END AS e8_n_65,
  'DN' || lpad(cast(({K}*15485863+11) % 10000000000000 AS {S}), 13, '0') AS health_insurance_id_clean,
  CASE {K} % 4 WHEN 0 THEN 'Nguyễn' WHEN 1 THEN 'Trần' WHEN 2 THEN 'Lê' ELSE 'Phạm' END
       || CASE {K} % 3 WHEN 0 THEN ' Văn ' WHEN 1 THEN ' Thị ' ELSE ' Minh ' END
       || CASE {K} % 7 WHEN 0 THEN 'An' WHEN 1 THEN 'Mai' WHEN 2 THEN 'Long' WHEN 3 THEN 'Lan'
       WHEN 4 THEN 'Hòa' WHEN 5 THEN 'Bình' ELSE 'Quỳnh' END AS c03,
  cast(1 + {K} % 500 AS {S}) || ' Lê Lợi, Phường Bến Nghé, Quận 1, TP. Hồ Chí Minh' AS o_text,
  cast((5 + {K} % 96) * 500000 AS {S}) AS m_val,
  cast(1960 + {K} % 44 AS {S}) || '-' || lpad(cast(1 + {K} % 12 AS {S}), 2, '0')
       || '-' || lpad(cast(1 + {K} % 28 AS {S}), 2, '0') AS info,
  'SYS-' || lpad(cast({K} % 1000000 AS {S}), 6, '0') AS sys_record_id,
  CASE WHEN {K} % 2 = 0 THEN 'true' ELSE 'false' END AS is_active,
  CASE {K} % 5 WHEN 0 THEN '50000' WHEN 1 THEN '200000' WHEN 2 THEN '1000000'
       WHEN 3 THEN '20000000' ELSE '100000000' END AS tx_amount,
  CASE WHEN {K} % 5 = 0 THEN NULL WHEN {K} % 5 = 1 THEN ''
       ELSE 'user' || cast({K} AS {S}) || '@example.com' END AS email_sparse,
  CASE WHEN {K} % 10 < 4 THEN ' 09' || lpad(cast({K} % 100000000 AS {S}), 8, '0') || chr(9)
       WHEN {K} % 10 < 7 THEN 'u' || cast({K} AS {S}) || '@mail.example.org'
       WHEN {K} % 10 < 9 THEN '0' || lpad(cast({K} AS {S}), 11, '0')
       ELSE 'call ' || cast({K} AS {S}) END AS contact,
  cast(NULL AS {S}) AS empty_col,
  {G} AS grp
FROM {T}
"""

# Values at the edges of the masks, mixed by key.
_EDGES = """
SELECT {K} AS k, {G} AS grp,
  CASE {K} % 14 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '12345' WHEN 3 THEN '123456'
       WHEN 4 THEN '1234567' WHEN 5 THEN 'a' || cast({K} AS {S}) || '@b' || cast({K} AS {S}) || '@c'
       WHEN 6 THEN '@x' || cast({K} AS {S}) WHEN 7 THEN 'x@' WHEN 8 THEN 'ab@c d.com'
       WHEN 9 THEN 'Nguyễn Văn ' || cast({K} AS {S}) WHEN 10 THEN '  '
       WHEN 11 THEN lpad(cast({K} AS {S}), 12, '0') WHEN 12 THEN 'x' || chr(9) || cast({K} AS {S}) || ' tab'
       ELSE ' 09' || lpad(cast({K} % 100000000 AS {S}), 8, '0') || chr(9) END AS v
FROM {T}
"""

_SOURCES = {
    "orders": ("o_orderkey", "o_orderpriority"),
    "customer": ("c_custkey", "c_mktsegment"),
}


def view_sql(template: str, table: str, text_type: str = "VARCHAR") -> str:
    key, group = _SOURCES[table]
    return template.format(K=key, G=group, T=table, S=text_type).strip()


def pii_sql(table: str) -> str:
    return view_sql(_PII, table)


def edges_sql(table: str) -> str:
    return view_sql(_EDGES, table)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _derive(spark: SparkSession, sf_dir: str, template: str, table: str) -> DataFrame:
    source = load(spark, sf_dir, table)
    select = view_sql(template, table, "STRING").removesuffix(f"FROM {table}") + "FROM {source}"
    return spark.sql(select, source=source)


def pii_view(spark: SparkSession, sf_dir: str, table: str = "orders") -> DataFrame:
    """The derived table."""
    return _derive(spark, sf_dir, _PII, table)


def edges_view(spark: SparkSession, sf_dir: str, table: str = "orders") -> DataFrame:
    return _derive(spark, sf_dir, _EDGES, table)
