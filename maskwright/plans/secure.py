"""The secure read: masked frames by role."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from maskwright import vocab as V
from maskwright.functions.names import names_by_fold, own_names
from maskwright.operators.masking import mask_frame
from maskwright.sources.store import MetadataStore
from maskwright.sources.tables import read_table, resolve_fqn

logger = logging.getLogger(__name__)


def secure_frame(df: DataFrame, policies: DataFrame, unknown: str | None = None, strict: bool = False) -> DataFrame:
    """Mask ``df`` by resolved policies of its table.

    Building the projection fetches one row per schema column, never data.
    """
    rules = {r.column_name: r.masking_rule for r in policies.select("column_name", "masking_rule").collect()}
    return mask_frame(df, rules, unknown, strict)


def _settle(spark: SparkSession, found: list[tuple], columns: list[str]) -> list[tuple]:
    """(table, column, level, rule) of one table under the schema's own names.

    A column of a level above NONE without a rule raises."""
    rows = []
    for table, column, level, rule in found:
        if level == V.NONE_LEVEL and not rule:
            continue
        if not rule:
            raise ValueError(f"Level {level} of column {column} has no rule for this role")
        rows.append((table, column, level, rule))
    names_by_fold(spark, [row[1] for row in rows])
    own = own_names(spark, columns, [row[1] for row in rows])
    return [(t, name, level, rule) for (t, _, level, rule), name in zip(rows, own)]


def _accesses(columns: list[str], settled: list[tuple]) -> list[tuple[str, str, str]]:
    """(column, action, level) of every column read, in schema order."""
    known = {column: (rule, level) for _, column, level, rule in settled}
    return [(c, *known.get(c, ("NONE", V.NONE_LEVEL))) for c in columns]


def _role_name(role: str) -> str:
    name = str(getattr(role, "value", role))
    if name not in V.ROLES:
        raise ValueError(f"Unknown role: {role}")
    return name


def secure_read(
    store: MetadataStore,
    role: str,
    table: str,
    columns: list[str] | None = None,
    database: str = "default",
    catalog: str | None = None,
    unknown: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """The table as ``role`` may see it; lazy, and audited before it is returned.

    Policies are looked up now and are fixed in the returned frame. A failing
    lookup or audit raises: data is never handed out unmasked or unrecorded.
    Filters the caller adds apply to the masked values.
    """
    name = _role_name(role)
    clean = table.strip().lower()
    df = read_table(store.spark, resolve_fqn(clean, database, catalog), columns)
    settled = _settle(store.spark, store.policies_of(name, clean, df.columns), df.columns)
    masked = mask_frame(df, {column: rule for _, column, _, rule in settled}, unknown, strict)
    store.log_access(name, {clean: _accesses(df.columns, settled)})
    return masked


def secure_read_all(
    store: MetadataStore,
    role: str,
    database: str | None = None,
    catalog: str | None = None,
    unknown: str | None = None,
    strict: bool = False,
) -> dict[str, DataFrame]:
    """Every registered table with all its columns, by table name.

    The policies of all tables are looked up in one job and all reads are audited in one append, however many tables
    there are; if either fails, it raises. Each table is read from where it was registered, unless a database is given;
    one that cannot be read is logged and left out.
    """
    name = _role_name(role)
    policies: dict[str, list[tuple]] = {}
    for row in store.policies_of_all(name).collect():
        policies.setdefault(row.table_name, []).append(tuple(row))
    frames, reads = {}, {}
    for table, path in sorted(store.table_paths().items()):
        namespace = database or path.rpartition(".")[0]
        try:
            df = read_table(store.spark, resolve_fqn(table, namespace, catalog if database else None))
            columns = df.columns
        except PySparkException:
            logger.exception("Could not read table %s", table)
            continue
        settled = _settle(store.spark, policies.get(table, []), columns)
        frames[table] = mask_frame(df, {column: rule for _, column, _, rule in settled}, unknown, strict)
        reads[table] = _accesses(columns, settled)
    if reads:
        store.log_access(name, reads)
    return frames


def read_for_role(
    store: MetadataStore, role: str, table: str = "", columns: list[str] | None = None, **options
) -> list[DataFrame]:
    """One entry point for both: an empty table name reads all tables."""
    if table and table.strip():
        return [secure_read(store, role, table, columns, **options)]
    return list(secure_read_all(store, role, **options).values())
