"""The governance scan: from tables to stored column verdicts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from maskwright import vocab as V
from maskwright.operators.arbitration import arbitrate, with_answers
from maskwright.operators.exchange import build_requests, decode_responses, score_with
from maskwright.operators.sampling import DEFAULT_SEED, column_sample_lists, sampled_values
from maskwright.operators.scoring import profile_tables, regex_verdict, tag_scores
from maskwright.operators.semantic import semantic_answer
from maskwright.sources.store import MetadataStore, cut_lineage
from maskwright.sources.tables import list_tables, read_table, resolve_fqn


def score_tables(
    frames: dict[str, DataFrame],
    sample_size: int | None = V.DEFAULT_SAMPLE_SIZE,
    threshold: float = V.DEFAULT_THRESHOLD,
    keys: dict[str, list[str]] | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Format verdict of every column, from a sample or (``None``) all values.

    ``keys`` names the columns that identify a row of a table; with them the
    sample depends on the data alone.
    """
    keys = keys or {}
    values = None
    if sample_size is not None:
        values = {t: sampled_values(df, sample_size, keys.get(t), seed) for t, df in frames.items()}
    return regex_verdict(tag_scores(profile_tables(frames, values)), threshold)


def column_scores(df: DataFrame, table: str, key: list[str] | None = None, **options) -> DataFrame:
    """:func:`score_tables` for one table."""
    return score_tables({table: df}, keys={table: key} if key else None, **options)


def table_verdicts(frames: dict[str, DataFrame], **options) -> DataFrame:
    """Final verdict of every column with the built-in second scanner.

    One aggregation per table feeds both scanners, so nothing is read twice and
    the verdicts need no join between them.
    """
    return arbitrate(semantic_answer(score_tables(frames, **options)))


def column_verdicts(df: DataFrame, table: str, key: list[str] | None = None, **options) -> DataFrame:
    """:func:`table_verdicts` for one table."""
    return table_verdicts({table: df}, keys={table: key} if key else None, **options)


def scorer_verdicts(
    frames: dict[str, DataFrame],
    scorer: Callable[[str], str],
    model_sample_size: int = V.DEFAULT_MODEL_SAMPLE_SIZE,
    max_retries: int = 3,
    **options,
) -> DataFrame:
    """Final verdict of every column with a caller-supplied second scanner.

    The scorer sees one request per table. A table whose columns are all settled
    by their format is not sent. The replies are stored before they are used, so
    no retry of a task asks the scorer again.
    """
    size = options.get("sample_size") or V.DEFAULT_SAMPLE_SIZE
    seed, keys = options.get("seed", DEFAULT_SEED), options.get("keys") or {}
    scored = cut_lineage(score_tables(frames, **options))
    samples = reduce(DataFrame.unionByName, [
        column_sample_lists(df, table, size, model_sample_size, keys.get(table), seed)
        for table, df in frames.items()
    ]).select("table_name", "ordinal", "model_sample")
    requests = build_requests(scored.join(samples, ["table_name", "ordinal"]))
    replies = cut_lineage(score_with(requests, scorer, max_retries))
    return arbitrate(with_answers(scored, decode_responses(replies, positions=True)))


def save_verdicts(store: MetadataStore, verdicts: DataFrame) -> DataFrame:
    """Store verdicts and their audit rows; returns the stored rows."""
    final = cut_lineage(verdicts)
    store.append_scan_audit(final)
    store.upsert_columns(final)
    return final


def _register(spark: SparkSession, store: MetadataStore, database: str, catalog: str | None) -> list[str]:
    names = list_tables(spark, database if catalog is None else f"{catalog}.{database}")
    paths = {name: resolve_fqn(name, database, catalog) for name in names}
    store.register_tables(paths)
    store.require_own_names(paths)
    return names


def scan_table(
    store: MetadataStore,
    table: str,
    database: str,
    catalog: str | None = None,
    scorer: Callable[[str], str] | None = None,
    **options,
) -> DataFrame:
    """Scan one table, store its verdicts and return them."""
    spark = store.spark
    _register(spark, store, database, catalog)
    name = table.strip().lower()
    store.table_id(name)
    frames = {name: read_table(spark, resolve_fqn(name, database, catalog))}
    return save_verdicts(store, _scan(frames, scorer, options))


def scan_all(
    store: MetadataStore,
    database: str,
    catalog: str | None = None,
    scorer: Callable[[str], str] | None = None,
    tables_per_job: int = 20,
    **options,
) -> list[str]:
    """Scan every table of a database; returns the names in scan order.

    Tables are scanned in groups, each as one job whose branches run side by
    side. The first failure stops the run; earlier groups stay stored.
    """
    spark = store.spark
    names = _register(spark, store, database, catalog)
    for start in range(0, len(names), tables_per_job):
        group = names[start:start + tables_per_job]
        frames = {n: read_table(spark, resolve_fqn(n, database, catalog)) for n in group}
        save_verdicts(store, _scan(frames, scorer, options))
    return names


def _scan(frames: dict[str, DataFrame], scorer: Callable[[str], str] | None, options: dict) -> DataFrame:
    return table_verdicts(frames, **options) if scorer is None else scorer_verdicts(frames, scorer, **options)
