"""Sampling and the long (column, value) form that every profile starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions.masking import column_ref, quoted
from maskwright.functions.matching import is_email, is_health_insurance_id, is_phone, is_resident_id
from maskwright.sources.local import local_frame

DEFAULT_SEED = 42
_DRAW = "_draw"


def list_columns(df: DataFrame) -> list[str]:
    """Column names in schema order."""
    return [field.name for field in df.schema.fields]


def draw_key(key: list[str] | None, seed: int) -> Column:
    """A pseudo-random hex text per row, made from its key columns or, without them, from a seeded random number.

    Never from the whole row: equal rows must be drawn one by one."""
    if not key:
        return F.md5(F.rand(seed).cast("string"))
    parts = [F.coalesce(column_ref(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def draw_limit(fraction: float) -> str:
    """Upper bound on the first sixteen hex digits that keeps about ``fraction``."""
    return "g" if fraction >= 1.0 else f"{int(fraction * 2**64):016x}"


def bounded_sample(
    df: DataFrame,
    n: int,
    key: list[str] | None = None,
    seed: int = DEFAULT_SEED,
    row_count: int | None = None,
) -> DataFrame:
    """At most ``3n`` rows, drawn with fraction ``min(5n / rows, 1)``.

    Rows whose draw falls below the fraction, the ``3n`` smallest of them: about
    ``5n`` rows pass the filter on the whole cluster, so the ordered limit that
    follows stays small. With ``key`` (columns that identify a row) the draw
    depends on the data alone; without, on a seeded random number, repeatable for
    one file layout. Every part of the table is drawn from alike. An empty table
    gives an empty sample.
    """
    return _drawn(df, n, key, seed, row_count).drop(_DRAW)


def _drawn(df: DataFrame, n: int, key: list[str] | None, seed: int, row_count: int | None) -> DataFrame:
    """The sample with its draws."""
    if row_count is None:
        row_count = df.count()
    fraction = min(5 * n / row_count, 1.0) if row_count else 1.0
    drawn = df.withColumn(_DRAW, draw_key(key, seed))
    if fraction < 1.0:
        drawn = drawn.filter(F.col(_DRAW) < draw_limit(fraction))
    return drawn.orderBy(_DRAW).limit(3 * n)


def to_long(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(ordinal, value): every column as text, one row per cell.

    ``ordinal`` is the position in the schema, as text; names are attached after
    aggregation, so that no row carries them. ``keep`` names columns that are
    carried along instead. Spark expands the columns inside the scan stage;
    nothing is shuffled.
    """
    keep = keep or []
    columns = [c for c in list_columns(df) if c not in keep]
    ordinals = [str(i) for i in range(len(columns))]
    texts = df.selectExpr(
        *[quoted(k) for k in keep],
        *[f"CAST({quoted(c)} AS STRING) AS `{i}`" for c, i in zip(columns, ordinals)],
    )
    return texts.unpivot(keep, ordinals, "ordinal", "value")


def all_columns(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name): one row per schema column."""
    rows = [(table, i, c) for table, df in frames.items() for i, c in enumerate(list_columns(df))]
    spark = next(iter(frames.values())).sparkSession
    return local_frame(spark, rows, "table_name string, ordinal int, column_name string")


def columns_frame(df: DataFrame, table: str) -> DataFrame:
    """:func:`all_columns` of one table."""
    return all_columns({table: df})


def with_names(by_ordinal: DataFrame, df: DataFrame, table: str, how: str = "left") -> DataFrame:
    """Attach table and column names to rows keyed by ``ordinal``.

    With ``how='left'`` schema columns without any row are kept.
    """
    numbered = by_ordinal.withColumn("ordinal", F.col("ordinal").cast("int"))
    return columns_frame(df, table).join(numbered, "ordinal", how).select(
        "table_name", "ordinal", "column_name", *[c for c in by_ordinal.columns if c != "ordinal"]
    )


def non_blank(long: DataFrame) -> DataFrame:
    """Rows whose value is neither null nor made of spaces alone."""
    return long.filter(F.trim("value") != "")


def _ranked_values(df: DataFrame, n: int, key: list[str] | None, seed: int, row_count: int) -> DataFrame:
    """(ordinal, value, rank): the first ``n`` non-blank values of the sample."""
    long = non_blank(to_long(_drawn(df, n, key, seed, row_count), keep=[_DRAW]))
    first = Window.partitionBy("ordinal").orderBy(_DRAW)
    return long.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n).drop(_DRAW)


def sampled_values(
    df: DataFrame,
    n: int,
    key: list[str] | None = None,
    seed: int = DEFAULT_SEED,
    row_count: int | None = None,
) -> DataFrame:
    """(ordinal, value): up to ``n`` non-blank values per column, in one job.

    The values come from one bounded sample and are ranked in draw order.
    """
    if row_count is None:
        row_count = df.count()
    return _ranked_values(df, n, key, seed, row_count).drop("rank")


def column_values(
    df: DataFrame, table: str, n: int, key: list[str] | None = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    """:func:`sampled_values` with table and column names."""
    return with_names(sampled_values(df, n, key, seed), df, table, how="inner")


def column_sample_lists(
    df: DataFrame,
    table: str,
    n: int = V.DEFAULT_SAMPLE_SIZE,
    m: int = V.DEFAULT_MODEL_SAMPLE_SIZE,
    key: list[str] | None = None,
    seed: int = DEFAULT_SEED,
    row_count: int | None = None,
) -> DataFrame:
    """One row per column: its list of ``n`` samples and the first ``m`` of them.

    A column without any value keeps its row, with empty lists.
    """
    if row_count is None:
        row_count = df.count()
    ranked = _ranked_values(df, n, key, seed, row_count)
    in_order = F.sort_array(F.collect_list(F.struct("rank", "value")))
    lists = ranked.groupBy("ordinal").agg(F.transform(in_order, lambda s: s["value"]).alias("sample_data"))
    samples = F.coalesce("sample_data", F.array().cast("array<string>"))
    return with_names(lists, df, table).select(
        "table_name", "ordinal", "column_name",
        samples.alias("sample_data"), F.slice(samples, 1, m).alias("model_sample"),
    )


_DETECTORS = {
    "RESIDENT_ID": is_resident_id,
    "PHONE": is_phone,
    "EMAIL": is_email,
    "HEALTH_INSURANCE_ID": is_health_insurance_id,
}


def stratified_sample(
    df: DataFrame,
    column: str,
    n: int,
    tag: str | None = None,
    threshold: float = V.DEFAULT_THRESHOLD,
    key: list[str] | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``int(n * threshold)`` values that carry ``tag`` and the rest that do not.

    Each share is capped by what is there. Without a strict ``tag`` it is a
    plain draw of ``n`` values. Both draws are ordered limits, so each task
    hands over at most its own few best rows.
    """
    value = column_ref(column).cast("string")
    order = draw_key(key, seed)
    values = df.select(value.alias("value"), order.alias(_DRAW)).filter(F.trim("value") != "")
    if tag not in _DETECTORS:
        return values.orderBy(_DRAW).limit(n).select("value", F.lit(None).cast("boolean").alias("is_match"))
    valid = int(n * threshold)
    flagged = values.withColumn("is_match", _DETECTORS[tag](F.col("value")))
    matching = flagged.filter("is_match").orderBy(_DRAW).limit(valid)
    others = flagged.filter("not is_match").orderBy(_DRAW).limit(n - valid)
    return matching.unionByName(others).orderBy(_DRAW).select("value", "is_match")
