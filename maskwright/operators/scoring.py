"""Tag counts, scores and the format-based verdict per column.

An exact profile is a wide aggregate: the tag of every cell of a row is one expression of a projection, and counts of
it are sums without a key. Rows are never multiplied, and a task hands over one row. Columns are taken a few at a time,
so that the code generated for them stays small enough to be compiled; column stores read each column once either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions.masking import quoted
from maskwright.functions.matching import value_tag
from maskwright.operators.sampling import all_columns, list_columns, non_blank
from maskwright.sources.local import local_frame

COUNTED_TAGS = V.STRICT_TAGS + V.SEMANTIC_TAGS

#: Dates of birth up to the year that half of a column of birth dates must reach back to.
EARLY_DATES = "n_early_dates"
#: Which of 64 places the hashes of names and addresses fall on, as bits: a linear counter of different values.
TEXT_BITS = "text_bits"

#: Columns of one aggregate. HotSpot compiles methods of up to 8000 bytes of byte code, and a column takes 1700.
CHUNK_COLUMNS = 4


def count_column(tag: str) -> str:
    return f"n_{tag.lower()}"


def _cell(value: str) -> dict[str, Column]:
    """The tag of a non-blank value (a dash for none; null if blank), and what the sketches take from it."""
    tag = F.when(F.trim(value) != "", F.coalesce(value_tag(F.col(value)), F.lit("-")))
    return {"tag": tag, "value": F.col(value)}


def _counts(tag: str, value: str) -> list[Column]:
    """Aggregates over the cells of one column; all of them merge, and none needs more than a number a task."""
    return [
        F.count(tag).alias("n_values"),
        *[F.expr(f"count_if({tag} = '{t}') AS {count_column(t)}") for t in COUNTED_TAGS],
        F.expr(f"count_if({tag} = 'DOB' AND {value} RLIKE r'{V.EARLY_YEAR_PATTERN}') AS {EARLY_DATES}"),
        F.expr(f"coalesce(bit_or(if({tag} IN ('NAME', 'ADDRESS'), shiftleft(1L, cast(xxhash64({value}) & 63 AS int)), NULL)), 0L)"
               f" AS {TEXT_BITS}"),
    ]


COUNT_NAMES = ("n_values", *map(count_column, COUNTED_TAGS), EARLY_DATES, TEXT_BITS)


def tag_counts(long: DataFrame) -> DataFrame:
    """:data:`COUNT_NAMES` per ordinal of (ordinal, value) rows, such as a sample's."""
    cells = non_blank(long).select("ordinal", *[c.alias(name) for name, c in _cell("value").items()])
    return cells.groupBy("ordinal").agg(*_counts("tag", "value"))


def chunk_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: an array with :data:`COUNT_NAMES` of each of ``columns``, from one pass over them."""
    texts = df.select(*[F.expr(f"CAST({quoted(c)} AS STRING) AS v{i}") for i, c in enumerate(columns)])
    cells = texts.select(*[c.alias(f"{name}{i}") for i in range(len(columns)) for name, c in _cell(f"v{i}").items()])
    counted = cells.agg(*[c.alias(f"{name}_{i}") for i in range(len(columns))
                          for name, c in zip(COUNT_NAMES, _counts(f"tag{i}", f"value{i}"))])
    return counted.select(F.array(*[F.struct(*[F.col(f"{n}_{i}").alias(n) for n in COUNT_NAMES]) for i in range(len(columns))]).alias("_found"))


def _wide_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name) and the counts of every column, from wide aggregates alone."""
    parts, rows = [], []
    for table, df in frames.items():
        columns = list_columns(df)
        for start in range(0, len(columns), CHUNK_COLUMNS):
            chunk = columns[start:start + CHUNK_COLUMNS]
            parts.append(chunk_counts(df, chunk).select(F.lit(len(parts)).alias("_chunk"), "_found"))
            rows += [(table, start + i, c, len(parts) - 1, i) for i, c in enumerate(chunk)]
    spark = next(iter(frames.values())).sparkSession
    schema = "table_name string, ordinal int, column_name string, _chunk int, _place int"
    named = local_frame(spark, rows, schema).join(reduce(DataFrame.unionByName, parts), "_chunk")
    return named.withColumn("_cell", F.get("_found", "_place")).select("table_name", "ordinal", "column_name", "_cell.*")


def _long_counts(frames: dict[str, DataFrame], values: dict[str, DataFrame]) -> DataFrame:
    counts = reduce(DataFrame.unionByName, [
        tag_counts(values[table]).withColumn("table_name", F.lit(table)) for table in frames
    ])
    counts = counts.withColumn("ordinal", F.col("ordinal").cast("int"))
    return all_columns(frames).join(counts, ["table_name", "ordinal"], "left").select(
        "table_name", "ordinal", "column_name", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in COUNT_NAMES])


def profile_tables(frames: dict[str, DataFrame], values: dict[str, DataFrame] | None = None) -> DataFrame:
    """Tag counts of every column of every table, as one plan.

    Exact, or of the (ordinal, value) rows in ``values``. Each table is reduced
    to one row per column next to its own scan; only those rows are brought
    together. Columns without any non-blank value are kept with zero counts.
    """
    values = values or {}
    parts = []
    exact = {t: df for t, df in frames.items() if t not in values}
    drawn = {t: df for t, df in frames.items() if t in values}
    if exact:
        parts.append(_wide_counts(exact))
    if drawn:
        parts.append(_long_counts(drawn, values))
    return reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, table: str) -> DataFrame:
    """Exact tag counts of every column of one table."""
    return profile_tables({table: df})


def share(tag: str) -> str:
    """SQL text: share of a column's values with ``tag``; 0 for an empty column."""
    return f"if(n_values > 0, {count_column(tag)} / n_values, 0D)"


def detected_tags() -> Column:
    """Strict tags with a score above zero, in detection order."""
    scored = ", ".join(f"named_struct('tag', '{t}', 'score', {share(t)})" for t in V.STRICT_TAGS)
    return F.expr(f"filter(array({scored}), s -> s.score > 0)")


def tag_scores(counts: DataFrame) -> DataFrame:
    """Add ``all_detected_tags`` (ordered list) and ``raw_scores`` (map)."""
    scored = counts.withColumn("all_detected_tags", detected_tags())
    return scored.withColumn("raw_scores", F.map_from_entries("all_detected_tags"))


def regex_verdict(scored: DataFrame, threshold: float = V.DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``regex_status`` and ``regex_candidates``.

    SUCCESS when a tag reaches the threshold: the best one by score, then
    severity, is the only candidate. UNDETERMINED otherwise: all detected tags,
    best score first, ties in detection order.
    """
    detected = F.col("all_detected_tags")
    passing = F.transform(
        F.filter(detected, lambda s: s["score"] >= threshold),
        lambda s: F.struct(s["score"].alias("score"), V.weight_of(s["tag"]).alias("weight"), s["tag"].alias("tag")),
    )
    ranked = F.array_sort(
        F.transform(detected, lambda s, i: F.struct((-s["score"]).alias("rank"), i.alias("position"),
                                                    s["tag"].alias("tag")))
    )
    success = F.size(passing) > 0
    return scored.withColumn(
        "regex_status", F.when(success, V.SUCCESS).otherwise(V.UNDETERMINED)
    ).withColumn(
        "regex_candidates",
        F.when(success, F.array(F.array_max(passing)["tag"])).otherwise(F.transform(ranked, lambda r: r["tag"])),
    )


def split_by_status(results: DataFrame) -> DataFrame:
    """Per table: the determined and the undetermined columns, in schema order.

    A table's lists are bounded by its schema width.
    """
    determined = F.col("regex_status") == V.SUCCESS
    column = F.struct("ordinal", "column_name")

    def names(condition: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(condition, column))), lambda c: c["column_name"])

    return results.groupBy("table_name").agg(
        names(determined).alias("determined_columns"), names(~determined).alias("undetermined_columns")
    )
