"""Masking whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.masking import column_ref, mask_expr, partial_mask
from maskwright.functions.names import folding, names_by_fold

#: From so many partially masked columns on, they share one expression over an array of them. Its code is compiled
#: once instead of once a column, which is what the first rows of a wide table wait for.
SHARED_FROM = 5


def mask_column(df: DataFrame, column: str, rule) -> DataFrame:
    """Replace one column by its masked form."""
    return df.withColumn(column, mask_expr(column, rule))


def mask_frame(df: DataFrame, rules: dict[str, str], unknown: str | None = None, strict: bool = False) -> DataFrame:
    """Mask all columns in one projection, in schema order.

    Columns that ``rules`` does not name pass through, or follow ``unknown`` when
    it is given; one that it names with an empty rule raises, since clear text
    would be the wrong guess. Names are compared as the session compares them.
    Works on streaming frames as well: the masks hold no state. Select the columns that are wanted before masking:
    one of many partially masked columns can't be had without reading the others.
    """
    by_name = names_by_fold(df.sparkSession, rules)
    fold = folding(df.sparkSession)

    def rule_of(name: str) -> str | None:
        known = by_name.get(fold(name))
        if known is None:
            return unknown
        if not (rules[known] or "").strip():
            raise ValueError(f"Column {name} has a policy without a rule")
        return rules[known]

    chosen = [(name, rule_of(name)) for name in df.columns]
    partial = [name for name, rule in chosen if str(getattr(rule, "value", rule)) == "PARTIAL_MASK"]
    if len(partial) < SHARED_FROM:
        return df.select(*[mask_expr(name, rule, strict) if rule else column_ref(name) for name, rule in chosen])
    texts = F.array(*[column_ref(name).cast("string") for name in partial])
    array = "_partial"
    while array in df.columns:
        array += "_"
    shared = df.withColumn(array, F.transform(texts, lambda value: partial_mask(value, strict)))
    place = {name: i for i, name in enumerate(partial)}

    def one(name: str, rule):
        if name in place:
            return F.get(array, F.lit(place[name])).alias(name)
        return mask_expr(name, rule, strict) if rule else column_ref(name)

    return shared.select(*[one(name, rule) for name, rule in chosen])
