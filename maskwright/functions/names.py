"""Column names as the session compares them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


def folding(spark: SparkSession) -> Callable[[str], str]:
    """The form in which two names of one column are equal: lower case, unless the session tells case apart."""
    exact = spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    return str if exact else str.lower


def names_by_fold(spark: SparkSession, names: Iterable[str]) -> dict[str, str]:
    """Folded name -> name; two names that fold alike raise."""
    fold, found = folding(spark), {}
    for name in names:
        if found.setdefault(fold(name), name) != name:
            raise ValueError(f"Column names {found[fold(name)]} and {name} are one to this session")
    return found


def own_names(spark: SparkSession, schema_names: Iterable[str], requested: Iterable[str]) -> list[str]:
    """The schema's own spelling of each requested name; an unknown name is left for Spark to report."""
    known, fold = names_by_fold(spark, schema_names), folding(spark)
    return [known.get(fold(name), name) for name in requested]
