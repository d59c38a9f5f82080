"""CSV in and out, and the ground-truth reader."""

from __future__ import annotations

import logging
import posixpath
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.tables import resolve_fqn, write_table

logger = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """First line is the header; every column is text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def table_name_of(path: str) -> str:
    """Lower-cased file name without its extension."""
    return posixpath.splitext(posixpath.basename(path.rstrip("/")))[0].lower()


def find_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, on any file system Spark can list.

    A folder named ``x.csv``, as Spark writes it, counts as one file. Only names
    are listed; no file content is read.
    """
    try:
        files = spark.read.format("binaryFile").load(pattern).select("path")
    except AnalysisException:
        return []
    folder = F.regexp_replace("path", "/[^/]*$", "")
    # the parts of a folder are one entry before anything reaches the driver
    found = files.select(F.when(F.lower(folder).endswith(".csv"), folder).otherwise(F.col("path")).alias("path")).distinct()
    return sorted(row.path for row in found.collect())


def ingest_csv(
    spark: SparkSession, path: str, database: str, catalog: str | None = None, provider: str = "parquet"
) -> str | None:
    """Load one CSV file as a table and return its full name.

    A missing file, or a load that fails, is logged and gives ``None``.
    """
    fqn = resolve_fqn(table_name_of(path), database, catalog)
    try:
        write_table(read_csv(spark, path), fqn, provider)
    except PySparkException:
        logger.exception("Could not load %s into %s", path, fqn)
        return None
    logger.info("Loaded %s into %s", path, fqn)
    return fqn


def ingest_folder(
    spark: SparkSession,
    pattern: str,
    database: str,
    catalog: str | None = None,
    provider: str = "parquet",
    parallel_jobs: int = 4,
) -> list[str]:
    """Load every CSV file that matches a glob, one table each.

    Several loads are in flight at once, so small files do not leave the cluster
    idle. Of files with the same table name the last one in path order wins.
    """
    files: dict[str, str] = {}
    for path in find_files(spark, pattern):
        if table_name_of(path) in files:
            logger.warning("%s is not loaded: %s has the same table name", files[table_name_of(path)], path)
        files[table_name_of(path)] = path
    if not files:
        logger.error("No CSV files match %s", pattern)
        return []
    with ThreadPoolExecutor(parallel_jobs) as pool:
        loaded = pool.map(lambda path: ingest_csv(spark, path, database, catalog, provider), files.values())
        return [fqn for fqn in loaded if fqn]


def write_csv(df: DataFrame, path: str) -> None:
    """Write a directory of CSV parts with header, one per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, column_name, sensitivity_tag, sensitivity_level) from JSON."""
    schema = (
        "table_name string, total_columns int, total_rows bigint, columns array<struct<"
        "column_name string, sensitivity_tag string, sensitivity_level string>>"
    )
    documents = spark.read.schema(schema).json(path, multiLine=True)
    table = F.regexp_replace("table_name", r"\.csv$", "")
    return documents.select(table.alias("table_name"), F.explode("columns").alias("c")).select("table_name", "c.*")
