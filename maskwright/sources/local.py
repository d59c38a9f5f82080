"""Planning-size frames: schema columns, policies, expectations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
}


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of a few known rows; ``schema`` is DDL text of simple types.

    It becomes a local relation whose size Spark knows, so that joins with it
    are planned as broadcasts without a hint and no Python worker is started.
    """
    fields = [field.split() for field in schema.split(",")]
    arrays = [pa.array([row[i] for row in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))
