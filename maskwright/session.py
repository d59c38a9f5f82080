"""Session settings that suit these jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The JVM never compiles a method of more than 8000 bytes of byte code. With
# this limit Spark splits such a projection (many masked columns) into methods
# that are compiled, instead of fusing it into one that is interpreted.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; they change speed, never results."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
