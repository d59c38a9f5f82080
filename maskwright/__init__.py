"""Spark-native PII governance: detect personal data, decide, mask, audit."""
