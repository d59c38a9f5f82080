"""Requests to, and replies from, an external scorer of undetermined columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions.text import unfence

REPLY_SCHEMA = (
    "table_name string, columns array<struct<column_name string, is_pii boolean, suggested_tag string, "
    "sensitivity_level string, confidence_score double, reason string>>"
)

PROMPT = """You review table columns for personal data (PII).

Table: %s

Columns already settled by their format, for context only:
%s

Columns to judge; answer these and no others:
%s

Tags: RESIDENT_ID, HEALTH_INSURANCE_ID, SALARY (HIGH); PHONE, EMAIL, NAME (MEDIUM); ADDRESS, DOB (LOW); NONE.
Rules:
- Judge by the sample values. A column name may support a tag but never decide it.
- NONE is the default. Give a tag only if at least half of the values fit its format.
- Give a tag only if your confidence is above 0.7.
- Keep each reason below 15 words.

Reply with JSON alone, in this form:
{"table_name": "...", "columns": [{"column_name": "...", "is_pii": true, "suggested_tag": "...", \
"sensitivity_level": "...", "confidence_score": 0.9, "reason": "..."}]}
"""


def build_requests(results: DataFrame) -> DataFrame:
    """One request row per table: both column groups as JSON, and the prompt.

    ``results`` has one row per column with its format verdict, its scores and
    ``model_sample``; the lists of a table are bounded by its schema width.
    """
    column = F.struct(
        "column_name", "regex_status", "regex_candidates", "raw_scores", F.col("model_sample").alias("sample_data")
    )
    determined = F.col("regex_status") == V.SUCCESS

    def group(condition):
        ordered = F.sort_array(F.collect_list(F.when(condition, F.struct("ordinal", F.to_json(column).alias("json")))))
        return F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda c: c["json"]), ", "), F.lit("]"))

    return results.groupBy("table_name").agg(
        group(determined).alias("determined_json"),
        group(~determined).alias("undetermined_json"),
        F.count_if(determined).alias("n_determined"),
        F.count_if(~determined).alias("n_undetermined"),
    ).withColumn("prompt", F.format_string(PROMPT, "table_name", "determined_json", "undetermined_json"))


def decode_responses(raw: DataFrame, strict: bool = True, positions: bool = False) -> DataFrame:
    """Parse ``raw_reply`` into answer rows, one per column.

    A reply is valid when its JSON has the reply schema with known tags and
    levels. ``strict`` raises on the first invalid reply; otherwise invalid
    replies are left out (select them with :func:`invalid_responses`).
    ``positions`` adds the place of each answer in its reply.
    """
    parsed = _parsed(raw)
    if strict:
        failed = F.raise_error(F.concat(F.lit("Invalid reply for table "), F.coalesce("table_name", F.lit("?"))))
        # The check is part of the exploded column, so no optimisation drops it.
        columns = F.when(F.col("is_valid"), F.col("reply.columns")).otherwise(failed)
    else:
        parsed = parsed.filter("is_valid")
        columns = F.col("reply.columns")
    exploded = parsed.select("table_name", F.posexplode(columns).alias("position", "c"))
    return exploded.select("table_name", "c.*", *["position"] * positions)


def invalid_responses(raw: DataFrame) -> DataFrame:
    return _parsed(raw).filter(~F.col("is_valid")).drop("reply", "is_valid")


def _parsed(raw: DataFrame) -> DataFrame:
    reply = F.from_json(unfence(F.col("raw_reply")), REPLY_SCHEMA)
    complete = F.forall(
        "reply.columns",
        lambda c: c["column_name"].isNotNull()
        & c["is_pii"].isNotNull()
        & c["suggested_tag"].isin(*V.TAGS)
        & c["sensitivity_level"].isin(*V.LEVELS)
        & c["confidence_score"].isNotNull()
        & c["reason"].isNotNull(),
    )
    valid = F.col("reply.columns").isNotNull() & F.col("reply.table_name").isNotNull() & complete
    # Exploding a one-element array keeps the parse in one place; as a plain
    # column it would be repeated in every expression that reads it.
    once = raw.select("*", F.explode(F.array(reply)).alias("reply"))
    return once.withColumn("is_valid", F.coalesce(valid, F.lit(False)))


def score_with(requests: DataFrame, fn: Callable[[str], str], max_retries: int = 3) -> DataFrame:
    """Ask ``fn(prompt) -> reply`` once per table and return the raw replies.

    A call that fails, or whose reply holds no JSON object with ``columns``, is
    repeated up to ``max_retries`` times and then raises. The calls run inside
    Spark tasks over one row per table, spread by table name; tables without an
    undetermined column are not asked.
    """

    def call(prompt: str) -> str:
        for attempt in range(1, max_retries + 1):
            try:
                reply = fn(prompt)
                body = reply.strip()
                if body.startswith("```"):
                    body = body.split("\n", 1)[1].rsplit("```", 1)[0]
                if "columns" not in json.loads(body):
                    raise ValueError("reply has no columns")
                return reply
            except Exception:
                if attempt == max_retries:
                    raise
        raise ValueError("max_retries must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"table_name": batch["table_name"], "raw_reply": batch["prompt"].map(call)})

    asked = requests.filter("n_undetermined > 0").select("table_name", "prompt").repartition("table_name")
    return asked.mapInPandas(run, "table_name string, raw_reply string")
