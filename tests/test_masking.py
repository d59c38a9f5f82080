import hashlib
from enum import Enum

import pytest
from pyspark.sql import functions as F

from maskwright.functions.masking import mask_expr
from maskwright.operators.masking import mask_column, mask_frame

PARTIAL = {
    "raw_test_email@gmail.com": "r*************@gmail.com",
    "Test Suite": "T*** S****",
    "023746352736": "023*****2736",
    "0937463528": "093***3528",
    "123456": "1233456",
    "1234567": "1234567",
    "12345678": "123*5678",
    "15500000": "155*0000",
    "@x": "@@x",
    "x@": "x@",
    "a@b@c": "a**@b",
    "ab@c d.com": "a*@c d.com",
    None: "[INVALID_DATA]",
    "": "[INVALID_DATA]",
    "12345": "[INVALID_DATA]",
    "  ": "  ",
    "Nguyễn Văn An": "N***** V** A*",
    "1990-05-20": "199***5-20",
}


def one(spark, value, rule, **options):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(mask_expr("v", rule, **options)).first().v


@pytest.mark.parametrize("value, masked", PARTIAL.items())
def test_partial_mask(spark, value, masked):
    assert one(spark, value, "PARTIAL_MASK") == masked


def test_strict_partial_mask_hides_short_numbers(spark):
    assert one(spark, "123456", "PARTIAL_MASK", strict=True) == "****56"
    assert one(spark, "12345678", "PARTIAL_MASK", strict=True) == "123*5678"


def test_other_rules_and_null(spark):
    assert one(spark, "abc", "HASH_MASK") == hashlib.sha256(b"abc").hexdigest()
    assert one(spark, None, "HASH_MASK") is None
    assert one(spark, None, "REDACTED_MASK") == "REDACTED"
    assert one(spark, "abc", "NULLIFY_MASK") is None
    assert one(spark, "abc", "CLEAR_TEXT") == "abc"


def test_rule_may_be_an_enum_and_must_be_known(spark):
    class Rule(Enum):
        HASH = "HASH_MASK"

    assert len(one(spark, "abc", Rule.HASH)) == 64
    with pytest.raises(ValueError):
        mask_expr("v", "NO_SUCH_RULE")


def test_typed_columns_and_odd_names(spark):
    df = spark.range(1).select(
        F.lit(12345678).alias("a b"), F.lit(1.5).alias("x`y"), F.lit("k@l.mn").alias("p.q"), F.lit(7).alias("id")
    )
    masked = mask_frame(df, {"a b": "PARTIAL_MASK", "x`y": "HASH_MASK", "p.q": "PARTIAL_MASK"})
    assert masked.columns == df.columns
    row = masked.first()
    assert row["a b"] == "123*5678" and len(row["x`y"]) == 64 and row["p.q"] == "k@l.mn" and row["id"] == 7


def test_mask_frame_is_one_projection_and_reads_no_hidden_column(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).selectExpr("id", "cast(id as string) a", "cast(id as string) b", "'x' c").write.parquet(path)
    masked = mask_frame(spark.read.parquet(path), {"a": "NULLIFY_MASK", "b": "REDACTED_MASK", "c": "HASH_MASK"})
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") == 1
    schema = plan.split("ReadSchema: ")[1]
    assert "a:string" not in schema and "b:string" not in schema and "c:string" in schema


def test_unknown_columns_can_be_redacted(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    assert mask_frame(df, {"a": "CLEAR_TEXT"}, unknown="REDACTED_MASK").first() == ("1", "REDACTED")
    assert mask_column(df, "b", "NULLIFY_MASK").first() == ("1", None)


def test_masks_apply_to_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("0937463528",)], "v string").write.parquet(path)
    stream = mask_frame(spark.readStream.schema("v string").parquet(path), {"v": "PARTIAL_MASK"})
    query = stream.writeStream.format("memory").queryName("masked_stream").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("masked_stream").first().v == "093***3528"


def test_many_partial_masks_share_an_expression_and_give_the_same(spark):
    values = [v for v in PARTIAL if v is not None]
    columns = [f"c{i}" for i in range(6)] + ["_partial", "a`b.c"]
    rows = [tuple(values[(i + j) % len(values)] if (i + j) % 7 else None for j in range(8)) for i in range(20)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)).withColumn("n", F.lit(1234567890))
    rules = {c: "PARTIAL_MASK" for c in [*columns, "n"]}
    for strict in (False, True):
        shared = mask_frame(df, rules, strict=strict)
        assert shared.columns == df.columns
        single = df.select(*[mask_expr(c, "PARTIAL_MASK", strict) for c in df.columns])
        assert shared.collect() == single.collect()
        assert dict(shared.dtypes)["n"] == "string"
    plan = mask_frame(df, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 1
