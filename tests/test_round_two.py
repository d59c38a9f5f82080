"""Faults that the green rows of the first round did not see."""

import pytest
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.operators import generation as G
from maskwright.operators.arbitration import arbitrate, with_answers
from maskwright.operators.evaluation import confusion, level_accuracy, require_complete
from maskwright.operators.keyed import insert_if_absent, one_per_key, upsert
from maskwright.operators.masking import mask_frame
from maskwright.operators.sampling import bounded_sample
from maskwright.plans.scan import column_verdicts, scan_table
from maskwright.plans.secure import secure_read, secure_read_all
from maskwright.sources.store import MetadataStore
from maskwright.sources.tables import write_table


def clustered(spark):
    phone = F.concat(F.lit("09"), F.lpad(F.col("id").cast("string"), 8, "0"))
    return spark.range(0, 100_000, 1, 20).select("id", F.when(F.col("id") < 10_000, "n/a").otherwise(phone).alias("a"),
                                                 F.when(F.col("id") >= 90_000, phone).otherwise("n/a").alias("b"))


def test_default_sample_draws_from_all_of_the_table(spark):
    ids = [r.id for r in bounded_sample(clustered(spark), 200).collect()]
    assert len(ids) <= 600 and max(ids) > 95_000 and abs(sum(ids) / len(ids) - 50_000) < 8_000


def test_sampled_verdict_of_clustered_columns_is_the_exact_one(spark):
    df = clustered(spark).drop("id")
    tags = [{r.column_name: r.sensitivity_tag for r in column_verdicts(df, "t", sample_size=n).collect()} for n in (200, None)]
    assert tags[0] == tags[1] == {"a": "PHONE", "b": "NONE"}


def test_long_addresses_keep_their_tag(spark):
    note = " giao giờ hành chính" * 60
    values = [f"{i} Kim Mã, Phường Kim Liên, Quận 7, Hà Nội{note}" for i in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "place string")
    assert column_verdicts(df, "t", sample_size=None).first().sensitivity_tag == "ADDRESS"


def test_ids_far_apart_give_different_rows(spark):
    ids = spark.createDataFrame([(5,), (5 + 2147483647,), (5 + 3 * 2147483647,)], "id long")
    for tag in ("ADDRESS", "NAME", "RESIDENT_ID"):
        assert len({r[0] for r in ids.select(G.gen_values(tag, F.col("id"))).collect()}) == 3


def test_masks_do_not_depend_on_the_case_of_a_name(spark):
    write_table(spark.createDataFrame([("012345678901", "0912345678", "x")] * 30, "CCCD string, Phone string, other string"), "case_db.people")
    store = MetadataStore(spark, "case_meta").create()
    scan_table(store, "people", "case_db", sample_size=None)
    clear = secure_read(store, "ADMIN", "people", None, "case_db").first()
    for names in (["CCCD", "Phone"], ["cccd", "phone"], ["CcCd", "PHONE"]):
        df = secure_read(store, "ANALYST", "People", names, "case_db")
        assert df.columns == ["CCCD", "Phone"]
        assert all(a != b for a, b in zip(df.first(), clear[:2]))
    with pytest.raises(ValueError, match="No verdict"):
        store.update_level("people", "nowhere", "HIGH")
    store.update_level("people", "OTHER", "HIGH")
    assert secure_read(store, "ANALYST", "people", ["other"], "case_db").first()[0] != "x"


def test_an_empty_rule_raises(spark):
    df = spark.createDataFrame([("x",)], "a string")
    for rules in ({"a": ""}, {"A": None}):
        with pytest.raises(ValueError, match="without a rule"):
            mask_frame(df, rules)


def test_one_row_per_key(spark):
    kind = "k int, v string"
    target = spark.createDataFrame([(1, "old"), (None, "null")], kind)
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "e")], kind)
    assert sorted(map(tuple, insert_if_absent(target, new, ["k"]).collect()), key=repr) == [(1, "old"), (2, "c"), (None, "null")]
    assert sorted(map(tuple, upsert(target, new, ["k"]).collect()), key=repr) == [(1, "b"), (2, "d"), (None, "e")]
    nothing = spark.createDataFrame([(1, None, "z")], "k int, o int, v string")
    for last in (True, False):
        assert [tuple(r) for r in one_per_key(nothing, ["k"], F.col("o"), last).collect()] == [(1, None, "z")]


def test_the_last_answer_counts(spark):
    scored = spark.createDataFrame([("t", 0, "a", V.UNDETERMINED, [], [])],
                                   "table_name string, ordinal int, column_name string, regex_status string, regex_candidates array<string>, all_detected_tags array<struct<tag:string,score:double>>")
    scored = scored.withColumn("raw_scores", F.map_from_entries("all_detected_tags"))
    answers = spark.createDataFrame([("t", "a", True, "NAME", "HIGH", 0.9, "x", 0), ("t", "a", False, "NONE", "NONE", 0.9, "y", 1)],
                                    "table_name string, column_name string, is_pii boolean, suggested_tag string, sensitivity_level string, confidence_score double, reason string, position int")
    assert [r.sensitivity_tag for r in arbitrate(with_answers(scored, answers)).collect()] == ["NONE"]


def test_a_missing_prediction_always_raises(spark):
    truth = spark.createDataFrame([("t", "a", "NAME", "HIGH"), ("t", "b", "NONE", "NONE")], "table_name string, column_name string, sensitivity_tag string, sensitivity_level string")
    matrix = require_complete(confusion(truth, truth.filter("column_name = 'a'")))
    with pytest.raises(Exception, match="Missing predictions"):
        level_accuracy(matrix).select("level_accuracy").collect()


def test_one_name_in_two_databases(spark):
    for database in ("first_db", "second_db"):
        write_table(spark.createDataFrame([("012345678901",)] * 20, "cccd string"), f"{database}.people")
    store = MetadataStore(spark, "names_meta").create()
    scan_table(store, "people", "first_db", sample_size=None)
    with pytest.raises(ValueError, match="store of its own"):
        scan_table(store, "people", "second_db", sample_size=None)
    assert secure_read_all(store, "ANALYST")["people"].first()[0] != "012345678901"
