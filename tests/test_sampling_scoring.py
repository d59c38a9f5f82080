import hashlib

from pyspark.sql import functions as F

from maskwright.operators.arbitration import arbitrate, with_answers
from maskwright.operators.sampling import (
    bounded_sample,
    column_sample_lists,
    column_values,
    sampled_values,
    stratified_sample,
)
from maskwright.operators.sampling import to_long
from maskwright.operators.scoring import (
    CHUNK_COLUMNS,
    chunk_counts,
    profile,
    profile_tables,
    regex_verdict,
    split_by_status,
    tag_scores,
)
from maskwright.operators.semantic import semantic_scan
from maskwright.plans.scan import column_scores, column_verdicts, table_verdicts

SCORED = ("table_name string, ordinal int, column_name string, n_values bigint, n_resident_id bigint, "
          "n_phone bigint, n_email bigint, n_health_insurance_id bigint")


def scored(spark, *counts):
    rows = [("t", i, f"c{i}", *c) for i, c in enumerate(counts)]
    return regex_verdict(tag_scores(spark.createDataFrame(rows, SCORED)))


def test_keyed_sample_is_the_smallest_hashes_whatever_the_layout(spark):
    df = spark.range(20000)
    got = [r.id for r in bounded_sample(df, 50, ["id"]).collect()]
    again = [r.id for r in bounded_sample(df.repartition(13), 50, ["id"]).collect()]
    draws = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i in range(20000))
    limit = f"{int(250 / 20000 * 2**32):08x}"
    expected = sorted(i for h, i in draws[:150] if h < limit)
    assert sorted(got) == sorted(again) == expected
    assert len(got) <= 150


def test_small_and_empty_tables(spark):
    assert bounded_sample(spark.range(10), 50, ["id"]).count() == 10
    assert bounded_sample(spark.range(10), 50).count() == 10
    empty = spark.createDataFrame([], "a string, b int")
    verdicts = column_verdicts(empty, "t").collect()
    assert [(v.column_name, v.sensitivity_tag) for v in verdicts] == [("a", "NONE"), ("b", "NONE")]


def test_unkeyed_sample_is_repeatable(spark):
    df = spark.range(20000)
    first, second = (sorted(r.id for r in bounded_sample(df, 50).collect()) for _ in range(2))
    assert first == second and 0 < len(first) <= 150


def test_column_values_skip_null_and_blank_but_keep_tabs(spark):
    df = spark.createDataFrame([("a", None), ("  ", "\t"), (None, "b")], "x string, y string")
    values = {(r.column_name, r.value) for r in column_values(df, "t", 10).collect()}
    assert values == {("x", "a"), ("y", "\t"), ("y", "b")}
    assert sampled_values(spark.range(1000), 20, ["id"]).count() == 20


def test_sample_lists_keep_empty_columns_and_share_one_draw(spark):
    df = spark.range(500).select("id", F.lit(None).cast("string").alias("nothing"))
    rows = {r.column_name: r for r in column_sample_lists(df, "t", 30, 5, ["id"]).collect()}
    assert rows["nothing"].sample_data == [] and rows["nothing"].model_sample == []
    assert len(rows["id"].sample_data) == 30 and rows["id"].model_sample == rows["id"].sample_data[:5]


def test_stratified_quota_is_capped_by_availability(spark):
    value = F.when(F.col("id") < 3, F.concat(F.lit("u"), "id", F.lit("@x.com"))).otherwise(F.lit("noise"))
    df = spark.range(100).select("id", value.alias("v"))
    rows = stratified_sample(df, "v", 10, "EMAIL", 0.7, ["id"]).collect()
    assert sum(r.is_match for r in rows) == 3 and sum(not r.is_match for r in rows) == 3
    assert stratified_sample(df, "v", 10, "NAME", 0.7, ["id"]).count() == 10


def test_verdicts_at_the_threshold_and_on_ties(spark):
    rows = scored(
        spark,
        (200, 140, 0, 0, 0),  # exactly 0.7
        (200, 139, 0, 0, 0),  # just below
        (10, 2, 2, 3, 0),  # ties in detection order
        (10, 0, 0, 0, 0),
        (0, 0, 0, 0, 0),  # no value at all
    ).orderBy("ordinal").collect()
    assert [r.regex_status for r in rows] == ["SUCCESS"] + ["UNDETERMINED"] * 4
    assert [r.regex_candidates for r in rows] == [
        ["RESIDENT_ID"], ["RESIDENT_ID"], ["EMAIL", "RESIDENT_ID", "PHONE"], [], [],
    ]
    assert rows[0].raw_scores == {"RESIDENT_ID": 0.7} and rows[4].raw_scores == {}
    low = regex_verdict(tag_scores(spark.createDataFrame([("t", 0, "c", 10, 4, 4, 0, 0)], SCORED)), 0.3).first()
    assert low.regex_candidates == ["RESIDENT_ID"]  # equal scores: severity decides


def test_exact_profile_has_no_window_and_one_small_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(id as string) a", "'user' || id || '@x.com' b", "null c")
    plan = profile(df, "t")._jdf.queryExecution().executedPlan().toString()
    for costly in ("Window", "Cartesian", "Python", "Expand", "Generate"):
        assert costly not in plan
    rows = {r.column_name: r for r in profile(df, "t").collect()}
    assert rows["b"].n_email == 1000 and rows["c"].n_values == 0


def test_a_chunk_of_columns_fits_a_compiled_method(spark):
    """The byte code of the widest method stays below what HotSpot compiles, and a column more would not hurt either."""
    df = spark.range(10).select(*[F.concat(F.lit(f"{i}-"), "id").alias(f"c{i}") for i in range(CHUNK_COLUMNS)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = chunk_counts(df, df.columns)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(plan).iterator()
        sizes = []
        while stages.hasNext():
            sizes.append(stages.next()._3().maxMethodCodeSize())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(sizes) < 8000


def test_wide_and_long_counts_agree(spark):
    """More columns than a chunk, blanks, nulls, odd names, numbers, and a table without rows."""
    df = spark.range(300).selectExpr(
        "cast(id as string) `a b`", "id n", "'user' || id || '@x.com' mail", "if(id % 3 = 0, null, if(id % 3 = 1, ' ', '0912345678')) p",
        "cast(1960 + id % 60 as string) || '-01-02' d", "'Lê Minh ' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + cast(id % 26 as int), 1) who",
        "array(id) list", "'Quận 1, Hà Nội' `place,x`", "'DN' || lpad(id, 13, '0') ins")
    frames = {"t": df, "none": df.limit(0)}
    long = {t: to_long(f) for t, f in frames.items()}
    key = lambda r: (r["table_name"], r["ordinal"])
    wide = sorted(profile_tables(frames).collect(), key=key)
    assert wide == sorted(profile_tables(frames, long).collect(), key=key)
    by_name = {r.column_name: r for r in wide if r.table_name == "t"}
    assert by_name["p"].n_values == 100 and by_name["d"].n_early_dates == 155 and by_name["d"].n_dob == 255
    assert bin(by_name["who"].text_bits).count("1") > 15 and bin(by_name["place,x"].text_bits).count("1") == 1


def tags_of(df):
    return {r.column_name: r.suggested_tag for r in semantic_scan(column_scores(df, "t", sample_size=None)).collect()}


def test_one_sentinel_date_does_not_make_a_birth_date(spark):
    df = spark.range(5000).selectExpr(
        "if(id = 0, '1970-01-01', cast(2008 + id % 2 as string) || '-05-06') c1", "if(id = 0, '2010-01-01', cast(1950 + id % 45 as string) || '-05-06') c2")
    assert tags_of(df) == {"c1": "NONE", "c2": "DOB"}


def test_labels_that_look_like_persons_are_no_names(spark):
    df = spark.range(2000).selectExpr(
        "array('Hoàng Gia', 'Mai Linh', 'Phan Rang')[id % 3] c1", "'Lê Minh ' || char(65 + id % 26) || char(97 + id % 7) c2",
        "array('Hoàng Gia', 'Mai Linh', 'Phan Rang')[id % 3] full_name", "array('Hà Nội', 'Nghệ An')[id % 2] c3")
    assert tags_of(df) == {"c1": "NONE", "c2": "NAME", "full_name": "NAME", "c3": "NONE"}
    few = spark.createDataFrame([("Lê Minh An",), ("Trần Thị Mai",), ("Phạm Văn Long",)], "c1 string")
    assert tags_of(few) == {"c1": "NAME"}


def test_many_tables_in_one_plan(spark):
    frames = {"t1": spark.range(5).selectExpr("'a@b.co' x"), "t2": spark.range(5).selectExpr("'n' y", "'0912345678' x")}
    found = {(r.table_name, r.column_name): r.sensitivity_tag for r in table_verdicts(frames).collect()}
    assert found == {("t1", "x"): "EMAIL", ("t2", "y"): "NONE", ("t2", "x"): "PHONE"}


def test_split_by_status_keeps_schema_order(spark):
    df = spark.range(5).selectExpr("'n' z", "'0912345678' b", "'m' a", "'a@b.co' c")
    split = split_by_status(column_scores(df, "t")).first()
    assert (split.determined_columns, split.undetermined_columns) == (["b", "c"], ["z", "a"])


ANSWER = ("table_name string, column_name string, is_pii boolean, suggested_tag string, sensitivity_level string, "
          "confidence_score double, reason string")


def test_decision_table(spark):
    columns = scored(
        spark, (10, 9, 0, 0, 0), (10, 0, 5, 0, 0), (10, 0, 5, 0, 0), (10, 0, 0, 0, 0), (10, 0, 0, 0, 0),
        (10, 0, 5, 0, 0), (10, 0, 0, 0, 0),
    )
    answers = spark.createDataFrame(
        [
            ("t", "c0", False, "NONE", "NONE", 0.9, "ignored"),
            ("t", "c1", False, "NONE", "NONE", 0.6, "no"),
            ("t", "c2", True, "NAME", "HIGH", 0.9, "yes"),
            ("t", "c3", True, "NAME", "HIGH", 0.95, "yes"),
            ("t", "c4", True, "NONE", "NONE", 0.95, "odd"),
        ],
        ANSWER,
    )
    rows = arbitrate(with_answers(columns, answers)).orderBy("ordinal").collect()
    assert [
        (r.is_pii, r.sensitivity_tag, r.sensitivity_level, r.confidence_score, r.detection_method) for r in rows
    ] == [
        (True, "RESIDENT_ID", "HIGH", 0.9, "REGEX"),
        (False, "NONE", "NONE", 0.6, "HYBRID"),
        (True, "PHONE", "MEDIUM", 0.5, "HYBRID"),
        (True, "NAME", "MEDIUM", 0.95, "LLM"),  # the level comes from the tag
        (False, "NONE", "NONE", 1.0, "HYBRID"),
        (False, "NONE", "NONE", 0.0, "HYBRID"),  # no answer for a column with a candidate
        (False, "NONE", "NONE", 1.0, "HYBRID"),
    ]
    assert rows[0].reason == "Detected PII fully by Regex - Regex tags detection: RESIDENT_ID:0.9"
    assert rows[2].reason == ("Detected PII by LLM and Regex, finally chosen by Regex - Regex tags detection: "
                              "PHONE:0.5 - LLM reason: yes")
    assert rows[5].reason.endswith(" - LLM reason: no answer")
