import json

import pytest

from maskwright.operators.exchange import build_requests, decode_responses, invalid_responses, score_with
from maskwright.operators.sampling import column_sample_lists
from maskwright.plans.scan import column_scores, scorer_verdicts

GOOD = json.dumps({
    "table_name": "t",
    "columns": [{"column_name": "c", "is_pii": True, "suggested_tag": "NAME", "sensitivity_level": "MEDIUM",
                 "confidence_score": 0.9, "reason": "tên"}],
})


def replies(spark, *texts):
    return spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)], "table_name string, raw_reply string")


@pytest.mark.parametrize("text", [GOOD, f"  {GOOD}\n", f"```json\n{GOOD}\n```", f"\n```\n{GOOD}\n  ```  \n", f"```json\n{GOOD}"])
def test_plain_and_fenced_replies(spark, text):
    row = decode_responses(replies(spark, text)).first()
    assert (row.table_name, row.column_name, row.suggested_tag, row.reason) == ("t0", "c", "NAME", "tên")


@pytest.mark.parametrize("text", [
    None, "", "no json", "{}", GOOD[:60], GOOD.replace("NAME", "NO_TAG"), GOOD.replace("MEDIUM", "SOME"),
    GOOD.replace('"is_pii": true, ', ""),
])
def test_invalid_replies_raise_or_are_set_aside(spark, text):
    with pytest.raises(Exception, match="Invalid reply"):
        decode_responses(replies(spark, text)).collect()
    mixed = replies(spark, text, GOOD)
    assert [r.table_name for r in decode_responses(mixed, strict=False).collect()] == ["t1"]
    assert [r.table_name for r in invalid_responses(mixed).collect()] == ["t0"]


def requests(spark):
    df = spark.range(20).selectExpr("'0912345678' phone", "'Nguyễn Văn An' c03", "id")
    samples = column_sample_lists(df, "t", 10, 2).select("ordinal", "model_sample")
    return build_requests(column_scores(df, "t").join(samples, "ordinal"))


def test_request_holds_both_groups_and_keeps_non_ascii(spark):
    row = requests(spark).first()
    determined, undetermined = json.loads(row.determined_json), json.loads(row.undetermined_json)
    assert [c["column_name"] for c in determined] == ["phone"]
    assert determined[0]["regex_candidates"] == ["PHONE"] and determined[0]["raw_scores"] == {"PHONE": 1.0}
    assert [c["column_name"] for c in undetermined] == ["c03", "id"]
    assert "Nguyễn Văn An" in row.prompt and len(undetermined[0]["sample_data"]) == 2
    assert (row.n_determined, row.n_undetermined) == (1, 2)


def test_scorer_is_retried_and_then_raises(spark, tmp_path):
    log = tmp_path / "calls"

    def flaky(prompt):
        with open(log, "a") as f:
            f.write("x")
        return "broken" if len(log.read_text()) < 3 else GOOD

    assert score_with(requests(spark), flaky).first().raw_reply == GOOD
    assert log.read_text() == "xxx"
    with pytest.raises(Exception):
        score_with(requests(spark), lambda prompt: "never json", max_retries=2).collect()


def test_settled_tables_are_not_sent(spark):
    def refuse(prompt):
        raise AssertionError("not to be called")

    df = spark.range(20).selectExpr("'0912345678' phone")
    row = scorer_verdicts({"t": df}, refuse).first()
    assert (row.sensitivity_tag, row.detection_method) == ("PHONE", "REGEX")


def test_scorer_answers_are_used(spark):
    answer = GOOD.replace('"c"', '"x"')
    df = spark.range(20).selectExpr("'Somebody' x", "'other' y")
    rows = {r.column_name: r for r in scorer_verdicts({"t": df}, lambda prompt: answer).collect()}
    assert (rows["x"].sensitivity_tag, rows["x"].detection_method, rows["x"].confidence_score) == ("NAME", "LLM", 0.9)
    assert (rows["y"].sensitivity_tag, rows["y"].detection_method) == ("NONE", "HYBRID")

