import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import matching as D

SPACES = ["", " ", "\t", "\n", "\x1c", "\x85", "\xa0", " ", "　", "\r\n "]
BODIES = [
    "012345678901", "01234567890", "0123456789012", "0912345678", "0212345678", "0912345678a", "a@b.co", "a@b.c",
    "@b.co", "a b@c.com", "x.y+z%1@sub.example.org", "DN1234567890123", "dn1234567890123", "DN123456789012", "",
    "0٣1234567890", "đ@b.com",
]


def expected_tags(value):
    """What each format means, on the stripped text, in plain Python."""
    if not value:
        return ["NONE"]
    text = value.strip()
    formats = {
        "RESIDENT_ID": r"0\d{11}",
        "PHONE": r"(03|05|07|08|09)\d{8}",
        "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        "HEALTH_INSURANCE_ID": r"[A-Z]{2}\d{13}",
    }
    return [t for t, p in formats.items() if re.fullmatch(p, text)] or ["NONE"]


def tags_of(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", D.match_tags(F.col("v")).alias("t"), D.value_tag(F.col("v")).alias("u")).collect()
    return {r.i: (r.t, r.u) for r in rows}


def test_strict_formats_match_plain_python(spark):
    values = [a + b + c for a in SPACES for b in BODIES for c in SPACES] + [None]
    found = tags_of(spark, values)
    for i, value in enumerate(values):
        assert found[i][0] == expected_tags(value), repr(value)
        strict = expected_tags(value)[0]
        if strict != "NONE":
            assert found[i][1] == strict, repr(value)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123579@.aADN \t-", max_size=18), min_size=40, max_size=80))
def test_strict_formats_on_random_text(spark, values):
    found = tags_of(spark, values)
    for i, value in enumerate(values):
        assert found[i][0] == expected_tags(value), repr(value)


@pytest.mark.parametrize(
    "value, tag",
    [
        ("1990-05-20", "DOB"), ("18/12/2004", "DOB"), ("2001.01.30", "DOB"), ("2024-05-20", None), ("1990-13-20", None),
        ("15500000", "SALARY"), ("5000000", "SALARY"), ("50000", None), ("100000000", "SALARY"), ("1000000000", None), ("15500001", None),
        ("Nguyễn Văn An", "NAME"), ("Trần Minh Khoa", "NAME"), ("Giáo viên", None), ("Lê", None), ("Tim mạch", None),
        ("123 Đường Lê Lợi, Phường Bến Nghé, Quận 1, TP. Hồ Chí Minh", "ADDRESS"), ("Quận Cầu Giấy, Hà Nội", "ADDRESS"),
        ("Tỉnh Nghệ An", "ADDRESS"), ("Bình Dương", "ADDRESS"), ("Hà Nam", "ADDRESS"), ("UBND Quận 1", None),
        ("Bệnh viện Trung ương Huế", None), ("Cửa số 12", None), ("true", None), ("200", None), ("SYS-123456", None),
        (None, None), ("", None),
    ],
)
def test_meaning_of_single_values(spark, value, tag):
    assert tags_of(spark, [value])[0][1] == tag


def test_levels_and_weights_are_total(spark):
    df = spark.createDataFrame([(t,) for t in [*V.TAGS, "OTHER", None]], "t string")
    rows = df.select("t", V.level_of(F.col("t")).alias("l"), V.weight_of(F.col("t")).alias("w")).collect()
    assert {r.t: (r.l, r.w) for r in rows} == {**V.TAGS, "OTHER": ("NONE", -2), None: ("NONE", -2)}
