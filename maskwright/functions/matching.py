"""Value-level detectors as native ``Column`` expressions.

The strip step of a match is part of the pattern, so a value is never rewritten
before it is matched, and cheap tests that need no regular expression (does it
hold ``@``, is it long enough) come first: most values of most columns are then
decided without one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import vocab as V


def _matches(value: Column, tag: str) -> Column:
    return value.rlike(V.whole_value(V.STRICT_PATTERNS[tag]))


def is_resident_id(value: Column) -> Column:
    return _matches(value, "RESIDENT_ID")


def is_phone(value: Column) -> Column:
    return _matches(value, "PHONE")


def is_email(value: Column) -> Column:
    return value.contains("@") & _matches(value, "EMAIL")


def is_health_insurance_id(value: Column) -> Column:
    return _matches(value, "HEALTH_INSURANCE_ID")


def strict_tag(value: Column) -> Column:
    """The strict-format tag of a value, or null.

    The four formats exclude each other: only EMAIL holds ``@``, and the other
    three differ in length (10, 12 and 15 characters once stripped).
    """
    size = F.octet_length(value)
    return (
        F.when(value.contains("@"), F.when(is_email(value), F.lit("EMAIL")))
        .when(size < 10, F.lit(None).cast("string"))
        .when(is_phone(value), F.lit("PHONE"))
        .when(size < 12, F.lit(None).cast("string"))
        .when(is_resident_id(value), F.lit("RESIDENT_ID"))
        .when(is_health_insurance_id(value), F.lit("HEALTH_INSURANCE_ID"))
    )


def match_tags(value: Column) -> Column:
    """All strict tags of a value as an array, ``[NONE]`` when there is none."""
    return F.array(F.coalesce(strict_tag(value.cast("string")), F.lit(V.NONE_TAG)))


def _text_tag(value: Column) -> Column:
    """ADDRESS or NAME; both need a space.

    Places come before persons, because several provinces open with a word that
    is also a family name.
    """
    address = value.rlike(V.ADDRESS_PATTERN) & ~value.rlike(V.ORGANISATION_PATTERN)
    return F.when(
        value.contains(" "),
        F.when(address, F.lit("ADDRESS")).when(value.rlike(V.NAME_PATTERN), F.lit("NAME")),
    )


def _numeric_tag(value: Column) -> Column:
    """Tag of a value known to have one of the numeric formats."""
    dated = value.contains("-") | value.contains("/") | value.contains(".")
    return (
        F.when(dated, F.lit("DOB"))
        .when(value.rlike("[A-Z]"), F.lit("HEALTH_INSURANCE_ID"))
        .when(value.rlike(r"\p{Nd}{12}"), F.lit("RESIDENT_ID"))
        .when(value.rlike(r"\p{Nd}{10}"), F.lit("PHONE"))
        .otherwise(F.lit("SALARY"))
    )


def value_tag(value: Column) -> Column:
    """The one tag a value carries, by format or by meaning, or null.

    Built for whole-table profiles: one regular expression rejects whatever has
    none of the numeric formats, and short or unspaced values see no other.
    """
    return (
        F.when(is_email(value), F.lit("EMAIL"))
        .when((F.octet_length(value) < V.SHORTEST_NUMERIC) & ~value.contains(" "), F.lit(None).cast("string"))
        .when(value.rlike(V.NUMERIC_PATTERN), _numeric_tag(value))
        .otherwise(_text_tag(value))
    )
