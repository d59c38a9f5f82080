"""Masking rules as native ``Column`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import vocab as V


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_ref(name: str) -> Column:
    """Reference to a top-level column, whatever characters its name holds."""
    return F.col(quoted(name))


def hash_mask(value: Column) -> Column:
    """SHA-256 of the value as text, in lower-case hex; null stays null."""
    return F.sha2(value.cast("string"), 256)


def redact_mask(value: Column) -> Column:
    return F.lit(V.REDACTED)


def nullify_mask(value: Column) -> Column:
    return F.lit(None).cast("string")


def clear_text(value: Column) -> Column:
    return value


def _stars(count: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(F.lit(0), count))


def mask_email(value: Column) -> Column:
    """First character, stars, ``@`` and the text between the first two ``@``."""
    at = F.locate("@", value)
    to_domain = F.substring_index(value, "@", 2)
    hidden = F.length(value) - (F.length(to_domain) - at) - 2
    return F.concat(F.substring(value, 1, 1), _stars(hidden), F.substr(to_domain, at))


def mask_words(value: Column) -> Column:
    """Keep the first character of every word, star the rest."""
    return F.regexp_replace(value, r"(?<=\S)\S", "*")


def mask_digits(value: Column) -> Column:
    """First three characters, stars, last four characters."""
    return F.concat(F.substring(value, 1, 3), _stars(F.length(value) - 7), F.substring(value, -4, 4))


def partial_mask(value: Column, strict: bool = False) -> Column:
    """Mask by the look of the value: e-mail, words, or phone / identity number.

    Null and values shorter than six characters become ``[INVALID_DATA]``. A
    value of six or seven characters stays readable; ``strict`` stars all but
    its last two characters instead.
    """
    text = value.cast("string")
    number = mask_digits(text)
    if strict:
        short = F.concat(_stars(F.length(text) - 2), F.substring(text, -2, 2))
        number = F.when(F.length(text) <= 7, short).otherwise(number)
    return (
        F.when(text.contains("@"), mask_email(text))
        .when(text.contains(" "), mask_words(text))
        .when(F.length(text) >= 6, number)
        .otherwise(F.lit(V.INVALID_DATA))
    )


_BY_RULE = {
    "HASH_MASK": hash_mask,
    "REDACTED_MASK": redact_mask,
    "NULLIFY_MASK": nullify_mask,
    "PARTIAL_MASK": partial_mask,
    "CLEAR_TEXT": clear_text,
}


def mask_expr(column: str, rule, strict: bool = False) -> Column:
    """Expression that masks ``column`` by ``rule`` and keeps its name.

    ``rule`` is the rule's name or an enum member whose value is that name.
    """
    name = str(getattr(rule, "value", rule))
    if name not in _BY_RULE:
        raise ValueError(f"Invalid masking rule: {rule}")
    value = column_ref(column)
    masked = partial_mask(value, strict) if name == "PARTIAL_MASK" else _BY_RULE[name](value)
    return masked.alias(column)
