"""Small text expressions used around the operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with accents and their plain letter, by rule."""
    accented, plain = "đ", "d"
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter.islower() and base != letter and base.isascii():
            accented, plain = accented + letter, plain + base
    return accented, plain


ACCENTED, PLAIN = _accent_table()


def slugify(name: Column) -> Column:
    """Lower case, no accents, dots for spaces, other characters dropped."""
    ascii_name = F.translate(F.lower(name), ACCENTED, PLAIN)
    return F.regexp_replace(F.replace(ascii_name, F.lit(" "), F.lit(".")), r"[^a-z0-9.]", "")


def score_text(score: Column) -> Column:
    """A score as text; tiny scores in fixed notation instead of an exponent."""
    return F.when(score >= 0.001, score.cast("string")).otherwise(F.format_string("%.6f", score))


def reason_suffix(detected: Column) -> Column:
    """`` - Regex tags detection: TAG:score, ...`` or empty text.

    ``detected`` is an array of (tag, score) structs.
    """
    parts = F.transform(detected, lambda d: F.concat(d["tag"], F.lit(":"), score_text(d["score"])))
    listed = F.concat(F.lit(" - Regex tags detection: "), F.array_join(parts, ", "))
    return F.when(F.size(detected) > 0, listed).otherwise(F.lit(""))


def unfence(raw: Column) -> Column:
    """Trim a reply and drop the Markdown fence lines around its JSON."""
    text = F.btrim(raw, F.lit(" \t\r\n\f\v"))
    opened = F.regexp_replace(text, r"^```[^\n]*(\n|$)", "")
    closed = F.regexp_replace(opened, r"(^|\n)[^\S\n]*```$", "")
    return F.trim(F.when(text.startswith("```"), closed).otherwise(text))
