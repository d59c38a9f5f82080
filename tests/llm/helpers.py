"""A small documents table with the odd cases, and plain counterparts of what the operators do."""

import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def odd_documents(spark, texts=None):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names clash."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    texts = texts or [
        "", None, "one", "  \t\n ", "a b c d e a b c d e\nsame line\nsame line\n", long, "ünï cödé 漢字 🙂 " * 20,
        "copy of a text that is longer than ten words and has no end at all", "copy of a text that is longer than ten words and has no end at all",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s0"][i % 4], len(t or ""), "x", None) for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", "s1", None, None, None), (None, None, None, None, None, None, None), rows[0], rows[-1]]
    return spark.createDataFrame(rows, DOC_SCHEMA)
