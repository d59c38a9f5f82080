import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import odd_documents

from maskwright.llm import phrases


def plain(rows, min_count, top=2000, depth=5, share=100):
    counts, totals, lower = {}, Counter(), {i: i + 32 for i in range(65, 91)}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        count = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            count.update(tuple(words[i : i + k]) for k in range(1, depth + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, count in counts.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        gone = {p[i : i + k] for p, b in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= share * count[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000 * a * totals[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def noisy(spark):
    rnd = random.Random(5)
    signs = ["a", "b", "A", "c\x01", "c", "é", "É", "x\ty", "z, q", "w.", "  ", "\x0b", "c\x01\x02"]
    langs = ["en", "", None, "und", "de x", "de"]
    rows = [(" ".join(rnd.choice(signs) for _ in range(200)), rnd.choice(langs)) for _ in range(200)]
    # a third of all words in one phrase, another with ever new ends, and odd rows
    rows += [("of the same " * 100, "en")] * 60 + [(" ".join(f"of the w{i % 40} x{j}" for j in range(60)), "en") for i in range(80)]
    rows += [(None, "en"), ("", None), (" ", "en"), ("one", "zz"), (None, None)]
    return rows


@pytest.mark.parametrize(("min_count", "sorted_rows"), [(5, 300_000), (5, 40), (40, 300)])
def test_equals_plain_counting(spark, monkeypatch, noisy, min_count, sorted_rows):
    monkeypatch.setattr(phrases, "_SORTED", sorted_rows)
    docs = spark.createDataFrame(noisy, "text string, lang string")
    found = phrases.collocations(docs, min_count, top=300)
    assert sorted(map(tuple, found.collect())) == plain(noisy, min_count, 300)


def test_a_filter_that_lets_everything_pass_changes_nothing(spark, monkeypatch, noisy):
    docs = spark.createDataFrame(noisy, "text string, lang string")
    monkeypatch.setattr(phrases, "frequent_filter", lambda counts, min_count: b"\xff" * (phrases._FILTER_BITS // 8))
    assert sorted(map(tuple, phrases.collocations(docs, 40).collect())) == plain(noisy, 40)


def test_share_of_a_longer_phrase(spark, noisy):
    docs = spark.createDataFrame(noisy, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(docs, 30, share=50).collect())) == plain(noisy, 30, share=50)


def test_odd_rows_and_an_empty_table(spark):
    docs = odd_documents(spark)
    assert sorted(map(tuple, phrases.collocations(docs, 2).collect())) == plain([(r["text"], r["lang"]) for r in docs.collect()], 2)
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_quicksort_counts_every_frequent_prefix():
    rnd = np.random.default_rng(1)
    words, weight = rnd.integers(-1, 3, (400, 4)), rnd.integers(1, 5, 400)
    for place in range(1, 4):
        words[words[:, place - 1] < 0, place] = -1
    want = Counter()
    for row, n in zip(words.tolist(), weight.tolist()):
        for size in range(1, 5):
            if row[size - 1] >= 0:
                want[tuple(row[:size])] += n
    got = {tuple(words[row, :size].tolist()): n for row, size, n in phrases.quicksorted(words, weight, 4, 20)}
    assert got == {p: n for p, n in want.items() if n >= 20}


def test_products_beyond_64_bits(spark):
    """A count near 10^11 in 10^12 words: floor(1000 a n / (l r)) needs some 27 digits."""
    a, left, n = 99_999_999_977, 99_999_999_989, 1_000_000_000_039
    counts = spark.createDataFrame([("en", "a", 1, left), ("en", "b", 1, left), ("en", "a b", 2, a)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    (row,) = phrases.scored(counts, totals).collect()
    assert row["score"] == 1000 * a * n // (left * left)


def test_languages_named_like_words_or_parted_by_spaces_are_counted_apart(spark):
    """The word "de" in "en" is not the word "en" in "de", nor is "a b" in "x y" that in "y x", or in "" that in " "."""
    rows = [("x de x. de de", "en")] * 7 + [("x en x. en en", "de")] * 11 + [("es fr", "")] * 3
    rows += [("a b", lang) for lang in ("x y", "y x", "x", "x ", "", " ", "\t") for _ in range(4)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert sorted(map(tuple, phrases.collocations(docs, 3).collect())) == plain(rows, 3)
