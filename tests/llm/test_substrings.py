import random

import numpy as np
import pytest
from helpers import odd_documents, words

from maskwright.llm.fm_index import Index, suffix_order
from maskwright.llm.substrings import dealt_segments, remove_repeats, search_shard


def plain_removal(rows, width):
    first = {}
    for doc, text in rows:
        own = words(text)
        for i in range(len(own) - width + 1):
            key = tuple(own[i : i + width])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if doc is None else doc)
    out = []
    for doc, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - width + 1):
            if first[tuple(own[i : i + width])] < (1 << 62 if doc is None else doc):
                gone[i : i + width] = [True] * width
        out.append((doc, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g)))
    return sorted(out, key=repr)


def test_suffix_order_and_backward_search():
    rng = np.random.default_rng(0)
    symbols = np.append(rng.integers(1, 5, 299), 0)
    order = suffix_order(symbols, 300)
    assert [tuple(symbols[i:]) for i in order] == sorted(tuple(symbols[i:]) for i in range(300))
    index = Index(symbols, np.zeros(300, np.int32), 5, 300)
    text = symbols.tolist()
    for _ in range(50):
        pattern = rng.integers(1, 5, 3)
        low, high = np.array([0]), np.array([300])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        assert high[0] - low[0] == sum(text[i : i + 3] == pattern.tolist() for i in range(298))


@pytest.mark.parametrize("limit", [40, 10_000])
def test_search_shard_equals_brute_force(limit):
    rng = random.Random(limit)
    for _ in range(30):
        bodies = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(12)]
        owners = np.array([rng.randint(0, 5) for _ in bodies])
        query, start, stop = search_shard(bodies, owners, owners > 0, 4, limit)
        got = {(q, i) for q, a, b in zip(query, start, stop) for i in range(a, b)}
        want = set()
        for q, body in enumerate(bodies):
            own = body.split()
            for i in range(len(own) - 3):
                if any(owners[o] < owners[q] and (" " + " ".join(own[i : i + 4]) + " ") in f" {x} " for o, x in enumerate(bodies)):
                    want |= {(q, j) for j in range(i, i + 4)}
        assert got == want


def test_removal_equals_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 120))] for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(40):  # pieces of the others, edited copies, periodic texts
        own = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            own += b[a : a + rng.randint(0, 80)] + [f"x{rng.randint(0, 9)}"] * rng.randint(0, 2)
        rows.append((100 + i, "\n".join(own)))
    rows += [(90, "p q " * 60), (91, "q p " * 50), (92, "p q " * 60), (5, rows[5][1]), (None, rows[5][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, anchor in ((10, 3), (50, 8)):
        got = remove_repeats(docs, width=width, anchor=anchor, shard_words=300).collect()
        assert sorted(map(tuple, got), key=repr) == plain_removal(rows, width)


def test_a_common_phrase_is_not_one_shard(spark):
    rng = random.Random(12)
    phrase, passage = [f"p{i}" for i in range(4)], [f"q{i}" for i in range(14)]  # the second is longer than a window
    rows = []
    for i in range(200):
        own = [[f"w{rng.randint(0, 9999)}" for _ in range(12)] for _ in range(3)]
        rows.append((rng.randint(0, 150), " ".join(own[0] + phrase + own[1] + passage + own[2])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, anchor in ((10, 3), (10, 8)):
        got = remove_repeats(docs, width=width, anchor=anchor, shard_words=400).collect()
        assert sorted(map(tuple, got), key=repr) == plain_removal(rows, width)
    bodies = [(1, i, i, "x", 30) for i in range(100)] + [(2 + i // 2, i, i, "x", 30) for i in range(100)]
    cold, hot = dealt_segments(spark.createDataFrame(bodies, "anchor long, body_mark long, owner long, body string, size long"), 400)
    assert {r.anchor for r in hot.collect()} == {1} and cold.count() == 100
    assert max(r[1] for r in cold.groupBy("_shard").sum("size").collect()) <= 1200


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = remove_repeats(docs, width=5, anchor=2)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_removal([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert remove_repeats(docs.limit(0)).count() == 0
