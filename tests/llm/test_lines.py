import random

import numpy as np
from helpers import odd_documents, words

from maskwright.llm.lines import candidates, deduplicated_documents, with_lines_removed


def plain(rows, threshold=0.8):
    places = []
    for k, (doc, text) in enumerate(rows):
        for i, line in enumerate((text or "").split("\n")):
            if words(line):
                places.append(((1 << 63) - 1 if doc is None else doc, i, k, frozenset(words(line))))
    gone = set()
    for d, i, k, own in places:
        for e, j, m, other in places:
            if (e, j) < (d, i) and len(own & other) >= threshold * len(own | other) - 1e-9:
                gone.add((k, i))
                break
    out = []
    for k, (doc, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if (k, i) not in gone)
        out.append((doc, kept, sum(bool(words(x)) for x in lines), sum((k, i) in gone for i in range(len(lines)))))
    return sorted(out, key=repr)


def texts(rng):
    base = [[f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randint(1, 30))] for _ in range(60)]
    rows = []
    for d in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            own = list(rng.choice(base[:4] if rng.random() < 0.5 else base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 50)}"
            lines.append(rng.choice([" ", "\t"]).join(own))
            if rng.random() < 0.1:
                lines.append("  ")
        rows.append((d * 3, "\n".join(lines)))
    return rows


def test_lines_equal_brute_force(spark):
    rows = texts(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = with_lines_removed(docs, ["doc_id", "text"], group=50)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_rows_that_share_a_doc_id_or_have_none(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, None, d, 7]), text) for d, text in texts(rng)]
    rows += [(None, f"the same first line with a year in it {y}\n{' '.join(f'v{y}x{k}' for k in range(5))}") for y in range(1990, 2020)]
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").selectExpr("*", "xxhash64(text) as mark")
    rows = [(r.doc_id, r.mark, r.text) for r in docs.collect()]
    places = [(((1 << 63) - 1 if d is None else d, m, i), frozenset(words(x))) for d, m, t in rows for i, x in enumerate(t.split("\n")) if words(x)]
    want = []
    for d, m, t in rows:
        gone = [bool(words(x)) and any(p < ((1 << 63) - 1 if d is None else d, m, i) and len(o & set(words(x))) >= 0.8 * len(o | set(words(x))) - 1e-9 for p, o in places) for i, x in enumerate(t.split("\n"))]
        want.append((d, "\n".join(x for x, g in zip(t.split("\n"), gone) if not g), sum(bool(words(x)) for x in t.split("\n")), sum(gone)))
    got = with_lines_removed(docs.drop("mark"), ["doc_id", "text"], group=50)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_odd_rows(spark):
    docs = odd_documents(spark, ["", None, "a b\nb a\n\n", "a b", "x\r\nx", "solo", "漢字 🙂\n漢字 🙂"])
    docs = docs.filter("doc_id is not null")
    got = with_lines_removed(docs, ["doc_id", "text", "kept"]).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted(map(tuple, got.collect()), key=repr) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert with_lines_removed(docs.limit(0), ["doc_id", "text"]).count() == 0
    whole = odd_documents(spark)
    kept = deduplicated_documents(whole)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() <= whole.count()


def postings(rng, n, width):
    sizes = rng.integers(4, 200 if width else 8, n)
    words = np.maximum(1, 1 << np.ceil(np.log2(sizes / 64)).astype(int).clip(0))
    return {"word": rng.integers(0, 4, n), "doc": rng.permutation(n), "line": np.zeros(n, np.int64), "set": np.arange(n), "size": sizes,
            "position": rng.integers(0, 2, n), "probe": np.ones(n, bool), "tile": np.full(n, -1), "words": words,
            "start": np.cumsum(words) - words, "bits": rng.integers(0, 4, int(words.sum())).astype(np.uint64)}


def test_candidates_are_all_pairs_that_pass(monkeypatch):
    rng = np.random.default_rng(2)
    for width in (0, 1):
        rows = postings(rng, 120, width)
        got = candidates(rows, 0.8, None)

        def fold(k, w):
            out = [0] * w
            for x in range(rows["words"][k]):
                out[x % w] ^= int(rows["bits"][rows["start"][k] + x])
            return out

        want = set()
        for a in range(120):
            for b in range(120):
                need = int(np.ceil(0.8 / 1.8 * (rows["size"][a] + rows["size"][b]) - 1e-9))
                w = min(rows["words"][a], rows["words"][b])
                apart = sum((x ^ y).bit_count() for x, y in zip(fold(a, w), fold(b, w)))
                most = min(rows["position"][a], rows["position"][b]) + min(rows["size"][k] - rows["position"][k] for k in (a, b))
                if rows["word"][a] == rows["word"][b] and rows["doc"][a] > rows["doc"][b] and min(rows["size"][a], rows["size"][b], most) >= need and apart <= rows["size"][a] + rows["size"][b] - 2 * need:
                    want.add((a, b))
        assert set(zip(got["late"].tolist(), got["early"].tolist())) == want and want
        for limit in (1, 10**6):
            best = candidates(rows, 0.8, 2, limit)
            assert {a for a, _ in want} == set(best["late"].tolist()) and np.bincount(best["late"]).max() <= 2
            assert dict(zip(best["late"].tolist(), best["more"].tolist())) == {a: sum(x == a for x, _ in want) > 2 for a, _ in want}


def test_hot_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("maskwright.llm.lines.TILE", 8)
    rows = texts(random.Random(9))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, with_lines_removed(docs, ["doc_id", "text"], group=50).collect()), key=repr) == plain(rows)


def test_rare_first_is_the_full_order():
    from maskwright.llm.lines import _rare_first

    rng = np.random.default_rng(3)
    for spread in (1 << 63, 40):  # the second has words that differ in their last bits alone
        line, rank, word = np.sort(rng.integers(0, 50, 2000)), rng.integers(0, 5, 2000), rng.integers(0, spread, 2000).astype(np.uint64)
        got, want = _rare_first(line, rank, word), np.lexsort((word, rank, line))
        assert all((x[got] == x[want]).all() for x in (line, rank, word))
    assert len(_rare_first(line[:0], rank[:0], word[:0])) == 0


def test_lists_meet_only_sizes_in_reach(monkeypatch):
    """Before, each posting of a list was held against all before it."""
    from maskwright.llm import lines

    met, ragged = [], lines._ragged
    monkeypatch.setattr(lines, "_ragged", lambda start, length: met.append(int(length.sum())) or ragged(start, length))
    n = 1500
    rows = {"word": np.ones(n, np.int32), "doc": np.arange(n), "line": np.zeros(n, np.int64), "set": np.arange(n), "size": np.arange(10, n + 10), "position": np.zeros(n, np.int64),
            "probe": np.ones(n, bool), "tile": np.full(n, -1), "words": np.ones(n, np.int64), "start": np.arange(n), "bits": np.zeros(n, np.uint64)}
    got = candidates(rows, 0.8, None)
    want = {(a, b) for a in range(n) for b in range(a) if rows["size"][b] >= np.ceil(0.8 / 1.8 * (rows["size"][a] + rows["size"][b]) - 1e-9)}
    assert set(zip(got["late"].tolist(), got["early"].tolist())) == want
    assert len(want) <= sum(met) < n * (n - 1) // 4


def test_only_wanted_lines_are_read_again(spark):
    """Before, all lines of a document with one wanted line were cut into words and its text was shuffled."""
    from maskwright.llm.lines import _doc_keys, _line_keys, _word_sets, bitmap

    docs = spark.createDataFrame([(1, 5, "a b\nc d e\n\nf"), (2, 6, "c d e\nx"), (2, 7, "y z\nq"), (3, 8, None), (4, 9, "")], "doc long, mark long, text string")
    docs = docs.fillna("", ["text"])
    places = spark.createDataFrame([(1, 5, 1), (1, 5, 3), (2, 7, 0)], "doc long, mark long, line long")
    wanted = bitmap(places, lambda batch: np.concatenate([_doc_keys(batch), _line_keys(_doc_keys(batch), batch.column("line").to_numpy())]))
    rarity = np.zeros(1 << 18, np.int32)
    assert sorted(len(r["words"]) for r in _word_sets(docs, wanted, rarity).collect()) == [1, 2, 3]
    assert "Exchange" not in _word_sets(docs, wanted, rarity)._jdf.queryExecution().executedPlan().toString()
