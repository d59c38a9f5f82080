import random
from collections import Counter

from helpers import odd_documents, words

from maskwright.llm.common import components
from maskwright.llm.similarity import document_classes, least_matches, one_of_each_class


def plain_classes(rows, width=5, threshold=0.8):
    def grams(text):
        own = words(text)
        return {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()

    texts = sorted({t or "" for _, t in rows})
    sets = [grams(t) for t in texts]
    root, links = list(range(len(texts))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    at = {t: i for i, t in enumerate(texts)}
    least, copies = {}, Counter(t or "" for _, t in rows)
    for d, t in rows:
        r = find(at[t or ""])
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[find(at[t or ""])], links[at[t or ""]], copies[t or ""]) for d, t in rows), key=repr)


def near_copies(rng):
    rows, base = [], [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 200))] for _ in range(25)]
    for i in range(600):
        own = list(rng.choice(base[:3] if i % 2 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 9])):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    return rows + [(1000, "a b c"), (1001, "a  b c"), (1002, "b a c"), (1003, ""), (1004, None), (None, rows[0][1]), (None, "a b"), (3, rows[3][1])]


def test_classes_equal_brute_force(spark):
    rows = near_copies(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, document_classes(docs).collect()), key=repr) == plain_classes(rows)


def test_one_of_each_class(spark):
    docs = odd_documents(spark)
    classes = {r.class_id for r in document_classes(docs).collect()}
    kept = one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(classes)
    assert document_classes(docs.limit(0)).count() == 0 and one_of_each_class(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_least_matches():
    assert least_matches(24, 0.8, 1e-9) < 24 * 0.8 / 2 and least_matches(216, 0.8, 1e-9) > 100
