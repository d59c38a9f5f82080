import math
import random
from collections import Counter

import numpy as np
from helpers import odd_documents, words

from maskwright.llm.common import binomial_tail
from maskwright.llm.licenses import FAMILIES, TEMPLATES, license_paragraphs, tokens, train
from maskwright.llm.quality import STEPS, certified_cutoff, kept_documents, losses_allowed, quality_verdicts, shares_of_doubt


def plain_counts(text):
    own, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    again = set()
    for i in range(len(own) - 4):
        if seen[tuple(own[i : i + 5])] > 1:
            again |= set(range(i, i + 5))
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [rng.choice([" ", "\n", "\t\r\n"]).join(rng.choice(["a", "b", "ç#", "🙂", "d|*"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    docs = odd_documents(spark, [*texts, None, "x " * 3000, " ".join(map(str, range(5000)))])
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    got = quality_verdicts(docs, labels).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    want = sorted(((r.doc_id, *plain_counts(r.text)) for r in docs.collect()), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)  # one label certifies nothing
    assert quality_verdicts(docs.limit(0), labels.limit(0)).count() == 0


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.05), (300, 12, 0.06)):
        assert math.isclose(binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_cutoffs_keep_their_risk():
    good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
    good[2], bad[20] = 3000, 100
    assert certified_cutoff(good, bad, 0.01, 1e-5) == 11  # the middle of the gap
    good[2] = 300
    assert certified_cutoff(good, bad, 0.01, 1e-5) is None  # too few to certify 1 %
    bad[:] = 0
    assert certified_cutoff(good, bad, 0.5, 1e-5) is None  # nothing to win
    rng, missed = np.random.default_rng(0), 0
    true = np.linspace(0.2, 0, STEPS + 1)  # share of good documents above each step
    for _ in range(300):
        values = np.searchsorted(-true, -rng.random(500))
        g = np.bincount(np.minimum(values, STEPS), minlength=STEPS + 1)
        c = certified_cutoff(g, np.full(STEPS + 1, 1000), 0.05, 0.05 / STEPS)
        missed += c is not None and (np.searchsorted(-true, -rng.random(20000)) > c).mean() > 0.055
    assert missed <= 15


def test_junk_goes_and_clean_documents_stay(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        own = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 80))]
        junk = i % 6 == 0
        rows.append((i, " ".join(f"{w}###" if junk else w for w in own), "en", "s", 1))
        labels.append((i, 0 if junk else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = kept_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, q in labels if q}


def test_small_strata_get_their_cutoffs(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for lang, good, bad in (("en", 2000, 200), ("de", 300, 30), (None, 300, 30), ("xx", 20, 10)):
        for i in range(good + bad):
            own = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 80))]
            rows.append((len(rows), " ".join(f"{w} ###" if i < bad and k % 2 else w for k, w in enumerate(own)), lang, "s", 1))
            labels.append((len(labels), int(i >= bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in kept_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    good = {i for i, q in labels if q}
    few = {r[0] for r in rows if r[2] == "xx"}  # too few to certify: only the base rules hold
    assert kept - few == good - few and few <= kept


def test_doubt_is_shared_among_strata_that_can_be_certified():
    assert shares_of_doubt({1000: 1, 3: 500}, 0.05, 0.05) == 1 and shares_of_doubt({1000: 4, 10: 9}, 0.05, 0.05) == 4
    assert [losses_allowed(n, 0.05, 0.05) for n in (0, 58, 59)] == [-1, -1, 0] and losses_allowed(246, 0.05, 0.0125) > 0


def test_licenses_are_named_and_confirmed(spark):
    lines = [("x", t, f) for f, family in TEMPLATES.items() for t in family]
    texts = [f"some text here\n{t}\nmore of it" for _, t, _ in lines] + ["The license of the driver was lost in the park.", "permission granted by the software of a copy", None, ""]
    docs = odd_documents(spark, texts)
    got = {(r.doc_id, r.paragraph): r for r in license_paragraphs(docs).collect()}
    for i, (_, _, family) in enumerate(lines):
        assert (got[i, 1].family, got[i, 1].confirmed) == (family, True)
    assert {d for d, _ in got if d is not None} == set(range(len(lines)))
    assert license_paragraphs(docs.limit(0)).count() == 0


def test_classifier_on_held_out_variations():
    model, rng = train(["plain words of no licence at all"] * 5), random.Random(8)
    right = total = 0
    for label, family in enumerate(TEMPLATES.values()):
        for t in family:
            own = tokens(t)
            if len(own) > 8:
                own = own[: rng.randrange(len(own))] + ["noise"] + own[rng.randrange(1, 4) :]
                right += int(np.argmax(model.probabilities([own])[0])) == label
                total += 1
    assert right / total > 0.9 and len(FAMILIES) == model.weights.shape[1] - 1
