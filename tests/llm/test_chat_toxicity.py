import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import odd_documents
from pyspark.sql import functions as F

from maskwright.llm.chat import formatted_chats
from maskwright.llm import toxicity as T
from maskwright.llm.common import Words
from maskwright.llm.toxicity import bags, toxicity


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("bot", "hello"), ("user", "more"), ("bot", None)]
    rows = [(c, t, *turns[t]) for c, n in ((5, 1), (4, 2), (7, 4), (2, 4), (9, 3)) for t in range(n)]
    rows += [(11, 0, "user", "hi"), (11, 1, "bot", "other"), (12, 0, "user", "hi\n"), (None, 3, None, "x"), (None, None, "user", "first"), (13, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = {r.conv_id: r for r in formatted_chats(df).collect()}
    assert set(got) == {2, 11, 12, None}
    assert (got[2].n_turns, got[2].logged) == (4, 2) and got[None].n_turns == 2
    assert got[2].text.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nhello<|im_end|>\n") and got[2].text.endswith("bot\n<|im_end|>\n")
    assert formatted_chats(df.limit(0)).count() == 0


def test_bags_have_the_ngrams_of_their_word():
    both = bags([b"idiot,", b"a", b"", "Äß".encode()])
    alone = bags([b"Idiot"])
    assert sorted(both.grams[both.word == 0]) == sorted(alone.grams)
    assert (both.word == 1).sum() == 1 and (both.word == 2).sum() == 0 and (both.word == 3).sum() == 3


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(2000)]
    rows = []
    for i in range(n):
        own = list(rng.choice(vocabulary, rng.integers(1, 200)))
        toxic = i % 5 == 0
        if toxic:
            own.insert(rng.integers(0, len(own) + 1), "zorkum" + "".join(rng.choice(list("klmnop"), 3)))
        rows.append((i, " ".join(own), int(toxic)))
    return rows


def test_unseen_spellings_are_found(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9999, None), (None, "zorkumxyz")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) + 2
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    known = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) > 0.98
    assert {r.doc_id: r.predicted for r in got}[None] == 1 and {r.doc_id: r.predicted for r in got}[9999] == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = corpus(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    a, b = (spark.createDataFrame([(i, 1 - y if o and flip else y) for (i, _, y), o in zip(rows, out)], "doc_id long, toxic int") for flip in (False, True))
    assert sorted(toxicity(docs, a).collect()) == sorted(toxicity(docs, b).collect())
    assert toxicity(odd_documents(spark), a.limit(0)).agg(F.max("score")).first()[0] < 0.01
    assert toxicity(docs.limit(0), a).count() == 0


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    table, softmax, bias = rng.standard_normal((5, 3)), rng.standard_normal((3, 2)), rng.standard_normal(2)
    entries = rng.integers(0, 6, 20), rng.integers(0, 5, 20), rng.random(20)
    y, share = np.array([0, 1, 1, 0, 1, 0]), rng.random(6)
    _, gradients = T.loss_and_gradient(table, softmax, bias, entries, y, share)
    for parameter, gradient in zip((table, softmax, bias), gradients):
        for at in np.ndindex(parameter.shape):
            values = []
            for step in (1e-6, -2e-6):
                parameter[at] += step
                values.append(T.loss_and_gradient(table, softmax, bias, entries, y, share)[0])
            parameter[at] += 1e-6
            assert abs((values[0] - values[1]) / 2e-6 - gradient[at]) < 1e-6


def test_averages_and_scores_equal_plain_ones(spark):
    """Word by word and n-gram by n-gram, with texts that are empty, null, repeated or without n-grams."""
    texts = ["idiot an idiot, you", "", None, "a", "<|> ..", "Äpfel und Birnen", "idiot an idiot, you", "x" * 3000]
    words = Words(pa.array(texts, pa.string()))
    text, bucket, weight = T.averages(words)
    got, want = {}, {}
    for t, b, w in zip(text.tolist(), bucket.tolist(), weight.tolist()):
        got[t, b] = w
    for t, value in enumerate(texts):
        parts = (value or "").split()
        for part in parts:
            grams = bags([part.encode()]).grams.tolist()
            for g in grams:
                want[t, g] = want.get((t, g), 0) + 1 / len(grams) / len(parts)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    model = T.Model(np.random.default_rng(2).standard_normal(T.BUCKETS).astype(np.float32), -0.3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in T.scored(docs, model).collect():
        odds = model.bias + sum(w * float(model.bucket[b]) for (t, b), w in want.items() if t == row.doc_id)
        assert abs(row.score - 1 / (1 + np.exp(-odds))) < 1e-6


def test_held_out_rows_of_the_given_tables(spark):
    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("the given tables are not here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.9 and hit / sum(r.toxic for r in rows) > 0.8
