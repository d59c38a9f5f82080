import hashlib
import random

from helpers import odd_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import bpe

NASTY = [
    None, "", " ", "  ", "a  b", "a \n b", "a\n \nb", "it's 's I'll'd\t\t x ", "x<|endoftext|>y <|endoftext|> <|endoftext|", "<|endoftext|>",
    "\0special:<|endoftext|>", "\0special:x", "ab" * 9000, " " * 50 + "x", "　 x　　y", "a 　b", "don't  can't", "\x1c a\x1c\x1d b", "\x85 a \x85b",
    " \x1cb", "漢字 かな 🙂🙂 é é", "x² ½ ٣٤ 12345", "A\r\nB\r\n\r\n  C", "� ﻿x", "<|endoftext|", "tail ",
]


def library():
    tokenizer = Tokenizer.from_file(bpe.default_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_equals_the_library(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(None, "no id"), (2, " "), (2, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    tokenizer, want = library(), []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=repr) == sorted(want, key=repr)


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    texts = sorted((r["text"] or "" for r in docs.collect()))
    assert sorted(r["text"] for r in bpe.decode(bpe.encode(docs)).collect()) == texts
    assert bpe.round_trip(docs.limit(0)).collect() == []


def test_signs_are_parted_as_the_library_does():
    signs = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 16)]]
    texts = ["".join(f"a{c}1 {c}\n{c}!" for c in signs[i : i + 64]) for i in range(0, len(signs), 64)]
    ids, at = bpe.Vocabulary(bpe.default_path()).encode(texts)
    want = library().encode_batch(texts, add_special_tokens=False)
    assert all(ids[at[i] : at[i + 1]].tolist() == one.ids for i, one in enumerate(want))


def test_queue_equals_merging_the_best_pair_again_and_again():
    vocabulary, rnd = bpe.Vocabulary(bpe.default_path()), random.Random(3)
    for _ in range(300):
        part = bytes(rnd.choice(b"aabbethin \xc3\xa9") for _ in range(rnd.randrange(1, 30)))
        symbols = [vocabulary.first[b] for b in part]
        while True:
            ranked = [(vocabulary.ranks[a][b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if b in vocabulary.ranks[a]]
            if not ranked:
                break
            rank, i = min(ranked)
            symbols[i : i + 2] = [vocabulary.merged[rank]]
        assert vocabulary.merge(part) == symbols


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 3)
    vocabulary = bpe.Vocabulary(bpe.default_path())
    first = [vocabulary.encode([t])[0].tolist() for t in ("one two three", "four five six", "one two three")]
    assert first[0] == first[2] and vocabulary.decode(first[1]) == "four five six"


def test_ids_that_are_no_text(spark):
    df = spark.createDataFrame([(1, [0xE9 - 0x21, 50256]), (2, None), (3, [])], "doc_id long, ids array<int>")
    want = library()
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()}
    assert texts == {1: want.decode([0xE9 - 0x21, 50256], skip_special_tokens=False), 2: "", 3: ""}
