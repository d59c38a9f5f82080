import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import odd_documents, words

from maskwright.llm import mixing, packing
from maskwright.llm.packing import END_ID, SEQUENCE, first_fit_decreasing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Reshare the excess over twice the size again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, fixed, left = {}, set(), share * sum(sizes.values())
    while len(fixed) < len(sizes):
        open_ = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            fixed.add(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("block", [7, 1024])
def test_mix_meets_targets(spark, block):
    docs = odd_documents(spark)
    plan = mixing.mix(docs, block_words=block)
    got = mixing.taken_words(plan).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = plain_targets(sizes)
    assert len(got) == docs.count()
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.taken_words(mixing.mix(docs, block_words=block)).collect()))


def test_schedule_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "en", f"s{i % 5}", 100) for i in range(1000)], "doc_id long, text string, lang string, source string, n_chars long")
    pieces = mixing.mix(docs, block_words=20).pieces.collect()
    blocks = {(p.source, p.block): p.slot for p in pieces}
    assert len({slot for slot in blocks.values()}) >= 0.98 * len(blocks)
    total = defaultdict(int)
    for source, _ in blocks:
        total[source] += 1
    half = len(blocks) // 2
    for source, count in total.items():
        early = sum(1 for (s, _), slot in blocks.items() if s == source and slot < half)
        assert abs(early - count / 2) <= 8  # the discrepancy of the points, not sqrt(n)


def test_mixed_documents_carry_the_words(spark):
    docs = odd_documents(spark)
    want = sum(r.taken for r in mixing.taken_words(mixing.mix(docs)).collect())
    rows = mixing.mixed_documents(docs)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(len(words(r.text)) for r in rows.collect()) == want
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 57, 400):
        sizes = rng.integers(1, 101, n)
        bins, offsets = first_fit_decreasing(sizes, 100)
        room = []
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (at, 100 - room[at])
            room[at] -= sizes[i]


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "Don't  STOP now x <|endoftext|> é ́a İ ΑΣ\n12 a\x1cb", "漢字🙂", "tok " * 5000, "A", "A"]
    docs = odd_documents(spark, texts)
    want = sorted(map(repr, ([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, END_ID] for r in docs.collect())))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    rows = packing.pack(docs, group_docs=4).collect()
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for spans in by_sequence.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
        assert sum(n for _, n in spans) <= SEQUENCE
    pieces = []
    for text in want:
        ids = eval(text)
        for a in range(0, len(ids), SEQUENCE):
            part = ids[a : a + SEQUENCE]
            pieces.append((a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert sorted(pieces) == sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0
