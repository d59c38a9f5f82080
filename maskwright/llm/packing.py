"""Packing documents into token sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Words, flat, slices, staged

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 4096
#: Words (some 50 bytes each) that a Python worker remembers; beyond, it starts to remember anew.
_REMEMBERED = 2_500_000
_CALL = 2000


class _Parted(Words):
    """Words, with a sign at the end of a word behind a Latin letter (ASCII, or U+00C0 to U+00FF) as a word of its own:
    the tokenizer parts there anyway, and fewer words differ."""

    def __init__(self, column: pa.Array):
        super().__init__(column, hashed=False)
        last, before, lead = (self.data[np.maximum(self.end - k, 0)] for k in (1, 2, 3))
        letter = (before | 32) - np.uint8(ord("a")) < 26
        letter |= (lead == 0xC3) & (before > 127) & (before != 0x97) & (before != 0xB7) & (self.end - self.start > 2)
        signs = np.flatnonzero((self.end - self.start > 1) & _SIGN[last] & letter)
        ends = self.end.copy()
        ends[signs] -= 1
        self.start = np.insert(self.start, signs + 1, self.end[signs] - 1)
        self.end = np.insert(ends, signs + 1, self.end[signs])
        self.of = self.of + np.searchsorted(signs, self.of)
        self.text = np.repeat(np.arange(len(column)), np.diff(self.of))
        self.hash = self._hashes()


_SIGN = np.zeros(256, bool)
_SIGN[list(b".,;:!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class _Encoder:
    """Token ids by white-space separated word. The tokenizer drops white space and never joins over it, so a
    text's ids are those of its words, and a word is encoded once.

    Words are looked up by 64 bits of hash, all of a slice of texts at a time; their lengths and first bytes are
    compared too, and a text with a word that differs there from the one known goes to the tokenizer as it is. New words
    go to the tokenizer many to a call, parted by bars: a bar between spaces is a token of its own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.hash, self.mark, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.begins, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """Encode new words, and lay their ids behind those that are known."""
        ids, sizes, at = [self.ids], [self.sizes], 0
        while at < len(words):
            to = at
            while to < len(words) and to - at < _CALL and b"|" not in words[to]:
                to += 1
            to = max(to, at + 1)
            text = b" | ".join(words[at:to]).decode()
            (encoded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)  # without places in the text
            found = np.array(encoded.ids, np.uint32)
            bars = np.flatnonzero(found == self.bar) if to - at > 1 else np.zeros(0, np.int64)
            sizes.append(np.diff(np.concatenate([[-1], bars, [len(found)]])) - 1)
            ids.append(np.delete(found, bars))
            if len(sizes[-1]) != to - at:
                raise ValueError("the tokenizer joins over white space")
            at = to
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _lowered(self, texts: pa.Array) -> Words:
        """The words of all texts. The tokenizer ignores case, but for its special tokens; A-Z in texts without
        such a token are lower case here, which makes fewer different words. Texts with combining marks (U+0300 to
        U+036F, which some letters join in lower case only) are left as they are."""
        data, offsets = flat(texts)
        sizes = np.diff(offsets)
        text = np.repeat(np.arange(len(texts)), sizes)
        kept = np.bincount(text[(data == 0xCC) | (data == 0xCD)], minlength=len(texts)) > 0
        kept[text[:-1][(data[:-1] == ord("<")) & (data[1:] == ord("|"))]] = True
        data = np.where(np.repeat(kept, sizes), data, _LOWER[data])
        return _Parted(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data)))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.hash) > _REMEMBERED:
            self.forget()
        words = self._lowered(texts)
        size = words.end - words.start
        padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
        first = np.zeros(len(words), np.uint64)
        for k in range(min(6, int(size.max()) if len(size) else 0)):
            first |= np.where(size > k, padded[words.start + k], 0).astype(np.uint64) << np.uint64(8 * k)
        mark = first | size.astype(np.uint64) << np.uint64(48)
        hashes, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hash)
        known[inside] = self.hash[place[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = words.data.tobytes()
            where = at[new]
            numbers = len(self.sizes) + np.arange(len(new))
            self.learn([raw[a:b] for a, b in zip(words.start[where].tolist(), words.end[where].tolist(), strict=True)])
            self.hash = np.insert(self.hash, place[new], hashes[new])
            self.mark = np.insert(self.mark, place[new], mark[where])
            self.number = np.insert(self.number, place[new], numbers)
            place = np.searchsorted(self.hash, hashes)
        place = place[inverse]
        other = np.unique(words.text[self.mark[place] != mark])
        ids, ends = self._gathered(self.number[place], words.of)
        found = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in other.tolist():
            found[i] = np.array([*self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, END_ID], np.uint32)
        return found

    def _gathered(self, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and where each text starts and ends."""
        sizes = self.sizes[words]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = upto[of] + np.arange(len(of))
        out = np.full(int(ends[-1]), END_ID, np.uint32)
        text = np.repeat(np.arange(len(of) - 1), np.diff(of))
        target = np.arange(int(upto[-1])) + np.repeat(text, sizes)
        out[target] = self.ids[np.arange(int(upto[-1])) + np.repeat(self.begins[words] - upto[:-1], sizes)]
        return out, ends


_encoders: dict[str, _Encoder] = {}


def cut_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenize every whole text, end it with id 1, and cut it into full sequences and one rest.

    Returns doc_id, start, length, ids_crc32, doc_tokens and ``_row``, a number for each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core to a task
        if tokenizer not in _encoders:
            _encoders[tokenizer] = _Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        number = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text"):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(pc.fill_null(part.column("text"), "")), strict=True):
                raw = memoryview(ids.astype("<u4").tobytes())
                for a in range(0, len(ids), sequence):
                    b = min(a + sequence, len(ids))
                    rows.append((doc, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), len(ids), number))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_row"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(cut, ", ".join(f"{n} long" for n in names))


class Bins:
    """Bins of equal capacity in a tournament tree: each node holds the largest free room below it."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Place ``size`` in the first bin that has room; its number and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had, leaf = room[at], at - self.leaves
        room[at] = had - size
        while at > 1:
            at //= 2
            largest = max(room[2 * at], room[2 * at + 1])
            if room[at] == largest:
                break
            room[at] = largest
        return leaf, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items larger than ``capacity`` are an error."""
    if len(sizes) and sizes.max() > capacity:
        raise ValueError("an item is larger than a bin")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Bins(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], had = tree.put(int(sizes[i]))
        offsets[i] = capacity - had
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Full pieces are sequences of their own. The rest of each document goes to a group drawn by hash, about
    ``group_docs`` documents whatever the table holds, and each group is packed on its own by first-fit decreasing.
    A null or empty text is its end id alone; rows with one doc_id are packed as documents of their own; an empty
    table gives no rows. A piece keeps its row if tasks are run again, since pieces are stored before they are dealt."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = staged(cut_pieces(docs, tokenizer, sequence))
    groups = max(1, round(pieces.filter("start = 0").count() / group_docs))
    rest = pieces.filter(F.col("length") < sequence)
    rest = rest.withColumn("_group", F.pmod(F.xxhash64("_row", "ids_crc32"), F.lit(groups)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("_row", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), sequence)
        first = group.column("_group")[0].as_py() << 24
        return group.select(columns).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    packed = rest.groupBy("_group").applyInArrow(fill, ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"]))
    full = pieces.filter(F.col("length") == sequence)
    return full.select(*columns, (F.col("_row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).union(packed)
