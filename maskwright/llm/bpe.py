"""Byte-level BPE: encoding by a queue of merges over a linked list of symbols, decoding by the vocabulary's bytes."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices

#: How byte-level vocabularies of this kind part a text before merging (fixed by the vocabulary file).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Signs that part a word from what follows, and are a part of their own at the end of a run.
_ENDS = (".", ",", ";", ":", "!", "?")
#: Runs and parts (some 250 bytes each) whose ids a Python worker remembers; beyond, it starts to remember anew.
_REMEMBERED = 800_000
#: Before a special string's key, so that it is told from the same signs in a text (where it can't stand by itself).
_SPECIAL = "\0special:"


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: visible Latin-1 signs are themselves, the other
    bytes follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ranks and pieces of a byte-level vocabulary file; remembers the ids of parts it has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, signs = content["model"], byte_signs()
        ids: dict[str, int] = model["vocab"]
        self.first = [0] * 256
        for sign, byte in signs.items():
            self.first[byte] = ids[sign]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        pieces = ids | self.special
        #: rank by left and right symbol; the last entry, which -1 finds, has none
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(pieces.values()) + 2)]
        self.merged = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left]][ids[right]] = rank
            self.merged.append(ids[left + right])
        #: the same for two bytes, by both of them
        self.byte_ranks = [self.ranks[a].get(b) for a in self.first for b in self.first]
        self.pieces = [b""] * (max(pieces.values()) + 1)
        for piece, i in pieces.items():
            known = all(c in signs for c in piece)
            self.pieces[i] = bytes(signs[c] for c in piece) if known else piece.encode()
        self.parts = regex.compile(PARTS)
        # the longest special string wins where several start at one place
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.odd_space = re.compile(r" (?:\s|\Z)")
        self._forget()

    def merge(self, part: bytes) -> list[int]:
        """Merge neighbours by rank, the leftmost first among equals.

        A queue entry is a rank and, in its low bits, a place. It is stale, and skipped, if the pair that now starts at
        its place has another rank; symbols that were swallowed are -1, as is the end, and make no pair."""
        n, ranks, merged = len(part), self.ranks, self.merged
        symbols = list(map(self.first.__getitem__, part))
        shift = 12 if n < 4096 else 40
        of_bytes, queue, a = self.byte_ranks, [], part[0]
        for i, b in enumerate(part[1:]):
            rank = of_bytes[a << 8 | b]
            if rank is not None:
                queue.append(rank << shift | i)
            a = b
        if not queue:
            return symbols
        heapify(queue)
        symbols.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        mask = (1 << shift) - 1
        while queue:
            entry = heappop(queue)
            i = entry & mask
            j = after[i]
            rank = entry >> shift
            if ranks[symbols[i]].get(symbols[j]) != rank:
                continue
            symbols[i] = symbol = merged[rank]
            symbols[j] = -1
            after[i] = j = after[j]
            before[j] = i
            others = ranks[symbol]
            if others:
                rank = others.get(symbols[j])
                if rank is not None:
                    heappush(queue, rank << shift | i)
            i = before[i]
            rank = ranks[symbols[i]].get(symbol)
            if rank is not None:
                heappush(queue, rank << shift | i)
        return [s for s in symbols if s >= 0]

    def _learn(self, run: str, single: bool) -> int:
        """The number of a run, whose ids are laid behind those that are known; ``single`` if it is one part."""
        if single or run[1:].isalpha() and run[0] == " ":
            parts = [run]
        elif run[-1:] in _ENDS and run[1:-1].isalpha() and run[0] == " ":
            parts = [run[:-1], run[-1]]  # most runs with a sign, without a search
        else:
            parts = self.parts.findall(run)
        if len(parts) == 1:
            ids = self.merge(run.encode())
        else:
            ids = []
            for part in parts:
                number = self.known.get(part)
                number = self._learn(part, True) if number is None else number
                ids += self.ids[self.ends[number] : self.ends[number + 1]]
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.known[run] = number = len(self.ends) - 2
        return number

    def _plain(self, text: str) -> list[int]:
        """Numbers of the runs of a text without special strings. No part goes on over a space that a sign follows, so
        such a text is looked up from space to space, and other texts part by part."""
        odd = self.odd_space.search(text)
        if odd:
            runs = self.parts.findall(text)
        else:
            runs = text.split(" ")
            runs[1:] = [" " + run for run in runs[1:]]
        known = self.known.get
        numbers = list(map(known, runs))
        if None in numbers:
            for i, number in enumerate(numbers):
                if number is None:
                    run = runs[i]
                    number = known(run)
                    numbers[i] = self._learn(run, bool(odd)) if number is None else number
        return numbers

    def _numbers(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            return self._plain(text)
        numbers = []
        for i, piece in enumerate(self.cut.split(text)):
            numbers += [self.known[f"{_SPECIAL}{piece}"]] if i % 2 else self._plain(piece)
        return numbers

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])
        for piece, i in self.special.items():
            self.known[f"{_SPECIAL}{piece}"] = len(self.known)
            self.ids.append(i)
            self.ends.append(len(self.ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text starts and ends in them."""
        if len(self.known) > _REMEMBERED:
            self._forget()
        numbers = list(map(self._numbers, texts))
        runs = np.fromiter(chain.from_iterable(numbers), np.int64)
        ends, ids = np.array(self.ends), np.array(self.ids, np.int32)
        sizes = ends[runs + 1] - ends[runs]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        found = ids[np.arange(upto[-1]) + np.repeat(ends[runs] - upto[:-1], sizes)]
        return found, upto[np.cumsum([0, *map(len, numbers)])]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's bytes behind each other; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once a Python process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; ``path`` is a byte-level BPE vocabulary that each worker can read.

    Special strings in a text are their ids, none is added. Null and empty texts have no ids; rows are kept one for
    one, repeated ones too, whatever their doc_id; other columns are left out. A text of one unbroken run is merged
    in n log n steps."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found, at = vocabulary(path).encode(pc.fill_null(part.column("text"), "").to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text of each row's ids, special ones included. Null ids are none."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = vocabulary(path).decode
        for batch in batches:
            ids = batch.column("ids")
            starts, values = ids.offsets.to_pylist(), ids.values.to_pylist()
            texts = [decoder(values[a:b]) for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids of every text and of what they decode to: :func:`encode` and :func:`decode` in one pass, so
    that ids need not leave the worker. Rows as in :func:`encode`."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        numbers = [str(i) for i in range(len(words.pieces))]
        for part in slices(batches, "text"):
            found, at = words.encode(pc.fill_null(part.column("text"), "").to_pylist())
            rows = []
            for a, b in pairwise(at.tolist()):
                ids = found[a:b].tolist()
                listed = ",".join(map(numbers.__getitem__, ids)).encode()
                rows.append((b - a, sha256(listed).hexdigest(), sha256(words.decode(ids).encode()).hexdigest()))
            size, ids_digest, digest = zip(*rows)
            columns = [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids_digest), pa.array(digest)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
