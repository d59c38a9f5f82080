"""Collocations: frequent phrases by a multikey three-way quicksort of suffixes, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import Words, flat, mixed, slices, staged

DEPTH = 5
MIN_COUNT = 100
TOP = 2000
_SLICE = 1 << 20
#: Bits of each filter, of frequent words and of frequent pairs, that every task gets: 4 MB, whatever the input.
_FILTER_BITS = 1 << 25
_BLOCK_BITS = 1 << 15
#: Counts that a task gathers before it combines them.
_COUNTS = 1 << 20
#: Rows that a task hands over at once.
_BATCH = 1 << 16
#: Bits of the hashes that are counted. Words or pairs that share them may pass the filter together, and are counted
#: apart later.
_KEY = np.uint64((1 << 40) - 1)
#: Different suffixes that a task gathers before it hands them over.
_SUFFIXES = 1 << 19
#: Suffixes that a task sorts, on average.
_SORTED = 300_000

# What parts pieces becomes a line feed, what parts words a space, and A-Z a-z.
_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[ord("A") : ord("Z") + 1] += 32
_SIGNS[[9, 32]] = 32
_SIGNS[[*map(ord, ".,;:!?"), *range(10, 14)]] = 10
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Pieces(Words):
    """Lower-cased words and the piece each lies in. ``hash`` depends on the language too."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = flat(texts)
        self.lang = langs.dictionary_encode()
        super().__init__(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(_SIGNS[data])), lines=True)
        # Another hash than the words', or the word "en" in "de" would equal the word "de" in "en".
        names = self.lang.dictionary.to_pylist()
        salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest()) for x in names], np.uint64)
        self.word_lang = self.lang.indices.to_numpy()[self.text] if len(texts) else np.zeros(0, np.int64)
        self.hash = mixed(self.hash + salt[self.word_lang])

    def pairs(self) -> np.ndarray:
        """Hash of each word and its follower; 0 at the end of a piece."""
        found = np.zeros(len(self), np.uint64)
        same = self.line[1:] == self.line[:-1]
        found[:-1] = np.where(same, mixed(self.hash[:-1] * _MULTIPLIER + self.hash[1:]) | np.uint64(1), np.uint64(0))
        return found


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, _BATCH):
        yield batch.slice(at, _BATCH)


def hashed_counts(docs: DataFrame, keys: Callable[[Pieces], np.ndarray]) -> DataFrame:
    """(lang, key, n): words per language where key is null, occurrences of each of ``keys`` elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, words = [], 0, {}

        def combined() -> tuple[np.ndarray, np.ndarray]:
            return _summed([k for k, _ in held], [n for _, n in held])

        def batch(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = [pa.nulls(len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())]
            return _cut(pa.RecordBatch.from_arrays(columns, names=["lang", "key", "n"]))

        for part in slices(batches, "text", _SLICE):
            found = Pieces(part.column("text"), part.column("lang"))
            names = found.lang.dictionary.to_pylist()
            for i, n in enumerate(np.bincount(found.word_lang, minlength=len(names)).tolist()):
                words[names[i]] = words.get(names[i], 0) + n
            held.append(np.unique(keys(found) & _KEY, return_counts=True))
            count += len(held[-1][0])
            if count > _COUNTS:
                held = [combined()]
                if len(held[0][0]) > _COUNTS // 2:
                    yield from batch(*held.pop())
                count = sum(len(k) for k, _ in held)
        if held:
            yield from batch(*combined())
        columns = [pa.array(list(words), pa.string()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "key", "n"])

    return docs.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def frequent_pairs(found: Pieces, words: np.ndarray) -> np.ndarray:
    """The pairs of ``found`` whose two words may both be frequent; others can't be."""
    may = _passes(words, found.hash)
    pairs = found.pairs()
    return pairs[(pairs > 0) & may & np.append(may[1:], False)] if len(pairs) else pairs


def frequent_filter(counts: DataFrame, min_count: int) -> bytes:
    """A bitmap over the hashes of words and pairs with ``min_count`` occurrences: none of them is missed, and few
    others pass while they are few against its bits. Its size is fixed; what passes in vain is counted out later."""
    bit = F.pmod("key", F.lit(_FILTER_BITS))
    bits = counts.filter(F.col("key").isNotNull() & (F.col("n") >= min_count)).select(
        F.expr(f"cast(pmod(key, {_FILTER_BITS}) div {_BLOCK_BITS} as int)").alias("block"), (bit % _BLOCK_BITS).cast("int").alias("bit")).distinct()

    def block(group: pa.Table) -> pa.Table:
        flags = np.zeros(_BLOCK_BITS, bool)
        flags[group.column("bit").to_numpy()] = True
        return group.slice(0, 1).select(["block"]).append_column("bits", pa.array([np.packbits(flags).tobytes()]))

    found = np.zeros(_FILTER_BITS // 8, np.uint8)
    size = _BLOCK_BITS // 8
    for row in bits.groupBy("block").applyInArrow(block, "block int, bits binary").collect():
        found[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return found.tobytes()


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(_FILTER_BITS - 1)
    return (bitmap[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def suffixes(docs: DataFrame, frequent: Broadcast, depth: int) -> DataFrame:
    """(lang, suffix, n): what stands from each word on, up to ``depth`` words of its piece and to the first pair that
    can't be frequent; equal ones of a task in few rows. Each word of a suffix is followed by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_pairs = (np.frombuffer(x, np.uint8) for x in frequent.value)
        held = _Suffixes()
        for part in slices(batches, "text", _SLICE):
            words = Pieces(part.column("text"), part.column("lang"))
            if not len(words):
                continue
            pairs = words.pairs()
            may = _passes(of_words, words.hash)
            goes_on = (pairs > 0) & _passes(of_pairs, pairs) & np.append(may[1:], False)
            length = may.astype(np.int64)
            key, going = words.hash.copy(), length > 0
            for step in range(1, depth):
                going[-step:] = False
                going[: len(going) - step] &= goes_on[step - 1 : len(going) - 1]
                at = np.flatnonzero(going)
                if not len(at):
                    break
                length[at] += 1
                key[at] = mixed(key[at] * _MULTIPLIER + words.hash[at + step] + np.uint64(step))
            at = np.flatnonzero(length)
            keys, first, n = np.unique(key[at], return_index=True, return_counts=True)
            held.add(words, keys, n, at[first], length[at[first]])
            if len(held.keys) > _SUFFIXES:
                yield from _cut(held.handed_over())
        if len(held.keys):
            yield from _cut(held.handed_over())

    return docs.mapInArrow(run, "lang string, suffix string, n long")


class _Suffixes:
    """Different suffixes of a task's slices, their languages, texts and numbers."""

    def __init__(self):
        self.keys, self.place, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.texts: list[bytes] = []
        self.langs: list[str] = []

    def add(self, words: Pieces, keys: np.ndarray, n: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        """Count the sorted ``keys`` ``n`` times; each is ``length`` words long at the word ``at``."""
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        self.n[self.place[where[known]]] += n[known]
        new = np.flatnonzero(~known)
        self.keys = np.insert(self.keys, where[new], keys[new])
        self.place = np.insert(self.place, where[new], len(self.n) + np.arange(len(new)))
        self.n = np.concatenate([self.n, n[new]])
        at, length = at[new], length[new]
        start, end = words.start[at], words.end[at + length - 1]
        sizes = np.concatenate([[0], np.cumsum(words.end - words.start)])
        plain = end - start == sizes[at + length] - sizes[at] + length - 1
        data = words.data.tobytes()
        texts = [data[a:b] + b" " for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        for i in np.flatnonzero(~plain).tolist():  # words that stand further apart
            texts[i] = b" ".join(filter(None, texts[i].split(b" "))) + b" "
        self.texts += texts
        names = words.lang.dictionary.to_pylist()
        self.langs += [names[i] for i in words.word_lang[at].tolist()]

    def handed_over(self) -> pa.RecordBatch:
        columns = [pa.array(self.langs, pa.string()), pa.array(self.texts, pa.binary()).cast(pa.string()), pa.array(self.n)]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "suffix", "n"])


def quicksorted(words: np.ndarray, weight: np.ndarray, depth: int, min_count: int) -> Iterator[tuple[int, int, int]]:
    """(row, length, count) of each prefix with ``min_count`` weight: three-way quicksort of pointers to the rows of
    ``words`` (a code per place, -1 behind the end), the weight of an equal part being the prefix's count.

    A part lighter than ``min_count`` holds no frequent prefix and is left unsorted. Equal parts go on one place
    further, up to ``depth`` places."""
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, at = todo.pop()
        while len(rows):
            codes = words[rows, at]
            pivot = codes[len(codes) // 2]
            equal = codes == pivot
            same = rows[equal]
            if pivot >= 0:
                count = int(weight[same].sum())
                if count >= min_count:
                    yield int(same[0]), at + 1, count
                    if at + 1 < depth:
                        todo.append((same, at + 1))
            less, more = rows[codes < pivot], rows[codes > pivot]
            heavy = [x for x in (less, more) if len(x) and weight[x].sum() >= min_count]
            todo += [(x, at) for x in heavy[1:]]
            rows = heavy[0] if heavy else rows[:0]


def phrase_counts(found: DataFrame, depth: int, min_count: int) -> DataFrame:
    """(lang, phrase, words, n) of all phrases with ``min_count`` occurrences, from stored (lang, suffix, n).

    Suffixes are dealt by ranges of (lang, words), so a leading word may have as many as it likes: those in the middle
    of a range are counted to the end there, and infrequent ones given up. A prefix of the first or last suffix of a
    range may go on in the next range, so its part is reported whatever it weighs, and parts are added up."""
    ranges = max(1, -(-found.count() // _SORTED))
    dealt = found.repartitionByRange(ranges, "lang", "suffix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        lang, suffix = table.column("lang").combine_chunks(), table.column("suffix").combine_chunks()
        weight = table.column("n").to_numpy()
        lists = pc.split_pattern(suffix, " ")
        codes = lists.flatten().dictionary_encode().indices.to_numpy()
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        length = np.diff(starts) - 1  # the last is empty, behind the last space
        words = np.full((len(table), depth + 1), -1, np.int64)
        words[:, 0] = lang.dictionary_encode().indices.to_numpy()
        for place in range(depth):
            has = length > place
            words[has, place + 1] = codes[starts[:-1][has] + place]
        ends = _least_and_greatest(lang, suffix)
        edge = {}
        for row in ends:
            inside = np.ones(len(words), bool)
            for place in range(int(length[row]) + 1):
                inside &= words[:, place] == words[row, place]
                if place:
                    edge[tuple(words[row, : place + 1])] = (row, place, int(weight[inside].sum()))
        out = list(edge.values())
        for row, size, n in quicksorted(words, weight, depth + 1, min_count):
            if size > 1 and tuple(words[row, :size]) not in edge:
                out.append((row, size - 1, n))
        names, texts = lang.take(pa.array([r for r, _, _ in out], pa.int64())), []
        for row, size, _ in out:
            texts.append(" ".join(suffix[row].as_py().split(" ")[:size]))
        columns = [names, pa.array(texts, pa.string()), pa.array([s for _, s, _ in out], pa.int32()), pa.array([n for _, _, n in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"])

    counted = dealt.mapInArrow(run, "lang string, phrase string, words int, n long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _least_and_greatest(lang: pa.Array, suffix: pa.Array) -> set[int]:
    """Rows of the first and last (lang, suffix) in the order of their bytes."""
    rows = set()
    for pick in (pc.min, pc.max):
        of_lang = np.flatnonzero(pc.equal(lang.cast(pa.binary()), pick(lang.cast(pa.binary()))).to_numpy(zero_copy_only=False))
        inner = suffix.take(pa.array(of_lang)).cast(pa.binary())
        rows.add(int(of_lang[pc.index(inner, pick(inner)).as_py()]))
    return rows


def scored(phrases: DataFrame, totals: DataFrame, share: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that remain, from (lang, phrase, words, n) and (lang, n).

    A candidate is cut after each of its words; the lowest floor(1000 a n / (l r)) counts, the first among equals. One
    that lies in a longer candidate with ``share`` percent of its occurrences goes; it is enough to look at those
    longer by one word, since what lies between is at least as frequent as the longer one. Products are decimals of
    38 digits: exact up to 10^11 words times 10^11 occurrences and well beyond."""
    candidates = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    inner = F.array(F.regexp_replace("phrase", "^[^ ]* ", ""), F.regexp_replace("phrase", " [^ ]*$", ""))
    longer = candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left")
    kept = kept.filter(F.coalesce(F.lit(100) * F.col("_longer") < F.lit(share) * F.col("a"), F.lit(True)))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), F.split("phrase", " ").alias("_words"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("_words", F.lit(1), F.col("k")), " ").alias("_left"),
                       F.array_join(F.slice("_words", F.col("k") + 1, F.size("_words")), " ").alias("_right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l")), ["lang", "_left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r")), ["lang", "_right"])
    cuts = cuts.join(totals.select("lang", "n"), "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alrn"}
    score = F.call_function("div", wide["a"] * wide["n"] * 1000, wide["l"] * wide["r"])
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n")
    best = best.agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    return best.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, depth: int = DEPTH, share: int = 100) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``depth`` words: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased in A-Z and stand in pieces between ``.,;:!?`` and line ends. ``n`` is the number of words of
    the language, ``a`` the phrase's occurrences, ``l`` and ``r`` those of its parts at the weakest cut. A null text
    has no words, a null language is ``und``, an empty one a language of its own; repeated rows count as often as they
    stand there; other columns are left out; an empty table gives no rows.

    Words are compared by 64 bits of hash within a slice of text, and by themselves from there on."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    share_out = docs.sparkSession.sparkContext.broadcast
    counts = staged(hashed_counts(texts, lambda found: found.hash))
    words = frequent_filter(counts, min_count)
    totals = counts.filter("key is null").select("lang", "n")
    shared = share_out(words)
    pairs = hashed_counts(texts, lambda found: frequent_pairs(found, np.frombuffer(shared.value, np.uint8)))
    both = share_out((words, frequent_filter(pairs, min_count)))
    phrases = staged(phrase_counts(staged(suffixes(texts, both, depth)), depth, min_count))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored(phrases, totals, share).withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
