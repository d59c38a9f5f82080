"""Substring dedup: repeated runs of words are found in an FM-index per shard and removed from later documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Words, growing, mixed, slices, staged, windows
from maskwright.llm.fm_index import Index, earlier_matches

WIDTH = 50
ANCHOR = 8
#: Words of an index, and of a shard on average; a shard with more is indexed in blocks, and all of its segments run
#: over each. Anchors of more than a HOT-th of it aren't put in a shard: their windows are compared one by one.
SHARD_WORDS = 400_000
HOT = 4
_LAST = (1 << 63) - 1


def anchored_runs(words: Words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut all windows of ``width`` words into runs whose least ``anchor``-gram is the same: that value, the first
    word, the word behind the last window. Equal windows have equal values, wherever they stand. A run has ``width``
    windows at most; a longer one, as in a text that repeats itself, is cut into several."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, key = windows(words.hash, words.text, anchor)
    grams = np.full(len(words), np.iinfo(np.uint64).max)
    grams[at] = key
    span = width - anchor + 1
    least, have = grams, 1
    while 2 * have <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    value = np.minimum(least[:n], least[span - have : span - have + n])
    whole = words.text[:n] == words.text[width - 1 :]
    change = np.ones(n, bool)
    change[1:] = (value[1:] != value[:-1]) | (words.text[1:n] != words.text[: n - 1]) | ~whole[:-1]
    first = np.flatnonzero(change & whole)
    last = np.ones(n, bool)
    last[:-1] = change[1:] | ~whole[1:]
    behind = np.flatnonzero(last & whole) + width
    parts = -(-(behind - first - width + 1) // width)
    number = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first, behind = np.repeat(first, parts) + number * width, np.repeat(behind, parts)
    return value[first], first, np.minimum(behind, first + 2 * width - 1)


def _runs(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            value, first, behind = anchored_runs(words, width, anchor)
            row = words.text[first]
            base = words.of[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(take), part.column("mark").take(take), pa.array(value.view(np.int64)), pa.array(first - base), pa.array(behind - base)],
                names=["doc", "mark", "anchor", "first", "behind"])

    return docs.mapInArrow(find, "doc long, mark long, anchor long, first long, behind long")


def _segments(hits: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for doc, mark, text, found in zip(*(part.column(c).to_pylist() for c in ("doc", "mark", "text", "hits")), strict=True):
                own = text.encode().split()
                rows += [(doc, mark, h["anchor"], h["first"], h["behind"], b" ".join(own[h["first"] : h["behind"]]).decode()) for h in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names, types = ["doc", "mark", "anchor", "first", "behind", "body"], [pa.int64()] * 5 + [pa.string()]
    return hits.mapInArrow(cut, "doc long, mark long, anchor long, first long, behind long, body string")


def search_shard(bodies: list[str], owners: np.ndarray, searched: np.ndarray, width: int, limit: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index the word sequences in blocks of ``limit`` words, and stream those to be searched over each block."""
    numbers: dict[bytes, int] = {}
    texts = [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in b.encode().split()), np.int64) for b in bodies]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.concatenate([np.append(t, 0) for t in texts])
    end = np.cumsum(sizes + 1) - 1
    begin = end - sizes
    owner = np.unique(owners, return_inverse=True)[1].astype(np.int32)
    asked = np.flatnonzero(searched)
    found, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + limit, "right")))
        a, b = begin[at], end[to - 1] + 1
        index = Index(symbols[a:b], np.repeat(owner[at:to], sizes[at:to] + 1), len(numbers) + 1, int(sizes.max()) + 1)
        found.append(earlier_matches(index, symbols, begin[asked], end[asked], owner[asked], width))
        at = to
    query, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    query = asked[query]
    return query, start - begin[query], stop - begin[query]


def _hot_windows(segments: DataFrame, width: int) -> DataFrame:
    """A row per window of the segments: where it starts, and 128 bits of hash of its words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            words = Words(part.column("body"))
            at, key = windows(words.hash, words.text, width)
            key_2 = windows(mixed(words.hash ^ np.uint64(0xA0761D6478BD642F)), words.text, width)[1]
            row = words.text[at]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(take) for c in ("anchor", "body_mark", "owner")), pa.array(at - words.of[row]), pa.array(key.view(np.int64)), pa.array(key_2.view(np.int64))],
                names=["anchor", "body_mark", "owner", "_from", "key", "key_2"])

    return segments.select("anchor", "body_mark", "owner", "body").mapInArrow(find, "anchor long, body_mark long, owner long, _from long, key long, key_2 long")


def hot_spans(segments: DataFrame, width: int) -> DataFrame:
    """(anchor, body_mark, _from, _to): the windows of segments that a smaller owner has too, by sums of no group."""
    keyed = _hot_windows(segments, width)
    shared = keyed.groupBy("key", "key_2").agg(F.min("owner").alias("_first"), F.max("owner").alias("_last")).filter("_first < _last")
    found = keyed.join(growing(shared.drop("_last")), ["key", "key_2"]).filter("owner > _first")
    return found.select("anchor", "body_mark", "_from", (F.col("_from") + width).alias("_to"))


def dealt_segments(distinct: DataFrame, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """The segments to search, with their _shard, and those of anchors that are too large for one.

    Copies are one segment by now: only anchors with different ones are searched."""
    several = distinct.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("owner").alias("_least"), F.sum("size").alias("_size")).filter("_n > 1")
    dealt = staged(distinct.join(growing(several.select("anchor", "_least", "_size")), "anchor"))
    hot = F.col("_size") * HOT > shard_words
    cold = dealt.filter(~hot)
    shards = max(1, (cold.agg(F.sum("size")).first()[0] or 0) // shard_words)
    return cold.withColumn("_shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))), dealt.filter(hot)


def repeated_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, mark, spans): the word spans of each document that lie in windows which a smaller doc_id has too.

    ``docs`` has doc, mark and text. Only runs of windows whose anchor occurs in two documents go on; equal runs
    are one segment of their smallest document before they reach a shard, so copies cost nothing there."""
    runs = staged(_runs(docs, width, anchor))
    shared = runs.groupBy("anchor").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).filter("_a < _b").select("anchor")
    hits = runs.join(growing(shared), "anchor").groupBy("doc", "mark").agg(F.collect_set(F.struct("anchor", "first", "behind")).alias("hits"))
    segments = staged(_segments(docs.join(growing(hits), ["doc", "mark"])).withColumn("body_mark", F.xxhash64("body")))
    distinct = segments.groupBy("anchor", "body_mark").agg(F.min("doc").alias("owner"), F.min("body").alias("body"), F.max(F.col("behind") - F.col("first")).alias("size"))
    distinct = staged(distinct)
    dealt, hot = dealt_segments(distinct, shard_words)

    def search(shard: pa.Table) -> pa.Table:
        owner = shard.column("owner").to_numpy()
        query, start, stop = search_shard(shard.column("body").to_pylist(), owner, owner > shard.column("_least").to_numpy(), width, shard_words)
        take = pa.array(query)
        return pa.table({"anchor": shard.column("anchor").take(take), "body_mark": shard.column("body_mark").take(take), "_from": pa.array(start), "_to": pa.array(stop)})

    spans = dealt.groupBy("_shard").applyInArrow(search, "anchor long, body_mark long, _from long, _to long")
    if not hot.isEmpty():
        spans = spans.union(hot_spans(hot, width))
    spans = spans.groupBy("anchor", "body_mark").agg(F.collect_list(F.struct("_from", "_to")).alias("own"))
    owners = distinct.select("anchor", "body_mark", "owner").join(growing(spans), ["anchor", "body_mark"], "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("_from"), (F.col("behind") - F.col("first")).alias("_to")))
    placed = segments.drop("body").join(growing(owners), ["anchor", "body_mark"])
    placed = placed.withColumn("_s", F.when(F.col("doc") > F.col("owner"), all_of_it).otherwise(F.col("own")))
    moved = F.transform("_s", lambda s: F.struct((s["_from"] + F.col("first")).alias("from"), (s["_to"] + F.col("first")).alias("to")))
    placed = placed.filter("_s is not null").select("doc", "mark", moved.alias("_s"))
    return placed.groupBy("doc", "mark").agg(F.flatten(F.collect_list("_s")).alias("spans"))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if it lies in a window of ``width`` words whose word sequence also starts in a document with a
    smaller doc_id, judged on the input. Rows with one doc_id don't take from each other; a null doc_id counts as
    larger than all others. Null and empty texts have no words; texts shorter than a window stay whole."""
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    spans = repeated_spans(docs.drop("doc_id"), **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts, removed, kept = [], [], []
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                own = text.encode().split()
                steps = np.zeros(len(own) + 1, np.int64)
                for s in found or ():
                    steps[s["from"]] += 1
                    steps[s["to"]] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                counts.append(len(own))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(own, gone, strict=True) if not g] if removed[-1] else own).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = docs.join(growing(spans), ["doc", "mark"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept string")
