"""Toxicity: bags of subword embeddings, averaged over a document, into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Words, mixed, slices, staged

#: Labelled documents to learn from, at most, of each class; taken by the least hash of doc_id.
SAMPLE = 4000
#: N-grams that get an embedding, at most: those most peculiar to toxic documents. The others count in the average and
#: weigh nothing.
FEATURES = 4096
#: Such an n-gram stands in so many toxic documents of the sample at least, and its log odds are so high.
LEAST_DOCUMENTS = 3
LEAST_ODDS = 1.5
BUCKETS = 1 << 18
DIMENSIONS = 8
STEPS = 200
#: An average over hundreds of words is small; so much larger, it suits the optimiser's steps.
_SCALE = 100.0
NGRAMS = (3, 4, 5, 6)
LIMIT = 0.7
_EDGES = "".join(map(chr, range(33))) + ".,;:!?\"'()[]{}<>|/\\-_"
_EDGE = np.zeros(128, bool)
_EDGE[[ord(c) for c in _EDGES]] = True


class Bags(NamedTuple):
    grams: np.ndarray  #: buckets of the n-grams of all words
    word: np.ndarray  #: the word of each
    count: int


def bags(words: list[bytes]) -> Bags:
    """The hashed character n-grams of each word in lower case; punctuation and the word's ends are one edge sign."""
    codes = np.frombuffer(b"\n".join([b"", *words, b""]).decode().lower().encode("utf-32-le"), np.uint32)
    word = np.cumsum(codes == 10) - 1
    edge = np.zeros(len(codes), bool)
    low = codes < 128
    edge[low] = _EDGE[codes[low]]
    values = mixed(np.where(edge, 0, codes).astype(np.uint64) + np.uint64(1))
    grams, owners = [], []
    power = values
    for n in range(2, max(NGRAMS) + 1):
        power = power[:-1] * np.uint64(0x9E3779B97F4A7C15) + values[n - 1 :] if len(power) > 1 else power[:0]
        if n in NGRAMS:
            m = len(power)
            ok = np.ones(m, bool)
            for k in range(1, n - 1):
                ok &= ~edge[k : k + m]
            at = np.flatnonzero(ok)
            grams.append((mixed(power[at]) & np.uint64(BUCKETS - 1)).astype(np.int64))
            owners.append(word[at + 1])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return Bags(grams[order], owners[order], len(words))


class Model(NamedTuple):
    """A bucket's embedding times the softmax weights (class 1 less class 0), and the bias: all that scoring needs."""

    bucket: np.ndarray
    bias: float

    def words(self, bag: Bags) -> np.ndarray:
        """What each word adds to the log odds of a text of this word alone: the mean of its n-grams' vectors."""
        total = np.bincount(bag.word, self.bucket[bag.grams], bag.count)
        return total / np.maximum(np.bincount(bag.word, minlength=bag.count), 1)


def averages(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of all texts: a word is the mean of its n-grams, a text the mean of its words."""
    _, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
    bag = _bags_of(words, first)
    sizes = np.bincount(bag.word, minlength=bag.count)
    starts = np.cumsum(sizes) - sizes
    # the n-grams of each word of each text, one by one
    each = sizes[number]
    upto = np.cumsum(each)
    at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts[number] - upto + each, each)
    text = np.repeat(words.text, each)
    counts = np.diff(words.of)
    weight = 1.0 / np.repeat(np.maximum(each, 1) * counts[words.text], each)
    key, inverse = np.unique(text * np.int64(BUCKETS) + bag.grams[at], return_inverse=True)
    return key // BUCKETS, key % BUCKETS, np.bincount(inverse, weight, len(key))


def _bags_of(words: Words, first: np.ndarray) -> Bags:
    raw = words.data.tobytes()
    return bags([raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)])


def loss_and_gradient(table: np.ndarray, softmax: np.ndarray, bias: np.ndarray, entries: tuple, y: np.ndarray, share: np.ndarray):
    """Weighted cross entropy of documents, and its gradients; ``entries`` are (document, feature, weight)."""
    document, feature, weight = entries
    mean = np.stack([np.bincount(document, weight * table[feature, d], len(y)) for d in range(table.shape[1])], 1)
    logits = mean @ softmax + bias
    logits -= logits.max(1, keepdims=True)
    odds = np.exp(logits)
    odds /= odds.sum(1, keepdims=True)
    loss = -float((share * np.log(odds[np.arange(len(y)), y])).sum())
    odds[np.arange(len(y)), y] -= 1
    error = odds * share[:, None]
    back = error @ softmax.T
    for_table = np.stack([np.bincount(feature, weight * back[document, d], len(table)) for d in range(table.shape[1])], 1)
    return loss, (for_table, mean.T @ error, error.sum(0))


def train(entries: tuple, buckets: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = STEPS, seed: int = 11) -> Model:
    """Embeddings of the n-grams in ``buckets`` and the softmax over their averages, trained together: Adam on the
    cross entropy of documents, each weighing ``share``."""
    rng = np.random.default_rng(seed)
    parameters = [rng.standard_normal((len(buckets), DIMENSIONS)) * 0.1, rng.standard_normal((DIMENSIONS, 2)) * 0.1, np.zeros(2)]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    entries = entries[0], entries[1], entries[2] * _SCALE
    for step in range(1, steps + 1):
        _, gradients = loss_and_gradient(*parameters, entries, y, share)
        for k, (g, decay) in enumerate(zip(gradients, (1e-5, 1e-4, 0.0), strict=True)):
            g = g + decay * parameters[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            parameters[k] -= 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    table, softmax, bias = parameters
    bucket = np.zeros(BUCKETS, np.float32)
    bucket[buckets] = table @ (softmax[:, 1] - softmax[:, 0]) * _SCALE
    return Model(bucket, float(bias[1] - bias[0]))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def _labelled_bags(rows: DataFrame) -> DataFrame:
    """(document, toxic, bucket, weight) of (document, toxic, text), made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            text, bucket, weight = averages(Words(part.column("text")))
            columns = [part.column("document").take(pa.array(text)), part.column("toxic").take(pa.array(text)), pa.array(bucket), pa.array(weight)]
            whole = pa.RecordBatch.from_arrays(columns, names=["document", "toxic", "bucket", "weight"])
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)

    return rows.select("document", "toxic", "text").mapInArrow(run, "document long, toxic int, bucket long, weight double")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Train on up to ``sample`` toxic and as many clean labelled documents that are not held out.

    Documents of a class weigh together what the class does among all labelled rows that are not held out. N-grams are
    counted on the executors; the driver gets up to ``features`` of them and, for each document, the weights of those
    that it has: a size that neither the number nor the length of texts moves."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
    known = staged(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = dict.fromkeys((0, 1), 0) | {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes[1]:
        return Model(np.zeros(BUCKETS, np.float32), -20.0)
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (1, 0)]
    # at most 2 * sample ids and labels: a table of fixed size
    few = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select("doc_id", "text").join(few, "doc_id")
    # equal texts teach once
    rows = rows.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("_same")).agg(
        F.min("doc_id").cast("long").alias("document"), F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = staged(rows)
    taught = rows.select("document", "toxic").orderBy("document", "toxic").toArrow()
    document, y = taught.column("document").to_numpy(), taught.column("toxic").to_numpy().astype(np.int64)
    counts = [max(1, int((y == c).sum())) for c in (0, 1)]
    entries = staged(_labelled_bags(rows))
    peculiar = entries.groupBy("bucket").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (counts[1] + 1)) - F.log((F.col("c") + 0.5) / (counts[0] + 1))
    peculiar = peculiar.withColumn("odds", odds).filter((F.col("t") >= LEAST_DOCUMENTS) & (F.col("odds") > LEAST_ODDS))
    best = peculiar.orderBy(F.desc("odds"), "bucket").limit(features).select("bucket")
    found = entries.join(F.broadcast(best), "bucket").select("document", "bucket", "weight").orderBy("document", "bucket").toArrow()
    buckets = np.unique(found.column("bucket").to_numpy())
    matrix = (np.searchsorted(document, found.column("document").to_numpy()), np.searchsorted(buckets, found.column("bucket").to_numpy()),
              found.column("weight").to_numpy())
    share = np.array([sizes[c] / counts[c] for c in (0, 1)])[y]
    return train(matrix, buckets, y, share / share.sum())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` to doc_id and text: the softmax over the average of all words of the whole text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            odds = np.full(part.num_rows, model.bias)
            if len(words):
                _, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
                value = model.words(_bags_of(words, first))[number]
                counts = np.diff(words.of)
                some = np.flatnonzero(counts)
                odds[some] += np.add.reduceat(value, words.of[some]) / counts[some]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], names=["doc_id", "score"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text gets the score of the bias alone. Null labels and ids teach nothing; where no toxic label
    is known, all scores are near 0. Two labels for a document count as toxic if one says so. A null doc_id is not
    held out. Rows with one doc_id are scored each by its own text."""
    rows = scored(docs, fitted(docs, labels, sample))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
