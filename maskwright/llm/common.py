"""Helpers shared by the text operators: shared tables, distributed running totals, words as numpy arrays."""

from __future__ import annotations

import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A word, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
_CHUNK = 1 << 20


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session, so that their Python finds it wherever it was started."""
    context = spark.sparkContext
    if _shipped.get("to") != context.applicationId:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='llm-')}/maskwright", "zip", root, "maskwright")
        context.addPyFile(archive)
        _shipped["to"] = context.applicationId
    return spark


_shipped: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may leave the setting out; it then gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("maskwright.llm.folder", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("maskwright.llm.folder", folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, nothing is computed twice.

    The files go when the session's JVM ends. Shuffle files of the step go when the JVM finds that nothing refers to
    them any more; asking for that here keeps the disk to what one step needs."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, hadoop = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(hadoop).deleteOnExit(where)
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """A side of a join whose size grows with the input: it is never broadcast, so plans are alike at every size."""
    return df.hint("merge")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows before this one within ``group``, in the order (bucket, order).

    ``bucket`` must be a monotone summary of the order. Only bucket sums meet in one task per group, so a group
    may hold most of the rows."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    keys = [*group, bucket]
    right = starts.select("_before", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    joined = df.join(right, [df[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))
    return joined.withColumn(out, total.cast("long")).drop("_before", *right.columns[1:])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the least node it is connected with.

    Alternates two steps until nothing changes: each node ties its larger neighbours to the least one, then its
    smaller ones. Every round is a written table; the number of rounds grows with the logarithm of a component."""
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


# Words as arrays. Space bytes weigh nothing, so a sum over a word and the space behind it is the word's own.

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _CHUNK
    while size < n:
        size *= 2
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        table = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > _CHUNK:
            return table
        _powers[size] = table
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind each other, and where each starts; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of many texts: ``start`` and ``end`` byte, ``of`` the first word of each text, 64-bit ``hash``."""

    def __init__(self, column: pa.Array, hashed: bool = True, lines: bool = False):
        self.data, self.offsets = data, offsets = flat(column)
        n = len(data)
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = offsets[:-1][offsets[:-1] < n]
        first[cut] = inside[cut]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = cut[cut > 0] - 1
        last[cut] = inside[cut]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(column)), np.diff(self.of))
        if lines:
            marks = data == 10
            marks[cut + 1] |= True
            self.line = np.cumsum(marks)[self.start] if n else np.zeros(0, np.int64)
        if hashed:
            self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self) -> np.ndarray:
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + _CHUNK, "right")))
            b = self.end[j - 1]
            up, down = _power_table(b - a)
            at = self.start[i:j] - a
            out[i:j] = np.add.reduceat(_BYTE[self.data[a:b]] * up[: b - a], at) * down[at]
            i = j
        return mixed(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``limit`` bytes of text, one text at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def windows(values: np.ndarray, text: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all runs of ``width`` values within one text, and a hash of each run."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # h(x, 2k) = mix(h(x, k) * a + h(x + k, k) * b), put together from the binary digits of the width
    power, size = values.astype(np.uint64), 1
    have, have_size = None, 0
    rest = width
    while rest:
        if rest & 1:
            have = power if have is None else _joined(have[: len(have)], power, have_size)
            have_size += size
        rest >>= 1
        if rest:
            power = _joined(power, power, size)
            size *= 2
    have = have[:n]
    whole = text[:n] == text[width - 1 :]
    at = np.flatnonzero(whole)
    return at, mixed(have[at] + np.uint64(salt))


def _joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    n = min(len(left), len(right) - shift)
    return mixed(left[:n] * np.uint64(0x2545F4914F6CDD1D) + right[shift : shift + n] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(shift))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, summed exactly in logarithms."""
    i = np.arange(k + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i]
    terms = np.array(logs) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(np.exp(terms - terms.max()).sum() * math.exp(terms.max()))
