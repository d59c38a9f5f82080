"""Documents whose sets of word n-grams are similar: MinHash buckets, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import Words, binomial_tail, components, growing, mixed, slices, staged, windows

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 36, 6
TOLERANCE = 1e-9
#: Texts of a component are compared tile by tile, about so many against as many in one task.
TILE = 256
#: Texts (with repeats) that one Arrow group holds on average.
GROUP = 1024
_COMPARED = 24
_rng = np.random.default_rng(977)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word ``width``-grams of each text behind each other, and where each text starts.

    A text with fewer words is one shingle, all of its words; one without words has none."""
    words = Words(column)
    at, key = windows(words.hash, words.text, width)
    text = words.text[at]
    counts = np.diff(words.of)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        whole = []
        for i in few:
            h = np.zeros(1, np.uint64)
            for w in words.hash[words.of[i] : words.of[i + 1]]:
                h = mixed(h * np.uint64(0x2545F4914F6CDD1D) + w)
            whole.append(h)
        text, key = np.concatenate([text, few]), np.concatenate([key, *whole])
        order = np.argsort(text, kind="stable")
        text, key = text[order], key[order]
    return key, np.searchsorted(text, np.arange(len(column) + 1))


def min_hashes(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A row of BANDS * ROWS MinHash values per text that has shingles."""
    starts = of[:-1][np.diff(of) > 0]
    out = np.empty((len(starts), len(_A)), np.uint32)
    if len(starts):
        low, high = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32)
        for j in range(len(_A)):
            out[:, j] = np.minimum.reduceat(low * _A[j] + high * _B[j], starts)
    return out


def _band_keys(docs: DataFrame, width: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends each text on once
        for part in slices(batches, "text"):
            ids = part.column("text_id").to_pylist()
            new = [k for k, i in enumerate(ids) if not (i in seen or seen.add(i))]
            part = part.take(pa.array(new, pa.int64()))
            key, of = shingles(part.column("text"), width)
            values = min_hashes(key, of).astype(np.uint64).reshape(-1, BANDS, ROWS)
            band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2])
            for r in range(ROWS):
                band = mixed(band * np.uint64(0x9FB21C651E98DF25) + values[:, :, r])
            text = part.column("text_id").to_numpy()[np.diff(of) > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(text, BANDS)), pa.array(band.ravel().view(np.int64))], names=["text_id", "bucket"])

    return docs.select("text_id", "text").mapInArrow(sketch, "text_id long, bucket long")


def _with_shingles(docs: DataFrame, width: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            key, of = shingles(part.column("text"), width)
            sets = [np.unique(key[a:b]).tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
            sketches = iter(min_hashes(key, of))
            sketched = [next(sketches).tobytes() if n else None for n in np.diff(of).tolist()]
            columns = [part.column("text_id"), part.column("component"), part.column("tiles"), pa.array(sets, pa.binary()), pa.array(sketched, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["text_id", "component", "tiles", "shingles", "sketch"]
    return docs.mapInArrow(cut, "text_id long, component long, tiles long, shingles binary, sketch binary")


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The least number of equal MinHash values among ``compared`` for which, with a uniform prior, a Jaccard of
    ``threshold`` has a posterior probability of at least ``tolerance``."""
    return next((m for m in range(compared + 1) if binomial_tail(m, compared + 1, threshold) >= tolerance), compared + 1)


def surviving_pairs(left: np.ndarray, right: np.ndarray, same: bool, threshold: float, tolerance: float,
                    may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sketches that stay likely enough after each step of MinHash values; all against all at first, or those
    that ``may`` (a flag for each pair) leaves."""
    first = min(_COMPARED, left.shape[1])
    left, right = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    equal = np.zeros((left.shape[1], right.shape[1]), np.uint8)
    for k in range(first):
        equal += left[k][:, None] == right[k][None, :]
    stay = equal >= least_matches(first, threshold, tolerance)
    if may is not None:
        stay &= may
    i, j = np.nonzero(np.triu(stay, 1) if same else stay)
    total = equal[i, j].astype(np.int32)
    for a in range(first, len(left), _COMPARED):
        b = min(a + _COMPARED, len(left))
        for k in range(a, b):
            total += left[k][i] == right[k][j]
        stay = total >= least_matches(b, threshold, tolerance)
        i, j, total = i[stay], j[stay], total[stay]
    return i, j


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j), through products of a 0/1 matrix, 4096 shingles at a time."""
    rows = np.unique(np.concatenate([i, j]))
    if len(i) < 2 * len(rows):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, counts = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    often = counts > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    product = np.zeros((len(rows), len(rows)), np.float32)
    for a in range(0, int(often.sum()), 4096):
        x, y = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(rows), 4096), np.float32)
        part[row[x:y], column[x:y] - a] = 1
        product += part @ part.T
    place = np.zeros(int(rows.max()) + 1, np.int64)
    place[rows] = np.arange(len(rows))
    return np.rint(product[place[i], place[j]]).astype(np.int64)


def linked(sets: list[np.ndarray], first: int, threshold: float, tolerance: float, sketches: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with a Jaccard of ``threshold`` or more: within the sets if ``first`` is their number, else
    between the first ones and the rest. Sets whose sizes are too far apart are not compared."""
    if sketches is None:
        sketches = min_hashes(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    same = first == len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    a, b = size[:first, None], (size if same else size[first:])[None, :]
    may = np.minimum(a, b) >= (threshold - 1e-12) * np.maximum(a, b)
    i, j = surviving_pairs(sketches[:first], sketches if same else sketches[first:], same, threshold, tolerance, may)
    j = j if same else j + first
    if not len(i):
        return i, j
    shared = _intersections(sets, i, j)
    sizes = np.array([len(s) for s in sets])
    stay = shared >= (threshold - 1e-12) * (sizes[i] + sizes[j] - shared)
    return i[stay], j[stay]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def text_links(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(text_id, root, links) for each different text that has a similar one: the least text_id of its class and
    the number of other texts with a Jaccard of ``threshold`` or more.

    ``docs`` has text_id (a 64-bit hash of the text) and text. Texts that share a bucket in one of the 36 bands of
    6 MinHash values are tied together; a pair at 0.8 is missed with probability 2e-5, one at 0.85 with 2e-8.
    Within what is tied together all pairs are compared, tile by tile, and none is emitted."""
    # one shuffle serves the sums and the join: neither side is filtered later on
    buckets = _band_keys(docs, width).filter("text_id is not null and bucket is not null").repartition("bucket")
    shared = buckets.groupBy("bucket").agg(F.min("text_id").alias("_least"), F.max("text_id").alias("_most")).filter("_least < _most")
    edges = buckets.join(growing(shared), "bucket").filter("text_id <> _least").select(F.col("text_id").alias("a"), F.col("_least").alias("b"))
    tied = staged(components(edges))
    sizes = tied.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    tied = tied.join(sizes, "root").select(F.col("node").alias("text_id"), F.col("root").alias("component"), "tiles")
    # one row per text, found where the join has put its copies
    texts = docs.join(growing(tied), "text_id").dropDuplicates(["text_id"])
    sets = staged(_with_shingles(texts.select("text_id", "component", "tiles", "text"), width))

    own = F.pmod(F.xxhash64("text_id"), F.col("tiles"))
    units = sets.withColumn("_own", own).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("_other"))
    units = units.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
    repeats = sets.groupBy("tiles").count().agg(F.sum(F.col("tiles") * F.col("count"))).first()[0] or 0
    groups = max(1, repeats // GROUP)
    units = units.withColumn("_group", F.pmod(F.xxhash64("component", "_i", "_j"), F.lit(groups)))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("component", "_i", "_j", "_own", "text_id")])
        unit = np.stack([group.column(c).to_numpy() for c in ("component", "_i", "_j")])
        own_tile, text = group.column("_own").to_numpy(), group.column("text_id").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (unit[:, 1:] != unit[:, :-1]).any(0)]))
        raw, sketched = group.column("shingles"), group.column("sketch")
        out = []
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
            within = unit[1, a] == unit[2, a]
            first = b - a if within else int((own_tile[a:b] == unit[1, a]).sum())
            if first == 0 or not within and first == b - a or b - a < 2:
                continue
            sketches = np.stack([np.frombuffer(sketched[k].as_py(), np.uint32) for k in range(a, b)])
            i, j = linked([np.frombuffer(raw[k].as_py(), np.uint64) for k in range(a, b)], first, threshold, tolerance, sketches)
            links = np.bincount(np.concatenate([i, j]), minlength=b - a)
            root = _roots(b - a, i, j)
            some = np.flatnonzero(links)
            out.append((text[a:b][some], text[a:b][root[some]], links[some]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("text_id", "tie", "links"), map(pa.array, columns), strict=True)))

    found = staged(units.groupBy("_group").applyInArrow(compare, "text_id long, tie long, links long"))
    roots = components(found.select(F.col("text_id").alias("a"), F.col("tie").alias("b")))
    links = found.groupBy("text_id").agg(F.sum("links").alias("links"))
    return links.join(roots, links["text_id"] == roots["node"]).select("text_id", "root", "links")


def document_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), n_links, n_copies.

    Documents with equal texts are copies and one class. Texts whose sets of word five-grams have a Jaccard of 0.8
    or more are linked, and links join classes; n_links counts the other texts linked with this one. A text with
    fewer words than a shingle is a shingle; a null text is empty, and texts without words are linked with none.
    A null doc_id is never a class_id unless the class has no other."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_id", F.xxhash64("text"))
    ids = staged(rows.select("doc_id", "text_id"))
    links = staged(text_links(rows.select("text_id", "text"), **options))
    texts = ids.groupBy("text_id").agg(F.min("doc_id").alias("_first"), F.count("*").alias("n_copies"))
    texts = texts.join(links, "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    classes = staged(texts)
    first = classes.groupBy("root").agg(F.min("_first").alias("class_id"))
    classes = classes.join(first, "root").select("text_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return ids.join(classes, "text_id").select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The document with the least doc_id of each class, with the columns it came with."""
    names = docs.columns
    rows = docs.withColumn("text_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    links = staged(text_links(rows.select("text_id", F.coalesce("text", F.lit("")).alias("text")), **options))
    first = rows.groupBy("text_id").agg(F.min("doc_id").alias("_first"))
    texts = first.join(links, "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    best = F.struct(F.col("_first").isNull().alias("n"), F.col("_first").alias("d"), F.col("text_id").alias("t"))
    kept = texts.groupBy("root").agg(F.min(best).alias("_b")).select(F.col("_b.t").alias("text_id"))
    rows = rows.join(kept, "text_id", "left_semi")
    order = Window.partitionBy("text_id").orderBy(F.col("doc_id").asc_nulls_last(), "source", "lang")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*names)
