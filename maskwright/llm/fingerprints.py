"""Document fingerprints from closed syncmers of words, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word; runs of 16 characters of a longer one; each sign of scripts that write without spaces.
TOKEN = r"[\x{2E80}-\x{10FFFF}]|[^\x20\x09-\x0D\x{2E80}-\x{10FFFF}]{1,16}"
#: Words of a k-mer and of the inner substring; the choice below is spelt out for these.
K, S = 5, 2
SKETCH = 64
#: Documents that one window task orders, on average.
BUCKET = 8192


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, which a shared subexpression of an array function is not."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """An array of (position, hash): the closed syncmers of the text's words.

    Of the four two-word substrings of a five-word k-mer the least by hash must be the first or the last. That
    depends on the five words alone, so a passage has the same anchors wherever it stands, about every other word.
    A text without one, such as any with fewer than five words, is an anchor as a whole."""

    def pairs(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))

    def chosen(s: Column) -> Column:
        def pick(x: Column, i: Column) -> Column:
            last = F.get(s, i + 3)
            inner = F.least(F.get(s, i + 1), F.get(s, i + 2))
            return F.when(F.least(x, last) <= inner, F.struct(i.alias("position"), F.xxhash64(x, F.get(s, i + 2), last).alias("hash")))

        return F.filter(F.transform(F.slice(s, 1, F.greatest(F.size(s) - 3, F.lit(0))), pick), lambda a: a.isNotNull())

    def of_tokens(t: Column) -> Column:
        found = let(F.transform(t, lambda w: F.xxhash64(w)), lambda h: let(pairs(h), chosen))
        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(t).alias("hash")))
        return let(found, lambda a: F.when(F.size(a) == 0, whole).otherwise(a))

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), of_tokens)


def sketch(text: Column) -> Column:
    """The SKETCH least different anchor hashes of a text, in order: a sample that two texts draw alike."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(anchors(text), lambda a: a["hash"]))), 1, SKETCH)


def printed(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """The share of the least SKETCH hashes of both that both have: estimates the Jaccard of all their anchors."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return let(least, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)).cast("double") / F.size(u))


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Anchors that documents of two tables share: left_id, right_id, shift (how much further right the passage
    stands in the second document) and how many anchors agree on it. Both have doc_id and text."""

    def rows(df: DataFrame, side: str) -> DataFrame:
        found = df.select(F.col("doc_id").alias(f"{side}_id"), F.explode(anchors(F.coalesce("text", F.lit("")))).alias("a"))
        return found.groupBy(f"{side}_id", F.col("a.hash").alias("hash")).agg(F.min("a.position").alias(f"{side}_at"))

    both = rows(left, "left").join(rows(right, "right"), "hash")
    return both.groupBy("left_id", "right_id", (F.col("right_at") - F.col("left_at")).alias("shift")).agg(F.count("*").alias("anchors"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the document that follows by descending doc_id, the first one after the last.

    ``docs`` has doc_id and text. Rows are dealt out by ranges of doc_id about BUCKET rows long; each range's first
    row is passed to the range before it. Null ids come last; rows with one doc_id follow by descending text."""
    count = docs.count()
    parts = max(1, count // BUCKET)
    bounds = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    bounds = sorted({int(b) for b in bounds}, reverse=True)
    # two steps to a row's range: which block of bounds, then where in the block
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def above(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b > F.col("doc_id")))

    if blocks:
        table = F.array(*[F.array(*[F.lit(b).cast("long") for b in block]) for block in blocks])
        block = F.greatest(above(F.array(*[F.lit(b[0]).cast("long") for b in blocks])) - 1, F.lit(0))
        bucket = block * step + above(F.get(table, block))
    else:
        bucket = F.lit(0)
    dealt = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(bucket))

    place = F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id", "text")
    first = dealt.groupBy("_bucket").agg(F.max(F.struct(place.alias("p"), F.struct(*columns).alias("c"))).alias("_f"))
    order = Window.orderBy(F.col("_bucket").desc())
    ends = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select("_bucket", F.coalesce(F.lag("_f.c").over(order), F.first("_f.c").over(ends)).alias("_first"))
    within = Window.partitionBy("_bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    dealt = dealt.withColumn("_own", F.lead(F.struct(*columns)).over(within))
    first = first.withColumnRenamed("_bucket", "_b")
    last = dealt.join(first, dealt["_own"].isNull() & (dealt["_bucket"] == first["_b"]), "left")
    follow = F.coalesce("_own", "_first")
    return last.select(*docs.columns, *[follow[c].alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the first floor(n_chars / 2) characters of the next document (all, if it has fewer) in place
    of as many at its end. A null text is empty; a text without words has the fingerprint of an empty one. Equal
    texts have equal fingerprints. An empty table gives no rows; a single document follows itself."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("own", sketch(F.col("text"))), ["text", "own"])
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))

    def out(e: Column) -> Column:
        return F.struct(printed(e).alias("print"), likeness(F.col("own"), e).alias("near"))

    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "own", "next_own", let(sketch(F.col("edited")), out).alias("_e"))
    return rows.select("doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), F.col("_e")["print"].alias("edited_fingerprint"),
                       F.col("_e")["near"].alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
