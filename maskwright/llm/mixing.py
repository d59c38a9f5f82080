"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import DOC_COLUMNS, WORD, running_total, staged

BLOCK_WORDS = 1024
_BINS = 4096
_CHUNK = 1 << 16


class Mix(NamedTuple):
    rows: DataFrame  #: one row per document: doc_id, source, mark, size, start, source_size, target
    pieces: DataFrame  #: slot, source, block, start, repeat, skip, length: words [skip, skip+length) of a document


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size): ``share`` of all words dealt by weight, no source
    above ``limit`` times its size, the excess dealt again by weight.

    Weights repeat over the sources by code point, null last. Works on one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), number % len(weights) + 1).cast("long").alias("weight"))
    # Sources reach their limit in the order of limit / weight; the level is the one at which the rest shares evenly.
    weighed = weighed.withColumn("_cap", F.col("source_size") * limit).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    weighed = weighed.withColumn("_level", level)
    found = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap").cast("double"), F.coalesce(found, F.lit(float("inf"))) * F.col("weight"))
    return weighed.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2,
        block_words: int = BLOCK_WORDS, seed: str = "mix") -> Mix:
    """Shuffle each source, cut it into blocks of equal word counts, and lay the blocks along the schedule.

    Slot i takes the van der Corput point of i through the cumulative weights; the k-th slot of a source takes its
    k-th block. A source read to its end starts again in the same order, up to ``limit`` times. The last block is
    cut at the target, so a source's words are its target, rounded. Blocks that found no slot follow at the end.

    A null text or one without words takes nothing; a null source is a source of its own; equal rows are told
    apart by their place. An empty table gives empty results."""
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select("doc_id", "source", mark.alias("mark"),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = staged(rows.withColumn("_bucket", F.substring("mark", 1, 3)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, weights, share, limit).withColumn("words", F.round("target").cast("long")))
    rows = running_total(rows, ["source"], "_bucket", [F.col("mark"), F.col("doc_id")], "size", "start").drop("_bucket")
    rows = staged(_with_source(rows, targets.select("source", "source_size", "target", "words")))

    own = rows.filter("size > 0").select("source", "start", "size", "source_size", "words")
    own = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(limit - 1).cast("long"))).alias("repeat"))
    own = own.withColumn("_from", F.col("start") + F.col("repeat") * F.col("source_size"))
    own = own.filter("_from < words").withColumn("_to", F.least("words", F.col("_from") + F.col("size")))
    blocks = F.sequence(F.expr(f"_from div {block_words}"), F.expr(f"(_to - 1) div {block_words}"))
    own = own.select("*", F.explode(blocks).alias("block"))
    first = F.greatest(F.col("_from"), F.col("block") * block_words)
    length = F.least(F.col("_to"), (F.col("block") + 1) * block_words) - first
    own = own.select("source", "block", "start", "repeat", (first - F.col("_from")).alias("skip"), length.alias("length"))
    slots = schedule(targets, block_words)
    right = slots.select(F.col("source").alias("_source"), F.col("rank").alias("_rank"), "slot")
    pieces = own.join(right, own["source"].eqNullSafe(right["_source"]) & (own["block"] == right["_rank"]), "left")
    late = F.lit(slot_count(targets, block_words)) + F.col("block")
    return Mix(rows.drop("words"), pieces.withColumn("slot", F.coalesce("slot", late)).drop("_source", "_rank"))


def slot_count(targets: DataFrame, block_words: int) -> int:
    return targets.agg(F.sum(F.ceil(F.col("words") / block_words))).first()[0] or 0


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(slot, source, rank): each slot's van der Corput point falls into one source's share of [0, 1)."""
    spark, count = targets.sparkSession, slot_count(targets, block_words)
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    shares = targets.filter("words > 0").select("source", "words", F.sum("words").over(upto).alias("_end"), F.sum("words").over(everything).alias("_all"))
    shares = shares.select("source", ((F.col("_end") - F.col("words")) / F.col("_all")).alias("_low"), (F.col("_end") / F.col("_all")).alias("_high"))
    bins = F.sequence(F.floor(F.col("_low") * _BINS), F.least(F.floor(F.col("_high") * _BINS), F.lit(_BINS - 1)))
    shares = shares.select("*", F.explode(bins).alias("_bin"))
    bits = 52
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("double") / F.lit(float(2**bits))
    slots = spark.range(count).select(F.col("id").alias("slot"), point.alias("_point"))
    slots = slots.withColumn("_bin", F.floor(F.col("_point") * _BINS)).join(shares, "_bin")
    slots = slots.filter("_low <= _point and _point < _high").select("slot", "source", F.expr(f"slot div {_CHUNK}").alias("_chunk"), F.lit(1).alias("_one"))
    return running_total(slots, ["source"], "_chunk", [F.col("slot")], "_one", "rank").select("slot", "source", "rank")


def _with_source(rows: DataFrame, targets: DataFrame) -> DataFrame:
    right = targets.withColumnRenamed("source", "_source")
    return rows.join(right, rows["source"].eqNullSafe(right["_source"])).drop("_source")


def taken_words(plan: Mix) -> DataFrame:
    """Each row of ``plan.rows`` with ``taken``, the words of all its pieces."""
    sums = plan.pieces.groupBy("source", "start").agg(F.sum("length").alias("_taken"))
    right = sums.select(F.col("source").alias("_source"), F.col("start").alias("_start"), "_taken")
    rows = plan.rows
    same = rows["source"].eqNullSafe(right["_source"]) & (rows["start"] == right["_start"]) & (rows["size"] > 0)
    taken = F.coalesce("_taken", F.lit(0)).cast("long")
    return rows.join(right, same, "left").withColumn("taken", taken).drop("_source", "_start", "_taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus as documents: a row for each time a document is taken whole, and its first words once
    more where it is taken in part."""
    docs = docs.select(*DOC_COLUMNS)
    taken = taken_words(mix(docs, **options))
    key = ["doc_id", "mark", "source"]
    number = Window.partitionBy(*key).orderBy("start")
    taken = taken.withColumn("_n", F.row_number().over(number)).filter("taken > 0")
    taken = taken.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("source").alias("_source"), F.col("_n").alias("_m"), "size", "taken")
    seed = options.get("seed", "mix")
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    docs = docs.withColumn("mark", mark)
    docs = docs.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("n_chars", "lang")))
    same = docs["doc_id"].eqNullSafe(taken["_doc"]) & (docs["mark"] == taken["_mark"]) & docs["source"].eqNullSafe(taken["_source"]) & (docs["_n"] == taken["_m"])
    rows = docs.join(taken, same)
    part = F.expr("taken % size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.expr("cast(taken div size as int)")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select(*[F.col(c) for c in DOC_COLUMNS], F.explode(copies).alias("_part"))
    words = F.expr(r"array_join(slice(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), 1, cast(_part as int)), ' ')")
    text = F.when(F.col("_part") == 0, F.col("text")).otherwise(words)
    return rows.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*DOC_COLUMNS)
