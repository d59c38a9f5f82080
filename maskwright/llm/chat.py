"""Chat formatting: logged snapshots of a conversation collapse to the longest, then turns are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clean(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """Each turn with its place in the conversation and the rolling hashes of all turns up to it.

    A turn's hash is salted with its place, and the hashes of a prefix are joined by exclusive or, so the rolling
    hash is a running aggregate; two salts make 128 bits."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.select("conv_id", "turn", _clean("role").alias("role"), _clean("text").alias("text"))
    turns = turns.withColumn("place", F.row_number().over(order))
    for salt in (1, 2):
        turns = turns.withColumn(f"hash{salt}", F.bit_xor(F.xxhash64(F.lit(salt), "place", "role", "text")).over(upto))
    return turns


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, place and hashes of the last turn): conversations that are no prefix of a longer one.

    Of equal conversations the least conv_id stays, null only if there is no other."""
    prefixes = with_prefix_hashes(turns)
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "hash1", "hash2")).alias("l")).select("conv_id", "l.*")
    key = ["place", "hash1", "hash2"]
    one = last.groupBy(*key).agg(F.min("conv_id").alias("_least"), F.count("*").alias("logged"))
    sizes = last.select("conv_id", F.col("place").alias("_size"))
    inner = prefixes.join(sizes, prefixes["conv_id"].eqNullSafe(sizes["conv_id"])).filter("place < _size").select(*key).distinct()
    return one.join(inner, key, "left_anti").select(F.col("_least").alias("conv_id"), F.col("place").cast("long").alias("n_turns"), "logged")


def render(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """``text`` of each conversation: role, line break, text between the two marks, turn after turn."""
    turn = F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(end + "\n"))
    turns = conversations.withColumn("_t", F.struct("place", turn.alias("t")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("_t")), lambda x: x["t"]), "")
    return turns.groupBy("conv_id").agg(whole.alias("text"))


def formatted_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation that is kept: conv_id, n_turns, logged (equal conversations in the log), text.

    Turns are ordered by number, role and text; null roles and texts are empty. Turns whose conv_id is null are one
    conversation. An empty table gives no rows."""
    kept = maximal_conversations(turns).select(F.col("conv_id").alias("_conv"), "n_turns", "logged")
    rows = with_prefix_hashes(turns)
    text = render(rows.join(kept.select("_conv"), rows["conv_id"].eqNullSafe(F.col("_conv")), "left_semi"))
    return text.join(kept, text["conv_id"].eqNullSafe(kept["_conv"])).select("conv_id", "n_turns", "logged", "text")
