"""Merkle manifest of a table: one tree per group, the groups' roots under one root, and a proof for every row.

Blocks of ``fanout ** levels`` rows are hashed each in one task. From there on blocks swap the roots of their subtrees
along a butterfly: in round r a block hears, from one block of each sibling subtree, the root of that subtree, and
hashes the common ancestor itself. Every block so learns its own way to the top while it goes up; nothing is sent down.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from maskwright.llm.common import staged

FANOUT = 3
LEVELS = 7
#: The columns of a leaf, in the order in which they are hashed.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"
PROOF_TYPE = ArrayType(StructType([StructField("left", StringType()), StructField("right", StringType())]))


def field(column: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and the value; a dash for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(F.encode(F.concat(*[field(columns[c]) for c in LEAF_COLUMNS]), "utf-8"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to with ``proof``."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]).cast("binary"), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), "")


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``place`` from 0 within ``group`` (null first) in ``order`` and ``place_of_group`` from 0.

    Rows are dealt by ranges of (group, order), so a group may hold most of them; what meets in one task are the
    counts of a group per range and the number of groups that start in a range."""
    spread = rows.repartitionByRange(F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    spread = spread.sortWithinPartitions(F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    # monotonically_increasing_id is (range << 33) + place in range; it is fixed once it is written
    spread = staged(spread.withColumn("_at", F.monotonically_increasing_id()))
    ranges = spread.groupBy(group, F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = staged(ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    starts = ranges.filter("_before = 0").select(group, "_range", "_first")
    starts = starts.withColumn("_in_range", F.row_number().over(Window.partitionBy("_range").orderBy("_first")) - 1)
    per_range = starts.groupBy("_range").agg(F.count("*").alias("_n"))
    per_range = per_range.select("_range", F.coalesce(F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_groups_before"))
    groups = starts.join(per_range, "_range").select(
        F.col(group).alias("_group"), (F.col("_groups_before") + F.col("_in_range")).cast("long").alias("place_of_group"))
    ranges = ranges.join(groups, F.col(group).eqNullSafe(F.col("_group")))
    # (range, first) names a group's part of a range, and no value of it is null
    ranges = ranges.select(F.col("_range").alias("_r"), F.col("_first").alias("_f"), F.col("_n").alias("_size"), "_before", "place_of_group")
    same = (F.shiftright("_at", 33) == F.col("_r")) & (F.col("_at") >= F.col("_f")) & (F.col("_at") < F.col("_f") + F.col("_size"))
    found = spread.join(ranges, same)
    place = (F.col("_before") + F.col("_at") - F.col("_f")).cast("long")
    return found.withColumn("place", place).drop("_at", "_r", "_f", "_size", "_before")


def _hashed(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _up(nodes: list[str], fanout: int) -> list[str]:
    return [_hashed(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]


def _tree(nodes: list[str], fanout: int, levels: int, alone: bool) -> list[list[str]]:
    """The levels above ``nodes``: ``levels`` of them, or up to a single node in a tree of one block."""
    found = [nodes]
    while len(found[-1]) > 1 if alone else len(found) <= levels:
        found.append(_up(found[-1], fanout))
    return found


def upper_proofs(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, root, proof) from (tree, block, blocks, node): the butterfly exchange.

    In round r a block holds the root of its subtree of ``fanout ** r`` blocks, as all blocks of that subtree do. It
    sends it to the block of the same rank in each sibling subtree; the blocks of a shorter last subtree take turns
    for the ranks it lacks. A round is one shuffle of at most ``fanout`` short rows a block."""
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    state = blocks.select("tree", "block", "blocks", F.col("node"), F.expr(f"cast(array() as {PROOF})").alias("proof"))
    width = 1
    while width < most:
        going = state.filter(F.expr(f"blocks > {width}"))
        there = state.filter(F.expr(f"blocks <= {width}"))
        going = going.withColumn("_own", F.expr(f"block div {width}"))
        # the size of this block's subtree, and the ranks in a full sibling that it answers for
        going = going.withColumn("_size", F.least(F.lit(width), F.expr(f"blocks - _own * {width}")))
        first = F.expr(f"_own div {fanout} * {fanout}")
        last = F.least(first + (fanout - 1), F.expr(f"(blocks - 1) div {width}"))
        sent = going.withColumn("_to", F.explode(F.sequence(first, last)))
        ranks = F.expr(f"sequence(block % {width}, cast({width - 1} as bigint), _size)")
        ranks = F.when(F.col("_to") == F.col("_own"), F.array(F.expr(f"block % {width}"))).otherwise(ranks)
        sent = sent.withColumn("_rank", F.explode(ranks)).withColumn("_dest", F.col("_to") * width + F.col("_rank"))
        sent = sent.filter("_dest < blocks")
        own = F.col("_to") == F.col("_own")
        heard = sent.groupBy("tree", F.col("_dest").alias("block"), "blocks").agg(
            F.sort_array(F.collect_list(F.struct("_own", "node"))).alias("_run"),
            F.max(F.when(own, F.col("proof"))).alias("proof"), F.max(F.when(own, F.col("_own"))).alias("_place"))

        def side(keep):
            return F.array_join(F.transform(F.filter("_run", keep), lambda x: x["node"]), "")

        run = F.struct(side(lambda x: x["_own"] < F.col("_place")).alias("left"), side(lambda x: x["_own"] > F.col("_place")).alias("right"))
        node = F.sha2(F.array_join(F.transform("_run", lambda x: x["node"]), "").cast("binary"), 256)
        heard = heard.select("tree", "block", "blocks", node.alias("node"), F.concat("proof", F.array(run)).cast(PROOF).alias("proof"))
        state = staged(heard.union(there.select(heard.columns)))
        width *= fanout
    return state.select("tree", "block", F.col("node").alias("root"), "proof")


def block_nodes(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, block, blocks, node): the root of each block of (tree, place, leaf).

    A block that is all of its tree is hashed up to one node, others up to ``levels`` whatever they hold; where block 0
    is full both are the same."""
    dealt = leaves.select("tree", F.expr(f"place div {fanout**levels}").alias("block"), "place", "leaf")

    def root(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        first = group.slice(0, 1).select(["tree", "block"])
        tree = _tree(group.column("leaf").to_pylist(), fanout, levels, _alone(group, fanout, levels))
        return first.append_column("node", pa.array(tree[-1], pa.string()))

    nodes = staged(dealt.groupBy("tree", "block").applyInArrow(root, "tree long, block long, node string"))
    return nodes.join(nodes.groupBy("tree").agg((F.max("block") + 1).alias("blocks")), "tree")


def _alone(group: pa.Table, fanout: int, levels: int) -> bool:
    return group.column("block")[0].as_py() == 0 and group.num_rows < fanout**levels


def proved(leaves: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Rows that have (tree, place, leaf), with ``proof`` and the other columns of ``above`` (tree, block, proof, ...):
    each block hashes its own rows once more and puts what it learned from the exchange behind their proofs."""
    dealt = leaves.withColumn("block", F.expr(f"place div {fanout**levels}"))
    more = [f for f in above.schema if f.name not in ("tree", "block", "proof")]
    schema = StructType([*dealt.schema, *more, StructField("proof", PROOF_TYPE)])

    def prove(group: pa.Table, upper: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        (upper,) = upper.to_pylist()
        tree = _tree(group.column("leaf").to_pylist(), fanout, levels, _alone(group, fanout, levels))
        proofs = []
        for i in range(group.num_rows):
            own = []
            for nodes in tree[:-1]:
                a = i - i % fanout
                own.append({"left": "".join(nodes[a:i]), "right": "".join(nodes[i + 1 : a + fanout])})
                i //= fanout
            proofs.append(own + upper["proof"])
        for kept in more:
            group = group.append_column(kept.name, pa.repeat(pa.scalar(upper[kept.name], pa.string()), group.num_rows))
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return group.append_column("proof", pa.array(proofs, kind)).select(schema.names)

    found = dealt.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return found.applyInArrow(prove, schema).drop("block")


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, change: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, place, leaf, changed_leaf, subroot, root and its ``proof``.

    A leaf hashes ``LEAF_COLUMNS``; leaves of a source ascend by doc_id (null first; rows that share one by leaf),
    sources by their bytes, null first. ``proof`` holds, from the leaf up to the root over all sources, what stands to
    the left and to the right of the own node in each run. ``change`` is a text that takes the place of ``text`` in
    ``changed_leaf`` where it is not null; the tree is always that of the rows as they are.

    Null values are hashed as a dash, so null and empty differ; rows repeated in full are leaves of their own, one
    behind the other; other columns are left out; an empty table gives no rows."""
    columns = {c: F.col(c) for c in LEAF_COLUMNS}
    changed = F.lit(None).cast("string")
    if change is not None:
        changed = F.when(change.isNotNull(), leaf_hash(columns | {"text": change}))
    leaves = staged(docs.select("doc_id", "source", leaf_hash(columns).alias("leaf"), changed.alias("changed_leaf")))
    rows = staged(placed(leaves, "source", ["doc_id", "leaf"]).withColumnRenamed("place_of_group", "tree"))
    blocks = staged(upper_proofs(block_nodes(rows, fanout, levels), fanout).withColumnRenamed("root", "subroot"))
    sources = blocks.filter("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("leaf"))
    tops = proved(sources, upper_proofs(block_nodes(sources, fanout, levels), fanout), fanout, levels)
    tops = tops.select(F.col("place").alias("_source"), "root", F.col("proof").alias("_upper"))
    above = blocks.join(tops, F.col("tree") == F.col("_source"))
    above = above.select("tree", "block", "subroot", "root", F.concat("proof", "_upper").cast(PROOF).alias("proof"))
    found = proved(rows, above, fanout, levels)
    return found.select("doc_id", "source", "place", "leaf", "changed_leaf", "subroot", "root", "proof")


def tampered_text() -> Column:
    """The text without line feeds where 2 divides the crc32 of the decimal doc_id, else null (as for a null doc_id)."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))


def verified_manifest(docs: DataFrame, **options) -> DataFrame:
    """The manifest's digests per document, and what the proof of a document says once its text is tampered with."""
    found = manifest(docs, change=tampered_text(), **options)
    found = found.withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
