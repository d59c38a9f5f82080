import hashlib
import zlib

import pytest
from helpers import odd_documents
from pyspark.sql import functions as F

from maskwright.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, i, fanout):
    for nodes in levels[:-1]:
        a = i - i % fanout
        yield nodes[a:i], nodes[i + 1 : a + fanout]
        i //= fanout


def plain(rows, fanout=3):
    """All of the query's columns, hashed one after the other."""
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    trees = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(groups[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((members, tree([leaf(r, r["text"]) for r in members], fanout)))
    top, out = tree([levels[-1][0] for _, levels in trees], fanout), []
    for k, (members, levels) in enumerate(trees):
        for i, row in enumerate(members):
            proof, text = [*way(levels, i, fanout), *way(top, k, fanout)], row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(row, text)
            for left, right in proof:
                node = digest(*left, node, *right)
            root = top[-1][0]
            out.append((row["doc_id"], levels[0][i], levels[-1][0], root, digest(*(x for a, b in proof for x in a + b)), node, node == root))
    return sorted(out, key=repr)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("levels", [7, 1, 0])
def test_odd_rows(spark, levels):
    docs = odd_documents(spark)
    assert collected(merkle.verified_manifest(docs, levels=levels)) == plain([r.asDict() for r in docs.collect()])


def test_blocks_of_a_hot_source_learn_their_proofs_from_each_other(spark):
    """28 blocks in one tree and a last subtree that is not full, beside trees of one block and of one leaf."""
    source = F.when(F.col("id") < 249, "hot").when(F.col("id") < 300, F.concat(F.lit("s"), F.col("id") % 7)).otherwise(F.concat(F.lit("t"), "id"))
    docs = spark.range(304).select(F.col("id").alias("doc_id"), source.alias("source"), F.lit("en").alias("lang"),
                                   F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("a\n"), F.col("id") % 5).alias("text"))
    docs = docs.repartition(5)
    rows = [r.asDict() for r in docs.collect()]
    assert collected(merkle.verified_manifest(docs, levels=2)) == plain(rows)
    assert collected(merkle.verified_manifest(docs, fanout=2, levels=3)) == plain(rows, 2)


def test_a_proof_leads_to_the_root_and_a_changed_row_does_not(spark):
    docs = odd_documents(spark)
    found = merkle.manifest(docs, levels=1, change=F.concat("text", F.lit("!")))
    found = found.select("leaf", "changed_leaf", "root", "proof", merkle.folded(F.col("leaf"), F.col("proof")).alias("same"),
                         merkle.folded(F.coalesce("changed_leaf", "leaf"), F.col("proof")).alias("other"))
    for row in found.collect():
        assert row["same"] == row["root"]
        assert (row["other"] == row["root"]) == (row["changed_leaf"] is None)


def test_empty_table(spark):
    assert merkle.verified_manifest(odd_documents(spark).limit(0)).collect() == []
