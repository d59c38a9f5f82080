import hashlib
import re
import struct

import xxhash
from helpers import odd_documents
from pyspark.sql import functions as F

from maskwright.llm.fingerprints import SKETCH, TOKEN, anchors, fingerprints, matches, with_next

PATTERN = re.compile(TOKEN.replace(r"\x{2E80}", "⺀").replace(r"\x{10FFFF}", "\U0010ffff"))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed=seed).intdigest()
    return signed(seed)


def plain_anchors(text):
    tokens = PATTERN.findall(text)
    h = [hashed(t) for t in tokens]
    found = []
    for i in range(len(h) - 4):
        s = [hashed(h[i + j], h[i + j + 1]) for j in range(4)]
        if s.index(min(s)) in (0, 3) or min(s) in (s[0], s[3]):
            found.append((i, hashed(s[0], s[2], s[3])))
    return found or [(0, hashed(*tokens))]


def plain_sketch(text):
    return sorted({h for _, h in plain_anchors(text)})[:SKETCH]


def plain_likeness(a, b):
    union = sorted(set(a) | set(b))[:SKETCH]
    return sum(x in a and x in b for x in union) / len(union)


def plain_fingerprints(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for k, (doc, text) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        own, e = plain_sketch(text), plain_sketch(edited)
        text_of = lambda s: ".".join(f"{x & (1 << 64) - 1:x}" for x in s)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(own), text_of(e), plain_likeness(own, e), plain_likeness(own, plain_sketch(follow))))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    docs = odd_documents(spark)
    got = fingerprints(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_fingerprints([(r.doc_id, r.text) for r in docs.collect()])
    assert fingerprints(docs.limit(0)).count() == 0


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr("maskwright.llm.fingerprints.BUCKET", 7)
    ids = [i * i for i in range(150)] + [-5, -4, None, None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    order = sorted((i for i in ids if i is not None), reverse=True) + [None, None]
    got = {r.text: r.next_text for r in with_next(docs, ["text"]).collect()}
    want = {f"t{a}": f"t{b}" for a, b in zip(order, order[1:] + order[:1])}
    want["tNone"] = got["tNone"]
    assert got == want and got["tNone"] in ("tNone", f"t{order[0]}")


def test_anchors_are_context_free(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b c d e f " + passage), (2, passage + " x y z")], "doc_id long, text string")
    hit = matches(docs.filter("doc_id = 1"), docs.filter("doc_id = 2")).orderBy(F.desc("anchors")).first()
    inside = spark.createDataFrame([(passage,)], "text string").select(F.size(anchors(F.col("text")))).first()[0]
    assert (hit.left_id, hit.right_id, hit["shift"]) == (1, 2, -6) and hit.anchors == inside
