"""Quality rules whose cutoffs are certified on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Words, binomial_tail, slices, staged, windows

#: The rules: a value from 0 up for each document, large where it looks bad. A cutoff is a step of 1/32.
RULES = ("symbols", "dup_lines", "repeats", "capitals", "marks", "long_words", "short_words", "brevity")
STEPS = 32
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_lines", "_capitals", "_letters", "_marks")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def repeated_words(words: Words, width: int = 5) -> np.ndarray:
    """Which words lie in a run of ``width`` words found twice or more in their text."""
    n = len(words)
    at, key = windows(words.hash, words.text, width)
    key = key + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = (key[a] == key[b]) & (words.text[at[a]] == words.text[at[b]])
    found = np.zeros(len(at), bool)
    found[a[same]] = found[b[same]] = True
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at[found], 1)
    np.add.at(steps, at[found] + width, -1)
    return np.cumsum(steps[:n]) > 0


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _line_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line of their text."""
    lines, again = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        lines[i], again[i] = len(own), len(own) - len(set(own))
    return lines, again


def count_batch(column: pa.Array) -> list[np.ndarray]:
    """The columns of COUNTS for each text of an Arrow column."""
    words = Words(column)
    data, offsets = words.data, words.offsets
    of_words = words.of
    ahead = (data & 0xC0) != 0x80
    spaces = np.isin(data, [9, 10, 11, 12, 13, 32])
    lines, again = _line_counts(column.to_pylist())
    return [
        np.diff(of_words), _per_text(ahead & ~spaces, offsets), _per_text(_SYMBOL[data], offsets), again,
        _per_text(repeated_words(words), of_words), lines, _per_text((data >= 65) & (data <= 90), offsets),
        _per_text((data >= 97) & (data <= 122) | (data >= 65) & (data <= 90), offsets), _per_text(_MARK[data], offsets),
    ]


def with_counts(docs: DataFrame, drop_text: bool = False) -> DataFrame:
    """Add the columns of COUNTS to ``docs``, which has a ``text``; null text counts as empty."""
    kept = [c for c in docs.columns if not (drop_text and c == "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + [f"{c} long" for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts = [pa.array(x.astype(np.int64)) for x in count_batch(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + counts, names=[*kept, *COUNTS])

    return docs.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_steps() -> dict[str, Column]:
    """The step of each rule's value for a document: 0 is clean, STEPS the worst."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    values = {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest("_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "capitals": F.col("_capitals") / F.greatest("_letters", F.lit(1)),
        "marks": F.col("_marks") / words,
        "long_words": (mean - 4) / 12,
        "short_words": (6 - mean) / 6,
        "brevity": (100 - F.col("n_words")) / 100,
    }
    return {k: F.ceil(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)) * STEPS).cast("int") for k, v in values.items()}


def losses_allowed(n: int, risk: float, doubt: float) -> int:
    """So many of ``n`` good documents may be rejected that, were the rejection rate ``risk``, so few would have a
    probability of at most ``doubt`` (the exact Clopper-Pearson bound); -1 if not even none."""
    low, high = -1, n
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if binomial_tail(k, n, risk) <= doubt else (low, k)
    return low


def paying_cutoff(good: np.ndarray, bad: np.ndarray, cost: float, most: float = float("inf")) -> tuple[float, int] | None:
    """What the cutoff c whose rule "step > c" pays best pays, and c; None if none pays or loses ``most`` at most.

    A cutoff pays by the bad documents it rejects, less ``cost`` for each good one. Among equals the most lenient is
    taken: the one in the middle of the gap that parts good from bad."""
    best = (0.0, 0, -2)
    lost = good.sum() - np.cumsum(good)
    won = bad.sum() - np.cumsum(bad)
    for c in range(STEPS):
        pays = won[c] - cost * lost[c]
        if good.sum() and pays > 0 and pays >= best[0] and lost[c] <= most:
            best = (pays, best[1] if pays == best[0] and best[2] == c - 1 else c, c)
    return None if best[2] < 0 else (float(best[0]), int((best[1] + best[2] + 1) // 2))


def certified_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, doubt: float, cost: float = 5.0) -> int | None:
    """The best paying cutoff of one rule among those whose losses ``risk`` and ``doubt`` allow, or None.

    ``good`` and ``bad`` count the labelled documents at each step."""
    found = paying_cutoff(good, bad, cost, losses_allowed(int(good.sum()), risk, doubt))
    return None if found is None else found[1]


def _rule_order(marked: DataFrame, cost: float) -> DataFrame:
    """(_stratum, _rule, _cut, _k): the rules that pay with their cutoffs and their places in the order.

    The best paying rule comes first, each further one is the best on what those before it leave. Only the half of
    the good documents that is for fitting is looked at, where each stands for two, and all bad ones."""
    rest = marked.filter("_fit or _quality = 0").withColumn("_used", F.array().cast("array<string>"))

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for rule in RULES:
            own = rows[rows["rule"] == rule]
            counts = [np.bincount(x["step"], x["count"], STEPS + 1) for x in (own[own["_quality"] == 1], own[own["_quality"] == 0])]
            if pays := paying_cutoff(*counts, 2 * cost):
                found.append((pays[0], rule, pays[1]))
        _, rule, cut = max(found, key=lambda x: x[0], default=(0, None, None))
        return pd.DataFrame({"_stratum": [key[0] if isinstance(key[0], str) else None], "_rule": [rule], "_cut": [cut]}).astype({"_cut": "Int32"})

    order = None
    for k in range(len(RULES)):
        long = rest.select("_stratum", "_quality", "_used", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("_r"))
        table = long.filter(~F.array_contains("_used", F.col("_r.rule"))).groupBy("_stratum", "_quality", F.col("_r.rule").alias("rule"), F.col("_r.step").alias("step")).count()
        best = staged(table.groupBy("_stratum").applyInPandas(choose, "_stratum string, _rule string, _cut int").filter("_rule is not null"))
        ranked = best.withColumn("_k", F.lit(k))
        order = ranked if order is None else order.union(ranked)
        if best.isEmpty():
            break
        right = best.withColumnRenamed("_stratum", "_s")
        rest = rest.join(right, rest["_stratum"].eqNullSafe(right["_s"]))
        step = F.coalesce(*[F.when(F.col("_rule") == r, F.col(r)) for r in RULES])
        rest = rest.filter(step <= F.col("_cut")).withColumn("_used", F.concat("_used", F.array("_rule"))).drop("_s", "_rule", "_cut")
    return order


def shares_of_doubt(sizes: dict[int, int], risk: float, doubt: float) -> int:
    """Among how many strata ``doubt`` is shared; ``sizes``: how many strata have so many good documents.

    Tarone's correction: a stratum too small to be certified at its share, were nothing of it lost, takes none."""
    k = 1
    while sum(many for n, many in sizes.items() if (1 - risk) ** n <= doubt / k) > k:
        k += 1
    return k


def certified_cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, doubt: float = 0.05, cost: float = 5.0) -> DataFrame:
    """(stratum, one cutoff column per rule), null where none is certified.

    Labelled documents that pass the base rules count. In each stratum half of the good ones, by a hash of the id,
    and the bad ones fit an order of rules with a cutoff each. That makes one sequence from lenient to strict: the
    first rule's cutoff sinks to its place, then the second's, and so on; a document's badness is where in it the
    document is rejected. The other half of the good ones tests the sequence: its losses only grow, so the tests
    form a fixed sequence and none needs a share of ``doubt``, which is shared among the strata alone. So with
    probability 1 - doubt, all rules together reject at most ``risk`` of the good documents of every stratum. Of
    the certified places the best paying is taken. A document labelled twice counts as bad if one label says so.
    Labels without a matching document, null labels and null ids don't count."""
    labels = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    fit = (F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(2)) == 0).alias("_fit")
    marked = counted.filter(~base_failed()).join(labels, "doc_id")
    marked = staged(marked.select(F.col(stratum).alias("_stratum"), "_quality", fit, *[v.alias(k) for k, v in rule_steps().items()]))
    order = staged(_rule_order(marked, cost))
    entry = F.struct(F.col("_rule").alias("key"), F.struct(F.col("_k").alias("k"), F.col("_cut").alias("cut")).alias("value"))
    right = order.groupBy(F.col("_stratum").alias("_s")).agg(F.map_from_entries(F.collect_list(entry)).alias("_path"))
    tested = marked.filter("not _fit or _quality = 0").join(right, marked["_stratum"].eqNullSafe(right["_s"]))
    # the rank of a place is k * STEPS + STEPS - 1 - cutoff; a document goes at the first cutoff below its step
    ranks = [F.when(F.col(r) > F.col("_path")[r]["cut"], F.col("_path")[r]["k"] * STEPS + STEPS - F.col(r)) for r in RULES]
    table = staged(tested.groupBy("_stratum", "_quality", F.coalesce(F.least(*ranks), F.lit(len(RULES) * STEPS)).alias("rank")).count())
    sizes = table.filter("_quality = 1").groupBy("_stratum").agg(F.sum("count").alias("n")).groupBy("n").count()
    share = doubt / shares_of_doubt({r[0]: r[1] for r in sizes.collect()}, risk, doubt)

    def choose(key: tuple, rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"_stratum": [key[0][1:] if key[0] else None]} | {r: [None] for r in RULES}
        at = sorted(zip(path["_k"], path["_rule"], path["_cut"], strict=True))
        good, bad = (np.bincount(x["rank"], x["count"], len(RULES) * STEPS + 1) for x in (rows[rows["_quality"] == 1], rows[rows["_quality"] == 0]))
        lost, won = np.cumsum(good), np.cumsum(bad)
        most, best, last = losses_allowed(int(good.sum()), risk, share), 0.0, -1
        for k, _, cut in at:  # within a rule the strictest of equals, its fitted cutoff; a further rule must win
            ranks = np.arange(k * STEPS, k * STEPS + STEPS - cut)
            pays = np.where(lost[ranks] <= most, won[ranks] - 2 * cost * lost[ranks], -np.inf)
            if pays.max() > best:
                best, last = pays.max(), int(ranks[np.flatnonzero(pays == pays.max())[-1]])
        for k, rule, cut in at:
            if k * STEPS <= last:
                out[rule] = [max(cut, STEPS - 1 - (last - k * STEPS))]
        return pd.DataFrame(out).astype({r: "Int32" for r in RULES})

    keyed = [x.withColumn("_key", F.coalesce(F.concat(F.lit("="), "_stratum"), F.lit(""))).groupBy("_key") for x in (table, order)]
    return keyed[0].cogroup(keyed[1]).applyInPandas(choose, "_stratum string, " + ", ".join(f"{r} int" for r in RULES))


def judged(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept``: no base rule failed, and no rule of the stratum is above its cutoff."""
    right = cutoffs.select(F.col("_stratum"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    rows = counted.join(right, counted[stratum].eqNullSafe(right["_stratum"]), "left")
    over = [F.coalesce(step > F.col(f"_cut_{r}"), F.lit(False)) for r, step in rule_steps().items()]
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad).drop(*right.columns)


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept.

    A null or empty text has no words and fails. A document whose language is null belongs to a stratum of its
    own; a stratum with few good labels (under 59 in the tested half, more if several share the doubt) gets no cutoffs,
    so only the base rules hold there."""
    counted = staged(with_counts(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), drop_text=True))
    cutoffs = staged(certified_cutoffs(counted, labels, **options))
    return judged(counted, cutoffs).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    counted = staged(with_counts(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), drop_text=True))
    cutoffs = staged(certified_cutoffs(counted, labels, **options))
    names = docs.columns
    return judged(with_counts(docs), cutoffs).filter("kept").select(*names)
