"""The queries of the text operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import (
    bpe, chat, fingerprints, licenses, lines, merkle, mixing, packing, phrases, quality, similarity, substrings, toxicity)
from maskwright.llm.common import documents


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(mixing.mix(documents(spark, sf_dir)))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_verdicts(documents(spark, sf_dir), labels)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_lines_removed(documents(spark, sf_dir), ["doc_id", "text"])


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.document_classes(documents(spark, sf_dir))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_paragraphs(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(documents(spark, sf_dir))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_source_mixing, op2_chat_formatting, op3_quality_rules, op4_line_dedup, op5_ngram_jaccard_join,
        op6_document_fingerprints, op7_substring_dedup, op8_license_scan, op9_packing, op10_toxicity,
        op11_phrase_mining, op12_merkle_manifest, op13_bpe)
}

ORACLE: dict[str, str] = {}

ORACLE["op1_source_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS mark
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight FROM sources),
ratios AS (SELECT *, (source_size * 2)::DOUBLE / weight AS ratio FROM weighed),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5
    - coalesce(sum(source_size * 2) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ratios),
targets AS (
  SELECT source, source_size,
    least((source_size * 2)::DOUBLE, coalesce((SELECT max(level) FROM levels WHERE level <= ratio), 'inf'::DOUBLE) * weight) AS target
  FROM levels),
laid AS (
  SELECT docs.*, source_size, target, round(target)::BIGINT AS words,
    (sum(size) OVER (PARTITION BY docs.source ORDER BY mark, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(words, start + size) - start)
   + greatest(0, least(words, source_size + start + size) - (source_size + start)))::BIGINT AS taken
FROM laid
"""

ORACLE["op7_substring_dedup"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
starts AS (SELECT r, d, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE len(words) >= 50),
windows AS (SELECT r, d, i, md5(array_to_string(words[i:i+49], ' ')) AS w FROM starts),
firsts AS (SELECT w, min(d) AS first FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT r, i FROM windows JOIN firsts USING (w) WHERE first < d),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM hits),
placed AS (SELECT r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS j FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS t FROM placed ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

ORACLE["op2_chat_formatting"] = r"""
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS t
  FROM conversations),
prefixes AS (SELECT conv_id, place, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY place) AS p FROM ordered),
whole AS (SELECT conv_id, max(place) AS n, arg_max(p, place) AS p FROM prefixes GROUP BY conv_id),
single AS (SELECT min(conv_id) AS conv_id, n, p, count(*)::BIGINT AS logged FROM whole GROUP BY n, p),
proper AS (SELECT DISTINCT prefixes.p FROM prefixes JOIN whole w ON prefixes.conv_id IS NOT DISTINCT FROM w.conv_id WHERE place < n)
SELECT conv_id, n::BIGINT AS n_turns, logged, p AS text FROM single WHERE p NOT IN (SELECT p FROM proper)
"""

ORACLE["op11_phrase_mining"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM worded GROUP BY lang),
places AS (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM worded, range(1, 6) AS sizes(size)),
counts AS (SELECT lang, size, words[i : i + size - 1] AS words, count(*)::HUGEINT AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM counts WHERE size > 1),
parts AS (SELECT lang, words AS longer, size, f, unnest(range(2, size)) AS part FROM candidates),
inside AS (SELECT lang, longer, f, part, unnest(range(1, size - part + 2)) AS i FROM parts),
covered AS (SELECT lang, longer[i : i + part - 1] AS words, max(f) AS f FROM inside GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN covered v ON c.lang = v.lang AND c.words = v.words
  WHERE v.f IS NULL OR 100 * v.f < 100 * c.f),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
valued AS (
  SELECT cuts.lang, cuts.words, cuts.f AS a, k, x.f AS l, y.f AS r, n, (1000 * cuts.f * n) // (x.f * y.f) AS score
  FROM cuts JOIN totals USING (lang)
  JOIN counts x ON x.lang = cuts.lang AND x.words = cuts.words[1:k]
  JOIN counts y ON y.lang = cuts.lang AND y.words = cuts.words[k + 1:]),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(words, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
  FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


ORACLE["op12_merkle_manifest"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS stripped,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
  FROM documents),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM docs GROUP BY source),
leaves AS (
  SELECT docs.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM docs JOIN sources ON docs.source IS NOT DISTINCT FROM sources.source),
nodes AS (
  SELECT tree, 0::BIGINT AS level, place::BIGINT AS place, leaf AS node, n::BIGINT AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 2) // 3)
  FROM nodes WHERE n > 1 GROUP BY tree, level, place // 3),
subroots AS (SELECT tree, level AS height, node AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0::BIGINT AS level, tree::BIGINT AS place, subroot AS node, (SELECT count(*) FROM subroots)::BIGINT AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 2) // 3)
  FROM tops WHERE n > 1 GROUP BY level, place // 3),
runs AS (
  SELECT tree, level, place // 3 AS run, list(struct_pack(place := place, node := node) ORDER BY place) AS members
  FROM nodes WHERE n > 1 GROUP BY tree, level, place // 3),
top_runs AS (SELECT level, place // 3 AS run, list(struct_pack(place := place, node := node) ORDER BY place) AS members FROM tops WHERE n > 1 GROUP BY level, place // 3),
steps AS (
  SELECT l.tree, l.place, level, place // (3 ** level)::BIGINT AS own, members
  FROM leaves l JOIN subroots s USING (tree), LATERAL (
    SELECT level, members FROM runs r WHERE r.tree = l.tree AND r.run = l.place // (3 ** (r.level + 1))::BIGINT)
  UNION ALL
  SELECT l.tree, l.place, height + t.level, l.tree // (3 ** t.level)::BIGINT, members
  FROM leaves l JOIN subroots s USING (tree) JOIN top_runs t ON t.run = l.tree // (3 ** (t.level + 1))::BIGINT),
sides AS (
  SELECT tree, place, level,
    array_to_string(list_transform(list_filter(members, lambda m: m.place < own), lambda m: m.node), '') AS l,
    array_to_string(list_transform(list_filter(members, lambda m: m.place > own), lambda m: m.node), '') AS r
  FROM steps),
proofs AS (
  SELECT tree, place, list(struct_pack(l := l, h := '', r := r) ORDER BY level) AS runs, string_agg(l || r, '' ORDER BY level) AS siblings
  FROM sides GROUP BY tree, place),
folded AS (
  SELECT leaves.*, subroot, (SELECT node FROM tops WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(l := '', h := CASE WHEN crc % 2 = 0 THEN stripped ELSE leaf END, r := ''), coalesce(runs, [])),
      lambda a, b: struct_pack(l := '', h := sha256(b.l || a.h || b.r), r := '')).h AS folded_root
  FROM leaves JOIN subroots USING (tree) LEFT JOIN proofs USING (tree, place))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
