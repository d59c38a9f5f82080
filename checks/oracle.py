"""The same results in plain SQL, for an engine that shares no code with Spark."""

from __future__ import annotations

from checks.queries import DERIVED, EXPECTED, FULL, RULES, SCANNED, TABLE, TRUTH
from checks.views import PII_COLUMNS, edges_sql, pii_sql
from maskwright import vocab as V
from maskwright.functions.text import ACCENTED, PLAIN
from maskwright.operators import generation as G
from maskwright.plans import suites

# Columns of the given tables, as the catalog scan sees them.
COLUMNS = {
    "embeddings": ("vec_id", "embedding", "label"),
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}

_SPACES = ("chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)"
           "||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)"
           "||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(x):
        if isinstance(x, bool):
            return str(x).lower()
        return q(x) if isinstance(x, str) else repr(x)
    return "VALUES " + ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


def strict_match(tag: str, v: str = "v") -> str:
    """Match of the stripped value, written apart from the Spark patterns."""
    pattern = {
        "RESIDENT_ID": r"^0\p{Nd}{11}$",
        "PHONE": r"^(03|05|07|08|09)\p{Nd}{8}$",
        "EMAIL": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
        "HEALTH_INSURANCE_ID": r"^[A-Z]{2}\p{Nd}{13}$",
    }[tag]
    return f"regexp_matches(trim({v}, {_SPACES}), {q(pattern)})"


def semantic_match(tag: str) -> str:
    dob = f"regexp_matches(v, {q(V.DOB_PATTERN)})"
    salary = f"regexp_matches(v, {q(V.SALARY_PATTERN)})"
    address = (f"(regexp_matches(v, {q(V.ADDRESS_PATTERN)}) "
               f"AND NOT regexp_matches(v, {q(V.ORGANISATION_PATTERN)}))")
    name = f"(regexp_matches(v, {q(V.NAME_PATTERN)}) AND NOT {address})"
    return {"DOB": dob, "SALARY": salary, "ADDRESS": address, "NAME": name}[tag]


TAGS = V.STRICT_TAGS + V.SEMANTIC_TAGS


def long_sql(source: str, columns) -> str:
    """(ordinal, column_name, v) of all cells as text, nulls left out."""
    texts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns)
    names = ", ".join(f'"{c}"' for c in columns)
    position = "CASE column_name " + " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(columns)) + " END"
    return (f"SELECT {position} AS ordinal, column_name, v FROM "
            f"(UNPIVOT (SELECT {texts} FROM ({source})) ON {names} INTO NAME column_name VALUE v)")


def counts_sql(source: str, columns, long: str | None = None) -> str:
    """One row per column: ordinal, column_name, n_values and a count per tag."""
    sums = ", ".join(
        f"count(*) FILTER (WHERE {strict_match(t) if t in V.STRICT_TAGS else semantic_match(t)}) AS n_{t.lower()}"
        for t in TAGS
    )
    year = "TRY_CAST(regexp_extract(v, '([0-9]{4})', 1) AS INTEGER)"
    sums += f", quantile_disc({year}, 0.5) FILTER (WHERE {semantic_match('DOB')}) AS median_year"
    sums += f", count(DISTINCT v) FILTER (WHERE {semantic_match('NAME')} OR {semantic_match('ADDRESS')}) AS n_texts"
    zero = ", ".join(f"coalesce(n_{t.lower()}, 0) AS n_{t.lower()}" for t in TAGS) + ", median_year, coalesce(n_texts, 0) AS n_texts"
    return (
        f"SELECT a.ordinal, a.column_name, coalesce(n_values, 0) AS n_values, {zero} "
        f"FROM ({values([(i, c) for i, c in enumerate(columns)])}) a(ordinal, column_name) LEFT JOIN ("
        f"SELECT ordinal, count(*) AS n_values, {sums} FROM ({long or long_sql(source, columns)}) "
        f"WHERE trim(v, ' ') <> '' GROUP BY ordinal) USING (ordinal)"
    )


def share(tag: str) -> str:
    return f"(CASE WHEN n_values > 0 THEN n_{tag.lower()} / n_values ELSE 0.0 END)"


def scores_sql(counts: str) -> str:
    """Adds s_<tag>, regex_status, cand (first candidate), candidates and detected."""
    shares = ", ".join(f"{share(t)} AS s_{t.lower()}" for t in TAGS)
    listed = ", ".join(
        f"{{'tag': {q(t)}, 'score': s_{t.lower()}, 'w': {V.TAGS[t][1]}, 'o': {i}}}"
        for i, t in enumerate(V.STRICT_TAGS)
    )
    return f"""
SELECT *, CASE WHEN len(passing) > 0 THEN 'SUCCESS' ELSE 'UNDETERMINED' END AS regex_status,
  CASE WHEN len(passing) > 0 THEN [passing[1].tag]
       ELSE list_transform(ranked, lambda d: d.tag) END AS candidates,
  list_transform(detected, lambda d: d.tag || ':' || CAST(d.score AS VARCHAR)) AS parts
FROM (SELECT *,
  (SELECT list(d ORDER BY d.score DESC, d.w DESC) FROM unnest(detected) u(d) WHERE d.score >= 0.7) AS passing,
  (SELECT list(d ORDER BY d.score DESC, d.o) FROM unnest(detected) u(d)) AS ranked
FROM (SELECT *, list_filter([{listed}], lambda d: d.score > 0) AS detected
FROM (SELECT *, {shares} FROM ({counts}))))"""


SUFFIX = ("CASE WHEN len(parts) > 0 THEN ' - Regex tags detection: ' || array_to_string(parts, ', ') ELSE '' END")


def _case(column: str, position: int, default) -> str:
    def lit(x):
        return q(x) if isinstance(x, str) else str(x)
    whens = " ".join(f"WHEN {q(t)} THEN {lit(row[position])}" for t, row in V.TAGS.items())
    return f"CASE {column} {whens} ELSE {lit(default)} END"


def level(column: str) -> str:
    return _case(column, 0, "NONE")


def answers_sql(scores: str) -> str:
    """Adds m_pii, m_tag, m_conf and m_reason: the second opinion."""
    parts = []
    for t in TAGS:
        base = V.SEMANTIC_BASE[t]
        cue = f"CASE WHEN regexp_matches(lower(column_name), {q(V.name_cue_pattern(t))}) THEN 0.1::DOUBLE ELSE 0 END"
        value = f"least(1.0::DOUBLE, {base}::DOUBLE + {1.0 - base}::DOUBLE * s_{t.lower()} + {cue})"
        known = f"s_{t.lower()} >= 0.5"
        if t == "DOB":
            known += f" AND (median_year <= {V.BIRTH_MEDIAN} OR {cue} > 0)"
        if t in ("NAME", "ADDRESS"):
            known += f" AND (n_texts >= least({V.MANY_VALUES}, {V.MANY_SHARE} * n_values) OR {cue} > 0)"
        parts.append(
            f"{{'c': CASE WHEN {known} THEN round({value}, 6) ELSE 0.0::DOUBLE END, "
            f"'w': {V.TAGS[t][1]}, 't': {q(t)}, 's': s_{t.lower()}}}"
        )
    return f"""
SELECT *, best.c > 0.7 AS m_pii, CASE WHEN best.c > 0.7 THEN best.t ELSE 'NONE' END AS m_tag,
  CASE WHEN best.c > 0.7 THEN best.c ELSE round(1.0::DOUBLE - best.c, 6) END AS m_conf,
  CASE WHEN best.c > 0.7 THEN CAST(CAST(floor(best.s * 100 + 0.5) AS INTEGER) AS VARCHAR)
       || '% of values look like ' || best.t
       ELSE 'No tag has clear evidence in the values' END AS m_reason
FROM (SELECT *, (SELECT d FROM unnest([{', '.join(parts)}]) u(d) ORDER BY d.c DESC, d.w DESC LIMIT 1) AS best
FROM ({scores}))"""


_DECIDE = """
SELECT table_name, column_name, pii AS is_pii, tag AS sensitivity_tag, {level} AS sensitivity_level,
  score AS confidence_score, method AS detection_method,
  word || {suffix} || CASE WHEN regex_status = 'UNDETERMINED' THEN ' - LLM reason: ' || m_reason ELSE '' END AS reason
FROM (SELECT *,
  row_no IN (1, 3, 4) AS pii,
  CASE WHEN row_no IN (1, 3) THEN cand WHEN row_no = 4 THEN m_tag ELSE 'NONE' END AS tag,
  CASE WHEN row_no IN (1, 3) THEN cand_score WHEN row_no IN (2, 4) THEN m_conf ELSE 1.0 END AS score,
  CASE row_no WHEN 1 THEN 'REGEX' WHEN 4 THEN 'LLM' ELSE 'HYBRID' END AS method,
  CASE row_no WHEN 1 THEN 'Detected PII fully by Regex'
    WHEN 2 THEN 'Regex detected PII but LLM did not detect any'
    WHEN 3 THEN 'Detected PII by LLM and Regex, finally chosen by Regex'
    WHEN 4 THEN 'Detected PII fully by LLM' ELSE 'No PII detected by Regex or LLM' END AS word
FROM (SELECT *, CASE WHEN regex_status = 'SUCCESS' THEN 1 WHEN cand <> 'NONE' AND NOT m_pii THEN 2
    WHEN cand <> 'NONE' THEN 3 WHEN m_pii AND m_tag <> 'NONE' THEN 4 ELSE 5 END AS row_no FROM ({answered})))
"""


def verdicts_sql(source: str, columns, table: str, long: str | None = None) -> str:
    answered = (
        f"SELECT *, {q(table)} AS table_name, coalesce(candidates[1], 'NONE') AS cand, "
        f"coalesce(list_filter(detected, lambda d: d.tag = candidates[1])[1].score, 0.0) AS cand_score "
        f"FROM ({answers_sql(scores_sql(counts_sql(source, columns, long)))})"
    )
    return _DECIDE.format(level=level("tag"), suffix=SUFFIX, answered=answered)


PII = pii_sql("orders")
EDGES = edges_sql("orders")
PII_SCORES = scores_sql(counts_sql(PII, PII_COLUMNS))
PII_VERDICTS = verdicts_sql(PII, PII_COLUMNS, TABLE)


def drawn_sql(source: str, key: str = "k") -> str:
    return f"SELECT *, md5('42:' || CAST({key} AS VARCHAR)) AS draw FROM ({source})"


def sample_sql(source: str, n: int) -> str:
    """About 5n rows by hash threshold, the 3n smallest hashes of them."""
    fraction = f"(SELECT least(5 * {n} / count(*), 1.0) FROM ({source}))"
    bound = (f"CASE WHEN {fraction} >= 1.0 THEN 'g' "
             f"ELSE format('{{:016x}}', CAST(floor({fraction} * 18446744073709551616.0::DOUBLE) AS UBIGINT)) END")
    return f"SELECT * FROM ({drawn_sql(source)}) WHERE draw < {bound} ORDER BY draw LIMIT {3 * n}"


def sample_values_sql(source: str, columns, n: int) -> str:
    """(ordinal, column_name, v, rank): the first n non-blank sampled values."""
    texts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns)
    names = ", ".join(f'"{c}"' for c in columns)
    position = "CASE column_name " + " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(columns)) + " END"
    return (
        f"SELECT * FROM (SELECT {position} AS ordinal, column_name, v, "
        f"row_number() OVER (PARTITION BY column_name ORDER BY draw) AS rank FROM "
        f"(UNPIVOT (SELECT draw, {texts} FROM ({sample_sql(source, n)})) ON {names} INTO NAME column_name VALUE v) "
        f"WHERE trim(v, ' ') <> '') WHERE rank <= {n}"
    )


def sample_lists_sql(n: int, m: int) -> str:
    return (
        f"SELECT {q(TABLE)} AS table_name, a.ordinal, a.column_name, coalesce(vs, []) AS vs, "
        f"coalesce(vs[1:{m}], []) AS ms "
        f"FROM ({values([(i, c) for i, c in enumerate(PII_COLUMNS)])}) a(ordinal, column_name) LEFT JOIN "
        f"(SELECT ordinal, list(v ORDER BY rank) AS vs FROM ({sample_values_sql(PII, PII_COLUMNS, n)}) "
        f"GROUP BY ordinal) USING (ordinal)"
    )


# --- masks -------------------------------------------------------------------------

def words_mask(v: str) -> str:
    """Star all but the first character of every run of non-space characters."""
    # RE2 and Java agree on \s but for the vertical tab, which no table holds.
    return (f"array_to_string(list_transform(regexp_extract_all({v}, '\\s+|\\S+'), lambda w: "
            f"CASE WHEN regexp_matches(w, '^\\s') THEN w ELSE left(w, 1) || repeat('*', length(w) - 1) END), '')")


def partial(v: str) -> str:
    domain = f"string_split({v}, '@')[2]"
    return f"""CASE WHEN contains({v}, '@') THEN substring({v}, 1, 1)
    || repeat('*', greatest(0, length({v}) - length({domain}) - 2)) || '@' || {domain}
  WHEN contains({v}, ' ') THEN {words_mask(v)}
  WHEN length({v}) >= 6 THEN left({v}, 3) || repeat('*', greatest(0, length({v}) - 7)) || right({v}, 4)
  ELSE '[INVALID_DATA]' END"""


def mask(rule: str, column: str) -> str:
    v = f'CAST("{column}" AS VARCHAR)'
    return {
        "HASH_MASK": f"sha256({v})",
        "REDACTED_MASK": "'REDACTED'",
        "NULLIFY_MASK": "CAST(NULL AS VARCHAR)",
        "PARTIAL_MASK": partial(v),
        "CLEAR_TEXT": f'"{column}"',
    }[rule]


def masked_frame(source: str, columns, rules: dict) -> str:
    return "SELECT " + ", ".join(
        f'{mask(rules.get(c, "CLEAR_TEXT"), c)} AS "{c}"' for c in columns
    ) + f" FROM ({source})"


def secured(role: str, source: str, columns=PII_COLUMNS) -> str:
    """Masks chosen per column by the verdict tables of this engine's own scan."""
    inner = []
    for c in columns:
        rule = f"(SELECT r.rule FROM verdict v JOIN rules r USING (sensitivity_level) WHERE v.column_name = {q(c)})"
        text = f'CAST("{c}" AS VARCHAR)'
        inner.append(
            f"CASE {rule} WHEN 'HASH_MASK' THEN sha256({text}) WHEN 'REDACTED_MASK' THEN 'REDACTED' "
            f"WHEN 'NULLIFY_MASK' THEN NULL WHEN 'PARTIAL_MASK' THEN {partial(text)} ELSE {text} END AS \"{c}\""
        )
    rules = values([(lv, rule) for lv, rule in V.POLICIES[role].items()])
    return (f"WITH verdict AS MATERIALIZED ({PII_VERDICTS}), rules(sensitivity_level, rule) AS ({rules}) "
            f"SELECT {', '.join(inner)} FROM ({source})")


def keep_type(sql: str, column: str = "k") -> str:
    return f'SELECT * REPLACE (CAST("{column}" AS BIGINT) AS "{column}") FROM ({sql})'


# --- metadata ------------------------------------------------------------------------

_TAG_LIST = "[" + ", ".join(q(t) for t in V.TAGS) + "]"
META_COLUMNS = (
    f"SELECT o_custkey AS table_id, 'c' || o_orderkey AS column_name, lower({_TAG_LIST}[o_orderkey % 9 + 1]) "
    f"AS sensitivity_tag, ['HIGH','MEDIUM','LOW','NONE'][o_orderkey % 4 + 1] AS sensitivity_level, "
    f"'REGEX' AS detection_method, 1.0::DOUBLE AS confidence_score, o_orderkey AS ordinal FROM orders"
)
POLICY_ROWS = values([(r, lv, rule) for r, levels in V.POLICIES.items() for lv, rule in levels.items()])


def policies_sql(role: str) -> str:
    return (
        f"SELECT c_name AS table_name, column_name, m.sensitivity_level, masking_rule FROM ({META_COLUMNS}) m "
        f"JOIN customer ON table_id = c_custkey JOIN ({POLICY_ROWS}) p(role_name, sensitivity_level, masking_rule) "
        f"ON p.sensitivity_level = m.sensitivity_level AND role_name = {q(role)}"
    )


ACCESSED = (f"SELECT c_name AS table_name, ordinal, column_name FROM ({META_COLUMNS}) "
            f"JOIN customer ON table_id = c_custkey")
KNOWN = f"SELECT * FROM ({policies_sql('ANALYST')}) WHERE sensitivity_level IN ('MEDIUM', 'LOW')"
AUDITED = f"""SELECT a.table_name, ordinal, a.column_name, coalesce(masking_rule, 'NONE') AS action,
  coalesce(sensitivity_level, 'NONE') AS sensitivity_level,
  coalesce(masking_rule, 'NONE') NOT IN ('NONE', 'CLEAR_TEXT') AS is_masked
FROM ({ACCESSED}) a LEFT JOIN ({KNOWN}) k ON a.table_name = k.table_name AND a.column_name = k.column_name"""

TRUTH_ROWS = values([(TABLE, c, t, V.TAGS[t][0]) for c, t in TRUTH.items()])
MATRIX = f"""
SELECT t.table_name,
  count(*) FILTER (WHERE t.tag <> 'NONE' AND p.sensitivity_tag <> 'NONE') AS tp,
  count(*) FILTER (WHERE t.tag = 'NONE' AND p.sensitivity_tag <> 'NONE') AS fp,
  count(*) FILTER (WHERE t.tag <> 'NONE' AND p.sensitivity_tag = 'NONE') AS fn,
  count(*) FILTER (WHERE t.tag = 'NONE' AND p.sensitivity_tag = 'NONE') AS tn,
  count(*) FILTER (WHERE p.sensitivity_tag IS NULL) AS missing,
  count(*) FILTER (WHERE t.level = p.sensitivity_level) AS level_hits,
  count(*) AS n_columns
FROM ({TRUTH_ROWS}) t(table_name, column_name, tag, level)
LEFT JOIN ({PII_VERDICTS}) p ON p.table_name = t.table_name AND p.column_name = t.column_name
GROUP BY t.table_name"""
RATED = f"""
SELECT *, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * (precision * recall) / (precision + recall)
  ELSE 0.0 END AS f1_score, level_hits / n_columns AS level_accuracy
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM ({MATRIX}))"""

EXPECTED_ROWS = values([(TABLE, *row) for row in EXPECTED])


def compliance_sql(role: str) -> str:
    """(role_name, column_name, masking_rule, must_mask, n_rows, n_ok) of all columns."""
    rules = {c: V.POLICIES[role][V.TAGS[t][0]] for c, t in TRUTH.items()}
    parts = []
    for c, t in FULL.items():
        rule = "CLEAR_TEXT" if t == "NONE" else V.POLICIES[role][V.TAGS[t][0]]
        v = f'CAST("{c}" AS VARCHAR)'
        test = {
            "HASH_MASK": f"length({v}) = 64",
            "NULLIFY_MASK": f"{v} IS NULL",
            "REDACTED_MASK": f"{v} = 'REDACTED'",
            "PARTIAL_MASK": f"contains({v}, '*')" + (f" AND contains({v}, '@')" if "email" in c else "")
            + (f" AND contains({v}, ' ')" if "name" in c or "c03" in c else ""),
            "CLEAR_TEXT": f"{v} <> 'REDACTED' AND NOT contains({v}, '*')",
        }[rule]
        parts.append(
            f"SELECT {q(role)} AS role_name, {q(c)} AS column_name, {q(rule)} AS masking_rule, "
            f"{str(rule != 'CLEAR_TEXT').lower()} AS must_mask, count(*) AS n_rows, "
            f"count(*) FILTER (WHERE {test}) AS n_ok FROM secured_{role}"
        )
    secured_cte = f"secured_{role} AS MATERIALIZED ({masked_frame(PII, PII_COLUMNS, rules)})"
    return f"SELECT * FROM (WITH {secured_cte} " + " UNION ALL ".join(parts) + ")"


ALL_COMPLIANCE = " UNION ALL ".join(compliance_sql(role) for role in V.ROLES)


def rate_sql(must_mask: bool, name: str) -> str:
    return (
        f"SELECT r.role_name, count(column_name) AS n_checked, "
        f"count(*) FILTER (WHERE n_ok = n_rows) AS n_passed, CASE WHEN count(column_name) > 0 "
        f"THEN count(*) FILTER (WHERE n_ok = n_rows) / count(column_name) * 100 ELSE 100.0 END AS {name} "
        f"FROM ({values([(r,) for r in V.ROLES])}) r(role_name) LEFT JOIN (SELECT * FROM ({ALL_COMPLIANCE}) "
        f"WHERE must_mask = {str(must_mask).lower()}) c ON c.role_name = r.role_name GROUP BY r.role_name"
    )


RUNS = "SELECT event_type AS role_name, CAST(value AS DECIMAL(27, 9)) AS d FROM events"
TRIMMED = ("SELECT role_name, CASE WHEN count(d) > 1 THEN sum(d) - max(d) ELSE sum(d) END AS total, "
           f"CASE WHEN count(d) > 1 THEN count(d) - 1 ELSE count(d) END AS n FROM ({RUNS}) GROUP BY role_name")
TRIMMED_MEAN = (f"SELECT role_name, CAST(sum(n) AS BIGINT) AS n_runs, CAST(sum(total) AS DOUBLE) / sum(n) AS mean "
                f"FROM ({TRIMMED}) GROUP BY GROUPING SETS ((role_name), ())")
NORMAL = "SELECT CAST(sum(d) - max(d) AS DOUBLE) / (count(d) - 1) AS normal FROM (SELECT CAST(l_quantity AS " \
         "DECIMAL(27, 9)) AS d FROM lineitem)"


# --- generated values -------------------------------------------------------------------

def draw(salt: int) -> str:
    p1, p2 = 2147483647, 2147483629
    high = f"(((id // {p1}) % {p2}) * {(1566083941 + 387420489 * salt) % p2} % {p2})"
    return f"((((id % {p1}) * {(1103515245 + 265443577 * salt) % p2}) + {high} + {12345 + 7919 * salt}) % {p2})"


def pick(pool, salt: int) -> str:
    listed = "[" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in pool) + "]"
    return f"{listed}[{draw(salt)} % {len(pool)} + 1]"


def between(low: int, high: int, salt: int) -> str:
    return f"({draw(salt)} % {high - low + 1} + {low})"


def pad(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), {width}, '0')"


def text(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def slug(expr: str) -> str:
    return (f"regexp_replace(replace(translate(lower({expr}), {q(ACCENTED)}, {q(PLAIN)}), ' ', '.'), "
            f"'[^a-z0-9.]', '', 'g')")


def name_sql(s: int) -> str:
    return f"{pick(V.FAMILY_NAMES, s)} || ' ' || {pick(G.MIDDLE_NAMES, s + 1)} || ' ' || {pick(G.GIVEN_NAMES, s + 2)}"


def birth(s: int) -> str:
    return f"CAST(DATE '1960-01-01' + CAST({between(0, 16060, s)} AS INTEGER) AS VARCHAR)"


def value_sql(tag: str, s: int) -> str:
    return {
        "RESIDENT_ID": f"'0' || {pad(between(1, 96, s), 2)} || {text(between(0, 3, s + 1))} "
                       f"|| substring({birth(s + 2)}, 3, 2) || {pad(between(0, 999999, s + 3), 6)}",
        "PHONE": f"{pick(G.PHONE_PREFIXES, s)} || {text(between(1000000, 9999999, s + 1))}",
        "EMAIL": f"{slug(name_sql(s))} || {text(between(1, 999, s + 3))} || '@' || {pick(G.PUBLIC_MAIL, s + 4)}",
        "HEALTH_INSURANCE_ID": f"{pick(G.INSURANCE_GROUPS, s)} || {pad(between(0, 9999999, s + 1), 7)} "
                               f"|| {pad(between(0, 999999, s + 2), 6)}",
        "NAME": name_sql(s),
        "ADDRESS": f"{text(between(1, 500, s))} || ' ' || {pick(G.STREETS, s + 1)} || ', ' "
                   f"|| {pick(G.WARDS, s + 2)} || ', ' || {pick(G.DISTRICTS, s + 3)} || ', ' "
                   f"|| {pick(V.PROVINCES, s + 4)}",
        "SALARY": text(f"{between(5, 100, s)} * 500000"),
        "DOB": birth(s),
    }[tag]


def noise_sql(kind: str, s: int) -> str:
    return {
        "record_id": f"'SYS-' || {text(between(100000, 999999, s))}",
        "ip": " || '.' || ".join(text(between(1, 254, s + k)) for k in range(4)),
        "device_hash": f"md5({text(draw(s))})",
        "amount": text(f"{pick(G.AMOUNTS, s)} * 1000"),
        "batch": f"'BATCH-' || {text(between(1000, 9999, s))}",
        "decision": f"{text(between(100, 999, s))} || '/QĐ-UBND'",
        "household": f"'0' || {pad(between(1, 96, s), 2)} || '/' || {text(between(100000, 999999, s + 1))}",
        "badge": f"'NV-' || {text(between(2021, 2025, s))} || '-' || {pad(between(1, 9999, s + 1), 4)}",
        "status_code": pick(G.STATUS_CODES, s),
        "boolean": pick(("true", "false"), s),
        "retry_count": text(between(0, 5, s)),
    }[kind]


def mixed_sql(s: int) -> str:
    d = draw(s)
    octets = " || '.' || ".join(text(f"(({d} >> {7 * k}) % 254 + 1)") for k in range(4))
    amounts = "[" + ", ".join(str(a) for a in G.AMOUNTS) + "]"
    return (f"CASE ({d} >> 28) % 4 WHEN 0 THEN 'NOISE-' || {text(f'({d} % 900000 + 100000)')} "
            f"WHEN 1 THEN {octets} WHEN 2 THEN md5({text(d)}) "
            f"ELSE {text(f'{amounts}[{d} % {len(G.AMOUNTS)} + 1] * 1000')} END")


IDS = "SELECT o_orderkey AS id FROM orders"
# Two digits of each id, their moduli, and each round's sum; an id outside the table goes through all rounds again.
FEISTEL = ("SELECT n, l, (n + l - 1) // l AS r FROM (SELECT count(*) AS n FROM orders), LATERAL (SELECT min_by(x, "
           "(x * ((n + x - 1) // x), -x)) AS l FROM range(greatest(1, floor(sqrt(n))::BIGINT - 1000), floor(sqrt(n))::BIGINT + 1) t(x))")


def _mixed(digit: str, k: int, key: int, modulus: str) -> str:
    y = f"(({digit} * {G.FEISTEL_ROUNDS[k]} + {G.feistel_addend(key, k)}) % {G.FEISTEL_PRIME})"
    return f"({y} * {y} % {G.FEISTEL_PRIME} % {modulus})"


def places_sql(key: int) -> str:
    """(id, n, p): the place of every id in the keyed permutation."""
    step = "SELECT id, n, l, r, p // r AS a0, p % r AS b0 FROM {source}"
    for k in range(0, len(G.FEISTEL_ROUNDS), 2):
        j = k // 2
        step = f"SELECT *, (a{j} + {_mixed(f'b{j}', k, key, 'l')}) % l AS a{j + 1} FROM ({step})"
        step = f"SELECT *, (b{j} + {_mixed(f'a{j + 1}', k + 1, key, 'r')}) % r AS b{j + 1} FROM ({step})"
    last = len(G.FEISTEL_ROUNDS) // 2
    walked = f"SELECT id, n, l, r, a{last} * r + b{last} AS p FROM ({step})"
    start = walked.format(source=f"(SELECT id, n, l, r, id AS p FROM ({IDS}), ({FEISTEL}))")
    return (f"SELECT id, n, p FROM (WITH RECURSIVE walk AS ({start} UNION ALL "
            f"{walked.format(source='(SELECT * FROM walk WHERE p >= n)')}) SELECT * FROM walk WHERE p < n)")


def chosen(pct: int) -> str:
    return f"(p < CAST(floor(n * {pct} / 100) AS BIGINT))"


SHARES = {s.column_name: (s.sensitivity_tag, s.match_percentage) for s in suites.SCANNER_SUITE}


def oracle() -> dict[str, str]:
    doc_words = ("SELECT lang, source, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS word FROM documents")
    def detector(tag):
        return (f"SELECT column_name, count(*) AS n_values, count(*) FILTER (WHERE {strict_match(tag)}) AS n_match "
                f"FROM ({long_sql(PII, PII_COLUMNS)}) WHERE trim(v, ' ') <> '' GROUP BY column_name")

    sql = {
        "a1_ingest_csv": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) "
        "AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer",
        "a2_ingest_folder": " UNION ALL ".join(
            f"SELECT {q(t)} AS table_name, column_name, count(*) AS n_cells FROM ({long_sql('FROM ' + t, COLUMNS[t])}) "
            f"WHERE trim(v, ' ') <> '' GROUP BY column_name"
            for t in ("region", "nation", "customer", "supplier", "part")
        ),
        "a3_write_table": "SELECT o_orderstatus, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS sum_key "
        "FROM orders GROUP BY 1",
        "a4_scan_table": "SELECT c_mktsegment, c_custkey FROM customer",
        "a5_list_tables": "SELECT 'region' AS table_name, count(*) AS n_rows FROM region UNION ALL "
        "SELECT 'nation', count(*) FROM nation",
        "a6_insert_if_absent": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice "
        "ELSE 0.0 END AS o_totalprice FROM orders",
        "a6_register_first": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) "
        "AS o_orderpriority FROM orders GROUP BY o_custkey",
        "a8_upsert": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice "
        "ELSE 0.0 END AS o_totalprice FROM orders",
        "a6_insert_duplicates": "WITH t AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders "
        "WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT * FROM t UNION ALL SELECT o_custkey, min(o_orderkey) "
        "FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM t) GROUP BY o_custkey",
        "a8_upsert_duplicates": "SELECT o_custkey, coalesce(max(o_orderkey) FILTER (WHERE o_orderstatus = 'O'), "
        "min(o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
        "a9_append": "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL "
        "SELECT s_suppkey, s_name FROM supplier",
        "a11_read_ground_truth": f"SELECT t.*, n_values FROM ({TRUTH_ROWS}) t(table_name, column_name, "
        f"sensitivity_tag, sensitivity_level) JOIN ({counts_sql(PII, PII_COLUMNS)}) USING (column_name)",
        "a12_fetch_verdicts": f"SELECT c_name AS table_name, column_name, upper(sensitivity_tag) AS sensitivity_tag, "
        f"sensitivity_level, detection_method, confidence_score FROM ({META_COLUMNS}) JOIN customer "
        f"ON table_id = c_custkey WHERE c_name = 'Customer#000000007'",
        "a13_update_level": f"SELECT table_id, column_name, CASE WHEN table_id = 7 AND sensitivity_level = 'LOW' "
        f"THEN 'HIGH' ELSE sensitivity_level END AS sensitivity_level FROM ({META_COLUMNS})",
        "a14_write_csv": f"SELECT CAST(k AS VARCHAR) AS k, cccd_clean, c03, o_text, info FROM ({PII})",
        "b1_bounded_sample": f"SELECT k, cccd_noise_70, contact FROM ({sample_sql(PII, 200)})",
        "b2_column_values": f"SELECT column_name, v AS value FROM ({sample_values_sql(PII, PII_COLUMNS, 50)})",
        "b3_column_sample_lists": f"SELECT table_name, ordinal, column_name, CAST(len(vs) AS INTEGER) AS n_sample, "
        f"array_to_string(vs, '|') AS sample_text, array_to_string(ms, '|') AS model_text "
        f"FROM ({sample_lists_sql(60, 5)})",
        "b5_stratified_sample": f"""WITH d AS (SELECT e8_n_65 AS value, {strict_match('EMAIL', 'e8_n_65')} AS is_match,
            draw FROM ({drawn_sql(PII)}))
          SELECT value, is_match FROM (SELECT * FROM d WHERE is_match ORDER BY draw LIMIT 7) UNION ALL
          SELECT value, is_match FROM (SELECT * FROM d WHERE NOT is_match ORDER BY draw LIMIT 3)""",
        "c1_is_resident_id": detector("RESIDENT_ID"),
        "c2_is_phone": detector("PHONE"),
        "c3_is_email": detector("EMAIL"),
        "c4_is_health_insurance_id": detector("HEALTH_INSURANCE_ID"),
        "c3_email_tokens": f"SELECT lang, source, count(*) FILTER (WHERE word <> '') AS n_words, "
        f"count(*) FILTER (WHERE {strict_match('EMAIL', 'word')}) AS n_emails FROM ({doc_words}) GROUP BY lang, source",
        "c5_match_tags": "SELECT column_name, tag, count(*) AS n_values FROM (SELECT column_name, CASE "
        + " ".join(f"WHEN {strict_match(t)} THEN {q(t)}" for t in V.STRICT_TAGS)
        + f" ELSE 'NONE' END AS tag FROM ({long_sql(PII, PII_COLUMNS)}) UNION ALL "
        f"SELECT 'empty_col', 'NONE' FROM ({PII}) UNION ALL SELECT 'email_sparse', 'NONE' FROM ({PII}) "
        f"WHERE email_sparse IS NULL) GROUP BY column_name, tag",
        "c6_tag_scores": "SELECT column_name, n_values, CAST(len(detected) AS INTEGER) AS n_tags, "
        + ", ".join(f"CAST(s_{t.lower()} AS DOUBLE) AS score_{t.lower()}" for t in V.STRICT_TAGS)
        + f" FROM ({PII_SCORES})",
        "c7_regex_success": f"SELECT column_name, regex_status, array_to_string(candidates, ',') AS candidates "
        f"FROM ({PII_SCORES}) WHERE regex_status = 'SUCCESS'",
        "c8_regex_undetermined": f"SELECT column_name, regex_status, coalesce(array_to_string(candidates, ','), '') "
        f"AS candidates FROM ({PII_SCORES}) WHERE regex_status = 'UNDETERMINED'",
        "c9_detected_tags": f"SELECT column_name, CAST(i - 1 AS INTEGER) AS position, detected[i].tag AS tag, "
        f"detected[i].score AS score FROM ({PII_SCORES}), unnest(range(1, len(detected) + 1)) u(i)",
        "c10_split_by_status": f"SELECT {q(TABLE)} AS table_name, "
        f"string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE regex_status = 'SUCCESS') AS determined, "
        f"string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE regex_status <> 'SUCCESS') AS undetermined "
        f"FROM ({PII_SCORES})",
        "c11_build_request": f"""WITH c AS (SELECT s.ordinal, regex_status, CAST(to_json({{'column_name': s.column_name,
            'regex_status': regex_status, 'regex_candidates': coalesce(candidates, []),
            'raw_scores': map_from_entries(list_transform(detected, lambda d: {{'k': d.tag, 'v': d.score}})),
            'sample_data': ms}}) AS VARCHAR) AS j FROM ({PII_SCORES}) s
            JOIN ({sample_lists_sql(60, 5)}) l ON l.ordinal = s.ordinal)
          SELECT {q(TABLE)} AS table_name, count(*) FILTER (WHERE regex_status = 'SUCCESS') AS n_determined,
            count(*) FILTER (WHERE regex_status <> 'SUCCESS') AS n_undetermined,
            '[' || string_agg(j, ', ' ORDER BY ordinal) FILTER (WHERE regex_status = 'SUCCESS') || ']'
              AS determined_json,
            CAST(length('[' || string_agg(j, ', ' ORDER BY ordinal) FILTER (WHERE regex_status <> 'SUCCESS') || ']')
              AS INTEGER) AS undetermined_length, true AS prompt_has_context FROM c""",
        "c12_decode_response": f"""SELECT CAST(o_orderkey AS VARCHAR) AS table_name, 'c' || o_custkey AS column_name,
            tag <> 'NONE' AS is_pii, tag AS suggested_tag, {level('tag')} AS sensitivity_level,
            0.9::DOUBLE AS confidence_score, o_orderpriority AS reason
          FROM (SELECT *, {_TAG_LIST}[o_orderkey % 9 + 1] AS tag FROM orders) WHERE o_orderstatus <> 'P'""",
        "c13_arbitrate": "SELECT x.*, CAST(substring(column_name, 2) AS INTEGER) AS ordinal FROM ("
        + _DECIDE.format(level=level("tag"), suffix=SUFFIX, answered=f"""
          SELECT o_orderpriority AS table_name, 'c' || k AS column_name, CASE WHEN k % 5 = 0 THEN 'SUCCESS'
              ELSE 'UNDETERMINED' END AS regex_status,
            CASE WHEN k % 5 < 3 THEN t ELSE 'NONE' END AS cand,
            CASE k % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.4 WHEN 2 THEN 0.25 ELSE 0.0 END AS cand_score,
            CASE k % 5 WHEN 0 THEN [t || ':0.9'] WHEN 1 THEN [t || ':0.4'] WHEN 2 THEN [t || ':0.25']
              ELSE [] END AS parts,
            o_orderstatus <> 'P' AND k % 3 <> 0 AS m_pii,
            CASE WHEN o_orderstatus <> 'P' THEN {_TAG_LIST}[k % 9 + 1] ELSE 'NONE' END AS m_tag,
            CASE WHEN o_orderstatus <> 'P' THEN 0.8::DOUBLE ELSE 0.0 END AS m_conf,
            CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'no answer' END AS m_reason
          FROM (SELECT *, o_orderkey AS k, [{', '.join(q(t) for t in V.STRICT_TAGS)}][o_orderkey % 4 + 1] AS t
                FROM orders)""") + ") x",
        "c14_reason_suffix": f"SELECT column_name, {SUFFIX} AS suffix FROM ({PII_SCORES})",
        "c15_level_weight": f"SELECT tag, {level('tag')} AS level, CAST({_case('tag', 1, -2)} AS INTEGER) AS weight, "
        f"count(*) AS n_rows FROM (SELECT [{', '.join(q(t) for t in (*V.TAGS, 'UNKNOWN_TAG'))}][o_orderkey % 10 + 1] "
        f"AS tag FROM orders) GROUP BY tag",
        "c16_scan_table": verdicts_sql(PII, PII_COLUMNS, TABLE, sample_values_sql(PII, PII_COLUMNS, 200)),
        "c16_scan_table_unkeyed": "SELECT column_name, CASE WHEN part >= 0.7 THEN 'PHONE' ELSE 'NONE' END AS "
        "sensitivity_tag, CASE WHEN part >= 0.7 THEN 'MEDIUM' ELSE 'NONE' END AS sensitivity_level FROM (UNPIVOT ("
        "SELECT avg((o_orderkey * 10 >= m)::INT) AS blank_at_first, avg((o_orderkey * 10 >= 9 * m)::INT) AS "
        "filled_at_last, avg((o_orderkey * 10 < 9 * m)::INT) AS blank_at_last FROM orders, (SELECT max(o_orderkey) "
        "AS m FROM orders)) ON blank_at_first, filled_at_last, blank_at_last INTO NAME column_name VALUE part)",
        "c16_scan_table_exact": PII_VERDICTS,
        "c17_scan_all": " UNION ALL ".join(
            [f"SELECT * FROM ({verdicts_sql('FROM ' + t, COLUMNS[t], t)})" for t in SCANNED]
            + [f"SELECT * FROM ({verdicts_sql(pii_sql(t), PII_COLUMNS, 'pii_' + t)})" for t in DERIVED]
        ),
        "c18_semantic_scan": f"SELECT {q(TABLE)} AS table_name, column_name, m_pii AS is_pii, m_tag AS suggested_tag, "
        f"{level('m_tag')} AS sensitivity_level, m_conf AS confidence_score, m_reason AS reason "
        f"FROM ({answers_sql(PII_SCORES)}) WHERE regex_status = 'UNDETERMINED'",
        "c19_score_with": f"""SELECT {q(TABLE)} AS table_name, s.column_name, hit AS is_pii,
            CASE WHEN hit THEN 'NAME' ELSE 'NONE' END AS suggested_tag, 0.9::DOUBLE AS confidence_score
          FROM ({PII_SCORES}) s JOIN (SELECT column_name, len(list_filter(ms, lambda v: contains(v, 'Nguyễn')
            OR contains(v, 'Trần'))) > 0 AS hit FROM ({sample_lists_sql(60, 5)})) l ON l.column_name = s.column_name
          WHERE regex_status = 'UNDETERMINED'""",
        "d1_resolve_policies": policies_sql("AUDITOR"),
        "d2_policy_matrix": f"SELECT a.table_name, a.column_name, coalesce(masking_rule, 'CLEAR_TEXT') AS masking_rule "
        f"FROM ({ACCESSED}) a LEFT JOIN ({KNOWN}) k ON a.table_name = k.table_name AND a.column_name = k.column_name",
        "d3_hash_mask": f"SELECT k, sha256(v) AS masked FROM ({EDGES})",
        "d3_hash_mask_text": "SELECT doc_id, sha256(text) AS masked FROM documents",
        "d4_redact_mask": f"SELECT k, 'REDACTED' AS masked FROM ({EDGES})",
        "d5_nullify_mask": f"SELECT k, CAST(NULL AS VARCHAR) AS masked FROM ({EDGES})",
        "d6_partial_mask": f"SELECT k, {partial('v')} AS masked FROM ({EDGES})",
        "d6_partial_mask_text": f"SELECT doc_id, {partial('text')} AS masked FROM documents",
        "d6_partial_mask_pii": masked_frame(PII, PII_COLUMNS, {c: "PARTIAL_MASK" for c in PII_COLUMNS if c != "k"}),
        "d7_clear_text": f"SELECT k, v AS masked FROM ({EDGES})",
        "d8_mask_expr": "SELECT k, " + ", ".join(f"{mask(r, 'v')} AS {r.lower()}" for r in V.MASKING_RULES)
        + f" FROM ({EDGES})",
        "d9_mask_column": "SELECT * REPLACE (sha256(c_name) AS c_name) FROM customer",
        "d10_mask_frame": masked_frame(PII, PII_COLUMNS, RULES),
        "d11_secure_frame_auditor": keep_type(secured("AUDITOR", PII)),
        "d11_secure_frame_analyst": keep_type(secured("ANALYST", PII)),
        "d11_secure_read": keep_type(secured("ANALYST", PII, ["k", "cccd_clean", "c03", "info", "grp"])),
        "d12_secure_read_all": " UNION ALL ".join(
            f"SELECT {q('pii_' + t)} AS table_name, a.column_name, coalesce(n_redacted, 0) AS n_redacted, "
            f"coalesce(n_starred, 0) AS n_starred, n_rows - coalesce(n_text, 0) AS n_null, n_rows "
            f"FROM ({values([(i, c) for i, c in enumerate(PII_COLUMNS)])}) a(ordinal, column_name) "
            f"CROSS JOIN (SELECT count(*) AS n_rows FROM {t}) LEFT JOIN (SELECT column_name, "
            f"count(*) FILTER (WHERE v = 'REDACTED') AS n_redacted, count(*) FILTER (WHERE contains(v, '*')) "
            f"AS n_starred, count(*) AS n_text FROM ({long_sql(secured('AUDITOR', pii_sql(t)), PII_COLUMNS)}) "
            f"GROUP BY column_name) c ON c.column_name = a.column_name"
            for t in ("customer", "orders")
        ),
        "d13_access_audit": f"""SELECT 'ANALYST' AS user_role, table_name AS target_table,
            CAST(to_json({{'accessed_columns': list({{'column_name': column_name, 'action': action,
              'sensitivity_level': sensitivity_level, 'is_masked': is_masked}} ORDER BY ordinal),
              'total_columns_accessed': count(*)}}) AS VARCHAR) AS context_details
          FROM ({AUDITED}) GROUP BY table_name""",
        "d13_accessed_columns": f"SELECT * EXCLUDE (ordinal) FROM ({AUDITED})",
        "e1_confusion": MATRIX,
        "e2_scores": f"SELECT table_name, round(precision, 6) AS precision, round(recall, 6) AS recall, "
        f"round(f1_score, 6) AS f1_score FROM ({RATED})",
        "e3_level_accuracy": f"SELECT table_name, round(level_accuracy, 6) AS level_accuracy FROM ({RATED})",
        "e4_masking_compliance": rate_sql(True, "masking_compliance"),
        "e4_compliance_by_column": ALL_COMPLIANCE,
        "e5_no_over_masking": rate_sql(False, "no_over_masking"),
        "e6_trimmed_latency": f"SELECT role_name, n_runs, round(mean, 6) AS mean_duration FROM ({TRIMMED_MEAN})",
        "e7_overhead_pct": f"SELECT role_name, n_runs, round(mean, 6) AS mean_duration, round(normal, 6) "
        f"AS normal_duration, round((mean - normal) / normal * 100, 6) AS overhead_pct "
        f"FROM ({TRIMMED_MEAN}), ({NORMAL})",
        "e8_mean_latency": f"SELECT role_name, count(d) AS n_runs, round(CAST(sum(d) AS DOUBLE) / count(d), 6) "
        f"AS mean_duration FROM ({RUNS}) GROUP BY GROUPING SETS ((role_name), ())",
        "e9_regex_expectations": f"""SELECT * FROM (SELECT x.table_name, x.column_name,
            CASE WHEN s.regex_status IS NULL THEN 'missing' WHEN s.regex_status <> x.status THEN 'status'
              WHEN coalesce(list_filter(detected, lambda d: d.tag = x.tag)[1].score, 0.0) < x.score THEN 'score'
              WHEN x.status = 'SUCCESS' AND NOT list_contains(candidates, x.tag) THEN 'candidate' END AS problem
          FROM ({EXPECTED_ROWS}) x(table_name, column_name, tag, status, method, score)
          LEFT JOIN ({PII_SCORES}) s ON s.column_name = x.column_name) WHERE problem IS NOT NULL""",
        "e10_sla_check": f"""SELECT m.metric, round(m.value, 6) AS value, t.target, t.direction, m.value >= t.target
            AS passed
          FROM (UNPIVOT (SELECT precision, recall, f1_score, level_accuracy FROM ({RATED}))
            ON precision, recall, f1_score, level_accuracy INTO NAME metric VALUE value) m
          JOIN ({values([(k, t, d) for k, (t, d) in V.SLA_TARGETS.items()])}) t(metric, target, direction)
            ON t.metric = m.metric""".replace("t.target,", "CAST(t.target AS DOUBLE) AS target,"),
        "e11_model_expectations": f"""SELECT * FROM (SELECT x.table_name, x.column_name,
            CASE WHEN s.column_name IS NULL THEN 'missing' WHEN m_tag <> x.tag THEN 'tag'
              WHEN m_pii <> (x.tag <> 'NONE') THEN 'is_pii' END AS problem
          FROM ({EXPECTED_ROWS}) x(table_name, column_name, tag, status, method, score)
          LEFT JOIN (SELECT * FROM ({answers_sql(PII_SCORES)}) WHERE regex_status = 'UNDETERMINED') s
            ON s.column_name = x.column_name WHERE x.method IN ('HYBRID', 'LLM')) WHERE problem IS NOT NULL""",
        "e12_request_coverage": f"SELECT {q(TABLE)} AS table_name, count(*) = {len(PII_COLUMNS)} AS is_complete "
        f"FROM ({PII_SCORES})",
        "f1_gen_values": "SELECT id, " + ", ".join(f"{value_sql(t, 42)} AS {t.lower()}" for t in G.MAKERS)
        + f" FROM ({IDS})",
        "f2_gen_noise": "SELECT id, " + ", ".join(f"{noise_sql(n, 42)} AS {n}" for n in G.NOISE_MAKERS)
        + f" FROM ({IDS})",
        "f3_gen_column": f"SELECT id, CASE WHEN {chosen(70)} THEN {value_sql('PHONE', 42)} ELSE {mixed_sql(92)} END "
        "AS phone_70, " + ", ".join(f"{chosen(p)} AS valid_{p}" for p in (65, 70, 85)) + f" FROM ({places_sql(42)})",
        "f4_gen_table": "SELECT x.column_name, n AS n_values, CASE WHEN share >= 0.7 THEN 'SUCCESS' "
        "ELSE 'UNDETERMINED' END AS regex_status, CASE WHEN share > 0 THEN tag ELSE '' END AS candidates, "
        "CAST(share AS DOUBLE) AS best_score FROM (SELECT c.column_name, c.tag, n, CASE WHEN c.strict THEN "
        "CAST(floor(n * c.pct / 100) AS BIGINT) / n ELSE 0.0 END AS share FROM ("
        + values([(c, t, p, t in V.STRICT_TAGS) for c, (t, p) in SHARES.items()])
        + ") c(column_name, tag, pct, strict), (SELECT count(*) AS n FROM orders)) x",
        "f5_gen_domain_tables": values([
            (name, s.column_name, s.sensitivity_tag, V.TAGS[s.sensitivity_tag][0])
            for name, specs in suites.DOMAIN_TABLES.items() for s in specs
        ]),
        "f6_slugify": f"SELECT k, {slug('''c03 || ' Đặng ' || grp''')} AS slug FROM ({PII})",
    }
    sql["f5_gen_domain_tables"] = (
        "SELECT x.* FROM (" + sql["f5_gen_domain_tables"]
        + ") x(table_name, column_name, sensitivity_tag, sensitivity_level)"
    )
    sql["f7_emit_truth"] = (
        "SELECT table_name, count(*) FILTER (WHERE sensitivity_tag <> 'NONE') AS tp, CAST(0 AS BIGINT) AS fp, "
        "CAST(0 AS BIGINT) AS fn, count(*) FILTER (WHERE sensitivity_tag = 'NONE') AS tn, CAST(0 AS BIGINT) AS missing, "
        f"count(*) AS level_hits, count(*) AS n_columns FROM ({sql['f5_gen_domain_tables']}) GROUP BY table_name"
    )
    sql["c13_arbitrate_repeated_answers"] = sql["c13_arbitrate"]
    sql["d11_secure_read_any_case"] = sql["d11_secure_read"]
    sql["f5_row_consistency"] = (
        f"SELECT t AS table_name, count(*) AS n_rows, count(*) AS n_agree FROM customer, "
        f"({values([(name,) for name in suites.DOMAIN_TABLES])}) x(t) GROUP BY t"
    )
    families = "[" + ", ".join(q(name) for name in V.FAMILY_NAMES[:12]) + "]"
    dates = ("SELECT CAST(DATE '1995-01-01' + CAST(o_orderkey % 900 AS INTEGER) AS VARCHAR) AS dob, "
             "CASE WHEN o_orderkey = 7 THEN '1970-01-01' ELSE dob END AS ship_date, "
             f"{families}[o_orderkey % 12 + 1] || ' Minh ' || ['An', 'Mai', 'Long', 'Lan', 'Quỳnh'][o_orderkey % 5 + 1] AS c7, "
             "['Hoàng Gia', 'Mai Linh', 'Phan Rang'][o_orderkey % 3 + 1] AS brand, "
             "CAST(DATE '1951-01-01' + CAST(o_orderkey * 7 % 17000 AS INTEGER) AS VARCHAR) AS d9, "
             "CAST((o_orderkey % 800 + 100) * 1000000 AS VARCHAR) AS salary FROM orders")
    scored = scores_sql(counts_sql(dates, ["ship_date", "c7", "brand", "dob", "d9", "salary"]))
    sql["c18_semantic_scan_dates"] = f"SELECT column_name, m_tag AS suggested_tag FROM ({answers_sql(scored)})"
    return sql
