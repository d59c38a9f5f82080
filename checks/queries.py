"""One query per operator, each over whole given tables."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import PII_COLUMNS, edges_view, load, pii_view
from maskwright import vocab as V
from maskwright.functions import masking as M
from maskwright.functions import matching as D
from maskwright.functions.text import reason_suffix, slugify
from maskwright.operators import evaluation as E
from maskwright.operators import generation as G
from maskwright.operators.arbitration import arbitrate, with_answers
from maskwright.operators.exchange import build_requests, decode_responses, score_with
from maskwright.operators.keyed import append, insert_if_absent, one_per_key, update_where, upsert
from maskwright.operators.masking import mask_column, mask_frame
from maskwright.operators.policy import access_audit, accessed_columns, policy_matrix, resolve_policies
from maskwright.operators.sampling import (
    bounded_sample,
    column_sample_lists,
    column_values,
    columns_frame,
    non_blank,
    stratified_sample,
    to_long,
    with_names,
)
from maskwright.operators.scoring import split_by_status
from maskwright.operators.semantic import semantic_scan
from maskwright.plans import suites
from maskwright.plans.scan import column_scores, column_verdicts, scan_all, table_verdicts
from maskwright.plans.secure import secure_frame, secure_read, secure_read_all
from maskwright.sources import ingest
from maskwright.sources.local import local_frame
from maskwright.sources.store import MetadataStore, ensure_checkpoint_dir, fetch_verdicts
from maskwright.sources.tables import list_tables, read_table, resolve_fqn, write_table

KEY = ["k"]
TABLE = "pii_orders"

# Real tags of the derived columns.
TRUTH = {
    "k": "NONE",
    "cccd_clean": "RESIDENT_ID",
    "cccd_noise_70": "RESIDENT_ID",
    "phone_clean": "PHONE",
    "email_clean": "EMAIL",
    "e8_n_65": "EMAIL",
    "health_insurance_id_clean": "HEALTH_INSURANCE_ID",
    "c03": "NAME",
    "o_text": "ADDRESS",
    "m_val": "SALARY",
    "info": "DOB",
    "sys_record_id": "NONE",
    "is_active": "NONE",
    "tx_amount": "NONE",
    "email_sparse": "EMAIL",
    "contact": "PHONE",
    "empty_col": "NONE",
    "grp": "NONE",
}
# Columns that carry their tag in every row.
FULL = {c: t for c, t in TRUTH.items() if c not in ("cccd_noise_70", "e8_n_65", "email_sparse", "contact", "empty_col")}
SCANNED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "pages", "benchmark", "labels", "conversations", "embeddings")
DERIVED = ("orders", "customer")


def _database(spark: SparkSession) -> str:
    """A database of this application's own, so that runs do not meet."""
    return "mw_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of this application below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files/{name}"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _truth_frame(spark: SparkSession, table: str = TABLE) -> DataFrame:
    rows = [(table, c, t, V.TAGS[t][0]) for c, t in TRUTH.items()]
    return local_frame(
        spark, rows, "table_name string, column_name string, sensitivity_tag string, sensitivity_level string"
    )


def _scores(spark, sf, size=None, table="orders"):
    return column_scores(pii_view(spark, sf, table), TABLE, sample_size=size, key=KEY)


def _verdicts(spark, sf, size=None, table="orders"):
    return column_verdicts(pii_view(spark, sf, table), TABLE, sample_size=size, key=KEY)


# --- A. Sources, sinks, catalog ------------------------------------------------

def a1_ingest_csv(spark, sf):
    path = _scratch(spark, "a1/Customer.csv")
    ingest.write_csv(load(spark, sf, "customer"), path)
    return read_table(spark, ingest.ingest_csv(spark, path, _database(spark) + "_a1"))


def a2_ingest_folder(spark, sf):
    names = ("region", "nation", "customer", "supplier", "part")
    for name in names:
        ingest.write_csv(load(spark, sf, name), _scratch(spark, f"a2/{name}.csv"))
    loaded = ingest.ingest_folder(spark, _scratch(spark, "a2/*.csv"), _database(spark) + "_a2")
    cells = [
        with_names(non_blank(to_long(spark.table(fqn))).groupBy("ordinal").agg(F.count("*").alias("n_cells")),
                   spark.table(fqn), fqn.split(".")[-1])
        for fqn in loaded
    ]
    return _union(cells).select("table_name", "column_name", "n_cells")


def a3_write_table(spark, sf):
    fqn = resolve_fqn("Orders_Copy", _database(spark))
    write_table(load(spark, sf, "customer"), fqn)
    write_table(load(spark, sf, "orders"), fqn)
    return spark.table(fqn).groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("sum_key")
    )


def a4_scan_table(spark, sf):
    fqn = resolve_fqn("customer_copy", _database(spark))
    write_table(load(spark, sf, "customer"), fqn)
    return read_table(spark, fqn, ["c_mktsegment", "c_custkey"])


def a5_list_tables(spark, sf):
    database = _database(spark) + "_a5"
    for name in ("Region", "nation"):
        write_table(load(spark, sf, name.lower()), resolve_fqn(name, database))
    frames = [
        spark.table(resolve_fqn(t, database)).agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(t))
        for t in list_tables(spark, database)
    ]
    return _union(frames)


def _priced(orders: DataFrame, price) -> DataFrame:
    return orders.select("o_orderkey", "o_orderstatus", price.alias("o_totalprice"))


def a6_insert_if_absent(spark, sf):
    orders = load(spark, sf, "orders")
    target = _priced(orders.filter("o_orderstatus = 'F'"), F.col("o_totalprice"))
    new = _priced(orders, F.lit(0.0))
    return insert_if_absent(target, new, ["o_orderkey"])


def a6_register_first(spark, sf):
    """Several candidates per key: the first by order key wins."""
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return one_per_key(orders, ["o_custkey"], F.col("o_orderkey"), last=False)


def a8_upsert(spark, sf):
    orders = load(spark, sf, "orders")
    target = _priced(orders.filter("o_orderstatus <> 'O'"), F.col("o_totalprice"))
    new = _priced(orders.filter("o_orderstatus <> 'F'"), F.lit(0.0))
    return upsert(target, new, ["o_orderkey"])


def _customer_orders(spark, sf, status=None):
    orders = load(spark, sf, "orders")
    return (orders.filter(F.col("o_orderstatus") == status) if status else orders).select("o_custkey", "o_orderkey")


def a6_insert_duplicates(spark, sf):
    """Several new rows per key: one of them is inserted."""
    target = one_per_key(_customer_orders(spark, sf, "F"), ["o_custkey"], F.col("o_orderkey"), last=False)
    return insert_if_absent(target, _customer_orders(spark, sf), ["o_custkey"])


def a8_upsert_duplicates(spark, sf):
    target = one_per_key(_customer_orders(spark, sf), ["o_custkey"], F.col("o_orderkey"), last=False)
    return upsert(target, _customer_orders(spark, sf, "O"), ["o_custkey"])


def a9_append(spark, sf):
    audit = [
        load(spark, sf, t).select(F.col(k).alias("id"), F.col(n).alias("name"))
        for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))
    ]
    return append(*audit)


def a11_read_ground_truth(spark, sf):
    """Truth documents written and read back, joined with what the data holds."""
    path = _scratch(spark, "a11")
    specs = [G.ColumnSpec(c, t) for c, t in TRUTH.items()]
    G.emit_truth(spark, TABLE + ".csv", specs, 0, path)
    truth = ingest.read_ground_truth(spark, path)
    counts = _scores(spark, sf).select("table_name", "column_name", "n_values")
    return truth.join(counts, ["table_name", "column_name"], "left")


def _metadata(spark, sf):
    """(columns, tables): every order is a column of the table its customer is."""
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    levels = F.array(*[F.lit(x) for x in V.LEVELS])
    columns = orders.select(
        F.col("o_custkey").alias("table_id"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("column_name"),
        F.lower(F.element_at(F.array(*[F.lit(t) for t in V.TAGS]), (F.col("o_orderkey") % 9 + 1).cast("int")))
        .alias("sensitivity_tag"),
        F.element_at(levels, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("sensitivity_level"),
        F.lit("REGEX").alias("detection_method"),
        F.lit(1.0).alias("confidence_score"),
        F.col("o_orderkey").alias("ordinal"),
    )
    return columns, customer.select(F.col("c_custkey").alias("table_id"), F.col("c_name").alias("table_name"))


def a12_fetch_verdicts(spark, sf):
    columns, tables = _metadata(spark, sf)
    busiest = "Customer#000000007"
    return fetch_verdicts(columns, tables, busiest)


def a13_update_level(spark, sf):
    columns, _ = _metadata(spark, sf)
    hit = (F.col("table_id") == 7) & (F.col("sensitivity_level") == "LOW")
    changed = update_where(columns, hit, {"sensitivity_level": F.lit("HIGH")})
    return changed.select("table_id", "column_name", "sensitivity_level")


def a14_write_csv(spark, sf):
    path = _scratch(spark, "a14")
    ingest.write_csv(pii_view(spark, sf).select("k", "cccd_clean", "c03", "o_text", "info"), path)
    return ingest.read_csv(spark, path)


# --- B. Sampling ----------------------------------------------------------------

def b1_bounded_sample(spark, sf):
    return bounded_sample(pii_view(spark, sf), 200, KEY).select("k", "cccd_noise_70", "contact")


def b2_column_values(spark, sf):
    values = column_values(pii_view(spark, sf), TABLE, 50, KEY)
    return values.select("column_name", "value")


def b3_column_sample_lists(spark, sf):
    lists = column_sample_lists(pii_view(spark, sf), TABLE, 60, 5, KEY)
    return lists.select(
        "table_name", "ordinal", "column_name", F.size("sample_data").alias("n_sample"),
        F.array_join("sample_data", "|").alias("sample_text"), F.array_join("model_sample", "|").alias("model_text"),
    )


def b5_stratified_sample(spark, sf):
    return stratified_sample(pii_view(spark, sf), "e8_n_65", 10, "EMAIL", 0.7, KEY)


# --- C. Detection and arbitration -----------------------------------------------

def _detector(name):
    def query(spark, sf):
        long = non_blank(to_long(pii_view(spark, sf)))
        hits = long.groupBy("ordinal").agg(
            F.count("*").alias("n_values"), F.count_if(getattr(D, name)(F.col("value"))).alias("n_match")
        )
        return with_names(hits, pii_view(spark, sf), TABLE, "inner").select("column_name", "n_values", "n_match")
    return query


def c3_email_tokens(spark, sf):
    """E-mail addresses among the words of real text, per language and source."""
    words = load(spark, sf, "documents").select(
        "lang", "source", F.explode(F.split("text", r"[ \t\r\n]+")).alias("word")
    )
    return words.groupBy("lang", "source").agg(
        F.count_if(F.col("word") != "").alias("n_words"), F.count_if(D.is_email(F.col("word"))).alias("n_emails")
    )


def c5_match_tags(spark, sf):
    long = to_long(pii_view(spark, sf)).select("ordinal", F.explode(D.match_tags(F.col("value"))).alias("tag"))
    counts = long.groupBy("ordinal", "tag").agg(F.count("*").alias("n_values"))
    return with_names(counts, pii_view(spark, sf), TABLE).select("column_name", "tag", "n_values")


def c6_tag_scores(spark, sf):
    scores = _scores(spark, sf)
    flat = [F.coalesce(F.col("raw_scores")[t], F.lit(0.0)).alias(f"score_{t.lower()}") for t in V.STRICT_TAGS]
    return scores.select("column_name", "n_values", F.size("raw_scores").alias("n_tags"), *flat)


def c7_regex_success(spark, sf):
    return _scores(spark, sf).filter(F.col("regex_status") == V.SUCCESS).select(
        "column_name", "regex_status", F.array_join("regex_candidates", ",").alias("candidates")
    )


def c8_regex_undetermined(spark, sf):
    return _scores(spark, sf).filter(F.col("regex_status") == V.UNDETERMINED).select(
        "column_name", "regex_status", F.array_join("regex_candidates", ",").alias("candidates")
    )


def c9_detected_tags(spark, sf):
    detected = _scores(spark, sf).select("column_name", F.posexplode("all_detected_tags").alias("position", "d"))
    return detected.select("column_name", "position", "d.tag", "d.score")


def c10_split_by_status(spark, sf):
    split = split_by_status(_scores(spark, sf))
    return split.select(
        "table_name",
        F.array_join("determined_columns", ",").alias("determined"),
        F.array_join("undetermined_columns", ",").alias("undetermined"),
    )


def _requests(spark, sf):
    view = pii_view(spark, sf)
    samples = column_sample_lists(view, TABLE, 60, 5, KEY).select("ordinal", "model_sample")
    return build_requests(_scores(spark, sf).join(samples, "ordinal"))


def c11_build_request(spark, sf):
    return _requests(spark, sf).select(
        "table_name", "n_determined", "n_undetermined", "determined_json",
        F.length("undetermined_json").alias("undetermined_length"),
        F.contains("prompt", "determined_json").alias("prompt_has_context"),
    )


def c12_decode_response(spark, sf):
    """A reply per order, plain or fenced; every one is parsed and checked."""
    tags = F.array(*[F.lit(t) for t in V.TAGS])
    tag = F.element_at(tags, (F.col("o_orderkey") % 9 + 1).cast("int"))
    column = F.struct(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("column_name"),
        (tag != "NONE").alias("is_pii"),
        tag.alias("suggested_tag"),
        V.level_of(tag).alias("sensitivity_level"),
        F.lit(0.9).alias("confidence_score"),
        F.col("o_orderpriority").alias("reason"),
    )
    body = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("table_name"), F.array(column).alias("columns")))
    fenced = F.concat(F.lit("  ```json\n"), body, F.lit("\n```\n"))
    raw = load(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("table_name"),
        F.when(F.col("o_orderstatus") == "F", fenced)
        .when(F.col("o_orderstatus") == "P", F.substring(body, 1, 40))
        .otherwise(body)
        .alias("raw_reply"),
    )
    return decode_responses(raw, strict=False)


def _decisions(spark, sf):
    """Every order as a column with a format verdict, most with an answer."""
    k = F.col("o_orderkey")
    score = F.when(k % 5 == 0, 0.9).when(k % 5 == 1, 0.4).when(k % 5 == 2, 0.25)
    tag = F.element_at(F.array(*[F.lit(t) for t in V.STRICT_TAGS]), (k % 4 + 1).cast("int"))
    one = F.array(F.struct(tag.alias("tag"), score.alias("score")))
    none = F.array().cast("array<struct<tag:string,score:double>>")
    orders = load(spark, sf, "orders")
    scored = orders.select(
        F.col("o_orderpriority").alias("table_name"),
        k.cast("int").alias("ordinal"),
        F.concat(F.lit("c"), k.cast("string")).alias("column_name"),
        F.when(k % 5 == 0, V.SUCCESS).otherwise(V.UNDETERMINED).alias("regex_status"),
        F.when(score.isNotNull(), one).otherwise(none).alias("all_detected_tags"),
    ).withColumn("raw_scores", F.map_from_entries("all_detected_tags")).withColumn(
        "regex_candidates", F.transform("all_detected_tags", lambda d: d["tag"])
    )
    said = F.element_at(F.array(*[F.lit(t) for t in V.TAGS]), (k % 9 + 1).cast("int"))
    answers = orders.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderpriority").alias("table_name"),
        F.concat(F.lit("c"), k.cast("string")).alias("column_name"),
        (k % 3 != 0).alias("is_pii"),
        said.alias("suggested_tag"),
        V.level_of(said).alias("sensitivity_level"),
        F.lit(0.8).alias("confidence_score"),
        F.col("o_orderstatus").alias("reason"),
    )
    return scored, answers


def c13_arbitrate(spark, sf):
    return arbitrate(with_answers(*_decisions(spark, sf)))


def c13_arbitrate_repeated_answers(spark, sf):
    """Each column is answered twice; the later answer is the one that counts."""
    scored, answers = _decisions(spark, sf)
    early = answers.withColumns({
        "is_pii": ~F.col("is_pii"), "suggested_tag": F.lit("NAME"), "confidence_score": F.lit(0.1),
        "reason": F.lit("an earlier answer"), "position": F.lit(0),
    })
    return arbitrate(with_answers(scored, answers.withColumn("position", F.lit(1)).unionByName(early)))


def c14_reason_suffix(spark, sf):
    scores = _scores(spark, sf)
    return scores.select("column_name", reason_suffix(F.col("all_detected_tags")).alias("suffix"))


def c15_level_weight(spark, sf):
    names = F.array(*[F.lit(t) for t in (*V.TAGS, "UNKNOWN_TAG")])
    tag = F.element_at(names, (F.col("o_orderkey") % 10 + 1).cast("int"))
    tagged = load(spark, sf, "orders").select(tag.alias("tag"))
    return tagged.groupBy(
        "tag", V.level_of(F.col("tag")).alias("level"), V.weight_of(F.col("tag")).alias("weight")
    ).agg(F.count("*").alias("n_rows"))


def c16_scan_table(spark, sf):
    return _verdicts(spark, sf, size=200).drop("ordinal")


def c16_scan_table_unkeyed(spark, sf):
    """The default draw on columns whose values change with the place in the table."""
    orders = load(spark, sf, "orders").select("o_orderkey")
    most = orders.agg(F.max("o_orderkey")).first()[0] or 0
    place, phone = F.col("o_orderkey") * 10, F.concat(F.lit("09"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    clustered = orders.select(
        F.when(place < most, "n/a").otherwise(phone).alias("blank_at_first"),
        F.when(place >= 9 * most, phone).otherwise("n/a").alias("filled_at_last"),
        F.when(place < 9 * most, phone).otherwise("n/a").alias("blank_at_last"),
    )
    verdicts = column_verdicts(clustered, "clustered", sample_size=200)
    return verdicts.select("column_name", "sensitivity_tag", "sensitivity_level")


def c16_scan_table_exact(spark, sf):
    return _verdicts(spark, sf).drop("ordinal")


def c17_scan_all(spark, sf):
    """Exact verdicts of every column of every given table and of two derived ones."""
    frames = {t: load(spark, sf, t) for t in SCANNED} | {f"pii_{t}": pii_view(spark, sf, t) for t in DERIVED}
    return table_verdicts(frames, sample_size=None).drop("ordinal")


def c18_semantic_scan(spark, sf):
    return semantic_scan(_scores(spark, sf))


def c18_semantic_scan_dates(spark, sf):
    """Dates of birth against dates of business with one sentinel, and persons against labels that look like them."""
    k = F.col("o_orderkey")
    business = F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int")).cast("string")
    person = F.concat(F.element_at(F.array(*map(F.lit, V.FAMILY_NAMES[:12])), (k % 12 + 1).cast("int")), F.lit(" Minh "),
                      F.element_at(F.array(*map(F.lit, ("An", "Mai", "Long", "Lan", "Quỳnh"))), (k % 5 + 1).cast("int")))
    label = F.element_at(F.array(*map(F.lit, ("Hoàng Gia", "Mai Linh", "Phan Rang"))), (k % 3 + 1).cast("int"))
    dates = load(spark, sf, "orders").select(
        F.when(k == 7, "1970-01-01").otherwise(business).alias("ship_date"), person.alias("c7"), label.alias("brand"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int")).cast("string").alias("dob"),
        F.date_add(F.lit("1951-01-01").cast("date"), (k * 7 % 17000).cast("int")).cast("string").alias("d9"),
        ((k % 800 + 100) * 1000000).cast("string").alias("salary"),
    )
    return semantic_scan(column_scores(dates, "dates", sample_size=None)).select("column_name", "suggested_tag")


def c19_score_with(spark, sf):
    """A stand-in scorer calls a column a name if its samples say so."""

    # Defined here, so that it is shipped to the tasks by value.
    def answer(prompt: str) -> str:
        listed = json.loads(prompt.split("answer these and no others:\n")[1].split("\n\nTags:")[0])
        columns = []
        for column in listed:
            named = any("Nguyễn" in v or "Trần" in v for v in column["sample_data"])
            columns.append({
                "column_name": column["column_name"],
                "is_pii": named,
                "suggested_tag": "NAME" if named else "NONE",
                "sensitivity_level": "MEDIUM" if named else "NONE",
                "confidence_score": 0.9,
                "reason": "samples",
            })
        return "```json\n" + json.dumps({"table_name": "t", "columns": columns}) + "\n```"

    replies = decode_responses(score_with(_requests(spark, sf), answer))
    return replies.select("table_name", "column_name", "is_pii", "suggested_tag", "confidence_score")


# --- D. Policies, masks, audit ---------------------------------------------------

def _policies(spark, sf, role):
    columns, tables = _metadata(spark, sf)
    return resolve_policies(columns, tables, V.policies_frame(spark), role)


def d1_resolve_policies(spark, sf):
    return _policies(spark, sf, "AUDITOR")


def _accessed(spark, sf):
    columns, tables = _metadata(spark, sf)
    return columns.join(tables, "table_id").select("table_name", "ordinal", "column_name")


def _known_policies(spark, sf):
    """Policies of the MEDIUM and LOW columns; the others have none."""
    return _policies(spark, sf, "ANALYST").filter(F.col("sensitivity_level").isin("MEDIUM", "LOW"))


def d2_policy_matrix(spark, sf):
    return policy_matrix(_accessed(spark, sf), _known_policies(spark, sf)).drop("ordinal")


def _masked_edges(mask):
    def query(spark, sf):
        return edges_view(spark, sf).select("k", mask(F.col("v")).alias("masked"))
    return query


def d3_hash_mask_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", M.hash_mask(F.col("text")).alias("masked"))


def d6_partial_mask_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", M.partial_mask(F.col("text")).alias("masked"))


def d6_partial_mask_pii(spark, sf):
    view = pii_view(spark, sf)
    return view.select("k", *[M.mask_expr(c, "PARTIAL_MASK") for c in PII_COLUMNS if c != "k"])


def d8_mask_expr(spark, sf):
    edges = edges_view(spark, sf)
    return edges.select("k", *[M.mask_expr("v", r).alias(r.lower()) for r in V.MASKING_RULES])


def d9_mask_column(spark, sf):
    return mask_column(load(spark, sf, "customer"), "c_name", "HASH_MASK")


RULES = {"cccd_clean": "HASH_MASK", "phone_clean": "NULLIFY_MASK", "email_clean": "PARTIAL_MASK",
         "c03": "PARTIAL_MASK", "o_text": "REDACTED_MASK", "info": "CLEAR_TEXT"}


def d10_mask_frame(spark, sf):
    return mask_frame(pii_view(spark, sf), RULES)


def _secured(spark, sf, role, table="orders"):
    """The view as ``role`` may see it, by the verdicts of an exact scan."""
    verdicts = _verdicts(spark, sf, table=table).withColumn("table_id", F.lit(1).cast("bigint"))
    tables = verdicts.groupBy("table_id").agg(F.first("table_name").alias("table_name"))
    policies = resolve_policies(verdicts, tables, V.policies_frame(spark), role, TABLE)
    return secure_frame(pii_view(spark, sf, table), policies)


def d11_secure_frame_auditor(spark, sf):
    return _secured(spark, sf, "AUDITOR")


def d11_secure_frame_analyst(spark, sf):
    return _secured(spark, sf, "ANALYST")


def _scanned_store(spark, sf, suffix):
    """A stored table for each source, scanned into a store of its own."""
    database = _database(spark) + suffix
    for table in ("orders", "customer"):
        write_table(pii_view(spark, sf, table), f"{database}.pii_{table}")
    store = MetadataStore(spark, database + "_meta").create()
    scan_all(store, database, sample_size=None)
    return store, database


def d11_secure_read(spark, sf):
    """Write, scan, store the verdicts, read them back, mask: the whole path."""
    store, database = _scanned_store(spark, sf, "_d11")
    return secure_read(store, "ANALYST", TABLE, ["k", "cccd_clean", "c03", "info", "grp"], database)


def d11_secure_read_any_case(spark, sf):
    """Names in any case get the masks of the columns they mean."""
    store, database = _scanned_store(spark, sf, "_d11c")
    return secure_read(store, "ANALYST", TABLE.upper(), ["K", "CCCD_Clean", "C03", "iNFO", "GRP"], database)


def d12_secure_read_all(spark, sf):
    store, database = _scanned_store(spark, sf, "_d12")
    frames = []
    for name, frame in secure_read_all(store, "AUDITOR", database).items():
        cells = to_long(frame).groupBy("ordinal").agg(
            F.count_if(F.col("value") == V.REDACTED).alias("n_redacted"),
            F.count_if(F.col("value").contains("*")).alias("n_starred"),
            F.count_if(F.col("value").isNull()).alias("n_null"),
            F.count("*").alias("n_rows"),
        )
        frames.append(with_names(cells, frame, name))
    return _union(frames).drop("ordinal")


def d13_access_audit(spark, sf):
    return access_audit(_accessed(spark, sf), _known_policies(spark, sf), "ANALYST").drop("executed_at")


def d13_accessed_columns(spark, sf):
    return accessed_columns(_accessed(spark, sf), _known_policies(spark, sf)).drop("ordinal")


# --- E. Evaluation ----------------------------------------------------------------

def _matrix(spark, sf):
    return E.require_complete(E.confusion(_truth_frame(spark), _verdicts(spark, sf)))


def e1_confusion(spark, sf):
    return _matrix(spark, sf)


def e2_scores(spark, sf):
    return E.scores(_matrix(spark, sf)).select(
        "table_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")]
    )


def e3_level_accuracy(spark, sf):
    rated = E.level_accuracy(_matrix(spark, sf))
    return rated.select("table_name", F.round("level_accuracy", 6).alias("level_accuracy"))


def e4_masking_compliance(spark, sf):
    return E.compliance_rates(e4_compliance_by_column(spark, sf))


def e4_compliance_by_column(spark, sf):
    return E.compliance_by_role(pii_view(spark, sf), FULL)


def e5_no_over_masking(spark, sf):
    return E.over_masking_rates(e4_compliance_by_column(spark, sf))


def _runs(spark, sf):
    return load(spark, sf, "events").select(F.col("event_type").alias("role_name"), F.col("value").alias("duration"))


def e6_trimmed_latency(spark, sf):
    return E.trimmed_latency(_runs(spark, sf)).withColumn("mean_duration", F.round("mean_duration", 6))


def e7_overhead_pct(spark, sf):
    normal = load(spark, sf, "lineitem").select(F.col("l_quantity").alias("duration"))
    result = E.overhead_pct(_runs(spark, sf), normal)
    return result.select(
        "role_name", "n_runs",
        *[F.round(c, 6).alias(c) for c in ("mean_duration", "normal_duration", "overhead_pct")],
    )


def e8_mean_latency(spark, sf):
    return E.mean_latency(_runs(spark, sf)).withColumn("mean_duration", F.round("mean_duration", 6))


# What a configuration might expect of the columns; some of it is wrong.
EXPECTED = [
    ("cccd_clean", "RESIDENT_ID", "SUCCESS", "REGEX", 1.0),
    ("cccd_noise_70", "RESIDENT_ID", "SUCCESS", "REGEX", 0.7),
    ("phone_clean", "EMAIL", "SUCCESS", "REGEX", 0.0),
    ("e8_n_65", "EMAIL", "UNDETERMINED", "HYBRID", 0.65),
    ("c03", "NAME", "UNDETERMINED", "LLM", 0.0),
    ("o_text", "NAME", "UNDETERMINED", "LLM", 0.0),
    ("contact", "PHONE", "UNDETERMINED", "HYBRID", 0.5),
    ("sys_record_id", "NONE", "SUCCESS", "HYBRID", 0.0),
    ("is_active", "NONE", "UNDETERMINED", "HYBRID", 0.0),
    ("no_such_column", "PHONE", "SUCCESS", "LLM", 0.0),
]


def _expected(spark):
    rows = [(TABLE, *row) for row in EXPECTED]
    return local_frame(
        spark, rows, "table_name string, column_name string, sensitivity_tag string, regex_status string, "
        "detection_method string, expected_regex_score double",
    )


def e9_regex_expectations(spark, sf):
    return E.regex_expectations(_scores(spark, sf), _expected(spark))


def e10_sla_check(spark, sf):
    rated = E.level_accuracy(E.scores(_matrix(spark, sf)))
    metrics = rated.unpivot(
        [], ["precision", "recall", "f1_score", "level_accuracy"], "metric", "value"
    )
    return E.sla_check(metrics, E.targets_frame(spark)).withColumn("value", F.round("value", 6))


def e11_model_expectations(spark, sf):
    return E.model_expectations(semantic_scan(_scores(spark, sf)), _expected(spark))


def e12_request_coverage(spark, sf):
    return E.request_coverage(_requests(spark, sf), len(PII_COLUMNS))


# --- F. Labelled data ---------------------------------------------------------------

def _ids(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


def f1_gen_values(spark, sf):
    values = [G.gen_values(t, F.col("id"), 42).alias(t.lower()) for t in G.MAKERS]
    return _ids(spark, sf).select("id", *values)


def f2_gen_noise(spark, sf):
    values = [G.gen_noise(n, F.col("id"), 42).alias(n) for n in G.NOISE_MAKERS]
    return _ids(spark, sf).select("id", *values)


def f3_gen_column(spark, sf):
    """An exact share of valid values; the whole table decides how many that is."""
    ids = _ids(spark, sf)
    n = ids.count()
    chosen = [G.is_chosen(F.col("id"), n, pct, 42).alias(f"valid_{pct}") for pct in (65, 70, 85)]
    column = G.gen_column(G.ColumnSpec("p", "PHONE", 70), F.col("id"), n, 42)
    return ids.select("id", column.alias("phone_70"), *chosen)


def f4_gen_table(spark, sf):
    """The scanner suite made from order keys, scored; shares must come out exact."""
    ids = _ids(spark, sf)
    table = G.gen_columns(ids, suites.SCANNER_SUITE, ids.count())
    scores = column_scores(table, "test_suite", sample_size=None)
    best = F.coalesce(F.array_max(F.map_values("raw_scores")), F.lit(0.0))
    return scores.select(
        "column_name", "n_values", "regex_status", F.array_join("regex_candidates", ",").alias("candidates"),
        best.alias("best_score"),
    )


def f5_gen_domain_tables(spark, sf):
    ids = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    n = ids.count()
    frames = {name: G.gen_columns(ids, specs, n) for name, specs in suites.DOMAIN_TABLES.items()}
    return table_verdicts(frames, sample_size=None).select("table_name", "column_name", "sensitivity_tag", "sensitivity_level")


def f5_row_consistency(spark, sf):
    """Rows whose e-mails are made from their name and whose resident number holds their year of birth."""
    ids = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    n, counts = ids.count(), []
    for name, specs in suites.DOMAIN_TABLES.items():
        agree = F.lit(True)
        for s in specs:
            if s.follows and s.sensitivity_tag == "EMAIL":
                agree &= F.col(s.column_name).startswith(slugify(F.col(s.follows)))
            elif s.follows:
                agree &= F.substring(s.column_name, 5, 2) == F.substring(s.follows, 3, 2)
        counts.append(G.gen_columns(ids, specs, n).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.count_if(agree).alias("n_agree")))
    return _union(counts)


def f6_slugify(spark, sf):
    names = pii_view(spark, sf).select("k", slugify(F.concat("c03", F.lit(" Đặng "), "grp")).alias("slug"))
    return names


def f7_emit_truth(spark, sf):
    """Truth of the domain tables, written and read back, joined with their data."""
    ids = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    n = ids.count()
    for name, specs in suites.DOMAIN_TABLES.items():
        G.emit_truth(spark, name + ".csv", specs, n, _scratch(spark, f"f7/{name}"))
    truth = ingest.read_ground_truth(spark, _scratch(spark, "f7/*"))
    frames = {name: G.gen_columns(ids, specs, n) for name, specs in suites.DOMAIN_TABLES.items()}
    return E.confusion(truth, table_verdicts(frames, sample_size=None))


QUERIES = {
    "a1_ingest_csv": a1_ingest_csv,
    "a2_ingest_folder": a2_ingest_folder,
    "a3_write_table": a3_write_table,
    "a4_scan_table": a4_scan_table,
    "a5_list_tables": a5_list_tables,
    "a6_insert_if_absent": a6_insert_if_absent,
    "a6_register_first": a6_register_first,
    "a8_upsert": a8_upsert,
    "a6_insert_duplicates": a6_insert_duplicates,
    "a8_upsert_duplicates": a8_upsert_duplicates,
    "a9_append": a9_append,
    "a11_read_ground_truth": a11_read_ground_truth,
    "a12_fetch_verdicts": a12_fetch_verdicts,
    "a13_update_level": a13_update_level,
    "a14_write_csv": a14_write_csv,
    "b1_bounded_sample": b1_bounded_sample,
    "b2_column_values": b2_column_values,
    "b3_column_sample_lists": b3_column_sample_lists,
    "b5_stratified_sample": b5_stratified_sample,
    "c1_is_resident_id": _detector("is_resident_id"),
    "c2_is_phone": _detector("is_phone"),
    "c3_is_email": _detector("is_email"),
    "c3_email_tokens": c3_email_tokens,
    "c4_is_health_insurance_id": _detector("is_health_insurance_id"),
    "c5_match_tags": c5_match_tags,
    "c6_tag_scores": c6_tag_scores,
    "c7_regex_success": c7_regex_success,
    "c8_regex_undetermined": c8_regex_undetermined,
    "c9_detected_tags": c9_detected_tags,
    "c10_split_by_status": c10_split_by_status,
    "c11_build_request": c11_build_request,
    "c12_decode_response": c12_decode_response,
    "c13_arbitrate": c13_arbitrate,
    "c13_arbitrate_repeated_answers": c13_arbitrate_repeated_answers,
    "c14_reason_suffix": c14_reason_suffix,
    "c15_level_weight": c15_level_weight,
    "c16_scan_table": c16_scan_table,
    "c16_scan_table_unkeyed": c16_scan_table_unkeyed,
    "c16_scan_table_exact": c16_scan_table_exact,
    "c17_scan_all": c17_scan_all,
    "c18_semantic_scan": c18_semantic_scan,
    "c18_semantic_scan_dates": c18_semantic_scan_dates,
    "c19_score_with": c19_score_with,
    "d1_resolve_policies": d1_resolve_policies,
    "d2_policy_matrix": d2_policy_matrix,
    "d3_hash_mask": _masked_edges(M.hash_mask),
    "d3_hash_mask_text": d3_hash_mask_text,
    "d4_redact_mask": _masked_edges(M.redact_mask),
    "d5_nullify_mask": _masked_edges(M.nullify_mask),
    "d6_partial_mask": _masked_edges(M.partial_mask),
    "d6_partial_mask_text": d6_partial_mask_text,
    "d6_partial_mask_pii": d6_partial_mask_pii,
    "d7_clear_text": _masked_edges(M.clear_text),
    "d8_mask_expr": d8_mask_expr,
    "d9_mask_column": d9_mask_column,
    "d10_mask_frame": d10_mask_frame,
    "d11_secure_frame_auditor": d11_secure_frame_auditor,
    "d11_secure_frame_analyst": d11_secure_frame_analyst,
    "d11_secure_read": d11_secure_read,
    "d11_secure_read_any_case": d11_secure_read_any_case,
    "d12_secure_read_all": d12_secure_read_all,
    "d13_access_audit": d13_access_audit,
    "d13_accessed_columns": d13_accessed_columns,
    "e1_confusion": e1_confusion,
    "e2_scores": e2_scores,
    "e3_level_accuracy": e3_level_accuracy,
    "e4_masking_compliance": e4_masking_compliance,
    "e4_compliance_by_column": e4_compliance_by_column,
    "e5_no_over_masking": e5_no_over_masking,
    "e6_trimmed_latency": e6_trimmed_latency,
    "e7_overhead_pct": e7_overhead_pct,
    "e8_mean_latency": e8_mean_latency,
    "e9_regex_expectations": e9_regex_expectations,
    "e10_sla_check": e10_sla_check,
    "e11_model_expectations": e11_model_expectations,
    "e12_request_coverage": e12_request_coverage,
    "f1_gen_values": f1_gen_values,
    "f2_gen_noise": f2_gen_noise,
    "f3_gen_column": f3_gen_column,
    "f4_gen_table": f4_gen_table,
    "f5_gen_domain_tables": f5_gen_domain_tables,
    "f5_row_consistency": f5_row_consistency,
    "f6_slugify": f6_slugify,
    "f7_emit_truth": f7_emit_truth,
}
