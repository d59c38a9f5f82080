import json
import time

import pytest
from pyspark.sql import functions as F

from maskwright.operators.keyed import one_per_key, upsert
from maskwright.operators.policy import resolve_policies
from maskwright.plans.scan import scan_all, scan_table
from maskwright.plans.secure import read_for_role, secure_read, secure_read_all
from maskwright.sources.store import MetadataStore
from maskwright.sources.tables import list_tables, read_table, write_table


@pytest.fixture(scope="module")
def store(spark):
    people = spark.range(300).selectExpr(
        "'09' || lpad(id, 8, '0') AS phone", "'Nguyễn ' || char(65 + id % 26) || 'ăn An' AS c03", "'0' || lpad(id, 11, '0') AS cccd",
        "CASE WHEN id % 2 = 0 THEN 'open' ELSE 'shut' END AS state",
    )
    write_table(people, "prod.people")
    write_table(spark.range(50).selectExpr("'u' || id || '@x.com' AS mail"), "prod.mails")
    store = MetadataStore(spark, "gov").create()
    scan_all(store, "prod")
    return store


def levels(store, table):
    return {r.column_name: (r.sensitivity_tag, r.sensitivity_level) for r in store.verdicts(table).collect()}


def test_scan_stores_verdicts_and_audit(store, spark):
    assert levels(store, "people") == {
        "phone": ("PHONE", "MEDIUM"), "c03": ("NAME", "MEDIUM"), "cccd": ("RESIDENT_ID", "HIGH"), "state": ("NONE", "NONE"),
    }
    assert levels(store, "mails") == {"mail": ("EMAIL", "MEDIUM")}
    assert store.read("governance_audit_logs").count() == 5
    scan_table(store, "MAILS ", "prod", sample_size=None)
    assert store.read("governance_audit_logs").count() == 6  # appended
    assert store.read("columns_metadata").count() == 5  # replaced, other tables kept


def test_register_and_seed_are_idempotent(store, spark):
    before = {r.table_name: r.path for r in store.read("tables_metadata").collect()}
    store.register_tables({"People": "elsewhere", "new_one": "x"})
    after = {r.table_name: r.path for r in store.read("tables_metadata").collect()}
    assert after == {**before, "new_one": "x"} and before["people"] == "prod.people"
    MetadataStore(spark, "gov").create()
    assert store.read("access_policies").count() == 12 and store.read("roles").count() == 3
    with pytest.raises(ValueError):
        store.table_id("never_seen")
    with pytest.raises(ValueError):
        scan_table(store, "never_seen", "prod")


def test_roles_see_what_their_policies_allow(store):
    clear = secure_read(store, "ADMIN", "people", database="prod").filter("phone = '0900000007'").first()
    assert clear.c03 == "Nguyễn Hăn An"
    row = secure_read(store, "ANALYST", " people ", ["cccd", "phone", "state"], "prod").first()
    assert len(row.cccd) == 64 and row.phone is None and row.state in ("open", "shut")
    row = secure_read(store, "AUDITOR", "people", database="prod").first()
    assert row.c03[:7] == "N***** " and row.c03[8:] == "** A*" and "*" in row.phone and "*" in row.cccd


def test_filters_apply_to_masked_values(store):
    secure = secure_read(store, "AUDITOR", "people", database="prod")
    assert secure.filter("phone = '0900000007'").count() == 0
    assert secure.filter("phone LIKE '090***%'").count() == 300


def test_update_is_seen_by_the_next_read_only(store):
    def read():
        return secure_read(store, "ANALYST", "people", ["state", "phone"], "prod")

    def stamps():
        return {r.column_name: r.updated_at for r in store.columns_of("people").collect()}

    old, before = read(), stamps()
    start = time.time()
    store.update_level("people", "state", "HIGH")
    assert len(read().first().state) == 64
    assert old.first().state in ("open", "shut")
    after = stamps()
    assert {c for c in after if after[c] != before[c]} == {"state"}
    store.update_level("people", "state", "NONE")
    assert read().first().state in ("open", "shut")
    assert levels(store, "mails") == {"mail": ("EMAIL", "MEDIUM")}
    with pytest.raises(ValueError):
        store.update_level("people", "state", "SECRET")


def test_an_update_is_visible_within_a_second(store):
    def change(level):
        start = time.time()
        store.update_level("people", "state", level)
        secure_read(store, "ANALYST", "people", ["state"], "prod").first()
        return time.time() - start

    change("LOW")
    assert min(change(level) for level in ("HIGH", "NONE", "HIGH", "NONE")) < 1.0


def test_readers_see_old_verdicts_until_the_pointer_moves(store, spark):
    """A reader with a store of its own, between the two steps of a change, and after a writer that failed."""
    other = MetadataStore(spark, "gov")
    before = levels(other, "people")
    rows = store.columns_of("people").drop("generation").withColumn("sensitivity_level", F.lit("LOW"))
    (table_id,) = {r.table_id for r in rows.collect()}
    left_behind = store.write_generation(rows)
    assert levels(other, "people") == before and other.read("columns_metadata").count() == 5
    assert secure_read(other, "ANALYST", "people", ["phone"], "prod").first().phone is None
    generation = store.write_generation(rows)
    assert generation > left_behind and levels(other, "people") == before
    store.point_to(generation, [table_id])
    assert {level for _, level in levels(other, "people").values()} == {"LOW"}
    assert len(secure_read(other, "ANALYST", "people", ["phone"], "prod").first().phone) == 64
    assert levels(other, "mails") == {"mail": ("EMAIL", "MEDIUM")}
    back = spark.createDataFrame([(c, level) for c, (_, level) in before.items()], "column_name string, _level string")
    restored = rows.join(back, "column_name").withColumn("sensitivity_level", F.col("_level"))
    store.point_to(store.write_generation(restored), [table_id])
    assert levels(other, "people") == before
    assert store.vacuum(older_than_seconds=0) >= 3
    assert levels(other, "people") == before and store.vacuum(older_than_seconds=0) == 0


def test_an_unchanged_store_answers_without_a_job(store, spark):
    for role in ("ANALYST", "AUDITOR"):
        store.policies_of(role, "people")
    spark.sparkContext.setJobGroup("free", "free")
    found = {role: store.policies_of(role, "people") for role in ("ANALYST", "AUDITOR")}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("free")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0
    for role, rows in found.items():
        wanted = resolve_policies(store.columns_of("people"), store.read("tables_metadata"), store.read("access_policies"), role, "people")
        assert sorted(rows) == sorted(map(tuple, wanted.collect()))


def test_reading_all_tables_takes_as_many_jobs_for_many_as_for_few(spark):
    counts = []
    for n in (2, 7):
        store = MetadataStore(spark, f"gov_{n}").create()
        for i in range(n):
            write_table(spark.range(5).selectExpr("'u' || id || '@x.com' AS mail"), f"many_{n}.t{i}")
        scan_all(store, f"many_{n}", sample_size=None)
        frames = {}
        spark.sparkContext.setJobGroup(f"all_{n}", "all")
        frames = secure_read_all(store, "AUDITOR")
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"all_{n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(frames) == n and "*" in frames["t1"].first().mail
        assert store.read("policy_engine_audit_logs").count() == n
    assert counts[0] == counts[1]


def test_a_failed_lookup_is_not_taken_for_an_unreadable_table(store, monkeypatch):
    def broken(*_):
        raise RuntimeError("no lookup")

    monkeypatch.setattr(store, "policies_of_all", broken)
    with pytest.raises(RuntimeError):
        secure_read_all(store, "AUDITOR", "prod")


def test_logs_stay_few_files_with_the_same_rows(spark, monkeypatch):
    """Many audited reads, another reader's append during a compaction, and a second compaction."""
    monkeypatch.setattr("maskwright.sources.store.COMPACT_AFTER", 10)
    store = MetadataStore(spark, "gov_logs").create()
    log = "policy_engine_audit_logs"

    def files():
        system, folder = store._folder(f"{log}_files")
        found, names = system.listFiles(folder, True), []
        while found.hasNext():
            names.append(found.next().getPath().getName())
        return [n for n in names if n.endswith(".parquet")]

    for i in range(25):
        store.log_access("ADMIN", {f"t{i}": [("a", "CLEAR_TEXT", "NONE")]})
        if i == 15:
            store.vacuum_log(log, 0)
    store.vacuum_log(log, 0)
    assert len(files()) <= 12
    rows = store.read(log).select("target_table").collect()
    assert sorted(r.target_table for r in rows) == sorted(f"t{i}" for i in range(25))

    plain = store._write_file

    def meanwhile(table, name, text):
        assert store.read(log).count() == 25  # written and not yet published
        MetadataStore(spark, "gov_logs").log_access("ADMIN", {"late": []})
        plain(table, name, text)

    monkeypatch.setattr(store, "_write_file", meanwhile)
    assert store.compact_log(log) > 1
    assert store.read(log).count() == 26
    monkeypatch.setattr(store, "_write_file", plain)
    assert store.compact_log(log) == 2 and store.vacuum_log(log, 0) > 0
    assert len(files()) == 1 and store.read(log).count() == 26 and store.compact_log(log) == 0
    context = json.loads(store.read(log).filter("target_table = 'late'").first().context_details)
    assert context == {"accessed_columns": [], "total_columns_accessed": 0}


def test_every_read_is_audited(store):
    before = store.read("policy_engine_audit_logs").count()
    secure_read(store, "ANALYST", "people", ["state", "cccd"], "prod")
    logs = store.read("policy_engine_audit_logs").orderBy(F.desc("executed_at"))
    assert logs.count() == before + 1
    context = json.loads(logs.first().context_details)
    assert context == {
        "accessed_columns": [
            {"column_name": "state", "action": "CLEAR_TEXT", "sensitivity_level": "NONE", "is_masked": False},
            {"column_name": "cccd", "action": "HASH_MASK", "sensitivity_level": "HIGH", "is_masked": True},
        ],
        "total_columns_accessed": 2,
    }


def test_reads_fail_closed(store, spark):
    with pytest.raises(ValueError):
        secure_read(store, "INTERN", "people", database="prod")
    broken = MetadataStore(spark, "no_such_store")
    with pytest.raises(Exception):
        secure_read(broken, "ANALYST", "people", database="prod")


def test_unscanned_columns_pass_or_follow_the_option(store, spark):
    write_table(spark.range(3).selectExpr("cast(id as string) a"), "prod.fresh")
    store.register_tables({"fresh": "prod.fresh"})
    assert {r.a for r in secure_read(store, "ANALYST", "fresh", database="prod").collect()} == {"0", "1", "2"}
    hidden = secure_read(store, "ANALYST", "fresh", database="prod", unknown="REDACTED_MASK")
    assert {r.a for r in hidden.collect()} == {"REDACTED"}


def test_read_all_leaves_out_broken_tables(store):
    store.register_tables({"gone": "prod.gone"})
    frames = secure_read_all(store, "AUDITOR", "prod")
    assert "gone" not in frames and {"people", "mails"} <= set(frames)
    assert "*" in frames["mails"].first().mail
    assert len(read_for_role(store, "AUDITOR", "", database="prod")) == len(frames)
    assert read_for_role(store, "AUDITOR", "mails", database="prod")[0].count() == 50


def test_catalog_helpers(store, spark):
    assert {"people", "mails"} <= set(list_tables(spark, "prod"))
    assert read_table(spark, "prod.people", ["state", "c03"]).columns == ["state", "c03"]
    assert read_table(spark, "prod.people", ["*"]).columns == ["phone", "c03", "cccd", "state"]


def test_policy_lookup_filters(spark):
    columns = spark.createDataFrame(
        [(1, "a", "HIGH"), (1, "b", "LOW"), (2, "a", "NONE")], "table_id int, column_name string, sensitivity_level string"
    )
    tables = spark.createDataFrame([(1, "t"), (2, "u")], "table_id int, table_name string")
    rules = spark.createDataFrame([("R", "HIGH", "HASH_MASK"), ("R", "LOW", "CLEAR_TEXT"), ("S", "HIGH", "X")],
                                  "role_name string, sensitivity_level string, masking_rule string")
    def found(*args):
        return {tuple(r) for r in resolve_policies(columns, tables, rules, "R", *args).collect()}

    assert found() == {("t", "a", "HIGH", "HASH_MASK"), ("t", "b", "LOW", "CLEAR_TEXT")}
    assert found("t", ["a"]) == {("t", "a", "HIGH", "HASH_MASK")} and found("u") == set()


def test_keyed_operators_survive_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS key", "id AS v")
    last = one_per_key(rows, ["key"], F.col("v"))
    assert last.count() == 2001 and last.filter("key = -1").first().v == 2997
    assert "Window" not in last._jdf.queryExecution().executedPlan().toString()
    merged = upsert(last, spark.createDataFrame([(-1, 7), (5000, 8)], "key bigint, v bigint"), ["key"])
    assert merged.count() == 2002 and merged.filter("key = -1").first().v == 7
