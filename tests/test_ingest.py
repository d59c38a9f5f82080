import json

from maskwright.sources import ingest


def test_csv_becomes_an_all_text_table(spark, tmp_path):
    (tmp_path / "People.csv").write_text("id,Name\n007,An\n8,\n", encoding="utf-8")
    fqn = ingest.ingest_csv(spark, str(tmp_path / "People.csv"), "ing")
    assert fqn == "ing.people"
    table = spark.table(fqn)
    assert dict(table.dtypes) == {"id": "string", "Name": "string"}
    assert {tuple(r) for r in table.collect()} == {("007", "An"), ("8", None)}


def test_reload_overwrites(spark, tmp_path):
    path = tmp_path / "t.csv"
    for text in ("a\n1\n2\n", "b\n3\n"):
        path.write_text(text)
        ingest.ingest_csv(spark, str(path), "ing")
    assert [tuple(r) for r in spark.table("ing.t").collect()] == [("3",)]


def test_missing_file_and_empty_folder_are_logged_not_raised(spark, tmp_path):
    assert ingest.ingest_csv(spark, str(tmp_path / "none.csv"), "ing") is None
    assert ingest.ingest_folder(spark, str(tmp_path / "*.csv"), "ing") == []


def test_folder_loads_files_and_spark_folders(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a\n1\n")
    ingest.write_csv(spark.range(100).repartition(3), str(tmp_path / "two.csv"))
    (tmp_path / "readme.txt").write_text("no")
    assert sorted(ingest.ingest_folder(spark, str(tmp_path / "*.csv"), "ing2")) == ["ing2.one", "ing2.two"]
    assert spark.table("ing2.two").count() == 100


def test_ground_truth(spark, tmp_path):
    document = {"table_name": "t.csv", "total_columns": 1, "total_rows": 5,
                "columns": [{"column_name": "c", "sensitivity_tag": "NAME", "sensitivity_level": "MEDIUM"}]}
    (tmp_path / "t_metadata.json").write_text(json.dumps(document, indent=4))
    rows = ingest.read_ground_truth(spark, str(tmp_path / "t_metadata.json")).collect()
    assert [tuple(r) for r in rows] == [("t", "c", "NAME", "MEDIUM")]
