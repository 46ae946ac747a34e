import os

from relforge.plans import workflow
from relforge.sources.catalog import Catalog, read_csv
from relforge.streaming.incremental import stream_profile


def test_odd_csv_files(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id,name\n1,Müller\n2,x\n".encode("latin-1"))
    (tmp_path / "quoted.csv").write_text('id,note\n1,"two\nlines"\n2,"say ""hi"""\n', encoding="utf-8")
    (tmp_path / "plain.csv").write_text("id,real,flag\n1,1.5,true\n2,,false\n", encoding="utf-8")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "latin.csv")).collect()] == [(1, "Müller"), (2, "x")]
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "quoted.csv")).collect()] == [(1, "two\nlines"), (2, 'say "hi"')]
    assert read_csv(spark, str(tmp_path / "plain.csv")).dtypes == [("id", "bigint"), ("real", "double"), ("flag", "boolean")]
    assert sorted(Catalog.from_folder(spark, f"file://{tmp_path}").tables) == ["latin", "plain", "quoted"]


def test_json_of_every_layout(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "one.json").write_text('{\n "a": 1\n}')
    (tmp_path / "broken.json").write_text("{no")
    found = Catalog.from_folder(spark, str(tmp_path))
    assert {t: df.count() for t, df in found.tables.items()} == {"array": 2, "lines": 2, "one": 1} and list(found.skipped) == ["broken.json"]


def test_structures_are_split(spark, tmp_path):
    rows = "\n".join(f"{i},Ann Lee,\"{i} Main St, Springfield, CA 1234{i}\"" for i in range(9))
    (tmp_path / "people.csv").write_text(f"person_id,full_name,address\n{rows}\n")
    state = workflow.run(spark, str(tmp_path), split=True)
    assert state.status == "completed", state.errors
    columns = {c for df in state.normalized.tables.values() for c in df.columns}
    assert {"full_name_first", "full_name_last", "address_street", "address_zip"} <= columns


def test_a_stream_of_files(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).selectExpr("id", "if(id % 2 = 0, id, null) AS half").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_profile(spark, str(tmp_path / "in"), "id long, half long", "t").writeStream.format("memory").queryName("profiles").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    got = {r["column_name"]: (r["total_count"], r["non_null_count"]) for r in spark.table("profiles").collect()}
    assert got == {"id": (20, 20), "half": (20, 10)} and os.path.isdir(tmp_path / "in")
