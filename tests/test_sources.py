"""Readers, configuration files, sinks and streams."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from termsheet.operators import export
from termsheet.session import reliable_checkpoint
from termsheet.sources import config_tables, ingest, sinks
from termsheet.streaming import jobs


def test_document_scan_replaces_bad_bytes(spark, tmp_path):
    folder = tmp_path / "000114036124000001"
    folder.mkdir()
    (folder / "raw.html").write_bytes(b"<p>caf\xe9</p>")
    (folder / "notes.txt").write_text("x")
    row = ingest.scan_documents(spark, str(tmp_path)).first()
    assert row["folder_key"] == "000114036124000001" and row["html"] == "<p>caf\ufffd</p>"
    assert [r["filename"] for r in ingest.list_files(spark, str(folder)).collect()] == ["notes.txt", "raw.html"]


def test_cusip_sheet_last_row_wins(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("Name, CUSIP ,Spectrum,Source\na,Q1,m1,u1\nb, Q1 ,m2,\nc,,m3,u\nd,Q2,,u\n")
    assert [tuple(r) for r in ingest.read_cusip_map(spark, str(path)).collect()] == [("Q1", "m2", "")]
    path.write_text("id,name\n1,2\n")
    assert ingest.read_cusip_map(spark, str(path)).count() == 0


def test_yaml_tables(spark, tmp_path):
    (tmp_path / "shared.yaml").write_text('labels:\n  "Maturity Date": "a.b"\n  "Bad": 3\n')
    (tmp_path / "issuer_b.yaml").write_text("issuer_key: B\naliases:\n  name_match_patterns: [Bee]\nsection_headings: [H1]\n"
                                            "table_labels:\n  \"Due\": \"a.c\"\nfield_hints:\n  a.b:\n    synonyms: [s1, s2]\n")
    (tmp_path / "issuer_a.yaml").write_text("aliases: {}\n")
    (tmp_path / "sections.yaml").write_text("coupon:\n  schema_keys: [coupon]\n  search_headers: [COUPON]\n")
    rows = config_tables.read_labels(spark, str(tmp_path / "shared.yaml"), None, str(tmp_path)).collect()
    assert [(r["layer"], r["issuer_key"], r["label_raw"]) for r in rows] == [(1, None, "Maturity Date"), (3, "B", "Due")]
    issuers, hints = config_tables.read_issuer_hints(spark, str(tmp_path))
    assert issuers.first()["section_headings"] == ["H1"] and hints.first()["synonyms"] == "s1, s2"
    assert config_tables.issuer_list(str(tmp_path))[0]["patterns"] == ["Bee"]
    assert config_tables.read_sections(str(tmp_path / "sections.yaml"))["coupon"]["max_chars"] == 10_000


def _exported(spark):
    filings = spark.createDataFrame([("f", "Q1", "a-1", None, "2024-01-01", "u", "v1")],
                                    "filing_id STRING, cusip STRING, accession_number STRING, issuer_name STRING, filing_date STRING, source_url STRING, schema_version STRING")
    runs = spark.createDataFrame([("f", "e1", "m 1", "2024-01-02")], "filing_id STRING, extraction_id STRING, model STRING, extracted_at STRING")
    fields = spark.createDataFrame([("f", "e1", "a.b", '"x,\\"y"', None, "accepted"), ("f", "e1", "a.c", "1.5", "2", "corrected"), ("f", "e1", "d", "3", None, "rejected"),
                                    ("f", "e1", "s", '{"k":1}', None, None)],
                                   "filing_id STRING, extraction_id STRING, field_path STRING, value_json STRING, reviewed_json STRING, review_status STRING")
    return filings, runs, export.effective_values(fields)


def test_json_sink_reads_back(spark, tmp_path):
    out = str(tmp_path / "json")
    docs = sinks.export_documents(*_exported(spark), "2024-02-03T04:05:06")
    assert docs.first()["file_name"] == "Q1_m_1_2024-02-03"
    sinks.write_documents(docs, out)
    doc = json.loads(spark.read.text(out).first()["value"])
    assert doc["fields"] == {"a": {"b": 'x,"y', "c": 2}, "s": {"k": 1}, "model": "m 1"}
    assert doc["field_review_status"] == {"a.b": "accepted", "a.c": "corrected", "d": "rejected", "s": "accepted"}
    assert doc["export_metadata"]["issuer_name"] == ""


def test_flat_sink_reads_back(spark, tmp_path):
    out = str(tmp_path / "csv")
    rows = sinks.flat_rows(*_exported(spark), ["s", "a.c", "d", "missing"])
    sinks.write_flat(rows, out)
    back = spark.read.csv(out, header=True, emptyValue="")
    assert back.columns == ["cusip", "payout_type_id", "schema_version", "filing_date", "a.c", "d", "missing", "s"]
    text = next(Path(out).glob("*.csv")).read_text().splitlines()[1]
    assert text.startswith("Q1,m 1,v1,2024-01-01,2,,,")


def test_reliable_checkpoint_keeps_rows(spark):
    df = reliable_checkpoint(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90


def test_stream_drops_repeated_filings(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [("000114036124000001", "2024-01-01 00:00:00"), ("0001140361-24-000001", "2024-01-01 01:00:00"), ("000114036124000002", "2024-01-01 02:00:00")]
    ddl = "accession_number STRING, received_at TIMESTAMP"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "accession_number STRING, t STRING").selectExpr("accession_number", "cast(t AS timestamp) received_at").write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (jobs.unique_filings(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r["folder_path"] for r in spark.read.parquet(str(out)).collect()) == ["000114036124000001", "000114036124000002"]


def test_a_replayed_batch_is_applied_once(spark, tmp_path):
    from termsheet.streaming import jobs

    ddl = "filing_id STRING, seq BIGINT, action STRING, model STRING"
    written, outcomes = [], []
    state = {"batch": -1, "rows": spark.createDataFrame([("f", "extracted", "index", 0.9), ("g", "extracted", "index", 0.9)],
                                                        "filing_id STRING, status STRING, model STRING, confidence DOUBLE")}

    def write_state(moved, batch_id):
        written.append((batch_id, [tuple(r) for r in moved.collect()]))
        if batch_id == 0 and state["batch"] < 0:
            state.update(batch=batch_id, rows=spark.createDataFrame(written[-1][1], "filing_id STRING, status STRING, model STRING, confidence DOUBLE"))
            raise RuntimeError("lost after the commit")

    spark.createDataFrame([("f", 1, "approve", "")], ddl).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        actions = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        stream = jobs.follow_actions(actions, lambda: state["rows"], lambda: state["batch"], write_state,
                                     lambda o, i: outcomes.append([r["reason"] for r in o.collect()]), str(tmp_path / "checkpoint"))
        try:
            stream.awaitTermination()
        except Exception as lost:
            assert "lost after the commit" in str(lost)
    assert written == [(0, [("f", "approved", "index", 0.9)])] and outcomes == [[None]]
