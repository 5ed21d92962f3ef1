import json
import os

import pandas as pd
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from loginlens.operators import geocode, layers
from loginlens.sources import documents, encode, readers, sinks

HEAD = "id,device_id,login_time,latitude,longitude"
LINES = ["a,d;1,2024-01-01 10:00:00,1.5,2.5", "a,d;2,2024-01-01 09:00:00,95,0", "b,d3,2024-01-01 08:00:00,3.0,4.0"]


def write(path, *lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


def test_reader_is_chosen_by_extension(spark, tmp_path):
    path = write(tmp_path / "x.CSV", HEAD, *LINES)
    assert rows_of(readers.read_logins(spark, path), "id", "device_id") == [("a", "d;1"), ("b", "d3")]
    df = spark.range(1)
    assert readers.read_logins(spark, df) is df
    for name in ("x.h5", "x.db", "x.pkl", "x.xls", "x"):
        with pytest.raises(ValueError, match="No reader available"):
            readers.read_logins(spark, str(tmp_path / name))


def test_missing_column_is_reported(spark, tmp_path):
    with pytest.raises(ValueError, match="Missing required column: id"):
        readers.read_logins(spark, write(tmp_path / "x.csv", "a,b", "1,2"))


@pytest.mark.parametrize("delimiter", [",", "\t", ";", "|"])
def test_delimiters(spark, tmp_path, delimiter):
    lines = [line.replace("d;", "d").replace(",", delimiter) for line in (HEAD, *LINES)]
    path = write(tmp_path / "x.txt", *lines)
    assert readers.read_logins(spark, path).count() == 2


def test_delimiter_by_count_and_single_column(spark, tmp_path):
    assert readers.rank_delimiters([HEAD, *LINES])[0] == ","
    assert readers.scan_delimited(spark, write(tmp_path / "a.txt", HEAD, *LINES)).columns == HEAD.split(",")
    assert readers.scan_delimited(spark, write(tmp_path / "b.txt", "word", "one", "two")).columns == ["word"]
    assert readers.scan_delimited(spark, write(tmp_path / "c.txt")).count() <= 1


def test_json_and_envelope(spark, tmp_path):
    record = {"id": "a", "device_id": "d", "login_time": "2024-01-01 10:00:00", "latitude": 1.0, "longitude": 2.0}
    path = write(tmp_path / "x.json", json.dumps([record, record]))
    assert readers.read_logins(spark, path).count() == 2
    event = {"user_id": "u", "timestamp": "2025-02-28T14:50:03.023Z", "latitude": 1.0, "longitude": 2.0,
             "device_id": "d", "ip_address": "1.2.3.4"}
    path = write(tmp_path / "e.json", json.dumps({"login_events": [event, event]}, indent=1))
    rows = readers.scan_json_envelope(spark, path).collect()
    assert len(rows) == 2 and rows[0].timestamp.microsecond == 23000


def test_feather_excel_and_parquet_files(spark, tmp_path):
    pdf = pd.DataFrame({"id": ["a", "b"], "device_id": ["d", "e"], "latitude": [1.0, 2.0], "longitude": [3.0, 4.0],
                        "login_time": pd.to_datetime(["2024-01-01 10:00:00.0", "2024-01-02 11:00:00.5"])})
    feather.write_feather(pdf, str(tmp_path / "x.feather"))
    pdf.astype({"login_time": "datetime64[us]"}).to_parquet(tmp_path / "x.parquet")
    text = pdf.assign(login_time=pdf["login_time"].astype(str))
    (tmp_path / "x.xlsx").write_bytes(encode.workbook_bytes(text))
    want = rows_of(readers.read_logins(spark, str(tmp_path / "x.parquet")), "id", "latitude")
    for name in ("x.feather", "x.xlsx"):
        got = readers.read_logins(spark, str(tmp_path / name))
        assert rows_of(got, "id", "latitude") == want
        assert got.where("id = 'b'").first().login_time.microsecond == 500000


def test_excel_day_numbers():
    times = readers._excel_time(pd.Series([45292.5, "2024-01-02 03:04:05"], dtype=object))
    assert list(times) == [pd.Timestamp("2024-01-01 12:00:00"), pd.Timestamp("2024-01-02 03:04:05")]


def test_office_extraction(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(encode.word_bytes(["Hello", "  ", "World & <co>"], [["x", "y"], ["1", "2"]]))
    (tmp_path / "b.pptx").write_bytes(encode.slides_bytes([["Title", " "], ["line1\nline2"]]))
    (tmp_path / "c.xlsx").write_bytes(encode.workbook_bytes(pd.DataFrame({"k": ["v"], "n": [1.5]}), "S1"))
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "e.json").write_text('{"a": 1}')
    (tmp_path / "f.pdf").write_bytes(b"skip")
    files = documents.office_files(spark, str(tmp_path))
    blocks = documents.extract_documents(files).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    got = {}
    for r in blocks.collect():
        got.setdefault(r.name, []).append(r)
    assert [r.text for r in got["a.docx"]] == ["Hello", "World & <co>", '["x", "y"]', '["1", "2"]']
    assert [(r.part, r.text) for r in got["b.pptx"]] == [("slide1", "Title"), ("slide2", "line1\nline2")]
    assert json.loads(got["c.xlsx"][0].text) == {"k": "v", "n": 1.5} and got["c.xlsx"][0].part == "S1"
    assert got["d.docx"][0].block == "error" and got["d.docx"][0].text.startswith("Error extracting text")
    assert json.loads(got["e.json"][0].text) == {"a": 1} and "f.pdf" not in got
    meta = {r.original_filename: r for r in documents.document_metadata(files).collect()}
    assert meta["b.pptx"].file_type == "powerpoint" and meta["a.docx"].extension == ".docx"
    restored = documents.document_bytes(documents.document_metadata(files)).where("original_filename = 'd.docx'").first()
    assert bytes(restored.content) == b"not a zip" and restored.status == "ok"


def test_document_bytes_statuses(spark):
    rows = spark.createDataFrame([("word", "aGk="), (None, "aGk="), ("pdf", "aGk=")], "file_type string, binary_content string")
    assert [(r.status, r.content and bytes(r.content)) for r in documents.document_bytes(rows).collect()] == [
        ("ok", b"hi"), ("missing file type", None), ("unsupported file type", None)]


def test_event_store_drops_repeats_and_keeps_verdicts(spark, small, tmp_path):
    path = str(tmp_path / "events")
    results = small.limit(0).select("event_id", F.lit(True).alias("is_anomalous"), F.lit(0.9).alias("combined_score"))
    sinks.append_login_events(sinks.login_events(small.unionByName(small), results), path)
    stored = spark.read.parquet(path)
    assert stored.count() == small.count() and stored.where("is_anomalous OR details IS NOT NULL").count() == 0
    assert any(n.startswith("login_date=") for n in os.listdir(path))


def test_bad_json_is_flagged(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("not json",)], "j string")
    out = sinks.json_to_nested(df, "j", spark.createDataFrame([], "a int").schema)
    assert [(r.j_ok, r.j.a if r.j else None) for r in out.collect()] == [(True, 1), (False, None)]


@pytest.mark.parametrize("days,period", [(31, ("P1D", "P5D")), (8, ("PT12H", "P1D")), (2, ("PT3H", "PT12H")),
                                         (1, ("PT30M", "PT3H"))])
def test_animation(make, days, period):
    end = f"2024-01-{1 + days:02d} 00:00:00" if days < 31 else "2024-02-01 00:00:00"
    df = make([(1, "a", "2024-01-01 00:00:00", 0.0, 0.0, "d"), (2, "a", end, 0.0, 0.0, "d")])
    row = layers.animation_settings(df).first()
    assert (row.period, row.duration) == period


def test_geojson_features(make):
    df = make([(1, "<u>", "2024-01-01 00:00:00", 1.0, 2.0, "d"), (2, "<u>", "2024-01-01 01:00:00", 3.0, 4.0, "d"),
               (3, "x", "2024-01-01 01:00:00", 99.0, 4.0, "d")])
    points = [json.loads(r.feature) for r in layers.point_json(layers.geojson_points(df)).collect()]
    assert len(points) == 2 and points[0]["geometry"]["coordinates"] == [2.0, 1.0]
    assert points[0]["properties"]["iconstyle"]["fillColor"] == "blue" and "&lt;u&gt;" in points[0]["properties"]["popup"]
    line = json.loads(layers.trajectory_lines(layers.trajectory_segments(df)).first().feature)
    assert line["geometry"] == {"type": "LineString", "coordinates": [[2.0, 1.0], [4.0, 3.0]]}


def test_geocode(spark):
    addresses = spark.createDataFrame([("1 Main St,  Town",), ("1 main st , town",), ("Nowhere",)], "address string")
    places = spark.createDataFrame([("1 Main St, Town", 1.0, 2.0), ("1 MAIN ST,TOWN", 1.0, 3.0)],
                                   "address string, lat double, lon double")
    got = rows_of(geocode.geocode_addresses(addresses, places))
    assert got == [("1 Main St,  Town", 1.0, 2.0), ("1 main st , town", 1.0, 2.0), ("Nowhere", None, None)]


def test_blocks_of_many_files_come_back_together(spark):
    import pyarrow as pa
    files = pa.RecordBatch.from_pydict({"path": [f"{i}.docx" for i in range(50)] + ["bad.docx", "x.pdf"],
                                        "content": [encode.word_bytes_of_text(f"a{i}\n\nb < {i}") for i in range(50)] + [b"no", b""]})
    found = list(documents._extract(iter([files])))
    assert len(found) == 1
    rows = found[0].to_pylist()
    assert [(r["position"], r["text"]) for r in rows[:4]] == [(0, "a0"), (1, "b < 0"), (0, "a1"), (1, "b < 1")]
    assert [r["block"] for r in rows[-2:]] == ["error", "error"] and len(rows) == 102


def test_a_text_escaped_whole_makes_the_file_of_its_lines():
    for text in ("", "a", "a\n", "\r\n<&>\n\x00x\n\n"):
        assert list(documents._word_blocks(encode.word_bytes_of_text(text))) == list(
            documents._word_blocks(encode.word_bytes(text.split("\n"))))
