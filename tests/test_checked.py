import pytest

from conftest import rows_of
from loginlens.session import run_dir
from loginlens.sources.checked import scan_checked_csv, scan_checked_json


def written(spark, *files):
    path = run_dir(spark, "checked")
    for lines in files:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
    return path


def reasons(checked):
    return sorted((r.row, r.reason) for r in checked.rejects.collect())


def test_every_csv_row_comes_out(spark):
    path = written(
        spark, ["id,device_id,login_time,latitude,longitude", "u1,d1,2024-01-01 10:00:00,1.5,2.5", "u2,d1,2024-01-01 10:00:00,abc,2.5",
                "u3,d1,soon,1.0,2.0", ",d1,2024-01-01 10:00:00,1.0,2.0", "u4,,2024-01-01 10:00:00,1.0,2.0", "u5,d1,2024-01-01 10:00:00,91,2",
                "u6,d1,2024-01-01 10:00:00,1.0,2.0,more", "u7,d1", "\"u,8\",d1,2024-01-01 10:00:00,,2.0"],
        ["longitude,latitude,city,login_time,device_id,id", "2.5,1.5,Rome,2024-01-01 10:00:00,d9,u9"],
        ["id,device_id,login_time,latitude", "u10,d1,2024-01-01 10:00:00,1.0"])
    got = scan_checked_csv(spark, path)
    assert sorted((r.id, r.device_id, r.latitude, r.longitude) for r in got.rows.collect()) == [("u1", "d1", 1.5, 2.5), ("u9", "d9", 1.5, 2.5)]
    assert [r for _, r in reasons(got)].count("malformed") == 2
    assert dict(reasons(got))["u6,d1,2024-01-01 10:00:00,1.0,2.0,more"] == "malformed" and dict(reasons(got))["u7,d1"] == "malformed"
    assert sorted(r for _, r in reasons(got)) == ["bad_coordinates"] * 3 + ["bad_time"] + ["malformed"] * 2 + [
        "missing_column", "missing_device", "missing_id"]
    assert got.rejects.where("file LIKE '%.txt'").count() == 9
    assert sorted((tuple(r.missing), tuple(r.extra)) for r in got.drift.collect()) == [((), ("city",)), (("longitude",), ())]


def test_every_json_row_comes_out(spark):
    good = '{"id":"u1","device_id":"d","login_time":"2024-01-01 10:00:00","latitude":1.5,"longitude":2}'
    path = written(spark, [good, good[:40], '{"id":"u2","device_id":"d","latitude":1,"longitude":2}', "[1", '{"id":"u3"}',
                           good.replace("1.5", '"x"')])
    got = scan_checked_json(spark, path)
    assert rows_of(got.rows, "id", "latitude") == [("u1", 1.5)]
    assert sorted(r for _, r in reasons(got)) == ["bad_coordinates", "bad_time", "malformed", "malformed", "missing_device"]
    assert good[:40] in dict(reasons(got)) and got.drift.count() == 0


def test_empty_and_odd_files(spark):
    assert scan_checked_csv(spark, written(spark, ["id,device_id,login_time,latitude,longitude"])).rows.count() == 0
    twice = scan_checked_csv(spark, written(spark, ["id,id,device_id,login_time,latitude,longitude", "u,v,d,2024-01-01 10:00:00,1,2"]))
    assert rows_of(twice.rows, "id") == [("u",)]
    path = written(spark, *[[f"id,c{i}", "u,v"] for i in range(3)])
    assert [r for _, r in reasons(scan_checked_csv(spark, path))] == ["missing_column"] * 3
    with pytest.raises(Exception):
        scan_checked_csv(spark, run_dir(spark, "nothing"))
