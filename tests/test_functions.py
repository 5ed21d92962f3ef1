import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.functions import clock, geo, stats, text
from loginlens.operators.scoring import location_z, velocity_score


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_haversine(spark):
    lit = F.lit
    assert value(spark, geo.haversine_km(lit(0.0), lit(179.9), lit(0.0), lit(-179.9))) == 22.24
    assert value(spark, geo.haversine_km(lit(51.5), lit(-0.15), lit(51.5), lit(-0.15))) == 0.0
    assert value(spark, geo.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(180.0))) == pytest.approx(20015.09)
    assert value(spark, geo.haversine_km(lit(None).cast("double"), lit(0.0), lit(0.0), lit(0.0))) is None


@pytest.mark.parametrize("lat,lon,ok", [
    (90.0, 0.0, True), (-90.0, 0.0, True), (90.0001, 0.0, False), (0.0, 180.0, True), (0.0, -180.0, True),
    (None, 0.0, False), (float("nan"), 0.0, False)])
def test_valid_coordinates(spark, lat, lon, ok):
    column = geo.valid_coordinates(F.lit(lat).cast("double"), F.lit(lon).cast("double"))
    assert value(spark, column) is ok


@pytest.mark.parametrize("speed,score", [
    (80, 0.0), (80.1, 0.1), (150, 0.1), (150.1, 0.3), (300, 0.3), (300.1, 0.6), (800, 0.6), (800.1, 0.9),
    (1000, 0.9), (1000.1, 1.0)])
def test_velocity_tiers_are_strict(spark, speed, score):
    assert value(spark, velocity_score(F.lit(float(speed)))) == score


@pytest.mark.parametrize("distance,spread,z", [(0.0, 0.0, 0.0), (5.0, 0.0, 10.0), (6.0, 2.0, 3.0)])
def test_location_z(spark, distance, spread, z):
    assert value(spark, location_z(F.lit(distance), F.lit(spread))) == z


@pytest.mark.parametrize("t", [0.001, 0.5, 1.0, 3.0, 5.99, 6.01, 17.9, 30.0, 60.0, 99.0])
def test_chi2_matches_the_error_function(spark, t):
    exact = math.erf(math.sqrt(t / 2)) - math.sqrt(2 * t / math.pi) * math.exp(-t / 2)
    assert value(spark, stats.chi2_cdf_3(F.lit(t))) == pytest.approx(exact, abs=1e-11)


def test_chi2_ends(spark):
    assert value(spark, stats.chi2_cdf_3(F.lit(0.0))) == 0.0
    assert value(spark, stats.chi2_cdf_3(F.lit(1e6))) == 1.0
    assert value(spark, stats.chi2_cdf_3(F.lit(None).cast("double"))) is None


def test_sigmoid_centre(spark):
    assert value(spark, stats.sigmoid_z(F.lit(3.0))) == 0.5


@pytest.mark.parametrize("ip,network", [
    ("192.168.1.77", "192.168.1.0"), ("2001:db8:1:2::5", "2001:db8:1::"), ("300.1.1.1", "300.1.1.1"),
    ("010.1.1.1", "010.1.1.1"), ("no:such::address::", "no:such::address::"), (None, None), ("::1", "::"),
    (":::", ":::"), ("1:2", "1:2"), ("1::2::3", "1::2::3"), ("2001:DB8::1:2", "2001:db8::"), ("::ffff:10.0.0.1", "::"),
    ("2001:0:0:1::", "2001::"), ("0:0:5::1", "0:0:5::"), ("1:2:3:4:5:6:7:8", "1:2:3::"), ("1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8:9"),
    ("fe80::1%eth0", "fe80::"), ("1::12345", "1::12345")])
def test_anonymize_ip(spark, ip, network):
    assert value(spark, text.anonymize_ip(F.lit(ip).cast("string"))) == network


def test_addresses_need_no_python(spark):
    plan = spark.range(1).select(text.anonymize_ip(F.lit("1.2.3.4")), text.valid_ip(F.lit("::1")))._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("iso,plain", [
    ("2025-02-28T14:50:03.023Z", "2025-02-28 14:50:03"), ("2025-02-28T14:50:03+05:30", "2025-02-28 14:50:03"),
    ("2025-02-28 14:50:03", "2025-02-28 14:50:03"), ("nonsense", None)])
def test_format_iso_text(spark, iso, plain):
    assert value(spark, clock.format_iso_text(F.lit(iso))) == plain


def test_merge_maps_nested(spark):
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType()))
    left = F.lit('{"a":{"x":1,"y":2},"b":{"z":3}}')
    right = F.lit('{"a":{"y":9},"c":{"w":4}}')
    merged = value(spark, text.merge_maps(F.from_json(left, kind), F.from_json(right, kind), kind))
    assert merged == {"a": {"x": 1, "y": 9}, "b": {"z": 3}, "c": {"w": 4}}


def test_popups_escape_markup(spark):
    assert value(spark, text.escape_html(F.lit("<b>&'\""))) == "&lt;b&gt;&amp;&#39;&quot;"


@pytest.mark.parametrize("number,shown", [(0.56875, "0.5687"), (12345.0, "12345.0000"), (0.5, "0.5000")])
def test_fixed_decimals_round_the_binary_value(spark, number, shown):
    assert value(spark, text.fixed_decimals(F.lit(number), 4)) == shown == f"{number:.4f}"


def test_ids(spark):
    ids = spark.range(2).select(text.unique_id().alias("u"), text.stable_id("id").alias("s")).collect()
    assert ids[0].u != ids[1].u and len(ids[0].u) == 36 and ids[0].s != ids[1].s
