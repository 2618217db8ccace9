"""Unit tables for every discretiser branch and both sides of each bound."""

import math

import pytest
from pyspark.sql import functions as F

from drainrules.functions import discretize as dz
from drainrules.operators import features as feat
from drainrules.schemas import SAMPLE

NAN = float("nan")


def _items(spark, column, values, bins, item):
    rows = []
    for v in values:
        r = {c: None for c in SAMPLE.fieldNames()}
        r[column] = v
        rows.append(tuple(r[c] for c in SAMPLE.fieldNames()))
    df = spark.createDataFrame(rows, SAMPLE)
    out = feat.item_table(df, bins).select(item).collect()
    return [r[0] for r in out]


BINS = {"rate": [0.0, 0.25, 0.5, 0.75, 1.0], "cpu": [0.0, 0.25, 0.5, 0.75, 1.0],
        "temperature": [5.0, 20.0, 40.0, 60.0, 100.0], "voltage": [3.0, 3.6, 4.0, 4.6],
        "screen": [0.0, 50.0, 100.0, 200.0, 255.0], "wifiStrength": [-99.0, -70.0, -50.0, -20.0, 0.0],
        "wifiSpeed": [0.0, 30.0, 60.0, 90.0, 144.0]}


@pytest.mark.parametrize("value,expected", [
    (NAN, "rate=q4"),          # the rate item is bucketed without its domain rule
    (-0.0001, "rate=q1"), (0.0, "rate=q1"), (0.25, "rate=q1"), (0.2500001, "rate=q2"),
    (0.5, "rate=q2"), (0.75, "rate=q3"), (0.76, "rate=q4"), (1.0, "rate=q4"), (1.0001, "rate=q4"),
    (None, None),
])
def test_rate(spark, value, expected):
    assert _items(spark, "rate", [value], BINS, "rate") == [expected]


@pytest.mark.parametrize("value,expected", [
    (NAN, None), (-0.0001, None), (0.0, "cpu=q1"), (0.25, "cpu=q1"), (0.3, "cpu=q2"),
    (0.75, "cpu=q3"), (0.9, "cpu=q4"), (1.0, "cpu=q4"), (1.0001, None), (None, None),
])
def test_cpu(spark, value, expected):
    assert _items(spark, "cpu", [value], BINS, "cpu") == [expected]


@pytest.mark.parametrize("value,expected", [
    (NAN, None), (99.99, "distance=no"), (100.0, "distance=yes"), (-5.0, "distance=no"), (None, None),
])
def test_distance(spark, value, expected):
    assert _items(spark, "distance", [value], BINS, "distance") == [expected]


@pytest.mark.parametrize("value,expected", [
    (NAN, None), (4.99, None), (5.0, "temperature=q1"), (20.0, "temperature=q1"), (20.5, "temperature=q2"),
    (99.99, "temperature=q4"), (100.0, "temperature=q4"), (100.01, None),
])
def test_temperature(spark, value, expected):
    assert _items(spark, "temp", [value], BINS, "temperature") == [expected]


@pytest.mark.parametrize("value,expected", [
    (NAN, "voltage=q3"),       # no domain rule: NaN sorts past every bound
    (1.0, "voltage=q1"), (3.6, "voltage=q1"), (3.7, "voltage=q2"), (4.0, "voltage=q2"), (9.0, "voltage=q3"),
])
def test_voltage(spark, value, expected):
    assert _items(spark, "voltage", [value], BINS, "voltage") == [expected]


@pytest.mark.parametrize("value,expected", [
    (-1.0, "screen=auto"), (-1.5, None), (-2.0, None), (-0.5, "screen=q1"), (0.0, "screen=q1"),
    (255.0, "screen=q4"), (256.0, None), (NAN, None), (150.0, "screen=q3"),
])
def test_screen(spark, value, expected):
    assert _items(spark, "screen", [value], BINS, "screen") == [expected]


@pytest.mark.parametrize("value,expected", [
    (NAN, None), (-100.0, "wifiStrength=q1"), (-100.5, None), (0.0, "wifiStrength=q4"), (0.5, None),
    (-60.0, "wifiStrength=q2"),
])
def test_wifi_strength(spark, value, expected):
    assert _items(spark, "wifiStrength", [value], BINS, "wifiStrength") == [expected]


@pytest.mark.parametrize("value,expected", [
    (NAN, None), (-0.5, None), (0.0, "wifiSpeed=q1"), (1000.0, "wifiSpeed=q4"), (45.0, "wifiSpeed=q2"),
])
def test_wifi_speed(spark, value, expected):
    assert _items(spark, "wifiSpeed", [value], BINS, "wifiSpeed") == [expected]


@pytest.mark.parametrize("value,expected", [
    ("unknown", "unknown"), ("null", "unknown"), (None, "unknown"), ("13", "lte"), ("7", "1xrtt"),
    ("18", "iwlan"), ("0", "unknown"), ("19", "unknown"), ("123456", "unknown"), ("12a", "12a"),
    ("lte_a", "lte_a"), ("12\n", "12\n"), ("", ""),
])
def test_mobile_network(spark, value, expected):
    assert _items(spark, "mobileNetwork", [value], BINS, "mobileNetType") == [f"mobileNetType={expected}"]


@pytest.mark.parametrize("value,expected", [
    ("unknown", "unknown"), ("null", "unknown"), (None, "unknown"), ("wifi", "wifi"), ("mobile", "mobile"),
])
def test_network(spark, value, expected):
    assert _items(spark, "network", [value], BINS, "netType") == [f"netType={expected}"]


def test_every_code_is_named(spark):
    codes = list(dz.MOBILE_NETWORK_CODES)
    got = _items(spark, "mobileNetwork", codes, BINS, "mobileNetType")
    assert got == [f"mobileNetType={dz.MOBILE_NETWORK_CODES[c]}" for c in codes]


def test_tied_bounds_leave_buckets_empty(spark):
    bins = dict(BINS, cpu=[0.0, 0.5, 0.5, 0.5, 1.0])
    assert _items(spark, "cpu", [0.5, 0.6], bins, "cpu") == ["cpu=q1", "cpu=q4"]


def test_no_quantiles_gives_q1(spark):
    bins = dict(BINS, cpu=[0.0, 0.0])
    assert _items(spark, "cpu", [0.9], bins, "cpu") == ["cpu=q1"]


def test_parse_excluded():
    assert dz.parse_excluded(" cpu, temp ,netType") == frozenset({"cpu", "temperature", "netType"})
    assert dz.parse_excluded(None) == frozenset()
    with pytest.raises(ValueError):
        dz.parse_excluded("rate")
    with pytest.raises(ValueError):
        dz.parse_excluded("battery")


def test_transaction_drops_items_not_rows(spark):
    row = tuple([NAN, NAN, NAN, NAN, 3.0, NAN, "1", "wifi", NAN, NAN])
    df = spark.createDataFrame([row], SAMPLE)
    tx = feat.transactions(df, BINS).collect()[0]["items"]
    assert tx == ["rate=q4", "voltage=q1", "mobileNetType=gprs", "netType=wifi"]
    assert math.isnan(row[0])
