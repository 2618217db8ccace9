"""Rule-browser text: JavaScript toPrecision(2), integral bounds, item labels, tabs."""

import pytest
from pyspark.sql import functions as F

from drainrules.functions.format import to_precision2
from drainrules.operators import report


@pytest.mark.parametrize("x,js", [
    (0.996, "1.0"), (2.44e-05, "0.000024"), (130.5, "1.3e+2"), (52.5, "53"), (27.5, "28"), (0.225, "0.23"),
    (0.0, "0.0"), (-0.5, "-0.50"), (100.0, "1.0e+2"), (5.0, "5.0"), (3.6, "3.6"), (1e-7, "1.0e-7"),
    (0.00000123, "0.0000012"), (99.96, "1.0e+2"), (-71.0, "-71"), (float("nan"), "NaN"),
])
def test_to_precision2(spark, x, js):
    got = spark.createDataFrame([(x,)], "x double").select(to_precision2(F.col("x"))).collect()[0][0]
    assert got == js


def test_item_labels(spark):
    bins = spark.createDataFrame(
        [("cpu", 0, 0.0), ("cpu", 1, 0.25), ("cpu", 2, 0.5), ("screen", 0, 0.0), ("screen", 1, 60.0),
         ("screen", 2, 126.0)], "feature string, idx int, bound double")
    items = spark.createDataFrame([("cpu=q2",), ("screen=q1",), ("screen=auto",), ("netType=wifi",),
                                   ("wifiSpeed=q1",), ("cpu=q7",)], "item string")
    got = dict(report.item_labels(items, bins).select("item", "label").collect())
    assert got == {"cpu=q2": "cpu is 0.25 - 0.50", "screen=q1": "screen is 0 - 60", "screen=auto": "screen=auto",
                   "netType=wifi": "netType=wifi", "wifiSpeed=q1": "wifiSpeed=q1", "cpu=q7": "cpu is NaN - NaN"}


def test_rate_bin_labels(spark):
    bins = spark.createDataFrame([("rate", i, b) for i, b in enumerate([2.44e-5, 0.2457, 0.4891, 0.7417, 0.99999])],
                                 "feature string, idx int, bound double")
    got = [tuple(r) for r in report.rate_bin_labels(bins).orderBy("tab").collect()]
    assert got[0] == (0, " Rate is 0.000024 - 0.25 % / s")
    assert got[-1] == (3, " Rate is 0.74 - 1.0 % / s")
