"""Preparation: readings -> pairs -> rates -> recent rates -> flat samples.

Decisions where the original record library is not visible:

* a pair is a reading and the previous reading of the same device in
  ``(time, reading_id)`` order; pairs without a time increase are dropped;
* ``rate = (prev.battery_level - cur.battery_level) / (cur.time - prev.time)``
  (percent per time unit; negative = charging);
* ``all_apps`` = union of the apps of both readings, as a set;
* the registration of a rate is the latest one of the device with
  ``reg_time <= cur.time`` (ties: greatest ``os``), or null.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drainrules import schemas
from drainrules.operators.asof import asof_join, previous_row

DEFAULT_BUCKET_WIDTH = "auto"  # or a width in time units (a day = 86400.0 s)


def filter_android(readings: DataFrame) -> DataFrame:
    """Android devices have uuids of at most 16 characters."""
    return readings.where(F.length("uuid") <= 16)


def pair_readings(readings: DataFrame, *, bucket_width: float | str = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """Consecutive readings of a device as ``(uuid, prev, cur)`` (schema PAIR)."""
    cols = [f.name for f in schemas.READING.fields]
    r = readings.select(*cols)
    matched = previous_row(r, "uuid", "time", [F.col("time"), F.col("reading_id")],
                           bucket_width=bucket_width, name="prev")
    cur = F.struct(*[F.col(c) for c in cols])
    return matched.where(F.col("prev").isNotNull() & (F.col("time") > F.col("prev.time"))).select(
        F.col("uuid"), F.col("prev"), cur.alias("cur"))


def rates_from_pairs(pairs: DataFrame, registrations: DataFrame | None = None, *,
                     bucket_width: float | str = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """Drain rate per pair with its apps and as-of registration (schema RATE)."""
    rate = (F.col("prev.battery_level") - F.col("cur.battery_level")) / (F.col("cur.time") - F.col("prev.time"))
    base = pairs.select(
        rate.alias("rate"),
        F.array_union(F.coalesce(F.col("prev.apps"), F.array().cast("array<string>")),
                      F.coalesce(F.col("cur.apps"), F.array().cast("array<string>"))).alias("all_apps"),
        F.struct(F.col("prev"), F.col("cur")).alias("sp"),
        F.col("uuid").alias("__uuid"),
        F.col("cur.time").alias("__time"),
        F.col("cur.reading_id").alias("__rid"),
    )
    if registrations is None:
        return base.select("rate", "all_apps", "sp", F.lit(None).cast(schemas.REGISTRATION).alias("registration"))
    regs = registrations.select("uuid", "reg_time", "os")
    matched = asof_join(
        base, regs, "__uuid", "__time", "reg_time",
        [F.col("__time"), F.lit(1), F.col("__rid").cast("string")],
        [F.col("reg_time"), F.lit(0), F.col("os")],
        bucket_width=bucket_width, match_name="registration", right_key="uuid")
    return matched.select("rate", "all_apps", "sp", "registration")


def asof_registration(rows: DataFrame, registrations: DataFrame, key: str, time: str, row_id: str, *,
                      bucket_width: float | str = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """Any rows with the latest registration at or before ``time`` (left, as-of)."""
    regs = registrations.select("uuid", "reg_time", "os")
    return asof_join(rows, regs, key, time, "reg_time",
                     [F.col(time), F.lit(1), F.col(row_id).cast("string")],
                     [F.col("reg_time"), F.lit(0), F.col("os")],
                     bucket_width=bucket_width, match_name="registration", right_key="uuid")


def unix_seconds(day: str) -> float:
    """``yyyy-MM-dd`` (UTC midnight) -> unix seconds."""
    d = _dt.datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=_dt.timezone.utc)
    return d.timestamp()


def filter_recent(rates: DataFrame, since: str | float) -> DataFrame:
    """Discharging rates (``rate >= 0``, NaN rejected) after the cutoff (strict)."""
    cutoff = unix_seconds(since) if isinstance(since, str) else float(since)
    return rates.where(~F.isnan("rate") & (F.col("rate") >= 0) & (F.col("sp.cur.time") > F.lit(cutoff)))


def filter_app(rates: DataFrame, app: str) -> DataFrame:
    """Rates whose app set contains ``app``."""
    return rates.where(F.array_contains("all_apps", app))


def flatten_rates(rates: DataFrame, keep_id: bool = False, extra: list | None = None) -> DataFrame:
    """Nested rate -> flat sample; device fields come from the second reading.

    ``keep_id`` adds ``reading_id`` of that reading in front.
    """
    cur = "sp.cur.androidFields"
    ident = [F.col("sp.cur.reading_id").alias("reading_id")] if keep_id else []
    return rates.select(
        *ident,
        F.col("rate").cast("double").alias("rate"),
        F.col(f"{cur}.cpuUsage").cast("double").alias("cpu"),
        F.col("sp.cur.distanceTraveled").cast("double").alias("distance"),
        F.col(f"{cur}.battery.temperature").cast("double").alias("temp"),
        F.col(f"{cur}.battery.voltage").cast("double").alias("voltage"),
        F.col(f"{cur}.screenBrightness").cast("double").alias("screen"),
        F.col(f"{cur}.networkInfo.mobileNetworkType").alias("mobileNetwork"),
        F.col(f"{cur}.networkInfo.networkType").alias("network"),
        F.col(f"{cur}.networkInfo.wifiSignalStrength").cast("double").alias("wifiStrength"),
        F.col(f"{cur}.networkInfo.wifiLinkSpeed").cast("double").alias("wifiSpeed"),
        *(extra or []),
    )
