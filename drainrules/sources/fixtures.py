"""Adapters that turn the driver's tables into the engine's inputs.

Each adapter is a lazy DataFrame over the given parquet tables, so every
query's work grows with them.  The same definitions exist as SQL text in
``drainrules.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drainrules import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_micros(name: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def _nan() -> Column:
    return F.lit(float("nan")).cast("double")


def device_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat samples (SAMPLE columns) with two apps each, from lineitem x part."""
    l = table(spark, sf_dir, "lineitem").alias("l")
    p = table(spark, sf_dir, "part").alias("p")
    j = l.join(p, F.col("l.l_partkey") == F.col("p.p_partkey"))
    ln = F.col("l.l_linenumber")
    ok = F.col("l.l_orderkey")
    pk = F.col("l.l_partkey")
    return j.select(
        ok.alias("order_id"),
        ln.alias("line_no"),
        F.when((ln == 7) & (ok % 5 == 0), _nan())
        .otherwise((F.col("l.l_extendedprice") - F.lit(20000.0)) / F.lit(50000.0)).alias("rate"),
        (F.col("l.l_quantity") / F.lit(40.0) - F.lit(0.1)).alias("cpu"),
        F.when((ln == 7) & (ok % 7 == 0), _nan())
        .otherwise(F.col("l.l_quantity") * ln).alias("distance"),
        (F.col("l.l_quantity") * F.lit(2.5)).alias("temp"),
        (F.lit(3.0) + F.col("l.l_tax") * F.lit(20.0)).alias("voltage"),
        F.when(ln == 1, F.lit(-1.0)).when(ln == 2, F.lit(-2.0))
        .otherwise((F.col("l.l_suppkey") * 3).cast("double")).alias("screen"),
        F.when(pk % 21 == 19, F.lit("null")).when(pk % 21 == 20, F.lit("lte_a"))
        .otherwise((pk % 21).cast("string")).alias("mobileNetwork"),
        F.when(F.col("l.l_returnflag") == "A", F.lit("wifi"))
        .when(F.col("l.l_returnflag") == "N", F.lit("mobile"))
        .otherwise(F.lit("unknown")).alias("network"),
        (F.lit(5) - pk % 120).cast("double").alias("wifiStrength"),
        (ok % 150 - 5).cast("double").alias("wifiSpeed"),
        F.col("p.p_brand").alias("app1"),
        F.col("p.p_type").alias("app2"),
        (epoch_micros("l_shipdate").cast("double") / F.lit(1e6)).alias("ship_time"),
    )


def _reading_struct(uuid: Column, time: Column, apps: Column, fields: dict[str, Column],
                    reading_id: Column | None = None) -> Column:
    """A READING struct from its device fields; the battery level is null."""
    cpu, temp, volt, screen, dist = (fields[c] for c in ("cpu", "temp", "voltage", "screen", "distance"))
    mob, net = fields["mobileNetwork"], fields["network"]
    ws, wsp = fields["wifiStrength"].cast("int"), fields["wifiSpeed"].cast("int")
    rid = F.lit(None).cast("long") if reading_id is None else reading_id
    return F.struct(
        rid.alias("reading_id"),
        uuid.alias("uuid"),
        time.alias("time"),
        F.lit(None).cast("double").alias("battery_level"),
        dist.alias("distanceTraveled"),
        apps.alias("apps"),
        F.struct(
            cpu.alias("cpuUsage"),
            F.struct(temp.alias("temperature"), volt.alias("voltage")).alias("battery"),
            screen.alias("screenBrightness"),
            F.struct(
                mob.alias("mobileNetworkType"),
                net.alias("networkType"),
                ws.alias("wifiSignalStrength"),
                wsp.alias("wifiLinkSpeed"),
            ).alias("networkInfo"),
        ).alias("androidFields"),
    )


def sample_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate records (schema RATE) whose second reading carries the sample.

    ``cur.time`` is the ship date in unix seconds, so the recency filter has
    a real date axis; apps are ``{app1, app2}`` as a set.
    """
    s = device_samples(spark, sf_dir)
    apps = F.array_distinct(F.array("app1", "app2"))
    cur = _reading_struct(F.concat(F.lit("and"), F.col("order_id").cast("string")), F.col("ship_time"), apps,
                          {c: F.col(c) for c in schemas.SAMPLE_COLUMNS}, (F.col("order_id") * 8 + F.col("line_no")).cast("long"))
    prev = F.lit(None).cast(schemas.READING)
    return s.select(
        F.col("rate"),
        apps.alias("all_apps"),
        F.struct(prev.alias("prev"), cur.alias("cur")).alias("sp"),
        F.lit(None).cast(schemas.REGISTRATION).alias("registration"),
    )


def _uuid_of(user_id: Column) -> Column:
    return F.when(user_id % 10 == 0, F.concat(F.lit("ios-device-000000-"), user_id.cast("string"))).otherwise(
        F.concat(F.lit("and"), user_id.cast("string"))
    )


def _compressed_time(name: str) -> Column:
    # One time unit = 1000 s, so rates fall in all classes.
    return epoch_micros(name).cast("double") / F.lit(1e9)


def device_readings(spark: SparkSession, sf_dir: str, events: Column | None = None) -> DataFrame:
    """Raw readings (schema READING) from ``events`` (or those that a condition picks).

    The device fields are made from ids, so that all classes of values occur.
    """
    e = table(spark, sf_dir, "events")
    if events is not None:
        e = e.where(events)
    apps = F.array_distinct(F.array(F.col("event_type"), F.concat(F.lit("app"), F.regexp_extract("props", "([0-9]+)", 1))))
    level = F.when(F.col("value") > 100, F.lit(100.0)).otherwise(F.col("value"))
    n, user = F.col("event_id"), F.col("user_id")
    fields = {
        "cpu": (n % 41).cast("double") / F.lit(40.0),
        "distance": (n % 200).cast("double"),
        "temp": (n % 90 + 5).cast("double"),
        "voltage": F.lit(3.0) + (n % 9).cast("double") / F.lit(10.0),
        "screen": F.when(n % 5 == 0, F.lit(-1.0)).otherwise((n % 256).cast("double")),
        "mobileNetwork": F.when(user % 21 == 19, F.lit("null")).when(user % 21 == 20, F.lit("lte_a")).otherwise((user % 21).cast("string")),
        "network": F.when(n % 3 == 0, F.lit("wifi")).when(n % 3 == 1, F.lit("mobile")).otherwise(F.lit("unknown")),
        "wifiStrength": F.lit(5) - user % 120,
        "wifiSpeed": n % 150 - 5,
    }
    r = _reading_struct(_uuid_of(user), _compressed_time("ts"), apps, fields)
    return e.select(
        F.col("event_id").cast("long").alias("reading_id"),
        r.getField("uuid").alias("uuid"),
        r.getField("time").alias("time"),
        level.alias("battery_level"),
        r.getField("distanceTraveled").alias("distanceTraveled"),
        apps.alias("apps"),
        r.getField("androidFields").alias("androidFields"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups (schema REGISTRATION) from ``events``."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return e.select(
        _uuid_of(F.col("user_id")).alias("uuid"),
        _compressed_time("ts").alias("reg_time"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("os"),
    )
