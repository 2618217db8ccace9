"""Readers and writers (all distributed; nothing is collected to the driver).

Parquet replaces the original Java object files.  Delimited text keeps the
original layouts: headerless comma CSV and tab TSV with a header for flat
samples, headerless ``app<TAB>count`` lines, and ``{app: count}`` JSON
objects for app counts (one object per output file, so no single task has
to hold all apps; a reader merges them).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drainrules import schemas
from drainrules.session import workers_find_package

APP_BUCKETS = 64  # folders of rates stored by app
DEVICE_BUCKETS = 64  # files of tables stored by device


# ---------------------------------------------------------------- parquet
def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RATE).parquet(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.READING).parquet(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAIR).parquet(path)


def read_registrations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGISTRATION).parquet(path)


def write_recent_rates(rates: DataFrame, path: str) -> str:
    """Recent rates partitioned by UTC month of the second reading (prunable;
    parquet row-group statistics on ``sp.cur.time`` serve finer ranges).

    ``REBALANCE(month)`` lets AQE put each month's rows together (few files
    per month) while splitting a hot month and merging small ones.
    """
    month = F.date_format(F.timestamp_seconds(F.col("sp.cur.time").cast("long")), "yyyy-MM")
    return write_parquet(rates.withColumn("month", month).hint("rebalance", "month"), path, ["month"])


def write_rates_by_app(rates: DataFrame, path: str, buckets: int = APP_BUCKETS) -> str:
    """Rates stored once per app of theirs: folders by hash of the app, sorted by app inside.

    A search for one app then reads one folder, and of it only the row groups
    whose statistics hold the app.  ``REBALANCE`` splits a hot folder's rows
    over several tasks and files.
    """
    per_app = rates.withColumn("app", F.explode(F.array_distinct("all_apps"))).withColumn("app_bucket", _app_bucket(F.col("app"), buckets))
    return write_parquet(per_app.hint("rebalance", "app_bucket").sortWithinPartitions("app_bucket", "app"), path, ["app_bucket"])


def read_rates_of_app(spark: SparkSession, path: str, app: str, buckets: int = APP_BUCKETS) -> DataFrame:
    """The rates of one app from ``write_rates_by_app`` (partition and row-group pruning)."""
    schema = T.StructType(schemas.RATE.fields + [T.StructField("app", T.StringType()), T.StructField("app_bucket", T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path)
    return stored.where((F.col("app_bucket") == _app_bucket(F.lit(app), buckets)) & (F.col("app") == app)).select(*schemas.RATE.names)


def _app_bucket(app, buckets: int):
    return F.pmod(F.hash(app), F.lit(int(buckets))).cast("int")


def read_recent_rates(spark: SparkSession, path: str) -> DataFrame:
    # a new schema: StructType.add would change the shared RATE in place
    schema = T.StructType(schemas.RATE.fields + [T.StructField("month", T.StringType(), True)])
    return spark.read.schema(schema).parquet(path)


def read_rates_for(spark: SparkSession, path: str, app: str) -> DataFrame:
    """The rates of one app, from rates stored either way.

    From ``write_rates_by_app`` one folder is read, and of it the row groups that hold the app; from plain
    rates all are read and filtered.
    """
    if "app_bucket" in spark.read.parquet(path).columns:
        return read_rates_of_app(spark, path, app)
    return read_rates(spark, path).where(F.array_contains("all_apps", app))


# ---------------------------------------------------------------- tables by device
def write_by_device(df: DataFrame, path: str, order: list[str], key: str = "uuid", buckets: int = DEVICE_BUCKETS) -> DataFrame:
    """Store a table bucketed by device and sorted inside its files; returns it read back.

    Windows and joins on the device then read co-located rows: no exchange.  ``REBALANCE`` hands each task
    whole devices, so that a bucket is few files, and splits a hot device's rows over several tasks.
    """
    (df.hint("rebalance", buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(*order)
     .option("path", path).saveAsTable(_table_name()))
    return open_by_device(df.sparkSession, path, df.schema, order, key, buckets)


def open_by_device(spark: SparkSession, path: str, schema: T.StructType, order: list[str], key: str = "uuid",
                   buckets: int = DEVICE_BUCKETS) -> DataFrame:
    """A table of ``write_by_device``, in any session (the folder alone does not say how it is bucketed)."""
    name = _table_name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    sort = ", ".join(f"`{c}`" for c in order)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({sort}) INTO {int(buckets)} BUCKETS "
              f"LOCATION '{path}'")
    return spark.table(name)


def _table_name() -> str:
    return f"drainrules_{uuid.uuid4().hex}"


# ---------------------------------------------------------------- flat samples as text
def write_samples_tsv(samples: DataFrame, path: str) -> str:
    """TSV with the header ``rate cpu distance ...`` (tab separated)."""
    _write_plain(samples, path, "\t", header=True)
    return path


def write_samples_csv(samples: DataFrame, path: str, sep: str = ",") -> str:
    _write_plain(samples, path, sep, header=False)
    return path


def _write_plain(samples: DataFrame, path: str, sep: str, header: bool) -> None:
    """Delimited text without quoting, values as they are, padded and empty ones too.

    A null text is the word ``null`` (which means the same to the miner).  The job fails for a null number, and for a text
    that holds the separator or a line end or begins or ends the line with white space: it could not be read back.
    """
    broken = "[" + "".join(f"\\x{ord(c):02x}" for c in sep) + "\\n\\r]"
    columns = []
    for f in samples.select(*schemas.SAMPLE_COLUMNS).schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            bad = F.raise_error(F.lit(f"a value of {f.name} holds the separator or a line end"))
            c = F.when(c.rlike(broken), bad.cast("string")).otherwise(F.coalesce(c, F.lit("null")))
        else:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"a value of {f.name} is null")).cast("string")).otherwise(c.cast("string"))
        columns.append(c.alias(f.name))
    (samples.select(*columns).write.mode("overwrite").option("sep", sep).option("header", header).option("quote", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_samples_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """Delimited flat samples, read strictly.

    A line is trimmed (characters up to U+0020 at its ends) and split at each separator; its values are taken as they are.
    A number that cannot be read, an empty one or a missing column fails the job, and the error names the file; columns beyond
    the tenth are ignored.  With ``header`` the lines that equal the header are left out.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^[\x00-\x20]+|[\x00-\x20]+$", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    if header:
        lines = lines.where(F.col("line") != sep.join(schemas.SAMPLE_COLUMNS))
    parts = lines.select(F.split("line", re.escape(sep), -1).alias("v"), "file")
    columns = []
    for i, f in enumerate(schemas.SAMPLE.fields):
        value = F.get("v", F.lit(i))
        if isinstance(f.dataType, T.StringType):
            good = value
        else:
            good = value.try_cast("double")
        wrong = F.concat(F.lit(f"bad value of {f.name} in "), F.col("file"), F.lit(": "), F.coalesce(value, F.lit("(no such column)")))
        columns.append(F.when(good.isNull(), F.raise_error(wrong).cast(f.dataType)).otherwise(good).alias(f.name))
    return parts.select(*columns)


# ---------------------------------------------------------------- app counts
def write_app_counts_tsv(counts: DataFrame, path: str) -> str:
    """Plain lines ``app<TAB>count``, names as they are; a name with a tab or line end fails the job."""
    app = F.coalesce("app", F.lit("null"))
    bad = F.raise_error(F.lit("an app name holds a tab or a line end")).cast("string")
    line = F.concat(F.when(app.rlike(r"[\t\n\r]"), bad).otherwise(app), F.lit("\t"), F.col("n").cast("string"))
    counts.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def read_app_counts_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``app<TAB>count``; the name is all before the last tab (it may be empty), a bad count fails the job."""
    line = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    n = F.substring_index("value", "\t", -1).try_cast("bigint")
    wrong = F.raise_error(F.concat(F.lit("bad line in "), F.col("file"), F.lit(": "), F.col("value")))
    app = F.regexp_extract("value", r"^([^\n]*)\t[^\t]*$", 1)
    return line.select(app.alias("app"), F.when(n.isNull() | ~F.contains("value", F.lit("\t")), wrong.cast("bigint")).otherwise(n).alias("n"))


def write_app_counts_json(counts: DataFrame, path: str) -> str:
    """``{app: n, ...}`` objects, one per partition of the counts."""
    per_part = counts.select("app", "n", F.spark_partition_id().alias("__p")).groupBy("__p").agg(
        F.map_from_entries(F.collect_list(F.struct("app", "n"))).alias("m"))
    per_part.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)
    return path


def read_app_counts_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Read ``{app: n}`` objects back as rows: one object per line, or one (possibly
    pretty-printed) object per file with ``whole_files=True``, which may be of any size."""
    if whole_files:
        return _read_json_object(spark, path)
    m = F.from_json(F.col("value"), "map<string,bigint>")
    return spark.read.text(path).select(F.explode(m).alias("app", "n"))


_ENTRY = re.compile(r'\s*\{?\s*("(?:[^"\\]|\\.)*")\s*:\s*(-?[0-9]+)\s*\}?\s*', re.DOTALL)


def _entries(text: str) -> list[tuple[str, int]]:
    """The entries of a run of text between two commas of an object."""
    out, at = [], 0
    while at < len(text):
        m = _ENTRY.match(text, at)
        if m is None or m.end() < len(text) and text[m.end()] != ",":
            if not text[at:].strip("{} \t\r\n"):
                break
            raise ValueError(f"no entry of an app count object: {text[at:at + 80]!r}")
        out.append((json.loads(m[1]), int(m[2])))
        at = m.end() + 1
    return out


def _read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """One object per file, cut by Spark at its commas, so that several tasks share a large one.

    A piece that is a whole entry stands for itself (inside a name its quotes would be escaped).  Pieces of names with
    commas are put together with their neighbours; a run at the end of a task's part goes on in the next part, so
    runs that touch an end (two per part at most) are collected per file and put together in order.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    workers_find_package(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, first, rows = None, [], True, []

        def leave() -> None:  # the run at an end of a part
            if run:
                rows.append((None, None, *part, 0 if first else 1, ",".join(run)))
                run.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            rows.clear()
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["app", "n", "file", "start", "at_end", "run"])

        for batch in batches:
            for value, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != part:
                    leave()
                    part, first = (file, start), True
                m = _ENTRY.fullmatch(value)
                if m is None:
                    run.append(value)
                    continue
                if first:
                    leave()
                    first = False
                elif run:
                    rows.extend((app, n, None, None, None, None) for app, n in _entries(",".join(run)))
                    run.clear()
                rows.append((json.loads(m[1]), int(m[2]), None, None, None, None))
            yield batch_of()
        leave()
        yield batch_of()

    found = pieces.mapInArrow(parse, "app string, n bigint, file string, start bigint, at_end int, run string")

    def glue(key: tuple, table: pa.Table) -> pa.Table:
        ordered = table.sort_by([("start", "ascending"), ("at_end", "ascending")])
        rows = _entries(",".join(ordered.column("run").to_pylist()))
        return pa.table({"app": pa.array([a for a, _ in rows], pa.string()), "n": pa.array([n for _, n in rows], pa.int64())})

    loose = found.where("run is not null").groupBy("file").applyInArrow(glue, "app string, n bigint")
    return found.where("run is null").select("app", "n").unionByName(loose)


# ---------------------------------------------------------------- rules document
def write_rules_json(lines: DataFrame, path: str) -> str:
    """Write the ordered lines of a rules document: its part files, one after the other by name, are the document."""
    lines.select("line").write.mode("overwrite").text(path)
    return path


RULES_DOC_SCHEMA = (
    "applicationName string, minSupport double, minConfidence double, FPGrowthRunTime bigint, "
    "executionTime bigint, bins map<string,array<double>>"
)
RULE_JSON_SCHEMA = "antecedents array<string>, consequents array<string>, confidence double"


def read_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """The rules document back as one row per rule with the envelope fields and ``position``, growing in order of the rules.

    Rules are read by many tasks; the envelope is one line, joined to them.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_name", F.monotonically_increasing_id().alias("id"))
    head = lines.where(F.startswith("value", F.lit('{"applicationName"'))).select(
        F.from_json(F.concat(F.regexp_replace("value", r',"rules":\[$', ""), F.lit("}")), RULES_DOC_SCHEMA).alias("d"))
    rules = lines.where(F.col("value").rlike(r'^,?\{"antecedents"')).select(
        F.from_json(F.regexp_replace("value", "^,", ""), RULE_JSON_SCHEMA).alias("rule"), F.struct("file_name", "id").alias("position"))
    # The head is one row.
    return rules.join(F.broadcast(head)).select("d.applicationName", "d.minSupport", "d.minConfidence", "rule", "position")
