"""Session helpers: a local session for tests/bench and the shared scratch folder.

On a cluster the session is created by the caller; the library only reads
``spark.checkpoint.dir`` from it.  A folder of our own is set only when that
setting is absent (local runs and tests), never on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_SCRATCH: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "drainrules") -> SparkSession:
    """Session for tests and the benchmark (``local[N]``, UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _session_checkpoint_dir(spark: SparkSession) -> str | None:
    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext handle (e.g. Spark Connect)
        sc = None
    if sc is not None:
        try:
            found = sc.getCheckpointDir()
        except Exception:  # pragma: no cover - older PySpark
            found = None
        if found:
            return found
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    return sc.getConf().get("spark.checkpoint.dir", None) if sc is not None else None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster's ``spark.checkpoint.dir`` wins.  Only when it is unset (local
    mode, tests) a fresh folder under the system temp directory is created.
    """
    global _LOCAL_SCRATCH
    found = _session_checkpoint_dir(spark)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must be set on a cluster (a shared folder)")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="drainrules-ckpt-")
    spark.sparkContext.setCheckpointDir(_LOCAL_SCRATCH)
    return _session_checkpoint_dir(spark) or _LOCAL_SCRATCH


def workers_find_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it (as ``spark.executorEnv.PYTHONPATH`` would say)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex}")


#: Rows of a few numbers in one file of a small table.
FILE_ROWS = 1 << 14


def few_files(df, rows: int):
    """``df`` of about ``rows`` narrow rows in no more partitions than it fills.

    Small tables are dealt over all shuffle partitions where Spark does not merge these by itself.  Each
    file costs a task and, on a local file system, processes that set its mode.  The number of
    partitions only ever falls, so large tables stay as they are.
    """
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the plan only once (a
    reliable RDD checkpoint of an unpersisted plan recomputes it to write).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
