"""Batch preparation: raw readings -> pairs (stored) -> rates with registration.

As in the original service, pairs are a stored intermediate where the as-of
join for registrations follows; without registrations they are read once and
only their needed columns are computed.
The table goes to the shared checkpoint folder (or ``pairs_path``).

``build_rates_by_device`` keeps all three tables bucketed by device: once readings and
registrations lie so, pairing and as-of read co-located rows and exchange none (hot devices aside).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from drainrules.operators import prepare as prep
from drainrules import schemas
from drainrules.session import materialize, scratch_path
from drainrules.sources import io


def build_pairs(readings: DataFrame, *, bucket_width: float | str = prep.DEFAULT_BUCKET_WIDTH,
                pairs_path: str | None = None) -> DataFrame:
    """Android readings paired with their predecessor, written once and read back."""
    pairs = prep.pair_readings(prep.filter_android(readings), bucket_width=bucket_width)
    if pairs_path is None:
        return materialize(pairs, "pairs")
    io.write_parquet(pairs, pairs_path)
    return io.read_pairs(readings.sparkSession, pairs_path)


def build_rates(readings: DataFrame, registrations: DataFrame | None = None, *,
                bucket_width: float | str = prep.DEFAULT_BUCKET_WIDTH, pairs_path: str | None = None) -> DataFrame:
    """Rates (schema RATE) from raw readings and optional registrations."""
    if registrations is None and pairs_path is None:  # read once: nothing to store
        pairs = prep.pair_readings(prep.filter_android(readings), bucket_width=bucket_width)
    else:
        pairs = build_pairs(readings, bucket_width=bucket_width, pairs_path=pairs_path)
    return prep.rates_from_pairs(pairs, registrations, bucket_width=bucket_width)


def store_readings(readings: DataFrame, path: str, buckets: int = io.DEVICE_BUCKETS) -> DataFrame:
    return io.write_by_device(readings.select(*schemas.READING.names), path, ["uuid", "time", "reading_id"], buckets=buckets)


def store_registrations(registrations: DataFrame, path: str, buckets: int = io.DEVICE_BUCKETS) -> DataFrame:
    return io.write_by_device(registrations.select(*schemas.REGISTRATION.names), path, ["uuid", "reg_time", "os"], buckets=buckets)


def build_rates_by_device(readings: DataFrame, registrations: DataFrame, buckets: int = io.DEVICE_BUCKETS, pairs_path: str | None = None) -> DataFrame:
    """Rates from readings and registrations that are stored by device with the same number of buckets."""
    pairs = prep.pair_readings(prep.filter_android(readings))
    path = pairs_path or scratch_path(readings.sparkSession, "pairs-by-device")
    stored = io.write_by_device(pairs, path, ["uuid"], buckets=buckets)
    return prep.rates_from_pairs(stored, registrations)
