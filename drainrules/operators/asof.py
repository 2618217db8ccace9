"""As-of join within a key, with hot keys cut into slices of time.

For every left row: the last right row of the same key that sorts before it
(order given by a struct per side).  ``split_points`` finds the hot keys, those of
more than ``SLICE_ROWS`` rows on both sides together, by one aggregate over key and
time alone, and cuts each of them, and only them, at quantiles of its own times, so
that a burst is split where it is dense and nobody else's plan changes.

Without hot keys the rows are windowed per key: one shuffle, and none where both
sides are stored bucketed by the key.  With hot keys, in one plan for all keys:

1. left and right rows are unioned and each ``(key, slice)`` is scanned in order
   with ``last(right, ignorenulls)`` (a key that is not hot is one slice);
2. the row that ends a slice of a hot key holds the slice's last right row; a
   window over these rows (one per slice) carries it into later slices;
3. left rows without a match in their own slice take the carried one (a join
   with the broadcast slices: at most two per ``SLICE_ROWS`` rows).

A number as ``bucket_width`` cuts all keys at its multiples instead.  Slices change
only the split, never the result: rows whose time is null or NaN stand in no
order, so they match nothing and nothing matches them.

``previous_row`` is the self-join case (each row's predecessor in its key):
``lag`` inside each slice instead of a union, with the same carried rows.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drainrules.session import materialize

SLICE_ROWS = 2_000_000
MAX_SLICES = 4096  # of one key
HOT_KEYS = 100_000  # hot keys the driver receives; with more of them slices get larger
SKETCH = 8192

_LOG = logging.getLogger(__name__)


def has_time(time: str) -> Column:
    """Whether a row has a place in the order of time."""
    t = F.col(time).cast("double")
    return t.isNotNull() & ~F.isnan(t)


def split_points(sides: list[tuple[DataFrame, str, str]], slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """``(__k, __at)``: for each hot key the ascending times at which it is cut; None where no key is hot.

    ``sides`` are tables with the names of their key and time.
    """
    rows = None
    for df, key, time in sides:
        side = df.where(F.col(key).isNotNull() & has_time(time)).select(F.col(key).alias("__k"), F.col(time).cast("double").alias("__t"))
        rows = side if rows is None else rows.unionByName(side)
    counts = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("n"))
    while True:
        hot = counts.where(F.col("n") > slice_rows).limit(HOT_KEYS + 1).collect()
        if len(hot) <= HOT_KEYS:
            break
        slice_rows *= 4
    if not hot:
        return None
    parts = {r["__k"]: min(MAX_SLICES, 1 << math.ceil(math.log2(r["n"] / slice_rows))) for r in hot}
    most = max(parts.values())
    spark = sides[0][0].sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(parts.items()), rows.select("__k", F.lit(0).alias("__parts")).schema))
    ranks = F.array(*[F.lit(i / most) for i in range(1, most)])
    found = (
        rows.join(wanted, "__k").groupBy("__k", "__parts").agg(F.kll_sketch_agg_double("__t", SKETCH).alias("__s"))
        .select("__k", "__parts", F.kll_sketch_get_quantile_double("__s", ranks).alias("__all"))
        .select("__k", "__parts", F.array_distinct(F.filter("__all", lambda x, i: (i + 1) % (F.lit(most) / F.col("__parts")) == 0)).alias("__at"))
    )
    found = materialize(found, "split-points")
    same = found.where(F.size("__at") < F.col("__parts") - 1).count()
    if same:
        _LOG.warning("%d hot keys hold many rows that share one time: such rows stay in one task", same)
    return found.select("__k", "__at")


def _sliced(df: DataFrame, cut: float | DataFrame | None) -> DataFrame:
    """Rows with ``__k`` and ``__t`` get their slice ``__b``, and ``__hot`` (whether their key has several)."""
    if cut is None:
        return df.withColumns({"__b": F.lit(0).cast("long"), "__hot": F.lit(False)})
    if isinstance(cut, DataFrame):
        at = F.size(F.filter("__at", lambda x: x < F.col("__t"))).cast("long")
        return df.join(F.broadcast(cut), "__k", "left").withColumns(
            {"__b": F.when(F.col("__at").isNull(), F.lit(0).cast("long")).otherwise(at), "__hot": F.col("__at").isNotNull()}).drop("__at")
    return df.withColumns({"__b": F.floor(F.col("__t") / F.lit(float(cut))), "__hot": F.lit(True)})


def _cut(bucket_width: float | str, sides: list[tuple[DataFrame, str, str]], slice_rows: int) -> float | DataFrame | None:
    return split_points(sides, slice_rows) if bucket_width == "auto" else float(bucket_width)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
              left_order: list[Column], right_order: list[Column], *, bucket_width: float | str,
              match_name: str = "match", right_key: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Return ``left`` plus a struct column ``match_name`` (all right columns or null).

    ``left_order`` / ``right_order`` are the sort keys of the two sides in one
    common order (same number and types of fields); a right row matches a
    left row when it sorts strictly before it.  Put a side tag in the keys to
    decide ties: e.g. ``(time, 0)`` for right and ``(time, 1)`` for left
    matches right rows at an equal time.  Left rows with a null key or a null
    or NaN time are kept with a null match; such right rows match nothing.
    """
    if len(left_order) != len(right_order):
        raise ValueError("left_order and right_order must have the same fields")
    rkey = right_key or key
    cut = _cut(bucket_width, [(left, key, left_time), (right, rkey, right_time)], slice_rows)
    lcols = left.columns
    rcols = right.columns
    placed = F.col(key).isNotNull() & has_time(left_time)
    rtype = right.select(F.struct(*rcols).alias("s")).schema["s"].dataType
    names = [f"o{i}" for i in range(len(left_order))]
    lside = left.where(placed).select(
        F.col(key).alias("__k"),
        F.col(left_time).cast("double").alias("__t"),
        F.struct(*[c.alias(n) for c, n in zip(left_order, names)]).alias("__o"),
        F.struct(*[F.col(c) for c in lcols]).alias("__l"),
        F.lit(None).cast(rtype).alias("__r"),
    )
    rside = right.where(F.col(rkey).isNotNull() & has_time(right_time)).select(
        F.col(rkey).alias("__k"),
        F.col(right_time).cast("double").alias("__t"),
        F.struct(*[c.alias(n) for c, n in zip(right_order, names)]).alias("__o"),
        F.lit(None).cast(lside.schema["__l"].dataType).alias("__l"),
        F.struct(*[F.col(c) for c in rcols]).alias("__r"),
    )
    in_slice = Window.partitionBy("__k" if cut is None else ["__k", "__b"]).orderBy("__o")
    upto = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last("__r", ignorenulls=True).over(upto)
    both = lside.unionByName(rside)
    if cut is None:
        out = both.select("__l", found.alias("__m")).where(F.col("__l").isNotNull()).select(
            *[F.col("__l").getField(c).alias(c) for c in lcols], F.col("__m").alias(match_name))
    else:
        win = _sliced(both, cut).select("__k", "__b", "__hot", "__l", found.alias("__m"), F.lead(F.lit(True)).over(in_slice).isNull().alias("__ends"))
        out = _with_carried(win.where(F.col("__l").isNotNull()), win, cut, F.struct("__l", "__m"), "__m").select(
            *[F.col("__l").getField(c).alias(c) for c in lcols], F.coalesce(F.col("__m"), F.col("__carry")).alias(match_name))
    return out.unionByName(left.where(~F.coalesce(placed, F.lit(False))).withColumn(match_name, F.lit(None).cast(rtype)))


def _with_carried(rows: DataFrame, win: DataFrame, cut: float | DataFrame, row: Column, field: str) -> DataFrame:
    """``rows`` with ``__carry``: ``field`` of the last row that ends an earlier slice of the key and has one.

    ``row`` names all columns of the slices, so that both uses of ``win`` read one shuffle.
    """
    w_key = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = win.where(F.col("__ends") & F.col("__hot")).select("__k", "__b", row.alias("__row"))
    carry = F.last(F.when(F.col("__row").getField(field).isNotNull(), F.col("__row")), ignorenulls=True).over(w_key)
    carried = ends.select("__k", "__b", carry.alias("__c")).select("__k", "__b", F.col("__c").getField(field).alias("__carry"))
    # Slices of hot keys are few; at a fixed width every key has them, and the rows lie by (key, slice) already.
    return rows.join(F.broadcast(carried) if isinstance(cut, DataFrame) else carried, ["__k", "__b"], "left")


def previous_row(df: DataFrame, key: str, time: str, order: list[Column], *, bucket_width: float | str,
                 name: str = "prev", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows of ``df`` with a key and a time, plus a struct ``name``: the previous row of the same key in ``order``.

    The self-join special case of ``asof_join``: ``lag`` within each slice; the
    first row of a slice takes the row that ends the nearest earlier slice of its
    key.  ``order`` must start with the time column so that slices follow the order.
    """
    cut = _cut(bucket_width, [(df, key, time)], slice_rows)
    cols = df.columns
    keyed = df.where(F.col(key).isNotNull() & has_time(time)).select(
        F.struct(*cols).alias("__row"), F.col(key).alias("__k"), F.col(time).cast("double").alias("__t"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("__o"))
    in_slice = Window.partitionBy("__k" if cut is None else ["__k", "__b"]).orderBy("__o")
    before = F.lag("__row").over(in_slice)
    if cut is None:
        return keyed.select("__row", before.alias(name)).select(*[F.col("__row").getField(c).alias(c) for c in cols], name)
    win = _sliced(keyed, cut).select("__row", "__k", "__b", "__hot", before.alias("__m"), F.lead(F.lit(True)).over(in_slice).isNull().alias("__ends"))
    out = _with_carried(win, win, cut, F.struct("__row"), "__row")
    return out.select(*[F.col("__row").getField(c).alias(c) for c in cols], F.coalesce(F.col("__m"), F.col("__carry")).alias(name))
