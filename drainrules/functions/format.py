"""Number formatting of the rule browser, as built-in Column expressions.

``to_precision2`` follows JavaScript ``Number.prototype.toPrecision(2)``:
exponent ``e`` of the value rounded to two significant digits; exponential
form ``d.de+E`` when ``e < -6`` or ``e >= 2``, else fixed with ``1 - e``
decimals.  Rounding is half-up on the shortest decimal form of the double
(``java.util.Formatter``); JavaScript rounds the exact binary value, so the
two can differ only when that decimal form ends in a 5 right at the cut.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_precision2(x: Column) -> Column:
    sci = F.format_string("%.1e", x)
    exp = F.split(sci, "e").getItem(1).cast("int")
    mantissa = F.split(sci, "e").getItem(0)
    expo_form = F.concat(mantissa, F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                         F.abs(exp).cast("string"))
    fixed = None
    for e in range(-6, 2):  # 1 - e decimals: 7 .. 0
        branch = F.format_string(f"%.{1 - e}f", x)
        fixed = F.when(exp == e, branch) if fixed is None else fixed.when(exp == e, branch)
    body = fixed.otherwise(expo_form)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("NaN"))
            .when(x == F.lit(float("inf")), F.lit("Infinity"))
            .when(x == F.lit(float("-inf")), F.lit("-Infinity"))
            .when(x == 0, F.lit("0.0"))
            .otherwise(body))


def js_number(x: Column) -> Column:
    """JavaScript default number text for integral values (``5``, ``-99``, ``100``)."""
    return F.when(x == 0, F.lit("0")).otherwise(x.cast("bigint").cast("string"))


def is_fractional(x: Column) -> Column:
    """JavaScript ``x % 1 !== 0`` (NaN counts as fractional, null too)."""
    return x.isNull() | F.isnan(x) | (x != F.floor(x))
