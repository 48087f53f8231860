"""Numeric helpers (MTH-01, MTH-02, NUL-01, CST-01)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, digits: int) -> Column:
    """Round half away from zero to ``digits`` decimals, on doubles.

    Scaled rounding gives the same result in every engine for the same
    input double (the rounding of a decimal string can differ on ties).
    """
    m = float(10 ** digits)
    return F.round(_c(c).cast("double") * m) / m


def rnd_sql(expr: str, digits: int) -> str:
    """SQL text of :func:`rnd` for the DuckDB oracle."""
    return f"(round(CAST({expr} AS DOUBLE) * {float(10 ** digits)}) / {float(10 ** digits)})"


#: Decimals that money is held in while it is computed: beyond, a double's
#: digits are noise of its binary form.
MONEY = "decimal(28,10)"


def money(c, digits: int = 2) -> Column:
    """Half up to ``digits`` decimals as decimal arithmetic rounds (1.005 is
    1.01, and so is a computed 1.00499999999999989); NULL where not finite."""
    return F.round(_c(c).cast("double").try_cast(MONEY), digits).cast("double")


def money_sql(expr: str, digits: int = 2) -> str:
    """SQL text of :func:`money`."""
    return f"CAST(round(TRY_CAST(CAST({expr} AS DOUBLE) AS {MONEY}), {digits}) AS DOUBLE)"


def safe_div(num, den, default=None) -> Column:
    """MTH-02: ``num / den``; NULL (or ``default``) when ``den`` is 0/NULL."""
    q = F.try_divide(_c(num).cast("double"), F.nullif(_c(den).cast("double"), F.lit(0.0)))
    return q if default is None else F.coalesce(q, F.lit(default))


def cents_avg(c) -> Column:
    """Exact mean of 2-dp money values: integer cents summed, then one
    division (no dependence on summation order)."""
    c = _c(c)
    cents = F.round(c * 100.0).cast("long")
    return F.sum(cents) / F.count(c) / 100.0


def cents_avg_sql(expr: str) -> str:
    """SQL text of :func:`cents_avg`."""
    return f"(sum(CAST(round(({expr}) * 100.0) AS BIGINT)) / count({expr}) / 100.0)"
