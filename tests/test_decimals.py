"""The clamp in decimals against Python's decimals, ties included."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewise.functions import signals as sg

_N = lambda lo, hi, places: st.integers(lo * 10**places, hi * 10**places).map(lambda n: Decimal(n).scaleb(-places))
_ROW = st.tuples(_N(0, 20_000, 4), _N(-99, 200, 4), _N(0, 500, 2), _N(0, 60, 4), _N(0, 90, 4))
TIES = [tuple(map(Decimal, r)) for r in (("100.0050", "0", "0", "25", "50"), ("1.0050", "0", "0", "25", "50"), ("200.0000", "0.0025", "0", "25", "50"),
                                         ("3.0000", "-90", "1.00", "25", "50"), ("0.0000", "10", "5.00", "25", "50"), ("64.0000", "0", "64.00", "25", "50"))]


def brute(base, raw, low, down, up):
    pct, applied = raw, False
    if raw > up:
        pct, applied = up, True
    if raw < -down:
        pct, applied = -down, True
    price = base * (1 + pct / 100)
    if price < low:
        price, applied = low, True
        pct = (price / base - 1) * 100 if base else None
    q = lambda x, to: None if x is None else x.quantize(Decimal(to), rounding=ROUND_HALF_UP)
    pct = q(pct, "0.0001")
    return q(price, "0.01"), None if pct is None or abs(pct) >= 10_000 else pct, applied  # the type holds no more


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(_ROW, min_size=1, max_size=40))
def test_clamp_in_decimals(spark, rows):
    rows = rows + TIES
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b decimal(18,4), r decimal(8,4), l decimal(10,2), d decimal(8,4), u decimal(8,4)")
    c = sg.clamp_price_decimal("b", "r", "l", "d", "u")
    out = df.select("i", c["price"].alias("price"), c["pct"].alias("pct"), c["applied"].alias("applied"))
    assert dict(out.dtypes) == {"i": "int", "price": sg.PRICE, "pct": sg.PERCENT, "applied": "boolean"}
    assert [tuple(r)[1:] for r in sorted(out.collect())] == [brute(*r) for r in rows]


def test_sums_do_not_depend_on_order(spark):
    df = spark.range(5000).select(((F.col("id") * 7919 % 100_003).cast("double") / 100).alias("x")).select(F.col("x").cast(sg.BASE).alias("x"))
    sums = {df.repartition(n).agg(F.sum("x"), F.avg("x")).first() for n in (1, 3, 7)}
    assert len(sums) == 1
