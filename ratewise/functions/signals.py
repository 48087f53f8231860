"""Signal scoring and price arithmetic as Column expressions (SIG-*, PRC-01,
PRC-06).  Piecewise functions are ``when`` chains: no Python UDF, so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewise.functions.mathx import money, rnd

NEUTRAL = 0.5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utilization_signal(contracts_util, bookings_util=None) -> Column:
    """SIG-U: u = contracts + bookings (NULL bookings = 0); >= .9 -> 1;
    >= .7 -> .5 + (u - .7) * 2.5; >= .5 -> .3 + (u - .5); else .6u.
    Missing contracts utilization -> .5."""
    cu = _c(contracts_util)
    u = cu + (F.coalesce(_c(bookings_util), F.lit(0.0)) if bookings_util is not None else F.lit(0.0))
    return (F.when(cu.isNull(), F.lit(NEUTRAL))
            .when(u >= 0.9, F.lit(1.0))
            .when(u >= 0.7, 0.5 + (u - 0.7) * 2.5)
            .when(u >= 0.5, 0.3 + (u - 0.5))
            .otherwise(u * 0.6))


def forecast_signal(forecast, mean_demand) -> Column:
    """SIG-F: r = forecast / mean TRAIN demand; >= 1.5 -> 1; >= 1 ->
    .5 + (r - 1); >= .5 -> r - .5; else 0.  No forecast, no mean or mean
    0 -> .5."""
    f, m = _c(forecast), _c(mean_demand)
    r = f / m
    return (F.when(f.isNull() | m.isNull() | (m == 0), F.lit(NEUTRAL))
            .when(r >= 1.5, F.lit(1.0))
            .when(r >= 1.0, 0.5 + (r - 1.0))
            .when(r >= 0.5, r - 0.5)
            .otherwise(F.lit(0.0)))


def competitor_signal(our_price, competitor_avg) -> Column:
    """SIG-C: r = ours / competitor average; r < .8 -> min(1, .7 + (.8 - r)
    * 1.5); r <= 1.2 -> .4 + (1.2 - r) * .5; else max(0, .3 - (r - 1.2) * .5).
    Missing or zero average -> .5."""
    o, a = _c(our_price), _c(competitor_avg)
    r = o / a
    return (F.when(a.isNull() | (a == 0), F.lit(NEUTRAL))
            .when(r < 0.8, F.least(F.lit(1.0), 0.7 + (0.8 - r) * 1.5))
            .when(r <= 1.2, 0.4 + (1.2 - r) * 0.5)
            .otherwise(F.greatest(F.lit(0.0), 0.3 - (r - 1.2) * 0.5)))


def bad_weather_score(rain, wind, code) -> Column:
    """SIG-W1: rain + wind + weather-code points, capped at 1, 2 dp."""
    rain, wind, code = _c(rain), _c(wind), _c(code)
    r = (F.when(rain > 20, 0.4).when(rain > 10, 0.3).when(rain > 5, 0.2)
         .when(rain > 0, 0.1).otherwise(0.0))
    w = F.when(wind > 50, 0.3).when(wind > 30, 0.2).when(wind > 20, 0.1).otherwise(0.0)
    c = F.when(code >= 95, 0.3).when(code >= 61, 0.2).when(code >= 45, 0.1).otherwise(0.0)
    return rnd(F.least(r + w + c, F.lit(1.0)), 2)


def extreme_heat(t_max, threshold: float = 43.0) -> Column:
    """SIG-W2: 1 when the daily maximum exceeds 43 C."""
    return F.when(_c(t_max) > threshold, 1).otherwise(0)


def weather_signal(bad_score, heat_flag, rain, present=None) -> Column:
    """SIG-W: bad >= .7 or heat -> .3; bad >= .4 or rain > 10 -> .4;
    bad <= .1 -> .6; else .5.  No weather row -> .5."""
    b = F.coalesce(_c(bad_score), F.lit(0.0))
    h = F.coalesce(_c(heat_flag), F.lit(0)) == 1
    p = F.coalesce(_c(rain), F.lit(0.0))
    sig = (F.when((b >= 0.7) | h, F.lit(0.3))
           .when((b >= 0.4) | (p > 10), F.lit(0.4))
           .when(b <= 0.1, F.lit(0.6))
           .otherwise(F.lit(NEUTRAL)))
    if present is None:
        return sig
    return F.when(_c(present), sig).otherwise(F.lit(NEUTRAL))


def holiday_signal(is_holiday, days_to_holiday, is_school_holiday, is_weekend) -> Column:
    """SIG-H with a calendar row: holiday .9; next holiday within 1..3 days
    .75; school holiday .7; weekend .6; else .5."""
    dth = _c(days_to_holiday)
    return (F.when(F.coalesce(_c(is_holiday), F.lit(False)), F.lit(0.9))
            .when(dth.isNotNull() & (dth >= 1) & (dth <= 3), F.lit(0.75))
            .when(F.coalesce(_c(is_school_holiday), F.lit(False)), F.lit(0.7))
            .when(F.coalesce(_c(is_weekend), F.lit(False)), F.lit(0.6))
            .otherwise(F.lit(NEUTRAL)))


def holiday_signal_without_calendar(is_weekend, calendar_missing_mode: str = "no_row") -> Column:
    """SIG-H fallbacks: no calendar row -> weekend .7 else .5; no calendar
    table at all -> weekend .65 else .5."""
    hi = 0.7 if calendar_missing_mode == "no_row" else 0.65
    return F.when(_c(is_weekend), F.lit(hi)).otherwise(F.lit(NEUTRAL))


def weighted_adjustment(signals: dict[str, Column], weights: dict[str, Column]) -> Column:
    """SIG-A: s = sum(w * signal); s >= .5 -> (s - .5) * 80, else
    (s - .5) * 60; percent, 4 dp."""
    s = None
    for name, sig in signals.items():
        term = _c(sig) * _c(weights[name])
        s = term if s is None else s + term
    adj = F.when(s >= 0.5, (s - 0.5) * 80.0).otherwise((s - 0.5) * 60.0)
    return rnd(adj, 4)


def clamp_price(base, raw_pct, min_price, max_discount, max_premium, max_price=None) -> dict[str, Column]:
    """PRC-01 guardrail clamp.

    pct capped to +max_premium and floored to -max_discount; price =
    base * (1 + pct / 100); below min_price the price becomes min_price
    and pct = (min / base - 1) * 100; above max_price, where there is one,
    likewise.  Price 2 dp, pct 4 dp, both half up.
    """
    base, raw = _c(base), _c(raw_pct)
    mp, md, mx = _c(min_price), _c(max_discount), _c(max_premium)
    capped = F.when(raw > mx, mx).when(raw < -md, -md).otherwise(raw)
    price0 = base * (1 + capped / 100.0)
    below = price0 < mp
    top = F.lit(None).cast("double") if max_price is None else _c(max_price)
    above = F.coalesce(price0 > top, F.lit(False))
    bound = F.when(below, mp).when(above, top)
    price = F.coalesce(bound, price0)
    pct = F.when(bound.isNotNull(), (bound / base - 1) * 100.0).otherwise(capped)
    applied = (raw > mx) | (raw < -md) | below | above
    return {"price": money(price, 2), "pct": money(pct, 4), "applied": applied}


#: Column types of money while it is computed, of a percentage, and of a price.
BASE, PERCENT, PRICE = "decimal(18,4)", "decimal(8,4)", "decimal(10,2)"


def clamp_price_decimal(base, raw_pct, min_price, max_discount, max_premium) -> dict[str, Column]:
    """PRC-01 in decimals from end to end: exact but for the two roundings, both
    half up, so a result never depends on how a double is written in binary.

    Inputs are cast to ``BASE`` and ``PERCENT``; the price has the type
    ``PRICE``, the percentage ``PERCENT``; what these cannot hold is NULL.  A
    price raised from a base of 0 has no percentage."""
    base, raw, low = _c(base).cast(BASE), _c(raw_pct).cast(PERCENT), _c(min_price).cast(PRICE)
    down, up = _c(max_discount).cast(PERCENT), _c(max_premium).cast(PERCENT)
    capped = F.when(raw > up, up).when(raw < -down, -down).otherwise(raw).cast(PERCENT)
    hundred = F.lit(100).cast("decimal(3,0)")
    free = base * (hundred + capped)  # the price in hundredths, exactly
    below = free < low * hundred
    price = F.when(below, low).otherwise(F.round(free * F.lit(0.01).cast("decimal(3,2)"), 2).try_cast(PRICE))
    raised = F.round((F.try_divide(low, base) - F.lit(1).cast("decimal(1,0)")) * hundred, 4).try_cast(PERCENT)
    return {"price": price, "pct": F.when(below, raised).otherwise(capped), "applied": (raw > up) | (raw < -down) | below}


def explanation(util, fcst, comp, weather, holiday, raw_pct, final_pct, applied) -> Column:
    """PRC-06: factor phrases in fixed order joined by '. '; 'Normal
    conditions' when none; a guardrail suffix with 1-dp percentages."""
    u, f, c, w, h = (_c(x) for x in (util, fcst, comp, weather, holiday))
    parts = [
        F.when(u >= 0.7, F.lit("High utilization (+)")).when(u <= 0.3, F.lit("Low utilization (-)")),
        F.when(f >= 0.7, F.lit("High forecast demand (+)")).when(f <= 0.3, F.lit("Low forecast demand (-)")),
        F.when(c >= 0.7, F.lit("Competitors priced higher (+)")).when(c <= 0.3, F.lit("Competitors priced lower (-)")),
        F.when(w <= 0.3, F.lit("Bad weather expected (-)")).when(w >= 0.7, F.lit("Good weather expected (+)")),
        F.when(h >= 0.7, F.lit("Holiday/weekend period (+)")),
    ]
    factors = F.concat_ws(". ", *parts)
    text = F.when(factors == "", F.lit("Normal conditions")).otherwise(factors)
    suffix = F.format_string(". Adjusted within guardrails (raw: %.1f%% -> final: %.1f%%)",
                             rnd(raw_pct, 1), rnd(final_pct, 1))
    return F.when(_c(applied), F.concat(text, suffix)).otherwise(text)


def weights_valid(total) -> Column:
    """SIG-V: weights sum to 1 within .01."""
    return F.abs(_c(total) - 1.0) < 0.01
