"""The domain tables as DuckDB SQL, for the oracle side of each query.

Each view mirrors the Spark adapter of the same name in
``ratewise.sources.domain``.  ``with_views(body, names)`` prefixes a query
body with the CTEs it needs (dependencies first).
"""

from __future__ import annotations

from ratewise.functions.mathx import rnd_sql
from ratewise.sources.fixed import TENANT_ID, fixed_table_sql

T = TENANT_ID

_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "categories": (fixed_table_sql("categories"), ()),
    "rate_bands": (fixed_table_sql("rate_bands"), ()),
    "status_config": (fixed_table_sql("status_config"), ()),
    "signal_weights_default": (fixed_table_sql("signal_weights_default"), ()),
    "event_city": (fixed_table_sql("event_city"), ()),
    "fixed_holidays": (fixed_table_sql("fixed_holidays"), ()),
    "branches": (f"""
        SELECT {T} AS tenant_id, n_nationkey AS branch_id,
               CASE WHEN n_nationkey % 2 = 0
                    THEN '{{"en":"' || n_name || '","ar":"فرع ' || n_name || '"}}'
                    ELSE n_name END AS branch_name,
               r_regionkey AS city_id, r_name AS city_name,
               n_nationkey % 2 = 0 AS is_airport, TRUE AS is_active
        FROM nation JOIN region ON n_regionkey = r_regionkey""", ()),
    "vehicles": (f"""
        SELECT {T} AS tenant_id, p_partkey AS vehicle_id,
               TRY_CAST(substr(p_brand, 7) AS INTEGER) AS model_id, c.category_id,
               CAST(p_partkey % 25 AS INTEGER) AS branch_id,
               CAST(140 + p_size % 17 AS INTEGER) AS status_id,
               p_size = 50 AS is_deleted
        FROM part JOIN categories c ON part.p_type = c.p_type""", ("categories",)),
    "contracts": (f"""
        SELECT l_orderkey * 10 + l_linenumber AS contract_id, {T} AS tenant_id,
               s_nationkey AS branch_id, l_partkey AS vehicle_id,
               CAST(l_shipdate AS DATE) AS start_date,
               CAST(CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS DATE) AS end_date,
               l_extendedprice / l_quantity AS daily_rate,
               l_returnflag AS contract_type,
               CASE WHEN l_linestatus = 'F' THEN 211 ELSE 210 END AS status_id
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""", ()),
    "rates": (f"""
        SELECT p_partkey AS rate_id, {T} AS tenant_id,
               TRY_CAST(substr(p_brand, 7) AS INTEGER) AS model_id, c.category_id,
               CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 25 AS INTEGER) END AS branch_id,
               make_date(CAST(1994 + p_size % 6 AS INTEGER), CAST(1 + p_size % 12 AS INTEGER), 1) AS start_date,
               CASE WHEN p_size <= 25 THEN make_date(CAST(1999 + p_size % 3 AS INTEGER), 12, 31) END AS end_date,
               TRUE AS is_active,
               p_retailprice / 10 AS base_rate
        FROM part JOIN categories c ON part.p_type = c.p_type""", ("categories",)),
    "rate_details": ("""
        SELECT rate_id, period_id, {rate} AS rate
        FROM rates CROSS JOIN rate_bands""".format(rate=rnd_sql("base_rate * multiplier", 2)), ("rates", "rate_bands")),
    "weather": (f"""
        SELECT {T} AS tenant_id, g.branch_id, b.city_name, g.weather_date,
               20.0 + (_tp % 2600) / 100.0 AS t_max,
               20.0 + (_tp % 2600) / 100.0 - 12.0 AS t_min,
               20.0 + (_tp % 2600) / 100.0 - 6.0 AS t_mean,
               CASE WHEN _mx % 5000 < 2500 THEN 0.0 ELSE (_mx % 5000 - 2500) / 100.0 END AS precipitation_sum,
               (_sk % 700) / 10.0 AS wind_max,
               CAST(_mn % 100 AS INTEGER) AS weather_code
        FROM (SELECT c_nationkey AS branch_id, CAST(o_orderdate AS DATE) AS weather_date,
                     sum(CAST(floor(o_totalprice) AS BIGINT)) AS _tp, max(o_orderkey) AS _mx,
                     sum(o_orderkey) AS _sk, min(o_orderkey) AS _mn
              FROM orders JOIN customer ON o_custkey = c_custkey
              GROUP BY 1, 2) g
        JOIN branches b ON g.branch_id = b.branch_id""", ("branches",)),
    "contract_years": ("""
        SELECT CAST(y AS INTEGER) AS year
        FROM (SELECT unnest(range(year(min(start_date)), year(max(start_date)) + 1)) AS y FROM contracts)""",
                       ("contracts",)),
    "holidays": (f"""
        SELECT {T} AS tenant_id, make_date(year, h_month, h_day) AS holiday_date, holiday_name,
               CAST(NULL AS VARCHAR) AS holiday_name_ar, holiday_type, TRUE AS is_public_holiday
        FROM contract_years CROSS JOIN fixed_holidays""", ("contract_years", "fixed_holidays")),
    "event_signal": (f"""
        SELECT {T} AS tenant_id, event_date, city_name, count(*) AS event_volume,
               round(ln(1 + count(*)), 4) AS event_score
        FROM (SELECT CAST(CAST(ts AS DATE) - INTERVAL 288 MONTH AS DATE) AS event_date, ec.city_name
              FROM events JOIN event_city ec ON events.event_type = ec.event_type)
        GROUP BY event_date, city_name""", ("event_city",)),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in _VIEWS[n][1]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (and what they need)."""
    ctes = [f"{n} AS ({_VIEWS[n][0]})" for n in _order(names)]
    body = body.strip()
    if body[:4].upper() == "WITH":
        body = body[4:].strip()
        return "WITH " + ",\n".join(ctes + [body])
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def register_view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    """Add a derived view that several oracle queries share."""
    _VIEWS[name] = (sql, deps)
