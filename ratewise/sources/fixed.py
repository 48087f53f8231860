"""Small fixed tables: configuration constants of the pricing domain.

Every table here is a literal of a few rows, independent of data size,
so joins against them are always broadcast.  Spark and the SQL oracle
both build their copies from these same Python lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TENANT_ID = 1

# --- fixed values: pricing defaults per category -------------------------
# (category_id, source p_type, name, min_price, max_discount_pct,
#  max_premium_pct, default_daily_rate).  Guardrail and base-rate defaults
# per category class (Economy, Compact, Standard, SUV, Luxury, Van) with
# the generic fallbacks 50 / 25 / 50 and 150.
CATEGORIES = [
    (1, "ECONOMY", "Economy", 50.0, 25.0, 40.0, 99.0),
    (2, "SMALL", "Compact", 70.0, 25.0, 45.0, 120.0),
    (3, "STANDARD", "Standard", 100.0, 25.0, 50.0, 150.0),
    (4, "MEDIUM", "SUV", 150.0, 20.0, 50.0, 220.0),
    (5, "LARGE", "Luxury", 300.0, 15.0, 60.0, 450.0),
    (6, "PROMO", "Van", 200.0, 20.0, 45.0, 280.0),
]
GENERIC_GUARDRAIL = (50.0, 25.0, 50.0)
GENERIC_DAILY_RATE = 150.0

# --- fixed values: rate period bands ---------------------------------------
# (period_id, from_days, to_days, multiplier of the model's base rate).
RATE_BANDS = [
    (1, 1, 6, 1.0),
    (2, 1, None, 1.05),
    (3, 7, 27, 5.5),
    (4, 28, None, 20.0),
    (5, 7, 30, 6.0),
]

# --- fixed values: vehicle status vocabulary --------------------------------
# (status_id, status_name, status_type); the service default configuration.
STATUS_CONFIG = [
    (140, "Ready", "AVAILABLE"),
    (141, "Rented", "RENTED"),
    (143, "Sold", "EXCLUDED"),
    (144, "Maintenance", "EXCLUDED"),
    (145, "Out Of Service", "EXCLUDED"),
    (146, "Accident", "EXCLUDED"),
    (147, "New", "EXCLUDED"),
    (148, "Replacement", "EXCLUDED"),
    (149, "Ready To Sell", "EXCLUDED"),
    (150, "Total Damage", "EXCLUDED"),
    (151, "Sold To Insurance", "EXCLUDED"),
    (152, "Stolen", "EXCLUDED"),
    (153, "Has Been Circulated", "EXCLUDED"),
    (154, "Preventive Maintenance", "EXCLUDED"),
    (155, "Not Ready", "EXCLUDED"),
    (156, "In-Use", "RENTED"),
]

# --- fixed values: default signal weights -----------------------------------
SIGNAL_WEIGHTS = [
    ("utilization", 0.30),
    ("forecast", 0.25),
    ("competitor", 0.25),
    ("weather", 0.10),
    ("holiday", 0.10),
]

# --- fixed values: event feed city per event type ---------------------------
# The event feed's five streams are read as the five monitored cities
# (the regions that group the branches).
EVENT_CITY = [
    ("click", "AFRICA"),
    ("error", "AMERICA"),
    ("purchase", "ASIA"),
    ("signup", "EUROPE"),
    ("view", "MIDDLE EAST"),
]

# --- fixed values: our category -> competitor vehicle type ------------------
# (category_id, competitor_vehicle_type); unmapped categories use Economy.
COMPETITOR_MAPPING = [
    (1, "Economy"),
    (2, "Compact"),
    (3, "Standard"),
    (4, "SUV Standard"),
    (5, "Luxury Sedan"),
    (6, "SUV Large"),
]
DEFAULT_COMPETITOR_TYPE = "Economy"

# --- fixed values: competitor vehicle type -> the feed's category -----------
FEED_CATEGORIES = [
    ("economy", "Economy"),
    ("compact", "Compact"),
    ("standard", "Standard"),
    ("fullsize", "Standard"),
    ("suv", "SUV Standard"),
    ("luxury", "Luxury Sedan"),
]
DEFAULT_VEHICLE_TYPE = "economy"

# --- fixed values: guardrail configuration rows -----------------------------
# (guardrail_id, category_id or None = all, branch_id or None = all,
#  min_price, max_discount_pct, max_premium_pct, max_price or None = no such
#  bound); NULL means "applies to all".
GUARDRAIL_CONFIG = [
    (1, None, None, 50.0, 25.0, 50.0, None),
    (2, 3, None, 100.0, 25.0, 50.0, 160.0),
    (3, 5, None, 300.0, 15.0, 60.0, None),
    (4, None, 0, 60.0, 20.0, 40.0, 150.0),
]

# --- fixed values: national holidays with a fixed calendar date -------------
# (month, day, name, type)
FIXED_HOLIDAYS = [
    (9, 23, "Saudi National Day", "National"),
    (2, 22, "Founding Day", "National"),
]

# --- fixed values: holiday type priority -------------------------------------
HOLIDAY_TYPE_PRIORITY = ["National holiday", "Religious", "Muslim", "Observance"]

CATEGORY_SCHEMA = T.StructType([
    T.StructField("category_id", T.IntegerType(), False),
    T.StructField("p_type", T.StringType(), False),
    T.StructField("category_name", T.StringType(), False),
    T.StructField("default_min_price", T.DoubleType(), False),
    T.StructField("default_max_discount_pct", T.DoubleType(), False),
    T.StructField("default_max_premium_pct", T.DoubleType(), False),
    T.StructField("default_daily_rate", T.DoubleType(), False),
])
RATE_BAND_SCHEMA = T.StructType([
    T.StructField("period_id", T.IntegerType(), False),
    T.StructField("from_days", T.IntegerType(), False),
    T.StructField("to_days", T.IntegerType(), True),
    T.StructField("multiplier", T.DoubleType(), False),
])
STATUS_SCHEMA = T.StructType([
    T.StructField("status_id", T.IntegerType(), False),
    T.StructField("status_name", T.StringType(), False),
    T.StructField("status_type", T.StringType(), False),
])
WEIGHT_SCHEMA = T.StructType([
    T.StructField("signal_name", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), False),
])
EVENT_CITY_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType(), False),
    T.StructField("city_name", T.StringType(), False),
])
FIXED_HOLIDAY_SCHEMA = T.StructType([
    T.StructField("h_month", T.IntegerType(), False),
    T.StructField("h_day", T.IntegerType(), False),
    T.StructField("holiday_name", T.StringType(), False),
    T.StructField("holiday_type", T.StringType(), False),
])

COMPETITOR_MAPPING_SCHEMA = T.StructType([
    T.StructField("category_id", T.IntegerType(), False),
    T.StructField("competitor_vehicle_type", T.StringType(), False),
])

FEED_CATEGORY_SCHEMA = T.StructType([
    T.StructField("vehicle_type", T.StringType(), False),
    T.StructField("feed_category", T.StringType(), False),
])

GUARDRAIL_SCHEMA = T.StructType([
    T.StructField("guardrail_id", T.IntegerType(), False),
    T.StructField("category_id", T.IntegerType(), True),
    T.StructField("branch_id", T.IntegerType(), True),
    T.StructField("min_price", T.DoubleType(), False),
    T.StructField("max_discount_pct", T.DoubleType(), False),
    T.StructField("max_premium_pct", T.DoubleType(), False),
    T.StructField("max_price", T.DoubleType(), True),
])

_FIXED = {
    "feed_categories": (FEED_CATEGORIES, FEED_CATEGORY_SCHEMA),
    "guardrail_config": (GUARDRAIL_CONFIG, GUARDRAIL_SCHEMA),
    "competitor_mapping": (COMPETITOR_MAPPING, COMPETITOR_MAPPING_SCHEMA),
    "categories": (CATEGORIES, CATEGORY_SCHEMA),
    "rate_bands": (RATE_BANDS, RATE_BAND_SCHEMA),
    "status_config": (STATUS_CONFIG, STATUS_SCHEMA),
    "signal_weights_default": (SIGNAL_WEIGHTS, WEIGHT_SCHEMA),
    "event_city": (EVENT_CITY, EVENT_CITY_SCHEMA),
    "fixed_holidays": (FIXED_HOLIDAYS, FIXED_HOLIDAY_SCHEMA),
}


def fixed_table(spark: SparkSession, name: str) -> DataFrame:
    """A fixed table as a local relation (always broadcast in joins)."""
    rows, schema = _FIXED[name]
    return spark.createDataFrame(rows, schema)


def _sql_literal(v, dtype: T.DataType) -> str:
    if v is None:
        sql_t = {T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
                 T.StringType: "VARCHAR"}[type(dtype)]
        return f"CAST(NULL AS {sql_t})"
    if isinstance(dtype, T.StringType):
        return "'" + str(v).replace("'", "''") + "'"
    if isinstance(dtype, T.DoubleType):
        return f"CAST({float(v)!r} AS DOUBLE)"
    if isinstance(dtype, T.IntegerType):
        return f"CAST({int(v)} AS INTEGER)"
    raise TypeError(dtype)


def fixed_table_sql(name: str) -> str:
    """The same fixed table as a SQL ``SELECT`` (for the DuckDB oracle)."""
    rows, schema = _FIXED[name]
    selects = []
    for row in rows:
        cols = [f"{_sql_literal(v, f.dataType)} AS {f.name}" for v, f in zip(row, schema.fields)]
        selects.append("SELECT " + ", ".join(cols))
    return " UNION ALL ".join(selects)
