"""Text scalar functions (STR-01..05, CMP-01, CMP-02).

Ordered-dictionary matching is done with higher-order array functions on
literal arrays (``filter`` keeps the list order, ``element_at(.., 1)``
takes the first hit), so no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: known vehicle brands, in match order ----------------------
KNOWN_BRANDS = [
    "Toyota", "Nissan", "Honda", "Hyundai", "Kia", "Chevrolet", "Ford",
    "Mazda", "Mitsubishi", "Suzuki", "Volkswagen", "Renault", "Peugeot",
    "BMW", "Mercedes-Benz", "Mercedes", "Audi", "Lexus", "Infiniti",
    "Cadillac", "Lincoln", "GMC", "Jeep", "Land Rover", "Range Rover",
    "Porsche", "Bentley", "Genesis", "Volvo", "Subaru", "Fiat", "Dodge",
    "Chrysler", "Ram", "Buick", "Acura", "Mini", "Alfa Romeo", "Jaguar",
    "Maserati", "Ferrari", "Lamborghini", "Rolls-Royce", "Aston Martin",
    "McLaren", "Bugatti", "Tesla", "Rivian", "Lucid", "Geely", "BYD",
    "Chery", "Great Wall", "Haval", "MG", "Skoda", "Seat", "Cupra",
    "Opel", "Citroën", "DS", "Lancia", "Smart", "Dacia",
]

# --- fixed values: vehicle model -> competitor category, in match order ------
MODEL_CATEGORIES = [
    ("Nissan Sunny", "Economy"), ("Toyota Yaris", "Economy"), ("Hyundai Accent", "Economy"),
    ("Kia Rio", "Economy"), ("Chevrolet Spark", "Economy"), ("Mitsubishi Mirage", "Economy"),
    ("Suzuki Swift", "Economy"), ("Honda City", "Economy"), ("Nissan Micra", "Economy"),
    ("Renault Symbol", "Economy"),
    ("Toyota Corolla", "Compact"), ("Hyundai Elantra", "Compact"), ("Kia Cerato", "Compact"),
    ("Honda Civic", "Compact"), ("Mazda 3", "Compact"), ("Nissan Sentra", "Compact"),
    ("Chevrolet Cruze", "Compact"), ("Volkswagen Jetta", "Compact"), ("Mitsubishi Lancer", "Compact"),
    ("Kia Forte", "Compact"),
    ("Toyota Camry", "Standard"), ("Honda Accord", "Standard"), ("Hyundai Sonata", "Standard"),
    ("Kia Optima", "Standard"), ("Nissan Altima", "Standard"), ("Mazda 6", "Standard"),
    ("Chevrolet Malibu", "Standard"), ("Ford Fusion", "Standard"), ("Volkswagen Passat", "Standard"),
    ("Kia K5", "Standard"),
    ("Hyundai Tucson", "SUV Compact"), ("Kia Sportage", "SUV Compact"), ("Toyota RAV4", "SUV Compact"),
    ("Honda CR-V", "SUV Compact"), ("Nissan Rogue", "SUV Compact"), ("Mazda CX-5", "SUV Compact"),
    ("Mitsubishi Outlander", "SUV Compact"), ("Ford Escape", "SUV Compact"),
    ("Chevrolet Equinox", "SUV Compact"), ("Jeep Compass", "SUV Compact"),
    ("Toyota Fortuner", "SUV Standard"), ("Hyundai Santa Fe", "SUV Standard"), ("Kia Sorento", "SUV Standard"),
    ("Nissan Pathfinder", "SUV Standard"), ("Ford Explorer", "SUV Standard"),
    ("Chevrolet Traverse", "SUV Standard"), ("Honda Pilot", "SUV Standard"),
    ("Jeep Grand Cherokee", "SUV Standard"), ("Mitsubishi Pajero", "SUV Standard"),
    ("Toyota 4Runner", "SUV Standard"),
    ("Toyota Land Cruiser", "SUV Large"), ("Nissan Patrol", "SUV Large"), ("Chevrolet Tahoe", "SUV Large"),
    ("GMC Yukon", "SUV Large"), ("Ford Expedition", "SUV Large"), ("Cadillac Escalade", "SUV Large"),
    ("Lexus LX", "SUV Large"), ("Infiniti QX80", "SUV Large"), ("Lincoln Navigator", "SUV Large"),
    ("Mercedes-Benz E-Class", "Luxury Sedan"), ("BMW 5 Series", "Luxury Sedan"), ("Audi A6", "Luxury Sedan"),
    ("Lexus ES", "Luxury Sedan"), ("Mercedes-Benz S-Class", "Luxury Sedan"), ("BMW 7 Series", "Luxury Sedan"),
    ("Audi A8", "Luxury Sedan"), ("Lexus LS", "Luxury Sedan"), ("Genesis G80", "Luxury Sedan"),
    ("Genesis G90", "Luxury Sedan"),
    ("Mercedes-Benz GLE", "Luxury SUV"), ("BMW X5", "Luxury SUV"), ("Audi Q7", "Luxury SUV"),
    ("Porsche Cayenne", "Luxury SUV"), ("Range Rover", "Luxury SUV"), ("Range Rover Sport", "Luxury SUV"),
    ("Mercedes-Benz GLS", "Luxury SUV"), ("BMW X7", "Luxury SUV"), ("Audi Q8", "Luxury SUV"),
    ("Bentley Bentayga", "Luxury SUV"),
]

# --- fixed values: feed vehicle group -> competitor category ------------------
GROUP_CATEGORIES = [
    ("Mini", "Economy"), ("Economy", "Economy"), ("Compact", "Compact"),
    ("Intermediate", "Standard"), ("Standard", "Standard"), ("Fullsize", "Standard"),
    ("Full-size", "Standard"), ("Compact SUV", "SUV Compact"), ("SUV", "SUV Standard"),
    ("Intermediate SUV", "SUV Standard"), ("Standard SUV", "SUV Standard"), ("Large SUV", "SUV Large"),
    ("Premium SUV", "SUV Large"), ("Luxury", "Luxury Sedan"), ("Premium", "Luxury Sedan"),
    ("Luxury Car", "Luxury Sedan"), ("Luxury SUV", "Luxury SUV"),
]
DEFAULT_CATEGORY = "Standard"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def localized_name(raw, lang: str = "ar") -> Column:
    """STR-01: JSON name -> requested language, else English, else the raw
    string (also when the text is not JSON)."""
    raw = _c(raw)
    return F.coalesce(F.get_json_object(raw, f"$.{lang}"), F.get_json_object(raw, "$.en"), raw)


def _first_match(low: Column, pairs) -> Column:
    """First (key, value) whose lower-cased key is contained in ``low``.

    A ``coalesce`` of flat ``when`` tests: list order is evaluation order,
    evaluation stops at the first hit, and code generation splits the long
    argument list into methods (a lambda ``filter`` would run interpreted,
    a long nested CASE can exceed the compiler's limits)."""
    if isinstance(low, str):
        # One SQL expression (a single planner call) over a column name.
        q = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return F.expr("coalesce(" + ", ".join(
            f"CASE WHEN contains({low}, {q(k.lower())}) THEN {q(v)} END" for k, v in pairs) + ")")
    return F.coalesce(*[F.when(low.contains(F.lit(k.lower())), F.lit(v)) for k, v in pairs])


def brand_of(name) -> Column:
    """CMP-01 first step: the first known brand (list order) contained
    case-insensitively in the stripped name, else NULL."""
    return _first_match(F.lower(_strip(_c(name))), [(b, b) for b in KNOWN_BRANDS])


def model_of(name, brand) -> Column:
    """CMP-01 second step, given the brand column: text after the brand
    without leading dashes/blanks (the whole name when nothing follows);
    without a brand, the part after the first space, else the name."""
    raw, brand = _c(name), _c(brand)
    nm = _strip(raw)
    pos = F.position(F.lower(brand), F.lower(nm))
    after = F.regexp_replace(_strip(F.substr(nm, pos + F.length(brand))), r"^[-\s]+", "")
    sp = F.locate(" ", nm)
    empty = raw.isNull() | (raw == "")
    return (F.when(empty, F.lit("Unknown"))
            .when(brand.isNotNull(), F.when(after == "", nm).otherwise(after))
            .when(sp > 0, F.substr(nm, sp + 1)).otherwise(nm))


def brand_label(name, brand) -> Column:
    """Final brand: 'Unknown' for empty names or names without a space."""
    raw, brand = _c(name), _c(brand)
    nm = _strip(raw)
    empty = raw.isNull() | (raw == "")
    return (F.when(empty, F.lit("Unknown")).when(brand.isNotNull(), brand)
            .when(F.locate(" ", nm) > 0, F.substring_index(nm, " ", 1)).otherwise(F.lit("Unknown")))


def with_brand_and_model(df, name_col: str = "vehicle_name"):
    """CMP-01 on a DataFrame: adds ``brand`` and ``model``.

    The matched brand is projected once and the dependent columns are
    computed in a second projection, so the dictionary scan runs once per
    row."""
    x = df.withColumn("_low", F.lower(_strip(F.col(name_col))))
    x = x.withColumn("_brand", _first_match("_low", [(b, b) for b in KNOWN_BRANDS])).drop("_low")
    return x.withColumn("brand", brand_label(name_col, "_brand")) \
            .withColumn("model", model_of(name_col, "_brand")).drop("_brand")


def brand_and_model(name) -> Column:
    """CMP-01 as one Column (struct(brand, model)), for small inputs."""
    b = brand_of(name)
    return F.struct(brand_label(name, b).alias("brand"), model_of(name, b).alias("model"))


def competitor_category(name, group) -> Column:
    """CMP-02: first model key (dictionary order) contained in the name ->
    its category; else the feed group's category; else Standard."""
    low = F.lower(F.coalesce(_c(name), F.lit("")))
    if isinstance(name, str):
        low = f"lower(coalesce({name}, ''))"
    hit = _first_match(low, MODEL_CATEGORIES)
    grp = None
    for k, v in GROUP_CATEGORIES:
        cond = _c(group) == F.lit(k)
        grp = F.when(cond, F.lit(v)) if grp is None else grp.when(cond, F.lit(v))
    return F.coalesce(hit, grp, F.lit(DEFAULT_CATEGORY))


def brand_and_model_sql(name: str) -> tuple[str, str]:
    """DuckDB SQL for (brand, model) of :func:`brand_and_model`."""
    brands = "[" + ", ".join("'" + b.replace("'", "''") + "'" for b in KNOWN_BRANDS) + "]"
    nm = f"regexp_replace({name}, '^\\s+|\\s+$', '', 'g')"
    brand = f"list_filter({brands}, lambda b: contains(lower({nm}), lower(b)))[1]"
    after = (f"regexp_replace(regexp_replace(substr({nm}, strpos(lower({nm}), lower({brand})) + length({brand})), "
             f"'^\\s+|\\s+$', '', 'g'), '^[-\\s]+', '')")
    empty = f"({name} IS NULL OR {name} = '')"
    sp = f"strpos({nm}, ' ')"
    b = (f"CASE WHEN {empty} THEN 'Unknown' WHEN {brand} IS NOT NULL THEN {brand} "
         f"WHEN {sp} > 0 THEN split_part({nm}, ' ', 1) ELSE 'Unknown' END")
    m = (f"CASE WHEN {empty} THEN 'Unknown' WHEN {brand} IS NOT NULL THEN "
         f"(CASE WHEN {after} = '' THEN {nm} ELSE {after} END) "
         f"WHEN {sp} > 0 THEN substr({nm}, {sp} + 1) ELSE {nm} END")
    return b, m


def competitor_category_sql(name: str, group: str) -> str:
    """DuckDB SQL of :func:`competitor_category`."""
    models = "[" + ", ".join(f"{{'k': '{k}', 'c': '{v}'}}" for k, v in MODEL_CATEGORIES) + "]"
    hit = f"list_filter({models}, lambda s: contains(lower(coalesce({name}, '')), lower(s.k)))[1].c"
    case = " ".join(f"WHEN {group} = '{k}' THEN '{v}'" for k, v in GROUP_CATEGORIES)
    return f"coalesce({hit}, CASE {case} END, '{DEFAULT_CATEGORY}')"
