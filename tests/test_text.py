"""Brand / model / category extraction on the hand-made corpus."""

import pytest

from ratewise.functions.text import competitor_category, with_brand_and_model

CORPUS = [
    ("Toyota Camry or similar", "Toyota", "Camry or similar", "Standard"),
    ("Hyundai Tucson", "Hyundai", "Tucson", "SUV Compact"),
    ("Mercedes-Benz E-Class", "Mercedes-Benz", "E-Class", "Luxury Sedan"),
    ("BMW X5 2024", "BMW", "X5 2024", "Luxury SUV"),
    ("Nissan Patrol V8", "Nissan", "Patrol V8", "SUV Large"),
    ("Unknown Vehicle", "Unknown", "Vehicle", "Standard"),
    ("Ford Mustang GT", "Ford", "Mustang GT", "Standard"),
    ("Kia Sorento 2023 Model", "Kia", "Sorento 2023 Model", "SUV Standard"),
    ("Chevrolet Tahoe LTZ", "Chevrolet", "Tahoe LTZ", "SUV Large"),
    ("Lexus RX 350", "Lexus", "RX 350", "Standard"),
    ("Range Rover Sport", "Range Rover", "Sport", "Luxury SUV"),
    ("Porsche Cayenne", "Porsche", "Cayenne", "Luxury SUV"),
    ("Mini Cooper S", "Mini", "Cooper S", "Standard"),
    ("Ferrari 488 Spider", "Ferrari", "488 Spider", "Standard"),
    ("Dodge Ram 1500", "Dodge", "Ram 1500", "Standard"),
    ("Land Rover Range Rover", "Land Rover", "Range Rover", "Luxury SUV"),
    ("Program Car", "Ram", "Car", "Standard"),
    ("Toyota", "Toyota", "Toyota", "Standard"),
    ("", "Unknown", "Unknown", "Standard"),
]


def test_corpus(spark):
    df = spark.createDataFrame([(n, "") for n, *_ in CORPUS], "vehicle_name string, vehicle_group string")
    out = with_brand_and_model(df).withColumn("category", competitor_category("vehicle_name", "vehicle_group"))
    got = {r.vehicle_name: (r.brand, r.model, r.category) for r in out.collect()}
    for name, brand, model, cat in CORPUS:
        assert got[name] == (brand, model, cat), name


def test_group_fallback(spark):
    df = spark.createDataFrame([("Some Car", "Compact SUV"), ("Other Car", "Nope")], "n string, g string")
    got = [r[0] for r in df.select(competitor_category("n", "g")).collect()]
    assert got == ["SUV Compact", "Standard"]


@pytest.mark.parametrize("raw,expected", [('{"en":"Riyadh","ar":"الرياض"}', "الرياض"), ('{"en":"Jeddah"}', "Jeddah"),
                                          ("plain", "plain"), (None, None)])
def test_localized_name(spark, raw, expected):
    from ratewise.functions.text import localized_name
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(localized_name("s")).first()[0] == expected
