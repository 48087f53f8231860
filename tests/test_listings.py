"""Nested provider payloads: defaults, fallbacks, unreadable ones."""

from ratewise.operators import competitor as cp


def test_normalise_listings(spark):
    rows = [
        (1, 4, '{"vehicle_info":{"v_name":"Toyota Yaris","group":"Economy","seats":5,"baggage_large":0,"bags_large":2,'
               '"baggage_small":1,"bags_small":9},"pricing_info":{"price":100.0},"supplier_info":{"name":"S"},"more":[1]}'),
        (2, 0, '{"vehicle_info":{},"pricing_info":{"price":-5}}'),
        (3, 2, "not json"),
        (4, 2, None),
    ]
    got = {r.quote_id: r for r in cp.normalise_listings(
        spark.createDataFrame(rows, "quote_id int, rental_days int, payload string"), ["quote_id"]).collect()}
    a = got[1]
    assert (a.competitor_name, a.vehicle_name, a.brand, a.daily_price, a.weekly_price, a.monthly_price) == (
        "S", "Toyota Yaris", "Toyota", 25.0, 150.0, 625.0)
    assert (a.seats, a.bags_large, a.bags_small) == (5, 2, 1)
    for i in (2, 3, 4):
        assert (got[i].competitor_name, got[i].vehicle_name, got[i].daily_price, got[i].bags_large) == ("Unknown", "Unknown", 0.0, None)
