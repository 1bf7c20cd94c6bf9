from wattledger.functions import labels as L


def evaluate(spark, expression, values, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").selectExpr(expression).collect()]


def test_footprint(spark):
    assert evaluate(spark, L.footprint("x"), [999.0, 2500.0, 3.2e6, 1234567.0e3, None]) == [
        "999 gCO2e", "2 kgCO2e", "3 TCO2e", "1,235 TCO2e", None,
    ]
    assert evaluate(spark, L.footprint("x", html=True), [5.0]) == ["5 gCO<sub>2</sub>e"]


def test_trees(spark):
    assert evaluate(spark, L.tree_months("x"), [0.5, 1.2, 3.0, 24.0, 30.0, 130.0, 24000.0]) == [
        "0.500 tree-months", "1.2 tree-month", "3.0 tree-months", "24 tree-months", "2 tree-years and 6 tree-months",
        "10.8 tree-years", "2000.0 tree-years",
    ]
    assert evaluate(spark, L.tree_months("x", split_years=False), [30.0]) == ["2 tree-years"]


def test_short_time(spark):
    texts = evaluate(spark, L.short_duration("x"), [90000_000, 172801_000, 59_000, 31536000_000, 3600_000, 172800_000], "bigint")
    assert texts == ["25.0 hours", "2.0 days", "59.00 seconds", "1.0 year", "1.0 hour", "48.0 hours"]


def test_driving_cost_percent(spark):
    assert evaluate(spark, L.driving("x"), [9.876, 1234.5]) == ["driving 9.88 km", "driving 1,234 km"]
    assert evaluate(spark, L.cost("x", "£"), [1234.5]) == ["£1,234"]
    assert evaluate(spark, L.percent("x"), [0.12345, 1.0]) == ["12.35%", "100.00%"]


def test_flying(spark):
    df = spark.createDataFrame(
        [(3.456, 0.3, 0.1), (30.0, 12.0, 0.4), (3000.0, 1300.0, 1234.5)], "flying_PAR_LON double, flying_NY_SF double, flying_NYC_MEL double"
    )
    rows = df.selectExpr(L.flying(), L.flying_number(), L.flying_trip()).collect()
    assert [tuple(r) for r in rows] == [
        ("3.46 flights between Paris and London", 3.46, "Paris - London"),
        ("12.0 flights between New York and San Francisco", 12.0, "New York - San Francisco"),
        ("1,234.5 flights between New York and Melbourne", 1234.5, "New York - Melbourne"),
    ]
