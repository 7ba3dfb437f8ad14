import pytest
from pyspark.sql import functions as F

from larder.functions import lines, text

LIVE = [
    ("2 cups rice", 2.0, "cups", "rice", 480.0),
    ("500g chicken", 500.0, "g", "chicken", 500.0),
    ("1 kg beef", 1.0, "kg", "beef", 1000.0),
    ("2 oz butter", 2.0, "oz", "butter", 56.7),
    ("3.5 cups water", 3.5, "cups", "water", 840.0),
    ("1/2 cup oil", 0.5, "cup", "oil", 120.0),
    ("2 1/2 cups water", 2.5, "cups", "water", 600.0),
    ("2½ cups flour", 2.5, "cups", "flour", 600.0),
    ("½ cup sugar", 0.5, "cup", "sugar", 120.0),
    ("1 onion", 1.0, "", "onion", 150.0),
    ("1 onion, chopped", 1.0, "", "onion", 150.0),
    ("parsley or cilantro", 0.0, "", "parsley", None),
    ("cayenne (optional)", 0.0, "", "cayenne", None),
    ("Pinch of cayenne", 1.0, "pinch", "cayenne", 0.35),
    ("6 garlic cloves", 6.0, "cloves", "garlic", 24.0),
    ("3 cloves garlic", 3.0, "cloves", "garlic", 12.0),
    ("15 oz can of cannellini beans", 15.0, "oz", "can of cannellini beans", 425.25),
    ("salt to taste", 0.0, "", "salt to taste", None),
    ("", 0.0, "", "", None),
]


def test_live_lines(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LIVE)], "i int, raw string")
    for r, (raw, qty, unit, name, grams) in zip(lines.parsed_live(df).orderBy("i").collect(), LIVE, strict=True):
        assert (r.raw, r.qty, r.unit, r.name_raw) == (raw, qty, unit, name)
        assert r.grams == (pytest.approx(grams) if grams is not None else None)


def test_garbage_lines(spark):
    df = spark.createDataFrame([(x,) for x in ("", "   ", "!!!", "12345", "a lot of salt", "🍅🍅", "1/0 cup broken", "9" * 400, "x" * 20_000, None)], "raw string")
    assert lines.parsed_live(df).count() == lines.extracted(df).count() == lines.parsed_batch(df).count() == 10
    for f in (lines.parsed_live, lines.extracted, lines.parsed_batch):
        f(df).collect()


MEASURES = [
    ("1 cup (211 g) rice", 211.0, "bracketed_metric"),
    ("1 oz [30-g] nuts", 30.0, "bracketed_metric"),
    ("3 lb (1.4 kg) beef", 1400.0, "bracketed_metric"),
    ("200g/7oz tomatoes", 200.0, "leading_metric"),
    ("1kg/2lb lamb", 1000.0, "leading_metric"),
    ("1 pound beef", 454.0, "pound_conversion"),
    ("2½ lb steak", 1135.0, "pound_conversion"),
    ("2 tsp salt", 10.0, "volume_unit"),
    ("1 large onion", 150.0, "count_estimate"),
    ("2 cloves garlic", 8.0, "count_estimate"),
    ("some salt", None, "no_match"),
    ("  ", None, "blank"),
]


def test_measures(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(MEASURES)], "i int, raw string")
    assert [(r.grams_total, r.extraction_method) for r in lines.extracted(df).orderBy("i").collect()] == [x[1:] for x in MEASURES]


def test_servings(spark):
    cases = [("MAKES 4 TO 6 SERVINGS", 5), ("MAKES 6 SERVINGS", 6), ("6 servings", 6), ("4 – 5", 4), ("4", 4), ("Makes a 900 g loaf", 8), ("garbage", 4), (None, 4), ("4 to 7", 6), ("99", 4)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, raw string, want int")
    assert df.where(~text.servings("raw").eqNullSafe(F.col("want"))).collect() == []


def test_batch_lines(spark):
    df = spark.createDataFrame([(1, "1/2 cup vegetable oil for frying"), (2, "3 pounds cod fillets, cut"), (3, "2 large onions, sliced"), (4, "salt to taste"), (5, "2-3 cups stock")], "i int, raw string")
    got = [tuple(r)[1:] for r in lines.parsed_batch(df).select("i", "measure_only", "grams", "remainder").orderBy("i").collect()]
    assert got[:4] == [("1/2 cup", 120.0, "vegetable oil for frying"), ("3 pounds", 1362.0, "cod fillets, cut"), ("2 large", 300.0, "onions, sliced"), ("", None, "salt to taste")]
    assert lines.parsed_batch(df, ranges="-").where("i = 5").first()["grams"] == 600.0


def test_scraped_lines(spark):
    df = spark.createDataFrame([("120g/4½oz onion", "120 g onion"), ("80-100 g <b>flour</b>", "80 g flour"), ("2 cups&nbsp;milk", "2 cups milk"), ("100ml/3fl oz milk", "100 ml oz milk")], "raw string, want string")
    assert df.where(text.scraped_line("raw") != F.col("want")).collect() == []


def test_names(spark):
    df = spark.createDataFrame([("2 cups Chopped Fresh Tomatoes (ripe)", "tomato", "fresh"), ("ground cumin", "cumin", "ground"), ("berries", "berry", None), ("couscous", "couscous", None)], "raw string, base string, form string")
    assert df.where(~text.base_ingredient("raw").eqNullSafe(F.col("base")) | ~text.form("raw").eqNullSafe(F.col("form"))).collect() == []
    types = [("manual_match", "high"), ("user_override", "custom"), ("usda_search", "medium"), ("wafct", "medium"), ("fuzzy_90%", "medium"), ("fuzzy_70%", "low"), ("no_match", "none"), (None, "none")]
    df = spark.createDataFrame(types, "t string, want string")
    assert df.where(text.confidence("t") != F.col("want")).collect() == []
