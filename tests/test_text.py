import pytest
from pyspark.sql import functions as F

from larder.functions import dates, labels, maths, text


def evaluate(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def keys(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    return [r.k for r in rows.select(text.identity_key(F.col("n")).alias("k")).collect()]


def test_identity_key_ignores_how_a_name_is_written(spark):
    a = keys(spark, ["Rice, white", "white rice", "White Rices"])
    assert a == ["rice white"] * 3
    b = keys(spark, ["ground beef, 80% lean", "ground beef", "Beef, ground"])
    assert len(set(b)) == 1
    assert len(set(keys(spark, ["milk, 3.25% milkfat", "Milk"]))) == 1
    assert len(set(keys(spark, ["pork loin, lean only", "pork loin"]))) == 2
    assert keys(spark, [None, ""]) == ["", ""]


@pytest.mark.parametrize("one, many", [
    ("potato", "potatoes"), ("jelly", "jellies"), ("pork foot", "pork feet"),
    ("maraschino cherry", "maraschino cherries"), ("sun-dried tomato", "sun-dried tomatoes"),
    ("hush puppy", "hush puppies"), ("leaf", "leaves"), ("loaf", "loaves"), ("knife", "knives"),
    ("glass", "glasses"), ("molasses", "molass"), ("peach", "peaches"),
])
def test_identity_key_folds_plurals(spark, one, many):
    a, b = keys(spark, [one, many])
    assert a == b


def test_words_that_only_look_plural_stay(spark):
    stay = ["asparagus", "hummus", "couscous", "watercress", "bass"]
    assert keys(spark, stay) == stay


@pytest.mark.parametrize("prep, description, base, kind, want", [
    ("cooked", "Cress, garden, cooked, boiled, drained, without salt", "cress", "ingredient", "boiled"),
    (None, "Raspberries, raw", "food", "ingredient", "raw"),
    (None, "Onion rings, breaded, par fried, frozen, unprepared", "food", "ingredient", "raw"),
    (None, "Egg, whole, uncooked", "food", "ingredient", "raw"),
    ("cooked", "Chicken breast, baked, broiled, or roasted, skin eaten, from raw", "chicken breast", "ingredient", "cooked"),
    (None, "Seeds, sesame butter, tahini, from raw and stone ground kernels", "sesame butter", "ingredient", None),
    ("cooked", "Beans, baked, home prepared", "baked beans", "ingredient", "cooked"),
    (None, "Raw vegetable, not further specified", "raw vegetable", "ingredient", None),
    ("frozen", "Peas, frozen, cooked, boiled, drained", "peas", "ingredient", "frozen"),
    ("smoked", "Fish, salmon, smoked, raw", "salmon", "ingredient", "smoked"),
    (None, "Cheese, fresh, queso fresco", "queso fresco", "ingredient", None),
    (None, "Salad, raw vegetable, with dressing", "vegetable salad", "dish", None),
])
def test_corrected_label(spark, prep, description, base, kind, want):
    got = evaluate(spark, labels.corrected_label(F.lit(prep).cast("string"), F.lit(description), F.lit(base), F.lit(kind)))
    assert got == want


def test_expansion_is_idempotent_and_logged(spark):
    raw = "Yogurt, NFS w/o salt w/ fat, prep., NS as to type, M&M's"
    want = "Yogurt, not further specified without salt with fat, prepared, not specified as to type, M&M's"
    once = evaluate(spark, labels.expand_abbreviations(F.lit(raw)))
    assert once == want
    assert evaluate(spark, labels.expand_abbreviations(F.lit(once))) == want
    log = evaluate(spark, labels.substitutions(F.lit(raw)))
    assert [r.rule for r in log] == ["abbrev:w/o", "abbrev:w/", "abbrev:NFS", "abbrev:NS", "abbrev:prep"]


def test_lost_word_stops_the_job(spark):
    with pytest.raises(Exception, match="protected words lost"):
        evaluate(spark, labels.guarded(F.lit("Beef, raw"), F.lit("Beef")))


@pytest.mark.parametrize("description, want", [
    ("Milk, 3.25% milkfat", 3.25), ("Milk, 2 % milk fat, 1% fat", 2.0), ("Yogurt, 4% fat", 4.0),
    ("Beef, 95% lean", 5.0), ("Beef", None),
])
def test_fat_percentage(spark, description, want):
    assert evaluate(spark, labels.fat_percentage(F.lit(description))) == want


@pytest.mark.parametrize("value, want", [
    ("🍗", True), ("👨‍🍳", True), ("☕️", True), ("👍🏽", True), ("🍗🍗", False), (":)", False), ("a", False), ("", False),
])
def test_single_emoji(spark, value, want):
    assert evaluate(spark, text.is_single_emoji(F.lit(value))) is want


@pytest.mark.parametrize("typed, want", [("1 1/2", 1.5), ("150", 150.0), ("abc", 0.0), ("1/0", 0.0), ("", 0.0), ("1/2", 0.5)])
def test_parse_amount(spark, typed, want):
    assert evaluate(spark, text.parse_amount(F.lit(typed))) == want


def test_slug_is_cut_at_forty_characters(spark):
    assert evaluate(spark, text.slug(F.lit("Chicken_1"))) == "chicken_1"
    assert evaluate(spark, text.slug(F.lit("!!!"))) == ""
    assert len(evaluate(spark, text.slug(F.lit("abc " * 30)))) <= 40


def test_portions(spark):
    assert evaluate(spark, maths.portion_ladder(F.lit(158.0))) == [15.0, 25.0, 40.0, 65.0, 85.0, 120.0, 158.0]
    assert evaluate(spark, maths.portion_ladder(F.lit(3.0))) == [3.0]
    ounce = evaluate(spark, maths.picked_portion(F.lit(4.0), F.lit("oz"), F.lit(28.35), F.lit(False)))
    assert (round(ounce.grams, 2), ounce.qty, ounce.label) == (113.4, None, "113 g")
    cup = evaluate(spark, maths.picked_portion(F.lit(2.0), F.lit("cup"), F.lit(158.0), F.lit(True)))
    assert (cup.grams, cup.qty, cup.portion_label, cup.label) == (316.0, 2.0, "cup", "2 × cup")


def test_label_values_round_trip(spark):
    stored = evaluate(spark, maths.per_100g(F.lit(24.0), F.lit(30.0)))
    assert stored == 80.0
    assert evaluate(spark, maths.scaled(F.lit(30.0), F.lit(stored))) == 24.0


def test_week_zero(spark):
    assert evaluate(spark, dates.monday_week(F.lit("2023-01-01"))) == "2023-00"
    assert evaluate(spark, dates.monday_week(F.lit("2024-01-01"))) == "2024-01"


@pytest.mark.parametrize("confidence, brand, failed, want", [
    (0.8, False, False, "auto_approved"), (0.79, False, False, "needs_review"),
    (0.99, True, False, "needs_review"), (0.99, False, True, "needs_review"),
])
def test_route(spark, confidence, brand, failed, want):
    assert evaluate(spark, labels.route(F.lit(confidence), F.lit(brand), F.lit(failed))) == want
