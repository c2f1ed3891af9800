from larder.operators import plate

DETECTION = ("session string, pos long, shot_count int, instance_id string, name string, search_term string, emoji string, grams double, "
             "confidence double, kcal_100g double, protein_100g double, carb_100g double, fat_100g double, shots array<int>")


def detections(spark, rows, shot_count=3):
    full = [("s", i, shot_count, r["id"], r.get("name", "Thing"), r.get("term", ""), r.get("emoji", ""), float(r.get("grams", 10)),
             float(r.get("confidence", .9)), float(r.get("kcal", 0)), 0.0, 0.0, 3.0, r.get("shots", [1])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, DETECTION)


def staged(spark, rows=()):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "session string, pos long, instance_id string, name string")


def normal(spark, rows, on_plate=(), shot_count=3):
    got = plate.normalise_detections(detections(spark, rows, shot_count), staged(spark, on_plate))
    return got.orderBy("pos").collect()


def test_repeated_id_collapses(spark):
    got = normal(spark, [{"id": "chicken_1", "name": "Chicken thigh", "grams": 140, "confidence": .7, "shots": [1]},
                         {"id": "Chicken_1", "name": "Grilled chicken thigh", "grams": 160, "confidence": .9, "shots": [2, 3]}])
    assert [(r.instance_id, r.name, r.grams, r.shots) for r in got] == [("chicken_1", "Grilled chicken thigh", 160.0, [1, 2, 3])]


def test_staged_id_is_adopted_once(spark):
    got = normal(spark, [{"id": "thigh_2", "name": "Chicken thighs"}, {"id": "thigh_3", "name": "chicken THIGH"}], [("chicken_1", "Chicken thigh")])
    assert [r.instance_id for r in got] == ["chicken_1", "thigh_3"]


def test_two_items_of_one_food_stay_two(spark):
    got = normal(spark, [{"id": "egg_1", "name": "Fried egg"}, {"id": "egg_2", "name": "Fried egg"}], [("egg_1", "Fried egg")])
    assert [r.instance_id for r in got] == ["egg_1", "egg_2"]


def test_unusable_rows_are_dropped_and_numbers_held(spark):
    got = normal(spark, [{"id": ""}, {"id": "!!!"}, {"id": "ok_1", "name": "   "},
                         {"id": "x_1", "grams": 9001, "confidence": 1.8, "shots": [3, 1, 1, 0, 9], "kcal": -20, "emoji": "🍗 chicken"}])
    assert [(r.instance_id, r.grams, r.confidence, r.shots, r.kcal_100g, r.fat_100g, r.emoji, r.search_term) for r in got] == [
        ("x_1", 0.0, 1.0, [1, 3], 0.0, 3.0, "🍗", "Thing")]


def test_no_shots_means_the_newest(spark):
    assert normal(spark, [{"id": "a", "grams": 137.6, "shots": []}], shot_count=4)[0].shots == [4]
    assert normal(spark, [{"id": "a", "grams": 137.6}])[0].grams == 138.0


def test_first_seen_order_is_kept(spark):
    got = normal(spark, [{"id": "c"}, {"id": "a"}, {"id": "b"}, {"id": "a", "shots": [2]}])
    assert [r.instance_id for r in got] == ["c", "a", "b"]


PLATE = ("session string, pos long, instance_id string, food_id long, name string, emoji string, kcal_100g double, protein_100g double, "
         "carb_100g double, fat_100g double, serving_g double, grams double, shots array<int>")


def rows_of(spark, rows):
    return spark.createDataFrame([("s", i, ident, None, name, None, 1.0, 1.0, 1.0, 1.0, None, float(grams), shots)
                                  for i, (ident, name, grams, shots) in enumerate(rows)], PLATE)


def ids(spark, values):
    return spark.createDataFrame([("s", v) for v in values], "session string, instance_id string")


def merged(spark, batch, candidates, edited=(), removed=()):
    got = plate.merge_plate(rows_of(spark, batch), rows_of(spark, candidates), ids(spark, edited), ids(spark, removed))
    return [(r.instance_id, r.name, r.grams, r.shots) for r in got.orderBy("place").collect()]


BATCH = [(None, "Toast", 40, []), ("chicken_1", "Chicken", 140, [1])]


def test_empty_reply_changes_nothing(spark):
    assert merged(spark, BATCH, []) == BATCH


def test_known_item_is_rewritten_in_place_and_new_ones_follow(spark):
    got = merged(spark, BATCH, [("salad_1", "Salad", 85, [2]), ("chicken_1", "Chicken thigh", 150, [2])])
    assert got == [(None, "Toast", 40.0, []), ("chicken_1", "Chicken thigh", 150.0, [1, 2]), ("salad_1", "Salad", 85.0, [2])]


def test_edited_weight_and_removal_survive(spark):
    got = merged(spark, BATCH, [("chicken_1", "Chicken thigh", 150, [2]), ("feta_1", "Feta", 30, [2])], edited=["chicken_1"], removed=["feta_1"])
    assert got[1] == ("chicken_1", "Chicken thigh", 140.0, [1, 2])
    assert len(got) == 2


def test_last_of_a_repeated_id_wins(spark):
    got = merged(spark, [], [("a", "First", 1, [1]), ("b", "B", 2, [1]), ("a", "Second", 3, [2])])
    assert got == [("b", "B", 2.0, [1]), ("a", "Second", 3.0, [2])]


def test_best_match_needs_enough_and_keeps_rank_on_ties(spark):
    wanted = spark.createDataFrame([(1, "Cherry tomatoes"), (2, "Olive oil"), (3, "Egg")], "key int, name string")
    options = spark.createDataFrame([(1, 1, "Tomato soup"), (1, 2, "Tomatoes, cherry"), (1, 3, "Cherry tomato"),
                                     (2, 1, "Oil, olive, salad or cooking"), (3, 1, "Eggs")], "key int, rn int, name string")
    got = {r.key: (r.rn, round(r.similarity, 2)) for r in plate.best_match(wanted, options, "key").collect()}
    assert got == {1: (2, 1.0), 3: (1, 1.0)}
