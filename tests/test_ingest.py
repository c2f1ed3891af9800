"""Release archives rebuilt as small CSV folders."""

import datetime

import pytest
from pyspark.sql import functions as F

from larder.sources import archives, tables
from larder.sources.release import Release, ingest


def write(folder, name, header, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


NUTRIENTS = ("id,name,unit_name,nutrient_nbr,rank", '1003,Protein,G,203,600', '1004,Fat,G,204,800',
             '1005,"Carbohydrate, by difference",G,205,1110', '1050,"Carbohydrate, other",G,205.2,1120', '1093,"Sodium, Na",MG,307,5800')


@pytest.fixture
def releases(tmp_path):
    f = tmp_path / "foundation"
    write(f, "nutrient.csv", *NUTRIENTS)
    write(f, "food.csv", "fdc_id,data_type,description,food_category_id,publication_date",
          '1105073,foundation_food,"Bananas, overripe, raw",9,2020-10-30', '999999,sub_sample_food,Sample,9,2020-10-30')
    write(f, "food_category.csv", "id,code,description", "9,0900,Fruits and Fruit Juices")
    write(f, "food_nutrient.csv", "id,fdc_id,nutrient_id,amount", "1,1105073,1004,1.0", "2,1105073,1004,3.0",
          "3,1105073,1093,0", "4,999999,1004,9", "5,1105073,1003,")
    write(f, "measure_unit.csv", "id,name", "1119,Banana", "9999,undetermined")
    write(f, "food_portion.csv", "id,fdc_id,seq_num,amount,measure_unit_id,portion_description,modifier,gram_weight,data_points,footnote",
          "1,1105073,1,1.0,1119,,Peeled,115,4,", "2,1105073,2,2.0,1119,,,230,,", "3,999999,1,1.0,1119,,,9,,")
    write(f, "foundation_food.csv", "fdc_id,NDB_number,footnote", "1105073,100254,")
    write(f, "food_attribute_type.csv", "id,name", "1000,Common Name")
    write(f, "food_attribute.csv", "id,fdc_id,seq_num,food_attribute_type_id,name,value", "1,1105073,1,1000,n,plantain", "2,1105073,2,,onto,x")
    write(f, "input_food.csv", "id,fdc_id,fdc_of_input_food,seq_num,amount,ingredient_code,ingredient_description,unit,portion_description,gram_weight,retention_code",
          "1,1105073,999999,1,,,Banana sample,,,100,")
    s = tmp_path / "survey"
    write(s, "nutrient.csv", *NUTRIENTS)
    write(s, "food.csv", "fdc_id,data_type,description,food_category_id,publication_date", '2705384.0,survey_fndds_food,"Milk, NFS",,2024-10-31')
    write(s, "food_nutrient.csv", "id,fdc_id,nutrient_id,amount", "1,2705384,307,40", "2,2705384,205,5", "3,2705384,205.2,1")
    write(s, "measure_unit.csv", "id,name", "9999,undetermined")
    write(s, "food_portion.csv", "id,fdc_id,seq_num,amount,measure_unit_id,portion_description,modifier,gram_weight",
          "1,2705384,1,,9999,1 cup mashed,10205,244", "2,2705384,2,,9999,Quantity not specified,90000,244")
    write(s, "survey_fndds_food.csv", "fdc_id,food_code,wweia_category_number,start_date,end_date", "2705384,11100000,1002,2021-01-01,2023-12-31")
    write(s, "wweia_food_category.csv", "wweia_food_category,wweia_food_category_description", "1002,\"Milk, whole\"")
    write(s, "input_food.csv", "id,fdc_id,seq_num,amount,sr_code,sr_description,unit,portion_description,gram_weight,retention_code",
          "1,2705384,1,1,1077,\"Milk, whole\",C,,244,0")
    return [Release("foundation_food", "2024-04-18", str(f)), Release("survey_fndds_food", "2024-10-31", str(s))]


def test_ingest(spark, releases):
    out = ingest(spark, releases)
    foods = {r.fdc_id: r for r in out["foods"].collect()}
    assert set(foods) == {1105073, 2705384}
    banana, milk = foods[1105073], foods[2705384]
    assert (banana.food_category, banana.fat_g, banana.ndb_number, banana.source_version) == ("Fruits and Fruit Juices", 2.0, "100254", "2024-04-18")
    assert (milk.food_category, milk.food_code, milk.start_date) == ("Milk, whole", "11100000", datetime.date(2021, 1, 1))
    nutrients = {(r.fdc_id, r.nutrient_id): r.amount for r in out["nutrients"].collect()}
    assert nutrients == {(1105073, 1004): 2.0, (1105073, 1093): 0.0, (2705384, 1093): 40.0, (2705384, 1005): 5.0, (2705384, 1050): 1.0}
    portions = {r.fdc_id: r for r in out["portions"].collect()}
    assert (portions[1105073].measure_unit, portions[1105073].modifier, portions[1105073].data_points) == ("Banana", "Peeled", 4)
    assert (portions[2705384].measure_unit, portions[2705384].modifier, portions[2705384].portion_description) == (None, None, "1 cup mashed")
    assert out["portions"].count() == 2
    assert {r.attribute_type for r in out["attributes"].collect()} == {"Common Name", None}
    inputs = {r.fdc_id: r for r in out["input_foods"].collect()}
    assert inputs[1105073].fdc_of_input_food == 999999
    assert (inputs[2705384].ingredient_code, inputs[2705384].ingredient_description) == ("1077", "Milk, whole")


def test_first_release_wins_a_shared_food(spark, releases):
    twice = ingest(spark, [releases[0], Release("foundation_food", "2020-01-01", releases[0].folder)])
    assert [r.source_version for r in twice["foods"].collect()] == ["2024-04-18"]


def test_newest_archive_on_disk(spark, tmp_path):
    for version in ("2023-10-26", "2024-04-18"):
        (tmp_path / f"FoodData_Central_foundation_food_csv_{version}.zip").write_bytes(b"x")
    got = archives.newest_archives(archives.listed_files(spark, str(tmp_path), "*.zip")).collect()
    assert [(r.data_type, r.version) for r in got] == [("foundation_food", "2024-04-18")]


def test_publish_moves_the_pointer_last(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert tables.publish({"foods": spark.range(5)}, root, 1) == {"foods": 5}
    tables.publish({"foods": spark.range(7)}, root, 2)
    assert tables.open_catalog(spark, root, "foods").count() == 7
    assert {n: t["rows"] for n, t in tables.manifest(spark, root).items()} == {"foods": 7}
    assert tables.manifest(spark, root)["foods"]["schema"].names == ["id"]


def test_a_table_is_read_pruned_and_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id long, name string, other double").write.parquet(path)
    rows = tables.read_table(spark, path, "id long, name string", ["name"], F.col("id") > 1)
    assert [tuple(r) for r in rows.collect()] == [("b",)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,name:string>" in plan and "GreaterThan(id,1)" in plan
    for wrong in ("id int", "id long, gone string"):
        with pytest.raises(ValueError):
            tables.read_table(spark, path, wrong)


def test_repeating_a_run_does_not_append_twice(spark, tmp_path):
    path = str(tmp_path / "audit")
    first = spark.range(3).withColumn("run_id", F.lit("a"))
    tables.append_log(first, path)
    tables.append_log(spark.range(2).withColumn("run_id", F.lit("b")), path)
    tables.append_log(first, path)
    assert spark.read.parquet(path).count() == 5


def test_rules_reject_human_typed_rows(spark):
    rows = [("ok", None, None, None, 1.0), (" ", None, None, None, 1.0), ("b", -1.0, None, None, 1.0),
            ("c", None, "cup", None, 1.0), ("d", None, None, "x", 1.0), ("e", None, None, "🍗", -0.1)]
    df = spark.createDataFrame(rows, "name string, serving_g double, serving_label string, emoji string, carb_g double")
    good, bad = tables.split_by_rules(df, tables.custom_food_rules(["carb_g"]))
    assert [r.name for r in good.collect()] == ["ok"]
    assert {r.name: r.broken for r in bad.collect()} == {
        " ": ["name"], "b": ["serving_g"], "c": ["serving_label"], "d": ["emoji"], "e": ["carb_g"]}


def test_a_small_release_rewrites_few_buckets(spark, tmp_path):
    from larder.operators import changes
    from larder.sources.buckets import BucketTable

    table = BucketTable(spark, str(tmp_path), "id")
    rows = spark.range(5000).select("id", F.lit("old").alias("v"))
    table.create(rows, 32)
    stamps = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")}
    incoming = spark.createDataFrame([(7, "new"), (9000, "fresh")], "id long, v string")
    apply = lambda before, sent: changes.upsert(before, sent, "id", ["v"]).snapshot
    assert table.change(incoming, apply) <= 2
    written = [p for p in tmp_path.rglob("part-*") if p not in stamps]
    assert 1 <= len({p.parent for p in written}) <= 2
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    got = {r.id: r.v for r in table.read().collect()}
    assert len(got) == 5001 and got[7] == "new" and got[9000] == "fresh" and got[8] == "old"

    # a change that fails leaves the table as it was
    with pytest.raises(ZeroDivisionError):
        table.change(incoming, lambda before, sent: 1 / 0)
    assert table.read().count() == 5001
    for _ in range(6):
        table.change(incoming.withColumn("v", F.lit("again")), apply)
    assert {r.id: r.v for r in table.read().collect()}[7] == "again"
    assert len(list((tmp_path / "data").iterdir())) <= 5
    # all rows of a bucket can go
    assert table.change(spark.range(5000).toDF("id"), lambda before, keys: before.join(keys, "id", "left_anti")) == 32
    assert [r.id for r in table.read().collect()] == [9000]
