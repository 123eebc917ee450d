import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skillet.functions import amounts
from skillet.functions.ids import number_in
from skillet.operators import nested, orphans, units
from skillet.plans import quality, serving, stats


@pytest.mark.parametrize("line, thing, want", [
    ("2 cups flour", "flour", (2.0, None, "cups")), ("1 1/2 tbsp salt", "salt", (1.5, None, "tbsp")), ("1-1/2 lb. beef", "beef", (1.5, None, "lb")), ("2½ lb. water", "water", (2.5, None, "lb")),
    ("½ cup milk", "milk", (0.5, None, "cup")), ("2,5 l carrot", "carrot", (2.5, None, "l")), (".5 oz thyme", "thyme", (0.5, None, "oz")), ("one and a half ounces rice", "rice", (1.5, None, "ounces")),
    ("salt, 25 mg", "salt", (25.0, None, "mg")), ("lentils (2.0 litre)", "lentils", (2.0, None, "litre")), ("3 (14.5oz.) cans peas", "peas", (3.0, 14.5, "oz")), ("2 boxes (400 gr each) oats", "oats", (2.0, 400.0, "gr")),
    ("4 x 8 OZ CANS corn", "corn", (4.0, 8.0, "oz")), ("2 fl. oz. rum", "rum", (2.0, None, "fl oz")), ("2-3 cabbage", "cabbage", (None, None, None)), ("some garlic", "garlic", (None, None, None)), ("", "x", (None, None, None)), (None, "x", (None, None, None)),
])
def test_amounts(spark, line, thing, want):
    df = spark.createDataFrame([(line, thing)], "l string, t string").select(F.inline(amounts.amount_texts(F.col("l"), F.col("t"))))
    r = df.select(amounts.number_of(F.col("n")).alias("q"), amounts.number_of(F.col("size")).alias("s"), "form").first()
    assert (r.q, r.s, r.form) == want


def test_compositions_and_cycles():
    ways = units.compose(units.EDGES)
    assert abs(ways["gallon", "milliliter"][0] - 16 * units.CUP_ML) < 1e-9 and abs(ways["pound", "milligram"][0] - 453592.37) < 1e-6
    hot = units.compose([units.Edge("celsius", "kelvin", 1.0, 273.15), units.Edge("celsius", "fahrenheit", 1.8, 32.0)])
    scale, offset, steps = hot["fahrenheit", "kelvin"]
    assert abs(212 * scale + offset - 373.15) < 1e-9 and steps == 2
    assert not units.inconsistent(units.EDGES)
    assert units.inconsistent([units.Edge("a", "b", 2.0), units.Edge("b", "c", 2.0), units.Edge("a", "c", 5.0)])
    with pytest.raises(ValueError):
        units.compose([units.Edge("a", "b", 0.0)])


def test_off_scale(spark):
    lines = spark.createDataFrame([
        ("rcp-1", 0, "2 cups Flour", None, None, "Flour", "flour "), ("1", 0, "2 cups Flour", None, None, "Flour", "flour "), (" rcp-01", 1, "1 lb beef", 1.0, "pound", "beef", "beef"),
        (None, 2, "1 lb beef", 1.0, "pound", "beef", "beef"), ("rcp-2", 0, None, 3.0, "KG", None, "rye"), ("rcp-2", 1, "3 cups rye", 3.0, "cup", "rye", "rye"), ("x", 1, "3 cups rye", 3.0, "cup", "rye", "rye"),
    ], "recipe_id string, line_index long, line_raw string, quantity double, unit string, ingredient_text string, normalized_text string")
    grams = spark.createDataFrame([("rcp-1", 0, 240000.0), ("rcp-1", 0, 240000.0), ("rcp-1", 1, 460.0), ("rcp-2", 0, 3.0), ("rcp-2", 1, 9.0), ("rcp-1", 2, None)], "recipe_id string, line_index long, grams double")
    ref = spark.createDataFrame([("Flour", "1/2 cup", 60.0, None), ("flour", "tbsp", 0.2645, "ounces, from an old card"), ("rye", "cup", None, None), ("beef", "slice", float("nan"), "x")], "normalized_text string, unit string, grams_per_unit double, source_note string")
    assert sorted((r.recipe_no, r.line_index) for r in units.off_scale(lines, grams, ref).collect()) == [(1, 0), (2, 0)]
    assert units.off_scale(lines.limit(0), grams, ref).count() == 0 and units.off_scale(lines, grams, ref.limit(0)).count() == 1


def test_nested_intervals(spark):
    food = {"food": {"fdcId": "7", "foodNutrients": [{"id": 1, "number": 208, "amount": 5.0, "nutrientAnalysisDetails": {"subSampleId": "2", "nutrientAcquisitionDetails": json.dumps([{"sampleUnitId": 3}, None])}}, None], "foodPortions": {"id": 4, "amount": 1}, "inputFoods": [{"id": 5, "inputFood": {"foodNutrients": {"id": 6}}}]}}
    rows = [("7", json.dumps({"foodNutrients": [{"id": 99}]}), "2024-01-01"), ("7 ", json.dumps(food), "2024-02-01"), ("7", json.dumps(food)[:-9], "2024-03-01"), ("8", None, None), (None, "{}", None), ("9", "[1]", None), ("10", "", None)]
    raw = spark.createDataFrame(rows, "fdc_id string, raw_payload string, ingested_at string").withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withColumn("doc", F.lit(1))
    want = {(7, "nutrient", 7, 1), (7, "analysis", 1, 2), (7, "acquisition", 2, 3), (7, "portion", 7, 4), (7, "input", 7, 5), (7, "input_nutrient", 5, 6)}
    assert {tuple(r) for r in nested.found(raw).collect()} == want
    assert nested.found(raw.limit(0)).count() == 0
    linked = nested.link(nested.nodes(nested.latest_complete(raw, "fdc_id", "raw_payload", "ingested_at")))
    assert [tuple(r) for r in nested.energy(nested.flat_table(linked, "nutrient")).collect()] == [(7, 5.0)]
    # Objects without a key are nodes all the same, and so is what lies in them; keys of any size in a bigint are read.
    bare = {"foodNutrients": [{"number": "208", "amount": 5.0, "nutrientAnalysisDetails": [{"subSampleId": 2}]}, {"id": 9223372036854775807, "nutrient": {"number": "203"}}, {"id": 12.0}, {"nutrient": {"number": "204"}}]}
    linked = nested.link(nested.nodes(raw.limit(1).select("doc", F.lit(json.dumps(bare)).alias("payload"))))
    n = nested.flat_table(linked, "nutrient").orderBy("pre").collect()
    assert [(r.key, r.number) for r in n] == [(None, "208"), (2**63 - 1, "203"), (12, None), (None, "204")]
    one = nested.flat_table(linked, "analysis").first()
    assert (one.key, one.parent, one.parent_pre) == (2, None, n[0].pre)
    assert nested.found(raw.limit(1).withColumn("raw_payload", F.lit(json.dumps(bare)))).count() == 2
    deep = "".join('{"a":' for _ in range(300)) + "1" + "}" * 300
    assert nested.found(raw.limit(1).withColumn("raw_payload", F.lit(deep))).count() == 0


def test_orphans(spark):
    ts = lambda c: F.col(c).cast("timestamp")
    child = spark.createDataFrame([("rcp-1", "2024-03-05"), ("RCP_01", "2024-01-05"), ("2", "2024-03-05"), ("3", "2024-03-05"), ("3", "2024-03-06"), (None, "2024-03-05"), ("none", "2024-03-05"), ("4", None)], "recipe_id string, ingested_at string").withColumn("ingested_at", ts("ingested_at"))
    parent = spark.createDataFrame([("rcp-1", "2024-02-01", None), ("1", "2024-04-01", None), ("2", "2024-01-01", "2024-03-05")], "recipe_id string, ingested_at string, deleted_at string").select("recipe_id", ts("ingested_at").alias("ingested_at"), ts("deleted_at").alias("deleted_at"))
    r = orphans.Reference("t", child, number_in("recipe_id"), "ingested_at", parent, number_in("recipe_id"), "ingested_at", "deleted_at")
    got = {(x.ref_id, x.ref_month, x.kind, x.n) for x in orphans.orphans([r]).collect()}
    assert got == {(1, "2024-01", "late", 1), (2, "2024-03", "deleted", 1), (3, "2024-03", "missing", 2), (4, None, "missing", 1)}
    assert {(x.ref_id, x.ref_month, x.kind, x.n) for x in orphans.orphan_rows(r, broadcast_limit=0, salts=3).collect()} == got
    empty = orphans.Reference("t", child.limit(0), number_in("recipe_id"), "ingested_at", parent.limit(0), number_in("recipe_id"), "ingested_at", "deleted_at")
    assert orphans.orphan_rows(empty).count() == 0


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (None, 2000.0)], "k int, v double")
    assert quality.not_null(df, "k").count() == 1 and quality.unique(df, "k").count() == 1 and quality.accepted_range(df, "v", 0, 910).count() == 1
    assert quality.accepted_values(df, "k", [2]).count() == 2 and quality.relationships(df, "k", df.where("k is null"), "k").count() == 2
    with pytest.raises(quality.GateFailure):
        quality.gate([quality.Expectation("kcal", quality.accepted_range(df, "v", 0, 910))])
    assert quality.fingerprint(df) == quality.fingerprint(df.orderBy(F.desc("v"))) != quality.fingerprint(df.limit(2))


def test_serving_and_stats(spark):
    lines = spark.createDataFrame([(1, "sea salt"), (1, "eggs"), (2, "salts"), (2, "peanut"), (3, "salty")], "recipe_no long, normalized_text string")
    n = spark.createDataFrame([(1, 1.0, 500.0, 0.5), (2, 0.9, None, 0.9), (3, 1.0, 9.0, 0.1)], "recipe_no long, coverage double, total_kcal double, trust double")
    meta = spark.createDataFrame([(1, "Egg pie"), (2, None)], "recipe_no long, title string")
    ask = lambda **k: [r.recipe_no for r in serving.retrieve(serving.PantryQuery(**k), lines, n, meta).collect()]
    assert ask(pantry=("salt", "egg")) == [1, 2] and ask(pantry=("salt",), max_kcal=900) == [1] and ask(pantry=("???",)) == [] and ask() == [2, 1] and ask(exclude=("peanut",), dish="egg") == [1] and ask(exclude=("peanut",)) == [1]
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "recipe_no long, tag string")
    assert [r.recipe_no for r in serving.retrieve(serving.PantryQuery(tags=("a", "b", "a")), lines, n, meta, tags).collect()] == [1]
    q = serving.query_of({"pantry": [" eggs ", ""], "dish": "pie", "max_kcal": "x", "min_kcal": 3, "tags": ["a", "z"]}, ("a",))
    assert q.pantry == ("eggs",) and q.min_coverage == 0.0 and q.max_kcal is None and q.min_kcal == 3.0 and q.tags == ("a",)
    low, high = stats.wilson(F.lit(27), F.lit(30))
    r = spark.range(1).select(F.round(low, 4), F.round(high, 4)).first()
    assert tuple(r) == (0.7438, 0.9654)
    pairs = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2, "a boolean, b boolean")
    assert stats.mcnemar(pairs, "a", "b") == (8, 2, pytest.approx(0.109375))
    b = stats.bootstrap(spark.range(100).withColumn("v", F.col("id") % 2), "v", draws=400).first()
    assert b["mean"] == 0.5 and 0.35 < b["low"] < 0.5 < b["high"] < 0.65
    plan = serving.plan_week(spark.createDataFrame([(k, float(k), 10.0 if k != 5 else 40.0) for k in range(1, 9)] + [(9, 6.0, 5.0), (10, None, 1.0), (11, 3.0, None)], "recipe_no long, total_kcal double, cost double"), 38.0, 6.0, 7)
    assert [r.recipe_no for r in plan.orderBy("day").collect()] == [6, 9, 4, 3]
    assert serving.plan_faults(plan, 38.0, 6.0) == [] and serving.plan_faults(plan.unionByName(plan), 38.0, 5.0) == ["budget", "ceiling", "repeated recipe"]
