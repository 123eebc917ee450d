import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skillet.functions import amounts, features, text
from skillet.operators import weights
from skillet.plans import guardrail

LINES = [
    ("1 c. firmly packed date sugar", 1.0, "cup", "date sugar"), ("2 1/2 c. thin sliced almond biscuits", 2.5, "cup", "thin almond biscuit"), ("3 (12 oz.) pkg. frozen spinach", 3.0, "package", "frozen spinach"),
    ("2/3 c. lard, cubed", 2 / 3, "cup", "lard"), ("4 tbsp. ghee or oil", 4.0, "tablespoon", "ghee"), ("1 small tin Smoked Sprats", 1.0, "tin", "smoked sprat"), ("3 medium leeks", 3.0, None, "leek"),
    ("pinch of mace", None, "pinch", "mace"), ("a dash of tabasco", 1.0, "dash", "tabasco"), ("zest of 2 limes", None, None, "zest of lime"), ("4 or 5 ripe plums or Greengage figs, pitted", 4.0, None, "ripe plum"),
    ("2 pkg. instant yeast (3 tsp.)", 2.0, "package", "instant yeast"), ("6 beaten yolks", 6.0, None, "yolk"), ("5 stalks celery, diced", 5.0, "stalk", "celery"), ("2 c. drained, crushed tomatoes", 2.0, "cup", "tomato"),
    ("9 oz. jar lime juice", 9.0, "ounce", "lime juice"), ("2 doz. mussels, cleaned", 2.0, "dozen", "mussel"), ("cumin and pepper to taste", None, None, "cumin and pepper"), ("2 lb. bag of rye flour", 2.0, "pound", "rye flour"),
    ("1 (9 oz.) pkg. frozen bean cuts", 1.0, "package", "frozen bean"), ("8-inch tart shell", 8.0, None, "inch tart shell"), ("2 pkg. ginger cookies, crushed", 2.0, "package", "ginger cookie"), ("3 cups cranberries", 3.0, "cup", "cranberry"),
    ("2 c. low-salt stock", 2.0, "cup", "low-salt stock"), ("2 to 3 lb. minced veal", 2.0, "pound", "veal"), ("4% kefir", None, None, "4% kefir"), ("1.5% kefir", None, None, "1.5% kefir"), ("2 T. ghee", 2.0, "tablespoon", "ghee"),
    ("2 t. mace", 2.0, "teaspoon", "mace"), ("0 yolks", None, None, "yolk"), ("2½ c. oats", 2.5, "cup", "oat"), ("", None, None, ""), (None, None, None, None), ("5", 5.0, None, ""), ("1/0 c. rye", None, "cup", "rye"),
]


def test_lines_and_their_names(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(LINES)], "k int, line string, q double, u string, n string")
    got = df.select("*", F.inline(F.array(amounts.parsed_line(F.col("line"), text.SIZE_WORDS)))).select("*", text.normal_name(F.col("ingredient_text")).alias("name")).orderBy("k").collect()
    assert [(r.line, r.quantity and round(r.quantity, 9), r.unit, r.name) for r in got] == [(r.line, r.q and round(r.q, 9), r.u, r.n) for r in got]


def test_normal_names_are_stable(spark):
    names = [("pound loaf mix", "pound loaf mix"), ("sliced or whole beets", "whole beet"), ("bay leaves", "bay leaf"), ("couscous", "couscous"), ("of ghee", "ghee"), ("tsp mace (to taste)", "mace"), ("cups", "cup"), (None, None), ("chopped", ""), ("large " * 400 + "eggs", "egg")]
    df = spark.createDataFrame(names, "t string, w string").select("t", "w", text.normal_name(F.col("t")).alias("n")).select("*", text.normal_name(F.col("n")).alias("again"))
    assert [(r.t, r.n, r.again) for r in df.collect()] == [(t, w, w) for t, w in names]


def test_servings(spark):
    said = [
        ("Roast 35 minutes. Serves 8.", 8), ("Serves 3 to 5.", 3), ("Makes around 7 helpings", 7), ("Yield: 14", 14), ("Yields four", 4), ("Makes 3 dozen buns.", 36), ("Makes 3 buns", 3), ("Makes 4 cakes.", None), ("Makes 3 small crusts", None),
        ("Yields 5 pints.", None), ("Makes 3 sheets", None), ("Yield: 2 1/2 dozen", 30), ("Makes about 5 1/3 cups", None), ("Serves 900", None), ("Serves 10-12 (as a side) people", 10), ("it serves nobody. Serves 3", 3), ("Servings: 8", 8), ("servings 8", None), ("Roast at 410.", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(said, "t string, w int").select("t", text.servings(F.col("t")).alias("n"))
    assert [(r.t, r.n) for r in df.collect()] == said


def test_portion_measures(spark):
    cases = [
        ("cup", "undetermined", "cup", None), ("tbsp", "undetermined", "tablespoon", None), ("cup, grated", "undetermined", "cup", "grated"), ("cup heaped", "undetermined", "cup", "heaped"), ("fl oz", "undetermined", "fluid_ounce", None),
        ("oz (18 halves)", "undetermined", "ounce", "18 halves"), ("jar (14 oz)", None, "jar", "14 oz"), ("cubic inch", "undetermined", "cubic_inch", None), (None, "milliliter", "milliliter", None), (None, "RACC", "racc", None),
        (None, "undetermined", None, None), (None, None, None, None), ("", "", None, None), ("fl oz cooked, hot", None, "fluid_ounce", "cooked, hot"),
    ]
    df = spark.createDataFrame(cases, "m string, u string, a string, b string").select("m", "u", weights.measure_of(F.col("m"), F.col("u")).alias("x"))
    assert [(r.m, r.u, r.x.measure, r.x.qualifier) for r in df.collect()] == cases
    w = spark.createDataFrame([("2", "50"), (None, "50"), ("0", "50"), ("1", "-3"), ("1", None)], "a string, g string").select(weights.portion_weight(F.col("a"), F.col("g")).alias("w"))
    assert [r.w for r in w.collect()] == [25.0, 50.0, None, None, None]


def test_weights_by_path(spark):
    portions = spark.createDataFrame([("flour", "cup", 125.0), ("flour", "tablespoon", 7.8), ("egg", "large", 50.0), ("egg", "small", 38.0), ("milk", "cup", 244.0), ("milk", "cup", None), ("nil", "cup", 0.0)], "thing string, measure string, grams double")
    cases = [
        ("2 lb. veal", 2.0, "pound", "x", 907.18474, "mass"), ("350 g oats", 350.0, "gram", "x", 350.0, "mass"), ("3 (16 oz.) pkg. frozen peas", 3.0, "package", "x", 1360.77711, "pack_size"), ("1 pkg. corn (16 oz.)", 1.0, "package", "x", 453.592372, "pack_size"),
        ("3 pkg. corn (16 oz.)", 3.0, "package", "x", 453.59237, "pack_size"), ("2 c. flour", 2.0, "cup", "flour", 250.0, "volumetric"), ("1 tbsp. flour", 1.0, "tablespoon", "flour", 7.8, "volumetric"), ("1 qt. milk", 1.0, "quart", "milk", 976.0, "volumetric_derived"),
        ("3 eggs", 3.0, None, "egg", 150.0, "count"), ("flour as liked", None, "cup", "flour", None, None), ("3 c. unknown", 3.0, "cup", "x", None, None), ("2 jars unknown", 2.0, "jar", "x", None, None), ("1 whole duck", 1.0, None, "milk", None, None),
        ("3 sprigs dill", 3.0, "sprig", "milk", None, None), ("1 c. nil", 1.0, "cup", "nil", None, None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, line_raw string, quantity double, unit string, thing string")
    got = {r.k: (r.grams and round(r.grams, 4), r.method) for r in weights.by_path(df, portions, ["k"]).collect()}
    assert got == {k: (c[4] and round(c[4], 4), c[5]) for k, c in enumerate(cases)}
    assert weights.by_path(df, portions.limit(0), ["k"]).count() == len(cases)


def test_features_of_pairs(spark):
    pairs = [("leek", "Leek, whole, raw", 1.0), ("leek", "Leekwort", 0.0), ("beet", "Beets, raw", 1.0), ("plums", "Plum, dried", 1.0), ("flour", "Rye flour, dark", 0.5), ("", "Leek, whole", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, w double")
    got = df.select("w", features.head_facet(F.col("a"), F.col("b")).alias("h"), features.plain_share(F.col("b")).alias("p"), features.jaro_winkler(F.col("a"), F.col("b")).alias("j"), features.jaccard(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.h for r in got] == [p[2] for p in pairs] and got[0].p == got[1].p == 1.0 and all(0 <= x <= 1 for r in got for x in (r.p, r.j, r.c))
    assert features.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and features.jaro_winkler_of("", "") == 1.0 and features.jaro_winkler_of("a", "") == 0.0


EGG = guardrail.Fact(guardrail.spellings("Egg Pie(Serves 12)", "r-1"), frozenset({4.0, 3.0}), frozenset({1834.0, 40.8}))
BEAN = guardrail.Fact(guardrail.spellings("Bean Egg Pie", "r-2"), frozenset({7.0}), frozenset({2615.0}))


@pytest.mark.parametrize("answer, checked, bad", [
    ("Egg Pie has 4 lines and 1,834 kcal.", 2, []), ("Egg Pie has about 1,840 kcal.", 1, []), ("Egg Pie has 5 lines.", 1, [5.0]), ("Egg Pie has 2,615 kcal.", 1, [2615.0]), ("Bean Egg Pie has 2615 kcal.", 1, []),
    ("Egg Pie and Bean Egg Pie have 1834 and 2615 kcal.", 2, []), ("Egg Pie is good. It has 1834 kcal.", 1, []), ("Egg Pie is good. It has 2615 kcal.", 1, [2615.0]), ("They have 1834 and 2615 kcal. Egg Pie is one.", 2, []),
    ("1. Egg Pie\n2. Bean Egg Pie\n", 2, []), ("Egg Pie(Serves 12) has 40.8 g", 1, []), ("Egg Pie serves 12.", 1, [12.0]), ("Egg Pie has 1,834-2,615 kcal.", 2, [2615.0]), ("egg pie: .5 or 0.5.", 2, [0.5]), ("", 0, []), ("No figures here.", 0, []),
])
def test_answers_are_held_to_their_recipe(answer, checked, bad):
    v = guardrail.check(answer, [EGG, BEAN])
    assert (v.checked, v.unsupported, v.passed) == (checked, bad, not bad)


def test_identifiers_and_retries():
    assert guardrail.numbers("dark 55-58% cocoa and 8888 rows", ("55-58% cocoa", "8888")) == [8888.0]
    assert guardrail.check("2 recipes", [EGG], exact=frozenset({2.0})).passed and not guardrail.check("2 recipes", [EGG]).passed
    asked = []
    answer, verdict, written = guardrail.guarded(lambda c: asked.append(c) or ("Egg Pie has 5 lines" if not c else "Egg Pie has 4 lines"), [EGG], "none")
    assert answer == "Egg Pie has 4 lines" and verdict.passed and written and "5" in asked[1]
    assert guardrail.guarded(lambda c: "9", [EGG], "plain")[::2] == ("plain", False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1e6).map(lambda x: round(x, 2)), max_size=6))
def test_every_figure_is_read(figures):
    assert guardrail.numbers(" and ".join(f"{f:,.2f}" for f in figures)) == figures
