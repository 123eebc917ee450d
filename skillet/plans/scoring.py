"""A model of which candidate is right, its honest scores and what it weighs; candidates made from words; the suite of table tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillet.functions.ids import number_in
from skillet.operators import candidates
from skillet.plans import evaluation, quality, stats
from skillet.session import durable
from skillet.session import table as T

FEATURES = ("jaccard", "jaro_winkler", "head_facet", "plain_share", "is_deprioritized", "margin")


def make_model(features: tuple[str, ...] = FEATURES, strength: float = 0.01):
    """Features brought to one scale, then a logistic regression in which both outcomes weigh alike (column ``weight``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol="label", weightCol="weight", regParam=strength),
    ])


def weighed(rows: DataFrame, target: str) -> DataFrame:
    """Rows with a known target as ``label``, and ``weight`` such that both labels weigh the same."""
    known = rows.where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))
    share = known.agg(F.avg("label").alias("_p"))
    return known.crossJoin(F.broadcast(share)).withColumn("weight", F.coalesce(F.try_divide(F.lit(0.5), F.when(F.col("label") == 1, F.col("_p")).otherwise(1 - F.col("_p"))), F.lit(1.0))).drop("_p")


def out_of_fold(rows: DataFrame, target: str, group: str, features: tuple[str, ...] = FEATURES, folds: int = 5) -> DataFrame:
    """``rows`` with a known target, ``fold`` and ``p``: each scored by a model that saw no row of its group. A fold without both outcomes to learn from gives the share of right ones."""
    from pyspark.ml.functions import vector_to_array

    known = durable(weighed(rows.fillna(0.0, list(features)), target).withColumn("fold", stats.fold_of(F.col(group), folds)))
    parts = []
    for k in range(folds):
        train, test = known.where(F.col("fold") != k), known.where(F.col("fold") == k)
        seen = train.agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).first()
        if seen.a and seen.b:
            scored = make_model(features).fit(train).transform(test).withColumn("p", vector_to_array("probability")[1])
        else:
            scored = test.withColumn("p", F.lit(1.0 if seen.a else 0.0))
        parts.append(scored.select(*known.columns, "p"))
    return reduce(DataFrame.unionByName, parts)


def coefficients(rows: DataFrame, target: str, features: tuple[str, ...] = FEATURES) -> list[tuple[str, float]]:
    """Features with their weight on one scale, the largest first."""
    fitted = make_model(features).fit(weighed(rows.fillna(0.0, list(features)), target))
    return sorted(zip(features, map(float, fitted.stages[-1].coefficients)), key=lambda x: (-abs(x[1]), x[0]))


def winners(scored: DataFrame, group: str, item: str, p: str = "p") -> DataFrame:
    """Per group the row of highest score, ties by item."""
    best = scored.groupBy(group).agg(F.min(F.struct((-F.col(p)).alias("s"), F.col(item), F.col("label"))).alias("m"), F.max("label").alias("reachable"))
    return best.select(group, F.col(f"m.{item}").alias(item), (-F.col("m.s")).alias(p), (F.col("m.label") == 1).alias("right"), (F.col("reachable") == 1).alias("reachable"))


def match_model(s: SparkSession, d: str) -> DataFrame:
    """Per fold the strings, those whose food is among the candidates, and those whose best candidate by out-of-fold score is right."""
    made = candidates_generated(s, d).select(F.col("normalized_text").alias("item"), number_in("fdc_id").cast("string").alias("label"), "cosine")
    scored = out_of_fold(evaluation.features_of(s, d, made), "target", "normalized_text")
    by = winners(scored, "normalized_text", "fdc_id").withColumn("fold", stats.fold_of(F.col("normalized_text")))
    return by.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("reachable").alias("n_reachable"), F.count_if("right").alias("n_right"))


def calibrated_scores(s: SparkSession, d: str) -> DataFrame:
    """Each labelled string's best score with the chance, by a non-decreasing curve, that its pick is right."""
    rows = evaluation.outcomes(s, d)
    curve = stats.isotonic(s, rows, "score", "good")
    from pyspark.ml.feature import VectorAssembler

    asked = VectorAssembler(inputCols=["score"], outputCol="features").transform(rows.select(F.col("item").alias("normalized_text"), "score"))
    return curve.transform(asked).select("normalized_text", "score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))), 9).alias("p"))


def candidates_generated(s: SparkSession, d: str) -> DataFrame:
    """Candidates of every distinct string, made from the words of strings and foods."""
    got = candidates.generate(T(s, d, "distinct_ingredient_strings"), "normalized_text", T(s, d, "usda_foods"), "fdc_id", "canonical_name")
    return got.select(F.col("name").alias("normalized_text"), "fdc_id", "from_words", "from_head", F.round("cosine", 6).alias("cosine"), "rank")


#: The suite: test, table, column, arguments.
SUITE = (
    ("not_null", "recipe_ingredient_lines", "recipe_id"), ("not_null", "recipe_ingredient_lines", "normalized_text"), ("not_null", "recipe_meta", "recipe_id"), ("not_null", "usda_foods", "fdc_id"),
    ("not_null", "usda_foods", "kcal_per_100g"), ("not_null", "usda_food_categories", "food_category"), ("not_null", "ingredient_entity_map", "fdc_id"), ("not_null", "distinct_ingredient_strings", "frequency_stratum"),
    ("unique", "usda_foods", "fdc_id"), ("unique", "usda_foods", "canonical_name"), ("unique", "documents", "doc_id"), ("unique", "recipe_meta", "recipe_id"), ("unique", "distinct_ingredient_strings", "normalized_text"),
    ("relationships", "ingredient_candidates", "fdc_id", "usda_foods", "fdc_id"), ("relationships", "ingredient_entity_map", "fdc_id", "usda_foods", "fdc_id"), ("relationships", "ingredient_entity_map", "normalized_text", "distinct_ingredient_strings", "normalized_text"),
    ("accepted_values", "distinct_ingredient_strings", "frequency_stratum", ["head", "mid", "tail"]), ("accepted_values", "recipe_ingredient_grams", "method", ["mass", "pack_size", "volumetric", "count"]),
    ("accepted_range", "usda_foods", "kcal_per_100g", 0, 910), ("accepted_range", "recipe_ingredient_grams", "grams", 0.01, 5000), ("accepted_range", "ingredient_candidates", "cosine_search", -1, 1), ("accepted_range", "ingredient_entity_map", "confidence", 0, 1),
)


def _suite(s: SparkSession, d: str) -> list[quality.Expectation]:
    out = []
    for test, t, column, *args in SUITE:
        if test == "relationships":
            args = [T(s, d, args[0]), args[1]]
        out.append(quality.Expectation(f"{test} {t}.{column}", getattr(quality, test)(T(s, d, t), column, *args)))
    return out


def dq_suite(s: SparkSession, d: str) -> DataFrame:
    """Every test of the suite with the number of rows (of keys for uniqueness) that violate it."""
    return reduce(DataFrame.unionByName, [e.violations.agg(F.lit(e.name).alias("test"), F.count("*").alias("n_violations")) for e in _suite(s, d)])


def _suite_sql() -> str:
    parts = []
    for test, t, c, *args in SUITE:
        where = {
            "not_null": lambda: f"FROM {t} WHERE {c} IS NULL",
            "unique": lambda: f"FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
            "relationships": lambda: f"FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {args[1]} FROM {args[0]} WHERE {args[1]} IS NOT NULL)",
            "accepted_values": lambda: f"FROM {t} WHERE {c} NOT IN ({', '.join(map(repr, args[0]))})",
            "accepted_range": lambda: f"FROM {t} WHERE {c} < {args[0]} OR {c} > {args[1]}",
        }[test]()
        parts.append(f"SELECT '{test} {t}.{c}' AS test, count(*) AS n_violations {where}")
    return " UNION ALL ".join(parts)


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[-,\s]+'), lambda w: w <> ''))"
QUERIES = {f.__name__: f for f in (match_model, calibrated_scores, candidates_generated, dq_suite)}
SQL = {
    "dq_suite": _suite_sql(),
    "candidates_generated": rf"""
WITH f AS (SELECT fdc_id, unnest({_WORDS.format("canonical_name")}) AS token, len({_WORDS.format("canonical_name")}) AS n FROM usda_foods),
idf AS (SELECT token, ln(1 + (SELECT count(*) FROM usda_foods)::DOUBLE / count(*)) AS w FROM f GROUP BY 1), fn AS (SELECT fdc_id, sqrt(sum(w * w)) AS norm FROM f JOIN idf USING (token) GROUP BY 1),
names AS (SELECT DISTINCT normalized_text FROM distinct_ingredient_strings WHERE normalized_text IS NOT NULL), t AS (SELECT normalized_text, unnest({_WORDS.format("normalized_text")}) AS token FROM names),
nn AS (SELECT normalized_text, sqrt(sum(w * w)) AS norm FROM t JOIN idf USING (token) GROUP BY 1),
dots AS (SELECT normalized_text, fdc_id, sum(w * w) AS dot FROM t JOIN idf USING (token) JOIN f USING (token) GROUP BY 1, 2),
scored AS (SELECT normalized_text, fdc_id, round(dot / (nn.norm * fn.norm), 9) AS cosine FROM dots JOIN nn USING (normalized_text) JOIN fn USING (fdc_id)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY normalized_text ORDER BY cosine DESC, fdc_id) AS r FROM scored) WHERE r <= 50),
block AS (SELECT normalized_text, fdc_id FROM (SELECT normalized_text, regexp_split_to_array(trim(lower(normalized_text)), '[-,\s]+')[-1] AS token FROM names) JOIN (SELECT token, fdc_id, row_number() OVER (PARTITION BY token ORDER BY n, fdc_id) AS place FROM f) USING (token) WHERE place <= 50),
both_ AS (SELECT coalesce(near.normalized_text, block.normalized_text) AS normalized_text, coalesce(near.fdc_id, block.fdc_id) AS fdc_id, near.fdc_id IS NOT NULL AS from_words, block.fdc_id IS NOT NULL AS from_head, cosine FROM near FULL JOIN block ON near.normalized_text = block.normalized_text AND near.fdc_id = block.fdc_id)
SELECT normalized_text, fdc_id, from_words, from_head, round(cosine, 6) AS cosine, CAST(row_number() OVER (PARTITION BY normalized_text ORDER BY cosine DESC NULLS LAST, fdc_id) - 1 AS INTEGER) AS rank FROM both_""",
}
