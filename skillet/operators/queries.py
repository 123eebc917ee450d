"""Queries of the core's data operators on the project's tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillet.operators import nested, orphans, units
from skillet.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(spark, d, "raw_usda_foods"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return nested.link(nested.nodes(nested.latest_complete(table(spark, d, "raw_usda_foods"), "fdc_id", "raw_payload", "ingested_at")))


def p1_energy(spark: SparkSession, d: str) -> DataFrame:
    return nested.energy(nested.flat_table(_linked(spark, d), "nutrient"))


#: Of each flat table the columns that its query shows: name, column, whether it is a number.
FLAT = {
    "nutrient": (("number", "number", False), ("name", "name", False), ("amount", "amount", True), ("unit_name", "unitName", False)),
    "analysis": (("amount", "amount", True),),
    "acquisition": (("purchase_date", "purchaseDate", False), ("store_city", "storeCity", False)),
    "portion": (("amount", "amount", True), ("gram_weight", "gramWeight", True), ("modifier", "modifier", False), ("measure", "measureUnit_name", False)),
    "input": (("food_description", "foodDescription", False), ("input_description", "inputFood_description", False)),
    "input_nutrient": (("number", "number", False), ("name", "name", False), ("amount", "amount", True), ("unit_name", "unitName", False)),
}


def _flat(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = nested.flat_table(_linked(spark, d), kind)
        return t.select(F.col("doc").alias("fdc_id"), F.col("parent").alias("parent_id"), F.col("key").alias("child_id"), *[(F.col(c).try_cast("double") if number else F.col(c)).alias(n) for n, c, number in FLAT[kind]])

    return run


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.off_scale(table(spark, d, "recipe_ingredient_lines"), table(spark, d, "recipe_ingredient_grams"), table(spark, d, "gram_reference")).select("recipe_no", "line_index")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a stated amount and how many of them could be weighed, per unit."""
    rows = units.to_grams(table(spark, d, "recipe_ingredient_lines"), table(spark, d, "gram_reference"), [])
    return rows.groupBy("unit", "base").agg(F.count("*").alias("n_lines"), F.count("grams").alias("n_weighed"))


def _references(spark: SparkSession, d: str):
    return orphans.project_references(table(spark, d, "recipe_ingredient_lines"), table(spark, d, "recipe_meta"), table(spark, d, "usda_food_categories"), table(spark, d, "usda_foods"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(_references(spark, d)).select("table_name", "ref_id", "ref_month", "kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.per_table_and_month(orphans.orphans(_references(spark, d)))


_ORPHANS = """
WITH refs AS (
  SELECT 'recipe_ingredient_lines' AS table_name, try_cast(nullif(regexp_replace(recipe_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS ref_id, ingested_at AS at FROM recipe_ingredient_lines
  UNION ALL
  SELECT 'usda_food_categories', try_cast(nullif(regexp_replace(fdc_id, '[^0-9]', '', 'g'), '') AS BIGINT), ingested_at FROM usda_food_categories
), parents AS (
  SELECT 'recipe_ingredient_lines' AS table_name, try_cast(nullif(regexp_replace(recipe_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS ref_id, min(ingested_at) AS first_at, max(deleted_at) AS deleted_at FROM recipe_meta GROUP BY 1, 2
  UNION ALL
  SELECT DISTINCT 'usda_food_categories', try_cast(nullif(regexp_replace(fdc_id, '[^0-9]', '', 'g'), '') AS BIGINT), CAST(NULL AS TIMESTAMPTZ), CAST(NULL AS TIMESTAMPTZ) FROM usda_foods
), judged AS (
  SELECT r.table_name, r.ref_id, strftime(timezone('UTC', CAST(r.at AS TIMESTAMPTZ)), '%Y-%m') AS ref_month,
         CASE WHEN p.ref_id IS NULL THEN 'missing' WHEN p.first_at > r.at THEN 'late' WHEN p.deleted_at <= r.at THEN 'deleted' END AS kind
  FROM refs r LEFT JOIN parents p ON p.table_name = r.table_name AND p.ref_id = r.ref_id
  WHERE r.ref_id IS NOT NULL
)
"""

def _elements(value: str) -> str:
    """SQL for the objects that a field holds: a list, one object, or either of them written as text."""
    v = f"(CASE WHEN json_type({value}) = 'VARCHAR' AND json_valid({value} ->> '$') THEN CAST({value} ->> '$' AS JSON) ELSE {value} END)"
    return f"(CASE json_type({v}) WHEN 'ARRAY' THEN CAST({v} AS JSON[]) WHEN 'OBJECT' THEN [{v}] ELSE [] END)"


def _key(value: str) -> str:
    return f"try_cast(nullif(regexp_replace({value}, '[^0-9]', '', 'g'), '') AS BIGINT)"


def _level(name: str, source: str, parent: str, field: str, key: str) -> str:
    return f"""{name} AS (
  SELECT fdc_id, {parent} AS parent_id, {_key(f"o ->> '$.{key}'")} AS child_id, o, pos FROM (
    SELECT fdc_id, {parent}, unnest(list) AS o, generate_subscripts(list, 1) AS pos FROM (SELECT *, {_elements(field)} AS list FROM {source})
  ) WHERE json_type(o) = 'OBJECT'
)"""


_NESTED = f"""
WITH last AS (
  SELECT {_key("fdc_id")} AS fdc_id, CAST(arg_max(raw_payload, (coalesce(epoch_us(CAST(ingested_at AS TIMESTAMPTZ)), -4611686018427387904), raw_payload)) AS JSON) AS o
  FROM raw_usda_foods WHERE raw_payload IS NOT NULL AND json_valid(raw_payload) AND json_type(CASE WHEN json_valid(raw_payload) THEN raw_payload END) = 'OBJECT' AND {_key("fdc_id")} IS NOT NULL GROUP BY 1
), food AS (SELECT fdc_id, CASE WHEN json_type(o -> '$.food') = 'OBJECT' THEN o -> '$.food' ELSE o END AS o FROM last),
{_level("nutrient", "food", "fdc_id", "o -> '$.foodNutrients'", "id").replace("SELECT fdc_id, fdc_id, unnest", "SELECT fdc_id, unnest")},
{_level("analysis", "nutrient", "child_id", "o -> '$.nutrientAnalysisDetails'", "subSampleId")},
{_level("acquisition", "analysis", "child_id", "o -> '$.nutrientAcquisitionDetails'", "sampleUnitId")},
{_level("portion", "food", "fdc_id", "o -> '$.foodPortions'", "id").replace("SELECT fdc_id, fdc_id, unnest", "SELECT fdc_id, unnest")},
{_level("input", "food", "fdc_id", "o -> '$.inputFoods'", "id").replace("SELECT fdc_id, fdc_id, unnest", "SELECT fdc_id, unnest")},
{_level("input_nutrient", "input", "child_id", "o -> '$.inputFood.foodNutrients'", "id")}
"""
_PATHS = {"number": ("number", "nutrient.number"), "name": ("name", "nutrient.name"), "unitName": ("unitName", "nutrient.unitName"), "measureUnit_name": ("measureUnit.name",), "inputFood_description": ("inputFood.description",)}


def _flat_sql(kind: str) -> str:
    def column(c: str, number: bool) -> str:
        value = "coalesce(" + ", ".join(f"o ->> '$.{p}'" for p in _PATHS.get(c, (c,))) + ")"
        return f"try_cast({value} AS DOUBLE)" if number else value

    return _NESTED + f"SELECT fdc_id, parent_id, child_id, {', '.join(f'{column(c, number)} AS {n}' for n, c, number in FLAT[kind])} FROM {kind}"


_LEVELS = " UNION ALL ".join(f"SELECT fdc_id, '{k}' AS child_kind, parent_id, child_id FROM {k}" for k in FLAT)

QUERIES = {"p1_found": p1_found, "p1_energy": p1_energy, **{f"p1_{k}": _flat(k) for k in FLAT}, "p2_found": p2_found, "p2_coverage": p2_coverage, "p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p1_found": _NESTED + f"SELECT DISTINCT * FROM ({_LEVELS}) WHERE parent_id IS NOT NULL AND child_id IS NOT NULL",
    **{f"p1_{k}": _flat_sql(k) for k in FLAT},
    "p1_energy": _NESTED + """, energy AS (
  SELECT fdc_id, pos, coalesce(o ->> '$.number', o ->> '$.nutrient.number') AS number, try_cast(o ->> '$.amount' AS DOUBLE) AS amount FROM nutrient
)
SELECT fdc_id, arg_min(amount, (CASE number WHEN '208' THEN 1 WHEN '958' THEN 2 ELSE 3 END, pos)) AS kcal_per_100g FROM energy WHERE number IN ('208', '958', '957') AND amount IS NOT NULL GROUP BY 1
""",
    "p5_found": _ORPHANS + "SELECT DISTINCT table_name, ref_id, ref_month, kind FROM judged WHERE kind IS NOT NULL",
    "p5_report": _ORPHANS + "SELECT table_name, ref_month, kind, count(DISTINCT ref_id) AS n_refs, count(*) AS n_rows FROM judged WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
}
