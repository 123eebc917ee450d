"""From sources to raw tables: recipes from CSV; foods, portions and categories from web answers kept as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillet.functions.ids import number_in
from skillet.sources import readers


def category_of(payload: Column) -> Column:
    """The category in a food's JSON: the description of foodCategory, foodCategory itself where it is a text, else brandedFoodCategory; empty if there is none."""
    own = F.get_json_object(payload, "$.foodCategory")
    text = F.nullif(F.trim(F.when(own.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(payload, "$.foodCategory.description"), F.lit(""))).otherwise(own)), F.lit(""))
    branded = F.when(own.rlike(r"^\s*\{"), F.lit(None)).otherwise(F.trim(F.get_json_object(payload, "$.brandedFoodCategory")))
    return F.coalesce(text, branded, F.lit(""))


def food_rows(payloads: DataFrame, source: str, at: Column | None = None) -> DataFrame:
    """(fdc_id, source, data_type, description, ingested_at, raw_payload) of JSON foods; what a payload lacks is empty."""
    field = lambda name: F.coalesce(F.get_json_object("raw_payload", f"$.{name}"), F.lit(""))
    return payloads.where("raw_payload is not null").select(field("fdcId").alias("fdc_id"), F.lit(source).alias("source"), field("dataType").alias("data_type"), field("description").alias("description"), (at if at is not None else F.current_timestamp()).alias("ingested_at"), "raw_payload")


def category_rows(payloads: DataFrame, source: str, at: Column | None = None) -> DataFrame:
    """(fdc_id, source, ingested_at, food_category) of JSON foods, one row per payload."""
    return payloads.where("raw_payload is not null").select(F.coalesce(F.get_json_object("raw_payload", "$.fdcId"), F.lit("")).alias("fdc_id"), F.lit(source).alias("source"), (at if at is not None else F.current_timestamp()).alias("ingested_at"), category_of(F.col("raw_payload")).alias("food_category"))


def portion_rows(fetched: DataFrame, source: str, at: Column | None = None) -> DataFrame:
    """(fdc_id, source, ingested_at, raw_payload) of (id, raw_payload) answers: the list of portions, empty where a food has none."""
    portions = F.coalesce(F.get_json_object("raw_payload", "$.foodPortions"), F.lit("[]"))
    return fetched.select(F.col("id").alias("fdc_id"), F.lit(source).alias("source"), (at if at is not None else F.current_timestamp()).alias("ingested_at"), portions.alias("raw_payload"))


def food_ids(foods: DataFrame) -> DataFrame:
    """The distinct ids that portions and categories are asked for, as plain numbers."""
    return foods.select(number_in("fdc_id").cast("string").alias("fdc_id")).where("fdc_id is not null").distinct()


def ingest(rows: DataFrame, path: str, least: int = 1) -> int:
    """Replace a raw table and tell its rows; fewer than ``least`` rows are refused, as a source that broke off would wipe the table."""
    n = rows.count()
    if n < least:
        raise ValueError(f"{n} rows for {path}; at least {least} are expected")
    readers.overwrite(rows, path)
    return n


def raw_recipes(spark: SparkSession, csv: str, path: str, least: int = 1) -> int:
    return ingest(readers.recipe_rows(spark, csv), path, least)
