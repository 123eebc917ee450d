"""The published tables: dimension, resolved lines and the nutrition of a recipe with its coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillet.functions.ids import number_in
from skillet.functions.text import stratum


def clean_meta(meta: DataFrame) -> DataFrame:
    """(recipe_no, title, source_url, directions): the last row of each recipe, blank texts as null, directions in lower case.

    A recipe whose last row is marked as deleted is left out, and with it from all that is served.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    last = meta.where(number_in("recipe_id").isNotNull()).groupBy(number_in("recipe_id").alias("recipe_no")).agg(F.max(F.struct("ingested_at", "title", "source_url", "directions", "deleted_at")).alias("r"))
    return last.where("r.deleted_at is null").select("recipe_no", blank("r.title").alias("title"), blank("r.source_url").alias("source_url"), F.lower(blank("r.directions")).alias("directions"))


def clean_categories(categories: DataFrame) -> DataFrame:
    """(fdc_no, food_category): one row per food, blank categories as null; of several the greatest."""
    return categories.where(number_in("fdc_id").isNotNull()).groupBy(number_in("fdc_id").alias("fdc_no")).agg(F.max(F.nullif(F.trim("food_category"), F.lit(""))).alias("food_category"))


def canonical(foods: DataFrame, categories: DataFrame) -> DataFrame:
    """The food dimension with its category."""
    f = foods.select(number_in("fdc_id").alias("fdc_no"), "description_raw", "canonical_name", "category", "kcal_per_100g", "protein_g", "fat_g", "carb_g")
    return f.join(clean_categories(categories), "fdc_no", "left")


def entity_picks(entity_map: DataFrame) -> DataFrame:
    """One pick per string; rows of one string agree but for repetition."""
    return entity_map.where("normalized_text is not null").groupBy("normalized_text").agg(number_in(F.max("fdc_id")).alias("pick"), F.max("confidence").alias("confidence"), F.bool_or("flagged").alias("flagged"), F.bool_or("abstained").alias("abstained"))


def resolved(lines: DataFrame, entity_map: DataFrame, grams: DataFrame, foods: DataFrame) -> DataFrame:
    """Every distinct line with its food, weight and whether it counts for nutrition.

    The condition that the pick wasn't declined belongs to the join: a line
    whose food is unknown stays, without one.
    """
    l = lines.where(number_in("recipe_id").isNotNull()).select(number_in("recipe_id").alias("recipe_no"), "line_index", "normalized_text").distinct()  # noqa: E741
    g = grams.groupBy(number_in("recipe_id").alias("recipe_no"), "line_index").agg(F.max("grams").alias("grams"))
    f = foods.select(number_in("fdc_id").alias("fdc_no"), "kcal_per_100g", "protein_g", "fat_g", "carb_g")
    m = entity_picks(entity_map).withColumn("fdc_no", F.when(~F.coalesce("abstained", F.lit(False)), F.col("pick")))
    out = l.join(m.drop("pick"), "normalized_text", "left").join(g, ["recipe_no", "line_index"], "left").join(f, "fdc_no", "left")
    counts = F.col("fdc_no").isNotNull() & F.col("kcal_per_100g").isNotNull() & F.col("grams").isNotNull()
    return out.withColumn("contributes", counts)


def nutrition(lines: DataFrame) -> DataFrame:
    """Per recipe: totals over the contributing lines, densities, coverage and trust; one pass of filtered sums.

    Sums are taken over decimals, so that a total doesn't hang on the order of its lines.
    """
    on = F.col("contributes")
    weight = F.col("grams").cast("decimal(18,6)")
    part = lambda c: (F.sum(F.when(on, F.col(c).cast("decimal(10,4)") * weight)).cast("double") / 100)
    agg = lines.groupBy("recipe_no").agg(
        F.count("*").alias("n_lines"), F.count_if(on).alias("n_counted"), F.sum(F.when(on, weight)).cast("double").alias("total_grams"),
        part("kcal_per_100g").alias("total_kcal"), part("protein_g").alias("total_protein_g"), part("fat_g").alias("total_fat_g"), part("carb_g").alias("total_carb_g"),
        F.min(F.when(on, F.col("confidence"))).alias("min_confidence"),
    )
    coverage = F.try_divide(F.col("n_counted").cast("double"), F.col("n_lines"))
    per = [F.when(F.col("total_grams") > 0, F.round(F.col(f"total_{x}") / F.col("total_grams") * 100, 4)).alias(f"{x}_per_100g") for x in ("kcal", "protein_g", "fat_g", "carb_g")]
    totals = [F.col(c) for c in ("total_grams", "total_kcal", "total_protein_g", "total_fat_g", "total_carb_g")]
    return agg.select("recipe_no", "n_lines", "n_counted", *totals, *per, coverage.alias("coverage"), (F.coalesce("min_confidence", F.lit(0.0)) * coverage).alias("trust"))


def distinct_strings(lines: DataFrame) -> DataFrame:
    """(normalized_text, occurrence_count, frequency_stratum) of the lines: the working set that later steps resolve."""
    n = lines.where("normalized_text is not null").groupBy("normalized_text").agg(F.count("*").alias("occurrence_count"))
    return n.withColumn("frequency_stratum", stratum(F.col("occurrence_count")))
