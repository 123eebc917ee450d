"""The serving queries: ranked retrieval of recipes and a greedy plan under a budget."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PantryQuery:
    pantry: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    dish: str = ""
    max_kcal: float | None = None
    min_kcal: float | None = None
    min_coverage: float = 0.8
    limit: int = 8
    tags: tuple[str, ...] = ()


def term_pattern(term: str) -> str | None:
    """A pattern for a written term as a whole word with an optional s; None if nothing readable is left of it."""
    clean = " ".join(re.sub(r"[^a-z0-9 -]", " ", term.lower()).split())
    return rf"(?<![A-Za-z0-9_]){re.escape(clean)}s?(?![A-Za-z0-9_])" if clean else None


def retrieve(q: PantryQuery, lines: DataFrame, nutrition: DataFrame, meta: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(recipe_no, title, matched, missing, n_matched, coverage, total_kcal, trust), best first.

    Ranked by matched terms, trust and number of the recipe. A pantry of only
    unreadable terms finds nothing, an empty one all recipes. Patterns are
    constants of the plan, and the lines are read once for all of them. An active bound leaves out recipes whose value is null.
    Recipes that ``meta`` doesn't know aren't served. ``tags`` (recipe_no, tag): all of the asked ones must be there.
    """
    terms = {t: term_pattern(t) for t in dict.fromkeys(q.pantry)}
    known = {t: p for t, p in terms.items() if p}
    bad = [p for t in q.exclude if (p := term_pattern(t))]
    out = nutrition.where(F.col("coverage") >= q.min_coverage)
    if q.max_kcal is not None:
        out = out.where(F.col("total_kcal") <= q.max_kcal)
    if q.min_kcal is not None:
        out = out.where(F.col("total_kcal") >= q.min_kcal)
    if q.pantry and not known:
        out = out.limit(0)
    text = F.coalesce("normalized_text", F.lit(""))
    refused = text.rlike("|".join(bad)) if bad else F.lit(False)
    if known or bad:
        hit = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in known.items()]).cast("array<string>"))
        seen = lines.select("recipe_no", hit.alias("t"), refused.alias("bad")).where((F.size("t") > 0) | F.col("bad"))
        hits = seen.groupBy("recipe_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("t")))).alias("matched"), F.bool_or("bad").alias("bad"))
        out = out.join(hits, "recipe_no", "inner" if known else "left").where(~F.coalesce("bad", F.lit(False)))
        out = out.where(F.size("matched") > 0) if known else out.withColumn("matched", F.array().cast("array<string>"))
    else:
        out = out.withColumn("matched", F.array().cast("array<string>"))
    if q.tags and tags is not None:
        has = tags.where(F.col("tag").isin(*q.tags)).groupBy("recipe_no").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(set(q.tags)))
        out = out.join(has.select("recipe_no"), "recipe_no", "left_semi")
    out = out.join(meta.select("recipe_no", "title"), "recipe_no")
    for word in q.dish.split():
        if p := term_pattern(word):
            out = out.where(F.lower(F.coalesce("title", F.lit(""))).rlike(p))
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    out = out.select("recipe_no", "title", F.array_join("matched", ",").alias("matched"), F.array_join(F.array_sort(F.array_except(wanted, "matched")), ",").alias("missing"), F.size("matched").cast("bigint").alias("n_matched"), "coverage", "total_kcal", "trust")
    return out.orderBy(F.col("n_matched").desc(), F.col("trust").desc(), "recipe_no").limit(q.limit)


def query_of(payload: dict, known_tags: tuple[str, ...] = (), limit: int = 8, min_coverage: float = 0.8) -> PantryQuery:
    """A query from a parsed request: unknown tags and unreadable bounds are dropped; a request for a dish asks for no coverage."""
    words = lambda k: tuple(str(x).strip() for x in payload.get(k) or () if str(x).strip())

    def bound(k: str) -> float | None:
        try:
            return None if payload.get(k) is None else float(payload[k])
        except (TypeError, ValueError):
            return None

    dish = str(payload.get("dish") or "").strip()
    return PantryQuery(words("pantry"), words("exclude"), dish, bound("max_kcal"), bound("min_kcal"), 0.0 if dish else min_coverage, limit, tuple(t for t in words("tags") if t in known_tags))


def plan_week(recipes: DataFrame, budget: float, ceiling: float, days: int, cost: str = "cost") -> DataFrame:
    """(day, recipe_no, total_kcal, cost): the most caloric recipes under ``ceiling`` that the budget still affords.

    A budget only shrinks, so what was skipped never becomes affordable: each day takes the first recipe after the last
    one, by falling energy and number, that fits what is left. That is one aggregate per day, whatever the number of recipes.
    """
    rows = recipes.where((F.col("total_kcal") <= ceiling) & F.col(cost).isNotNull() & (F.col("total_kcal") > 0))
    key = F.struct(F.col("total_kcal").cast("double").alias("k"), (-F.col("recipe_no")).alias("no"), F.col(cost).cast("double").alias("cost"))
    chosen, left, part = [], budget, rows
    for day in range(1, days + 1):
        r = part.where(F.col(cost) <= left).agg(F.max(key)).first()[0]
        if r is None:
            break
        chosen.append((day, -r.no, r.k, r.cost))
        left -= r.cost
        part = rows.where((F.col("total_kcal") < r.k) | (F.col("total_kcal") == r.k) & (F.col("recipe_no") > -r.no))
    return recipes.sparkSession.createDataFrame(chosen, "day int, recipe_no bigint, total_kcal double, cost double")


def plan_faults(plan: DataFrame, budget: float, ceiling: float) -> list[str]:
    """What a plan breaks: its budget, the ceiling of a day, or that no recipe comes twice."""
    r = plan.agg(F.coalesce(F.sum("cost"), F.lit(0.0)), F.coalesce(F.max("total_kcal"), F.lit(0.0)), F.count("*") - F.countDistinct("recipe_no")).first()
    return [name for name, broken in (("budget", r[0] > budget + 1e-9), ("ceiling", r[1] > ceiling), ("repeated recipe", r[2] > 0)) if broken]
