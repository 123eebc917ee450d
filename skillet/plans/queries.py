"""Queries of the relational plans on the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillet.functions import text
from skillet.functions.answers import last_answers, majority
from skillet.functions.ids import number_in
from skillet.operators.candidates import head_noun_index
from skillet.plans import gold, quality, serving, stats
from skillet.plans.evaluation import ANSWERS_SQL
from skillet.session import durable
from skillet.session import table as T
from skillet.sources import ingest, readers

_NO = "try_cast(nullif(regexp_replace({}, '[^0-9]', '', 'g'), '') AS BIGINT)"
_R, _F = _NO.format("recipe_id"), _NO.format("fdc_id")


def _resolved(s, d):
    return gold.resolved(T(s, d, "recipe_ingredient_lines"), T(s, d, "ingredient_entity_map"), T(s, d, "recipe_ingredient_grams"), T(s, d, "usda_foods"))


_RESOLVED = f"""
WITH lines AS (SELECT DISTINCT {_R} AS recipe_no, line_index, normalized_text FROM recipe_ingredient_lines WHERE {_R} IS NOT NULL),
picks AS (SELECT normalized_text, {_NO.format("max(fdc_id)")} AS pick, max(confidence) AS confidence, bool_or(flagged) AS flagged, bool_or(abstained) AS abstained FROM ingredient_entity_map WHERE normalized_text IS NOT NULL GROUP BY 1),
grams AS (SELECT {_R} AS recipe_no, line_index, max(grams) AS grams FROM recipe_ingredient_grams GROUP BY 1, 2),
foods AS (SELECT {_F} AS fdc_no, kcal_per_100g, protein_g, fat_g, carb_g FROM usda_foods),
resolved AS (
  SELECT f0.fdc_no, l.normalized_text, l.recipe_no, l.line_index, p.confidence, p.flagged, p.abstained, g.grams, f.kcal_per_100g, f.protein_g, f.fat_g, f.carb_g,
         f0.fdc_no IS NOT NULL AND f.kcal_per_100g IS NOT NULL AND g.grams IS NOT NULL AS contributes
  FROM lines l LEFT JOIN picks p ON p.normalized_text = l.normalized_text
  LEFT JOIN grams g ON g.recipe_no = l.recipe_no AND g.line_index = l.line_index,
  LATERAL (SELECT CASE WHEN NOT coalesce(p.abstained, false) THEN p.pick END AS fdc_no) f0
  LEFT JOIN foods f ON f.fdc_no = f0.fdc_no
)
"""
_NUTRITION = _RESOLVED + """, nutrition AS (
  SELECT recipe_no, count(*) AS n_lines, count(*) FILTER (WHERE contributes) AS n_counted, sum(grams::DECIMAL(18,6)) FILTER (WHERE contributes)::DOUBLE AS g,
    sum(kcal_per_100g::DECIMAL(20,4) * grams::DECIMAL(18,6)) FILTER (WHERE contributes)::DOUBLE / 100 AS kcal, sum(protein_g::DECIMAL(20,4) * grams::DECIMAL(18,6)) FILTER (WHERE contributes)::DOUBLE / 100 AS protein,
    sum(fat_g::DECIMAL(20,4) * grams::DECIMAL(18,6)) FILTER (WHERE contributes)::DOUBLE / 100 AS fat, sum(carb_g::DECIMAL(20,4) * grams::DECIMAL(18,6)) FILTER (WHERE contributes)::DOUBLE / 100 AS carb, min(confidence) FILTER (WHERE contributes) AS c
  FROM resolved GROUP BY 1
), rolled AS (
  SELECT recipe_no, n_lines, n_counted, g AS total_grams, kcal AS total_kcal, protein AS total_protein_g, fat AS total_fat_g, carb AS total_carb_g,
    CASE WHEN g > 0 THEN round(kcal / g * 100, 4) END AS kcal_per_100g, CASE WHEN g > 0 THEN round(protein / g * 100, 4) END AS protein_g_per_100g,
    CASE WHEN g > 0 THEN round(fat / g * 100, 4) END AS fat_g_per_100g, CASE WHEN g > 0 THEN round(carb / g * 100, 4) END AS carb_g_per_100g,
    n_counted::DOUBLE / n_lines AS coverage, coalesce(c, 0) * (n_counted::DOUBLE / n_lines) AS trust
  FROM nutrition
)
"""


def lines_resolved(s: SparkSession, d: str) -> DataFrame:
    return _resolved(s, d).select("recipe_no", "line_index", "fdc_no", "confidence", "flagged", "abstained", "grams", "contributes")


def _nutrition(s, d):
    return gold.nutrition(_resolved(s, d))


def nutrition_rollup(s: SparkSession, d: str) -> DataFrame:
    return _nutrition(s, d).select("recipe_no", "n_lines", "n_counted", "coverage", "trust", "total_grams", F.round("total_kcal", 1).alias("total_kcal"), "kcal_per_100g")


def canonical_dim(s: SparkSession, d: str) -> DataFrame:
    return gold.canonical(T(s, d, "usda_foods"), T(s, d, "usda_food_categories"))


def recipe_meta_clean(s: SparkSession, d: str) -> DataFrame:
    return gold.clean_meta(T(s, d, "recipe_meta")).select("recipe_no", "title", "directions")


def category_nullif(s: SparkSession, d: str) -> DataFrame:
    return gold.clean_categories(T(s, d, "usda_food_categories"))


def distinct_strings_strata(s: SparkSession, d: str) -> DataFrame:
    return gold.distinct_strings(T(s, d, "recipe_ingredient_lines"))


def facets_search_text(s: SparkSession, d: str) -> DataFrame:
    raw = F.col("description_raw")
    return T(s, d, "usda_foods").select("fdc_id", text.canonical_name(raw).alias("canonical_name"), text.search_text(raw).alias("search_text"), text.category(raw).alias("category"))


def deprioritized(s: SparkSession, d: str) -> DataFrame:
    """Whether a food is of a category that recipes hardly mean, or a brand; the catalogue's descriptions, and those of the raw records that name brands."""
    raw = T(s, d, "raw_usda_foods").where("description is not null").select(F.col("description").alias("description_raw"))
    rows = T(s, d, "usda_foods").select("description_raw").unionByName(raw).distinct()
    return rows.select("description_raw", text.is_deprioritized(F.col("description_raw")).alias("is_deprioritized"))


def resolve_top1(s: SparkSession, d: str) -> DataFrame:
    """The best candidate per string, flagged and declined by its score."""
    c = T(s, d, "ingredient_candidates").where("cosine_search is not null and not isnan(cosine_search)")
    best = c.groupBy("normalized_text").agg(F.min(F.struct((-F.col("cosine_search")).alias("k"), F.col("fdc_id"))).alias("m"))
    score = -F.col("m.k")
    return best.select("normalized_text", F.col("m.fdc_id").alias("fdc_id"), score.alias("cosine"), (score < 0.40).alias("flagged"), (score < 0.644).alias("abstained"))


def entity_map_join(s: SparkSession, d: str) -> DataFrame:
    """Every string with its best candidate; one whose food the catalogue lacks stays, without a description. ``dq_unknown_foods`` reports these."""
    strings = T(s, d, "distinct_ingredient_strings").where("normalized_text is not null").groupBy("normalized_text").agg(F.max("occurrence_count").alias("occurrence_count"))
    foods = T(s, d, "usda_foods").select("fdc_id", "description_raw", "kcal_per_100g")
    return strings.join(resolve_top1(s, d), "normalized_text").join(foods, "fdc_id", "left")


def candidate_union(s: SparkSession, d: str) -> DataFrame:
    """One row per pair with what found it, ranked anew."""
    c = T(s, d, "ingredient_candidates")
    score = F.max(F.when(~F.isnan("cosine_search"), F.col("cosine_search")))
    pairs = c.groupBy("normalized_text", "fdc_id").agg(*[F.bool_or(f).alias(f) for f in ("from_embed_search", "from_embed_desc", "from_token_head")], score.alias("cosine"))
    order = Window.partitionBy("normalized_text").orderBy(F.col("cosine").desc_nulls_last(), "fdc_id")
    return pairs.withColumn("rank", F.row_number().over(order) - 1)


def head_noun_block(s: SparkSession, d: str) -> DataFrame:
    return head_noun_index(T(s, d, "usda_foods"), "fdc_id", "canonical_name")


def topk_cosine(s: SparkSession, d: str, block: int = 20_000) -> DataFrame:
    """The five nearest of all vectors for every twentieth one: exact, in matrix products, ties by vec_id.

    The queries are asked in blocks of about ``block`` vectors, which bounds what is broadcast; each task
    keeps its five best per query before the shuffle, and all that tie with the last of them.
    """
    import numpy as np
    import pandas as pd

    v = T(s, d, "embeddings").where("embedding is not null")
    asked = v.where("vec_id % 20 = 0").select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // block))

    def ask(k: int) -> DataFrame:
        q = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).toPandas()
        ids = q["vec_id"].to_numpy()
        m = np.stack(q["embedding"].to_numpy()).astype(np.float64) if len(q) else np.zeros((0, 1))
        sent = s.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)))

        def run(batches):
            ids, m = sent.value
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                other = b["vec_id"].to_numpy()
                for at in range(0, len(ids), 512):
                    sim = m[at : at + 512] @ x.T
                    sim[ids[at : at + 512, None] == other[None, :]] = -2.0
                    k = min(5, sim.shape[1])
                    last = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
                    rows, cols = np.nonzero((sim >= last[:, None] - 1e-12) & (sim > -2))
                    # Of exact copies only the five of smallest id can come first.
                    order = np.lexsort((other[cols], -np.round(sim[rows, cols], 12), rows))
                    rows, cols = rows[order], cols[order]
                    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    rows, cols = rows[rank < 5], cols[rank < 5]
                    yield pd.DataFrame({"query_id": ids[at + rows], "vec_id": other[cols], "cosine": sim[rows, cols]})

        return v.select("vec_id", "embedding").mapInPandas(run, "query_id bigint, vec_id bigint, cosine double")

    near = ask(0)
    for k in range(1, blocks):
        near = near.unionByName(ask(k))
    order = Window.partitionBy("query_id").orderBy(F.round("cosine", 12).desc(), "vec_id")
    return near.withColumn("place", F.row_number().over(order)).where("place <= 5").select("query_id", "vec_id", "place", F.round("cosine", 5).alias("cosine"))


def majority_vote(s: SparkSession, d: str) -> DataFrame:
    """The answer with most votes per string, one vote per annotator; null on a tie."""
    won = majority(last_answers(T(s, d, "ensemble"), "normalized_text", "annotator", "fdc_id", "judged_at"))
    return won.select(F.col("item").alias("normalized_text"), F.col("label").alias("winner"), "votes")


def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    """Share of strings whose majority answer is among the first k candidates."""
    gold_id = majority_vote(s, d).where("winner is not null and winner <> 'none'").select("normalized_text", F.col("winner").alias("fdc_id"))
    ranked = candidate_union(s, d).groupBy("normalized_text", number_in("fdc_id").cast("string").alias("fdc_id")).agg(F.min("rank").alias("rank"))
    hit = gold_id.join(ranked, ["normalized_text", "fdc_id"], "left")
    return hit.select(F.explode(F.array(*[F.lit(k) for k in (5, 10, 25, 50)])).alias("k"), "rank").groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("rank") < F.col("k")).cast("double"), F.lit(0.0))), 6).alias("recall"))


def wilson_ci(s: SparkSession, d: str) -> DataFrame:
    by = T(s, d, "ingredient_entity_map").where("frequency_stratum is not null").groupBy("frequency_stratum").agg(F.count("*").alias("n"), F.count_if("flagged").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return by.select("frequency_stratum", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def stratified_rate(s: SparkSession, d: str) -> DataFrame:
    """The flagged share per string and per occurrence, weighted by the strata of all strings."""
    strata = F.lower(F.trim("frequency_stratum")).alias("stratum")
    totals = T(s, d, "distinct_ingredient_strings").where("frequency_stratum is not null").groupBy(strata).agg(F.count("*").alias("strings"), F.sum("occurrence_count").alias("uses"))
    rates = T(s, d, "ingredient_entity_map").where("frequency_stratum is not null").groupBy(strata).agg(F.avg(F.col("flagged").cast("double")).alias("rate"), F.try_divide(F.sum(F.col("flagged").cast("double") * F.col("occurrence_count")), F.sum("occurrence_count")).alias("use_rate"))
    return totals.join(rates, "stratum").agg(F.round(F.sum(F.col("rate") * F.col("strings")) / F.sum("strings"), 6).alias("per_string"), F.round(F.sum(F.col("use_rate") * F.col("uses")) / F.sum("uses"), 6).alias("per_use"))


def error_bands(s: SparkSession, d: str) -> DataFrame:
    """Energy of the earlier pick against that of the best candidate, in bands of relative error."""
    e = T(s, d, "ingredient_entity_map").where("normalized_text is not null").groupBy("normalized_text").agg(F.max("kcal_per_100g").alias("a"))
    b = entity_map_join(s, d).select("normalized_text", F.col("kcal_per_100g").alias("b"))
    err = stats.error(F.col("a"), F.col("b"))
    return e.join(b, "normalized_text").where(err.isNotNull()).groupBy(stats.band(err).alias("band")).agg(F.count("*").alias("n"))


def ambiguity(s: SparkSession, d: str) -> DataFrame:
    """Spread of energy among the foods of one category word."""
    f = T(s, d, "usda_foods").where("kcal_per_100g is not null").groupBy("category").agg(F.count("*").alias("n"), F.min("kcal_per_100g").alias("lo"), F.max("kcal_per_100g").alias("hi"))
    return f.where("n >= 2").select("category", "n", F.round(F.try_divide(F.col("hi") - F.col("lo"), F.col("hi")), 6).alias("spread"))


def abstain_sweep(s: SparkSession, d: str) -> DataFrame:
    m = T(s, d, "ingredient_entity_map").select(F.round("cosine", 2).alias("score"), F.col("fdc_id").isNull().alias("empty"))
    return stats.sweep(m, "score", "empty").select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


PANTRY = serving.PantryQuery(pantry=("salt", "butter", "garlic"), exclude=("onion",), min_coverage=0.2, limit=20)


_PUBLISHED: dict = {}


def published(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, nutrition, meta) as the serving side reads them: built once per session and source, then read from where they were written."""
    key = (s.sparkContext.applicationId, d)
    if key not in _PUBLISHED:
        lines = durable(_resolved(s, d).select("recipe_no", "normalized_text", "contributes", "confidence", "grams", "kcal_per_100g", "protein_g", "fat_g", "carb_g"))
        _PUBLISHED[key] = (durable(lines.select("recipe_no", "normalized_text").distinct().coalesce(8)), durable(gold.nutrition(lines).coalesce(8)), durable(gold.clean_meta(T(s, d, "recipe_meta")).select("recipe_no", "title").coalesce(8)))
    return _PUBLISHED[key]


def retrieval_ranked(s: SparkSession, d: str) -> DataFrame:
    """A pantry question asked of the published tables."""
    return serving.retrieve(PANTRY, *published(s, d)).select("recipe_no", "title", "matched", "missing", "n_matched", "coverage", "trust")


def planner_greedy(s: SparkSession, d: str) -> DataFrame:
    """A week of recipes under 2,000 kcal whose weight together stays within nine kilograms."""
    _, n, _ = published(s, d)
    rows = n.where("coverage >= 0.5").select("recipe_no", F.bround("total_kcal", 0).alias("total_kcal"), F.bround("total_grams", 0).alias("cost"))
    return serving.plan_week(rows, 9_000.0, 2_000.0, 7).select("day", "recipe_no", "total_kcal", "cost")


def dq_not_null(s, d):
    return quality.not_null(T(s, d, "recipe_ingredient_lines"), "recipe_id").select("line_index", "line_raw")


def dq_unique(s, d):
    return quality.unique(T(s, d, "recipe_meta"), "recipe_id")


def dq_unique_line(s, d):
    return quality.unique(T(s, d, "recipe_ingredient_lines"), "recipe_id", "line_index")


def dq_relationships(s, d):
    return quality.relationships(T(s, d, "ingredient_candidates").select("fdc_id").distinct(), "fdc_id", T(s, d, "usda_foods"), "fdc_id")


def dq_unknown_foods(s, d):
    """Best candidates that the catalogue lacks: a build of the entity map stops on any."""
    return entity_map_join(s, d).where("description_raw is null").select("normalized_text", "fdc_id")


def dq_accepted_values(s, d):
    return quality.accepted_values(T(s, d, "distinct_ingredient_strings"), "frequency_stratum", ["head", "mid", "tail"]).select("normalized_text", "frequency_stratum")


def dq_accepted_range(s, d):
    return quality.accepted_range(T(s, d, "recipe_ingredient_grams"), "grams", 0.01, 5000).select("recipe_id", "line_index", "grams")


# What the published tables are expected to hold.
DRIFT = {
    "mean kcal per 100 g": (150.0, 350.0), "median total grams": (300.0, 1500.0), "p99 total grams": (2000.0, 7000.0), "mean coverage": (0.45, 0.75),
    "share with any nutrition": (0.85, 1.0), "mean trust": (0.20, 0.55), "share of complete recipes": (0.02, 0.15), "share of weighed lines": (0.55, 0.72), "hours since last line": (0.0, 720.0),
}


def drift_expectations(s: SparkSession, d: str) -> DataFrame:
    """Nine scalars of the published tables against the ranges they are expected in; a null value fails.

    Freshness is taken against the last time that any table knows, so that a run can be repeated.
    """
    lines = _resolved(s, d)
    n = gold.nutrition(lines)
    heavy = F.when(F.col("total_grams") > 0, F.col("total_grams"))
    a = n.agg(
        F.avg("kcal_per_100g"), F.median(heavy), F.percentile(heavy, 0.99), F.avg("coverage"), F.try_divide(F.count_if(F.col("coverage") > 0).cast("double"), F.count("*")),
        F.avg("trust"), F.try_divide(F.count_if(F.col("coverage") == 1).cast("double"), F.count("*")),
    )
    weighed = lines.agg(F.try_divide(F.count("grams").cast("double"), F.count("*")))
    last = T(s, d, "recipe_ingredient_lines").agg(F.max("ingested_at").alias("l")).crossJoin(T(s, d, "recipe_meta").agg(F.max("ingested_at").alias("m")))
    hours = last.select((F.floor(F.unix_seconds(F.greatest("l", "m").cast("timestamp")) / 3600) - F.floor(F.unix_seconds(F.col("l").cast("timestamp")) / 3600)).cast("double"))
    named = a.toDF(*list(DRIFT)[:7]).crossJoin(weighed.toDF(list(DRIFT)[7])).crossJoin(hours.toDF(list(DRIFT)[8]))
    rows = F.array(*[F.struct(F.lit(k).alias("expectation"), F.round(F.col(f"`{k}`"), 4).alias("value"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for k, (lo, hi) in DRIFT.items()])
    return named.select(F.inline(rows)).select("expectation", "value", F.coalesce((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")), F.lit(False)).alias("ok"))


def coverage_by_class(s: SparkSession, d: str) -> DataFrame:
    g = T(s, d, "recipe_ingredient_grams")
    return g.groupBy(F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"), F.count_if("converted").alias("n_converted"))


def median_of_shares(s: SparkSession, d: str) -> DataFrame:
    per = T(s, d, "recipe_ingredient_grams").groupBy("recipe_id").agg(F.avg(F.col("converted").cast("double")).alias("share"))
    return per.agg(F.round(F.median("share"), 6).alias("median_share"), F.count("*").alias("n_recipes"))


def jsonl_last_wins(s: SparkSession, d: str) -> DataFrame:
    """A journal of answers, one JSON line each and every eleventh torn off, read back: the last one of each annotator per string."""
    e = T(s, d, "ensemble").select("normalized_text", "annotator", F.coalesce("fdc_id", F.lit("")).alias("fdc_id"), F.unix_micros(F.col("judged_at").cast("timestamp")).alias("at"))
    torn = F.conv(F.substring(F.md5(F.concat_ws("|", "normalized_text", "annotator", "fdc_id")), 1, 4), 16, 10).cast("int") % 11 == 0
    line = F.to_json(F.struct("normalized_text", "annotator", "fdc_id", "at"))
    lines = e.select(F.when(torn, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value"))
    return readers.records_of(lines, "normalized_text string, annotator string, fdc_id string, at bigint", ["normalized_text", "annotator"], "at").select("normalized_text", "annotator", "fdc_id")


def categories_extracted(s: SparkSession, d: str) -> DataFrame:
    """The category in each complete payload of the raw foods."""
    raw = T(s, d, "raw_usda_foods").where(F.try_parse_json("raw_payload").isNotNull())
    return raw.select("fdc_id", ingest.category_of(F.col("raw_payload")).alias("food_category")).distinct()


def hash_sample(s: SparkSession, d: str) -> DataFrame:
    """The control share: strings whose hash falls into 15 of 100 buckets."""
    t = T(s, d, "distinct_ingredient_strings").where("normalized_text is not null").select("normalized_text").distinct()
    return t.where(F.conv(F.substring(F.sha2(F.concat(F.lit("control:"), "normalized_text"), 256), 1, 8), 16, 10).cast("bigint") % 100 < 15)


def twin_groups(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return t.where("n > 1").select("first_id", "n")


def fingerprint(s: SparkSession, d: str) -> DataFrame:
    """Number and summed hashes of the held-out texts: the same in any order, and no text leaves its task."""
    h = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12), 16, 10).cast("bigint")
    return T(s, d, "eval_items").where("split = 'holdout'").agg(F.count("*").alias("n"), F.sum(h).alias("fingerprint"))


def portions_median(s: SparkSession, d: str) -> DataFrame:
    """The median weight per string and method, null methods as a group of their own."""
    l = T(s, d, "recipe_ingredient_lines").where("recipe_id is not null").select("recipe_id", "line_index", "normalized_text").distinct()  # noqa: E741
    g = T(s, d, "recipe_ingredient_grams").distinct()
    return l.join(g, ["recipe_id", "line_index"]).groupBy("normalized_text", "method").agg(F.round(F.median("grams"), 4).alias("grams"))


def events_windows(s: SparkSession, d: str) -> DataFrame:
    """Extension: events counted per hour and type."""
    e = T(s, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def region_rollup(s: SparkSession, d: str) -> DataFrame:
    """Extension: revenue per region and nation with subtotals."""
    l, o, c, n, r = (T(s, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))  # noqa: E741
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    money = F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double")
    return j.rollup("r_name", "n_name").agg(F.round(money, 2).alias("revenue"), F.count("*").alias("n"))


_TOP1 = """best AS (SELECT normalized_text, fdc_id, cosine_search AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY normalized_text ORDER BY cosine_search DESC, fdc_id) AS r FROM ingredient_candidates WHERE cosine_search IS NOT NULL AND NOT isnan(cosine_search)) WHERE r = 1),
joined AS (SELECT s.normalized_text, s.occurrence_count, b.fdc_id, b.cosine, f.description_raw, f.kcal_per_100g FROM (SELECT normalized_text, max(occurrence_count) AS occurrence_count FROM distinct_ingredient_strings WHERE normalized_text IS NOT NULL GROUP BY 1) s JOIN best b USING (normalized_text) LEFT JOIN usda_foods f USING (fdc_id))"""
_UNION = """pairs AS (SELECT normalized_text, fdc_id, bool_or(from_embed_search) AS from_embed_search, bool_or(from_embed_desc) AS from_embed_desc, bool_or(from_token_head) AS from_token_head, max(CASE WHEN NOT isnan(cosine_search) THEN cosine_search END) AS cosine FROM ingredient_candidates GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY normalized_text ORDER BY cosine DESC NULLS LAST, fdc_id) - 1 AS INTEGER) AS rank FROM pairs)"""
_TERM = "regexp_matches(coalesce(normalized_text, ''), '(^|[^A-Za-z0-9_]){}s?($|[^A-Za-z0-9_])')"
_META = f"""meta AS (SELECT recipe_no, m.title AS title, m.directions AS directions FROM (SELECT {_R} AS recipe_no, max({{'ingested_at': ingested_at, 'title': title, 'source_url': source_url, 'directions': directions, 'deleted_at': deleted_at}}) AS m FROM recipe_meta WHERE {_R} IS NOT NULL GROUP BY 1) WHERE m.deleted_at IS NULL)"""
_FACETS = "list_filter(list_transform(string_split(regexp_replace(description_raw, '\\s*\\([Ii]ncludes foods for [^)]*\\)', ''), ','), lambda x: trim(x)), lambda x: x <> '')"

SQL = {
    "lines_resolved": _RESOLVED + "SELECT recipe_no, line_index, fdc_no, confidence, flagged, abstained, grams, contributes FROM resolved",
    "nutrition_rollup": _NUTRITION + "SELECT recipe_no, n_lines, n_counted, coverage, trust, total_grams, round(total_kcal, 1) AS total_kcal, kcal_per_100g FROM rolled",
    "canonical_dim": f"SELECT {_F} AS fdc_no, description_raw, canonical_name, category, kcal_per_100g, protein_g, fat_g, carb_g, food_category FROM usda_foods LEFT JOIN (SELECT {_F} AS no, max(nullif(trim(food_category), '')) AS food_category FROM usda_food_categories GROUP BY 1) c ON c.no = {_NO.format('usda_foods.fdc_id')}",
    "recipe_meta_clean": f"WITH {_META} SELECT recipe_no, nullif(trim(title), '') AS title, lower(nullif(trim(directions), '')) AS directions FROM meta",
    "category_nullif": f"SELECT {_F} AS fdc_no, max(nullif(trim(food_category), '')) AS food_category FROM usda_food_categories WHERE {_F} IS NOT NULL GROUP BY 1",
    "distinct_strings_strata": "SELECT normalized_text, count(*) AS occurrence_count, CASE WHEN count(*) >= 20 THEN 'head' WHEN count(*) >= 3 THEN 'mid' ELSE 'tail' END AS frequency_stratum FROM recipe_ingredient_lines WHERE normalized_text IS NOT NULL GROUP BY 1",
    "facets_search_text": f"SELECT fdc_id, lower(array_to_string({_FACETS}, ' ')) AS canonical_name, lower(array_to_string(list_reverse({_FACETS}), ' ')) AS search_text, coalesce(lower({_FACETS}[1]), '') AS category FROM usda_foods",
    "deprioritized": f"WITH d AS (SELECT description_raw FROM usda_foods UNION SELECT description FROM raw_usda_foods WHERE description IS NOT NULL) SELECT description_raw, coalesce(lower({_FACETS}[1]), '') IN ('babyfood', 'restaurant foods', 'fast foods', 'formula') OR regexp_matches(regexp_replace(description_raw, '\\s*\\([Ii]ncludes foods for [^)]*\\)', ''), '(^|[^A-Za-z0-9_])[A-Z][A-Z''&.]{{3,}}($|[^A-Za-z0-9_])') AS is_deprioritized FROM d",
    "resolve_top1": f"WITH {_TOP1} SELECT normalized_text, fdc_id, cosine, cosine < 0.40 AS flagged, cosine < 0.644 AS abstained FROM best",
    "entity_map_join": f"WITH {_TOP1} SELECT normalized_text, occurrence_count, fdc_id, cosine, cosine < 0.40 AS flagged, cosine < 0.644 AS abstained, description_raw, kcal_per_100g FROM joined",
    "candidate_union": f"WITH {_UNION} SELECT * FROM ranked",
    "head_noun_block": r"WITH w AS (SELECT fdc_id, list_distinct(list_filter(regexp_split_to_array(lower(canonical_name), '[-,\s]+'), lambda x: x <> '')) AS w FROM usda_foods), t AS (SELECT fdc_id, len(w) AS n, unnest(w) AS token FROM w), r AS (SELECT token, fdc_id, CAST(row_number() OVER (PARTITION BY token ORDER BY n, fdc_id) AS INTEGER) AS place FROM t) SELECT token, fdc_id, place FROM r WHERE place <= 50",
    "topk_cosine": "WITH n AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, vec_id) AS INTEGER) AS place, round(c, 5) AS cosine FROM n) SELECT * FROM r WHERE place <= 5",
    "majority_vote": f"WITH {ANSWERS_SQL} SELECT item AS normalized_text, label AS winner, CAST(votes AS BIGINT) AS votes FROM winners",
    "recall_at_k": f"WITH {ANSWERS_SQL}, {_UNION}, best AS (SELECT normalized_text, CAST({_F} AS VARCHAR) AS fdc_id, min(rank) AS rank FROM ranked GROUP BY 1, 2) SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN rank < k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM winners LEFT JOIN best ON best.normalized_text = winners.item AND best.fdc_id = winners.label, (VALUES (5), (10), (25), (50)) AS ks(k) WHERE label IS NOT NULL AND label <> 'none' GROUP BY 1",
    "wilson_ci": "WITH a AS (SELECT frequency_stratum, count(*) AS n, count(*) FILTER (WHERE flagged) AS k FROM ingredient_entity_map WHERE frequency_stratum IS NOT NULL GROUP BY 1), b AS (SELECT *, n::DOUBLE AS m, k / n::DOUBLE AS p FROM a) SELECT frequency_stratum, n, k, round(greatest((p + 3.8416 / (2 * m)) / (1 + 3.8416 / m) - 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / (1 + 3.8416 / m), 0), 6) AS low, round(least((p + 3.8416 / (2 * m)) / (1 + 3.8416 / m) + 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / (1 + 3.8416 / m), 1), 6) AS high FROM b",
    "stratified_rate": "WITH t AS (SELECT lower(trim(frequency_stratum)) AS stratum, count(*) AS strings, sum(occurrence_count)::DOUBLE AS uses FROM distinct_ingredient_strings WHERE frequency_stratum IS NOT NULL GROUP BY 1), r AS (SELECT lower(trim(frequency_stratum)) AS stratum, avg(flagged::INT) AS rate, sum(flagged::INT * occurrence_count)::DOUBLE / sum(occurrence_count) AS use_rate FROM ingredient_entity_map WHERE frequency_stratum IS NOT NULL GROUP BY 1) SELECT round(sum(rate * strings) / sum(strings), 6) AS per_string, round(sum(use_rate * uses) / sum(uses), 6) AS per_use FROM t JOIN r USING (stratum)",
    "error_bands": f"WITH {_TOP1}, e AS (SELECT normalized_text, max(kcal_per_100g) AS a FROM ingredient_entity_map WHERE normalized_text IS NOT NULL GROUP BY 1), x AS (SELECT CASE WHEN abs(a - kcal_per_100g) <= 5 THEN 0 ELSE abs(a - kcal_per_100g) / greatest(abs(a), abs(kcal_per_100g)) END AS err FROM e JOIN joined USING (normalized_text) WHERE a IS NOT NULL AND kcal_per_100g IS NOT NULL) SELECT CASE WHEN err < 0.1 THEN 'under 0.10' WHEN err < 0.25 THEN 'under 0.25' WHEN err < 0.5 THEN 'under 0.50' ELSE 'beyond' END AS band, count(*) AS n FROM x GROUP BY 1",
    "ambiguity": "SELECT category, count(*) AS n, round((max(kcal_per_100g) - min(kcal_per_100g)) / max(kcal_per_100g), 6) AS spread FROM usda_foods WHERE kcal_per_100g IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "abstain_sweep": "WITH m AS (SELECT round(cosine, 2) AS score, fdc_id IS NULL AS empty FROM ingredient_entity_map WHERE cosine IS NOT NULL), b AS (SELECT score AS threshold, count(*) AS n, count(*) FILTER (WHERE empty) AS neg FROM m GROUP BY 1), c AS (SELECT threshold, coalesce(sum(n) OVER w, 0)::DOUBLE AS declined, coalesce(sum(neg) OVER w, 0)::DOUBLE AS right_, (SELECT count(*) FROM m WHERE empty)::DOUBLE AS every FROM b WINDOW w AS (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), p AS (SELECT threshold, right_ / declined AS p, right_ / nullif(every, 0) AS r FROM c WHERE declined > 0) SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 6) AS f FROM p",
    "retrieval_ranked": _NUTRITION + f", {_META}, hits AS (SELECT recipe_no, array_to_string(list_sort(list(DISTINCT t)), ',') AS matched, count(DISTINCT t) AS n_matched, array_to_string(list_sort(list_filter(['salt', 'butter', 'garlic'], lambda x: NOT list_contains(list(DISTINCT t), x))), ',') AS missing FROM (SELECT recipe_no, unnest(list_filter([CASE WHEN {_TERM.format('salt')} THEN 'salt' END, CASE WHEN {_TERM.format('butter')} THEN 'butter' END, CASE WHEN {_TERM.format('garlic')} THEN 'garlic' END], lambda x: x IS NOT NULL)) AS t FROM resolved) GROUP BY 1) SELECT recipe_no, nullif(trim(title), '') AS title, matched, missing, n_matched, coverage, trust FROM rolled JOIN hits USING (recipe_no) JOIN meta USING (recipe_no) WHERE coverage >= 0.2 AND recipe_no NOT IN (SELECT recipe_no FROM resolved WHERE {_TERM.format('onion')}) ORDER BY n_matched DESC, trust DESC, recipe_no LIMIT 20",
    "dq_not_null": "SELECT line_index, line_raw FROM recipe_ingredient_lines WHERE recipe_id IS NULL",
    "dq_unique": "SELECT recipe_id, count(*) AS n FROM recipe_meta WHERE recipe_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "dq_unique_line": "SELECT recipe_id, line_index, count(*) AS n FROM recipe_ingredient_lines GROUP BY 1, 2 HAVING count(*) > 1",
    "dq_relationships": "SELECT DISTINCT fdc_id FROM ingredient_candidates WHERE fdc_id IS NOT NULL AND fdc_id NOT IN (SELECT fdc_id FROM usda_foods)",
    "dq_unknown_foods": f"WITH {_TOP1} SELECT normalized_text, fdc_id FROM joined WHERE description_raw IS NULL",
    "dq_accepted_values": "SELECT normalized_text, frequency_stratum FROM distinct_ingredient_strings WHERE frequency_stratum NOT IN ('head', 'mid', 'tail')",
    "dq_accepted_range": "SELECT recipe_id, line_index, grams FROM recipe_ingredient_grams WHERE grams < 0.01 OR grams > 5000",
    "drift_expectations": _NUTRITION + ", a AS (SELECT avg(kcal_per_100g) AS a1, median(total_grams) FILTER (WHERE total_grams > 0) AS a2, quantile_cont(total_grams, 0.99) FILTER (WHERE total_grams > 0) AS a3, avg(coverage) AS a4, count(*) FILTER (WHERE coverage > 0)::DOUBLE / count(*) AS a5, avg(trust) AS a6, count(*) FILTER (WHERE coverage = 1)::DOUBLE / count(*) AS a7 FROM rolled), w AS (SELECT count(grams)::DOUBLE / count(*) AS a8 FROM resolved), t AS (SELECT floor(epoch(greatest((SELECT max(ingested_at) FROM recipe_ingredient_lines), (SELECT max(ingested_at) FROM recipe_meta))) / 3600) - floor(epoch((SELECT max(ingested_at) FROM recipe_ingredient_lines)) / 3600) AS a9), v AS (SELECT * FROM a, w, t, LATERAL (VALUES " + ", ".join(f"('{k}', a{n}, {lo}, {hi})" for n, (k, (lo, hi)) in enumerate(DRIFT.items(), 1)) + ") AS x(expectation, value, low, high)) SELECT expectation, round(value, 4) AS value, coalesce(value BETWEEN low AND high, false) AS ok FROM v",
    "coverage_by_class": "SELECT coalesce(method, 'none') AS method, count(*) AS n, count(*) FILTER (WHERE converted) AS n_converted FROM recipe_ingredient_grams GROUP BY 1",
    "median_of_shares": "SELECT round(median(share), 6) AS median_share, count(*) AS n_recipes FROM (SELECT recipe_id, avg(converted::INT) AS share FROM recipe_ingredient_grams GROUP BY 1)",
    "jsonl_last_wins": "WITH e AS (SELECT normalized_text, annotator, coalesce(fdc_id, '') AS f, epoch_us(CAST(judged_at AS TIMESTAMPTZ)) AS t FROM ensemble WHERE normalized_text IS NOT NULL AND annotator IS NOT NULL), whole AS (SELECT * FROM e WHERE ('0x' || substr(md5(concat_ws('|', normalized_text, annotator, f)), 1, 4))::INTEGER % 11 <> 0) SELECT normalized_text, annotator, arg_max(f, (coalesce(t, -9000000000000000), f)) AS fdc_id FROM whole GROUP BY 1, 2",
    "categories_extracted": "WITH o AS (SELECT fdc_id, CAST(raw_payload AS JSON) AS o FROM raw_usda_foods WHERE json_valid(raw_payload)) SELECT DISTINCT fdc_id, coalesce(nullif(trim(CASE json_type(o -> '$.foodCategory') WHEN 'OBJECT' THEN coalesce(o ->> '$.foodCategory.description', '') WHEN 'NULL' THEN NULL ELSE o ->> '$.foodCategory' END), ''), CASE WHEN coalesce(json_type(o -> '$.foodCategory'), '') <> 'OBJECT' THEN trim(o ->> '$.brandedFoodCategory') END, '') AS food_category FROM o",
    "hash_sample": "SELECT DISTINCT normalized_text FROM distinct_ingredient_strings WHERE normalized_text IS NOT NULL AND ('0x' || substr(sha256('control:' || normalized_text), 1, 8))::BIGINT % 100 < 15",
    "twin_groups": "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "fingerprint": "SELECT count(*) AS n, CAST(sum(('0x' || substr(sha256(coalesce(text, '')), 1, 12))::BIGINT) AS BIGINT) AS fingerprint FROM eval_items WHERE split = 'holdout'",
    "portions_median": "SELECT normalized_text, method, round(median(grams), 4) AS grams FROM (SELECT DISTINCT recipe_id, line_index, normalized_text FROM recipe_ingredient_lines WHERE recipe_id IS NOT NULL) JOIN (SELECT DISTINCT * FROM recipe_ingredient_grams) USING (recipe_id, line_index) GROUP BY 1, 2",
    "planner_greedy": _NUTRITION.replace("WITH lines", "WITH RECURSIVE lines", 1) + ", p AS (SELECT recipe_no, round_even(total_kcal, 0) AS kcal, round_even(total_grams, 0) AS cost FROM rolled WHERE coverage >= 0.5), q AS (SELECT *, row_number() OVER (ORDER BY kcal DESC, recipe_no) AS k FROM p WHERE kcal <= 2000 AND kcal > 0 AND cost <= 9000), g AS (SELECT 0::BIGINT AS k, 0 AS day, NULL::BIGINT AS recipe_no, NULL::DOUBLE AS kcal, NULL::DOUBLE AS cost, 9000.0::DOUBLE AS budget, false AS taken UNION ALL SELECT q.k, g.day + CASE WHEN q.cost <= g.budget THEN 1 ELSE 0 END, q.recipe_no, q.kcal, q.cost, g.budget - CASE WHEN q.cost <= g.budget THEN q.cost ELSE 0 END, q.cost <= g.budget FROM g JOIN q ON q.k = g.k + 1 WHERE g.day < 7) SELECT CAST(day AS INTEGER) AS day, recipe_no, kcal AS total_kcal, cost FROM g WHERE taken",
    "events_windows": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "region_rollup": "SELECT r_name, n_name, round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))::DOUBLE, 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
}
QUERIES = {
    f.__name__: f
    for f in (
        lines_resolved, nutrition_rollup, canonical_dim, recipe_meta_clean, category_nullif, distinct_strings_strata, facets_search_text, deprioritized,
        resolve_top1, entity_map_join, candidate_union, head_noun_block, topk_cosine, majority_vote, recall_at_k, wilson_ci, stratified_rate, error_bands,
        ambiguity, abstain_sweep, retrieval_ranked, planner_greedy, dq_not_null, dq_unique, dq_unique_line,
        dq_relationships, dq_unknown_foods, dq_accepted_values, dq_accepted_range, drift_expectations, coverage_by_class, median_of_shares, jsonl_last_wins, categories_extracted, hash_sample,
        twin_groups, fingerprint, portions_median, events_windows, region_rollup,
    )
}
