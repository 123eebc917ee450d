"""Queries that hold resolvers and annotators against each other, draw labelling samples and fit thresholds, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillet.functions import features
from skillet.functions.answers import last_answers, majority
from skillet.functions.ids import number_in
from skillet.plans import stats
from skillet.session import table as T

SEED = 20260724
_NO = "try_cast(nullif(regexp_replace({}, '[^0-9]', '', 'g'), '') AS BIGINT)"
_LABEL = f"CASE WHEN lower(trim(fdc_id)) = 'none' THEN 'none' ELSE CAST({_NO.format('fdc_id')} AS VARCHAR) END"


def _answers(s, d):
    return last_answers(T(s, d, "ensemble"), "normalized_text", "annotator", "fdc_id", "judged_at")


def _foods(s, d):
    return T(s, d, "usda_foods").select(number_in("fdc_id").cast("string").alias("label"), "description_raw", "kcal_per_100g", "is_deprioritized")


ANSWERS_SQL = f"""
said AS (
  SELECT normalized_text AS item, lower(trim(annotator)) AS who, arg_max(coalesce({_LABEL}, ''), (coalesce(epoch_us(CAST(judged_at AS TIMESTAMPTZ)), -4611686018427387904), coalesce({_LABEL}, ''))) AS label
  FROM ensemble WHERE normalized_text IS NOT NULL AND annotator IS NOT NULL GROUP BY 1, 2
), answers AS (SELECT * FROM said WHERE label <> ''),
tally AS (SELECT item, label, count(*) AS n FROM answers GROUP BY 1, 2),
most AS (SELECT item, label, n, max(n) OVER (PARTITION BY item) AS votes FROM tally),
winners AS (SELECT item, votes, CASE WHEN count(*) = 1 THEN max(label) END AS label FROM most WHERE n = votes GROUP BY 1, 2)"""
_FOODS_SQL = f"foods AS (SELECT CAST({_NO.format('fdc_id')} AS VARCHAR) AS label, description_raw, kcal_per_100g, is_deprioritized FROM usda_foods)"


# Agreement.
def agreement_by_description(s: SparkSession, d: str) -> DataFrame:
    """Krippendorff's alpha after foods of one description count as one answer."""
    same = _answers(s, d).join(_foods(s, d), "label", "left").select("item", F.coalesce("description_raw", "label").alias("label"))
    return stats.krippendorff(same).withColumn("alpha", F.round("alpha", 6))


def agreement_interval(s: SparkSession, d: str) -> DataFrame:
    """The interval of Krippendorff's alpha."""
    return stats.krippendorff_interval(_answers(s, d)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def annotator_agreement(s: SparkSession, d: str) -> DataFrame:
    """How often each annotator gives the majority's answer, by id and by description, with the interval of the latter."""
    won = majority(_answers(s, d)).where("label is not null").select("item", F.col("label").alias("won"))
    f = _foods(s, d).select("label", "description_raw")
    rows = _answers(s, d).join(won, "item").join(f, "label", "left").join(f.select(F.col("label").alias("won"), F.col("description_raw").alias("won_description")), "won", "left")
    same = (F.col("label") == F.col("won")) | F.coalesce(F.col("description_raw") == F.col("won_description"), F.lit(False))
    by = rows.groupBy("annotator").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("won")).alias("n_same_id"), F.count_if(same).alias("n_same_food"))
    low, high = stats.wilson(F.col("n_same_food"), F.col("n"))
    return by.select("annotator", "n", "n_same_id", "n_same_food", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# Resolvers against the majority.
def _top1(s, d):
    c = T(s, d, "ingredient_candidates").where("cosine_search is not null and not isnan(cosine_search) and normalized_text is not null and fdc_id is not null")
    best = c.groupBy(F.col("normalized_text").alias("item")).agg(F.min(F.struct((-F.col("cosine_search")).alias("k"), "fdc_id")).alias("m"))
    return best.select("item", number_in("m.fdc_id").cast("string").alias("pick"), (-F.col("m.k")).alias("score"))


_TOP1_SQL = f"""top1 AS (SELECT normalized_text AS item, CAST({_NO.format('fdc_id')} AS VARCHAR) AS pick, cosine_search AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY normalized_text ORDER BY cosine_search DESC, fdc_id) AS r FROM ingredient_candidates
  WHERE cosine_search IS NOT NULL AND NOT isnan(cosine_search) AND normalized_text IS NOT NULL AND fdc_id IS NOT NULL) WHERE r = 1)"""


def outcomes(s: SparkSession, d: str) -> DataFrame:
    """(item, pick, score, label, good, empty): the best candidate of each labelled string, whether it is right, and whether no food fits."""
    won = majority(_answers(s, d)).where("label is not null").select("item", "label")
    return _top1(s, d).join(won, "item").select("item", "pick", "score", "label", (F.col("pick") == F.col("label")).alias("good"), (F.col("label") == "none").alias("empty"))


OUTCOMES_SQL = f"WITH {ANSWERS_SQL}, {_TOP1_SQL}, outcomes AS (SELECT item, pick, score, w.label, pick = w.label AS good, w.label = 'none' AS empty FROM top1 JOIN winners w USING (item) WHERE w.label IS NOT NULL)"


def top1_accuracy(s: SparkSession, d: str) -> DataFrame:
    """How many best candidates are right, how many strings have their food among the candidates, and how many there are."""
    c = T(s, d, "ingredient_candidates").select(F.col("normalized_text").alias("item"), number_in("fdc_id").cast("string").alias("label")).distinct()
    has = outcomes(s, d).join(c.withColumn("held", F.lit(True)), ["item", "label"], "left")
    return has.agg(F.count_if("good").alias("n_right"), F.count_if("held").alias("n_retrievable"), F.count("*").alias("n"))


def score_reliability(s: SparkSession, d: str) -> DataFrame:
    """Mean score and share of right picks in five bins of equal width, the last one closed."""
    bin_of = F.least(F.greatest(F.floor(F.col("score") * 5), F.lit(0)), F.lit(4)).cast("int")
    return outcomes(s, d).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("good").cast("double")), 6).alias("observed"))


def resolvers_compared(s: SparkSession, d: str) -> DataFrame:
    """The earlier resolver's answer and the best candidate against the majority: the four cells of a paired comparison."""
    earlier = T(s, d, "ingredient_entity_map").where("normalized_text is not null").groupBy(F.col("normalized_text").alias("item")).agg(F.coalesce(number_in(F.max("fdc_id")).cast("string"), F.lit("none")).alias("earlier"))
    rows = outcomes(s, d).join(earlier, "item").withColumn("before", F.col("earlier") == F.col("label"))
    return rows.agg(F.count_if(F.col("before") & F.col("good")).alias("both"), F.count_if(F.col("before") & ~F.col("good")).alias("only_earlier"), F.count_if(~F.col("before") & F.col("good")).alias("only_candidate"), F.count_if(~F.col("before") & ~F.col("good")).alias("neither"))


# Thresholds.
def threshold_fit(s: SparkSession, d: str) -> DataFrame:
    """The score below which declining serves F2 best."""
    return stats.fit_threshold(outcomes(s, d), "score", "empty").select("threshold", F.round("f", 6).alias("f"))


def nomatch_floor(s: SparkSession, d: str) -> DataFrame:
    """The cut of highest F1 on the strings that no food fits, with its precision and recall."""
    best = stats.sweep(outcomes(s, d), "score", "empty", 1.0).where("f > 0").agg(F.min(F.struct((-F.col("f")).alias("f"), "threshold", "precision", "recall")).alias("m"))
    return best.select("m.threshold", F.round("m.precision", 6).alias("precision"), F.round("m.recall", 6).alias("recall"))


def threshold_cross_validated(s: SparkSession, d: str) -> DataFrame:
    """Per fold the threshold that the others fit, and what it declines of the fold."""
    got = stats.cross_validated(outcomes(s, d), "item", "score", "empty")
    return got.groupBy("fold", "threshold").agg(F.count("*").alias("n"), F.count_if("declined").alias("n_declined"), F.count_if(F.col("declined") & F.col("negative")).alias("n_rightly"))


def coverage_curve(s: SparkSession, d: str) -> DataFrame:
    return stats.coverage_curve(outcomes(s, d), "score", "good", "item").select("point", "n", F.round("accuracy", 6).alias("accuracy"))


def accuracy_at_target(s: SparkSession, d: str) -> DataFrame:
    return stats.best_at_target(outcomes(s, d), "score", "good", 0.8).select("threshold", "n", F.round("accuracy", 6).alias("accuracy"))


_SWEEP_SQL = """, grouped AS (SELECT {group} score AS threshold, count(*) AS n, count(*) FILTER (WHERE empty) AS neg FROM {source} GROUP BY ALL),
below AS (SELECT {group} threshold, sum(n) OVER w AS n, sum(neg) OVER w AS neg, sum(neg) OVER ({part}) AS every FROM grouped WINDOW w AS ({part} ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
points AS (SELECT {group} threshold, neg::DOUBLE / n AS p, neg::DOUBLE / nullif(every, 0) AS r FROM below WHERE n > 0),
scored AS (SELECT {group} threshold, p, r, coalesce((1 + {b2}) * p * r / nullif({b2} * p + r, 0), 0) AS f FROM points)"""


# Pairs of strings and foods.
def pair_features(s: SparkSession, d: str) -> DataFrame:
    """The features of every candidate pair, its distance from the string's best score, and whether it is the majority's food or has its description."""
    c = T(s, d, "ingredient_candidates").where("normalized_text is not null").select(F.col("normalized_text").alias("item"), number_in("fdc_id").cast("string").alias("label"), F.nanvl("cosine_search", F.lit(None).cast("double")).alias("cosine"))
    return features_of(s, d, c)


def features_of(s: SparkSession, d: str, c: DataFrame) -> DataFrame:
    """``pair_features`` of any candidates (item, label, cosine)."""
    c = c.groupBy("item", "label").agg(F.max("cosine").alias("cosine"))
    best = c.groupBy("item").agg(F.max("cosine").alias("best"))
    f = _foods(s, d)
    won = majority(_answers(s, d)).where("label is not null").select("item", F.col("label").alias("won"))
    won = won.join(f.select(F.col("label").alias("won"), F.col("description_raw").alias("won_description")), "won", "left")
    rows = c.join(best, "item").join(f, "label").join(won, "item", "left")
    target = F.when(F.col("won").isNotNull(), (F.col("label") == F.col("won")) | F.coalesce(F.col("description_raw") == F.col("won_description"), F.lit(False)))
    name, text = F.col("item"), F.col("description_raw")
    # Letters beyond ASCII count as one sign, as the SQL that it is held against compares bytes.
    ascii_of = lambda c: F.regexp_replace(F.lower(c), "[^ -~]", "?")
    return rows.select(
        F.col("item").alias("normalized_text"), F.col("label").alias("fdc_id"), F.round(features.jaccard(name, text), 6).alias("jaccard"), F.round(features.jaro_winkler(ascii_of(name), ascii_of(text)), 6).alias("jaro_winkler"),
        features.head_facet(name, text).alias("head_facet"), F.round(features.plain_share(text), 6).alias("plain_share"), F.coalesce(F.col("is_deprioritized").cast("double"), F.lit(0.0)).alias("is_deprioritized"),
        F.round(F.col("cosine") - F.col("best"), 6).alias("margin"), target.alias("target"),
    )


def same_food_spread(s: SparkSession, d: str) -> DataFrame:
    """Per string the relative spread of energy among the candidates that share the first two facets with its best one."""
    f = _foods(s, d).where("kcal_per_100g is not null").select("label", features.food_key(F.col("description_raw")).alias("food"), "kcal_per_100g")
    mine = _top1(s, d).join(_foods(s, d).select(F.col("label").alias("pick"), features.food_key(F.col("description_raw")).alias("food")), "pick").select("item", "food")
    c = T(s, d, "ingredient_candidates").where("normalized_text is not null").select(F.col("normalized_text").alias("item"), number_in("fdc_id").cast("string").alias("label")).distinct()
    by = c.join(f, "label").join(mine, ["item", "food"]).groupBy("item").agg(F.count("*").alias("n"), F.max("kcal_per_100g").alias("hi"), F.min("kcal_per_100g").alias("lo"))
    return by.where("n >= 2").select(F.col("item").alias("normalized_text"), "n", F.round(F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.col("hi")), F.lit(0.0)), 6).alias("spread"))


# Samples for labelling.
def _hashed(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def gold_sample(s: SparkSession, d: str) -> DataFrame:
    """A hundred strings of each stratum by seeded hash, every third of them held out, with the control share marked."""
    strings = T(s, d, "distinct_ingredient_strings").where("normalized_text is not null and frequency_stratum is not null").select("normalized_text", F.lower(F.trim("frequency_stratum")).alias("stratum")).distinct()
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(_hashed(F.lit(str(SEED)), "normalized_text"), "normalized_text"))
    control = F.conv(F.substring(F.sha2(F.concat(F.lit("control:"), "normalized_text"), 256), 1, 8), 16, 10).cast("bigint") % 100 < 15
    return strings.withColumn("place", place).where("place <= 100").select("normalized_text", "stratum", "place", F.when(F.col("place") % 3 == 0, "holdout").otherwise("tune").alias("split"), control.alias("control"))


def relabel_draw(s: SparkSession, d: str) -> DataFrame:
    """Two draws of thirty labelled strings each: the second one leaves out what the first one took."""
    strings = _answers(s, d).select(F.col("item").alias("normalized_text")).distinct()
    first = strings.orderBy(_hashed(F.lit("1"), "normalized_text"), "normalized_text").limit(30)
    second = strings.join(first, "normalized_text", "left_anti").orderBy(_hashed(F.lit("2"), "normalized_text"), "normalized_text").limit(30)
    return first.withColumn("number", F.lit(1)).unionByName(second.withColumn("number", F.lit(2)))


def pending_disagreements(s: SparkSession, d: str) -> DataFrame:
    """Strings on which the earlier resolver and the majority differ, with a seeded coin for the order in which they are shown."""
    earlier = T(s, d, "ingredient_entity_map").where("normalized_text is not null").groupBy(F.col("normalized_text").alias("item")).agg(F.coalesce(number_in(F.max("fdc_id")).cast("string"), F.lit("none")).alias("earlier"))
    won = majority(_answers(s, d)).where("label is not null")
    coin = F.conv(F.substring(_hashed(F.lit("order"), "item"), 1, 8), 16, 10).cast("bigint") % 2 == 0
    return earlier.join(won, "item").where("earlier <> label").select(F.col("item").alias("normalized_text"), "earlier", "label", coin.alias("earlier_first"))


def label_targets(s: SparkSession, d: str) -> DataFrame:
    """The union of the strings that annotators, the earlier resolver or the candidates know, with who knows them."""
    parts = [T(s, d, t).where("normalized_text is not null").select("normalized_text", F.lit(b).alias("b")).distinct() for t, b in (("ensemble", 1), ("ingredient_entity_map", 2), ("ingredient_candidates", 4))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("normalized_text").agg(F.sum("b").alias("known_to"))


def shuffled_candidates(s: SparkSession, d: str) -> DataFrame:
    """The candidates of each string in a seeded order of their own, as an annotator is shown them; the first ten."""
    c = T(s, d, "ingredient_candidates").where("normalized_text is not null and fdc_id is not null").select("normalized_text", "fdc_id").distinct()
    place = F.row_number().over(Window.partitionBy("normalized_text").orderBy(_hashed(F.lit(str(SEED)), "normalized_text", "fdc_id"), "fdc_id"))
    return c.withColumn("place", place).where("place <= 10")


def food_search(s: SparkSession, d: str) -> DataFrame:
    """Foods whose description holds both words, the shortest first."""
    text = F.lower("description_raw")
    hit = T(s, d, "usda_foods").where(F.contains(text, F.lit("smoked")) & F.contains(text, F.lit("ham")) | F.contains(text, F.lit("curd")))
    order = (F.length("description_raw"), "description_raw", "fdc_id")
    return hit.select("fdc_id", "description_raw").orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def example_lines(s: SparkSession, d: str) -> DataFrame:
    """The first three distinct written lines of every string."""
    lines = T(s, d, "recipe_ingredient_lines").where("normalized_text is not null and line_raw is not null").select("normalized_text", "line_raw").distinct()
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("normalized_text").orderBy("line_raw"))).where("place <= 3")


def undecided_top(s: SparkSession, d: str) -> DataFrame:
    """The three most used strings that were declined or flagged, with the share of such strings."""
    m = T(s, d, "ingredient_entity_map").where("normalized_text is not null").groupBy("normalized_text").agg(F.max("occurrence_count").alias("occurrence_count"), (F.bool_or("abstained") | F.bool_or("flagged")).alias("undecided"))
    share = m.agg(F.round(F.count_if("undecided") / F.count("*"), 6).alias("share"))
    return m.where("undecided").orderBy(F.col("occurrence_count").desc_nulls_last(), "normalized_text").limit(3).crossJoin(F.broadcast(share)).select("normalized_text", "occurrence_count", "share")


def grams_summary(s: SparkSession, d: str) -> DataFrame:
    """Recorded weights: how many, the least, the median and the most, by way of conversion."""
    g = T(s, d, "recipe_ingredient_grams").where("grams is null or not isnan(grams)")
    return g.groupBy(F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"), F.count("grams").alias("n_weighed"), F.round(F.min("grams"), 4).alias("least"), F.round(F.median("grams"), 4).alias("middle"), F.round(F.max("grams"), 4).alias("most"))


def top_units(s: SparkSession, d: str) -> DataFrame:
    """The twelve units that most strings are measured in."""
    l = T(s, d, "recipe_ingredient_lines").where("unit is not null and normalized_text is not null")  # noqa: E741
    return l.groupBy(F.lower(F.trim("unit")).alias("unit")).agg(F.countDistinct("normalized_text").alias("n_strings"), F.count("*").alias("n")).orderBy(F.col("n_strings").desc(), "unit").limit(12)


def recipe_steps(s: SparkSession, d: str) -> DataFrame:
    """The steps of every recipe's directions: the trimmed, non-empty texts of a JSON list; none for anything else."""
    m = T(s, d, "recipe_meta").where(number_in("recipe_id").isNotNull()).groupBy(number_in("recipe_id").alias("recipe_no")).agg(F.max(F.struct("ingested_at", "title", "source_url", "directions")).alias("r"))
    steps = F.coalesce(F.filter(F.transform(F.from_json("r.directions", "array<string>"), F.trim), lambda x: x != ""), F.array().cast("array<string>"))
    listed = F.col("r.directions").rlike(r"^\s*\[")
    return m.select("recipe_no", F.posexplode(F.when(listed, steps).otherwise(F.array().cast("array<string>"))).alias("place", "step"))


def band_distribution(s: SparkSession, d: str) -> DataFrame:
    """Foods per band of the gap between the earlier resolver's energy and the catalogue's, empty bands with 0."""
    m = T(s, d, "ingredient_entity_map").select(number_in("fdc_id").cast("string").alias("label"), F.col("kcal_per_100g").alias("a")).where("label is not null").distinct()
    err = stats.error(F.col("a"), F.col("kcal_per_100g"))
    got = m.join(_foods(s, d), "label").where(err.isNotNull()).groupBy(stats.band(err).alias("band")).agg(F.count("*").alias("n"))
    bands = s.createDataFrame([("under 0.10",), ("under 0.25",), ("under 0.50",), ("beyond",)], "band string")
    return bands.join(got, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        agreement_by_description, agreement_interval, annotator_agreement, top1_accuracy, score_reliability, resolvers_compared, threshold_fit, nomatch_floor, threshold_cross_validated,
        coverage_curve, accuracy_at_target, pair_features, same_food_spread, gold_sample, relabel_draw, pending_disagreements, label_targets, shuffled_candidates,
        food_search, example_lines, undecided_top, grams_summary, top_units, recipe_steps, band_distribution,
    )
}
_EARLIER = f"earlier AS (SELECT normalized_text AS item, coalesce(CAST({_NO.format('max(fdc_id)')} AS VARCHAR), 'none') AS earlier FROM ingredient_entity_map WHERE normalized_text IS NOT NULL GROUP BY 1)"
_KEY = "list_transform(string_split(lower(description_raw), ',')[1:2], lambda x: trim(x))"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[-,\\s]+'), lambda w: w <> ''))"
_PLAIN = "[" + ", ".join(f"'{w}'" for w in features.PLAIN_MODIFIERS) + "]"
_TAIL = "list_filter(regexp_split_to_array(CASE WHEN contains(description_raw, ',') THEN regexp_replace(lower(description_raw), '^[^,]*,', '') ELSE '' END, '[-,\\s]+'), lambda w: w <> '')"
SQL = {
    "agreement_interval": f"""WITH {ANSWERS_SQL}, counts AS (SELECT item, label, count(*) AS c FROM answers GROUP BY 1, 2), per AS (SELECT item, sum(c) AS n, sum(c * c) AS sq FROM counts GROUP BY 1 HAVING sum(c) > 1),
u AS (SELECT item, n, sq, d, ('0x' || substr(md5(item || '|' || d), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM per, range(200) AS r(d)),
w AS (SELECT *, len(list_filter({list(stats.POISSON)}::DOUBLE[], lambda p: u >= p)) AS w FROM u), i AS (SELECT d, sum(w * (n * n - sq)::DOUBLE / (n - 1)) AS differ, sum(w * n)::DOUBLE AS n FROM w GROUP BY 1),
l AS (SELECT d, sum(c * c)::DOUBLE AS sq FROM (SELECT d, label, sum(w * c)::DOUBLE AS c FROM w JOIN counts USING (item) GROUP BY 1, 2) GROUP BY 1), a AS (SELECT 1 - differ / ((n * n - sq) / (n - 1)) AS alpha FROM i JOIN l USING (d))
SELECT round(quantile_cont(alpha, 0.025), 6) AS low, round(quantile_cont(alpha, 0.975), 6) AS high FROM a""",
    "agreement_by_description": f"""WITH {ANSWERS_SQL}, {_FOODS_SQL}, named AS (SELECT item, coalesce(description_raw, a.label) AS label FROM answers a LEFT JOIN foods USING (label)),
counts AS (SELECT item, label, count(*) AS c FROM named GROUP BY 1, 2), per AS (SELECT item, sum(c) AS n, sum(c * c) AS sq FROM counts GROUP BY 1 HAVING sum(c) > 1),
obs AS (SELECT sum((n * n - sq)::DOUBLE / (n - 1)) AS differ, sum(n)::DOUBLE AS n, count(*) AS n_items FROM per), lab AS (SELECT sum(c * c)::DOUBLE AS sq FROM (SELECT label, sum(c) AS c FROM counts JOIN per USING (item) GROUP BY 1))
SELECT round(1 - differ / ((n * n - sq) / (n - 1)), 6) AS alpha, CAST(n_items AS BIGINT) AS n_items, CAST(n AS BIGINT) AS n_answers FROM obs, lab""",
    "annotator_agreement": f"""WITH {ANSWERS_SQL}, {_FOODS_SQL}, x AS (SELECT a.who, a.label = w.label AS same, coalesce(f.description_raw = g.description_raw, false) AS alike FROM answers a JOIN winners w ON w.item = a.item AND w.label IS NOT NULL LEFT JOIN foods f ON f.label = a.label LEFT JOIN foods g ON g.label = w.label),
c AS (SELECT who AS annotator, count(*) AS n, count(*) FILTER (WHERE same) AS n_same_id, count(*) FILTER (WHERE same OR alike) AS n_same_food FROM x GROUP BY 1), p AS (SELECT *, n::DOUBLE AS m, n_same_food / n::DOUBLE AS p FROM c)
SELECT annotator, n, n_same_id, n_same_food, round(greatest(((p + 3.8416 / (2 * m)) - 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 0), 6) AS low, round(least(((p + 3.8416 / (2 * m)) + 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 1), 6) AS high FROM p""",
    "top1_accuracy": OUTCOMES_SQL + f", held AS (SELECT DISTINCT normalized_text AS item, CAST({_NO.format('fdc_id')} AS VARCHAR) AS label, true AS held FROM ingredient_candidates) SELECT count(*) FILTER (WHERE good) AS n_right, count(*) FILTER (WHERE held) AS n_retrievable, count(*) AS n FROM outcomes LEFT JOIN held USING (item, label)",
    "score_reliability": OUTCOMES_SQL + " SELECT CAST(least(greatest(floor(score * 5), 0), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(good::INT), 6) AS observed FROM outcomes GROUP BY 1",
    "resolvers_compared": OUTCOMES_SQL + f", {_EARLIER} SELECT count(*) FILTER (WHERE earlier = label AND good) AS both, count(*) FILTER (WHERE earlier = label AND NOT good) AS only_earlier, count(*) FILTER (WHERE earlier <> label AND good) AS only_candidate, count(*) FILTER (WHERE earlier <> label AND NOT good) AS neither FROM outcomes JOIN earlier USING (item)",
    "threshold_fit": OUTCOMES_SQL + _SWEEP_SQL.format(group="", source="outcomes", part="", b2="4") + " SELECT coalesce(max(threshold), 0.0) AS threshold, coalesce(max(f), 0.0) AS f FROM (SELECT threshold, round(f, 6) AS f FROM scored WHERE f > 0 ORDER BY scored.f DESC, threshold LIMIT 1)",
    "nomatch_floor": OUTCOMES_SQL + _SWEEP_SQL.format(group="", source="outcomes", part="", b2="1") + " SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM scored WHERE f > 0 ORDER BY f DESC, threshold LIMIT 1",
    "threshold_cross_validated": OUTCOMES_SQL + ", placed AS (SELECT *, ('0x' || substr(sha256('20260730:' || item), 1, 8))::BIGINT % 5 AS fold FROM outcomes), train AS (SELECT CAST(k AS INTEGER) AS fold, score, empty FROM placed, range(5) AS r(k) WHERE k <> fold)" + _SWEEP_SQL.format(group="fold,", source="train", part="PARTITION BY fold", b2="4") + ", cuts AS (SELECT k AS fold, coalesce(threshold, 0.0) AS threshold FROM range(5) AS r(k) LEFT JOIN (SELECT fold, threshold, row_number() OVER (PARTITION BY fold ORDER BY f DESC, threshold) AS place FROM scored WHERE f > 0) b ON b.fold = k AND b.place = 1) SELECT CAST(fold AS INTEGER) AS fold, threshold, count(*) AS n, count(*) FILTER (WHERE score < threshold) AS n_declined, count(*) FILTER (WHERE score < threshold AND empty) AS n_rightly FROM placed JOIN cuts USING (fold) GROUP BY 1, 2",
    "coverage_curve": OUTCOMES_SQL + ", placed AS (SELECT good, row_number() OVER (ORDER BY score DESC, item) AS k, count(*) OVER () AS every FROM outcomes) SELECT CAST(point AS DOUBLE) AS point, greatest(1, round(max(every) * point))::BIGINT AS n, round(avg(good::INT) FILTER (WHERE k <= greatest(1, round(every * point))), 6) AS accuracy FROM placed, (VALUES (0.1), (0.25), (0.5), (0.75), (1.0)) AS p(point) GROUP BY point",
    "accuracy_at_target": OUTCOMES_SQL + ", grouped AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE good) AS g FROM outcomes GROUP BY 1), upto AS (SELECT score AS threshold, sum(n) OVER w AS n, sum(g) OVER w / sum(n) OVER w AS accuracy FROM grouped WINDOW w AS (ORDER BY score DESC)), best AS (SELECT * FROM upto WHERE accuracy >= 0.8 ORDER BY threshold LIMIT 1) SELECT threshold, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy FROM (SELECT 1) LEFT JOIN best ON true",
    "pair_features": f"""WITH {ANSWERS_SQL}, {_FOODS_SQL}, c AS (SELECT normalized_text AS item, CAST({_NO.format('fdc_id')} AS VARCHAR) AS label, max(CASE WHEN NOT isnan(cosine_search) THEN cosine_search END) AS cosine FROM ingredient_candidates WHERE normalized_text IS NOT NULL GROUP BY 1, 2),
x AS (SELECT c.item, c.label, cosine, max(cosine) OVER (PARTITION BY c.item) AS best FROM c),
y AS (SELECT x.*, f.description_raw, f.is_deprioritized, w.label AS won, g.description_raw AS won_description, {_WORDS.format("x.item")} AS a, {_WORDS.format("f.description_raw")} AS b, regexp_split_to_array(trim(lower(x.item)), '\\s+')[-1] AS head, lower(trim(split_part(f.description_raw, ',', 1))) AS facet FROM x JOIN foods f ON f.label = x.label LEFT JOIN winners w ON w.item = x.item AND w.label IS NOT NULL LEFT JOIN foods g ON g.label = w.label),
z AS (SELECT *, {_TAIL} AS tail FROM y)
SELECT item AS normalized_text, label AS fdc_id, round(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS jaccard, round(jaro_winkler_similarity(regexp_replace(lower(item), '[^ -~]', '?', 'g'), regexp_replace(lower(description_raw), '[^ -~]', '?', 'g')), 6) AS jaro_winkler,
  CASE WHEN trim(item) = '' THEN 0.0 WHEN facet IN (head, head || 's', regexp_replace(head, 's+$', '')) THEN 1.0 WHEN list_contains(regexp_split_to_array(facet, '\\s+'), head) THEN 0.5 ELSE 0.0 END::DOUBLE AS head_facet,
  round(coalesce(len(list_filter(tail, lambda w: list_contains({_PLAIN}, w) OR regexp_matches(w, '^[0-9]+$')))::DOUBLE / nullif(len(tail), 0), 1), 6) AS plain_share, coalesce(is_deprioritized::INT::DOUBLE, 0.0) AS is_deprioritized, round(cosine - best, 6) AS margin,
  CASE WHEN won IS NOT NULL THEN label = won OR coalesce(description_raw = won_description, false) END AS target FROM z""",
    "same_food_spread": f"WITH {_TOP1_SQL}, {_FOODS_SQL}, f AS (SELECT label, array_to_string({_KEY}, '|') AS food, kcal_per_100g FROM foods), mine AS (SELECT item, food FROM top1 JOIN f ON f.label = pick), c AS (SELECT DISTINCT normalized_text AS item, CAST({_NO.format('fdc_id')} AS VARCHAR) AS label FROM ingredient_candidates WHERE normalized_text IS NOT NULL) SELECT item AS normalized_text, count(*) AS n, round(coalesce((max(kcal_per_100g) - min(kcal_per_100g)) / nullif(max(kcal_per_100g), 0), 0), 6) AS spread FROM c JOIN f USING (label) JOIN mine USING (item, food) WHERE kcal_per_100g IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "gold_sample": f"WITH t AS (SELECT DISTINCT normalized_text, lower(trim(frequency_stratum)) AS stratum FROM distinct_ingredient_strings WHERE normalized_text IS NOT NULL AND frequency_stratum IS NOT NULL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY stratum ORDER BY sha256('{SEED}|' || normalized_text), normalized_text) AS INTEGER) AS place FROM t) SELECT normalized_text, stratum, place, CASE WHEN place % 3 = 0 THEN 'holdout' ELSE 'tune' END AS split, ('0x' || substr(sha256('control:' || normalized_text), 1, 8))::BIGINT % 100 < 15 AS control FROM r WHERE place <= 100",
    "relabel_draw": f"WITH {ANSWERS_SQL}, t AS (SELECT DISTINCT item AS normalized_text FROM answers), a AS (SELECT normalized_text FROM t ORDER BY sha256('1|' || normalized_text), 1 LIMIT 30), b AS (SELECT normalized_text FROM t WHERE normalized_text NOT IN (SELECT normalized_text FROM a) ORDER BY sha256('2|' || normalized_text), 1 LIMIT 30) SELECT normalized_text, 1 AS number FROM a UNION ALL SELECT normalized_text, 2 FROM b",
    "pending_disagreements": f"WITH {ANSWERS_SQL}, {_EARLIER} SELECT item AS normalized_text, earlier, label, ('0x' || substr(sha256('order|' || item), 1, 8))::BIGINT % 2 = 0 AS earlier_first FROM earlier JOIN winners USING (item) WHERE label IS NOT NULL AND earlier <> label",
    "label_targets": "SELECT normalized_text, CAST(sum(b) AS BIGINT) AS known_to FROM (SELECT DISTINCT normalized_text, 1 AS b FROM ensemble UNION ALL SELECT DISTINCT normalized_text, 2 FROM ingredient_entity_map UNION ALL SELECT DISTINCT normalized_text, 4 FROM ingredient_candidates) WHERE normalized_text IS NOT NULL GROUP BY 1",
    "shuffled_candidates": f"WITH c AS (SELECT DISTINCT normalized_text, fdc_id FROM ingredient_candidates WHERE normalized_text IS NOT NULL AND fdc_id IS NOT NULL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY normalized_text ORDER BY sha256('{SEED}|' || normalized_text || '|' || fdc_id), fdc_id) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 10",
    "food_search": "WITH r AS (SELECT fdc_id, description_raw, CAST(row_number() OVER (ORDER BY length(description_raw), description_raw, fdc_id) AS INTEGER) AS place FROM usda_foods WHERE lower(description_raw) LIKE '%smoked%' AND lower(description_raw) LIKE '%ham%' OR lower(description_raw) LIKE '%curd%') SELECT * FROM r WHERE place <= 50",
    "example_lines": "WITH t AS (SELECT DISTINCT normalized_text, line_raw FROM recipe_ingredient_lines WHERE normalized_text IS NOT NULL AND line_raw IS NOT NULL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY normalized_text ORDER BY line_raw) AS INTEGER) AS place FROM t) SELECT * FROM r WHERE place <= 3",
    "undecided_top": "WITH m AS (SELECT normalized_text, max(occurrence_count) AS occurrence_count, bool_or(abstained) OR bool_or(flagged) AS undecided FROM ingredient_entity_map WHERE normalized_text IS NOT NULL GROUP BY 1) SELECT normalized_text, occurrence_count, (SELECT round(count(*) FILTER (WHERE undecided)::DOUBLE / count(*), 6) FROM m) AS share FROM m WHERE undecided ORDER BY occurrence_count DESC NULLS LAST, normalized_text LIMIT 3",
    "grams_summary": "SELECT coalesce(method, 'none') AS method, count(*) AS n, count(grams) AS n_weighed, round(min(grams), 4) AS least, round(median(grams), 4) AS middle, round(max(grams), 4) AS most FROM recipe_ingredient_grams WHERE grams IS NULL OR NOT isnan(grams) GROUP BY 1",
    "top_units": "SELECT lower(trim(unit)) AS unit, count(DISTINCT normalized_text) AS n_strings, count(*) AS n FROM recipe_ingredient_lines WHERE unit IS NOT NULL AND normalized_text IS NOT NULL GROUP BY 1 ORDER BY n_strings DESC, unit LIMIT 12",
    "recipe_steps": f"WITH last AS (SELECT {_NO.format('recipe_id')} AS recipe_no, max({{'ingested_at': ingested_at, 'title': title, 'source_url': source_url, 'directions': directions}}) AS r FROM recipe_meta WHERE {_NO.format('recipe_id')} IS NOT NULL GROUP BY 1), l AS (SELECT recipe_no, list_filter(list_transform(CASE WHEN json_valid(r.directions) AND json_type(CASE WHEN json_valid(r.directions) THEN r.directions END) = 'ARRAY' THEN from_json(r.directions, '[\"VARCHAR\"]') ELSE [] END, lambda x: trim(x)), lambda x: x <> '') AS steps FROM last) SELECT recipe_no, CAST(generate_subscripts(steps, 1) - 1 AS INTEGER) AS place, unnest(steps) AS step FROM l",
    "band_distribution": f"WITH {_FOODS_SQL}, m AS (SELECT DISTINCT CAST({_NO.format('fdc_id')} AS VARCHAR) AS label, kcal_per_100g AS a FROM ingredient_entity_map), e AS (SELECT CASE WHEN abs(a - kcal_per_100g) <= 5 THEN 0 ELSE abs(a - kcal_per_100g) / greatest(abs(a), abs(kcal_per_100g)) END AS err FROM m JOIN foods USING (label) WHERE a IS NOT NULL AND kcal_per_100g IS NOT NULL), b AS (SELECT CASE WHEN err < 0.1 THEN 'under 0.10' WHEN err < 0.25 THEN 'under 0.25' WHEN err < 0.5 THEN 'under 0.50' ELSE 'beyond' END AS band FROM e) SELECT v.band, count(b.band) AS n FROM (VALUES ('under 0.10'), ('under 0.25'), ('under 0.50'), ('beyond')) AS v(band) LEFT JOIN b ON b.band = v.band GROUP BY 1",
}
