"""Queries of the training-data operators on the project's tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillet.llm import labels, leakage, mapping, packing, sampling, subjects, topn
from skillet.session import table

#: Where the public vocabulary files lie; a parameter of the packing operator.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
STRATA = ("head", "mid", "tail")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return labels.last_answers(table(spark, d, "ensemble"), "normalized_text", "annotator", "fdc_id", "judged_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    items, _ = labels.consensus(_answers(spark, d))
    return items.select(F.col("item").alias("normalized_text"), F.col("label").alias("fdc_id"))


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    return labels.consensus(_answers(spark, d))[1]


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return labels.krippendorff(_answers(spark, d)).withColumn("alpha", F.round("alpha", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    sample, residuals = _drawn(spark, d)
    return sampling.unmet(sample, residuals, table(spark, d, "distinct_ingredient_strings"), table(spark, d, "manifest"), STRATA).select("manifest_id", "stratum")


def _drawn(spark: SparkSession, d: str):
    items = sampling.strata_of(table(spark, d, "distinct_ingredient_strings"), STRATA)
    return sampling.draw(items, "item", [F.col("stratum")], sampling.manifest_rows(table(spark, d, "manifest"), STRATA))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn strings of every manifest."""
    return _drawn(spark, d)[0].select("manifest_id", F.col("item").alias("normalized_text"), F.col("_m0").alias("stratum"))


def p4_residuals(spark: SparkSession, d: str) -> DataFrame:
    """What every manifest asks of each stratum and what it gets."""
    return spark.createDataFrame(_drawn(spark, d)[1], "manifest_id string, margin int, category string, asked double, drawn bigint").select("manifest_id", "category", "asked", "drawn")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "ingredient_candidates"), "normalized_text", "fdc_id", "cosine_search").select("normalized_text", "fdc_id")


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "ingredient_candidates"), "normalized_text", "fdc_id", "cosine_search")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return mapping.map_names(table(spark, d, "distinct_ingredient_strings"), "normalized_text", table(spark, d, "usda_foods"), "fdc_id", "canonical_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).where("fdc_id is not null").select("normalized_text", "fdc_id")


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).where("fdc_id is null").select("normalized_text")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), TOKENIZER, CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents"), TOKENIZER, CAPACITY), CAPACITY)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlaps(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(*[table(spark, d, t) for t in ("documents", "subject_labels", "subject_areas", "eval_items")])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.corpus_shares(_subjects(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_annotators, p3_agreement, p4_found, p4_sample, p4_residuals, p6_found, p6_top, p7_found, p7_unmatched,
        p8_pack, p8_fill, p9_found, p9_overlaps, p10_found, p10_composition,
    )
}

_ALLOTTED = """
WITH have AS (
  SELECT lower(trim(frequency_stratum)) AS stratum, count(DISTINCT normalized_text) AS n FROM distinct_ingredient_strings WHERE lower(trim(frequency_stratum)) IN ('head', 'mid', 'tail') GROUP BY 1
), parts AS (
  SELECT manifest_id, coalesce(total, 0) AS total, coalesce(min_per_stratum, 0) AS least, s.stratum, coalesce(s.part, 0) AS part, sum(coalesce(s.part, 0)) OVER (PARTITION BY manifest_id) AS whole
  FROM manifest, LATERAL (VALUES ('head', per_stratum.head), ('mid', per_stratum.mid), ('tail', per_stratum.tail)) AS s(stratum, part)
  WHERE manifest_id IS NOT NULL
), wish AS (
  SELECT manifest_id, parts.stratum, total * coalesce(part / nullif(whole, 0), 0) AS goal, least, coalesce(n, 0) AS holds, n IS NOT NULL AS known FROM parts LEFT JOIN have USING (stratum)
), whole AS (
  SELECT *, least(floor(least(goal, holds) + 1e-9), holds) AS base, least(goal, holds) AS capped FROM wish
), spare AS (
  SELECT *, floor(sum(capped) OVER (PARTITION BY manifest_id) + 0.5) - sum(base) OVER (PARTITION BY manifest_id) AS spare,
    row_number() OVER (PARTITION BY manifest_id, base < holds ORDER BY base - capped, stratum) AS place FROM whole
), allotted AS (SELECT manifest_id, stratum AS category, greatest(goal, least::DOUBLE) AS asked, CAST(greatest(base + CASE WHEN base < holds AND place <= spare THEN 1 ELSE 0 END, least(least, holds)) AS BIGINT) AS drawn FROM spare)
"""
_TOP = """
WITH best AS (
  SELECT normalized_text, fdc_id, max(cosine_search) AS cosine_search FROM ingredient_candidates
  WHERE cosine_search IS NOT NULL AND NOT isnan(cosine_search) AND normalized_text IS NOT NULL AND fdc_id IS NOT NULL GROUP BY 1, 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY normalized_text ORDER BY cosine_search DESC, fdc_id) AS place FROM best
)
"""
SQL = {
    "p4_found": """
WITH have AS (
  SELECT lower(trim(frequency_stratum)) AS stratum, count(DISTINCT normalized_text) AS n FROM distinct_ingredient_strings GROUP BY 1
), wish AS (
  SELECT manifest_id, s.stratum, greatest(coalesce(total * (coalesce(s.part, 0) / nullif(coalesce(per_stratum.head, 0) + coalesce(per_stratum.mid, 0) + coalesce(per_stratum.tail, 0), 0)), 0), coalesce(min_per_stratum, 0)) AS asked
  FROM manifest, LATERAL (VALUES ('head', per_stratum.head), ('mid', per_stratum.mid), ('tail', per_stratum.tail)) AS s(stratum, part)
)
SELECT manifest_id, wish.stratum FROM wish LEFT JOIN have ON have.stratum = wish.stratum WHERE coalesce(n, 0) < asked - 1e-9
""",
    "p4_residuals": _ALLOTTED + "SELECT manifest_id, category, asked, drawn FROM allotted",
    "p4_sample": _ALLOTTED + """, strings AS (SELECT DISTINCT normalized_text, lower(trim(frequency_stratum)) AS stratum FROM distinct_ingredient_strings WHERE normalized_text IS NOT NULL),
placed AS (
  SELECT manifest_id, normalized_text, stratum, drawn, row_number() OVER (PARTITION BY manifest_id, stratum ORDER BY -ln((('0x' || substr(md5(coalesce(seed, 0) || '|' || normalized_text), 1, 13))::BIGINT + 0.5) / 4503599627370496.0), normalized_text) AS place
  FROM allotted JOIN strings ON strings.stratum = allotted.category JOIN manifest USING (manifest_id)
)
SELECT manifest_id, normalized_text, stratum FROM placed WHERE place <= drawn
""",
    "p9_found": r"""
WITH texts AS (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'i', item_id, coalesce(text, '') FROM eval_items),
bare AS (SELECT kind, id, regexp_replace(regexp_replace(t, '(?i)</?(?:a|b|i|u|em|strong|span|mark|small|sub|sup|font|code)(?:\s[^<>]*)?>', '', 'g'), '</?[A-Za-z!][^<>]*>|&(?:[a-zA-Z]+|#\d+);', ' ', 'g') AS t FROM texts),
plain AS (SELECT kind, id, replace(replace(strip_accents(regexp_replace(lower(t), '[\p{Mn}\p{Cf}]', '', 'g')), 'ß', 'ss'), 'æ', 'ae') AS t FROM bare),
words AS (SELECT kind, id, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM plain WHERE id IS NOT NULL),
runs AS (SELECT kind, id, unnest(list_transform(range(1, greatest(len(w) - 8, 1)), lambda k: array_to_string(w[k : k + 9], ' '))) AS run FROM words)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.kind = 'd' AND i.kind = 'i' AND d.run = i.run
""",
    "p6_found": _TOP + "SELECT normalized_text, fdc_id FROM ranked WHERE place <= 5",
    "p6_top": _TOP + "SELECT normalized_text, fdc_id, cosine_search, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 5",
    "p3_agreement": """
WITH said AS (
  SELECT normalized_text AS item, lower(trim(annotator)) AS who,
    arg_max(CASE WHEN lower(trim(fdc_id)) = 'none' THEN 'none' ELSE coalesce(CAST(try_cast(nullif(regexp_replace(fdc_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS VARCHAR), '') END, (judged_at, coalesce(CASE WHEN lower(trim(fdc_id)) = 'none' THEN 'none' ELSE CAST(try_cast(nullif(regexp_replace(fdc_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS VARCHAR) END, ''))) AS label
  FROM ensemble GROUP BY 1, 2
), counts AS (SELECT item, label, count(*) AS c FROM said WHERE label <> '' GROUP BY 1, 2),
per AS (SELECT item, sum(c) AS n, sum(c * c) AS sq FROM counts GROUP BY 1 HAVING sum(c) > 1),
obs AS (SELECT sum((n * n - sq)::DOUBLE / (n - 1)) AS differ, sum(n)::DOUBLE AS n, count(*) AS n_items FROM per),
lab AS (SELECT sum(c * c)::DOUBLE AS sq FROM (SELECT label, sum(c) AS c FROM counts JOIN per USING (item) GROUP BY 1))
SELECT round(1 - differ / ((n * n - sq) / (n - 1)), 6) AS alpha, CAST(n_items AS BIGINT) AS n_items, CAST(n AS BIGINT) AS n_answers FROM obs, lab
""",
}
