"""Queries of line parsing, names, servings and weights, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillet.functions import amounts, text
from skillet.functions.ids import number_in
from skillet.operators import nested, units, weights
from skillet.operators.queries import _NESTED
from skillet.session import table as T


def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in sorted(table.items())) + "}"


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def number_sql(n: str) -> str:
    """SQL for the number that a text in lower case stands for."""
    glyphs = {g: float(t[0]) / float(t.partition("/")[2]) for g, t in amounts.GLYPHS.items()}
    words = {w: float(v) for w, v in amounts.NUMBER_WORDS.items()}
    part = lambda k: f"(try_cast(split_part(regexp_split_to_array(replace({n}, ',', '.'), '[ -]+')[{k}], '/', 1) AS DOUBLE) / CASE WHEN contains(regexp_split_to_array(replace({n}, ',', '.'), '[ -]+')[{k}], '/') THEN nullif(try_cast(split_part(regexp_split_to_array(replace({n}, ',', '.'), '[ -]+')[{k}], '/', -1) AS DOUBLE), 0) ELSE 1 END)"
    return f"""CASE WHEN regexp_matches({n}, '^[a-z]') THEN {_map(words)}[split_part({n}, ' ', 1)] + CASE WHEN {n} LIKE '%and a half' THEN 0.5 ELSE 0 END
    WHEN regexp_matches({n}, '[{"".join(amounts.GLYPHS)}]') THEN {_map(glyphs)}[right({n}, 1)] + coalesce(try_cast(nullif(regexp_extract({n}, '^[0-9]+', 0), '') AS DOUBLE), 0)
    ELSE {part(1)} + coalesce({part(2)}, 0) END"""


_AFTER = rf"(?is)^((?:(?:{'|'.join(sorted(text.SIZE_WORDS, key=lambda w: (-len(w), w)))})\.?\s+)*)([a-z]+)(?:\.\s*|\s+)(\S.*)$"
PARSED_SQL = f"""
opened AS (
  SELECT *, CASE WHEN regexp_matches(line_raw, '{amounts.PERCENT}') THEN '' ELSE regexp_extract(line_raw, '{amounts.OPENING}', 0) END AS opening FROM SOURCE
), rest AS (
  SELECT *, trim(substr(line_raw, length(opening) + 1)) AS rest, lower(coalesce(nullif(regexp_extract(opening, '{amounts.OPENING}', 1), ''), nullif(regexp_extract(opening, '{amounts.OPENING}', 2), ''))) AS n FROM opened
), worded AS (
  SELECT *, regexp_extract(rest, '{_AFTER}', 2) AS word, regexp_extract(rest, '{_AFTER}', 3) AS follows FROM rest
), parsed AS (
  SELECT * EXCLUDE (opening, rest, n, word, follows, quantity, unit, ingredient_text), nullif({number_sql("n")}, 0) AS quantity,
    coalesce({_map(amounts.LETTER_UNITS)}[word], {_map(amounts.UNIT_WORDS)}[lower(word)]) AS unit,
    CASE WHEN coalesce({_map(amounts.LETTER_UNITS)}[word], {_map(amounts.UNIT_WORDS)}[lower(word)]) IS NOT NULL THEN trim(follows) ELSE rest END AS ingredient_text
  FROM worded
)"""


def parsed_lines(s: SparkSession, d: str) -> DataFrame:
    """Every line with the amount, unit and name that its text states."""
    lines = T(s, d, "recipe_ingredient_lines").select(number_in("recipe_id").alias("recipe_no"), "line_index", "line_raw")
    return lines.select("recipe_no", "line_index", "line_raw", F.inline(F.array(amounts.parsed_line(F.col("line_raw"), text.SIZE_WORDS)))).drop("line_raw")


def normal_names(s: SparkSession, d: str) -> DataFrame:
    """The normal form of every name that the lines are written with."""
    names = T(s, d, "recipe_ingredient_lines").where("ingredient_text is not null").select("ingredient_text").distinct()
    return names.select("ingredient_text", text.normal_name(F.col("ingredient_text")).alias("name"))


def recipe_servings(s: SparkSession, d: str) -> DataFrame:
    """What the title and directions of a recipe's last row state as servings."""
    m = T(s, d, "recipe_meta").where(number_in("recipe_id").isNotNull()).groupBy(number_in("recipe_id").alias("recipe_no")).agg(F.max(F.struct("ingested_at", "title", "source_url", "directions")).alias("r"))
    stated = F.concat(F.coalesce("r.title", F.lit("")), F.lit(" "), F.coalesce("r.directions", F.lit("")))
    return m.select("recipe_no", text.servings(stated).alias("servings"))


def _portions(s, d):
    """(thing, measure, grams) of the reference weights: every measure that is weighed itself."""
    known = units.unit_table(s)
    w = units.reference_weights(T(s, d, "gram_reference"), known).where("unit is not null")
    per = known.select("unit", "scale").distinct()
    return w.join(per, "unit").select("thing", F.col("unit").alias("measure"), (F.col("g_per_base") * F.col("scale")).alias("grams"))


def grams_by_line(s: SparkSession, d: str) -> DataFrame:
    """What every line weighs in whole milligrams (halves go down), and by which way it was found."""
    lines = T(s, d, "recipe_ingredient_lines").select(number_in("recipe_id").alias("recipe_no"), "line_index", F.lower(F.trim("normalized_text")).alias("thing"), "line_raw", F.inline(F.array(amounts.parsed_line(F.col("line_raw"), text.SIZE_WORDS))))
    got = weights.by_path(lines, _portions(s, d), ["recipe_no", "line_index"])
    return got.select("recipe_no", "line_index", F.floor(F.col("grams") * 1000 + 0.4999).alias("milligrams"), "method")


def portions_parsed(s: SparkSession, d: str) -> DataFrame:
    """The portions of the raw foods with their measure, what narrows it, and the weight of one."""
    linked = nested.link(nested.nodes(nested.latest_complete(T(s, d, "raw_usda_foods"), "fdc_id", "raw_payload", "ingested_at")))
    p = nested.flat_table(linked, "portion")
    rows = p.select(F.col("doc").alias("fdc_id"), F.col("key").alias("portion_id"), weights.measure_of(F.col("modifier"), F.col("measureUnit_name")).alias("m"), weights.portion_weight(F.col("amount"), F.col("gramWeight")).alias("grams"))
    return rows.where("m.measure is not null and grams is not null").select("fdc_id", "portion_id", "m.measure", "m.qualifier", F.round("grams", 4).alias("grams"))


def portion_medians(s: SparkSession, d: str) -> DataFrame:
    """Per food and measure the weight without a qualifier, else the median of those with one."""
    by = portions_parsed(s, d).groupBy("fdc_id", "measure").agg(F.median(F.when(F.col("qualifier").isNull(), F.col("grams"))).alias("a"), F.median(F.when(F.col("qualifier").isNotNull(), F.col("grams"))).alias("b"))
    return by.select("fdc_id", "measure", F.round(F.coalesce("a", "b"), 4).alias("grams"))


def gram_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Recorded weights per string and unit against the reference's weight of that unit: median of both and the relative gap."""
    lines = T(s, d, "recipe_ingredient_lines").where("quantity > 0 and unit is not null and not isnan(quantity)").select(number_in("recipe_id").alias("recipe_no"), "line_index", F.lower(F.trim("normalized_text")).alias("thing"), "quantity", amounts.unit_form(F.col("unit")).alias("form")).distinct()
    noted = T(s, d, "recipe_ingredient_grams").where("grams is not null and not isnan(grams)").select(number_in("recipe_id").alias("recipe_no"), "line_index", "grams").distinct()
    unit = weights._known(amounts.ALIASES, F.col("form"))
    seen = lines.join(noted, ["recipe_no", "line_index"]).groupBy("thing", unit.alias("measure")).agg(F.count("*").alias("n"), F.median(F.col("grams") / F.col("quantity")).alias("observed"))
    gap = F.abs(F.col("observed") - F.col("grams")) / F.greatest("observed", "grams")
    return seen.join(_portions(s, d), ["thing", "measure"]).select("thing", "measure", "n", F.round("observed", 7).alias("observed"), F.round("grams", 7).alias("expected"), F.round(gap, 6).alias("gap"))


def _singular_sql(w: str) -> str:
    listed = {x: x for x in text.NOT_PLURAL} | {x: x[:-1] for x in text.IE_PLURALS} | text.IRREGULAR
    ends = " ".join(f"WHEN ends_with({w}, '{e}') THEN {w}[:-{len(e) + 1}] || '{i}'" for e, i in text.ENDINGS)
    return f"coalesce({_map(listed)}[{w}], CASE WHEN length({w}) <= 3 THEN {w} {ends} ELSE {w} END)"


_READINGS = r"""
WITH names AS (SELECT DISTINCT ingredient_text FROM recipe_ingredient_lines WHERE ingredient_text IS NOT NULL),
open AS (SELECT ingredient_text, regexp_replace(lower(ingredient_text), '\([^)]*\)', ' ', 'g') AS t FROM names),
readings AS (
  SELECT ingredient_text, 1 AS k, regexp_split_to_array(split_part(t, ',', 1), '\bor\b')[1] AS r FROM open
  UNION ALL SELECT ingredient_text, 2, split_part(t, ',', 1) FROM open UNION ALL SELECT ingredient_text, 3, t FROM open
)"""
_NAMES = _READINGS + f""", words AS (
  SELECT ingredient_text, k, list_filter(list_transform(regexp_extract_all(r, '{text.NAME_TOKEN}'), lambda w: regexp_replace(w, '^[0-9]+-', '')), lambda w: NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN {_list(text.FILLER)}) AS w FROM readings
), ones AS (SELECT *, list_transform(w, lambda x: {_singular_sql("x")}) AS o FROM words),
ends AS (
  SELECT *, coalesce(list_position(list_transform(w, lambda x: x NOT IN {_list(["of", *text.HEADS])}), true), 0) AS a,
    coalesce(list_position(list_reverse(list_transform(o, lambda x: x NOT IN {_list(text.FILLER)})), true), 0) AS b FROM ones
), cut AS (SELECT *, CASE WHEN b > 0 THEN len(w) - b + 1 ELSE 0 END AS last FROM ends),
named AS (SELECT ingredient_text, k, array_to_string(list_concat(CASE WHEN last > 1 THEN w[CASE WHEN a = 0 THEN last ELSE least(a, last) END : last - 1] ELSE [] END, CASE WHEN last > 0 THEN [o[last]] ELSE [] END), ' ') AS name FROM cut)
SELECT ingredient_text, coalesce(arg_min(name, k) FILTER (WHERE name <> ''), '') AS name FROM named GROUP BY 1"""

_SERVE_PATTERN = rf"(?:\b(?:serves?|makes|yields?)\s*:?|\bservings?\s*:)\s*(?:(?:about|approximately|around)\b)?\s*\b(\d{{1,3}}|{'|'.join(text.SERVING_WORDS)})\b\s*(\d{{1,3}}/\d{{1,3}})?\s*(?:to\b|-|–)?\s*(?:\b\d{{1,3}}\b)?\s*(?:\d{{1,3}}/\d{{1,3}})?\s*(?:\([^)]*\))?\s*(\bdozen\b)?\s*([a-z]+)?\s*([a-z]+)?"


def _servings_sql(t: str) -> str:
    g = [f"regexp_extract(lower({t}), '{_SERVE_PATTERN}', {k})" for k in range(1, 6)]
    n = f"coalesce({_map(text.SERVING_WORDS)}[{g[0]}], try_cast(nullif({g[0]}, '') AS INTEGER))"
    part = f"coalesce(try_cast(nullif(split_part({g[1]}, '/', 1), '') AS DOUBLE) / nullif(try_cast(nullif(split_part({g[1]}, '/', 2), '') AS DOUBLE), 0), 0)"
    value = f"CAST(round_even(({n} + {part}) * CASE WHEN {g[2]} <> '' THEN 12 ELSE 1 END, 0) AS INTEGER)"
    return f"CASE WHEN {value} BETWEEN 1 AND 200 AND {g[3]} NOT IN {_list(text.NO_PORTIONS)} AND {g[4]} NOT IN {_list(text.NO_PORTIONS)} THEN {value} END"


_NO = "try_cast(nullif(regexp_replace({}, '[^0-9]', '', 'g'), '') AS BIGINT)"
_R = _NO.format("recipe_id")
_WAYS = weights.ways()
_UNITS = "(VALUES " + ", ".join(sorted({f"('{f.replace('fl. oz', 'fl oz')}', '{u}', '{_WAYS.get(u, (u, 1.0))[0]}', {_WAYS.get(u, (u, 1.0))[1]!r}::DOUBLE)" for f, u in amounts.ALIASES.items()})) + ") AS units(form, unit, base, scale)"


def _form_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '\s+', ' ', 'g'), '\.+$', ''), '^fl\.? ?oz', 'fl oz')"


def _word_in(words: str) -> str:
    return f"regexp_matches(note, '(^|[^a-z])({words})($|[^a-z])')"


#: (thing, measure, grams) of the reference weights.
_PORTIONS = rf"""
stated AS (
  SELECT lower(trim(normalized_text)) AS thing, {_form_sql("unit")} AS u, lower(coalesce(source_note, '')) AS note, grams_per_unit FROM gram_reference WHERE grams_per_unit > 0 AND NOT isnan(grams_per_unit)
), formed AS (
  SELECT thing, trim(regexp_extract(u, '^({amounts.NUMBER})\s*', 1)) AS lead, {_form_sql(f"regexp_replace(u, '^({amounts.NUMBER})" + chr(92) + "s*', '')")} AS form,
    grams_per_unit * (CASE WHEN {_word_in("mg|milligrams?")} THEN 0.001 WHEN {_word_in("kg|kilos?|kilograms?")} THEN 1000 WHEN {_word_in("lbs?|pounds?")} THEN 453.59237 WHEN {_word_in("oz|ounces?")} THEN 28.349523125 ELSE 1 END
      / CASE WHEN regexp_matches(note, 'per\s+dozen') THEN 12 ELSE coalesce(try_cast(nullif(regexp_extract(note, '(?:per|for|of)\s+(\d+)', 1), '') AS DOUBLE), 1) END) AS g FROM stated
), weighed AS (
  SELECT thing, unit AS measure, g / coalesce(CASE WHEN lead <> '' THEN {number_sql("lead")} END, 1) AS g, scale FROM formed JOIN {_UNITS} USING (form) WHERE base <> 'gram'
), portions AS (SELECT thing, measure, median(g / scale) * any_value(scale) AS grams FROM weighed GROUP BY 1, 2)"""
_SIZE = "CASE measure " + " ".join(f"WHEN '{u}' THEN {s!r}" for u, (b, s) in sorted(_WAYS.items()) if b == "milliliter") + " END"
_G = {u: s for u, (b, s) in _WAYS.items() if b == "gram"}
_ML = {u: s for u, (b, s) in _WAYS.items() if b == "milliliter"}
_GRAMS = "WITH " + PARSED_SQL.replace("SOURCE", "recipe_ingredient_lines") + f""", {_PORTIONS}, per AS (
  SELECT thing, arg_max(grams / {_SIZE}, {_SIZE}) FILTER (WHERE {_SIZE} IS NOT NULL) AS ml, max(grams) FILTER (WHERE measure = 'piece') AS one FROM portions GROUP BY 1
), packed AS (
  SELECT try_cast(nullif(regexp_replace(recipe_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS recipe_no, line_index, line_raw, quantity AS q, p.unit AS u, lower(trim(normalized_text)) AS thing,
    regexp_extract(lower(line_raw), '{weights.PACK_SIZE}', 1) AS n, MAP {{{", ".join(f"'{f}': '{u}'" for f, u in sorted(amounts.ALIASES.items()))}}}[{_form_sql(f"regexp_extract(lower(line_raw), '{weights.PACK_SIZE}', 2)")}] AS pu FROM parsed p
), sized AS (
  SELECT k.*, ml, one, o.grams AS own, CASE WHEN regexp_matches(line_raw, '{weights.PACK_AFTER}') THEN coalesce(q, 1) ELSE 1 END * CASE WHEN n <> '' THEN {number_sql("n")} END * coalesce({_map(_G)}[pu], {_map(_ML)}[pu] * ml) AS pack, coalesce(u IN {_list(amounts.PACK_FORMS)}, false) AS is_pack
  FROM packed k LEFT JOIN per ON per.thing = k.thing LEFT JOIN portions o ON o.thing = k.thing AND o.measure = k.u AND {_map(_ML)}[k.u] IS NOT NULL
), found AS (SELECT recipe_no, line_index, list_filter([{{'g': q * {_map(_G)}[u], 'm': 'mass'}}, {{'g': CASE WHEN is_pack THEN pack END, 'm': 'pack_size'}}, {{'g': q * own, 'm': 'volumetric'}}, {{'g': q * {_map(_ML)}[u] * ml, 'm': 'volumetric_derived'}}, {{'g': CASE WHEN NOT is_pack THEN pack END, 'm': 'pack_size'}}, {{'g': CASE WHEN u IS NULL THEN q * one END, 'm': 'count'}}], lambda x: x.g > 0)[1] AS b FROM sized)
SELECT recipe_no, line_index, CAST(floor(b.g * 1000 + 0.4999) AS BIGINT) AS milligrams, b.m AS method FROM found"""
_LONG = "|".join(k.replace(".", "[.]") for k in sorted(weights.LONG_MEASURES, key=len, reverse=True))
_MEASURES = _NESTED + rf""", said AS (
  SELECT fdc_id, child_id AS portion_id, coalesce(CASE WHEN lower(trim(o ->> '$.modifier')) NOT IN {_list(weights.NO_MEASURE)} THEN lower(trim(o ->> '$.modifier')) END, CASE WHEN lower(trim(o ->> '$.measureUnit.name')) NOT IN {_list(weights.NO_MEASURE)} THEN lower(trim(o ->> '$.measureUnit.name')) END) AS source,
    coalesce(try_cast(o ->> '$.amount' AS DOUBLE), 1) AS a, try_cast(o ->> '$.gramWeight' AS DOUBLE) AS g FROM portion
), cut AS (SELECT *, nullif(trim(array_to_string(regexp_extract_all(source, '\(([^)]*)\)', 1), ' ')), '') AS remark, trim(regexp_replace(source, '\([^)]*\)', ' ', 'g')) AS rest FROM said),
parts AS (SELECT *, trim(split_part(rest, ',', 1)) AS head, nullif(trim(CASE WHEN contains(rest, ',') THEN regexp_replace(rest, '^[^,]*,', '') END), '') AS tail FROM cut),
words AS (SELECT *, regexp_matches(head, '^({_LONG})(?: +(.*))?$') AS long, regexp_extract(head, '^(\S+)\s*(.*)$', 1) AS first, regexp_extract(head, '^(\S+)\s*(.*)$', 2) AS more FROM parts),
taken AS (SELECT *, {_map(amounts.UNIT_WORDS)}[first] IS NOT NULL AND (more = '' OR {_map(amounts.UNIT_WORDS)}[more] IS NULL) AS takes FROM words),
named AS (SELECT fdc_id, portion_id, CASE WHEN long THEN {_map(weights.LONG_MEASURES)}[regexp_extract(head, '^({_LONG})', 1)] WHEN takes THEN {_map(amounts.UNIT_WORDS)}[first] ELSE nullif(head, '') END AS measure,
  nullif(array_to_string(list_filter([nullif(CASE WHEN long THEN regexp_extract(head, '^({_LONG})(?: +(.*))?$', 2) WHEN takes THEN more END, ''), tail, remark], lambda x: x IS NOT NULL), ', '), '') AS qualifier, CASE WHEN a > 0 AND g > 0 THEN round(g / a, 4) END AS grams FROM taken),
usable AS (SELECT * FROM named WHERE measure IS NOT NULL AND grams IS NOT NULL)"""

# Problem 2. RE2 has no look-around, so what may stand before and after an amount is matched with it.
_AMOUNT = "(?:^|[^a-z0-9/.,])" + amounts.AMOUNT.removeprefix("(?<![a-z0-9/.,])").removesuffix("(?![a-z])") + "(?:$|[^a-z])"
_WEIGHED = rf"""
WITH {_PORTIONS}, per_unit AS (
  SELECT thing, base, unit, median(g / coalesce(CASE WHEN lead <> '' THEN {number_sql("lead")} END, 1) / scale) AS own FROM formed JOIN {_UNITS} USING (form) WHERE base <> 'gram' GROUP BY 1, 2, 3
), per_base AS (SELECT thing, base, median(own) AS other FROM per_unit GROUP BY 1, 2),
texts AS (
  SELECT recipe_id, line_index, lower(trim(normalized_text)) AS thing, quantity, unit AS u, CASE WHEN length(coalesce(ingredient_text, normalized_text)) > 0 THEN replace(lower(line_raw), lower(coalesce(ingredient_text, normalized_text)), ' ') ELSE lower(line_raw) END AS rest FROM recipe_ingredient_lines
), read AS (
  SELECT *, nullif(regexp_extract(rest, '{_AMOUNT}', 1), '') AS n, nullif(regexp_extract(rest, '{_AMOUNT}', 2), '') AS size, {_form_sql(f"nullif(regexp_extract(rest, '{_AMOUNT}', 3), '')")} AS written FROM texts
), amounts AS (
  SELECT recipe_id, line_index, thing, coalesce({number_sql("n")}, CASE WHEN written IS NULL THEN quantity END) * CASE WHEN size IS NULL THEN 1 ELSE {number_sql("size")} END AS n, coalesce(written, {_form_sql("u")}) AS form FROM read WHERE written IS NOT NULL OR u IS NOT NULL
), weighed_lines AS (
  SELECT recipe_id, line_index, units.unit, units.base, CASE WHEN units.base = 'gram' THEN n * scale ELSE n * scale * coalesce(own, other) END AS grams
  FROM amounts JOIN {_UNITS} USING (form) LEFT JOIN per_unit ON per_unit.thing = amounts.thing AND per_unit.base = units.base AND per_unit.unit = units.unit LEFT JOIN per_base ON per_base.thing = amounts.thing AND per_base.base = units.base
  WHERE n IS NOT NULL
)"""

QUERIES = {f.__name__: f for f in (parsed_lines, normal_names, recipe_servings, grams_by_line, portions_parsed, portion_medians, gram_accuracy)}
SQL = {
    "p2_coverage": _WEIGHED + " SELECT unit, base, count(*) AS n_lines, count(grams) AS n_weighed FROM weighed_lines GROUP BY 1, 2",
    "p2_found": _WEIGHED + f", noted AS (SELECT {_R} AS recipe_no, line_index, grams AS recorded FROM recipe_ingredient_grams WHERE grams IS NOT NULL AND NOT isnan(grams)), lines AS (SELECT {_R} AS recipe_no, line_index, grams FROM weighed_lines WHERE grams IS NOT NULL) SELECT DISTINCT recipe_no, line_index FROM lines JOIN noted USING (recipe_no, line_index) WHERE recorded > 2 * grams OR recorded < grams / 2",
    "parsed_lines": "WITH " + PARSED_SQL.replace("SOURCE", "recipe_ingredient_lines") + f" SELECT {_R} AS recipe_no, line_index, quantity, unit, ingredient_text FROM parsed",
    "normal_names": _NAMES,
    "grams_by_line": _GRAMS,
    "portions_parsed": _MEASURES + " SELECT * FROM usable",
    "portion_medians": _MEASURES + " SELECT fdc_id, measure, round(coalesce(median(grams) FILTER (WHERE qualifier IS NULL), median(grams) FILTER (WHERE qualifier IS NOT NULL)), 4) AS grams FROM usable GROUP BY 1, 2",
    "gram_accuracy": f"""WITH {_PORTIONS}, l AS (SELECT DISTINCT {_R} AS recipe_no, line_index, lower(trim(normalized_text)) AS thing, quantity, MAP {{{", ".join(f"'{f}': '{u}'" for f, u in sorted(amounts.ALIASES.items()))}}}[{_form_sql("unit")}] AS measure FROM recipe_ingredient_lines WHERE quantity > 0 AND NOT isnan(quantity) AND unit IS NOT NULL),
g AS (SELECT DISTINCT {_R} AS recipe_no, line_index, grams AS noted FROM recipe_ingredient_grams WHERE grams IS NOT NULL AND NOT isnan(grams)), seen AS (SELECT thing, measure, count(*) AS n, median(noted / quantity) AS observed FROM l JOIN g USING (recipe_no, line_index) GROUP BY 1, 2)
SELECT thing, measure, n, round(observed, 7) AS observed, round(grams, 7) AS expected, round(abs(observed - grams) / greatest(observed, grams), 6) AS gap FROM seen JOIN portions USING (thing, measure)""",
    "recipe_servings": f"WITH last AS (SELECT {_R} AS recipe_no, max({{'ingested_at': ingested_at, 'title': title, 'source_url': source_url, 'directions': directions}}) AS r FROM recipe_meta WHERE {_R} IS NOT NULL GROUP BY 1), said AS (SELECT recipe_no, coalesce(r.title, '') || ' ' || coalesce(r.directions, '') AS t FROM last) SELECT recipe_no, {_servings_sql('t')} AS servings FROM said",
}
