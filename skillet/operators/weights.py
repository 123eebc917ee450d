"""Weights of parsed lines: by mass, by the size of a pack, by a measured volume or by the piece, and what they are measured with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillet.functions.amounts import ALIASES, NUMBER, PACK_FORMS, UNIT_WORDS, _any_of, number_of, unit_form
from skillet.operators.units import BASES, EDGES, compose

# Measures by which a line without a unit is weighed, in this order; measures of more than one word; texts that name no measure.
COUNT_MEASURES = ["each", "piece", "large", "medium", "racc", "serving", "small"]
LONG_MEASURES = {"fl oz": "fluid_ounce", "fluid ounce": "fluid_ounce", "fl. oz": "fluid_ounce", "cubic inch": "cubic_inch", "nlea serving": "serving"}
NO_MEASURE = ["", "undetermined", "none", "null"]

#: Groups: how many and which unit a remark in brackets states as the size of a pack; it may follow the opening number at once.
PACK_SIZE = rf"\(\s*({NUMBER})\s*({_any_of(ALIASES)})\.?(?:\s+each)?\s*\)"
PACK_AFTER = r"^\s*[0-9½⅓⅔¼¾]+\s*\("


def _known(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key)


def ways() -> dict[str, tuple[str, float]]:
    """unit -> (base unit, scale) of the units that have a way to a base."""
    found = compose(EDGES)
    return {u: (b, found[u, b][0]) for b in BASES for u in {u for u, _ in found} if (u, b) in found}


def by_path(lines: DataFrame, portions: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, grams and method of each line; both null where no way applies, never 0.

    ``lines``: keep, thing, quantity, unit (canonical), line_raw. ``portions`` (thing, measure, grams): the weight of one
    measure of a thing. The first way that gives more than 0 counts: ``mass``; ``pack_size`` for packs, the number
    in brackets being the size of one pack if it follows the opening number at once, else of all; ``volumetric`` by the thing's own
    weight of the measure, ``volumetric_derived`` by that of its largest other volume; ``pack_size`` for the rest;
    ``count`` for lines without a unit, by the first of ``COUNT_MEASURES`` that is weighed. Repeated lines stay repeated.
    """
    to = ways()
    masses, volumes = {u: s for u, (b, s) in to.items() if b == "gram"}, {u: s for u, (b, s) in to.items() if b == "milliliter"}
    clean = portions.where((F.col("grams") > 0) & ~F.isnan("grams")).select("thing", "measure", "grams").groupBy("thing", "measure").agg(F.median("grams").alias("grams"))
    size = _known(volumes, F.col("measure"))
    rank = F.array_position(F.array(*[F.lit(m) for m in COUNT_MEASURES]), F.col("measure"))
    per = clean.groupBy("thing").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", "grams"))).alias("_own"),
        F.max(F.when(size.isNotNull(), F.struct(size.alias("s"), (F.col("grams") / size).alias("g")))).alias("_ml"),
        F.min(F.when(rank > 0, F.struct(rank.alias("r"), "grams"))).alias("_one"),
    )
    low = F.lower("line_raw")
    n, form = F.regexp_extract(low, PACK_SIZE, 1), F.regexp_extract(low, PACK_SIZE, 2)
    read = lines.withColumn("_p", F.array(F.struct(F.nullif(n, F.lit("")).alias("n"), unit_form(form).alias("form"))))
    read = read.select(*keep, "thing", "quantity", "unit", "line_raw", F.inline("_p")).join(per, "thing", "left")
    q, u = F.col("quantity"), F.col("unit")
    pack_unit = _known(ALIASES, F.col("form"))
    one = number_of(F.col("n"))
    times = F.when(F.col("line_raw").rlike(PACK_AFTER), F.coalesce(q, F.lit(1.0))).otherwise(1.0)
    pack = times * one * F.coalesce(_known(masses, pack_unit), _known(volumes, pack_unit) * F.col("_ml.g"))
    is_pack = F.coalesce(u.isin(*PACK_FORMS), F.lit(False))
    own = F.when(_known(volumes, u).isNotNull(), q * F.try_element_at("_own", u))
    found = [
        (q * _known(masses, u), "mass"), (F.when(is_pack, pack), "pack_size"), (own, "volumetric"), (q * _known(volumes, u) * F.col("_ml.g"), "volumetric_derived"),
        (F.when(~is_pack, pack), "pack_size"), (F.when(u.isNull(), q * F.col("_one.grams")), "count"),
    ]
    best = F.coalesce(*[F.when(g > 0, F.struct(g.alias("grams"), F.lit(m).alias("method"))) for g, m in found])
    return read.select(*keep, F.inline(F.array(F.struct(best.alias("_b"))))).select(*keep, F.col("_b.grams").alias("grams"), F.col("_b.method").alias("method"))


def measure_of(modifier: Column, unit: Column) -> Column:
    """struct<measure, qualifier> of a portion: the modifier counts before the unit; what narrows a measure is its qualifier.

    A measure is one of ``LONG_MEASURES``, else a known unit word that opens the text (unless a unit follows it), else the whole text before a comma.
    """
    given = lambda c: F.nullif(F.when(F.lower(F.trim(c)).isin(*NO_MEASURE), F.lit("")).otherwise(F.lower(F.trim(c))), F.lit(""))
    source = F.coalesce(given(modifier), given(unit))
    remark = F.nullif(F.trim(F.array_join(F.regexp_extract_all(source, F.lit(r"\(([^)]*)\)"), F.lit(1)), " ")), F.lit(""))
    rest = F.trim(F.regexp_replace(source, r"\([^)]*\)", " "))
    head, tail = F.trim(F.substring_index(rest, ",", 1)), F.nullif(F.trim(F.when(F.contains(rest, F.lit(",")), F.regexp_replace(rest, "^[^,]*,", ""))), F.lit(""))
    long = rf"^({'|'.join(k.replace('.', '[.]') for k in sorted(LONG_MEASURES, key=len, reverse=True))})(?: +(.*))?$"
    first, more = F.regexp_extract(head, r"^(\S+)\s*(.*)$", 1), F.regexp_extract(head, r"^(\S+)\s*(.*)$", 2)
    opened = _known(UNIT_WORDS, first)
    takes = opened.isNotNull() & ((more == "") | _known(UNIT_WORDS, more).isNull())
    measure = F.when(head.rlike(long), _known(LONG_MEASURES, F.regexp_extract(head, long, 1))).when(takes, opened).otherwise(F.nullif(head, F.lit("")))
    extra = F.nullif(F.when(head.rlike(long), F.regexp_extract(head, long, 2)).when(takes, more), F.lit(""))
    return F.struct(measure.alias("measure"), F.when(source.isNotNull(), F.nullif(F.array_join(F.array_compact(F.array(extra, tail, remark)), ", "), F.lit(""))).alias("qualifier"))


def portion_weight(amount: Column, grams: Column) -> Column:
    """Grams of one measure; a missing amount is 1; null unless both are positive."""
    a = F.coalesce(amount.try_cast("double"), F.lit(1.0))
    return F.when((a > 0) & (grams.try_cast("double") > 0), grams.try_cast("double") / a)
