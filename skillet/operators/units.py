"""Quantities in different units brought to one unit through a graph of conversions.

Every conversion is an edge ``source -> target`` with an affine function
``scale * x + offset``. Edges that hold everywhere form one small graph whose
shortest compositions are precomputed; edges that hold only for one thing (the
weight of a cup of flour) carry that thing as their scope and are composed with
the former by equi-joins, so the scoped table may be of any size.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillet.functions.amounts import ALIASES, NUMBER, amount_texts, number_of, unit_form
from skillet.functions.ids import number_in


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    scale: float
    offset: float = 0.0


def _then(f: tuple[float, float], g: tuple[float, float]) -> tuple[float, float]:
    """g after f."""
    return f[0] * g[0], f[1] * g[0] + g[1]


def compose(edges: list[Edge]) -> dict[tuple[str, str], tuple[float, float, int]]:
    """(source, target) -> (scale, offset, steps) along a shortest path; edges also count backwards.

    The graph is walked on the driver: it holds units, not data. Among equally short paths the one that comes
    first by name is taken. An edge of scale 0 can't be turned back and raises.
    """
    out: dict[str, dict[str, tuple[float, float]]] = defaultdict(dict)
    for e in edges:
        if e.scale == 0:
            raise ValueError(f"{e.source} -> {e.target}: a scale of 0 can't be turned back")
        out[e.source].setdefault(e.target, (e.scale, e.offset))
        out[e.target].setdefault(e.source, (1 / e.scale, -e.offset / e.scale))
    found = {}
    for start in sorted(out):
        reached, queue = {start: (1.0, 0.0, 0)}, deque([start])
        while queue:
            at = queue.popleft()
            for to in sorted(out[at]):
                if to not in reached:
                    scale, offset, steps = reached[at]
                    reached[to] = (*_then((scale, offset), out[at][to]), steps + 1)
                    queue.append(to)
        found |= {(start, to): f for to, f in reached.items()}
    return found


def inconsistent(edges: list[Edge], tolerance: float = 1e-3) -> list[tuple[Edge, float]]:
    """Edges that close a cycle whose composition isn't the identity, with the relative error.

    A spanning forest is laid in the order given; each edge outside it closes
    one cycle, and these cycles generate all others.
    """
    bad, tree = [], []
    for e in edges:
        known = compose(tree).get((e.source, e.target)) if tree else None
        if known is None:
            tree.append(e)
            continue
        probe = 100.0
        a, b = known[0] * probe + known[1], e.scale * probe + e.offset
        error = abs(a - b) / max(abs(a), abs(b), 1e-12)
        if error > tolerance:
            bad.append((e, error))
    return bad


#: Exact mass units and US kitchen measures on a cup of 236.6 ml.
CUP_ML = 236.6
EDGES = [
    Edge("milligram", "gram", 0.001),
    Edge("kilogram", "gram", 1000.0),
    Edge("ounce", "gram", 28.349523125),
    Edge("pound", "ounce", 16.0),
    Edge("liter", "milliliter", 1000.0),
    Edge("deciliter", "milliliter", 100.0),
    Edge("cup", "milliliter", CUP_ML),
    Edge("tablespoon", "teaspoon", 3.0),
    Edge("cup", "tablespoon", 16.0),
    Edge("fluid ounce", "tablespoon", 2.0),
    Edge("cup", "fluid ounce", 8.0),
    Edge("pint", "cup", 2.0),
    Edge("quart", "pint", 2.0),
    Edge("gallon", "quart", 4.0),
    Edge("gallon", "cup", 16.0),
    Edge("pound", "gram", 453.59237),
]
BASES = ("gram", "milliliter")


def unit_table(spark: SparkSession, edges: list[Edge] = EDGES, bases: tuple[str, ...] = BASES) -> DataFrame:
    """(form, unit, base, scale, offset): each written form of a unit with its way to a base unit.

    Units without a way to any base are their own base.
    """
    if bad := inconsistent(edges):
        raise ValueError(f"conversions contradict each other: {bad}")
    ways = compose(edges)
    rows = []
    for form, unit in ALIASES.items():
        base = next((b for b in bases if (unit, b) in ways), unit)
        scale, offset, _ = ways.get((unit, base), (1.0, 0.0, 0))
        rows.append((form.replace("fl. oz", "fl oz"), unit, base, scale, offset))
    return spark.createDataFrame(sorted(set(rows)), "form string, unit string, base string, scale double, offset double")


def scale_in_note(note: Column) -> Column:
    """Grams for one of the stated weights, from a remark: its unit if it names one, divided by the number it covers."""
    note = F.lower(F.coalesce(note, F.lit("")))
    mass = (
        F.when(note.rlike(r"(?<![a-z])(mg|milligrams?)(?![a-z])"), 0.001)
        .when(note.rlike(r"(?<![a-z])(kg|kilos?|kilograms?)(?![a-z])"), 1000.0)
        .when(note.rlike(r"(?<![a-z])(lbs?|pounds?)(?![a-z])"), 453.59237)
        .when(note.rlike(r"(?<![a-z])(oz|ounces?)(?![a-z])"), 28.349523125)
        .otherwise(1.0)
    )
    covered = F.nullif(F.regexp_extract(note, r"(?:per|for|of)\s+(\d+)", 1), F.lit("")).try_cast("double")
    covered = F.when(note.rlike(r"per\s+dozen"), 12.0).otherwise(F.coalesce(covered, F.lit(1.0)))
    return F.try_divide(mass, covered)


def reference_weights(reference: DataFrame, units: DataFrame) -> DataFrame:
    """(thing, base, unit, g_per_base): scoped edges from a table of weighed measures.

    ``reference``: normalized_text, unit, grams_per_unit, source_note. The unit
    may open with a number ("100 leaf"), the note may name the scale. Weights
    that are null or not positive and units that are not known are left out;
    several sources of one unit give their median, and so do several units
    with the same base for every unit that isn't weighed itself (``unit`` null).
    """
    u = unit_form(F.col("unit"))
    n = F.nullif(F.trim(F.regexp_extract(u, rf"^({NUMBER})\s*(?![0-9])", 1)), F.lit(""))
    form = unit_form(F.regexp_replace(u, rf"^(?:{NUMBER})\s*(?![0-9])", ""))
    rows = (
        reference.where((F.col("grams_per_unit") > 0) & ~F.isnan("grams_per_unit"))
        .select(F.lower(F.trim("normalized_text")).alias("thing"), F.inline(F.array(F.struct(n.alias("n"), form.alias("form")))), (F.col("grams_per_unit") * scale_in_note(F.col("source_note"))).alias("grams"))
        .select("thing", "form", F.try_divide("grams", F.coalesce(number_of(F.col("n")), F.lit(1.0))).alias("grams"))
        .join(units, "form")
        .where(F.col("base") != "gram")
        .select("thing", "base", "unit", (F.col("grams") / F.col("scale")).alias("g_per_base"))
    )
    own = rows.groupBy("thing", "base", "unit").agg(F.median("g_per_base").alias("g_per_base"))
    return own.unionByName(own.groupBy("thing", "base").agg(F.median("g_per_base").alias("g_per_base")).withColumn("unit", F.lit(None).cast("string")))


def to_grams(lines: DataFrame, reference: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, unit, base, amount (in the base unit) and grams of every line with an amount and a unit.

    ``lines``: line_raw, ingredient_text, normalized_text, quantity, unit. The
    line itself counts; the columns quantity and unit stand in where the line
    has no readable amount or is null. A pack counts as often as its number
    says. ``grams`` is null where the thing isn't weighed in that measure.
    Repeated lines stay repeated.
    """
    units = unit_table(lines.sparkSession)
    weights = reference_weights(reference, units)
    texts = amount_texts(F.col("line_raw"), F.coalesce(F.col("ingredient_text"), F.col("normalized_text")))
    written = F.col("form").isNotNull()
    read = (
        lines.select(*keep, F.lower(F.trim("normalized_text")).alias("thing"), F.col("quantity").alias("_q"), F.col("unit").alias("_u"), F.inline(texts))
        .where(written | F.col("_u").isNotNull())
        .select(
            *keep,
            "thing",
            (F.coalesce(number_of(F.col("n")), F.when(~written, F.col("_q"))) * F.when(F.col("size").isNull(), F.lit(1.0)).otherwise(number_of(F.col("size")))).alias("_n"),
            F.when(written, F.col("form")).otherwise(unit_form(F.col("_u"))).alias("form"),
        )
    )
    based = read.where(F.col("_n").isNotNull()).join(units, "form").select(*keep, "thing", "unit", "base", (F.col("_n") * F.col("scale") + F.col("offset")).alias("amount"))
    own = weights.where(F.col("unit").isNotNull()).withColumnRenamed("g_per_base", "_own")
    other = weights.where(F.col("unit").isNull()).drop("unit").withColumnRenamed("g_per_base", "_other")
    return (
        based.join(own, ["thing", "base", "unit"], "left")
        .join(other, ["thing", "base"], "left")
        .select(*keep, "unit", "base", "amount", F.when(F.col("base") == "gram", F.col("amount")).otherwise(F.col("amount") * F.coalesce("_own", "_other")).alias("grams"))
    )


def off_scale(lines: DataFrame, recorded: DataFrame, reference: DataFrame, factor: float = 2.0) -> DataFrame:
    """(recipe_no, line_index, grams, recorded): recorded weights more than ``factor`` times off the converted amount.

    Lines without a readable recipe_id and null, NaN or missing recorded grams
    are left out; repeated lines and repeated records give one row. An amount
    of 0 makes any other recorded weight wrong.
    """
    converted = to_grams(lines.withColumn("recipe_no", number_in("recipe_id")).where("recipe_no is not null"), reference, ["recipe_no", "line_index"]).where("grams is not null")
    noted = recorded.where(F.col("grams").isNotNull() & ~F.isnan("grams")).select(number_in("recipe_id").alias("recipe_no"), "line_index", F.col("grams").alias("recorded"))
    off = (F.col("recorded") > factor * F.col("grams")) | (F.col("recorded") < F.col("grams") / factor)
    return converted.join(noted, ["recipe_no", "line_index"]).where(off).groupBy("recipe_no", "line_index").agg(F.min("grams").alias("grams"), F.min("recorded").alias("recorded"))
