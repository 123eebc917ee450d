"""How well a written name and the description of a food go together, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that leave a food in its ordinary form.
PLAIN_MODIFIERS = [
    "raw", "whole", "fresh", "fluid", "regular", "plain", "unprepared", "all-purpose", "enriched", "bleached", "unbleached",
    "table", "salted", "granulated", "cultured", "full", "fat", "with", "without", "and", "commercial", "stick", "light",
    "large", "or", "added", "solids", "unsalted",
]


def words(text: Column) -> Column:
    """The distinct words of a text; commas and hyphens separate them."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[,\-\s]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, and half a transposition for each match out of order."""
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), -1)
        if j >= 0:
            taken[j] = True
            left.append(c)
    if not left:
        return 0.0
    m = len(left)
    crossed = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken) if t))) // 2
    return (m / len(a) + m / len(b) + (m - crossed) / m) / 3


def jaro_winkler_of(a: str, b: str, weight: float = 0.1, above: float = 0.7) -> float:
    s = jaro(a, b)
    common = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return s + weight * common * (1 - s) if s > above else s


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity without regard to case; null for null. The built-ins have none, so it runs in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler_of(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(F.lower(a), F.lower(b))


def head_facet(name: Column, description: Column) -> Column:
    """1 if the description leads with the last word of the name, but for a plural s; 0.5 if its first facet holds it; else 0."""
    head = F.element_at(F.split(F.trim(F.lower(name)), r"\s+"), -1)
    leading = F.lower(F.trim(F.substring_index(description, ",", 1)))
    same = (leading == head) | (leading == F.concat(head, F.lit("s"))) | (leading == F.regexp_replace(head, "s+$", ""))
    return F.when(F.trim(name) == "", 0.0).when(same, 1.0).when(F.array_contains(F.split(leading, r"\s+"), head), 0.5).otherwise(0.0)


def plain_share(description: Column) -> Column:
    """The share of plain words and numbers among those after the first facet; 1 without any."""
    tail = F.when(F.contains(description, F.lit(",")), F.regexp_replace(description, "^[^,]*,", "")).otherwise("")
    parts = F.filter(F.split(F.lower(tail), r"[,\-\s]+"), lambda w: w != "")
    plain = F.filter(parts, lambda w: w.isin(*PLAIN_MODIFIERS) | w.rlike("^[0-9]+$"))
    return F.coalesce(F.try_divide(F.size(plain).cast("double"), F.size(parts)), F.lit(1.0))


def food_key(description: Column, facets: int = 2) -> Column:
    """The first facets of a description, by which foods count as the same."""
    return F.array_join(F.transform(F.slice(F.split(F.lower(description), ","), 1, facets), F.trim), "|")
