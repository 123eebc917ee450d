"""Amounts written in text: digits, fractions, number words, packs with a stated size."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Written forms of the units, by canonical unit.
UNIT_FORMS = {
    "milligram": ["milligram", "milligrams", "mg"],
    "gram": ["gram", "grams", "g", "gr", "gm", "gms"],
    "kilogram": ["kilogram", "kilograms", "kilo", "kilos", "kg"],
    "ounce": ["ounce", "ounces", "oz"],
    "pound": ["pound", "pounds", "lb", "lbs"],
    "milliliter": ["milliliter", "milliliters", "millilitre", "millilitres", "ml", "cc"],
    "deciliter": ["deciliter", "deciliters", "decilitre", "decilitres", "dl"],
    "liter": ["liter", "liters", "litre", "litres", "l"],
    "teaspoon": ["teaspoon", "teaspoons", "tsp"],
    "tablespoon": ["tablespoon", "tablespoons", "tbsp", "tbs"],
    "fluid ounce": ["fluid ounce", "fluid ounces", "fl oz", "fl. oz"],
    "cup": ["cup", "cups", "c"],
    "pint": ["pint", "pints", "pt"],
    "quart": ["quart", "quarts", "qt"],
    "gallon": ["gallon", "gallons", "gal"],
    "pinch": ["pinch", "pinches"],
    "dash": ["dash", "dashes"],
    "cube": ["cube", "cubes"],
    "stick": ["stick", "sticks"],
    "piece": ["piece", "pieces"],
    "head": ["head", "heads"],
    "slice": ["slice", "slices"],
    "pat": ["pat", "pats"],
    "clove": ["clove", "cloves"],
    "sprig": ["sprig", "sprigs"],
    "bunch": ["bunch", "bunches"],
    "stalk": ["stalk", "stalks"],
    "leaf": ["leaf", "leaves"],
}
# Written forms of packs, and of units that only count, by canonical unit.
PACK_FORMS = {
    "package": ["package", "packages", "pkg", "pkgs"],
    "can": ["can", "cans"],
    "jar": ["jar", "jars"],
    "box": ["box", "boxes"],
    "bag": ["bag", "bags"],
    "bottle": ["bottle", "bottles"],
    "carton": ["carton", "cartons"],
    "container": ["container", "containers"],
    "envelope": ["envelope", "envelopes"],
    "packet": ["packet", "packets"],
    "tin": ["tin", "tins"],
}
COUNT_FORMS = {"dozen": ["doz", "dozen"], "drop": ["drop", "drops"]}
# A capital T is a tablespoon, a small t a teaspoon.
LETTER_UNITS = {"T": "tablespoon", "t": "teaspoon"}
# Number words, fraction glyphs.
NUMBER_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "dozen": 12, "half": 0.5, "quarter": 0.25}
GLYPHS = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅐": "1/7", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅑": "1/9", "⅒": "1/10"}

ALIASES = {form: unit for unit, forms in UNIT_FORMS.items() for form in forms}
PACKS = [form for forms in PACK_FORMS.values() for form in forms]
#: Single words that may stand as the unit of a line, with their canonical unit.
UNIT_WORDS = {"tb": "tablespoon"} | {form: unit for table in (UNIT_FORMS, PACK_FORMS, COUNT_FORMS) for unit, forms in table.items() for form in forms if form.isalpha()}


def _any_of(words) -> str:
    """Longest first, so that a short form never hides a longer one; blanks stand for any run of blanks."""
    return "|".join(re.escape(w).replace("\\ ", r"\s*") for w in sorted(words, key=lambda w: (-len(w), w)))


_WORDS = _any_of(w for w in NUMBER_WORDS if w not in ("a", "an"))
_GLYPH = "[" + "".join(GLYPHS) + "]"
NUMBER = rf"\d+\s*{_GLYPH}|{_GLYPH}|\d+[ -]+\d+/\d+|\d+/\d+|\d*[.,]\d+|\d+|(?:{_WORDS})(?: and a half)?"
#: Groups: how many (of a range the first), size of one pack if stated, unit.
AMOUNT = rf"(?<![a-z0-9/.,])({NUMBER})(?:\s*(?:-|–|to|or)\s*(?:{NUMBER}))?\s*(?:(?:x\s*|(?:(?:{_any_of(PACKS)})\s*)?\(\s*)({NUMBER})\s*)?({_any_of(ALIASES)})(?![a-z])"


def _part(p: Column) -> Column:
    """One number or fraction as double."""
    below = F.when(p.contains("/"), F.substring_index(p, "/", -1).try_cast("double")).otherwise(F.lit(1.0))
    return F.try_divide(F.substring_index(p, "/", 1).try_cast("double"), below)


def number_of(c: Column) -> Column:
    """Text of a number (lower case) as double; null if it is none. ``c`` should be a plain column: it is used several times."""
    words = F.create_map(*[x for w, n in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(float(n)))])
    glyphs = F.create_map(*[x for g, t in GLYPHS.items() for x in (F.lit(g), F.lit(float(t[0]) / float(t.partition("/")[2])))])
    word = F.try_element_at(words, F.substring_index(c, " ", 1)) + F.when(c.endswith("and a half"), 0.5).otherwise(0.0)
    glyph = F.try_element_at(glyphs, F.right(c, F.lit(1))) + F.coalesce(F.regexp_extract(c, r"^\d+", 0).try_cast("double"), F.lit(0.0))
    parts = F.split(F.replace(c, F.lit(","), F.lit(".")), "[ -]+")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.when(c.rlike("^[a-z]"), word).when(c.rlike(_GLYPH), glyph).otherwise(_part(first) + F.coalesce(_part(second), F.lit(0.0)))


#: A line opens with a percentage, or with groups: number, number word; a remark in brackets may follow.
PERCENT = r"^\s*\d+(?:[.,]\d+)?\s*%"
DIGITS = NUMBER.rpartition("|(?:")[0]
OPENING = rf"(?i)^\s*(?:({DIGITS})(?:\s*(?:-|–|to|or)\s*(?:{DIGITS}))?|({_any_of(NUMBER_WORDS)})\b)?\s*(?:\([^)]*\)\s*)?"


def parsed_line(line: Column, size_words: list[str]) -> Column:
    """struct<quantity double, unit string, ingredient_text string> of a written line; null for null.

    The line opens with an amount (of a range the first number; 0 is none) unless it is a percentage, then a remark in
    brackets. Words of size may stand before the unit. A word is a unit only if something follows it. Use it behind
    ``inline(array(...))``, so that it is worked out once.
    """
    opening = F.when(line.rlike(PERCENT), F.lit("")).otherwise(F.regexp_extract(line, OPENING, 0))
    number = F.lower(F.coalesce(*[F.nullif(F.regexp_extract(opening, OPENING, k), F.lit("")) for k in (1, 2)]))
    rest = F.trim(F.substring(line, F.length(opening) + 1, F.length(line)))
    after = rf"(?is)^((?:(?:{_any_of(size_words)})\.?\s+)*)([a-z]+)(?:\.\s*|\s+)(\S.*)$"
    word, follows = F.regexp_extract(rest, after, 2), F.regexp_extract(rest, after, 3)
    known = lambda table, w: F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), w)
    unit = F.coalesce(known(LETTER_UNITS, word), known(UNIT_WORDS, F.lower(word)))
    return F.struct(F.nullif(number_of(number), F.lit(0.0)).alias("quantity"), unit.alias("unit"), F.when(unit.isNotNull(), F.trim(follows)).otherwise(rest).alias("ingredient_text"))


def unit_form(c: Column) -> Column:
    """A written unit in the form that ``ALIASES`` has: lower case, single blanks, no closing dot, "fl oz"."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), r"\.+$", ""), r"^fl\.? ?oz", "fl oz")


def amount_texts(line: Column, text: Column) -> Column:
    """array of one struct<n string, size string, form string> read from a line, to be put through ``inline``.

    ``text`` is the part of the line that names the thing; it is taken out
    first, so that no word of it counts as a unit. Fields are null where the
    line states none. The array keeps the optimizer from reading each line
    again for every filter on what was read.
    """
    line = F.lower(line)
    rest = F.when(F.length(text) > 0, F.replace(line, F.lower(text), F.lit(" "))).otherwise(line)
    n, size, form = [F.nullif(F.regexp_extract(rest, AMOUNT, k), F.lit("")) for k in (1, 2, 3)]
    return F.array(F.struct(n.alias("n"), size.alias("size"), unit_form(form).alias("form")))
