"""Numbers in written answers held against the facts that they may quote.

An answer is read once from left to right. Names of recipes are found first and blotted out, so that no figure in them
counts; list markers, numbers and ends of sentences then come out of one pattern. Each sentence is judged when it ends, against the recipes that it names, else against the
last one named before, else against all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillet.plans import stats
from skillet.session import table as T

# Decimal places in which a figure is shown, and how far a quoted measurement may be off.
PLACES = {"total_kcal": 0, "kcal_per_100g": 0, "total_grams": 0, "total_protein_g": 1, "total_fat_g": 1, "total_carb_g": 1, "coverage": 2, "trust": 2}
TOLERANCE = 0.01


@dataclass(frozen=True)
class Fact:
    """A recipe by the names it may be called, and the figures that may be quoted of it."""

    names: tuple[str, ...]
    exact: frozenset[float] = frozenset()
    measured: frozenset[float] = frozenset()


@dataclass
class Verdict:
    checked: int = 0
    unsupported: list[float] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.unsupported

    def complaint(self) -> str:
        """What a writer is told to mend; empty for a passed answer."""
        listed = ", ".join(f"{v:g}" for v in self.unsupported)
        return f"Not in the data of the recipe in question: {listed}. Use only the figures given; don't work out new ones." if listed else ""


def spellings(title: str | None, key: str) -> tuple[str, ...]:
    """The names of a recipe: its title, the title before any bracket, its key. Names of less than three letters are none."""
    title = (title or "").strip()
    return tuple(dict.fromkeys(n for n in (title, title.partition("(")[0].strip(), key) if len(n) >= 3))


def permitted(value: float, exact: frozenset, measured: frozenset) -> bool:
    """A count must be equal; a measurement may be ``TOLERANCE`` off."""
    return value in exact or any(abs(value - m) <= TOLERANCE * max(abs(m), 1.0) for m in measured)


_SIGNS = re.compile(r"(?m:^)[\s>*-]*(?P<marker>\d{1,2})[.)]\s|(?P<number>\d[\d,]*(?:\.\d+)?|\.\d+)|(?P<end>(?<=[.!?;:])\s+|\n+)")


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _blotted(text: str, names: list[str], identifiers: tuple[str, ...]) -> tuple[str, list[tuple[int, str]]]:
    """(text without the figures in names and identifiers, (place, name) of each name): from the left, the longest first, none within another.

    Names count in any case. What consists of digits only hides nothing: the figure could be a claim.
    """
    low, spans = _lower(text), []
    for where, word, is_name in [(low, n, True) for n in names] + [(text, i, False) for i in identifiers if not i.isdigit()]:
        at = where.find(word) if word else -1
        while at >= 0:
            spans.append((at, -len(word), word if is_name else None))
            at = where.find(word, at + 1)
    out, named, end = list(text), [], 0
    for at, size, word in sorted(spans, key=lambda x: x[:2]):
        if at < end:
            continue
        end = at - size
        if word is not None:
            named.append((at, word))
        if word is None or not word.isdigit():
            for k in range(at, end):
                if out[k].isalnum():
                    out[k] = "x"
    return "".join(out), named


def numbers(text: str, identifiers: tuple[str, ...] = ()) -> list[float]:
    """All figures of a text in order, but for those inside identifiers."""
    found = ((m.group("number") or m.group("marker")) for m in _SIGNS.finditer(_blotted(text, [], identifiers)[0]))
    return [float(n.replace(",", "")) for n in found if n]


def check(text: str, facts: list[Fact], exact: frozenset = frozenset(), measured: frozenset = frozenset(), identifiers: tuple[str, ...] = ()) -> Verdict:
    """Whether every figure of an answer belongs to the recipe it is said of. ``exact`` and ``measured`` may be quoted anywhere."""
    owners: dict[str, list[Fact]] = {}
    for f in facts:
        for n in f.names:
            owners.setdefault(_lower(n), []).append(f)
    plain, named = _blotted(text, list(owners), identifiers)
    verdict, claims, last, k = Verdict(), [], [], 0

    def judge(end: int) -> None:
        """The sentence that ends here, with the names that begin in it."""
        nonlocal claims, last, k
        here = []
        while k < len(named) and named[k][0] < end:
            here.append(owners[named[k][1]])
            k += 1
        last = here[-1] if here else last
        scope = [f for own in here for f in own] or last or facts
        ok = (frozenset().union(exact, *(f.exact for f in scope)), frozenset().union(measured, *(f.measured for f in scope)))
        verdict.unsupported = list(dict.fromkeys(verdict.unsupported + [v for v in claims if not permitted(v, *ok)]))
        claims = []

    for m in _SIGNS.finditer(plain):
        if m.lastgroup == "end":
            judge(m.end())
            continue
        verdict.checked += 1
        if m.lastgroup == "number":
            claims.append(float(m.group("number").replace(",", "")))
    judge(len(text) + 1)
    return verdict


def guarded(write, facts: list[Fact], fallback: str, **more) -> tuple[str, Verdict, bool]:
    """(answer, verdict, whether it was written): ``write(complaint)`` is asked twice at most, then the fallback stands in."""
    complaint = ""
    for _ in range(2):
        text = write(complaint)
        verdict = check(text, facts, **more)
        if verdict.passed:
            return text, verdict, True
        complaint = verdict.complaint()
    return fallback, check(fallback, facts, **more), False


def shown(c: str) -> Column:
    """A figure as it is shown; null stays null."""
    return F.bround(F.col(c), PLACES[c])


def facts_of(nutrition: DataFrame, meta: DataFrame) -> DataFrame:
    """(recipe_no, name, shown figures, exact, measured): what may be quoted of each recipe."""
    rows = nutrition.join(meta.select("recipe_no", "title"), "recipe_no", "left")
    rows = rows.select("recipe_no", F.coalesce("title", F.concat(F.lit("Recipe "), F.col("recipe_no").cast("string"))).alias("name"), "n_lines", "n_counted", *[F.bround(F.col(c), p).alias(c) for c, p in PLACES.items() if c in nutrition.columns])
    exact = F.array(F.col("n_lines").cast("double"), F.col("n_counted").cast("double"))
    measured = F.array_compact(F.array(*[F.col(c) for c in PLACES if c in nutrition.columns and c not in ("coverage", "trust")], F.bround(F.col("coverage") * 100, 1)))
    return rows.select("*", exact.alias("exact"), measured.alias("measured"))


def _whole(c: Column) -> Column:
    return F.coalesce(c.cast("bigint").cast("string"), F.lit("unknown"))


def templated(prefix: str = "") -> Column:
    """The plain answer about a recipe of ``facts_of``: right by construction."""
    c = lambda n: F.col(f"{prefix}{n}")
    return F.concat(c("name"), F.lit(" has "), _whole(c("n_lines")), F.lit(" lines, of which "), _whole(c("n_counted")), F.lit(" count. It weighs "), _whole(c("total_grams")), F.lit(" g and has "), _whole(c("total_kcal")), F.lit(" kcal, that is "), _whole(c("kcal_per_100g")), F.lit(" per 100 g."))


def injections() -> dict[str, tuple[list[Column], str]]:
    """Errors that an answer about recipe a may hold: the figures and the sentence they come in."""
    no, kcal = F.col("a.recipe_no"), F.col("a.total_kcal")
    return {
        "none": ([], ""),
        "perturbed": ([F.bround(kcal * 1.3, 0)], "In all it has %s kcal."),
        "cost": ([(no % 20).cast("double") + 3.49], "It costs $%s."),
        "servings": ([(17 + no % 5).cast("double")], "It serves %s."),
        "divided": ([F.bround(kcal / 4, 0)], "Each helping has %s kcal."),
        "round": ([F.lit(55_000.0)], "About %s kcal in a year."),
        "misattributed": ([F.col("b.total_kcal")], "In all it has %s kcal."),
        "whole dollar": ([(12 + no % 7).cast("double")], "It costs $%s."),
        "phrasing": ([(23 + no % 3).cast("double")], "It feeds %s people."),
        "range": ([(301 + no % 9).cast("double"), (399 + no % 9).cast("double")], "Between %s-%s kcal each."),
    }


def answers(facts: DataFrame) -> DataFrame:
    """(recipe_no, kind, text, facts): for each pair of recipes 2k and 2k + 1 an answer about both, as it is and with each error."""
    a, b = facts.where("recipe_no % 2 = 0").alias("a"), facts.where("recipe_no % 2 = 1").alias("b")
    pair = a.join(b, F.col("b.recipe_no") == F.col("a.recipe_no") + 1)
    known = lambda p: F.struct(F.col(f"{p}.name").alias("name"), F.col(f"{p}.exact").alias("exact"), F.col(f"{p}.measured").alias("measured"))
    made = []
    for kind, (values, said) in injections().items():
        figures = [F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("decimal(12,2)").cast("string")) for v in values]
        text = F.concat(templated("a."), F.lit(" "), F.format_string(said, *figures) if values else F.lit(""), F.lit("\n"), templated("b."))
        present = F.lit(True)
        for v in values:
            present &= v.isNotNull()
        made.append(F.when(present, F.struct(F.lit(kind).alias("kind"), text.alias("text"))))
    return pair.select(F.col("a.recipe_no").alias("recipe_no"), F.array(known("a"), known("b")).alias("facts"), F.explode(F.array_compact(F.array(*made))).alias("m")).select("recipe_no", "m.kind", "m.text", "facts")


def checked(rows: DataFrame) -> DataFrame:
    """(recipe_no, kind, checked, unsupported) of ``answers``: answers are independent of one another, so they are read in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, facts in zip(b["text"], b["facts"]):
                known = [Fact(spellings(f["name"], ""), frozenset(map(float, f["exact"])), frozenset(map(float, f["measured"]))) for f in facts]
                v = check(text, known, exact=frozenset({float(len(known))}), identifiers=("per 100 g",))
                out.append((v.checked, [float(x) for x in v.unsupported]))
            yield pd.DataFrame({"recipe_no": b["recipe_no"], "kind": b["kind"], "checked": [o[0] for o in out], "unsupported": [o[1] for o in out]})

    return rows.mapInPandas(run, "recipe_no bigint, kind string, checked int, unsupported array<double>")


def _facts(s: SparkSession, d: str) -> DataFrame:
    from skillet.plans import gold
    from skillet.plans.queries import _nutrition

    return facts_of(_nutrition(s, d), gold.clean_meta(T(s, d, "recipe_meta")))


def recipe_facts(s: SparkSession, d: str) -> DataFrame:
    """The figures of every recipe as they are shown and may be quoted."""
    f = _facts(s, d)
    return f.select("recipe_no", "name", "n_lines", "n_counted", "total_kcal", "kcal_per_100g", "total_grams", "total_protein_g", "coverage", F.size("measured").cast("bigint").alias("n_measured"))


def guardrail_check(s: SparkSession, d: str) -> DataFrame:
    """Every pair's answer, as it is and with each error: figures checked, how many have no support, and their sum."""
    got = checked(answers(_facts(s, d)))
    return got.select("recipe_no", "kind", F.col("checked").cast("bigint").alias("checked"), F.size("unsupported").cast("bigint").alias("n_unsupported"), F.round(F.aggregate("unsupported", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


def guardrail_rates(s: SparkSession, d: str) -> DataFrame:
    """How many answers with each error are caught, with the interval of the rate."""
    by = checked(answers(_facts(s, d))).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.size("unsupported") > 0).alias("n_caught"))
    low, high = stats.wilson(F.col("n_caught"), F.col("n"))
    return by.select("kind", "n", "n_caught", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def guardrail_numbers(s: SparkSession, d: str) -> DataFrame:
    """The figures in each document and each held-out item, thousands read as one number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [numbers(t or "") for t in b["text"]]
            yield pd.DataFrame({"kind": b["kind"], "id": b["id"], "n_numbers": [len(x) for x in found], "total": [round(sum(x), 2) for x in found]})

    texts = T(s, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(T(s, d, "eval_items").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text"))
    return texts.mapInPandas(run, "kind string, id bigint, n_numbers bigint, total double").where("n_numbers > 0")


QUERIES = {f.__name__: f for f in (recipe_facts, guardrail_check, guardrail_rates, guardrail_numbers)}


def sql(nutrition: str, meta: str) -> dict[str, str]:
    """The SQL of this module's queries, on the nutrition and meta of the plans."""
    places = {"total_kcal": 0, "kcal_per_100g": 0, "total_grams": 0, "total_protein_g": 1, "total_fat_g": 1, "total_carb_g": 1, "coverage": 2}
    facts = f"""{nutrition}, {meta}, facts AS (SELECT recipe_no, coalesce(nullif(trim(title), ''), 'Recipe ' || recipe_no) AS name, n_lines, n_counted, {', '.join(f'round_even({c}, {p}) AS {c}' for c, p in places.items())} FROM rolled LEFT JOIN meta USING (recipe_no)),
known AS (SELECT *, list_filter([total_kcal, kcal_per_100g, total_grams, total_protein_g, total_fat_g, total_carb_g, round_even(coverage * 100, 1)], lambda x: x IS NOT NULL) AS measured, [n_lines::DOUBLE, n_counted::DOUBLE] AS exact FROM facts)"""
    stated = "(2 + (total_grams IS NOT NULL)::INT + (total_kcal IS NOT NULL)::INT + (kcal_per_100g IS NOT NULL)::INT)"
    kinds = """('none', []::DOUBLE[]), ('perturbed', [round_even(a.total_kcal * 1.3, 0)]), ('cost', [round((a.recipe_no % 20) + 3.49, 2)]), ('servings', [(17 + a.recipe_no % 5)::DOUBLE]), ('divided', [round_even(a.total_kcal / 4, 0)]), ('round', [55000.0]),
 ('misattributed', [b.total_kcal]), ('whole dollar', [(12 + a.recipe_no % 7)::DOUBLE]), ('phrasing', [(23 + a.recipe_no % 3)::DOUBLE]), ('range', [(301 + a.recipe_no % 9)::DOUBLE, (399 + a.recipe_no % 9)::DOUBLE])"""
    judged = f"""{facts}, pairs AS (
  SELECT a.recipe_no, k.kind, k.figures, CASE WHEN lower(a.name) = lower(b.name) THEN list_concat(a.exact, b.exact) ELSE a.exact END AS exact, CASE WHEN lower(a.name) = lower(b.name) THEN list_concat(a.measured, b.measured) ELSE a.measured END AS measured, a.stated + b.stated AS stated
  FROM (SELECT *, {stated} AS stated FROM known) a JOIN (SELECT *, {stated} AS stated FROM known) b ON a.recipe_no % 2 = 0 AND b.recipe_no = a.recipe_no + 1, LATERAL (VALUES {kinds}) AS k(kind, figures)
), judged AS (
  SELECT recipe_no, kind, stated + len(figures) AS checked, list_distinct(list_filter(figures, lambda v: v <> 2.0 AND NOT list_contains(exact, v) AND len(list_filter(measured, lambda m: abs(v - m) <= 0.01 * greatest(abs(m), 1))) = 0)) AS bad
  FROM pairs WHERE len(list_filter(figures, lambda x: x IS NULL)) = 0
)"""
    return {
        "_judged": judged,
        "recipe_facts": facts + " SELECT recipe_no, name, n_lines, n_counted, total_kcal, kcal_per_100g, total_grams, total_protein_g, coverage, len(measured)::BIGINT AS n_measured FROM known",
        "guardrail_check": judged + " SELECT recipe_no, kind, checked::BIGINT AS checked, len(bad)::BIGINT AS n_unsupported, round(coalesce(list_sum(bad), 0), 2) AS total FROM judged",
        "guardrail_rates": judged + ", c AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE len(bad) > 0) AS n_caught FROM judged GROUP BY 1), p AS (SELECT *, n::DOUBLE AS m, n_caught / n::DOUBLE AS p FROM c) SELECT kind, n, n_caught, round(greatest(((p + 3.8416 / (2 * m)) - 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 0), 6) AS low, round(least(((p + 3.8416 / (2 * m)) + 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 1), 6) AS high FROM p",
        "guardrail_numbers": r"WITH t AS (SELECT 'document' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'item', item_id, coalesce(text, '') FROM eval_items), n AS (SELECT kind, id, unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?|\.\d+')) AS n FROM t) SELECT kind, id, count(*) AS n_numbers, round(sum(replace(n, ',', '')::DOUBLE), 2) AS total FROM n GROUP BY 1, 2",
    }
