"""What is shown to people and writers: escaped texts, the order of candidates, findings of the gate, the running rate of the guardrail."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillet.functions import features
from skillet.functions.ids import number_in
from skillet.plans import guardrail, scoring
from skillet.session import table as T

# What a candidate's place is raised or lowered by.
LEADS, HOLDS_IN_FIRST, HOLDS_HEAD, HOLDS_ALL, ORDINARY, HAS_ENERGY, LOW = 0.30, 0.18, 0.08, 0.10, 0.28, 0.03, -0.15


def safe(text: Column) -> Column:
    """A text that can't close or open a tag it is put into; quotes stay as they are."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def display_score(name: Column, cosine: Column, description: Column, low: Column, has_energy: Column) -> Column:
    """The score by which candidates are shown: the cosine, raised for foods that lead with the name's head word in their ordinary form.

    It decides the order on a screen only. What isn't related to the name by any word gets no bonus.
    """
    said = F.split(F.trim(name), r"\s+")
    head = F.element_at(said, -1)
    first = F.lower(F.trim(F.substring_index(description, ",", 1)))
    held = features.words(description)
    leads = first.isin(head, F.concat(head, F.lit("s"))) & (F.trim(name) != "")
    related = leads | F.array_contains(held, head)
    ordinary = F.contains(description, F.lit(",")) & (features.plain_share(description) == 1.0) & (F.trim(F.regexp_replace(description, "^[^,]*,", "")) != "")
    points = [
        (leads, LEADS), (~leads & F.array_contains(F.split(first, r"\s+"), head), HOLDS_IN_FIRST), (F.array_contains(held, head), HOLDS_HEAD), ((F.trim(name) != "") & (F.size(F.array_except(said, held)) == 0), HOLDS_ALL),
        (related & ordinary, ORDINARY), (related & has_energy, HAS_ENERGY), (low, LOW),
    ]
    out = cosine
    for when, by in points:
        out = out + F.when(when, by).otherwise(0.0)
    return out


@dataclass(frozen=True)
class Finding:
    """Something that a check found: what it is about, how grave it is, and the figures that may be said of it."""

    trigger: str
    subject: str
    severity: str
    facts: dict[str, float] = field(default_factory=dict)

    def plain(self) -> str:
        """The finding in a sentence that needs no check."""
        stated = ", ".join(f"{k} {v:g}" for k, v in self.facts.items())
        return f"{self.trigger} on {self.subject} ({self.severity}): {stated}."

    def checked(self, text: str) -> guardrail.Verdict:
        """A written account of the finding held to its figures."""
        return guardrail.check(text, [], exact=frozenset(map(float, self.facts.values())), identifiers=(self.subject, self.trigger))


def findings_of(rows: DataFrame, most: int = 1_000) -> list[Finding]:
    """The gravest ``most`` findings of (trigger, subject, severity, n), the largest first; a report, so it is read on the driver."""
    got = rows.orderBy(F.col("n").desc(), "trigger", "subject").limit(most).collect()
    return [Finding(r.trigger, r.subject, r.severity, {"rows": float(r.n)}) for r in got]


def _candidates(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "ingredient_candidates").where("normalized_text is not null and not isnan(cosine_search) and cosine_search is not null")
    return c.groupBy("normalized_text", number_in("fdc_id").alias("fdc_no")).agg(F.max("cosine_search").alias("cosine"))


def display_scores(s: SparkSession, d: str) -> DataFrame:
    """Every candidate with the score by which it is shown."""
    f = T(s, d, "usda_foods").select(number_in("fdc_id").alias("fdc_no"), "description_raw", F.coalesce("is_deprioritized", F.lit(False)).alias("low"), F.col("kcal_per_100g").isNotNull().alias("has"))
    rows = _candidates(s, d).join(f, "fdc_no")
    return rows.select("normalized_text", "fdc_no", F.round(display_score(F.col("normalized_text"), F.col("cosine"), F.col("description_raw"), F.col("low"), F.col("has")), 6).alias("score"))


def safe_texts(s: SparkSession, d: str) -> DataFrame:
    """Titles and texts of the documents in the form in which they may be put between tags, with their lengths."""
    return T(s, d, "documents").select("doc_id", safe(F.col("title")).alias("title"), F.length(safe(F.col("text"))).alias("n_safe"))


def gate_findings(s: SparkSession, d: str) -> DataFrame:
    """The tests of the suite that some row violates, as findings: an error for missing and doubled keys, else a warning."""
    parts = F.split("test", " ")
    rows = scoring.dq_suite(s, d).where("n_violations > 0").select(parts[0].alias("trigger"), parts[1].alias("subject"), F.col("n_violations").alias("n"))
    return rows.select("trigger", "subject", F.when(F.col("trigger").isin("not_null", "unique"), "error").otherwise("warn").alias("severity"), "n")


def guardrail_summary(s: SparkSession, d: str) -> DataFrame:
    """One row over all checked answers: how many, how many passed, the figures checked and their median per answer."""
    c = guardrail.checked(guardrail.answers(guardrail._facts(s, d)))
    return c.agg(F.count("*").alias("n_answers"), F.count_if(F.size("unsupported") == 0).alias("n_passed"), F.sum(F.col("checked").cast("bigint")).alias("n_figures"), F.median("checked").alias("median_figures"))


QUERIES = {f.__name__: f for f in (display_scores, safe_texts, gate_findings, guardrail_summary)}


def sql(judged: str) -> dict[str, str]:
    """The SQL of this module's queries; ``judged`` ends in the guardrail's table of judged answers."""
    number = "try_cast(nullif(regexp_replace(fdc_id, '[^0-9]', '', 'g'), '') AS BIGINT)"
    plain = "[" + ", ".join(f"'{w}'" for w in features.PLAIN_MODIFIERS) + "]"
    escaped = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return {
        "display_scores": rf"""
WITH c AS (SELECT normalized_text, {number} AS fdc_no, max(cosine_search) AS cosine FROM ingredient_candidates WHERE normalized_text IS NOT NULL AND cosine_search IS NOT NULL AND NOT isnan(cosine_search) GROUP BY 1, 2),
f AS (SELECT {number} AS fdc_no, description_raw, coalesce(is_deprioritized, false) AS low, kcal_per_100g IS NOT NULL AS has FROM usda_foods),
x AS (SELECT *, regexp_split_to_array(trim(normalized_text), '\s+') AS said, lower(trim(split_part(description_raw, ',', 1))) AS facet, list_filter(regexp_split_to_array(lower(description_raw), '[-,\s]+'), lambda w: w <> '') AS held,
  CASE WHEN contains(description_raw, ',') THEN list_filter(regexp_split_to_array(regexp_replace(lower(description_raw), '^[^,]*,', ''), '[-,\s]+'), lambda w: w <> '') ELSE [] END AS tail FROM c JOIN f USING (fdc_no)),
y AS (SELECT *, said[-1] AS head, facet IN (said[-1], said[-1] || 's') AND trim(normalized_text) <> '' AS leads, len(tail) > 0 AND len(list_filter(tail, lambda w: NOT (list_contains({plain}, w) OR regexp_matches(w, '^[0-9]+$')))) = 0 AS ordinary FROM x)
SELECT normalized_text, fdc_no, round(cosine + CASE WHEN leads THEN {LEADS} ELSE 0 END + CASE WHEN NOT leads AND list_contains(regexp_split_to_array(facet, '\s+'), head) THEN {HOLDS_IN_FIRST} ELSE 0 END + CASE WHEN list_contains(held, head) THEN {HOLDS_HEAD} ELSE 0 END
  + CASE WHEN trim(normalized_text) <> '' AND len(list_filter(said, lambda w: NOT list_contains(held, w))) = 0 THEN {HOLDS_ALL} ELSE 0 END + CASE WHEN (leads OR list_contains(held, head)) AND ordinary THEN {ORDINARY} ELSE 0 END
  + CASE WHEN (leads OR list_contains(held, head)) AND has THEN {HAS_ENERGY} ELSE 0 END + CASE WHEN low THEN {LOW} ELSE 0 END, 6) AS score FROM y""",
        "safe_texts": f"SELECT doc_id, {escaped.format('title')} AS title, CAST(length({escaped.format('text')}) AS INTEGER) AS n_safe FROM documents",
        "gate_findings": f"SELECT split_part(test, ' ', 1) AS trigger, split_part(test, ' ', 2) AS subject, CASE WHEN split_part(test, ' ', 1) IN ('not_null', 'unique') THEN 'error' ELSE 'warn' END AS severity, n_violations AS n FROM ({scoring.SQL['dq_suite']}) WHERE n_violations > 0",
        "guardrail_summary": judged + " SELECT count(*) AS n_answers, count(*) FILTER (WHERE len(bad) = 0) AS n_passed, sum(checked)::BIGINT AS n_figures, median(checked)::DOUBLE AS median_figures FROM judged",
    }
