"""All queries of the core by name."""

from __future__ import annotations

from skillet.operators import queries as data
from skillet.plans import answers, evaluation, guardrail, lines, scoring
from skillet.plans import queries as plans

MODULES = (data, plans, lines, evaluation, guardrail, scoring, answers)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    held = guardrail.sql(plans._NUTRITION, plans._META)
    judged = held.pop("_judged")
    return {**data.SQL, **plans.SQL, **lines.SQL, **evaluation.SQL, **held, **scoring.SQL, **answers.sql(judged)}
