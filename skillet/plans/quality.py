"""Expectations on tables: each gives the rows that violate it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur more than once, with their number; null keys don't count for one column."""
    rows = df.where(F.col(columns[0]).isNotNull()) if len(columns) == 1 else df
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def relationships(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def accepted_range(df: DataFrame, column: str, low=None, high=None, inclusive: bool = True) -> DataFrame:
    """Nulls pass; a bound left out doesn't hold."""
    c, bad = F.col(column), []
    if low is not None:
        bad.append(c < low if inclusive else c <= low)
    if high is not None:
        bad.append(c > high if inclusive else c >= high)
    return df.where(c.isNotNull() & reduce(lambda a, b: a | b, bad, F.lit(False)))


@dataclass(frozen=True)
class Expectation:
    name: str
    violations: DataFrame


class GateFailure(Exception):
    pass


def gate(expectations: list[Expectation]) -> None:
    """Raise with the names of all expectations that some row violates."""
    if failed := [e.name for e in expectations if not e.violations.isEmpty()]:
        raise GateFailure(", ".join(failed))


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, content hash) without regard to order; equal tables have equal fingerprints."""
    r = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("h")).agg(F.count("*"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def prove(build, expectations, inject, remove, state) -> list[str]:
    """What is wrong with a gate; empty if it holds.

    ``build()`` writes the tables behind the gate, ``expectations()`` gives its tests, ``inject()`` plants a violation in the
    source and ``remove()`` takes it out again; ``state()`` is the fingerprint of what readers see. A clean build must pass, a build with
    the violation must stop and leave readers with what they had, and the next clean one must pass again.
    """
    faults = []

    def run() -> bool:
        try:
            gate(expectations())
        except GateFailure:
            return False
        build()
        return True

    if not run():
        faults.append("a clean source is refused")
    before = state()
    inject()
    try:
        if run():
            faults.append("a violation passes")
        if state() != before:
            faults.append("a refused build changed what readers see")
    finally:
        remove()
    if not run():
        faults.append("the source stays refused after the violation is gone")
    return faults
