"""References to records that are missing, deleted or came later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillet.functions.ids import number_in
from skillet.session import durable


@dataclass(frozen=True)
class Reference:
    """One foreign key: the referring rows, their key and time, and the table the key points to.

    ``first`` and ``deleted`` name the parent's times; where they are None only
    missing records count.
    """

    name: str
    child: DataFrame
    key: Column
    at: str
    parent: DataFrame
    parent_key: Column
    first: str | None = None
    deleted: str | None = None


def _parents(r: Reference) -> DataFrame:
    """One row per key: its first time, and when it was deleted (the last such time that is noted)."""
    none = F.lit(None).cast("timestamp")
    rows = r.parent.select(r.parent_key.alias("ref_id"), (F.col(r.first) if r.first else none).alias("_t"), (F.col(r.deleted) if r.deleted else none).alias("_d"))
    return rows.where("ref_id is not null").groupBy("ref_id").agg(F.min("_t").alias("first_at"), F.max("_d").alias("deleted_at"))


def orphan_rows(r: Reference, broadcast_limit: int = 1_000_000, salts: int = 16) -> DataFrame:
    """(table_name, ref_id, ref_month, kind, n): orphan references with the number of rows that hold them.

    The referring rows are first brought down to one row per distinct key with its first and last time, which shrinks
    a key of any number of rows where it lies. The distinct keys meet the parents in a left anti-join, and what they
    know of the other keys' times tells which of these can hold late or deleted references at all. Only these suspect keys are joined
    back to the rows: broadcast if a count shows no more than ``broadcast_limit`` of them, so that no row is
    shuffled, else over ``salts`` parts per key. A null key, or one without a number,
    is no reference. A null time gives a null month and can be only "missing".
    """
    refs = r.child.select(r.key.alias("ref_id"), F.col(r.at).alias("at")).where("ref_id is not null")
    keys = refs.groupBy("ref_id").agg(F.min("at").alias("_from"), F.max("at").alias("_to"))
    parents = _parents(r)
    none = F.lit(None).cast("timestamp")
    suspects = keys.join(parents, "ref_id", "left_anti").select("ref_id", F.lit(True).alias("missing"), none.alias("first_at"), none.alias("deleted_at"))
    if r.first or r.deleted:
        known = keys.join(parents, "ref_id").where((F.col("first_at") > F.col("_from")) | (F.col("deleted_at") <= F.col("_to")))
        suspects = suspects.unionByName(known.select("ref_id", F.lit(False).alias("missing"), "first_at", "deleted_at"))
    suspects = durable(suspects)
    if suspects.limit(broadcast_limit + 1).count() <= broadcast_limit:
        rows = refs.join(F.broadcast(suspects), "ref_id")
    else:
        spread = suspects.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = refs.withColumn("_salt", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int")).join(spread.hint("merge"), ["ref_id", "_salt"])
    kind = F.when(F.col("missing"), "missing").when(F.col("first_at") > F.col("at"), "late").when(F.col("deleted_at") <= F.col("at"), "deleted")
    rows = rows.select("ref_id", F.date_format("at", "yyyy-MM").alias("ref_month"), kind.alias("kind")).where("kind is not null")
    return rows.groupBy(F.lit(r.name).alias("table_name"), "ref_id", "ref_month", "kind").agg(F.count("*").alias("n"))


def orphans(references: list[Reference]) -> DataFrame:
    """``orphan_rows`` of several foreign keys under one another."""
    out = orphan_rows(references[0])
    for r in references[1:]:
        out = out.unionByName(orphan_rows(r))
    return out


def per_table_and_month(rows: DataFrame) -> DataFrame:
    """(table_name, ref_month, kind, n_refs, n_rows) of ``orphans``."""
    return rows.groupBy("table_name", "ref_month", "kind").agg(F.count("*").alias("n_refs"), F.sum("n").alias("n_rows"))


def project_references(lines: DataFrame, meta: DataFrame, categories: DataFrame, foods: DataFrame) -> list[Reference]:
    return [
        Reference("recipe_ingredient_lines", lines, number_in("recipe_id"), "ingested_at", meta, number_in("recipe_id"), "ingested_at", "deleted_at"),
        Reference("usda_food_categories", categories, number_in("fdc_id"), "ingested_at", foods, number_in("fdc_id")),
    ]
