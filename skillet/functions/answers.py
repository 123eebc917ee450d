"""Answers of annotators as column expressions and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillet.functions.ids import number_in


def plain_label(label: Column | str) -> Column:
    """An answer in one way of writing: ``none``, the number of an id as text, or the text itself; null for a blank one."""
    text = F.lower(F.trim(label))
    return F.when(text == "none", "none").when(text == "", F.lit(None)).otherwise(F.coalesce(number_in(label).cast("string"), text))


def last_answers(rows: DataFrame, item: str, annotator: str, label: str, at: str) -> DataFrame:
    """(item, annotator, label): the last answer of each annotator to each item; blank ones are no answers.

    Ids are plain numbers as text, whatever zeros and blanks stand around
    them; ``none`` keeps its name in any case. Annotators are compared without
    case and blanks. A null time counts as the earliest; of answers at one time the greatest as text counts. Rows with
    a null item or annotator are left out.
    """
    clean = rows.select(F.col(item).alias("item"), F.lower(F.trim(annotator)).alias("annotator"), plain_label(label).alias("label"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62))).alias("at")).where("item is not null and annotator is not null")
    last = clean.groupBy("item", "annotator").agg(F.max(F.struct("at", F.coalesce("label", F.lit("")).alias("label"))).alias("last"))
    return last.select("item", "annotator", F.col("last.label").alias("label")).where("label <> ''")


def majority(answers: DataFrame) -> DataFrame:
    """(item, label, votes): the answer of most annotators; null on a tie."""
    n = answers.groupBy("item", "label").agg(F.count("*").alias("n"))
    most = n.groupBy("item").agg(F.max("n").alias("votes"))
    top = n.join(most, "item").where(F.col("n") == F.col("votes"))
    return top.groupBy("item", "votes").agg(F.when(F.count("*") == 1, F.max("label")).alias("label")).select("item", "label", "votes")
