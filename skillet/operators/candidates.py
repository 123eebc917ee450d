"""Candidate foods of written names: nearest by word vectors, and those that share the name's head word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillet.functions.features import words


def head_noun_index(foods: DataFrame, key: str, name: str, most: int = 50) -> DataFrame:
    """(token, fdc_id, place): per word of the names the foods that hold it, those of the fewest words first."""
    names = foods.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).alias("fdc_id"), words(F.col(name)).alias("w"))
    tokens = names.select("fdc_id", F.size("w").alias("n"), F.explode("w").alias("token"))
    order = Window.partitionBy("token").orderBy("n", "fdc_id")
    return tokens.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("token", "fdc_id", "place")


def nearest(names: DataFrame, name: str, foods: DataFrame, key: str, entry: str, k: int = 50, limit: int = 200_000) -> DataFrame:
    """(name, fdc_id, cosine): of each distinct name the ``k`` nearest foods by cosine of idf-weighted word vectors, above 0; ties by id.

    The catalogue is a fixed list of at most ``limit`` foods; its vectors go to every task as postings. A batch of names is scored by
    adding, word by word, the postings of the word to the rows of the names that hold it. Words that no food has weigh nothing.
    """
    listed = foods.where(F.col(key).isNotNull()).select(F.col(key).alias("i"), words(F.coalesce(F.col(entry), F.lit(""))).alias("w")).orderBy("i").limit(limit + 1).toPandas()
    if len(listed) > limit:
        raise ValueError(f"more than {limit} foods: split the catalogue and take the best of all parts")
    ids, n = listed["i"].to_numpy(), len(listed)
    vocabulary: dict[str, int] = {}
    owner = np.concatenate([np.full(len(w), r) for r, w in enumerate(listed["w"])]).astype(np.int64) if n else np.zeros(0, np.int64)
    term = np.array([vocabulary.setdefault(x, len(vocabulary)) for w in listed["w"] for x in w], dtype=np.int64)
    df = np.bincount(term, minlength=len(vocabulary))
    idf = np.log(1 + n / np.maximum(df, 1))
    norm = np.sqrt(np.bincount(owner, idf[term] ** 2, minlength=n))
    order = np.argsort(term, kind="stable")
    sent = names.sparkSession.sparkContext.broadcast((ids, vocabulary, idf, norm, owner[order], np.concatenate([[0], np.cumsum(df)])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vocabulary, idf, norm, owner, start = sent.value
        for b in (b.iloc[x : x + 500] for b in batches for x in range(0, len(b), 500)):
            dot, own = np.zeros((len(b), len(ids))), np.zeros(len(b))
            holders: dict[int, list[int]] = {}
            for r, w in enumerate(b["w"]):
                for t in {vocabulary[x] for x in w if x in vocabulary}:
                    holders.setdefault(t, []).append(r)
            for t, rows in holders.items():
                dot[np.ix_(rows, owner[start[t] : start[t + 1]])] += idf[t] ** 2
                own[rows] += idf[t] ** 2
            cosine = np.round(dot / np.maximum(np.sqrt(own)[:, None] * norm[None, :], 1e-12), 9)
            rows, cols = np.nonzero(cosine > 0)
            # Foods stand in order of their ids, so a stable sort settles ties.
            best = np.lexsort((cols, -cosine[rows, cols], rows))
            rows, cols = rows[best], cols[best]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            yield pd.DataFrame({"name": b["name"].to_numpy()[rows[first]], "fdc_id": ids[cols[first]], "cosine": cosine[rows[first], cols[first]]})

    asked = names.select(F.col(name).alias("name")).where("name is not null").distinct().select("name", words(F.col("name")).alias("w"))
    return asked.mapInPandas(run, "name string, fdc_id string, cosine double")


def generate(names: DataFrame, name: str, foods: DataFrame, key: str, entry: str, k: int = 50) -> DataFrame:
    """(name, fdc_id, from_words, from_head, cosine, rank): the union of both ways, ranked by cosine (none last) and id, from 0."""
    near = nearest(names, name, foods, key, entry, k).withColumn("from_words", F.lit(True))
    asked = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    head = asked.select("name", F.try_element_at(F.split(F.trim(F.lower("name")), r"[,\-\s]+"), F.lit(-1)).alias("token"))
    block = head.join(head_noun_index(foods, key, entry, k).select("token", "fdc_id"), "token").select("name", "fdc_id", F.lit(True).alias("from_head"))
    both = near.join(block, ["name", "fdc_id"], "full")
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.col("cosine").desc_nulls_last(), "fdc_id")) - 1
    return both.select("name", "fdc_id", F.coalesce("from_words", F.lit(False)).alias("from_words"), F.coalesce("from_head", F.lit(False)).alias("from_head"), "cosine", place.alias("rank"))
