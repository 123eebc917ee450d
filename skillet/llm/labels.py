"""Consensus of several annotators who disagree: who is right, who is reliable, how hard each item is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillet.functions.answers import last_answers  # noqa: F401
from skillet.plans.stats import krippendorff  # noqa: F401
from skillet.session import durable


def _flat(pdf: pd.DataFrame):
    """Votes of a batch of items as arrays: item, annotator, and the number of the (item, label) pair they stand for."""
    sizes = pdf["who"].map(len).to_numpy()
    item = np.repeat(np.arange(len(pdf)), sizes)
    who = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["who"]]) if len(pdf) else np.zeros(0, np.int64)
    what = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["what"]]) if len(pdf) else np.zeros(0, np.int64)
    span = int(what.max()) + 1 if len(what) else 1
    pairs, vote = np.unique(item * span + what, return_inverse=True)
    return item, who, vote, pairs // span, pairs % span


def expect(item, who, vote, pair_item, n_items: int, ability, groups, wrong: float, inner: int, prior: float):
    """Posterior of every (item, label) pair, and ease of every item, for given abilities.

    A vote is right with probability s(ability * ease); a wrong one falls on
    one of ``wrong`` other labels. Ease starts at 1 and takes ``inner`` gradient
    steps on the expected log-likelihood, with a normal prior on its logarithm.
    Votes of one ``groups`` number for the same label of an item share one vote.
    """
    log_ease = np.zeros(n_items)
    a = ability[who]
    key = vote.astype(np.int64) * (int(groups.max()) + 1 if len(groups) else 1) + groups[who]
    _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
    w = 1.0 / cnt[inv]
    for step in range(inner + 1):
        p = np.clip(1.0 / (1.0 + np.exp(-a * np.exp(log_ease)[item])), 1e-6, 1 - 1e-6)
        score = np.bincount(vote, w * (np.log(p) - np.log((1 - p) / wrong)), minlength=len(pair_item))
        top = np.zeros(n_items)
        np.maximum.at(top, pair_item, score)
        mass = np.exp(score - top[pair_item])
        # Labels that nobody gave hold the score 0.
        total = np.bincount(pair_item, mass, minlength=n_items) + np.exp(-top)
        post = mass / total[pair_item]
        if step < inner:
            gap = w * (post[vote] - p) * a * np.exp(log_ease)[item]
            log_ease = np.clip(log_ease + 0.3 * (np.bincount(item, gap, minlength=n_items) - prior * log_ease), -2.0, 2.0)
    return post, np.exp(log_ease), p, w


def _together(item: np.ndarray, who: np.ndarray, vote: np.ndarray, chunk: int = 2_000_000) -> list[tuple]:
    """(i, j, both, same) of the annotators that voted on the same items, ``item`` in order: in how many, and in how many alike."""
    first = np.flatnonzero(np.diff(item, prepend=-1))
    size = np.diff(np.append(first, len(item)))
    out = []
    for k in np.unique(size[size > 1]):
        a, b = np.triu_indices(k, 1)
        at = first[size == k]
        for part in np.array_split(at, max(1, len(at) * len(a) // chunk)):
            x, y = (part[:, None] + a).ravel(), (part[:, None] + b).ravel()
            out.append((np.minimum(who[x], who[y]), np.maximum(who[x], who[y]), np.ones(len(x)), (vote[x] == vote[y]).astype(float)))
            if len(out) > 8:
                out = [_summed([out])]
    return out


def _summed(parts: list[list[tuple]]) -> tuple:
    """The rows of ``_together`` added up per pair."""
    rows = [r for p in parts for r in p]
    if not rows:
        return tuple(np.zeros(0) for _ in range(4))
    i, j, both, same = (np.concatenate(c) for c in zip(*rows))
    span = int(j.max()) + 1 if len(j) else 1
    key, inverse = np.unique(i.astype(np.int64) * span + j.astype(np.int64), return_inverse=True)
    return key // span, key % span, np.bincount(inverse, both, minlength=len(key)), np.bincount(inverse, same, minlength=len(key))


def consensus(answers: DataFrame, rounds: int = 12, least: int = 3, wrong: float = 8.0, inner: int = 4, prior: float = 1.0, copied: float = 0.95, shared: int = 10, broadcast_limit: int = 100_000):
    """(items, annotators) of (item, annotator, label) answers, one per item and annotator.

    items: item, label, posterior, difficulty, n_answers, n_labels - for items
    with at least ``least`` answers; equal posteriors give the smaller label as
    text. annotators: annotator, ability, reliability (the mean posterior of
    their answers), n_answers, n_twins (others that give the same wrong answers). Items with fewer
    answers take part in the model; they only aren't returned.

    Ability and difficulty are learned jointly by gradient
    expectation-maximisation: each round works out the labels' posteriors and
    the items' ease where the items lie, and sends only sums per annotator to
    the driver, which takes one Newton step per ability. The driver holds a few numbers per annotator - people,
    not rows; items may be any number. Annotators whose wrong
    answers to common items agree in more than ``copied`` of at least ``shared`` cases
    count as one where they agree, so that a copied answer isn't counted twice; only such pairs reach the driver.
    The number of rounds is fixed, so the result doesn't hang on a threshold.
    """
    spark = answers.sparkSession
    names = [r[0] for r in answers.select("annotator").distinct().orderBy("annotator").collect()]
    number = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "annotator string, who int")
    votes = answers.join(F.broadcast(number) if len(names) <= broadcast_limit else number.hint("merge"), "annotator")
    place = F.dense_rank().over(Window.partitionBy("item").orderBy("label")) - 1
    packed = votes.withColumn("what", place.cast("int")).groupBy("item").agg(F.collect_list(F.struct("who", "what", "label")).alias("v"))
    packed = packed.select("item", F.col("v.who").alias("who"), F.col("v.what").alias("what"), F.col("v.label").alias("label"))
    packed = durable(packed)
    m = len(names)
    ability, groups = np.ones(m), np.arange(m)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grad, hess, post_sum, n, pairs = np.zeros(m), np.zeros(m), np.zeros(m), np.zeros(m), []
        for pdf in batches:
            if not len(pdf):
                continue
            item, who, vote, pair_item, _ = _flat(pdf)
            post, ease, p, w = expect(item, who, vote, pair_item, len(pdf), ability, groups, wrong, inner, prior)
            b = ease[item]
            grad += np.bincount(who, w * (post[vote] - p) * b, minlength=m)
            hess += np.bincount(who, w * p * (1 - p) * b * b, minlength=m)
            post_sum += np.bincount(who, post[vote], minlength=m)
            n += np.bincount(who, minlength=m)
            if twins:
                bad = np.flatnonzero(post[vote] < 0.2)
                pairs.append(_together(item[bad], who[bad], vote[bad]))
        k = np.flatnonzero(n)
        yield pd.DataFrame({"kind": "a", "i": k.astype(np.int32), "j": np.int32(-1), "x": grad[k], "y": hess[k], "z": post_sum[k], "n": n[k]})
        if pairs:
            i, j, both, same = _summed(pairs)
            yield pd.DataFrame({"kind": "p", "i": i.astype(np.int32), "j": j.astype(np.int32), "x": same, "y": both, "z": 0.0, "n": 0.0})

    def gathered():
        out = packed.mapInPandas(sums, "kind string, i int, j int, x double, y double, z double, n double")
        out = out.groupBy("kind", "i", "j").agg(*[F.sum(c).alias(c) for c in "xyzn"])
        return out.where((F.col("kind") == "a") | (F.col("y") >= shared) & (F.col("x") > copied * F.col("y"))).orderBy("kind", "i", "j").collect()

    for k in range(rounds):
        twins = k == rounds // 2 - 1
        for r in gathered() if m else []:
            if r.kind == "a":
                ability[r.i] += np.clip((r.x - prior * (ability[r.i] - 1.0)) / (r.y + prior), -1.5, 1.5)
            else:
                a, b = groups[r.i], groups[r.j]
                groups[groups == max(a, b)] = min(a, b)
    twins = False

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            item, who, vote, pair_item, pair_what = _flat(pdf)
            post, ease, _, _ = expect(item, who, vote, pair_item, len(pdf), ability, groups, wrong, inner, prior)
            order = np.lexsort((pair_what, -np.round(post, 12), pair_item))
            first = order[np.concatenate([[True], np.diff(pair_item[order]) > 0])]
            labels = [l[list(w).index(k)] for l, w, k in zip(pdf["label"], pdf["what"], pair_what[first])]
            sizes = pdf["who"].map(len).to_numpy()
            out = pd.DataFrame({"item": pdf["item"].to_numpy(), "label": labels, "posterior": post[first], "difficulty": 1.0 / ease, "n_answers": sizes.astype("int64"), "n_labels": np.bincount(pair_item, minlength=len(pdf)).astype("int64")})
            yield out[sizes >= least]

    items = packed.mapInPandas(settle, "item string, label string, posterior double, difficulty double, n_answers bigint, n_labels bigint")
    final = {r.i: r for r in (gathered() if m else []) if r.kind == "a"}
    people = [(n, float(ability[k]), float(final[k].z / final[k].n) if k in final and final[k].n else None, int(final[k].n) if k in final else 0, int((groups == groups[k]).sum() - 1)) for k, n in enumerate(names)]
    return items, spark.createDataFrame(people, "annotator string, ability double, reliability double, n_answers bigint, n_twins bigint")
