"""Documents packed into containers of a fixed number of tokens."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillet.session import durable

#: Fixed value: the pattern by which the public byte-level vocabularies cut a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counter(path: str, pattern: str = PATTERN) -> Callable[[list[str]], list[int]]:
    """Token counts of texts under the vocabulary file at ``path``: .tiktoken ranks, a tokenizers .json or a sentencepiece .model."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens) over whole texts; a null text has 0 tokens. Null ids are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": np.asarray(count(b["text"].fillna("").tolist()), dtype=np.int64)})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_tokens bigint")


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin) by sum-of-squares packing, in the order given; sizes are 0 to capacity.

    ``open_at[h]`` counts the containers filled to level h. An item goes to the
    level for which the sum of the squared counts of the levels between empty
    and full grows least; of equal ones to the fullest. Items of size 0 go where the last item went.
    """
    open_at = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, fills = np.empty(len(sizes), dtype=np.int64), []
    last = -1
    for k, s in enumerate(sizes):
        s = int(s)
        if s == 0:
            if last < 0:
                fills.append(0)
                last = 0
                stacks[0].append(0)
            where[k] = last
            continue
        if stacks[0]:
            # A container that holds nothing yet takes the next item.
            b = stacks[0].pop()
            h = 0
        else:
            top = capacity - s
            # From level h to h + s: 2 N(h+s) + 1 for the level gained (none if full), 1 - 2 N(h) for the level left.
            gain = 2 * open_at[s : capacity + 1] + 1
            gain[top] = 0
            cost = gain + 1 - 2 * open_at[: top + 1]
            cost[0] = gain[0]
            cost[1:][open_at[1 : top + 1] == 0] = np.iinfo(np.int64).max
            h = top - int(np.argmin(cost[::-1]))
            if h == 0:
                b = len(fills)
                fills.append(0)
            else:
                b = stacks[h].pop()
                open_at[h] -= 1
        fills[b] = h + s
        if h + s < capacity:
            open_at[h + s] += 1
            stacks[h + s].append(b)
        where[k] = b
        last = b
    return where, np.asarray(fills, dtype=np.int64)


def _merge(capacity: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one shard of partly filled containers, the fullest first."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        where, fills = place(pdf["fill"].to_numpy(), capacity)
        return pd.DataFrame({"bin": pdf["bin"], "into": where + (int(pdf["shard"].iloc[0]) << 32) + (level << 58), "filled": fills[where]})

    return merge


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, per_shard: int = 50_000) -> DataFrame:
    """(doc_id, piece, start, n_tokens, container): where each document lies.

    A document of more than ``capacity`` tokens gives full containers of its
    own and one rest; no other is split. Documents are spread by the hash of
    their id over shards of about ``per_shard`` items, each packed by itself in
    one pass. The containers that are left partly filled are the items of a
    next, smaller level, until one shard holds them all, so spreading costs no
    room. Empty documents lie in some container with 0 tokens.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counted = durable(token_counts(documents, tokenizer))
    c = F.lit(capacity)
    full = F.floor(F.col("n_tokens") / c)
    pieces = counted.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.when(F.col("n_tokens") % c == 0, F.greatest(full - 1, F.lit(0))).otherwise(full)), lambda i: F.least(c, F.col("n_tokens") - i * c))).alias("piece", "n_tokens"))
    items = pieces.where(F.col("n_tokens") < c).select(F.xxhash64("doc_id", "piece").alias("h"), "doc_id", "piece", "n_tokens")
    n = items.count()
    shards = max(1, -(-n // per_shard))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "piece"], ignore_index=True)
        where, fills = place(pdf["n_tokens"].to_numpy(), capacity)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"], "bin": where + (int(pdf["shard"].iloc[0]) << 32), "fill": fills[where]})

    sharded = items.withColumn("shard", F.pmod("h", F.lit(shards)))
    packed = durable(sharded.groupBy("shard").applyInPandas(first, "doc_id bigint, piece int, n_tokens bigint, bin bigint, fill bigint"))
    final = packed.select("doc_id", "piece", "n_tokens", "bin")
    level, bins = 1, packed.where(F.col("fill") < c).select("bin", "fill").distinct()
    while shards > 1:
        # Some shards of a level hold most of its room; a tenth of the shards, each of mixed origin, closes it.
        shards = max(1, shards // 10)

        moved = durable(bins.withColumn("shard", F.pmod(F.xxhash64("bin"), F.lit(shards))).groupBy("shard").applyInPandas(_merge(capacity, level), "bin bigint, into bigint, filled bigint"))
        final = final.join(moved.select("bin", "into"), "bin", "left").select("doc_id", "piece", "n_tokens", F.coalesce("into", "bin").alias("bin"))
        bins = moved.where(F.col("filled") < c).select(F.col("into").alias("bin"), F.col("filled").alias("fill")).distinct()
        level += 1
    final = final.withColumn("bin", F.concat(F.lit("b"), F.col("bin")))
    whole = pieces.where(F.col("n_tokens") == c).select("doc_id", "piece", "n_tokens", F.concat(F.lit("d"), F.col("doc_id"), F.lit("-"), F.col("piece")).alias("bin"))
    return final.unionByName(whole).select("doc_id", "piece", (F.col("piece").cast("bigint") * c).alias("start"), "n_tokens", F.col("bin").alias("container"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row (n_documents, n_containers, n_tokens, unused_share)."""
    by = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    docs = packed.agg(F.countDistinct("doc_id").alias("n_documents"))
    return docs.crossJoin(by.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), (1 - F.try_divide(F.sum("t"), F.count("*") * F.lit(capacity))).alias("unused_share")))
