"""Passages of held-out items inside a corpus, found by spaced seeds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillet.llm.mapping import plain
from skillet.session import durable

SPAN = 10

#: Which words of a window count for a seed. Any window whose first word is equal and in which no two words in a row
#: differ meets at least one of these, and fewer masks of five words don't suffice.
MASKS = ("1010101010", "1010100101", "1010010110", "1001010101", "1001011010", "1101010100", "1101101000")


def cleaned(c: Column) -> Column:
    """A text in lower case without accents, markup and invisible characters."""
    c = F.coalesce(c, F.lit(""))
    marked = F.regexp_replace(F.regexp_replace(c, r"(?i)</?(?:a|b|i|u|em|strong|span|mark|small|sub|sup|font|code)(?:\s[^<>]*)?>", ""), r"</?[A-Za-z!][^<>]*>|&(?:[a-zA-Z]+|#\d+);", " ")
    c = plain(F.when(c.contains("<") | c.contains("&"), marked).otherwise(c))
    return F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))


def words_of(c: Column) -> Column:
    """The words of a cleaned text, in order: runs of letters and digits."""
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")


class _Hashes(dict):
    """Word -> hash."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[w] = v = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        return v


def seeds_of(words: np.ndarray) -> np.ndarray:
    """Per mask and window of ``SPAN`` words the hash of the words that the mask lets through."""
    n = max(0, len(words) - SPAN + 1)
    out = np.empty((len(MASKS), n), np.uint64)
    salted = words.astype(np.uint64) + np.uint64(1)
    for k, mask in enumerate(MASKS):
        h = np.full(n, 2 * k + 1, np.uint64)
        for at in [i for i, c in enumerate(mask) if c == "1"]:
            h = (h ^ salted[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[k] = h
    return out


def _windows(texts: DataFrame, key: str, known=None) -> DataFrame:
    """(key, pos, seed) of (key, t): the seeds of every window of every text.

    With ``known``, a broadcast of (seeds in order, item and pos of each), the rows are (key, item, shift) of the seeds that are among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, find = _Hashes(), re.compile(r"[^\W_]+").findall
        if known is not None:
            seeds, items, at = known.value
            some = np.zeros(1 << 22, bool)
            some[seeds >> np.uint64(42)] = True
        for b in (b.slice(k, 2_000) for b in batches for k in range(0, b.num_rows, 2_000)):
            flat, ends = [], []
            for t in b.column("t").to_pylist():
                flat += find(t)
                ends.append(len(flat))
            ends = np.array(ends, dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            own = seeds_of(np.fromiter(map(hashes.__getitem__, flat), np.int64, len(flat)))
            doc = np.repeat(np.arange(b.num_rows), ends - starts)[: own.shape[1]]
            inside = np.arange(own.shape[1]) + SPAN <= ends[doc]
            if known is None:
                where = np.flatnonzero(inside)
                key_at, pos, seed = np.tile(doc[where], len(MASKS)), np.tile((where - starts[doc[where]]), len(MASKS)), own[:, where].ravel()
                yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()).take(pa.array(key_at)), pa.array(pos.astype(np.int32)), pa.array(seed.view(np.int64))], names=[key, "pos", "seed"])
                continue
            hit_doc, hit_item, hit_shift = [], [], []
            for row in own:
                where = np.flatnonzero(inside & some[row >> np.uint64(42)])
                low, high = np.searchsorted(seeds, row[where]), np.searchsorted(seeds, row[where], side="right")
                n = high - low
                which = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n) + np.arange(n.sum())
                where = np.repeat(where, n)
                hit_doc.append(doc[where])
                hit_item.append(items[which])
                hit_shift.append(where - starts[doc[where]] - at[which])
            hit = np.unique(np.stack([np.concatenate(x) for x in (hit_doc, hit_item, hit_shift)]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()).take(pa.array(hit[0])), pa.array(hit[1]), pa.array(hit[2].astype(np.int32))], names=[key, "item_id", "shift"])

    schema = f"{key} bigint, pos int, seed bigint" if known is None else f"{key} bigint, item_id bigint, shift int"
    return texts.mapInArrow(run, schema)


def _texts(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(key, cleaned(F.col("text")).alias("t"))


def overlaps(documents: DataFrame, items: DataFrame, broadcast_limit: int = 3_000_000, salts: int = 16) -> DataFrame:
    """(doc_id, item_id, longest, tolerant, same): documents that share a passage with an item.

    ``longest`` is the longest run of equal words, ``tolerant`` the longest run
    in which no two words in a row differ, ``same`` the number of equal words
    along that alignment; of several alignments with ``tolerant`` of at least ten
    words the one with the longest equal run counts. Pairs without any don't
    come out; all others do, as such a run begins with an equal word and each
    way in which the next nine can differ meets a mask. Unseen remain passages
    that keep fewer words, so that two in a row differ at least every ten words,
    and those cut up so by words put in or left out.

    Every window of ten words is hashed under each mask. The items' seeds meet
    those of the documents in an equi-join: where the documents lie, if a count shows no more than
    ``broadcast_limit`` seeds of items, so that only hits leave a task. More items are met by a shuffle in which a seed is spread over
    ``salts`` parts by the hash of the document, so that a passage which stands in a third of the documents isn't
    gathered in one task. The hits, not the corpus, are then kept; the documents that have any are found by a
    semi-join on their ids, and only these are cut into words again and verified, along each hit's alignment. Null ids are left
    out; null, empty and shorter texts share nothing; an item with repeated rows counts once.
    """
    held = durable(_texts(items, "item_id").distinct())
    own = _windows(held, "item_id").select("item_id", F.col("pos").alias("ipos"), "seed").distinct()
    few = own.limit(broadcast_limit + 1).toArrow()
    fits = few.num_rows <= broadcast_limit
    docs = _texts(documents, "doc_id")
    if fits:
        seeds = few.column("seed").to_numpy().view(np.uint64)
        order = np.argsort(seeds)
        known = items.sparkSession.sparkContext.broadcast((seeds[order], few.column("item_id").to_numpy().astype(np.int64)[order], few.column("ipos").to_numpy().astype(np.int64)[order]))
        hits = _windows(docs, "doc_id", known)
    else:
        spread = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = _windows(docs, "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(spread.hint("merge"), ["seed", "salt"])
        hits = met.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    hits = durable(hits)
    ids = hits.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.limit(broadcast_limit + 1).count() <= broadcast_limit else ids.hint("merge")
    found = docs.join(ids, "doc_id", "left_semi").select("doc_id", F.explode(F.array(words_of(F.col("t")))).alias("words"))
    held = held.select("item_id", F.explode(F.array(words_of(F.col("t")))).alias("iw"))
    hits = found.join(hits.hint("merge"), "doc_id").join(F.broadcast(held) if fits else held.hint("merge"), "item_id")
    part = F.slice("words", F.greatest(F.lit(1), F.col("shift") + 1), F.size("iw") + F.least(F.lit(0), F.col("shift")))
    aligned = hits.select("doc_id", "item_id", "iw", F.explode(F.array(F.concat(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), -F.col("shift"))), lambda i: F.lit("")), part))).alias("dw"))
    # The first of the sequence stands for no word: sequence(0, k) has k + 1 members.
    equal = F.transform("iw", lambda w, i: F.coalesce(F.try_element_at("dw", i + 2) == w, F.lit(False)))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("loose"), F.lit(0).alias("loosest"), F.lit(True).alias("miss"), F.lit(0).alias("same"))

    def step(a: Column, e: Column) -> Column:
        run = F.when(e, a["run"] + 1).otherwise(0)
        loose = F.when(e | ~a["miss"], a["loose"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"), loose.alias("loose"), F.greatest(a["loosest"], loose).alias("loosest"), (~e).alias("miss"), (a["same"] + e.cast("int")).alias("same"))

    got = aligned.select("doc_id", "item_id", F.aggregate(equal, start, step).alias("r")).select("doc_id", "item_id", F.col("r.best").alias("longest"), F.col("r.loosest").alias("tolerant"), F.col("r.same").alias("same"))
    got = got.where(F.col("tolerant") >= SPAN).groupBy("doc_id", "item_id")
    return got.agg(F.max(F.struct("longest", "tolerant", "same")).alias("m")).select("doc_id", "item_id", "m.*")


def leaked(documents: DataFrame, items: DataFrame, least: int = SPAN) -> DataFrame:
    """(doc_id, item_id): documents that hold at least ``least`` (ten or more) consecutive words of an item."""
    if least < SPAN:
        raise ValueError(f"windows have {SPAN} words; fewer can't be found")
    return overlaps(documents, items).where(F.col("longest") >= least).select("doc_id", "item_id")
