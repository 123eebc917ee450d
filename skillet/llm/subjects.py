"""Subjects of documents by seeded non-negative factoring of the document-term matrix."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillet.llm.mapping import plain
from skillet.session import durable

#: Words, and what ends a sentence: a closing mark before a blank, or a line break.
TOKEN = r"\w+|[.!?](?=\s)|\n"
#: Words in a row that make a passage of a held-out item.
SHINGLE = 6
#: Terms whose sums travel together, and documents whose terms lie in memory side by side.
BLOCK, CHUNK = 1_024, 2_000

_SUMS = pa.schema([("k", pa.int32()), ("block", pa.int32()), ("num", pa.list_(pa.float64()))])
_CODED = pa.schema([("doc_id", pa.int64()), ("lang", pa.int32()), ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])


class Codes(dict):
    """Token -> twice its 32-bit hash, and one more if it is a term (a word of three letters or more); -1 for ends of sentences."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        v = -1 if w in ".!?\n" else zlib.crc32(w.encode("utf-8", "surrogatepass")) * 2 + (len(w) >= 3 and w.isalpha())
        self[w] = v
        return v


def tokens(texts: list[str], codes: Codes, find=re.compile(TOKEN).findall) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all words, words per sentence, document of each sentence) of plain texts; empty sentences are left out."""
    flat, ends = [], []
    for t in texts:
        if t:
            flat += find(t)
        flat.append("\n")
        ends.append(len(flat))
    ids = np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat))
    mark = ids < 0
    sentence = (np.cumsum(mark) - mark)[~mark]
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[~mark]
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    return ids[~mark], np.diff(np.append(first, len(sentence))), doc[first]


def _mix(words: np.ndarray) -> np.ndarray:
    """One number for each run of ``SHINGLE`` words."""
    n = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return h


class Runs:
    """The runs of ``SHINGLE`` words of some texts, and which sentences consist of them."""

    def __init__(self, texts: list[str]):
        codes = Codes()
        found = [_mix(tokens([t], codes)[0]) for t in texts]
        self.hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.some = np.zeros(1 << 20, bool)
        self.some[self.hashes >> np.uint64(44)] = True

    def made_of(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per sentence whether at least half of its words lie in runs; ``words`` of all sentences one after another."""
        mixed = _mix(words)
        hit = np.flatnonzero(self.some[mixed >> np.uint64(44)])
        hit = hit[np.isin(mixed[hit], self.hashes)]
        if not len(hit):
            return np.zeros(len(sizes), bool)
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        hit = hit[sentence[hit] == sentence[hit + SHINGLE - 1]]
        inside = np.zeros(len(words), bool)
        for k in range(SHINGLE):
            inside[hit + k] = True
        n = np.bincount(sentence[inside], minlength=len(sizes))
        return (n > 0) & (2 * n >= sizes)


def solve(xh: np.ndarray, hh: np.ndarray, steps: int, block: int = 2_048) -> np.ndarray:
    """Mixtures W >= 0 for which W H comes closest to the rows, by multiplicative updates; ``xh`` is X H^T, ``hh`` H H^T.

    Rows don't hang on one another; they are taken in blocks that stay in the cache through all steps, one column after another.
    """
    n, k = xh.shape
    w = np.full((k, n), 1.0 / max(1, k))
    for at in range(0, n, block):
        x, part = np.ascontiguousarray(xh[at : at + block].T), w[:, at : at + block].copy()
        below = np.empty_like(part)
        for _ in range(steps):
            np.matmul(hh, part, out=below)
            below += 1e-9
            np.divide(x, below, out=below)
            part *= below
        w[:, at : at + block] = part
    return np.ascontiguousarray(w.T)


def _rows(row: np.ndarray, term: np.ndarray, idf: np.ndarray, size: int, n: int, weight: np.ndarray | None = None):
    """(row, term, value), sorted by row: summed weights, or log-scaled counts without ``weight``, times idf, with rows of length 1."""
    key = row * size + term
    if weight is None:
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        v = 1 + np.log(np.diff(np.append(first, len(key))))
        key = key[first]
    else:
        key, inverse = np.unique(key, return_inverse=True)
        v = np.bincount(inverse, weight, minlength=len(key))
    row = key // size
    term = key - row * size
    v = v * idf[term]
    norm = np.sqrt(np.bincount(row, v * v, minlength=n))
    return row, term, v / np.maximum(norm[row], 1e-9)


def _times(row, term, v, h: np.ndarray, n: int) -> np.ndarray:
    """X H^T of rows sorted by ``row``."""
    out = np.zeros((n, len(h)))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    if len(first):
        out[row[first]] = np.add.reduceat(np.ascontiguousarray(h.T)[term] * v[:, None], first, axis=0)
    return out


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, CHUNK):
            yield b.slice(k, CHUNK)


class Columns:
    """Where the hash of a term stands in the matrices: a column of its own, or one of ``buckets`` that rare terms share."""

    def __init__(self, often: np.ndarray, buckets: int, evidence: np.ndarray | None = None):
        self.often, self.buckets, self.evidence = np.sort(often), buckets, evidence
        self.size = len(often) + buckets
        # Most terms are found by the low bits of their hash; what another term hides there is looked for in order.
        self.mask = (1 << min(22, max(12, (8 * len(often)).bit_length()))) - 1
        self.slot = np.zeros(self.mask + 1, np.int32)
        self.slot[self.often & self.mask] = np.arange(len(often))

    def of(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.often):
            return terms % self.buckets
        at = self.slot[terms & self.mask].astype(np.int64)
        lost = np.flatnonzero(self.often[at] != terms)
        if len(lost):
            t = terms[lost]
            near = np.minimum(np.searchsorted(self.often, t), len(self.often) - 1)
            at[lost] = np.where(self.often[near] == t, near, len(self.often) + t % self.buckets)
        return at

    def languages(self, b: pa.RecordBatch, terms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The language of each document of a batch; where none is known, the one whose documents hold its terms most often."""
        lang = b.column("lang").to_numpy(zero_copy_only=False)
        lost = np.repeat(lang < 0, lengths)
        if lost.any():
            doc = np.repeat(np.arange(len(lang)), lengths)[lost]
            by = np.stack([np.bincount(doc, e[terms[lost]], minlength=len(lang)) for e in self.evidence])
            lang = np.where(lang < 0, by.argmax(axis=0), lang)
        return np.maximum(lang, 0)


def _by_language(b: pa.RecordBatch, columns: Columns):
    """(language, its documents' places in the batch, terms, sizes of documents) of a batch."""
    terms, lengths = _lists(b.column("terms"))
    terms = columns.of(terms)
    lang = columns.languages(b, terms, lengths)
    for g in np.unique(lang):
        own = np.flatnonzero(lang == g)
        yield g, own, terms[np.repeat(lang == g, lengths)], lengths[own]


def _sparse(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Sums per component as blocks of terms, without the blocks that hold nothing."""
    k_out, b_out, v_out = [], [], []
    for k, v in sums.items():
        for at in range(0, len(v), BLOCK):
            part = v[at : at + BLOCK]
            if part.any():
                k_out.append(k)
                b_out.append(at // BLOCK)
                v_out.append(part)
    return pa.RecordBatch.from_arrays([pa.array(k_out, pa.int32()), pa.array(b_out, pa.int32()), pa.array(v_out, pa.list_(pa.float64()))], schema=_SUMS)


def _gathered(rows: DataFrame, lengths: list[int]) -> list[np.ndarray]:
    """The sums of ``_sparse`` rows: added per (component, block) where the shuffle puts them, then read into one array per component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}
        for b in batches:
            values, sizes = _lists_of_double(b.column("num"))
            start = 0
            for k, block, n in zip(b.column("k").to_pylist(), b.column("block").to_pylist(), sizes):
                v = values[start : start + n]
                start += n
                at[k, block] = at[k, block] + v if (k, block) in at else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in at], pa.int32()), pa.array([b for _, b in at], pa.int32()), pa.array(list(at.values()), pa.list_(pa.float64()))], schema=_SUMS)

    out = [np.zeros(n) for n in lengths]
    for r in rows.repartition("k", "block").mapInArrow(add, "k int, block int, num array<double>").collect():
        out[r.k][r.block * BLOCK : r.block * BLOCK + len(r.num)] = r.num
    return out


def _lists_of_double(column) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy(zero_copy_only=False))


def subjects(
    documents: DataFrame, labels: DataFrame, areas: DataFrame, held_out: DataFrame, share: float = 0.2, rounds: int = 6, least_share: float = 0.0005, buckets: int = 4_096,
    max_labels: int = 200_000, steps: int = 20, sentence_steps: int = 30, lead: float = 0.5, clear: float = 0.25, strength: float = 0.05, spread: float = 0.02, described_in: str = "en",
) -> DataFrame:
    """(doc_id, subject, share): subjects that at least ``share`` of a document's subject-bearing sentences deal with.

    The document-term matrix of all documents of a language is factored as W H by alternating non-negative updates. One
    component per subject is anchored: seeded with what the documents labelled so hold above the mean of the subjects and
    with the words of the subject's description; one free component takes up what all share. ``spread`` of the mean row
    is added to each anchor, as an update can't raise a zero. Each of the ``rounds`` goes over all rows where they lie and
    sends only sums per component and block of terms. Labels that disagree with a row's words weigh on no component by
    force, so wrong and missing ones are outvoted.

    The subjects are read off W: the sentences are rows under the same H, a word counting up to ``lead`` less the later it
    stands, since side remarks come last. A sentence deals with the subject of its largest mixture weight, if this is at
    least ``strength`` and holds ``clear`` of the weight of all components; other sentences, and those of which half the
    words lie in passages of ``SHINGLE`` words of held-out items, bear none.

    Terms are words of three letters or more, told apart by 32 bits of hash and counted over all documents. Those in less
    than ``least_share`` of them share ``buckets`` columns, so that none is dropped and there are at most mean terms per
    document / least_share + buckets columns. Languages are those with labelled documents; a document that names another or none belongs to the one whose
    documents hold its words most often. Of more than ``max_labels`` labels those with the smallest hashes are taken;
    labels of unknown subjects don't count. ``areas`` and ``held_out`` are fixed tables and read whole. Null ids are left
    out; null and empty texts have no subject.
    """
    spark = documents.sparkSession
    code = F.lower(F.substring(F.trim(F.coalesce("lang", F.lit(""))), 1, 2))
    docs = documents.where("doc_id is not null").select("doc_id", F.when(code.rlike("^[a-z]{2}$") & (F.lower(F.trim("lang")) != "und"), code).otherwise("").alias("tongue"), plain(F.coalesce("text", F.lit(""))).alias("t"))
    described = {r[0]: (r[1] or "").lower() for r in areas.where("subject is not null").select("subject", "description").orderBy("subject", "description").collect()}
    names = sorted(described)
    n_subjects = len(names)
    runs = spark.sparkContext.broadcast(Runs([r[0] for r in held_out.select(plain(F.coalesce("text", F.lit("")))).collect()]))
    number = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "subject string, s int")
    marked = labels.join(F.broadcast(number), "subject").select("doc_id", "s").where("doc_id is not null").distinct()
    # At most max_labels rows, so broadcast.
    marked = durable(marked.orderBy(F.xxhash64("doc_id", "s"), "doc_id", "s").limit(max_labels))
    held = {(r.tongue, r.s): r.n for r in docs.join(F.broadcast(marked), "doc_id").groupBy("tongue", "s").agg(F.count("*").alias("n")).collect()}
    tongues = sorted({g for g, _ in held if g}) or [""]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, at = Codes(), lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        for b in _chunks(batches):
            words, sizes, doc = tokens(b.column("t").to_pylist(), codes)
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            keep = (words % 2 == 1) & ~runs.value.made_of(words, sizes)[sentence]
            n_terms = np.bincount(sentence[keep], minlength=len(sizes))
            filled = n_terms > 0
            lang = np.array([tongues.index(g) if g in tongues else -1 for g in b.column("tongue").to_pylist()], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), pa.array(lang),
                pa.ListArray.from_arrays(at(np.bincount(doc, n_terms, minlength=b.num_rows)), pa.array((words[keep] >> 1).astype(np.uint32).view(np.int32))),
                pa.ListArray.from_arrays(at(np.bincount(doc[filled], minlength=b.num_rows)), pa.array(n_terms[filled].astype(np.int32))),
            ], schema=_CODED)

    coded = durable(docs.mapInArrow(encode, "doc_id bigint, lang int, terms array<int>, sizes array<int>"))

    # Document frequencies per language, over all documents; rare terms count in hashed columns.
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            terms, lengths = _lists(b.column("terms"))
            lang = b.column("lang").to_numpy(zero_copy_only=False)
            seen = np.unique((np.repeat(np.arange(len(lang)), lengths) << 32) + terms + 2**31)
            key, n = np.unique((lang[seen >> 32].astype(np.int64) << 32) + (seen & (2**32 - 1)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array(((key & (2**32 - 1)) - 2**31).astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "term", "df"])

    sizes = {r.lang: r.n for r in coded.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    n_docs = sum(sizes.values())
    counts = coded.select("lang", "terms").mapInArrow(count, "lang int, term int, df bigint").groupBy("term", "lang").agg(F.sum("df").alias("df"))
    often = F.sum("df").over(Window.partitionBy("term")) >= max(2.0, least_share * n_docs)
    column = F.when(often, F.col("term").cast("bigint")).otherwise(F.lit(2**32) + F.pmod("term", F.lit(buckets)))
    table = counts.withColumn("term", column).groupBy("term", "lang").agg(F.sum("df").alias("df")).collect()
    columns = Columns(np.array(sorted({r.term for r in table if r.term < 2**31}), dtype=np.int64), buckets)
    size = columns.size
    df = np.zeros((len(tongues), size))
    for r in table:
        if r.lang >= 0:
            df[r.lang, int(columns.of(np.array([r.term]))[0]) if r.term < 2**31 else len(columns.often) + r.term - 2**32] += r.df
    own = np.array([max(1, sizes.get(g, 0)) for g in range(len(tongues))], dtype=float)
    idf = np.maximum(np.log(own[:, None] / np.maximum(df, 1.0)), 0.0) + 0.02
    columns.evidence = df / own[:, None] / np.maximum((df / own[:, None]).sum(axis=0), 1e-12)
    shared = spark.sparkContext.broadcast((columns, idf))
    k_all, n_tongues = n_subjects + 1, len(tongues)
    every = [size] * (k_all * n_tongues)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (columns, idf), sums = shared.value, {}
        for b in _chunks(batches):
            mark = b.column("s").to_numpy(zero_copy_only=False)
            for g, own, terms, lengths in _by_language(b, columns):
                row, term, v = _rows(np.repeat(np.arange(len(own)), lengths), terms, idf[g], columns.size, len(own))
                for s in np.unique(mark[own]):
                    k = g * k_all + int(s)
                    sums[k] = sums.get(k, 0.0) + np.bincount(term, v * (mark[own] == s)[row], minlength=columns.size)
        yield _sparse(sums)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (columns, idf), h, sums, extra = shared.value, now.value, {}, {}
        for b in _chunks(batches):
            for g, own, terms, lengths in _by_language(b, columns):
                row, term, v = _rows(np.repeat(np.arange(len(own)), lengths), terms, idf[g], columns.size, len(own))
                w = solve(_times(row, term, v, h[g], len(own)), h[g] @ h[g].T, steps) if h is not None else np.ones((len(own), 1))
                for k in range(w.shape[1]):
                    sums[g * k_all + k] = sums.get(g * k_all + k, 0.0) + np.bincount(term, v * w[row, k], minlength=columns.size)
                extra[g] = extra.get(g, 0.0) + w.T @ w
        # W^T W of a language rides along as one more block of its components.
        yield _sparse(sums)
        yield _sparse({k_all * n_tongues + g: m.ravel() for g, m in extra.items()})

    h = None
    if n_subjects and n_docs:
        now = spark.sparkContext.broadcast(None)
        mean = _gathered(coded.mapInArrow(step, "k int, block int, num array<double>"), every + [1] * n_tongues)
        given = _gathered(coded.join(F.broadcast(marked), "doc_id").select("lang", "terms", "s").mapInArrow(seeds, "k int, block int, num array<double>"), every)
        h = np.zeros((n_tongues, k_all, size))
        for g, tongue in enumerate(tongues):
            for s in range(n_subjects):
                v = given[g * k_all + s]
                h[g, s] = v / max(1, held.get((tongue, s), 0))
                if tongue in (described_in, ""):
                    words = tokens([described[names[s]]], Codes())[0]
                    h[g, s, np.unique(columns.of((words[words % 2 == 1] >> 1).astype(np.uint32).view(np.int32).astype(np.int64)))] += 0.02
            base = h[g, :n_subjects].mean(axis=0)
            whole = mean[g * k_all]
            h[g, :n_subjects] = np.maximum(h[g, :n_subjects] - base, 0.0)
            h[g, n_subjects] = np.minimum(whole / max(whole.sum(), 1e-9), base / max(base.sum(), 1e-9)) + 1e-6 * (whole > 0)
            h[g] /= np.maximum(np.linalg.norm(h[g], axis=1, keepdims=True), 1e-9)
            h[g, :n_subjects] += spread * whole / max(np.linalg.norm(whole), 1e-9)
        for _ in range(rounds):
            now = spark.sparkContext.broadcast(h)
            got = _gathered(coded.mapInArrow(step, "k int, block int, num array<double>"), every + [k_all * k_all] * n_tongues)
            now.unpersist()
            for g in range(n_tongues):
                num, den = np.stack(got[g * k_all : (g + 1) * k_all]), got[k_all * n_tongues + g].reshape(k_all, k_all)
                h[g] = h[g] * num / (den @ h[g] + 1e-9)
                h[g] /= np.maximum(np.linalg.norm(h[g], axis=1, keepdims=True), 1e-9)
    told = spark.sparkContext.broadcast(h)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (columns, idf), h = shared.value, told.value
        schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("share", pa.float64())])
        for b in _chunks(batches) if h is not None else ():
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            terms, lengths = _lists(b.column("terms"))
            terms = columns.of(terms)
            lang = columns.languages(b, terms, lengths)
            sizes, n_sentences = _lists(b.column("sizes"))
            doc = np.repeat(np.arange(b.num_rows), n_sentences)
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            place_in = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            weight = 1.0 - lead * place_in / np.maximum(1, sizes[sentence])
            mixture = np.zeros((len(sizes), k_all))
            for g in np.unique(lang[doc]):
                on = (lang[doc] == g)[sentence]
                row, term, v = _rows(sentence[on], terms[on], idf[g], columns.size, len(sizes), weight[on])
                own = np.unique(row)
                at = np.zeros(len(sizes), dtype=np.int64)
                at[own] = np.arange(len(own))
                mixture[own] = solve(_times(at[row], term, v, h[g], len(own)), h[g] @ h[g].T, sentence_steps)
            best = mixture[:, :n_subjects].argmax(axis=1)
            most = mixture[np.arange(len(sizes)), best]
            bears = (most >= strength) & (most >= clear * mixture.sum(axis=1))
            tally = np.bincount(doc[bears] * n_subjects + best[bears], minlength=b.num_rows * n_subjects).reshape(b.num_rows, n_subjects)
            part = tally / np.maximum(tally.sum(axis=1, keepdims=True), 1)
            d, s = np.nonzero((tally > 0) & (part >= share - 1e-9))
            yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array([names[k] for k in s], pa.string()), pa.array(part[d, s])], schema=schema)

    return coded.mapInArrow(judge, "doc_id bigint, subject string, share double")


def corpus_shares(found: DataFrame) -> DataFrame:
    """(subject, n_documents, share): each document counts once, divided by its subjects' shares."""
    whole = found.groupBy("doc_id").agg(F.sum("share").alias("_w"))
    n = whole.agg(F.count("*").alias("_n"))
    rows = found.join(whole, "doc_id").groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum(F.col("share") / F.col("_w")).alias("_s"))
    return rows.crossJoin(n).select("subject", "n_documents", (F.col("_s") / F.col("_n")).alias("share"))
