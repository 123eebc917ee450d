"""Nested JSON records turned into related flat tables.

Every object of a record gets a pre-order and a post-order number by a
depth-first walk. A node lies inside another exactly when its interval
[pre, post] lies inside the other's, so the node tables are tied together by
interval containment alone, whatever the depth or the shape of the fields
between them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillet.functions.ids import number_in


@dataclass(frozen=True)
class Kind:
    """A type of node: the field whose elements it is, the kind it lies in, its key and the plain fields to keep."""

    name: str
    field: str
    parent: str
    key: str
    keep: tuple[str, ...] = ()


@dataclass(frozen=True)
class Layout:
    root: str
    kinds: tuple[Kind, ...]
    _by: dict = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "_by", {(k.parent, k.field): k for k in self.kinds})


FOODS = Layout(
    "food",
    (
        Kind("nutrient", "foodNutrients", "food", "id", ("number", "nutrient.number", "name", "nutrient.name", "amount", "unitName", "nutrient.unitName")),
        Kind("analysis", "nutrientAnalysisDetails", "nutrient", "subSampleId", ("amount",)),
        Kind("acquisition", "nutrientAcquisitionDetails", "analysis", "sampleUnitId", ("purchaseDate", "storeCity")),
        Kind("portion", "foodPortions", "food", "id", ("amount", "gramWeight", "modifier", "measureUnit.name")),
        Kind("input", "inputFoods", "food", "id", ("foodDescription", "inputFood.description", "inputFood.dataType")),
        Kind("input_nutrient", "foodNutrients", "input", "id", ("number", "nutrient.number", "name", "nutrient.name", "amount", "unitName", "nutrient.unitName")),
    ),
)

NODES = "doc bigint, kind string, key bigint, pre bigint, post bigint, level bigint, body string"
_NODES = pa.schema([("doc", pa.int64()), ("kind", pa.string()), ("key", pa.int64()), ("pre", pa.int64()), ("post", pa.int64()), ("level", pa.int64()), ("body", pa.string())])


def _parsed(text):
    """The JSON value in a text, or None if it isn't complete."""
    try:
        return json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return None


def _number(v):
    """The number that a key's digits make; None for none, and for one beyond a bigint."""
    if isinstance(v, (bool, dict, list)) or v is None:
        return None
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    digits = "".join(c for c in str(v) if c in "0123456789")
    n = int(digits) if digits and len(digits) < 20 else -1
    return n if 0 <= n < 2**63 else None


def _fields(layout: Layout, kind: Kind) -> frozenset:
    """The fields by which an object shows itself to be of a kind."""
    return frozenset({kind.key} | {p.partition(".")[0] for p in kind.keep} | {k.field for k in layout.kinds if k.parent == kind.name})


def _plain(node: dict, paths: tuple[str, ...]) -> dict:
    got = {}
    for path in paths:
        v = node
        for step in path.split("."):
            v = v.get(step) if isinstance(v, dict) else None
        name = path.rpartition(".")[2] if path.rpartition(".")[2] in ("number", "unitName") or path == "nutrient.name" else path.replace(".", "_")
        if v is not None and not isinstance(v, (dict, list)) and name not in got:
            got[name] = v
    return got


def label(record: dict, layout: Layout, doc: int, with_body: bool, out: list) -> None:
    """Append the nodes of one record to ``out`` (seven lists). The walk keeps its own stack, so depth has no limit.

    Every object of a kind is a node, with or without a readable key; ``pre`` names it within its record.
    """
    clock, shown = [0, 0], {k.name: _fields(layout, k) for k in layout.kinds}

    def enter(kind: str, key, level: int, node: dict, keep) -> int:
        at = len(out[0])
        for column, v in zip(out, (doc, kind, key, clock[0], -1, level, json.dumps(_plain(node, keep)) if with_body else None)):
            column.append(v)
        clock[0] += 1
        return at

    stack = [("visit", record, layout.root, Kind(layout.root, "", "", ""), 0)]
    while stack:
        step, value, inside, kind, level = stack.pop()
        if step == "leave":
            if value >= 0:
                out[4][value] = clock[1]
            clock[1] += 1
            continue
        if isinstance(value, str) and kind is not None and value[:1] in "[{" and value[:1]:
            value = _parsed(value)
        if isinstance(value, list):
            stack.extend(("visit", v, inside, kind, level) for v in reversed(value))
            continue
        if not isinstance(value, dict):
            continue
        at = -1
        if kind is not None:
            if kind.name != layout.root and value and shown[kind.name].isdisjoint(value) and all(isinstance(v, (dict, list)) for v in value.values()):
                # An object of objects stands for their list.
                stack.extend(("visit", v, inside, kind, level) for v in reversed(list(value.values())))
                continue
            key = doc if kind.name == layout.root else _number(value.get(kind.key))
            at, inside = enter(kind.name, key, level, value, kind.keep), kind.name
        else:
            clock[0] += 1
        stack.append(("leave", at, None, None, level))
        for name in reversed(list(value)):
            child = layout._by.get((inside, name))
            if child is not None or isinstance(value[name], (dict, list)):
                stack.append(("visit", value[name], inside, child, level + 1))


def latest_complete(raw: DataFrame, id_column: str, payload: str, at: str) -> DataFrame:
    """(doc, payload): per id the last payload that is a complete JSON object.

    A null time counts as the earliest; among payloads of one time the greatest
    text is taken. Ids without a number and null payloads are left out. One row
    per id and partition reaches the shuffle, however many versions an id has.
    """

    @F.pandas_udf("boolean")
    def complete(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and isinstance(_parsed(t), dict)).astype(bool)

    rows = raw.select(number_in(id_column).alias("doc"), F.col(payload).alias("payload"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62))).alias("at"))
    rows = rows.where("doc is not null and payload is not null")
    # The built-in reader settles nearly all; only what it can't read (cut off, beyond its size, keys twice) is sent to Python.
    rows = rows.withColumn("_ok", F.ltrim("payload").startswith("{") & F.try_parse_json("payload").isNotNull())
    rows = rows.where(F.col("_ok") | complete(F.when(~F.col("_ok"), F.col("payload"))))
    return rows.groupBy("doc").agg(F.max(F.struct("at", "payload")).alias("last")).select("doc", F.col("last.payload").alias("payload"))


def nodes(payloads: DataFrame, layout: Layout = FOODS, with_body: bool = True, batch: int = 20_000) -> DataFrame:
    """Node rows (``NODES``) of (doc, payload): every object of a kind of ``layout``, with its interval."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(7)]
            for doc, text in zip(b.column("doc").to_pylist(), b.column("payload").to_pylist()):
                record = _parsed(text)
                if isinstance(record, dict):
                    label(record, layout, doc, with_body, out)
                if len(out[0]) >= batch:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NODES)], schema=_NODES)
                    out = [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NODES)], schema=_NODES)

    return payloads.select("doc", "payload").mapInArrow(walk, NODES)


def link(labelled: DataFrame, layout: Layout = FOODS) -> DataFrame:
    """Node rows but the roots, with ``parent`` and ``parent_pre``: key and pre-order number of the closest enclosing node of the parent kind.

    In pre-order the closest enclosing node of a kind is the last one of it
    before the node, provided that its interval holds the node's; a running
    ``last`` finds it in one pass over a record's nodes, with no pair of nodes
    built. Kinds that hold their own kind aren't meant to be linked this way.
    """
    before = Window.partitionBy("doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    parents = sorted({k.parent for k in layout.kinds})
    rows = labelled.select("*", *[F.last(F.when(F.col("kind") == p, F.struct("key", "pre", "post")), ignorenulls=True).over(before).alias(f"_{p}") for p in parents])
    near = F.coalesce(*[F.when(F.col("kind") == k.name, F.col(f"_{k.parent}")) for k in layout.kinds])
    rows = rows.where(F.col("kind") != layout.root).withColumn("_near", near).where((F.col("_near.pre") < F.col("pre")) & (F.col("_near.post") > F.col("post")))
    return rows.select("doc", "kind", F.col("_near.key").alias("parent"), F.col("_near.pre").alias("parent_pre"), "key", "pre", "post", "level", "body")


def flat_table(linked: DataFrame, kind: str, layout: Layout = FOODS) -> DataFrame:
    """The flat table of one kind: doc, parent, key, parent_pre, pre and its plain fields as strings.

    (doc, pre) names a row and (doc, parent_pre) the row it belongs to, also where an object has no key.
    """
    k = next(k for k in layout.kinds if k.name == kind)
    names = list(dict.fromkeys(p.rpartition(".")[2] if p.rpartition(".")[2] in ("number", "unitName") or p == "nutrient.name" else p.replace(".", "_") for p in k.keep))
    body = F.from_json("body", ", ".join(f"{n} string" for n in names))
    return linked.where(F.col("kind") == kind).withColumn("_b", body).select("doc", "parent", "key", "parent_pre", "pre", *[F.col(f"_b.{n}").alias(n) for n in names])


def found(raw: DataFrame, layout: Layout = FOODS) -> DataFrame:
    """(fdc_id, child_kind, parent_id, child_id), each once, of the last complete payload per fdc_id; objects without a key, or within one, have no such row."""
    linked = link(nodes(latest_complete(raw, "fdc_id", "raw_payload", "ingested_at"), layout, with_body=False), layout)
    return linked.where("key is not null and parent is not null").select(F.col("doc").alias("fdc_id"), F.col("kind").alias("child_kind"), F.col("parent").alias("parent_id"), F.col("key").alias("child_id")).distinct()


def energy(nutrients: DataFrame, numbers: tuple[str, ...] = ("208", "958", "957")) -> DataFrame:
    """(fdc_id, kcal_per_100g): per food the amount of the first of ``numbers`` it has; of repeated ones the first in the payload."""
    rows = nutrients.where(F.col("number").isin(*numbers)).withColumn("_a", F.col("amount").try_cast("double")).where("_a is not null")
    by = rows.groupBy("doc").agg(*[F.min_by("_a", F.when(F.col("number") == n, F.col("pre"))).alias(f"_{n}") for n in numbers])
    return by.select(F.col("doc").alias("fdc_id"), F.coalesce(*[F.col(f"_{n}") for n in numbers]).alias("kcal_per_100g"))
