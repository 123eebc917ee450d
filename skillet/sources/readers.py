"""Sources and sinks: recipe CSVs, JSON-lines caches, guarded overwrites and a published pointer."""

from __future__ import annotations

import ast
import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def recipe_rows(spark: SparkSession, path: str, source: str = "recipes") -> DataFrame:
    """(recipe_id, source, source_url, raw_payload) of a CSV whose first, unnamed column numbers the rows; the whole row is kept as JSON."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    first = rows.columns[0]
    url = F.col("link") if "link" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.concat(F.lit(f"{source}:"), F.col(f"`{first}`")).alias("recipe_id"), F.lit(source).alias("source"), url.alias("source_url"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("raw_payload"))


def listed(cell: Column) -> Column:
    """The texts of a list written as JSON; one written as a Python literal is read where JSON fails. Null for anything else."""

    @F.pandas_udf("array<string>")
    def literal(cells: pd.Series) -> pd.Series:
        def read(c):
            try:
                v = ast.literal_eval(c) if c is not None else None
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return None
            return [x if isinstance(x, str) else None for x in v] if isinstance(v, list) else None

        return cells.map(read)

    parsed = F.when(cell.rlike(r"^\s*\["), F.from_json(cell, "array<string>"))
    odd = cell.rlike(r"^\s*\[\s*'")
    return F.when(odd, literal(F.when(odd, cell))).otherwise(parsed)


def ingredient_lines(raw: DataFrame, field: str = "ingredients") -> DataFrame:
    """(recipe_id, line_index, line_raw): the lines of each payload; blank ones are left out, the others keep their numbers."""
    lines = listed(F.get_json_object("raw_payload", f"$.{field}"))
    return raw.select("recipe_id", F.posexplode(lines).alias("line_index", "line_raw")).where(F.trim("line_raw") != "")


def records_of(lines: DataFrame, schema: str, key: list[str], at: str) -> DataFrame:
    """JSON ``lines`` (value) with torn ones dropped; of each key the last record by ``at``. Records without a key are no records."""
    whole = lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*").dropna(subset=key)
    rest = [c for c in whole.columns if c not in key and c != at]
    return whole.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("_r")).select(*key, "_r.*")


def last_records(spark: SparkSession, path: str, schema: str, key: list[str], at: str) -> DataFrame:
    """``records_of`` the JSON-lines files at ``path``."""
    return records_of(spark.read.text(path), schema, key, at)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a Parquet table; an empty one is refused, since it would wipe what is there."""
    if df.isEmpty():
        raise ValueError(f"refusing to overwrite {path} with no rows")
    df.write.mode("overwrite").parquet(path)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a place that the cluster shares, whatever its scheme."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a small file; without ``replace`` only if there is none, and tell whether it was written."""
    fs, p = _folder(spark, path)
    if not replace and fs.exists(p):
        return False
    try:
        out = fs.create(p, replace)
    except Exception:
        if replace:
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


@contextmanager
def lock(spark: SparkSession, path: str, wait: float = 60.0, pause: float = 0.2) -> Iterator[None]:
    """An exclusive lock of writers: a file on the shared file system that only one can create. Raises ``TimeoutError`` after ``wait`` seconds."""
    until = time.monotonic() + wait
    while not write_text(spark, path, "held", replace=False):
        if time.monotonic() >= until:
            raise TimeoutError(f"{path} is held by another writer")
        time.sleep(pause)
    try:
        yield
    finally:
        fs, p = _folder(spark, path)
        fs.delete(p, False)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, run: str, revision: str = "") -> None:
    """Write all tables below ``root``/``run``, then turn one pointer file to them: readers see all or none.

    The pointer names the run, its tables with their rows, and the revision of the code. Empty tables are refused before the pointer moves.
    """
    with lock(spark, f"{root}/.lock"):
        rows = {}
        for name, df in tables.items():
            overwrite(df, f"{root}/{run}/{name}")
            rows[name] = spark.read.parquet(f"{root}/{run}/{name}").count()
        write_text(spark, f"{root}/pointer.json", json.dumps({"run": run, "tables": rows, "revision": revision}))


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    pointer = read_text(spark, f"{root}/pointer.json")
    if pointer is None:
        raise FileNotFoundError(f"nothing is published below {root}")
    return spark.read.parquet(f"{root}/{json.loads(pointer)['run']}/{name}")


def export(spark: SparkSession, root: str, names: list[str], target: str) -> None:
    """Copy published tables to ``target`` as one file each, for readers without a cluster."""
    for name in names:
        published(spark, root, name).coalesce(1).write.mode("overwrite").parquet(f"{target}/{name}")


def append_records(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, such as labels, verdicts or an audit log; ``last_records`` reads the last of each key."""
    df.write.mode("append").json(path)


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, n_files, n_bytes) of the Parquet tables below a folder."""
    fs, p = _folder(spark, root)
    rows = []
    for entry in fs.listStatus(p) if fs.exists(p) else []:
        name = entry.getPath().getName()
        if name.endswith(".parquet") or entry.isDirectory() and not name.startswith((".", "_")):
            size = fs.getContentSummary(entry.getPath())
            rows.append((name.removesuffix(".parquet"), size.getFileCount(), size.getLength()))
    return spark.createDataFrame(rows, "table_name string, n_files long, n_bytes long")
