"""Samples whose categories have given proportions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillet.session import durable


def rake(cells: dict[tuple, float], targets: list[dict], rounds: int = 200, tolerance: float = 1e-9) -> dict[tuple, float]:
    """Weights of cells whose margins are ``targets``, by iterative proportional fitting.

    A cell is a tuple with one category per margin; ``cells`` has the number of
    items in each. ``targets`` gives one dict of category shares per margin. A
    category that holds no item can't be met and is left out of its margin. The
    returned weights sum to 1 over the cells.
    """
    total = sum(cells.values())
    if total <= 0:
        return {c: 0.0 for c in cells}
    w = {c: n / total for c, n in cells.items()}
    for _ in range(rounds):
        moved = 0.0
        for m, shares in enumerate(targets):
            have: dict = {}
            for c, x in w.items():
                have[c[m]] = have.get(c[m], 0.0) + x
            asked = sum(s for k, s in shares.items() if have.get(k, 0) > 0)
            if asked <= 0:
                continue
            for c in w:
                goal = shares.get(c[m], 0.0) / asked
                f = goal / have[c[m]] if have[c[m]] > 0 else 0.0
                moved = max(moved, abs(have[c[m]] - goal))
                w[c] *= f
        if moved < tolerance:
            break
    return w


def _whole(wish: dict, room: dict, n: int) -> dict:
    """Whole numbers that sum to ``n``: largest remainders of ``wish``, at most ``room``."""
    got = {c: min(math.floor(x + 1e-9), int(room[c])) for c, x in wish.items()}
    spare = n - sum(got.values())
    for c in sorted(wish, key=lambda c: (got[c] - wish[c], str(c))):
        if spare > 0 and got[c] < room[c]:
            got[c] += 1
            spare -= 1
    return got


def _fill(weights: dict[tuple, float], cells: dict[tuple, float], goal: float) -> dict[tuple, float]:
    """``goal`` items over cells in proportion to their weights; what a cell lacks goes to those that have room.

    Cells without weight come last, in proportion to what they hold. Only if all cells are used up less than ``goal`` comes out.
    """
    out = dict.fromkeys(cells, 0.0)
    for by in (weights, cells):
        while goal - sum(out.values()) > 1e-9:
            free = {c: by.get(c, 0.0) for c in cells if out[c] < cells[c] and by.get(c, 0.0) > 0}
            if not free:
                break
            left, whole = goal - sum(out[c] for c in cells if c not in free), sum(free.values())
            for c, w in free.items():
                out[c] = min(max(out[c], left * w / whole), cells[c])
            if all(out[c] < cells[c] for c in free):
                break
    return out


def allot(weights: dict[tuple, float], cells: dict[tuple, float], total: int, minimum: int, margin: int = 0, shares: dict | None = None) -> dict[tuple, int]:
    """Whole numbers of items per cell: each category of ``margin`` gets its share of ``total`` or all that it holds,
    spread over its cells by their weights; what a cell lacks is taken from the category's cells that have room. Then
    repaired so that each category has ``minimum`` items if it holds as many. Categories that can't be filled don't
    pass their share on: the shares are asked for, not the sum. Without ``shares`` the weights' sums stand for them."""
    inside = {k: {c: n for c, n in cells.items() if c[margin] == k} for k in sorted({c[margin] for c in cells}, key=str)}
    if shares is None:
        shares = {k: sum(weights.get(c, 0.0) for c in of) for k, of in inside.items()}
    asked = sum(shares.values()) or 1.0
    holds = {k: sum(of.values()) for k, of in inside.items()}
    goal = {k: min(max(0.0, total * shares.get(k, 0.0) / asked), holds[k]) for k in inside}
    whole = _whole(goal, holds, math.floor(sum(goal.values()) + 0.5))
    got: dict = {}
    for k, of in inside.items():
        got |= _whole(_fill(weights, of, whole[k]), of, whole[k])
        short = min(minimum, holds[k]) - whole[k]
        for c in sorted(of, key=lambda c: (-(of[c] - got[c]), str(c))):
            more = max(0, min(short, of[c] - got[c]))
            got[c] += int(more)
            short -= int(more)
    return got


def demands(manifest: DataFrame, strata: tuple[str, ...]) -> DataFrame:
    """(manifest_id, stratum, share, asked): what each manifest asks of each stratum.

    asked = total * share of the sum of per_stratum (null is 0), or
    min_per_stratum if that is more (null is 0). Without any positive share, or
    without a total, only the minimum is asked for. Rows with a null
    manifest_id are left out.
    """
    part = {s: F.greatest(F.coalesce(F.col(f"per_stratum.{s}"), F.lit(0.0)), F.lit(0.0)) for s in strata}
    whole = reduce(lambda a, b: a + b, part.values())
    rows = [F.struct(F.lit(s).alias("stratum"), F.coalesce(F.try_divide(p, whole), F.lit(0.0)).alias("share")) for s, p in part.items()]
    asked = F.greatest(F.coalesce(F.col("total"), F.lit(0)) * F.col("share"), F.coalesce(F.col("min_per_stratum"), F.lit(0)).cast("double"))
    out = manifest.where("manifest_id is not null").select("manifest_id", "seed", "total", "min_per_stratum", F.inline(F.array(*rows)))
    return out.select("*", asked.alias("asked"))


def strata_of(strings: DataFrame, strata: tuple[str, ...], keep: list[Column] = ()) -> DataFrame:
    """Distinct (item, stratum): strata without case and blanks; null strings, null and unknown strata belong to none."""
    rows = strings.select(F.col("normalized_text").alias("item"), F.lower(F.trim("frequency_stratum")).alias("stratum"), *keep)
    return rows.where(F.col("item").isNotNull() & F.col("stratum").isin(*strata)).distinct()


def gaps(strings: DataFrame, manifest: DataFrame, strata: tuple[str, ...] = ("head", "mid", "tail")) -> DataFrame:
    """(manifest_id, stratum, asked, available, missing) of the strata with fewer distinct strings than asked for."""
    counts = strata_of(strings, strata).groupBy("stratum").agg(F.count("*").alias("available"))
    rows = demands(manifest, strata).join(counts, "stratum", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return rows.where(F.col("available") < F.col("asked") - 1e-9).select("manifest_id", "stratum", "asked", "available", (F.col("asked") - F.col("available")).alias("missing"))


def draw(items: DataFrame, key: str, margins: list[Column], manifest_rows: list[dict], slack: float = 6.0, max_cells: int = 10_000) -> tuple[DataFrame, list[dict]]:
    """(sample, residuals) for manifests asking for shares of one or several category margins.

    ``items``: one row per item. ``margins``: a category column per margin; an
    item with a null category in any belongs to no cell. ``manifest_rows``: dicts with id, seed, total, minimum
    and targets (a dict of shares per margin; the minimum holds for the first).

    The cells' weights are raked on the driver from the cell counts (at most
    ``max_cells`` cells, a number of categories, not of rows). Where a cell holds
    less than its weight asks for, the cells of the same first category make up
    for it, at the cost of the other margins. Each item of a cell gets the weighted
    exponential key -ln(u)/w, w being the cell's weight by its number of items and
    u a hash of seed and item; the cell's allotment of smallest keys is drawn.

    Of n out of N items the last key drawn lies, but for less than one case in a billion, between the keys that n -/+
    ``slack`` * sqrt(n + 1) items are expected below. Items beyond the upper one are dropped where they are read, items
    below the lower one are taken, and only those between are ranked, so a cell of any size is neither shuffled
    nor sorted whole. A cell in which that guess fails is ranked whole. One seed always draws the same items.
    """
    names = [f"_m{k}" for k in range(len(margins))]
    base = items.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), *[m.alias(n) for m, n in zip(margins, names)]).dropna(subset=names).distinct()
    cells = {tuple(r[n] for n in names): r["count"] for r in base.groupBy(*names).count().limit(max_cells + 1).collect()}
    if len(cells) > max_cells:
        raise ValueError(f"more than {max_cells} cells")
    spark = items.sparkSession
    plan, residuals = [], []
    for m in manifest_rows:
        weights = rake(cells, m["targets"]) if cells else {}
        got = allot(weights, cells, m["total"], m["minimum"], shares=m["targets"][0]) if cells else {}
        for c, n in got.items():
            if n > 0:
                w = max(weights.get(c, 0.0), 1e-9) / cells[c]
                low, high = [_key_below(n + side * slack * math.sqrt(n + 1), cells[c], w) for side in (-1, 1)]
                plan.append((m["id"], int(m["seed"]), *c, int(n), w, low, high))
        for k, shares in enumerate(m["targets"]):
            for category in shares:
                drawn = sum(n for c, n in got.items() if c[k] == category)
                asked = m["total"] * shares[category] / (sum(shares.values()) or 1.0)
                residuals.append({"manifest_id": m["id"], "margin": k, "category": category, "asked": float(max(asked, m["minimum"] if k == 0 else 0.0)), "drawn": drawn})
    schema = "manifest_id string, seed bigint, " + ", ".join(f"{n} string" for n in names) + ", n bigint, w double, low double, high double"
    # One row per manifest and cell, so broadcast.
    wanted = spark.createDataFrame(plan, schema)
    # 52 bits of hash make u, which lies strictly between 0 and 1.
    digits = F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit("|"), F.col("item"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    keyed = base.join(F.broadcast(wanted), names).withColumn("_key", -F.log(u) / F.col("w"))
    cell, columns = ["manifest_id", *names], ["manifest_id", "item", *names]
    # About as many rows as are drawn; the others go where they are read.
    near = durable(keyed.where(F.col("_key") < F.col("high")).select(*columns, "n", "low", "_key"))
    held = near.groupBy(*cell).agg(F.count_if(F.col("_key") < F.col("low")).alias("_sure"), F.count("*").alias("_near"))
    # One row per manifest and cell at most, and hardly ever any.
    missed = wanted.join(held, cell, "left").where((F.coalesce("_sure", F.lit(0)) > F.col("n")) | (F.coalesce("_near", F.lit(0)) < F.col("n"))).select(*cell).collect()
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("_key", "item"))
    failed = spark.createDataFrame(missed, wanted.select(*cell).schema)
    rest = near.join(F.broadcast(failed), cell, "left_anti") if missed else near
    sure = rest.where(F.col("_key") < F.col("low"))
    between = rest.where(F.col("_key") >= F.col("low")).join(F.broadcast(held), cell)
    edge = between.withColumn("_r", place).where(F.col("_r") <= F.col("n") - F.col("_sure"))
    drawn = sure.select(*columns).unionByName(edge.select(*columns))
    if missed:
        whole = keyed.join(F.broadcast(failed), cell).withColumn("_r", place).where(F.col("_r") <= F.col("n"))
        drawn = drawn.unionByName(whole.select(*columns))
    return drawn, residuals


def _key_below(n: float, of: float, w: float) -> float:
    """The key -ln(u)/w below which ``n`` items of ``of`` are expected."""
    if n <= 0:
        return 0.0
    return math.inf if n >= of else -math.log1p(-n / of) / w


def unmet(sample: DataFrame, residuals: list[dict], strings: DataFrame, manifest: DataFrame, strata: tuple[str, ...] = ("head", "mid", "tail")) -> DataFrame:
    """(manifest_id, stratum, asked, drawn) of the strata, as the first margin of ``draw``, that its sample leaves short.

    Whole numbers may leave a stratum less than one item short of what it could have; ``gaps`` counts, as an exact check, whether it holds enough.
    """
    wish = [(r["manifest_id"], r["category"], r["asked"]) for r in residuals if r["margin"] == 0]
    asked = sample.sparkSession.createDataFrame(wish, "manifest_id string, stratum string, asked double")
    drawn = sample.groupBy("manifest_id", F.col("_m0").alias("stratum")).agg(F.count("*").alias("drawn"))
    short = asked.join(drawn, ["manifest_id", "stratum"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < asked")
    return short.join(gaps(strings, manifest, strata), ["manifest_id", "stratum"], "left_semi")


def manifest_rows(manifest: DataFrame, strata: tuple[str, ...], others: list[dict] = ()) -> list[dict]:
    """The manifests as ``draw`` takes them; ``others`` are the targets of further margins. The table of manifests is fixed and read whole."""
    by: dict = {}
    for r in demands(manifest, strata).collect():
        m = by.setdefault(r["manifest_id"], {"id": r["manifest_id"], "seed": r["seed"] or 0, "total": int(r["total"] or 0), "minimum": int(r["min_per_stratum"] or 0), "targets": [{}, *others]})
        m["targets"][0][r["stratum"]] = r["share"]
    return list(by.values())
