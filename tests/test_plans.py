import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skillet.functions.answers import last_answers, majority
from skillet.operators import candidates
from skillet.plans import answers, quality, scoring, stats

SMALL = "/root/testdata/sf0.001"


def test_running_sums_against_one_window(spark):
    rng = np.random.default_rng(1)
    rows = [(float(k), int(rng.integers(0, 9))) for k in rng.permutation(400)]
    df = spark.createDataFrame(rows, "s double, n long")
    want, total = {}, 0
    for s, n in sorted(rows):
        want[s] = total
        total += n
    assert {r.s: r.n_below for r in stats.running(df, "s", ["n"], blocks=7).collect()} == want
    assert stats.running(df.limit(0), "s", ["n"]).count() == 0


def test_thresholds_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i}", round(float(rng.random()), 2), bool(rng.random() < 0.4), bool(rng.random() < 0.7)) for i in range(300)] + [("n", None, True, True)]
    df = spark.createDataFrame(rows, "k string, s double, empty boolean, good boolean")
    known = [r for r in rows if r[1] is not None]

    def f2(t):
        cut = [r for r in known if r[1] < t]
        hit = sum(r[2] for r in cut)
        p, r = hit / len(cut), hit / sum(r[2] for r in known)
        return 5 * p * r / (4 * p + r) if hit else 0.0

    best = max(f2(t) for t in {r[1] for r in known} if any(r[1] < t for r in known))
    got = stats.fit_threshold(df, "s", "empty").first()
    assert got.f == pytest.approx(best) and f2(got.threshold) == pytest.approx(best)
    assert tuple(stats.fit_threshold(df.where("not empty"), "s", "empty").first()) == (0.0, 0.0)
    cv = stats.cross_validated(df, "k", "s", "empty").collect()
    assert len(cv) == 300 and len({(r.fold, r.threshold) for r in cv}) == 5
    order = sorted(known, key=lambda r: (-r[1], r[0]))
    curve = {r.point: r.accuracy for r in stats.coverage_curve(df, "s", "good", "k").collect()}
    assert curve == {p: pytest.approx(np.mean([r[3] for r in order[: round(300 * p)]])) for p in (0.1, 0.25, 0.5, 0.75, 1.0)}
    hit = stats.best_at_target(df, "s", "good", 0.7).first()
    assert hit.accuracy >= 0.7 and stats.best_at_target(df, "s", "good", 1.1).first().threshold is None


def test_bootstraps(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("double").alias("a"), ((F.col("id") % 4) > 0).cast("double").alias("b"), F.when(F.col("id") < 100, "x").otherwise("y").alias("g"))
    p = stats.paired_bootstrap(df, "a", "b", 400).first()
    assert p.difference == 0.25 and p.low < 0.25 < p.high and p.p_b_better > 0.99
    s = stats.stratified_interval(df, "g", "a", {"x": 1.0, "y": 3.0}, 400).first()
    assert s.low < 0.5 < s.high and s.high - s.low < 0.2
    assert tuple(stats.bootstrap(df.limit(0), "a", 10).first()) == (None, None, None)


def test_isotonic_curve_never_falls(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(rng.random() < x)) for x in rng.random(300)]
    df = spark.createDataFrame(rows, "s double, o double")
    model = stats.isotonic(spark, df, "s", "o")
    p = list(model.predictions)
    assert p == sorted(p) and min(p) >= 0 and max(p) <= 1


def test_one_vote_per_annotator(spark):
    rows = [("a", "r1", "1", "2024-01-01"), ("a", "R1 ", "2", "2024-01-02"), ("a", "r2", "02", None), ("a", "r3", "1", None), ("b", "r1", "1", None), ("b", "r2", "none", None)]
    df = spark.createDataFrame(rows, "t string, who string, l string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(map(tuple, majority(last_answers(df, "t", "who", "l", "at")).collect())) == [("a", "2", 2), ("b", None, 1)]


def test_candidates_against_brute_force(spark):
    foods = [("1", "egg whole raw"), ("2", "egg white"), ("3", "white bread"), ("4", None), (None, "egg"), ("5", "")]
    names = [("white egg",), ("egg",), ("zzz",), ("",), (None,), ("egg",)]
    f, n = spark.createDataFrame(foods, "fdc_id string, canonical_name string"), spark.createDataFrame(names, "t string")
    got = {(r.name, r.fdc_id): (r.from_words, r.from_head, r["rank"]) for r in candidates.generate(n, "t", f, "fdc_id", "canonical_name").collect()}
    assert got == {("white egg", "2"): (True, True, 0), ("white egg", "1"): (True, True, 2), ("white egg", "3"): (True, False, 1), ("egg", "2"): (True, True, 0), ("egg", "1"): (True, True, 1)}
    assert candidates.nearest(n, "t", f, "fdc_id", "canonical_name", k=1).where("name = 'white egg'").first().fdc_id == "2"


def test_out_of_fold_scores_tell_right_from_wrong(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i // 3}", str(i), *map(float, rng.random(6)), bool(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i string, " + ", ".join(f"{c} double" for c in scoring.FEATURES) + ", target boolean")
    df = df.withColumn("jaccard", F.when(F.col("target"), F.col("jaccard") + 1).otherwise(F.col("jaccard")))
    scored = scoring.out_of_fold(df, "target", "g")
    assert scored.count() == 300 and scored.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert scoring.winners(scored, "g", "i").agg(F.avg(F.col("right").cast("int"))).first()[0] > 0.95
    assert scoring.coefficients(df, "target")[0][0] == "jaccard"
    assert scoring.out_of_fold(df.where("not target"), "target", "g").agg(F.max("p")).first()[0] == 0.0


def test_gate_is_proved(spark):
    source, seen = [5.0], {}
    table = lambda: spark.createDataFrame([(v,) for v in source], "v double")
    tests = lambda: [quality.Expectation("range", quality.accepted_range(table(), "v", 0, 9))]
    build = lambda: seen.update(state=quality.fingerprint(table()))
    how = dict(build=build, inject=lambda: source.append(99.0), remove=lambda: source.pop(), state=lambda: seen.get("state"))
    assert quality.prove(expectations=tests, **how) == []
    assert quality.prove(expectations=lambda: [], **how) == ["a violation passes", "a refused build changed what readers see"]


def test_queries_answer_their_sql_on_small_tables(spark):
    """A few whole queries against their SQL; all of them are held against it at larger scales."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("usda_foods", "raw_usda_foods", "recipe_ingredient_lines", "recipe_ingredient_grams", "recipe_meta", "gram_reference", "ensemble", "ingredient_candidates", "distinct_ingredient_strings", "ingredient_entity_map"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("p1_found", "p1_portion", "parsed_lines", "normal_names", "grams_by_line", "guardrail_rates", "threshold_fit", "gold_sample"):
        df = queries[name](spark, SMALL)
        want = con.execute(sql[name]).df()
        got = df.toPandas()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want), name
        key = lambda r: tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in r)
        assert sorted(map(key, got[sorted(got.columns)].itertuples(index=False))) == sorted(map(key, want[sorted(want.columns)].itertuples(index=False))), name


def test_alpha_and_its_interval(spark):
    rng = np.random.default_rng(6)
    rows = [(f"i{k}", str(k % 5) if rng.random() < 0.8 else str(rng.integers(0, 5))) for k in range(200) for _ in range(3)]
    df = spark.createDataFrame(rows, "item string, label string")
    a, i = stats.krippendorff(df).first(), stats.krippendorff_interval(df).first()
    assert i.low < a.alpha < i.high and i.high - i.low < 0.25
    assert tuple(stats.krippendorff_interval(df.limit(0)).first()) == (None, None)


def test_shown_texts_and_findings(spark):
    pairs = [("leek", 0.5, "Leek, whole, raw", False, True), ("leek", 0.6, "Leekwort", False, True), ("moon dust", 0.7, "Taro, raw", False, True), ("flour", 0.5, "Rye flour, dark", True, False), ("", 0.1, "Leek, raw", False, True)]
    df = spark.createDataFrame(pairs, "n string, c double, d string, low boolean, has boolean")
    got = [round(r[0], 6) for r in df.select(answers.display_score(*[F.col(x) for x in ("n", "c", "d", "low", "has")])).collect()]
    assert got == [pytest.approx(x) for x in (1.29, 0.6, 0.7, 0.71, 0.1)]
    assert spark.range(1).select(answers.safe(F.lit("a <b> & 'c'"))).first()[0] == "a &lt;b&gt; &amp; 'c'"
    rows = spark.createDataFrame([("not_null", "t.c", "error", 3), ("unique", "t.d", "error", 9)], "trigger string, subject string, severity string, n long")
    first, second = answers.findings_of(rows)
    assert first.plain() == "unique on t.d (error): rows 9." and second.checked("not_null on t.c holds for all but 3 rows.").passed and not second.checked("4 rows").passed
