import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skillet.llm import labels, leakage, mapping, packing, queries, sampling, subjects, topn

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_top_n_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(20)}", str(rng.randrange(60)), rng.choice([None, float("nan"), 0.5, round(rng.random(), 2)]), "x") for _ in range(3000)] + [(None, "1", 0.9, "x"), ("g1", None, 0.9, "x")]
    df = spark.createDataFrame(rows, "g string, i string, s double, place string")
    got = {(r.g, r.i, r.s, r.place) for r in topn.top_n(df, "g", "i", "s").collect()}
    best = {}
    for g, i, s, _ in rows:
        if g and i and s is not None and s == s:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -9))
    want = {(g, i, s, k + 1) for g, m in best.items() for k, (i, s) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert got == want
    assert topn.top_n(df.limit(0), "g", "i", "s").count() == 0


def test_top_n_all_scores_equal(spark):
    df = spark.range(500).select(F.lit("a").alias("g"), F.col("id").cast("string").alias("i"), F.lit(1.0).alias("s"))
    assert [r.i for r in topn.top_n(df, "g", "i", "s").orderBy("place").collect()] == sorted(str(k) for k in range(500))[:5]


def test_rake_meets_both_margins():
    cells = {("a", "x"): 10, ("a", "y"): 30, ("b", "x"): 40, ("b", "y"): 20}
    w = sampling.rake(cells, [{"a": 0.7, "b": 0.3}, {"x": 0.5, "y": 0.5}])
    assert abs(sum(v for (a, _), v in w.items() if a == "a") - 0.7) < 1e-6 and abs(sum(v for (_, x), v in w.items() if x == "x") - 0.5) < 1e-6
    got = sampling.allot(w, cells, 20, 8)
    assert sum(v for (a, _), v in got.items() if a == "b") >= 8 and all(got[c] <= cells[c] for c in cells)
    assert sampling.rake({}, []) == {}


def test_allot_hands_a_cells_shortage_to_its_stratum():
    cells = {("a", "x"): 5, ("a", "y"): 200, ("b", "x"): 300, ("b", "y"): 40}
    shares = {"a": 0.5, "b": 0.5}
    weights = sampling.rake(cells, [shares, {"x": 0.5, "y": 0.5}])
    for w in (weights, {("a", "x"): 0.4, ("a", "y"): 0.1, ("b", "x"): 0.5, ("b", "y"): 0.0}):
        got = sampling.allot(w, cells, 201, 0, shares=shares)
        drawn = {k: sum(n for c, n in got.items() if c[0] == k) for k in "ab"}
        assert sum(drawn.values()) in (200, 201) and min(drawn.values()) == 100 and all(got[c] <= cells[c] for c in cells)
    # A stratum that is used up passes nothing on, and one without strings leaves the others their shares.
    got = sampling.allot(weights, cells, 600, 0, shares=shares)
    assert got[("a", "x")] + got[("a", "y")] == 205 and got[("b", "x")] + got[("b", "y")] == 300
    only = {("a", "x"): 50, ("a", "y"): 50}
    assert sum(sampling.allot(sampling.rake(only, [shares, {"x": 0.5, "y": 0.5}]), only, 40, 0, shares=shares).values()) == 20


def test_draw_and_gaps(spark):
    strings = spark.createDataFrame([(f"s{k}", 1, [" Head", "mid", "TAIL ", None][k % 4] if k else None) for k in range(400)] + [("s1", 1, "mid"), (None, 1, "mid")], "normalized_text string, occurrence_count long, frequency_stratum string")
    schema = "manifest_id string, seed long, total long, per_stratum struct<head double, mid double, tail double>, min_per_stratum long"
    manifest = spark.createDataFrame([("m1", 7, 60, (1.0, 1.0, 1.0), 5), ("m2", 8, 400, (None, 50.0, 50.0), 0), ("m3", 9, 10, (None, None, None), None), (None, 1, 9, (1.0, 1.0, 1.0), 1)], schema)
    assert {(r.manifest_id, r.stratum) for r in sampling.gaps(strings, manifest).collect()} == {("m2", "mid"), ("m2", "tail")}
    items = sampling.strata_of(strings, ("head", "mid", "tail"))
    rows = sampling.manifest_rows(manifest, ("head", "mid", "tail"))
    sample, rest = sampling.draw(items, "item", [F.col("stratum")], rows)
    n = {(r.manifest_id, r._m0): r["count"] for r in sample.groupBy("manifest_id", "_m0").count().collect()}
    assert n[("m1", "head")] == n[("m1", "mid")] == n[("m1", "tail")] == 20 and ("m2", "head") not in n
    assert sample.count() == sample.distinct().count() and any(r["drawn"] < r["asked"] for r in rest if r["manifest_id"] == "m2")
    again, _ = sampling.draw(items, "item", [F.col("stratum")], rows)
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, again.collect()))
    # A guess that fails, too low or too high, changes nothing: the cell is ranked whole.
    for slack in (-9.0, 0.0, 0.5, 60.0):
        other, _ = sampling.draw(items, "item", [F.col("stratum")], rows, slack=slack)
        assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, other.collect()))
    assert sampling.draw(items.limit(0), "item", [F.col("stratum")], rows)[0].count() == 0


def test_draw_over_two_margins_is_fair(spark):
    items = spark.range(4000).select(F.col("id").alias("item"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("x"), F.when(F.col("id") % 3 == 0, "c").otherwise("d").alias("y"), F.lit("m").alias("manifest_id"))
    wishes = [{"id": f"m{k}", "seed": k, "total": 400, "minimum": 10, "targets": [{"a": 0.5, "b": 0.5}, {"c": 0.7, "d": 0.3}]} for k in range(20)]
    sample, rest = sampling.draw(items, "item", [F.col("x"), F.col("y")], wishes)
    got = sample.toPandas()
    assert got.groupby("manifest_id").item.nunique().eq(400).all() and all(abs(r["asked"] - r["drawn"]) <= 2 for r in rest)
    # Items of one cell are drawn alike often: 20 draws of some 30 % of the 333 items of the smallest cell.
    often = got[(got._m0 == "a") & (got._m1 == "c")].groupby("item").size().reindex([str(k) for k in range(0, 4000, 12)], fill_value=0)
    assert abs(often.mean() - 20 * 140 / 334) < 0.5 and often.std() < 2.6

def test_p4_found_comes_from_the_draw(spark, tmp_path, monkeypatch):
    rows = [(" ".join(["w"] * (1 + k % 6)) + f"x{k}", 1, ["head", " Mid", "tail", None][k % 4]) for k in range(200)]
    spark.createDataFrame(rows, "normalized_text string, occurrence_count long, frequency_stratum string").write.parquet(f"{tmp_path}/distinct_ingredient_strings.parquet")
    schema = "manifest_id string, seed long, total long, per_stratum struct<head double, mid double, tail double>, min_per_stratum long"
    wishes = [("m1", 7, 61, (1.0, 1.0, 1.0), 5), ("m2", 8, 140, (None, 50.0, 20.0), 0), ("m3", 9, 10, (None, None, None), 51), ("m4", 9, 101, (1.0, 1.0, 0.0), None)]
    spark.createDataFrame(wishes, schema).write.parquet(f"{tmp_path}/manifest.parquet")
    found = lambda: {tuple(r) for r in queries.p4_found(spark, str(tmp_path)).collect()}
    want = {("m2", "mid"), ("m3", "head"), ("m3", "mid"), ("m3", "tail"), ("m4", "head"), ("m4", "mid")}
    assert found() == want
    draw = sampling.draw
    monkeypatch.setattr(sampling, "draw", lambda *a: (draw(*a)[0], [r for r in draw(*a)[1] if r["manifest_id"] != "m2"]))
    assert found() == {w for w in want if w[0] != "m2"}


def test_consensus_recovers_planted_labels(spark):
    rng = np.random.default_rng(5)
    skill = {f"r{k}": p for k, p in enumerate([0.95, 0.9, 0.85, 0.8, 0.3, 0.3])}
    truth = {f"i{k}": str(rng.integers(1, 9)) for k in range(300)}
    rows = []
    for i, t in truth.items():
        wrong = str(rng.integers(10, 15))
        for r, p in skill.items():
            if rng.random() < 0.8:
                a = t if rng.random() < p else str(rng.integers(10, 15))
                rows.append((i, r, wrong if r in ("r4", "r5") and a != t else a))
    df = spark.createDataFrame(rows, "item string, annotator string, label string")
    items, people = labels.consensus(df)
    got = items.toPandas()
    assert (got.label == got.item.map(truth)).mean() > 0.95
    rel = people.toPandas().set_index("annotator").reliability
    assert rel["r0"] > rel["r3"] > rel["r4"]
    empty_items, empty_people = labels.consensus(df.limit(0))
    assert empty_items.count() == 0 and empty_people.count() == 0


def test_pairs_of_annotators_against_brute_force():
    rng = np.random.default_rng(2)
    rows = sorted({(int(i), int(w)): int(rng.integers(0, 3)) for i, w in rng.integers(0, 12, (200, 2))}.items())
    item, who, vote = np.array([r[0][0] for r in rows]), np.array([r[0][1] for r in rows]), np.array([r[1] for r in rows])
    want = {}
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            if item[x] == item[y]:
                c = want.setdefault((min(who[x], who[y]), max(who[x], who[y])), [0, 0])
                c[0] += 1
                c[1] += vote[x] == vote[y]
    for chunk in (1, 50, 10**6):
        i, j, both, same = labels._summed([labels._together(item, who, vote, chunk)])
        assert {(a, b): [c, d] for a, b, c, d in zip(i, j, both, same)} == want


def test_items_with_few_answers_take_part(spark):
    rows = [(f"i{k}", r, "7" if r != "r3" else "8") for k in range(30) for r in ("r1", "r2", "r3", "r4")] + [("two", "r1", "9"), ("two", "r3", "5"), ("one", "r5", "4")]
    df = spark.createDataFrame(rows, "item string, annotator string, label string")
    items, people = labels.consensus(df)
    assert {r.item for r in items.collect()} == {f"i{k}" for k in range(30)}
    assert {r.annotator: r.n_answers for r in people.collect()} == {"r1": 31, "r2": 30, "r3": 31, "r4": 30, "r5": 1}
    assert {r.item: r.label for r in labels.consensus(df, least=1, broadcast_limit=0)[0].collect()}["two"] == "9"


def test_last_answers_and_agreement(spark):
    rows = [("a", "R1", "007", "2024-01-02"), ("a", "r1 ", "8", "2024-01-01"), ("a", "r2", " 7", "2024-01-01"), ("a", "r3", "None ", None), ("b", "r1", "5", "2024-01-01"), ("b", "r1", "", "2024-02-01"), (None, "r1", "5", None), ("c", None, "5", None)]
    df = spark.createDataFrame(rows, "t string, who string, l string, at string").withColumn("at", F.col("at").cast("timestamp"))
    a = labels.last_answers(df, "t", "who", "l", "at")
    assert sorted(map(tuple, a.collect())) == [("a", "r1", "7"), ("a", "r2", "7"), ("a", "r3", "none")]
    assert labels.krippendorff(a.where("label = '7'")).first().alpha == 1.0
    assert labels.krippendorff(a.limit(0)).first().alpha is None


@pytest.mark.parametrize("name, want", [("store bought whipped vanilla curd", "1"), ("curd vanila whippd", "1"), ("whppd vanilla curds for garnish", "1"), ("vanilla-curd (whipped)", "1"), ("vanillacurd whipped", "1"), ("curd", None), ("", None), ("osthullum toothpicks", None), ("würzige vanilla cúrd whipped", "1"), ("smoked ham", "3"), ("vanilla curd curd", "2"), ("curd vanilla vanila curd whipped vanilla curd whipped", "1"), ("bbq ham", "4"), ("barbecued ham smoked", None), ("osthullum", None)])
def test_names(spark, name, want):
    foods = spark.createDataFrame([("1", "curd whipped vanilla"), ("2", "curd vanilla"), ("3", "ham smoked"), ("4", "ham barbecued"), (None, "x"), ("5", None)], "fdc_id string, canonical_name string")
    names = spark.createDataFrame([(name,), (name,), (None,)], "normalized_text string")
    got = mapping.map_names(names, "normalized_text", foods, "fdc_id", "canonical_name").collect()
    assert [(r.normalized_text, r.fdc_id) for r in got] == [(name, want)]


def test_soft_tf_idf_ranks_the_readings(spark):
    """A token that may be either of two words is read as the entry asks; of complete entries the one of higher score is taken."""
    foods = spark.createDataFrame([("1", "bread corn"), ("2", "bread horn"), ("3", "horn"), ("4", "meal torn corn")], "fdc_id string, canonical_name string")
    names = spark.createDataFrame([("bread corn",), ("bred corn",), ("xorn bread",), ("meal xorn corn",), ("bread",)], "normalized_text string")
    got = {r.normalized_text: (r.fdc_id, r.score) for r in mapping.map_names(names, "normalized_text", foods, "fdc_id", "canonical_name").collect()}
    assert got["bread corn"] == ("1", pytest.approx(1.0)) and got["bred corn"][0] == "1" and 0.8 < got["bred corn"][1] < 1
    assert got["xorn bread"][0] in ("1", "2") and got["meal xorn corn"][0] == "4" and got["bread"] == (None, None)
    assert mapping.map_names(names.limit(0), "normalized_text", foods, "fdc_id", "canonical_name").count() == 0
    assert mapping.map_names(names, "normalized_text", foods.limit(0), "fdc_id", "canonical_name").where("fdc_id is null").count() == 5


def test_words_of_their_own_hold_at_any_size(spark):
    """A remark that looks like a word of the list is told by how many names hold it against how many hold the word."""
    foods = spark.createDataFrame([("1", "curd stone"), ("2", "curd")], "fdc_id string, canonical_name string")
    for times in (1, 7):
        rows = [(f"store curd brand{'abcdefghijklmnop'[k % 16]}{'qrstuvwxyz'[k // 16]}",) for k in range(20 * times)] + [("stone curd",), ("stonne curd",), ("stroe curd",)]
        names = spark.createDataFrame(rows, "normalized_text string")
        got = {r.normalized_text: r.fdc_id for r in mapping.map_names(names, "normalized_text", foods, "fdc_id", "canonical_name").collect()}
        assert all(got[r[0]] == "2" for r in rows[: 20 * times]) and got["stone curd"] == got["stonne curd"] == "1" and got["stroe curd"] == "2"


def test_deletions_and_sound(spark):
    got = spark.range(1).select(mapping.deletions(F.lit("abc"), 2).alias("d")).first().d
    assert set(got) == {"abc", "bc", "ac", "ab", "a", "b", "c"}


def _best_fit(sizes, capacity):
    """Bins of the fullest-that-fits rule, which SS is held against."""
    room = []
    for s in sizes:
        fits = [k for k, r in enumerate(room) if r >= s]
        if fits:
            k = min(fits, key=lambda k: room[k])
            room[k] -= s
        else:
            room.append(capacity - s)
    return len(room)


@pytest.mark.parametrize("most, unused", [(100, 1.0), (30, 0.01)])
def test_place_fills_and_never_overflows(most, unused):
    sizes = np.random.default_rng(1).integers(0, most + 1, 2000)
    where, fills = packing.place(sizes, 100)
    by = np.bincount(where, sizes)
    assert (by == fills).all() and by.max() <= 100
    assert len(by) <= 1.03 * _best_fit(sizes, 100) and 1 - sizes.sum() / (len(by) * 100) < unused


def test_pack_whole_documents(spark):
    texts = ["word " * n for n in (0, 1, 5, 40, 130, 17, 3)] + [None, "ends" * 9]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "a", "x")], "doc_id long, text string, container string")
    count = packing.counter(TOKENIZER)
    got = packing.pack(docs, TOKENIZER, 32, per_shard=3).toPandas()
    assert set(got.doc_id) == set(range(len(texts)))
    total = got.groupby("doc_id").n_tokens.sum()
    assert [total[k] for k in range(len(texts))] == count([t or "" for t in texts])
    assert got.groupby("container").n_tokens.sum().max() <= 32
    pieces = got.groupby("doc_id").piece.count()
    assert all(pieces[k] == 1 for k in range(len(texts)) if total[k] <= 32)
    assert packing.fill_report(packing.pack(docs.limit(0), TOKENIZER, 32), 32).first().n_containers == 0


def _words(t):
    t = unicodedata.normalize("NFKD", t.lower())
    t = re.sub(r"</?(?:b|i|em|span)>", "", t)
    t = re.sub(r"<[^<>]+>", " ", t)
    t = "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf"))
    return re.findall(r"[a-z0-9]+", t)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}x" for k in range(40)]
    items = {k: " ".join(rng.choice(vocab) for _ in range(rng.choice([6, 12, 30]))) for k in range(25)}
    docs = {}
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            t = items[rng.randrange(25)].split()
            a = rng.randrange(0, max(1, len(t) - 8))
            t = t[a : a + rng.randrange(8, 20)]
            if d % 5 == 0 and t:
                t[len(t) // 2] = "changed"
            w[len(w) // 2 : len(w) // 2] = t
        docs[d] = " ".join(f"<b>{x.upper()}</b>" if rng.random() < 0.1 else x.replace("w", "w­") if rng.random() < 0.1 else x + rng.choice(["", "", ",", "!\n"]) for x in w)
    docs[500], docs[501] = "", None
    docs[502], docs[503] = "word " * 30_000 + items[next(k for k, x in items.items() if len(x.split()) == 30)], "<b></b> . \u00ad"
    grams = {}
    for i, t in items.items():
        w = _words(t)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = set()
    for d, t in docs.items():
        w = _words(t or "")
        for k in range(len(w) - 9):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 10]), ())}
    dd = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item_id", F.lit(0))
    ii = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked(dd, ii).collect()} == want and want
    assert leakage.leaked(dd, ii.limit(0)).count() == 0 and leakage.leaked(dd.limit(0), ii).count() == 0
    assert leakage.leaked(dd.where("doc_id in (500, 501, 503)"), ii).count() == 0
    slack = {(r.doc_id, r.item_id) for r in leakage.overlaps(dd, ii).collect()}
    assert want <= slack and len(slack) > len(want)


def _tolerant(a, b):
    """Longest run in which no two words in a row differ, over all alignments, word by word."""
    best = 0
    for shift in range(1 - len(a), len(b)):
        run, miss = 0, True
        for i, w in enumerate(a):
            same = 0 <= i + shift < len(b) and b[i + shift] == w
            run = run + 1 if same or not miss else 0
            miss = not same
            best = max(best, run)
    return best


def test_overlaps_without_broadcast_and_with_a_hot_passage(spark):
    rng = random.Random(2)
    hot = " ".join(f"h{k}" for k in range(12))
    items = [(1, hot), (2, " ".join(f"b{k}" for k in range(15))), (3, hot + " " + " ".join(f"c{k}" for k in range(9))), (None, hot), (4, None)]
    docs = [(d, (hot if d % 3 == 0 else "") + " " + " ".join(f"r{rng.randrange(99)}" for _ in range(20))) for d in range(300)] + [(900, "x " + items[1][1]), (901, ""), (None, hot)]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in docs if d is not None for i, x in items[:3] if " ".join(x.split()[:12]) in t}
    for limit in (3_000_000, 0):
        got = {(r.doc_id, r.item_id) for r in leakage.overlaps(dd, ii, broadcast_limit=limit).where("longest >= 10").collect()}
        assert got == want and len(want) == 201


def test_masks_meet_every_window_without_two_misses_in_a_row():
    for m in range(2**9):
        w = "1" + format(m, "09b")
        assert "00" in w or any(all(x <= y for x, y in zip(mask, w)) for mask in leakage.MASKS), w


def test_overlaps_against_brute_force(spark):
    rng = random.Random(8)
    items = {k: [f"i{k}w{j}" for j in range(n)] for k, n in enumerate([120, 120, 10, 10, 14, 30])}
    docs = {}
    for i, w in items.items():
        for step in range(2, 12):
            docs[len(docs)] = [x if (j + 1) % step else f"r{j}" for j, x in enumerate(w)]
        for at in range(len(w) if len(w) == 10 else 0):
            docs[len(docs)] = ["before"] + [x if j != at else "other" for j, x in enumerate(w)] + ["after"]
        for _ in range(25):
            docs[len(docs)] = [x if rng.random() < 0.7 else "other" for x in w]
    # The alignment with the longest equal run is too short, the other is not.
    items[9] = "a b c d e f g h x1 x2 x3 k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11".split()
    docs[len(docs)] = "a b c d e f g h y1 y2 y3 y4 y5 y6 k1 k2 z k4 k5 z k7 k8 z k10 k11".split()
    dd = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    ii = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = {(d, i, n) for d, x in docs.items() for i, w in items.items() if (n := _tolerant(w, x)) >= 10}
    got = {(r.doc_id, r.item_id, r.tolerant) for r in leakage.overlaps(dd, ii).collect()}
    assert {x[:2] for x in got} == {x[:2] for x in want} and all(t <= n for d, i, n in want for e, j, t in got if (d, i) == (e, j))
    assert len(want) > 60


def _made_of(sentences, runs):
    words, sizes, _ = subjects.tokens(["\n".join(sentences)], subjects.Codes())
    return list(runs.made_of(words, sizes))


def test_made_of_counts_every_word_of_a_run():
    runs = subjects.Runs(["a b c d e f g h i j k"])
    # The last two sentences hold a run only together.
    got = _made_of(["a b c d e f g h i j k and four more words", "a b c d e f g and eight more words than these few here", "a b c d e", "", "x a b c", "d e f"], runs)
    assert got == [True, False, False, False, False]
    assert _made_of(["a b c"], subjects.Runs([])) == [False] and _made_of([], runs) == []
    words, sizes, doc = subjects.tokens(["One two. three", "", "?! 3.5 kg\n\nx"], subjects.Codes())
    assert len(words) == 7 and list(sizes) == [2, 1, 3, 1] and list(doc) == [0, 0, 2, 2] and list(words % 2) == [1, 1, 1, 0, 0, 0, 0]


def test_subjects_find_the_language_and_hash_rare_words(spark):
    rng = random.Random(9)
    own = {("law", "en"): "permit court statute appeal".split(), ("farm", "en"): "soil harvest tractor manure".split(), ("law", "es"): "tribunal licencia ordenanza multa".split(), ("farm", "es"): "campo cosecha semilla riego".split()}
    docs, labs, truth = [], [], {}
    for d in range(400):
        s, g = list(own)[d % 4]
        said = {"en": "the {} and the {} were told.", "es": "sin {} no hay {} aqui."}[g]
        docs.append((d, " ".join(said.format(*rng.sample(own[s, g], 2)) for _ in range(4)) + f" rare{'abcdefghij'[d % 10]}{'klmnopqrst'[d // 10 % 10]}{'uvwxyz'[d % 6]}", g if d % 5 else [None, "und", "xx"][d % 3], 1))
        truth[d] = s
        if d < 80 and d % 5:
            labs.append((d, s, "x"))
    dd = spark.createDataFrame(docs, "doc_id long, text string, lang string, subject int")
    ll = spark.createDataFrame(labs, "doc_id long, subject string, text string")
    aa = spark.createDataFrame([("law", "permits and courts"), ("farm", None), (None, "x")], "subject string, description string")
    ev = spark.createDataFrame([(1, None)], "item_id long, text string")
    for share in (0.0005, 0.2):
        by = {r.doc_id: r.subject for r in subjects.subjects(dd, ll, aa, ev, least_share=share, buckets=64).collect()}
        assert np.mean([by.get(d) == s for d, s in truth.items()]) > (0.97 if share < 0.1 else 0.8)
    # Without labels the descriptions alone anchor the components; without subjects nothing comes out.
    assert {r.subject for r in subjects.subjects(dd, ll.limit(0), aa, ev).collect()} <= {"law", "farm"}
    assert subjects.subjects(dd, ll, aa.limit(0), ev).count() == 0


def test_subjects_on_planted_topics(spark):
    rng = random.Random(6)
    # Words of a subject stand in fewer documents than frame_share; those of the frames in more.
    own = {
        "law": "permit court statute appeal inspector tribunal clause verdict ordinance licence penalty decree".split(),
        "farm": "soil harvest tractor manure seed silo orchard pasture drought barn plough herd".split(),
        "code": "parser cache commit build schema query thread socket compiler kernel buffer branch".split(),
        "sport": "coach league sprint marathon podium referee stadium relay hurdle goalkeeper medal race".split(),
    }
    frame = ["the {} came before the {}.", "nobody knew that the {} is a {}.", "a {} and the {} again."]
    docs, labs, truth = [], [], {}
    for d in range(240):
        s = list(own)[d % 4]
        out = [rng.choice(frame).format(*rng.sample(own[s], 2)) for _ in range(6)] + ["more on this below."]
        docs.append((d, " ".join(out).capitalize(), "en"))
        truth[d] = s
        if d < 40:
            labs.append((d, s))
    docs += [(900, "", "en"), (901, None, None)]
    dd = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    ll = spark.createDataFrame(labs + [(1, "unknown"), (None, "law")], "doc_id long, subject string")
    aa = spark.createDataFrame([("law", "permits and courts"), ("farm", None), ("code", ""), ("sport", "training")], "subject string, description string")
    ev = spark.createDataFrame([(1, "something held out of here entirely")], "item_id long, text string")
    got = subjects.subjects(dd, ll, aa, ev)
    by = {r.doc_id: r.subject for r in got.collect()}
    assert np.mean([by.get(d) == s for d, s in truth.items()]) > 0.97 and 900 not in by and 901 not in by
    shares = {r.subject: r.share for r in subjects.corpus_shares(got).collect()}
    assert abs(shares["law"] - 0.25) < 0.05
    assert subjects.subjects(dd.limit(0), ll, aa, ev).count() == 0
