import json
import shutil

import pytest

from skillet.sources import ingest, readers, rest
from skillet.streaming.windows import windowed


def test_csv_lines_cache_and_publish(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(',title,ingredients,link\n0,Pie,"[""1 c. flour"", "" "", ""2 eggs""]",http://x\n1,None,not json,\n2,Tart,"[\'1 c. \"fine\" sugar\', 3, \'\']",\n'.replace('"fine"', '""fine""'))
    raw = readers.recipe_rows(spark, str(p))
    assert [tuple(r) for r in readers.ingredient_lines(raw).collect()] == [("recipes:0", 0, "1 c. flour"), ("recipes:0", 2, "2 eggs"), ("recipes:2", 0, '1 c. "fine" sugar')]
    j = tmp_path / "c.jsonl"
    j.write_text('{"k": "a", "at": 1, "v": "x"}\n{"k": "a", "at": 2, "v": "y"}\n{"k": "b", "at": 1\n')
    assert [tuple(r) for r in readers.last_records(spark, str(j), "k string, at long, v string", ["k"], "at").collect()] == [("a", 2, "y")]
    root = str(tmp_path / "gold")
    with pytest.raises(FileNotFoundError):
        readers.published(spark, root, "t")
    readers.publish(spark, {"t": raw}, root, "r1", "rev")
    with pytest.raises(ValueError):
        readers.publish(spark, {"t": raw.limit(0)}, root, "r2")
    assert readers.published(spark, root, "t").count() == 3
    readers.export(spark, root, ["t"], str(tmp_path / "out"))
    assert [tuple(r)[:1] for r in readers.catalog(spark, str(tmp_path / "out")).collect()] == [("t",)]
    with readers.lock(spark, f"{root}/.lock"):
        with pytest.raises(TimeoutError), readers.lock(spark, f"{root}/.lock", wait=0.1):
            pass
    readers.append_records(spark.createDataFrame([("a", 3, "z")], "k string, at long, v string"), str(tmp_path / "log"))
    readers.append_records(spark.createDataFrame([("a", 4, "w")], "k string, at long, v string"), str(tmp_path / "log"))
    assert [tuple(r) for r in readers.last_records(spark, str(tmp_path / "log"), "k string, at long, v string", ["k"], "at").collect()] == [("a", 4, "w")]
    shutil.rmtree(root)


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:50:00", "a", 2.0), ("2024-01-01 11:05:00", "b", 3.0)], "ts string, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed(s).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed(rows).collect()))


def test_paged_and_batched_sources(spark, monkeypatch):
    store = [{"id": k} for k in range(45)]
    calls = []

    def get(n):
        calls.append(n)
        if len(calls) == 2:
            raise ConnectionError("once")
        return store[(n - 1) * 20 : n * 20]

    waits = []
    assert list(rest.pages(get, 20, sleep=waits.append)) == store and calls == [1, 2, 2, 3] and waits == [1.0]
    with pytest.raises(rest.Refused):
        rest.tried(lambda: (_ for _ in ()).throw(rest.Refused("key")), sleep=waits.append)
    with pytest.raises(OSError):
        rest.tried(lambda: (_ for _ in ()).throw(OSError("down")), tries=3, sleep=waits.append)
    assert waits == [1.0, 1.0, 2.0]
    monkeypatch.delenv("FOOD_API_KEY", raising=False)
    with pytest.raises(rest.Refused):
        rest.api_key()
    spark.dataSource.register(rest.paged_source("foods_paged", lambda n: [{"id": k} for k in range(45)][(n - 1) * 20 : n * 20], 45, 20))
    assert sorted(json.loads(r[0])["id"] for r in spark.read.format("foods_paged").load().collect()) == list(range(45))
    ids = spark.createDataFrame([("1",), ("2",), ("2",), (None,), ("9",)], "fdc string")
    cached = spark.createDataFrame([("1", "{}")], "id string, raw_payload string")
    got = rest.fetched(spark, ids, lambda part: {i: {"n": i} for i in part if i != "9"}, cached, batch=1)
    assert {(r.id, r.raw_payload) for r in got.collect()} == {("1", "{}"), ("2", '{"n": "2"}'), ("9", None)}


def test_raw_tables_from_web_answers(spark, tmp_path):
    foods = [
        {"fdcId": 7, "dataType": "SR", "description": "Egg", "foodCategory": {"description": " Dairy "}}, {"fdcId": "008", "foodCategory": "Nuts"}, {"fdcId": 9, "foodCategory": " ", "brandedFoodCategory": "Snacks"},
        {"fdcId": 10}, {"fdcId": 11, "foodCategory": {"id": 1}, "brandedFoodCategory": "Snacks"}, {"description": "no id", "foodCategory": None},
    ]
    raw = spark.createDataFrame([(json.dumps(f),) for f in foods] + [(None,)], "raw_payload string")
    assert [tuple(r) for r in ingest.category_rows(raw, "web").select("fdc_id", "food_category").collect()] == [("7", "Dairy"), ("008", "Nuts"), ("9", "Snacks"), ("10", ""), ("11", ""), ("", "")]
    rows = ingest.food_rows(raw, "web")
    assert [tuple(r) for r in rows.select("fdc_id", "data_type", "description").limit(2).collect()] == [("7", "SR", "Egg"), ("008", "", "")]
    assert sorted(r[0] for r in ingest.food_ids(rows).collect()) == ["10", "11", "7", "8", "9"]
    got = spark.createDataFrame([("7", '{"foodPortions": [{"id": 1}]}'), ("8", "{}"), ("9", None)], "id string, raw_payload string")
    assert [tuple(r) for r in ingest.portion_rows(got, "web").select("fdc_id", "raw_payload").collect()] == [("7", '[{"id":1}]'), ("8", "[]"), ("9", "[]")]
    path = str(tmp_path / "raw")
    assert ingest.ingest(rows, path, 5) == 6 and spark.read.parquet(path).count() == 6
    with pytest.raises(ValueError):
        ingest.ingest(rows.limit(2), path, 5)
    assert spark.read.parquet(path).count() == 6
    csv = tmp_path / "r.csv"
    csv.write_text(",title,ingredients,link\n0,Pie,[],\n")
    assert ingest.raw_recipes(spark, str(csv), str(tmp_path / "recipes")) == 1
