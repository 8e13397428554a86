"""Sources and sinks over small files."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.sources import batches, fetch, files
from tagmill.streaming.totals import running_totals, windowed_counts


def test_json_lines_keep_the_last_row_of_a_key(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "a", "prompt_version": "1"}\n\n{"id": "a", "prompt_version": "2"}\n{"id": "b", "prompt_version": "1"}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "p.jsonl"), files.PREDICTION, "id")
    assert {r.id: r.prompt_version for r in rows.collect()} == {"a": "2", "b": "1"}
    assert files.read_cache(spark, str(tmp_path / "p.jsonl"), "2").count() == 1


def test_tags_and_settings(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,primary,secondary,fit,confidence,rationale\nq1, A ,"B; C;;",direct,high,"says ""so"",\nyes"\nq2,A,,direct,high,x\n')
    got = {r.id: (r.primary, r.secondary) for r in files.read_tags(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {"q1": ("A", ["B", "C"]), "q2": ("A", [])}
    (tmp_path / "h.toml").write_text('[units]\n"S:A" = { hours = 4 }\n"S:B" = { hours = 6.5, prereqs = ["S:A"] }\n')
    assert {r.unit_id: (r.hours, r.prereqs) for r in files.read_settings(spark, str(tmp_path / "h.toml")).collect()} == {"S:A": (4.0, []), "S:B": (6.5, ["S:A"])}


def test_profile_is_checked(tmp_path):
    path = tmp_path / "me.toml"
    path.write_text("exam_date = 2027-02-06\nstart_date = 2026-10-01\nhours_per_day = 3\n")
    assert files.read_profile(str(path))["final_weeks"] == 4
    path.write_text("exam_date = 2026-02-06\nstart_date = 2026-10-01\nhours_per_day = 3\n")
    with pytest.raises(ValueError, match="after"):
        files.read_profile(str(path))


def test_taxonomy(spark, tmp_path):
    doc = {"papers": {"DA": {"title": "t", "sections": [{"id": "DA.PS", "number": 1, "title": "P", "official_text": "", "items": [{"id": "DA.PS.01", "label": "l", "cluster": "c", "official_text": "o"}]}]}}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    row = files.read_taxonomy(spark, str(tmp_path / "s.json")).first()
    assert (row.part, row.item_id, row.unit_id, row.note) == ("DA", "DA.PS.01", "DA.PS:c", "")


def test_vectors_and_documents(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.eye(3, dtype="float32"))
    rows = files.read_npy(spark, str(tmp_path / "v.npy")).orderBy("row").collect()
    assert [r.vector for r in rows] == np.eye(3).tolist()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    row = files.read_documents(spark, str(tmp_path / "a.pdf")).first()
    assert row.valid and row.bytes == 8


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([(2, ["x", "y"], 0.5), (1, [], None)], "id INT, tags ARRAY<STRING>, v DOUBLE")
    files.write_csv(f, str(tmp_path / "c"))
    assert {r.id: r.tags for r in spark.read.csv(str(tmp_path / "c"), header=True, schema="id INT, tags STRING, v DOUBLE").collect()}[2] == "x;y"
    files.write_jsonl(f, str(tmp_path / "j"), "id")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert json.loads(files.document(rows=f))["rows"][0]["tags"] == ["x", "y"]
    assert files.markdown_table(f, ["id", "v"]).splitlines()[2] == "| 2 | 0.5 |"


def test_totals_take_only_what_is_new(spark, tmp_path):
    schema = "k STRING, v INT"
    spark.createDataFrame([("a", 1), ("a", 2)], schema).write.parquet(str(tmp_path / "in"))
    read = lambda: running_totals(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], {"s": F.col("v")}, str(tmp_path / "work"))
    assert [tuple(r) for r in read().collect()] == [("a", 2, 3)]
    spark.createDataFrame([("a", 4), ("b", 5)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in read().collect()) == [("a", 3, 7), ("b", 1, 5)]


def test_windows(spark):
    f = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS t, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'a'")
    assert sorted(r.n for r in windowed_counts(f, "t", "k").collect()) == [1, 2]


def test_download_tries_again():
    waits, answers = [], [OSError("down"), OSError("down"), b"body"]

    def get(url):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert fetch.download("u", get, waits.append) == b"body" and waits == [2.0, 4.0]
    answers += [OSError("a"), OSError("b"), OSError("last")]
    with pytest.raises(OSError, match="last"):
        fetch.download("u", get, waits.append)


def test_mirrors(tmp_path):
    web = {"a": b"%PDF one", "b": b"%PDF one", "c": b"<html>", "d": b"%PDF two"}

    def get(url):
        if url not in web:
            raise OSError("not there")
        return web[url]

    made = fetch.fetch_all({"x.pdf": ["e", "c", "a", "b"]}, str(tmp_path / "raw"), get)
    assert (tmp_path / "raw" / "x.pdf").read_bytes() == b"%PDF one" and [m["ok"] for m in made[0]["mirrors"]] == [False, False, True, True]
    for urls in (["a", "d"], ["c", "e"], []):
        with pytest.raises(ValueError):
            fetch.agreed(urls, get)


def test_folder_and_store(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x").write_text("1")
    (tmp_path / "to").mkdir()
    (tmp_path / "to" / "old").write_text("1")
    assert fetch.replace_folder(str(tmp_path / "a"), str(tmp_path / "to")) == 1 and not (tmp_path / "to" / "old").exists()
    store = fetch.Store(str(tmp_path / "s" / "store.json"))
    assert store.get("k") is None and store.put("k", [1]) and store.get("k") == [1] and not store.put("k", object())
    (tmp_path / "s" / "store.json").write_text("{broken")
    assert store.get("k", 5) == 5 and not fetch.Store(str(tmp_path)).put("k", 1)


def test_npy_and_plan(spark, tmp_path):
    rows = spark.createDataFrame([(2, [0.5, 1.0]), (1, [2.0, 3.0])], "id INT, vector ARRAY<DOUBLE>")
    assert files.write_npy(rows, str(tmp_path / "v.npy")) == 2
    assert [list(r.vector) for r in files.read_npy(spark, f"file://{tmp_path}/v.npy").orderBy("row").collect()] == [[2.0, 3.0], [0.5, 1.0]]
    plan = spark.createDataFrame([(0, "learn", "u", 2.5, None), (0, "finish", "u", 0.0, "q1,q2"), (1, "mock", "m", 5.0, None)], "week INT, kind STRING, unit_id STRING, plan_hours DOUBLE, practice STRING")
    calendar = spark.createDataFrame([(0, "2001-01-01", "2001-01-07", "learn", 3.0), (1, "2001-01-08", "2001-01-10", "final", 6.0)], "week INT, week_start STRING, week_end STRING, phase STRING, capacity DOUBLE")
    md, js = files.write_plan(plan, calendar, str(tmp_path / "plan"), {"u": "Unit"})
    text = open(md).read()
    assert "Week 1: 2001-01-01 to 2001-01-07 (learn, 2.5 of 3 h)" in text and "- Learn: Unit 2.5 h" in text and "practise with: Unit q1,q2" in text
    assert [w["blocks"][0]["kind"] for w in json.load(open(js))] == ["finish", "mock"]
    assert files.report("T", {"S": ("What.", plan.select("week"))}).startswith("# T\n\n## S\n\nWhat.\n\n| week |")


def test_tagging_in_batches(tmp_path):
    questions = [{"id": f"q{i:02}", "part": "AB"[i % 2], "text": "?"} for i in range(24)]
    items = {"A": ["a1", "a2"], "B": ["b1"]}
    calls, waits = [], []

    def ask(prompt, schema):
        ids = schema["properties"]["tags"]["items"]["properties"]["id"]["enum"]
        calls.append(ids)
        if len(calls) == 1:
            raise OSError("busy")
        rows = [{"id": i, "primary": "a1" if prompt.startswith("PA") else "b1", "secondary": ["a2", "a2", "a1", "zz"]} for i in ids if i != "q02" or len(calls) > 2]
        return json.dumps({"tags": [*rows, {"id": "foreign", "primary": "a1"}, *rows]}), 100

    clock = [0.0]
    pace = batches.Pace(250, lambda: clock[0], lambda s: (waits.append(s), clock.__setitem__(0, clock[0] + s))[0])
    cache = str(tmp_path / "cache.jsonl")
    assert batches.tag(questions, {"A": "PA", "B": "PB"}, items, ask, cache, "1", pace=pace, sleep=waits.append) == []
    assert [len(c) for c in calls] == [10, 10, 1, 2, 10, 2] and calls[2] == ["q02"] and waits[0] == 2.0 and 60.0 in waits
    rows = batches.cached(cache, "1")
    assert len(rows) == 24 and rows["q00"]["secondary"] == ["a2"] and rows["q01"]["secondary"] == []
    assert batches.tag(questions, {}, items, ask, cache, "1") == [] and len(calls) == 6
    assert batches.tag(questions, {"A": "PA", "B": "PB"}, items, lambda p, s: ("not json", 1), cache, "2", limit=3) == ["q00", "q02", "q04"]
