import json

import pytest

from factloom.sources import files
from factloom.streaming.arrivals import arrivals


def test_jsonl_round_trip_and_missing(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "aliases": ["x"]}\n\n{"id": "2"}\n', encoding="utf-8")
    df = files.read_jsonl(spark, str(p), files.FACT)
    assert [r["id"] for r in df.orderBy("id").collect()] == ["1", "2"]
    assert files.read_jsonl(spark, str(tmp_path / "none"), files.FACT, missing_ok=True).count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "none"), files.FACT).count()
    files.write_jsonl(df, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), files.FACT).count() == 2
    assert files.read_jsonl(spark, str(p), files.FACT, most=1, order="id").count() == 1


def test_csv_and_results(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ('q"x', 2)], "k string, n int")
    files.write_csv(df, str(tmp_path / "c"), ["k", "n", "none"])
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), ["k", "n", "none"]).fillna("").collect()} == {("a", "", ""), ('q"x', "2", "")}
    for d, v in (("one", 1), ("two", 2)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "m_test_eval.json").write_text(json.dumps([{"dataset": "x", "n": v}]))
    got = files.read_results(spark, [str(tmp_path / "one" / "*.json"), str(tmp_path / "two" / "*.json")], "dataset string, n long").collect()
    assert [(r["n"], r["file_name"]) for r in got] == [(1, "m_test_eval.json")]
    assert "| a |" in files.write_markdown(df.select("k"), str(tmp_path / "md"), "T")
    assert files.keep_last(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, o int, v string"), ["k"], "o").first()["v"] == "y"


def test_stream_of_facts(spark, sf, tmp_path):
    facts = spark.read.parquet(f"{sf}/facts.parquet")
    facts.write.parquet(str(tmp_path / "in"))
    q = arrivals(spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("arrived").collect()} == {tuple(r) for r in arrivals(facts).where("start is not null").collect()}


def test_every_core_query_has_a_result(spark, sf):
    import __spark_entry__ as e
    from factloom.plans.queries import QUERIES
    from factloom.plans.sql import SQL

    assert set(SQL) <= set(QUERIES)
    assert e.entry(spark).count() > 0
    for name in ("skill_pools", "eval_summary", "collision_probe", "p5_found"):
        assert QUERIES[name](spark, sf).count() > 0
