import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import field_mentions
from factloom.operators import builders as B
from factloom.operators import knowledge as N
from factloom.operators import retrieval as Q
from factloom.operators import scoring as S
from factloom.operators.analysis import cluster_rows, planning, source_support
from factloom.sources import files as L


def test_numbers_are_dense_and_in_order(spark):
    rows = [(i % 3, random.Random(i).randrange(10**6) * 100 + i) for i in range(200)]
    got = B.numbered(spark.createDataFrame(rows, "a int, b long").repartition(7), "n", "a", "b").orderBy("n").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows) and [r["n"] for r in got] == list(range(200))
    assert B.numbered(spark.createDataFrame([], "a int, b long"), "n", "a", "b").count() == 0


def test_label_passages_and_facts(spark):
    context = "array<struct<section_title:string,text:string>>"
    rows = [(1, "q1", "Drug ", [("Warnings", "stop"), (None, "plain"), ("", ""), ("Only", None)]), (2, "q2", None, []), (3, "q3", None, None), (4, "q4", "", [(None, str(i)) for i in range(9)])]
    df = spark.createDataFrame(rows, f"row long, qid string, drug_name string, context {context}")
    p = {r["row"]: r["p"] for r in df.select("row", B.label_passages(F.col("context")).alias("p")).collect()}
    assert p[1] == ["Warnings: stop", "plain", "Only: "] or p[1] == ["Warnings: stop", "plain", "Only:"] and p[2] == []
    f = {r["row"]: r for r in B.label_facts(df).collect()}
    assert set(f) == {1, 4} and f[4]["text"] == "0\n\n1\n\n2\n\n3" and f[4]["aliases"] == [] and f[1]["aliases"] == ["Drug"]


def test_bank_is_numbered_by_family(spark):
    e = spark.createDataFrame([(7, "drug_drug", "A", "B", "drug", None, None), (3, "drug_drug", "C", "D", "drug", "drug", "meets")], "row long, relation string, x_name string, y_name string, x_type string, y_type string, display_relation string")
    i = spark.createDataFrame([(1, "drugchat_chembl", "5", " ask ", "CC=O", None, {"name": "X", "cid": ""}), (2, "drugchat_chembl", "6", None, None, None, None)], "row long, source string, source_index string, instruction string, input string, output string, metadata map<string,string>")
    bank = B.knowledge_bank(B.edge_facts(e), B.instruction_facts(i)).orderBy("fact_idx").collect()
    assert [r["title"] for r in bank] == ["C --meets--> D", "A --drug_drug--> B", "ask", "drugchat_chembl fact"]
    assert bank[1]["text"] == "PrimeKG relation: A (drug) --drug_drug--> B (None)." and bank[2]["aliases"] == ["CC=O", "X"] and bank[3]["aliases"] == []


def test_alias_lists_have_bounded_parts(spark):
    rows = [("s", f"t{i}", "x", ["Hot ", "cold"] if i == 0 else ["hot"]) for i in range(60)] + [("s", "t0", "x", None)]
    got = B.alias_lists(spark.createDataFrame(rows, "source string, title string, text string, aliases array<string>"), size=10).collect()
    hot = [r["fact_ids"].split(",") for r in got if r["alias"] == "hot"]
    assert len(hot) == 6 and len({x for p in hot for x in p}) == 60 and all(p == sorted(p) for p in hot)


def test_official_pool_takes_the_first_rows_of_a_source(spark):
    rows = [(i, "a", str(i), "train" if i % 4 else "test") for i in range(20)] + [(50, "b", "x", None)]
    got = B.official_pool(spark.createDataFrame(rows, "k long, source string, source_index string, s string"), "k", F.col("s"), 3).collect()
    assert {r["k"] for r in got if r["pool"] == "train"} == {1, 2, 3, 50} and {r["k"] for r in got if r["pool"] == "test"} == {0, 4, 8, 12, 16}


def test_field_mentions_do_not_cross_fields(spark):
    df = spark.createDataFrame([("ends here", "Begins there", "Foo hydrochloride"), (None, None, None)], "a string, b string, d string")
    got = [set(r[0]) for r in df.select(field_mentions("a", "b", drug="d")).collect()]
    assert got[0] == {"ends here", "begins there", "foo hydrochloride", "foo"} and got[1] == set()


def test_collectors(spark, tmp_path):
    for folder, f1 in (("one", 0.5), ("two", 0.7)):
        p = tmp_path / folder
        p.mkdir()
        (p / "lm_fdarxbench_bm25_raw_test_eval.json").write_text(f'[{{"n": 3, "avg_token_f1": {f1}}}, {{"n": 4, "avg_token_f1": 0.1, "dataset": "sub"}}]')
        (p / f"lm_fdarxbench_{'kg' if f1 > 0.6 else 'rrf'}_raw_test_eval.json").write_text('{"n": 5, "avg_token_f1": 0.2}' if f1 > 0.6 else "{broken")
        (p / "notes.txt").write_text("no result")
    got = L.read_results(spark, [str(tmp_path / x) for x in ("none", "one", "two")], "dataset string, n double, avg_token_f1 double", S.filename_fields(F.col("file_name"))).where("method is not null").collect()
    assert sorted((r["method"], r["n"], r["avg_token_f1"]) for r in got) == [("bm25", 3.0, 0.5), ("bm25", 4.0, 0.1), ("kg", 5.0, 0.2)]
    (tmp_path / "results_summary.csv").write_text("dataset,method,model,variant,subtask,n,token_f1,exact,numeric_acc,file\nd,bm25,m,raw,,7,0.5,x,,f\n")
    r = L.read_summaries(spark, [str(tmp_path / "results_summary.csv"), str(tmp_path / "gone.csv")]).first()
    assert (r["subtask"], r["n"], r["token_f1"], r["exact"], r["numeric_acc"]) == ("d", 7.0, 0.5, None, None)
    with pytest.raises(ValueError):
        L.read_jsonl(spark, str(tmp_path), "a int", most=3)


def test_tables_are_replaced_and_copied(spark, tmp_path):
    at = str(tmp_path / "t")
    L.replace_table(spark.range(3), at)
    L.replace_table(spark.range(5), at)
    assert spark.read.parquet(at).count() == 5 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    L.copy_table(spark, str(tmp_path / "gone"), str(tmp_path / "c"), "id long")
    assert spark.read.parquet(str(tmp_path / "c")).count() == 0
    assert L.write_json_object(spark.range(1), str(tmp_path / "j")) == '{"id":0}'


def test_grid_must_be_complete(spark):
    s = spark.createDataFrame([("m", "a", "d", "t"), ("n", "b", "d", "t")], "model_name string, method_name string, dataset string, task_type string")
    with pytest.raises(ValueError):
        S.assert_complete(s)
    assert S.assert_complete(s.limit(1)).count() == 1


def test_bags_with_empty_and_null_sides(spark):
    rows = [(1, ["a", "a", "b"], ["a", "c", "a", "a"]), (2, [], []), (3, None, ["x"]), (4, ["x"], [])]
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    got = {r["k"]: (r["n_a"], r["n_b"], r["common"]) for r in S.overlap(df, "k", F.col("a"), F.col("b")).collect()}
    assert got == {1: (3, 4, 2), 2: (0, 0, 0), 3: (0, 1, 0), 4: (1, 0, 0)}


def test_planning_and_support(spark):
    facts = spark.createDataFrame([(1, "primekg", "T", "alpha beta"), (2, None, None, None)], "fact_idx long, source string, title string, text string")
    found = spark.createDataFrame([(1, 1), (1, 2)], "qid long, fact_idx long")
    q = spark.createDataFrame([(1, ["primekg"], "Alpha gamma", "g"), (2, ["primekg"], "", "g")], "qid long, allow array<string>, gold_answer string, grp string")
    said = spark.createDataFrame([(1, "beta beta zeta")], "qid long, prediction string")
    m = {r["qid"]: r for r in planning(found, facts, q, said).collect()}
    assert (m[1]["source_precision"], m[1]["evidence_recall_at_k"], m[1]["evidence_utilization"]) == (0.5, 0.5, 0.5)
    assert m[2]["source_precision"] is None and m[2]["evidence_recall_at_k"] is None and m[2]["evidence_utilization"] is None
    s = {r["source"]: r for r in source_support(found, facts, q).collect()}
    assert s["primekg"]["n"] == 2 and s["primekg"]["mean_gold_token_recall"] == 0.25 and s["fdarxbench_label"]["mean_gold_token_recall"] == 0.0


def test_names_inside_texts_match_brute_force(spark):
    rng = random.Random(4)
    names = [" ".join(rng.choice(["alpha", "be", "gam-ma", "delta9", "of"]) for _ in range(rng.randrange(1, 4))) for _ in range(25)]
    texts = [" ".join(rng.choice(["alpha", "be", "gam-ma", "delta9", "xalphax", "of"]) for _ in range(12)) for _ in range(40)]
    import re

    want = {(i, n) for i, t in enumerate(texts) for n in set(names) if len(n) >= 4 and re.search("[a-z0-9]{3}", n) and n in t}
    t = spark.createDataFrame(list(enumerate(texts)), "qid long, qtext string")
    assert {(r["qid"], r["name"]) for r in N.contained_names(t, spark.createDataFrame([(n,) for n in names], "name string")).collect()} == want


def test_clusters_name_their_first_skill(spark):
    c = spark.createDataFrame([(0, "b"), (0, "a"), (0, "b"), (1, "z"), (1, "y")], "cluster int, skill string")
    got = {r["cluster"]: (r["n"], r["top_skill"], r["purity"], r["skill_counts"]) for r in cluster_rows(c).collect()}
    assert got == {0: (3, "b", 0.666667, "b:2|a:1"), 1: (2, "y", 0.5, "y:1|z:1")}


def test_vectors_must_have_facts(spark):
    v = spark.createDataFrame([(1, "s"), (2, "s")], "fact_idx long, source string")
    with pytest.raises(ValueError):
        Q.matched_vectors(v, v.where("fact_idx = 1"))
    with pytest.raises(ValueError):
        Q.locked(v, "other")
    assert Q.matched_vectors(Q.locked(v, "s"), v).count() == 2
