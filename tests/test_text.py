import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import routing as R
from factloom.functions import text as T
from factloom.operators import scoring as S


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()[0]


def test_norms(spark):
    assert one(spark, T.norm_text("a"), a=" A \t b ") == "a b"
    assert one(spark, T.metric_text("a", "none"), a=None) == "none"
    assert one(spark, T.metric_text("a", ""), a="It's  50%, ok.") == "its 50 ok"
    assert one(spark, T.tokens("a"), a="Co-trim 2.5mg, x'y -z") == ["co-trim", "2.5mg", "x'y", "z"]
    assert one(spark, T.token_set("a"), a="b a b") == ["a", "b"]


def test_ids_match_hashlib(spark):
    h = hashlib.sha1(b"s||None||t").hexdigest()
    assert one(spark, T.stable_id("a", "b", "c"), a="s", b=None, c="t") == h[:20]
    for x in ("abc", "", "qa-17"):
        assert one(spark, T.sha1_bucket("a", 6), a=x) == int(hashlib.sha1(x.encode()).hexdigest(), 16) % 6
        assert one(spark, T.half_split("a"), a=x) == ("discovery" if hashlib.sha256(x.encode()).digest()[0] < 128 else "evaluation")


@pytest.mark.parametrize("p, r, want", [("about 10.4", "10", True), ("11", "10", False), ("none", "10", False), ("10", "ten", None), ("1e3 x", " 1000\n", True), (None, "5", False), ("5", None, None)])
def test_numeric_match(spark, p, r, want):
    assert one(spark, T.numeric_match("a", "b"), a=p, b=r) is want


def test_answer_shapes(spark):
    for a, want in [(None, "empty"), (" \n", "empty"), ("-1.5e3", "numeric"), ("[C][O]", "molecule_string"), ("Information not found!", "abstention"), ("a\nb", "list_or_multiline"), ("- a", "list_or_multiline"), ("a b", "short_text"), ("a " * 9, "long_text")]:
        assert one(spark, T.answer_shape("a"), a=a) == want, a


def test_counter_cells(spark):
    df = spark.createDataFrame([("b", 1), ("a", 3), ("c", 1)], "k string, n long")
    cell = df.agg(T.counter_cell("k", "n")).first()[0]
    assert cell == "a:3|b:1|c:1"
    assert [tuple(x) for x in one(spark, T.parse_counter("a"), a="x:y:3|bad|z:1|q:n")] == [("x:y", 3), ("z", 1)]


def test_mentions(spark):
    got = set(one(spark, T.mentions("q", "c", "d", "s", "t"), q="What does Aspirin forte do?", c="CCO", d="Foo hydrochloride", s="C=O", t=None))
    assert {"what does aspirin forte do", "foo hydrochloride", "foo", "c=o", "cco"} <= got


def test_token_f1(spark):
    df = spark.createDataFrame([(1, "a b b", "a b c"), (2, "", ""), (3, "x", ""), (4, None, "none")], "pred_id long, p string, r string")
    o = S.overlap(df, "pred_id", S.words("p"), S.words("r")).withColumn("f", S.f1(F.col("n_a"), F.col("n_b"), F.col("common")))
    assert {r["pred_id"]: round(r["f"], 4) for r in o.collect()} == {1: 0.6667, 2: 1.0, 3: 0.0, 4: 1.0}


def test_routes(spark):
    def go(f, **v):
        base = {"source": "m", "task_type": "", "question": "", "input_type": "", "id": "1"} | v
        return one(spark, f, **base)

    assert go(R.route(), source="fdarxbench", task_type="Multihop") == "fda_label_multihop"
    assert go(R.route(), task_type="property prediction") == "molecule_property_numeric"
    assert go(R.route(), task_type="description-guided molecule design", question="describe") == "molecule_design"
    assert go(R.route_legacy(), task_type="property", question="describe it") == "molecule_description"
    assert go(R.route_question(), question="Which warning and dose?") == "fda_label_multihop"
    assert go(R.route_question(), question="x", source="fdarxbench") == "biomedical_open_qa"
    assert go(R.route_analysis(), source="fdarxbench", task_type="refusal") == "fda_label_refusal"
    for s in R.SKILLS:
        assert one(spark, R.route_wrong(F.col("a")), a=s) not in (s, None)
    assert go(R.route_random("id")) == list(R.SKILLS)[int(hashlib.sha1(b"1").hexdigest(), 16) % 6]
    with pytest.raises(ValueError):
        R.parse_ablate("steps")
    assert R.parse_ablate("none") == frozenset()


def test_file_names(spark):
    def f(x):
        return [one(spark, c, n=x) for c in S.filename_fields(F.col("n"))]

    assert f("lm_fdarxbench_bm25_skillrouted_ret_test_eval.json") == ["lm", "fdarxbench", "bm25_skillrouted", "ret"]
    assert f("lm_fdarxbench_raw_test_eval.json") == ["lm", "fdarxbench", "none", "raw"]
    assert f("other.json") == [None, None, None, None]
