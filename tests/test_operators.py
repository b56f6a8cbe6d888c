import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from factloom.functions import routing as R
from factloom.operators import analysis as A
from factloom.operators import blocks
from factloom.operators import knowledge as N
from factloom.operators import retrieval as Q
from factloom.operators import scoring as S
from factloom.operators import variants as V
from factloom.plans.queries import QUERIES
from factloom.plans.sql import SQL

FACT = "fact_idx long, source string, relation string, title string, text string, aliases array<string>, entities array<string>, tokens array<string>"


def facts(spark, n=30):
    rows = [(i, ["primekg", "drugchat_chembl", "fdarxbench_label"][i % 3], "drug_drug", f"t{i}", f"alpha beta word{i}", [f"Drug{i % 7}"], [f"Drug{i % 7}", f"X{i}"], None if i % 2 else ["alpha", "beta", f"word{i}"]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, None, None, None, None, None, None)], FACT)


def test_bm25_prefers_rare_words_and_breaks_ties_by_fact(spark):
    q = spark.createDataFrame([(1, "word5 alpha"), (2, "alpha"), (3, ""), (4, None)], "qid long, qtext string")
    got = [(r["qid"], r["rank"], r["fact_idx"]) for r in Q.bm25_topk(q, facts(spark), k=2).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 5), (1, 2, 0), (2, 1, 0), (2, 2, 1)]
    late = Q.bm25_topk(q, facts(spark), k=1, larger_first=True).where("qid = 2").first()
    assert late["fact_idx"] == 29


def test_candidate_cap_stops_after_the_term_that_reaches_it(spark):
    post = spark.createDataFrame([("rare", 1), ("mid", 1), ("mid", 2), ("mid", 3), ("hot", 4), ("hot", 5)], "term string, fact_idx long")
    terms = spark.createDataFrame([(9, "rare", 1), (9, "mid", 2), (9, "hot", 3)], "qid long, term string, term_rank int")
    assert {r["fact_idx"] for r in Q.capped_terms(terms, post, 3).collect()} == {1, 2, 3}
    assert {r["fact_idx"] for r in Q.capped_terms(terms, post, 1).collect()} == {1}


def test_search_in_blocks_matches_sums_of_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    rows = [(i, rng.choice(["primekg", "s", None]), rng.choice(["r", "t"]), None, " ".join(word() for _ in range(rng.randint(0, 12))), [f"Name {rng.randint(0, 30)}"], None, None) for i in range(300)]
    f = spark.createDataFrame(rows, FACT)
    asked = [(i, " ".join(word() for _ in range(8)), f"name {i}" if i < 20 else None, ["one", "all", None][i % 3]) for i in range(40)]
    q = spark.createDataFrame(asked, "qid long, qtext string, drug_name string, skill string").withColumns({c: F.lit(None).cast("string") for c in ("question", "input_molecule_or_context", "decoded_smiles", "task_type")})
    skills = {"one": (["s"], ["r", "t"]), "all": (["primekg", "s"], ["r", "t"])}
    table = spark.createDataFrame([(k, *v, 2) for k, v in skills.items()], "skill string, sources array<string>, relations array<string>, top_k int")
    n, avgdl = Q.sizes(f)
    post = Q.postings(f)
    terms = Q.query_terms(q, Q.inverse_frequency(post, n), least=2).cache()
    monkeypatch.setattr(Q, "query_terms", lambda *a, **k: terms)
    sums = {(r["qid"], r["fact_idx"]): r["score"] for r in Q.lexical_scores(terms, post, avgdl).collect()}
    fact = {r[0]: r for r in rows}
    for cap, method, block in ((1000, "bm25_skillrouted", 70), (40, "hybrid", 70), (40, "bm25_skillrouted", 300), (90, "bm25_skillrouted", 70)):
        monkeypatch.setattr(Q.blocks, "BLOCK", block)
        capped = {(r["qid"], r["fact_idx"]) for r in Q.capped_terms(terms, post, cap).collect()} if n > cap else set(sums)
        want = set()
        for qid, _, name, skill in asked:
            found = []
            for i, r in fact.items():
                if method == "bm25_skillrouted" and (skill is None or r[1] not in skills[skill][0]):
                    continue
                hit = name is not None and r[5][0].lower() == name
                if hit or (qid, i) in capped:
                    score = (sums.get((qid, i), 0) + 50_000) // 100_000 + 10_000 * hit * ((8 if method == "hybrid" else 0) + (r[1] == "primekg"))
                    found.append((-score, not hit, i))
            found = [x for x in sorted(found) if x[0] < 0][: 2 if method == "hybrid" and skill else 4]
            want |= {(qid, rank, i, -s / 1e4, not miss) for rank, (s, miss, i) in enumerate(found, 1)}
        got = Q.retrieve(q, f, method, 4, table, cap=cap).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    late = {(r["qid"], r["rank"], r["fact_idx"]) for r in Q.bm25_topk(q, f, k=5, larger_first=True, rounded=False).collect()}
    assert late == {(x, rank, i) for x in range(40) for rank, (_, i) in enumerate(sorted(((s, i) for (y, i), s in sums.items() if y == x), reverse=True)[:5], 1)}


def test_sums_in_one_pass_hold_the_best_of_all_with_ties_hits_and_what_may_be_used():
    rng = np.random.default_rng(5)
    held = [sorted(set(rng.zipf(1.3, rng.integers(0, 9)).clip(max=40).tolist())) for _ in range(700)]
    lists = blocks.Lists([pa.array([[f"w{x}" for x in r] for r in held], pa.list_(pa.string()))])
    base, ids = 1.0 + np.arange(10) / 4, rng.permutation(700)
    for usable in (None, rng.random(700) < 0.4, np.zeros(700, bool)):
        sums = blocks.Sums(lists, usable, base)
        for i in range(60):
            words = rng.permutation(40)[: 1 + i % 7] + 1
            asked = [(int(c), 1.0 + w % 3) for w, c in ((w, pc.index_in(pa.scalar(f"w{w}"), value_set=lists.words).as_py()) for w in words.tolist()) if c is not None]
            weight = {lists.words[c].as_py(): w for c, w in asked}
            may = np.ones(700, bool) if usable is None else usable
            hits = np.flatnonzero(may & (rng.random(700) < 0.01))
            want = []
            for row in np.flatnonzero(may).tolist():
                score = sum(int(np.floor(weight[f"w{x}"] / base[len(held[row])] * 1e9 + 0.5)) for x in held[row] if f"w{x}" in weight) + 10**9 * (row in hits)
                want.append((-score, row not in hits, int(ids[row]) * (-1 if i % 2 else 1)))
            rows, score, hit = sums.best(asked, hits, np.full(len(hits), 10**9), 8, 0)
            at = blocks._first(ids[rows], score, hit, 8, bool(i % 2))
            assert [(-int(score[x]), not hit[x], int(ids[rows[x]]) * (-1 if i % 2 else 1)) for x in at] == [x for x in sorted(want) if x[0] < 0][:8]


@pytest.fixture(scope="module")
def many_facts(spark, tmp_path_factory):
    """Tables in which a record's rarest word is in 20,000 facts, none of which is among its best."""
    d = str(tmp_path_factory.mktemp("many"))
    kinds = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(r).alias("relation")) for s, r in sorted({(s, r) for x in R.skill_table(spark).collect() for s in x["sources"] for r in x["relations"]})))
    i = spark.range(45_000).withColumn("rare", F.col("id") < 20_000).withColumn("kind", F.get(kinds, (F.col("id") % F.size(kinds)).cast("int")))
    tokens = F.when(F.col("rare"), F.concat(F.array(F.lit("rarely")), F.transform(F.sequence(F.lit(1), F.lit(19)), lambda x: F.concat(F.lit("filler"), x.cast("string"))))).otherwise(F.array(F.lit("common")))
    none = F.lit(None).cast("array<string>")
    f = i.select(F.col("id").alias("fact_idx"), F.when(F.col("rare"), "other").otherwise(F.col("kind.source")).alias("source"), F.when(F.col("rare"), "other").otherwise(F.col("kind.relation")).alias("relation"), F.lit("t").alias("title"), F.concat_ws(" ", tokens).alias("text"), none.alias("aliases"), none.alias("entities"), tokens.alias("tokens"))
    f.coalesce(1).write.parquet(f"{d}/facts.parquet")
    like = spark.read.parquet("/root/testdata/sf0.001/qa_records.parquet").limit(0)
    given = {"qa_id": F.col("id"), "id": F.col("id").cast("string"), "source": F.lit("fdarxbench"), "question": F.lit("rarely common"), "task_type": F.lit("factual")}
    spark.range(3).select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in like.dtypes)).coalesce(1).write.parquet(f"{d}/qa_records.parquet")
    return d


@pytest.mark.parametrize("name", ["bm25_routed", "bm25_routed_wrong", "bm25_routed_predicted", "bm25_routed_random", "hybrid_retrieve", "prompts", "prompts_ablated", "skill_hybrid_retrieve"])
def test_no_candidate_is_dropped_where_a_rare_word_is_in_many_facts(spark, many_facts, name):
    duckdb = pytest.importorskip("duckdb").connect()
    for t in ("facts", "qa_records"):
        duckdb.sql(f"create view {t} as select * from '{many_facts}/{t}.parquet/*.parquet'")
    want = duckdb.sql(SQL[name]).fetchall()
    assert len(want) >= 3 and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in QUERIES[name](spark, many_facts).collect())


def test_edge_cap_matches_a_sequential_walk(spark):
    rng = random.Random(1)
    for cap in (1, 2, 3):
        edges = [(i, rng.choice("abcd"), rng.choice("abcd")) for i in range(60)]
        wanted, count, kept = {"a", "b", "c"}, {}, set()
        for i, x, y in edges:
            ends = [e for e in (x, y) if e in wanted]
            if not ends or all(count.get(e, 0) >= cap for e in ends):
                continue
            kept.add(i)
            for e in ends:
                count[e] = count.get(e, 0) + 1
        e = spark.createDataFrame(edges, "fact_idx long, x string, y string")
        w = spark.createDataFrame([(x,) for x in wanted], "name string")
        assert {r["fact_idx"] for r in N.capped_edges(e, w, cap).collect()} == kept


def test_dense_matches_brute_force(spark):
    rng = random.Random(2)
    vs = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(50)}
    vs[51] = vs[3]
    df = spark.createDataFrame([(i, f"s{i % 2}", v) for i, v in vs.items()], "fact_idx long, source string, v array<double>")
    q = df.where("fact_idx < 5").select(F.col("fact_idx").alias("qid"), "v", F.array(F.lit("s0")).alias("allow"))
    for allowed in (None, "allow"):
        got = {}
        for r in Q.dense_topk(q, df, k=3, block=7, allowed=allowed).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["fact_idx"]))
        for i in range(5):
            order = sorted((-round(sum(a * b for a, b in zip(vs[i], v)), 6), j) for j, v in vs.items() if j != i and not (allowed and j % 2))
            assert [f for _, f in sorted(got[i])] == [j for _, j in order[:3]]


def test_fusion_and_budget(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "qid long, fact_idx long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "qid long, fact_idx long, rank int")
    assert [r["fact_idx"] for r in Q.fuse(a, b, k=3).orderBy("rank").collect()] == [20, 10, 30]
    f = spark.createDataFrame([(10, "s", "r", "x" * 20), (20, None, None, "y\nz")], "fact_idx long, source string, relation string, text string")
    found = a.withColumn("score", F.lit(8.5))
    assert Q.evidence_block(found, f, 1000).first()["block"] == "1. [s:r; score=8.5] " + "x" * 20 + "\n2. [None:None; score=8.5] y z"
    assert Q.evidence_block(found, f, 45).first()["n_lines"] == 1
    assert Q.evidence_block(found, f, 5).first()["block"] == "No KB evidence retrieved within budget."


def test_same_molecule_caps_without_pairs(spark):
    r = spark.createDataFrame([(i, "CC ") for i in range(40)] + [(50, None), (51, " "), (52, "N")], "qa_id long, decoded_smiles string")
    got = N.same_molecule(r, 3).collect()
    assert len(got) == 120 and {x["other"] for x in got if x["qa_id"] == 0} == {1, 2, 3} and {x["other"] for x in got if x["qa_id"] == 2} == {0, 1, 3}


def test_contained_names_never_multiply_texts(spark):
    names = ["abcd", "aspirin", "aspirin plus", "aspirin plusx", "bcde", "abc", "ä ö", "warfarin sodium", "rfar"]
    texts = [(1, "Take ASPIRIN  plus, abcde"), (2, "xwarfarin sodiumx"), (3, ""), (4, None), (5, "nothing"), (6, "abc ä ö")]
    t, n = spark.createDataFrame(texts, "qid long, qtext string"), spark.createDataFrame([(x,) for x in names], "name string")
    for least in (4, 3, 1):
        want = {(q, x) for q, text in texts for x in names if text and len(x) >= least and x in " ".join(text.lower().split())}
        for block in (200_000, 2):
            assert {(r["qid"], r["name"]) for r in N.contained_names(t, n, least, block).collect()} == want
    assert "Generate" not in N.contained_names(t, n)._jdf.queryExecution().executedPlan().toString()


def test_divergence_and_entropy(spark):
    d = spark.createDataFrame([("a", "x", 0, 1.0), ("a", "y", 1, 0.0), ("b", "x", 0, 0.0), ("b", "y", 1, 1.0), ("c", "x", 0, 0.5), ("c", "y", 1, 0.5)], "grp string, source string, pos int, share double")
    js = {(r["grp_a"], r["grp_b"]): r["js_divergence"] for r in A.divergence(d).collect()}
    assert js["a", "b"] == 1.0 and ("ALL", "MEAN") in js
    h = {r["grp"]: r for r in A.heterogeneity(d, 2).collect()}
    assert h["a"]["entropy_bits"] == 0.0 and h["c"]["normalized_entropy"] == 1.0 and h["c"]["dominant_source"] == "x" and h["c"]["effective_sources"] == 2.0


def test_cluster_quality(spark):
    same = A.cluster_quality(spark.createDataFrame([(i % 3, str(i % 3)) for i in range(30)], "cluster int, skill string")).first()
    assert (same["purity"], same["nmi"], same["ari"]) == (1.0, 1.0, 1.0)


def test_splits_are_disjoint_and_complete(spark):
    rows = spark.createDataFrame([(i, f"Drug {i % 25}" if i % 10 else None) for i in range(200)], "qa_id long, drug_name string")
    s = V.identity_holdout(rows, "qa_id", V.identity_key("drug_name"))
    got = s.collect()
    assert len(got) == 200
    test = {r["identity"] for r in got if r["split"] == "test"}
    assert len(test) == round(25 * 0.2) and not test & {r["identity"] for r in got if r["split"] == "train"}
    assert {r["n_shared"] for r in V.split_summary(s).collect()} == {0}


def test_perturbations(spark):
    f = facts(spark)
    assert V.noise(f, 0.5).count() == 16 and V.noise(f, 0.0).count() == 0
    d = V.decoys(f, 2, 0.3).collect()
    assert len(d) == 2 * round(31 * 0.3) and all(r["source"] != r["true_source"] for r in d)
    assert sorted(map(str, d)) == sorted(map(str, V.decoys(f, 2, 0.3).collect()))
    with pytest.raises(ValueError):
        V.perturbed(f, "other")


def test_policy_ties_go_to_the_larger_name(spark):
    s = spark.createDataFrame([("m", "d", "t", x, 0.5, p) for x in ("a", "b") for p in ("discovery", "evaluation")], "model_name string, dataset string, question_type string, method_name string, utility double, h string")
    assert S.select_policies(s, F.col("h")).first()["selected_method"] == "b"


def test_field_coverage_counts_empty_as_missing(spark):
    df = spark.createDataFrame([("s", "", [], 0), ("s", "x", ["a"], None)], "source string, t string, l array<string>, n int")
    assert {r["field"]: r["present"] for r in A.field_coverage(df, "source").collect()} == {"t": 1, "l": 1, "n": 1}


def test_dense_search_shuffles_no_vectors_and_filters_a_pool_after_it(spark):
    """copies of vectors and all pairs of the pool went through the disk."""
    rng = random.Random(8)
    rows = [(i, "abc"[i % 3] if i % 7 else None, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    v = spark.createDataFrame(rows, "fact_idx long, source string, v array<double>")
    q = v.where("fact_idx % 5 = 0").select(F.col("fact_idx").alias("qid"), "v", F.expr("case fact_idx % 3 when 0 then array() when 1 then array(source) end").cast("array<string>").alias("allow"))
    got = Q.dense_topk(q, v, k=4, block=16, allowed="allow", pool=40)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted((r["qid"], r["rank"], r["fact_idx"], r["score"]) for r in df.collect())
    assert key(got) == key(Q.routed_pool(Q.dense_topk(q, v, k=40, block=16), q, v, k=4))
