"""Registered queries of the core; each takes (spark, directory of tables) and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import routing as R
from factloom.functions import text as T
from factloom.operators import analysis as A
from factloom.operators import builders as B
from factloom.operators import knowledge as N
from factloom.operators import retrieval as Q
from factloom.operators import scoring as S
from factloom.operators import variants as V
from factloom.operators.hotkeys import hot_pairs, key_report
from factloom.sources import files as L
from factloom.storage import cut, scratch, table
from factloom.streaming.arrivals import arrivals as arrival_counts

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _facts(spark, d):
    return table(spark, d, "facts")


def _qa(spark, d):
    return Q.qa_queries(table(spark, d, "qa_records"))


def _items(spark, d):
    return table(spark, d, "eval_items").withColumn("qid", F.col("item_id")).withColumn("qtext", F.concat_ws(" ", "question", "text"))


def _scores(spark, d):
    return S.score(table(spark, d, "predictions"))


def _long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# --- skewed keys -------------------------------------------------------------------------------


@query
def p5_found(spark, d):
    return hot_pairs(_facts(spark, d))


@query
def p5_report(spark, d):
    return key_report(_facts(spark, d)).withColumn("share", F.round("share", 6))


# --- texts, identifiers, numbers ---------------------------------------------------------------


@query
def fact_token_counts(spark, d):
    """Tokens of each fact's text and of title, text and aliases together."""
    f = _facts(spark, d)
    tk = T.tokens(F.coalesce("text", F.lit("")))
    return f.select("fact_idx", F.size(tk).cast("long").alias("n_tokens"), F.size(F.array_distinct(tk)).cast("long").alias("n_distinct"), F.length(T.fact_text()).cast("long").alias("n_chars"), F.array_join(F.slice(T.token_set(F.coalesce("text", F.lit(""))), 1, 5), " ").alias("first_terms"))


@query
def passages(spark, d):
    return _facts(spark, d).select("fact_idx", T.passage_text().alias("passage"))


@query
def normal_forms(spark, d):
    p = S.latest(table(spark, d, "predictions"))
    return p.select("pred_id", T.norm_text("prediction").alias("normal"), T.metric_text("prediction", "none").alias("metric"), T.metric_text("reference_output", "").alias("reference_metric"))


@query
def stable_ids(spark, d):
    return _facts(spark, d).select("fact_idx", T.stable_id("source", "title", "text").alias("fid"), T.stable_id("source_id", "fact_idx", size=16).alias("rid"))


@query
def hash_buckets(spark, d):
    q = table(spark, d, "qa_records").select("id").distinct()
    return q.select("id", T.sha1_bucket("id", 6).cast("long").alias("bucket"), T.half_split("id").alias("half"))


@query
def mention_counts(spark, d):
    m = Q.query_aliases(_qa(spark, d))
    return m.groupBy("alias").agg(F.count(F.lit(1)).alias("n"))


@query
def record_types(spark, d):
    q = _qa(spark, d)
    return q.select("qa_id", T.probable_smiles("decoded_smiles").alias("smiles"), T.input_type("source", "input_molecule_or_context").alias("kind"), T.answer_shape("gold_answer").alias("shape"), R.question_type("source", "task_type").alias("question_type"), V.identity_key("drug_name", "decoded_smiles", "input_molecule_or_context").alias("identity"))


@query
def numbers(spark, d):
    p = S.latest(table(spark, d, "predictions"))
    return p.select("pred_id", T.first_number("prediction").alias("first_number"), T.is_number("reference_output").alias("is_numeric"), T.numeric_match("prediction", "reference_output").alias("matched"))


@query
def entity_names(spark, d):
    e = _facts(spark, d).select("source", F.explode(T.entity_strings()).alias("e"))
    return e.groupBy("source", T.norm_text("e").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query
def result_file_fields(spark, d):
    p = table(spark, d, "predictions").select(F.concat_ws("_", "model_name", "dataset", "method_name", F.lit("ret_test_eval.json")).alias("file_name")).distinct()
    return p.select("file_name", *S.filename_fields(F.col("file_name")))


# --- routing -----------------------------------------------------------------------------------


@query
def routes(spark, d):
    q = _qa(spark, d)
    return q.select("qa_id", R.route().alias("skill"), R.route_legacy().alias("legacy"), R.route_question().alias("predicted"), R.route_analysis().alias("analysis"), R.route_random("id").alias("random"), R.route_wrong(R.route()).alias("wrong"))


@query
def router_confusion(spark, d):
    names = list(R.SKILLS)
    q = _qa(spark, d).select(R.route().alias("gold"), R.route_question().alias("predicted"))
    return _long(q.groupBy("gold").pivot("predicted", names).count().fillna(0, names), *names)


@query
def router_accuracy(spark, d):
    q = _qa(spark, d).select(R.route().alias("gold"), R.route_question().alias("predicted"))
    return q.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("n_correct"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query
def skill_pools(spark, d):
    """Facts that each skill may use."""
    f, s = _facts(spark, d).groupBy("source", "relation").agg(F.count(F.lit(1)).alias("n")), R.skill_table(spark)
    x = f.join(F.broadcast(s), F.expr("array_contains(sources, source) and array_contains(relations, relation)"))
    return x.groupBy("skill").agg(F.sum("n").alias("n_facts"), F.count(F.lit(1)).alias("n_pairs"))


def _with_evidence(spark, d):
    """Records, and whether graph edges or other records of their molecule are evidence for them."""
    q = _qa(spark, d)
    graph = kg_evidence_attached(spark, d).select("qid").distinct().withColumn("graph", F.lit(True))
    molecule = N.same_molecule(q).select(F.col("qa_id").alias("qid")).distinct().withColumn("molecule", F.lit(True))
    return q.join(graph, "qid", "left").join(molecule, "qid", "left").fillna(False, ["graph", "molecule"])


@query
def slot_availability(spark, d):
    """How many records of an analysed skill have each of the slots that it needs."""
    q = _with_evidence(spark, d).withColumn("skill", R.route_analysis())
    m = F.create_map(*[x for k, v in R.data_slots(F.col("graph"), F.col("molecule")).items() for x in (F.lit(k), v)])
    x = q.select("skill", F.explode(R.analysis_slots(F.col("skill"))).alias("slot"), m.alias("m"))
    return x.groupBy("skill", "slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m")[F.col("slot")]).alias("filled"))


@query
def skill_analysis(spark, d):
    """Of each source, skill and task: records, lengths of the base prompt, how many have all slots, and graph facts a record;
    a row of source none where there is no evidence."""
    q = cut(_with_evidence(spark, d).withColumn("skill", R.route_analysis()).withColumn("chars", F.length(B.base_prompt())))
    m = F.create_map(*[x for k, v in R.data_slots(F.col("graph"), F.col("molecule")).items() for x in (F.lit(k), v)])
    q = q.withColumn("m", m).withColumn("full", F.forall(R.analysis_slots(F.col("skill")), lambda s: F.col("m")[s]))
    by = [F.col("source").alias("dataset"), "skill", "task_type"]
    g = q.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("chars"), 2).alias("avg_prompt_chars"), F.max("chars").cast("long").alias("max_prompt_chars"), F.round(F.avg(F.col("full").cast("double")), 6).alias("all_required_slots_coverage"))
    ev = kg_evidence_attached(spark, d).join(_facts(spark, d).select("fact_idx", F.col("source").alias("evidence_source")), "fact_idx").join(q.select("qid", *by), "qid").groupBy("dataset", "skill", "task_type", "evidence_source").agg(F.count(F.lit(1)).alias("facts"))
    names = ["dataset", "skill", "task_type"]
    x = g.join(ev, [g[c].eqNullSafe(ev[c]) for c in names], "left").select(*(g[c] for c in names), "n", "avg_prompt_chars", "max_prompt_chars", "all_required_slots_coverage", F.coalesce("evidence_source", F.lit("none")).alias("evidence_source"), F.coalesce("facts", F.lit(0)).alias("retrieved_facts"))
    return x.withColumn("facts_per_example", F.round(F.col("retrieved_facts") / F.col("n"), 6))


# --- retrieval ---------------------------------------------------------------------------------


@query
def bm25_topk(spark, d):
    return _long(Q.bm25_topk(_items(spark, d), _facts(spark, d)), "rank").withColumn("score", F.col("score").cast("double"))


@query
def bm25_lexical_rank(spark, d):
    return _long(Q.bm25_topk(_items(spark, d), _facts(spark, d), k=50, larger_first=True, rounded=False), "rank").select("qid", "rank", "fact_idx")


@query
def candidate_cap(spark, d):
    f = _facts(spark, d)
    post = Q.postings(f)
    t = Q.query_terms(_items(spark, d), Q.inverse_frequency(post, Q.sizes(f)[0]))
    c = Q.capped_terms(t, post, 200)
    return c.groupBy("qid").agg(F.count(F.lit(1)).alias("n_candidates"), F.max("first_term").cast("long").alias("last_term"))


def _retrieve(spark, d, method, override="none", with_skills=True):
    q = _qa(spark, d).withColumn("skill", R.routed(override))
    r = Q.retrieve(q, _facts(spark, d), method, 8, R.skill_table(spark) if with_skills else None)
    return _long(r, "rank").withColumn("score", F.col("score").cast("double"))


@query
def kg_retrieve(spark, d):
    return _retrieve(spark, d, "kg")


@query
def hybrid_retrieve(spark, d):
    return _retrieve(spark, d, "hybrid")


@query
def skill_hybrid_retrieve(spark, d):
    return _retrieve(spark, d, "skill_hybrid")


@query
def bm25_routed(spark, d):
    return _retrieve(spark, d, "bm25_skillrouted")


@query
def bm25_routed_predicted(spark, d):
    return _retrieve(spark, d, "bm25_skillrouted", "predicted")


@query
def bm25_routed_random(spark, d):
    return _retrieve(spark, d, "bm25_skillrouted", "random")


@query
def bm25_routed_wrong(spark, d):
    return _retrieve(spark, d, "bm25_skillrouted", "wrong")


def _item_records(spark, d):
    """The evaluation items with the fields of records."""
    null = F.lit(None).cast("string")
    i = table(spark, d, "eval_items").select(
        F.col("item_id").alias("qa_id"), F.col("item_id").cast("string").alias("id"), F.col("dataset").alias("source"), "question", F.col("text").alias("input_molecule_or_context"), null.alias("input_type"), null.alias("decoded_smiles"),
        "gold_answer", "task_type", null.alias("drug_name"), F.lit("test").alias("split"),
    )
    return i.withColumn("qid", F.col("qa_id")).withColumn("qtext", T.query_text())


def _item_retrieve(spark, d, method, **how):
    q = _item_records(spark, d).withColumn("skill", R.route())
    r = Q.retrieve(q, _facts(spark, d), method, 8, R.skill_table(spark), **how)
    return _long(r, "rank").withColumn("score", F.col("score").cast("double"))


@query
def items_routed(spark, d):
    return _item_retrieve(spark, d, "bm25_skillrouted")


@query
def items_unrouted(spark, d):
    """The routed method with its source routing ablated."""
    return _item_retrieve(spark, d, "bm25_skillrouted", ablate=R.parse_ablate("source_routing"))


@query
def items_capped(spark, d):
    """The hybrid method with at most about 200 candidates of the rarest terms."""
    return _item_retrieve(spark, d, "hybrid", cap=200)


@query
def run_counters(spark, d):
    """Records, evidence and alias hits of a run, a skill."""
    q = _item_records(spark, d).withColumn("skill", R.route())
    found = Q.retrieve(q, _facts(spark, d), "hybrid", 8, R.skill_table(spark)).groupBy("qid").agg(F.count(F.lit(1)).alias("k"), F.count_if("alias_hit").alias("h"))
    x = q.join(found, "qid", "left")
    return x.groupBy("skill").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("k") > 0).alias("with_evidence"), F.coalesce(F.sum("k"), F.lit(0)).alias("facts"), F.coalesce(F.sum("h"), F.lit(0)).alias("alias_hits"))


@query
def baseline_prompts(spark, d):
    """Prompt of each evaluation item with the evidence of the lexical method, as the two turns of a talk."""
    f, q = _facts(spark, d), _item_records(spark, d)
    b = Q.evidence_block(Q.bm25_topk(q, f), f, 3500)
    x = q.join(b, "qid", "left").withColumn("m", B.messages(B.evidence_prompt(), F.col("gold_answer")))
    return x.select("qa_id", F.col("m")[0]["content"].alias("prompt"), F.col("m")[1]["content"].alias("answer"))


@query
def augmented_records(spark, d):
    """Evaluation items with their skill, its evidence (first fact, sources) and the slots that it fills."""
    f, s = _facts(spark, d), R.skill_table(spark)
    q = _item_records(spark, d).withColumn("skill", R.route())
    found = Q.retrieve(q, f, "skill_hybrid", 8, s).join(f.select("fact_idx", "source", "relation"), "fact_idx")
    ev = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "fact_idx", "source", "relation"))).alias("evidence"))  # at most top_k
    x = q.join(ev, "qid", "left").join(F.broadcast(s.select("skill", "top_k", "answer_format")), "skill", "left")
    schema = F.struct("skill", "top_k", "answer_format").alias("skill_schema")
    x = x.select("qa_id", schema, F.coalesce("evidence", F.array().cast("array<struct<rank:int,fact_idx:bigint,source:string,relation:string>>")).alias("retrieved_kb_evidence"))
    return x.select("qa_id", F.col("skill_schema.skill").alias("skill"), F.size("retrieved_kb_evidence").cast("long").alias("n_evidence"), F.get("retrieved_kb_evidence", F.lit(0))["fact_idx"].alias("first_fact"), F.array_join(F.array_sort(F.array_distinct(F.transform("retrieved_kb_evidence", lambda e: F.coalesce(e["source"], F.lit("unknown"))))), ",").alias("evidence_sources"))


@query
def evidence_counts(spark, d):
    """Facts of each evidence kind by source and relation; a kind without a source of its own has a default one."""
    f = _facts(spark, d)
    kb = Q.bm25_topk(_items(spark, d), f).join(f.select("fact_idx", "source", "relation"), "fact_idx").select(F.lit("kb").alias("kind"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("relation", F.lit("unknown")).alias("relation"))
    kg = kg_evidence_attached(spark, d).select(F.lit("kg").alias("kind"), F.lit("corrected_primekg").alias("source"), F.lit(None).cast("string").alias("relation"))
    mol = N.same_molecule(_qa(spark, d)).join(_qa(spark, d).select(F.col("qa_id").alias("other"), F.col("source")), "other").select(F.lit("molecule").alias("kind"), F.coalesce("source", F.lit("corrected_molecule")).alias("source"), F.lit(None).cast("string").alias("relation"))
    return kb.unionByName(kg).unionByName(mol).groupBy("kind", "source", "relation").agg(F.count(F.lit(1)).alias("n"))


@query
def rrf_dense(spark, d):
    """Reciprocal rank fusion of the dense and the lexical first 50 facts, for every twentieth fact as a query."""
    f = _facts(spark, d)
    v = Q.matched_vectors(Q.clean_vectors(table(spark, d, "fact_vectors")), f)
    q = v.where("fact_idx % 20 = 0").select(F.col("fact_idx").alias("qid"), "v")
    asked = q.join(f.select(F.col("fact_idx").alias("qid"), F.coalesce("text", F.lit("")).alias("qtext")), "qid").select("qid", "qtext")
    lexical = Q.bm25_topk(asked, f, k=51, larger_first=True, rounded=False).where("qid <> fact_idx")
    w = Window.partitionBy("qid").orderBy("rank")
    lexical = lexical.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 50)
    return _long(Q.fuse(Q.dense_topk(q, v, k=50), cut(lexical)), "rank")


def _vectors(spark, d):
    v = Q.clean_vectors(table(spark, d, "fact_vectors"))
    return v, v.where("fact_idx % 20 = 0").select(F.col("fact_idx").alias("qid"), "v", F.array("source").alias("allow"))


@query
def dense_topk(spark, d):
    v, q = _vectors(spark, d)
    return _long(Q.dense_topk(q, v), "rank")


@query
def dense_locked(spark, d):
    v, q = _vectors(spark, d)
    return _long(Q.dense_topk(q, Q.locked(v, "fdarxbench_label")), "rank")


@query
def oracle_topk(spark, d):
    """The search inside the allowed sources of each query (here the source of its own fact)."""
    v, q = _vectors(spark, d)
    return _long(Q.dense_topk(q, v, allowed="allow"), "rank")


@query
def dense_routed_pool(spark, d):
    """The first 300 of all, then those of allowed sources."""
    v, q = _vectors(spark, d)
    return _long(Q.dense_topk(q, v, allowed="allow", pool=300), "rank")


def _two_lists(spark, d):
    f, q = _facts(spark, d), _items(spark, d)
    a = Q.bm25_topk(q, f, k=50, larger_first=True, rounded=False)
    b = Q.bm25_topk(q.withColumn("qtext", F.col("gold_answer")), f, k=50)
    return cut(a), cut(b)


@query
def rrf_fusion(spark, d):
    return _long(Q.fuse(*_two_lists(spark, d)), "rank")


@query
def rerank_overlap(spark, d):
    """The fused first 50, reranked by the overlap of their tokens with the query."""
    return _long(Q.rerank(Q.fuse(*_two_lists(spark, d), k=50), _items(spark, d), _facts(spark, d)), "rank")


@query
def evidence_blocks(spark, d):
    f = _facts(spark, d)
    found = Q.bm25_topk(_items(spark, d), f)
    return _long(Q.evidence_block(found, f, 600), "n_lines")


@query
def prompts(spark, d):
    """Prompt of each record with its routed skill, steps, answer format and evidence."""
    return _prompts(spark, d, frozenset())


@query
def prompts_ablated(spark, d):
    return _prompts(spark, d, R.parse_ablate("solving_steps,evidence_org"))


def _prompts(spark, d, ablate):
    f = _facts(spark, d)
    q = _qa(spark, d).withColumn("skill", R.route())
    found = Q.retrieve(q, f, "bm25_skillrouted", 3, R.skill_table(spark), ablate=ablate).withColumn("score", F.col("score").cast("decimal(20,4)"))
    b = Q.evidence_block(found, f, 3500)
    s = R.skill_table(spark).select("skill", "answer_format", "steps")
    x = q.join(b, "qid", "left").join(F.broadcast(s), "skill", "left")
    steps = F.transform("steps", lambda t, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), t))
    none = F.array().cast("array<string>")
    context = F.coalesce("input_molecule_or_context", F.lit(""))
    lines = F.concat(
        F.array(*map(F.lit, B.HEAD), F.lit("")),
        none if "skill_id" in ablate else F.array(F.concat(F.lit("Skill: "), "skill")),
        none if "solving_steps" in ablate else F.concat(F.array(F.lit(R.STEPS_HEAD)), steps),
        none if "answer_format" in ablate else F.array(F.concat(F.lit("Answer format: "), "answer_format")),
        F.when(context != "", F.array(F.lit(""), F.lit(R.CONTEXT_HEAD), context)).otherwise(none),
        F.array(F.lit(""), F.lit(B.EVIDENCE_HEAD if "evidence_org" in ablate else R.SKILL_EVIDENCE), F.coalesce("block", F.lit(B.NO_EVIDENCE)), F.lit(""), F.concat(F.lit("Question: "), F.coalesce("question", F.lit("None"))), F.lit("Answer:")),
    )
    return x.select("qa_id", "skill", F.array_join(lines, "\n").alias("prompt"), F.trim(F.coalesce("gold_answer", F.lit(""))).alias("answer"))


# --- knowledge bank ----------------------------------------------------------------------------


@query
def alias_index(spark, d):
    return N.alias_counts(_facts(spark, d))


@query
def alias_lists(spark, d):
    return B.alias_lists(_facts(spark, d))


def _rows(spark, d):
    """Records as raw instruction rows."""
    r = S.latest(table(spark, d, "qa_records"), "qa_id")
    return r.select("qa_id", "source", "source_path", "source_index", F.col("question").alias("instruction"), F.col("input_molecule_or_context").alias("input"), F.col("gold_answer").alias("output"), "metadata", "split", F.col("input_type").alias("raw_type"), "drug_name")


@query
def built_records(spark, d):
    r = B.instruction_records(_rows(spark, d))
    return r.select("qa_id", "id", "source", "source_index", "question", "input_molecule_or_context", "input_type", "gold_answer", "task_type")


@query
def built_pool(spark, d):
    """The official test rows and the first 200 other rows of each source."""
    r = _rows(spark, d)
    return B.official_pool(r, "qa_id", F.coalesce(F.col("metadata")["split"], "split"), 200)


@query
def base_prompts(spark, d):
    q = _qa(spark, d).withColumn("m", B.messages(B.base_prompt(), F.col("gold_answer")))
    return q.select("qa_id", F.col("m")[0]["content"].alias("prompt"), F.col("m")[1]["content"].alias("answer"))


@query
def candidate_mentions(spark, d):
    """Phrases of the records, each field on its own, that may name what the graph knows."""
    return _candidates(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _candidates(spark, d):
    return _qa(spark, d).select(F.explode(T.field_mentions("question", "input_molecule_or_context", "task_type", "drug_name", drug="drug_name")).alias("name"))


@query
def label_contexts(spark, d):
    """Passages of the label records' contexts."""
    return _label_rows(spark, d).select(F.col("row").alias("qa_id"), F.array_join(B.label_passages(F.col("context")), "\n\n").alias("passages"), F.size(B.label_passages(F.col("context"), 4)).cast("long").alias("n_used"))


def _label_rows(spark, d):
    r = _rows(spark, d).where("raw_type = 'FDA label context'")
    items = F.transform(F.split(F.coalesce("input", F.lit("")), "\n"), lambda t: F.struct(F.regexp_extract(t, "^([A-Z][A-Za-z ]{2,40}): (.+)$", 1).alias("section_title"), F.when(F.regexp(t, F.lit("^[A-Z][A-Za-z ]{2,40}: .+$")), F.regexp_extract(t, "^([A-Z][A-Za-z ]{2,40}): (.+)$", 2)).otherwise(t).alias("text")))
    return r.select(F.col("qa_id").alias("row"), F.col("qa_id").alias("qid"), "drug_name", items.alias("context"))


def _bank(spark, d):
    f = _facts(spark, d)
    edges = N.capped_edges(N.graph_edges(f), _candidates(spark, d).select("name").distinct(), 10).select("fact_idx")
    raw = f.join(edges, "fact_idx").select(F.col("fact_idx").alias("row"), "relation", F.col("entities")[0].alias("x_name"), F.col("entities")[1].alias("y_name"), F.col("metadata")["x_type"].alias("x_type"), F.col("metadata")["y_type"].alias("y_type"), F.col("metadata")["display_relation"].alias("display_relation"))
    rows = _rows(spark, d).where("source = 'mol_instructions'").withColumn("row", F.col("qa_id"))
    return B.knowledge_bank(B.edge_facts(raw), B.instruction_facts(rows), B.label_facts(_label_rows(spark, d)))


@query
def built_bank(spark, d):
    """Graph, instruction and label facts as one bank, numbered in this order."""
    b = _bank(spark, d)
    return b.select("fact_idx", "id", "source", "source_id", "title", "text", "relation", F.size("aliases").cast("long").alias("n_aliases"), F.size("tokens").cast("long").alias("n_tokens"))


@query
def bank_summary(spark, d):
    """Facts of each family and their total, as one JSON object."""
    g = _facts(spark, d).groupBy().agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.coalesce(F.col("source") == s, F.lit(False))).alias(s) for s in B.FAMILIES))
    return g.select(F.to_json(F.struct(*g.columns)).alias("summary"))


def _wanted(spark, d):
    return _qa(spark, d).select(T.norm_text("drug_name").alias("name")).where("name <> ''").distinct()


@query
def kg_edges_capped(spark, d):
    return N.capped_edges(N.graph_edges(_facts(spark, d)), _wanted(spark, d), 10)


@query
def kg_evidence(spark, d):
    return _long(N.graph_evidence(N.graph_edges(_facts(spark, d)), _wanted(spark, d)), "rank")


@query
def kg_evidence_attached(spark, d):
    """Evidence of the names that a record's text holds: distinct facts, the first six by fact."""
    ev = N.graph_evidence(N.graph_edges(_facts(spark, d)), _wanted(spark, d)).select("name", "fact_idx")
    held = N.contained_names(_qa(spark, d).select("qid", "qtext"), ev.select("name").distinct())
    x = held.join(ev, "name").select("qid", "fact_idx").distinct()
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("fact_idx")).cast("long")).where("rank <= 6")


@query
def molecule_evidence(spark, d):
    return _long(N.same_molecule(_qa(spark, d)), "rank")


@query
def collision_probe(spark, d):
    return N.collisions(_facts(spark, d), least=0.05)


def _probes(spark, d):
    f = _facts(spark, d)
    return B.probes(N.collisions(f, least=0.05), f)


@query
def probe_records(spark, d):
    return _probes(spark, d)[0]


@query
def probe_provenance(spark, d):
    return _probes(spark, d)[1]


@query
def probe_counts(spark, d):
    """Probes by the sources of the right and the wrong fact, and how many differ in relation."""
    p = N.collisions(_facts(spark, d), least=0.05)
    return p.groupBy("gold_source", "decoy_source").agg(F.count(F.lit(1)).alias("n"), F.count_if("distinct_relation").alias("n_distinct"))


# --- scores and reports ------------------------------------------------------------------------


@query
def record_scores(spark, d):
    return _scores(spark, d).select("pred_id", "exact", "normalized_exact", F.round("token_f1", 6).alias("token_f1"), "numeric_match", F.round("utility", 6).alias("utility"))


@query
def eval_summary(spark, d):
    return S.eval_summary(_scores(spark, d), "dataset", "method_name")


@query
def grouping_sets_report(spark, d):
    return S.report_with_totals(_scores(spark, d))


@query
def macro_average(spark, d):
    return S.macro_average(_scores(spark, d))


@query
def weighted_mean(spark, d):
    s = _scores(spark, d).groupBy("method_name", "task_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("numeric_match").cast("double")).alias("numeric"))
    return S.weighted_mean(s, "method_name", "numeric", "n")


@query
def performance_by_type(spark, d):
    s = _scores(spark, d)
    return s.groupBy("model_name", "dataset", "question_type", "method_name", T.half_split(F.col("pred_id").cast("string")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("utility"), 6).alias("utility"))


@query
def policy_select_holdout(spark, d):
    return S.select_policies(_scores(spark, d), T.half_split(F.col("pred_id").cast("string")))


@query
def method_model_pivot(spark, d):
    s = _scores(spark, d)
    return S.cells(s)


@query
def collected_results(spark, d):
    """Result files of each model, data set and method, and a summary table, written and collected again: of a cell that both
    have the table's row counts; the headline is the numeric score where there is one."""
    s = S.eval_summary(_scores(spark, d).where("model_name is not null and dataset is not null and method_name is not null"), "model_name", "dataset", "method_name")
    s = cut(s)
    at = scratch(spark)
    name = F.concat_ws("_", "model_name", "dataset", "method_name", F.lit("raw_test_eval.json"))
    written = s.where("method_name <> 'rrf'").select(name.alias("file"), F.lit(None).cast("string").alias("dataset"), "n", "avg_token_f1", "exact", "numeric_accuracy")
    written.write.partitionBy("file").json(f"{at}/results")
    L.write_csv(s.where("method_name in ('rrf', 'bm25')").select("dataset", F.col("method_name").alias("method"), F.col("model_name").alias("model"), F.lit("raw").alias("variant"), F.lit("").alias("subtask"), "n", F.col("avg_token_f1").alias("token_f1"), "exact", F.col("numeric_accuracy").alias("numeric_acc"), F.lit("summary.csv").alias("file")), f"{at}/summary", ["dataset", "method", "model", "variant", "subtask", "n", "token_f1", "exact", "numeric_acc", "file"])
    schema = "dataset string, n double, avg_token_f1 double, exact double, numeric_accuracy double"
    got = L.read_results(spark, [f"{at}/missing", f"{at}/results"], schema, S.filename_fields(F.regexp_replace("file_name", "^file=", "")))
    rows = got.where("model is not null").select(F.col("data").alias("dataset"), "method", "model", "variant", F.coalesce("dataset", "data").alias("subtask"), "n", F.col("avg_token_f1").alias("token_f1"), "exact", F.col("numeric_accuracy").alias("numeric_acc"), F.lit(0).alias("at"))
    more = L.read_summaries(spark, [f"{at}/summary"]).drop("file").withColumn("at", F.lit(1))
    last = L.keep_last(rows.unionByName(more), ["model", "dataset", "method", "subtask", "variant"], "at")
    return last.select("model", "dataset", "method", "subtask", "variant", F.col("n").cast("long").alias("n"), F.round(S.headline(), 6).alias("headline"), F.when(F.col("at") == 1, "summary").otherwise("file").alias("came_from"))


@query
def zipped_deltas(spark, d):
    """Predictions without and with retrieval, row by row as they come, cut to the shorter, a model and data set."""
    s = _scores(spark, d).where("method_name in ('none', 'hybrid') and model_name is not null and dataset is not null").select("pred_id", "model_name", "dataset", "method_name", "token_f1", "question_type")
    x = B.numbered(s, "at", "model_name", "dataset", "method_name", "pred_id")
    first = x.groupBy("model_name", "dataset", "method_name").agg(F.min("at").alias("start"))
    x = x.join(F.broadcast(first), ["model_name", "dataset", "method_name"]).withColumn("row", F.col("at") - F.col("start"))  # one row a model, data set and method
    a = x.where("method_name = 'none'").select("model_name", "dataset", "row", F.col("token_f1").alias("base"), "question_type")
    b = x.where("method_name = 'hybrid'").select("model_name", "dataset", "row", F.col("token_f1").alias("kb"))
    z = a.join(b, ["model_name", "dataset", "row"])
    return z.groupBy("model_name", "dataset", "question_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("base"), 6).alias("base_f1"), F.round(F.avg("kb"), 6).alias("kb_f1"), F.round(F.avg("kb") - F.avg("base"), 6).alias("delta"))


@query
def closed_and_retrieved(spark, d):
    """Closed-book rows and retrieval rows in one table, counted."""
    s = _scores(spark, d)
    u = s.where("method_name = 'none'").withColumn("origin", F.lit("closed_book")).unionByName(s.where("method_name in ('bm25', 'hybrid', 'kg')").withColumn("origin", F.lit("retrieval")))
    return u.groupBy("origin", "model_name", "method_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("token_f1"), 6).alias("token_f1"))


@query
def file_methods(spark, d):
    """The method in the name of each prediction file."""
    p = table(spark, d, "predictions").select(F.concat_ws("_", "model_name", "dataset", "method_name", F.lit("test.jsonl")).alias("file_name")).distinct()
    return p.select("file_name", S.method_of_file(F.col("file_name")).alias("method"), S.method_family(S.method_of_file(F.col("file_name"))).alias("family"))


@query
def ordering_check(spark, d):
    return S.ordering_check(_scores(spark, d), "bm25", "hybrid", "rrf", 0.05)


@query
def completeness_anti(spark, d):
    return S.missing_cells(_scores(spark, d))


@query
def answer_token_recall(spark, d):
    """Recall of the gold answer's words in the record's own context."""
    q = _qa(spark, d)
    o = S.overlap(q, "qa_id", S.recall_words("input_molecule_or_context"), S.recall_words("gold_answer"))
    return o.select("qa_id", F.round(F.when(F.col("n_b") > 0, F.col("common") / F.col("n_b")).otherwise(0.0), 6).alias("recall"))


@query
def set_recall(spark, d):
    """Share of the distinct gold words that the context has; null where there is no gold word."""
    q = _qa(spark, d)
    g, e = F.array_distinct(S.words("gold_answer", "")), F.array_distinct(S.words("input_molecule_or_context", ""))
    return q.select("qa_id", F.round(F.when(F.size(g) > 0, F.size(F.array_intersect(g, e)) / F.size(g)), 6).alias("recall"))


@query
def multiset_intersection(spark, d):
    p = S.latest(table(spark, d, "predictions"))
    return _long(S.overlap(p, "pred_id", S.words("prediction"), S.words("reference_output")), "n_a", "n_b", "common")


# --- analyses ----------------------------------------------------------------------------------


def _mix(spark, d, by="source"):
    f, q = _facts(spark, d), _items(spark, d)
    found = Q.bm25_topk(q, f)
    return A.source_mix(found, f, q.select("qid", F.concat_ws("|", "dataset", "task_type").alias("grp")), by)


@query
def source_mix(spark, d):
    return _mix(spark, d)


@query
def relation_mix(spark, d):
    return _mix(spark, d, "relation")


@query
def heterogeneity(spark, d):
    f, q = _facts(spark, d), _items(spark, d)
    found = cut(Q.bm25_topk(q, f))
    groups = q.select("qid", F.concat_ws("|", "dataset", "task_type").alias("grp"), "gold_answer", R.question_type().alias("t"))
    allowed = groups.groupBy("grp").agg(F.min("t").alias("t")).select("grp", R.allowed_by_type(F.col("t")).alias("allow"))
    return A.heterogeneity(A.distribution(A.source_mix(found, f, groups.select("qid", "grp"))), allowed=allowed, support=A.source_support(found, f, groups))


@query
def js_divergence(spark, d):
    return A.divergence(A.distribution(_mix(spark, d)))


def _said(spark, d, method):
    """The prediction of a method for each record; of several the last."""
    p = S.latest(table(spark, d, "predictions")).where(F.col("method_name") == method)
    return p.where("qa_id is not null").groupBy(F.col("qa_id").alias("qid")).agg(F.max_by(F.struct("prediction"), "pred_id").alias("x")).select("qid", "x.prediction")


@query
def planning_metrics(spark, d):
    """Planning metrics of the alias method's evidence and predictions, means over the records where each is defined."""
    f, q = _facts(spark, d), _qa(spark, d)
    q = q.withColumn("skill", R.route()).withColumn("allow", R.allowed_sources(F.col("skill")))
    found = cut(Q.retrieve(q, f, "kg", 8, R.skill_table(spark)))
    m = A.planning(found, f, q, _said(spark, d, "kg")).join(q.select("qid", F.col("source").alias("dataset"), "task_type"), "qid")
    return _planning_rows(m, "kg")


PLANNED = ["source_precision", "wrong_source_rate", "source_entropy_bits", "skill_source_agreement", "evidence_recall_at_k", "evidence_utilization"]


def _planning_rows(m, method):
    g = m.groupBy("dataset", "task_type").agg(F.count(F.lit(1)).alias("n_records"), *(F.round(F.avg(c), 4).alias(c) for c in PLANNED))
    return g.withColumn("method", F.lit(method)).withColumn("method_family", S.method_family(F.col("method")))


@query
def family_rollup(spark, d):
    """Uniform and skill methods over the evaluation items, weighted by the records of their strata."""
    f = _facts(spark, d)
    q = cut(_item_records(spark, d).withColumn("skill", R.route()).withColumn("allow", R.allowed_sources(F.col("skill"))))
    rows = None
    for method in ("bm25", "hybrid", "bm25_skillrouted"):
        m = A.planning(cut(Q.retrieve(q, f, method, 8, R.skill_table(spark))), f, q).join(q.select("qid", F.col("source").alias("dataset"), "task_type"), "qid")
        r = _planning_rows(m, method)
        rows = r if rows is None else rows.unionByName(r)
    rows = cut(rows)
    mean = lambda c: F.round(F.sum(F.when(F.col(c).isNotNull(), F.col(c) * F.col("n_records"))) / F.sum(F.when(F.col(c).isNotNull(), F.col("n_records"))), 4).alias(c)
    return rows.groupBy("method_family").agg(F.sum("n_records").alias("n"), *(mean(c) for c in PLANNED[:2] + PLANNED[3:5]))


@query
def source_support(spark, d):
    f, q = _facts(spark, d), _items(spark, d)
    return A.source_support(Q.bm25_topk(q, f), f, q.select("qid", F.concat_ws("|", "dataset", "task_type").alias("grp"), "gold_answer"))


@query
def best_sources(spark, d):
    """The source that supports the answers of each group best; ties go to the first of the four."""
    order = F.array_position(F.array(*map(F.lit, R.SOURCES)), F.col("source"))
    g = source_support(spark, d).groupBy("grp").agg(F.max_by(F.struct("source", "mean_gold_token_recall", "n"), F.struct("mean_gold_token_recall", -order)).alias("x"))
    return g.select("grp", F.col("x.source").alias("best_source"), F.col("x.mean_gold_token_recall").alias("recall"), "x.n")


@query
def source_shares(spark, d):
    """Shares of the sources in each group's evidence, by facts an example times examples."""
    m = _mix(spark, d).withColumn("v", F.col("avg_facts") * F.col("examples_with_evidence")).where(F.col("source").isin(R.SOURCES))
    total = F.sum("v").over(Window.partitionBy("grp"))  # four sources a group
    return m.select("grp", "source", F.round(F.when(total > 0, F.col("v") / total).otherwise(0.0), 6).alias("share"))


@query
def utility_matrix(spark, d):
    """Mean utility of question types and methods over models, centred by the type's mean, and whether a method is the best."""
    s = _scores(spark, d).groupBy("dataset", "question_type", "method_name", "model_name").agg(F.avg("utility").alias("u"))
    m = s.groupBy("dataset", "question_type", "method_name").agg(F.round(F.avg("u"), 6).alias("utility"))
    row = Window.partitionBy("dataset", "question_type")  # one row a method
    best = F.row_number().over(row.orderBy(F.col("utility").desc(), "method_name")) == 1
    return m.select("dataset", "question_type", "method_name", "utility", F.round(F.col("utility") - F.avg("utility").over(row), 5).alias("centred"), best.alias("is_best"))


@query
def policy_gains(spark, d):
    """The three largest and the three smallest gains over the lexical method of each model."""
    x = method_deltas(spark, d).where("f1_delta is not null")
    top = Window.partitionBy("model_name").orderBy(F.col("f1_delta").desc(), "question_type", "method_name")
    low = Window.partitionBy("model_name").orderBy(F.col("f1_delta"), "question_type", "method_name")
    r = x.withColumn("place", F.row_number().over(top).cast("long")).where("place <= 3").withColumn("end", F.lit("top"))
    return r.unionByName(x.withColumn("place", F.row_number().over(low).cast("long")).where("place <= 3").withColumn("end", F.lit("bottom"))).select("model_name", "end", "place", "question_type", "method_name", "f1_delta")


@query
def field_coverage(spark, d):
    return A.field_coverage(table(spark, d, "qa_records"), "source")


@query
def task_inventory(spark, d):
    q = cut(_with_evidence(spark, d))
    size = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))
    by = ["source", "task_type", "input_type"]
    shapes = q.groupBy(*by, T.answer_shape("gold_answer").alias("shape")).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(T.counter_cell("shape", "c").alias("answer_shapes"))
    rest = q.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.col("decoded_smiles") != "", F.lit(False)).cast("double")), 4).alias("with_smiles"), F.round(F.avg(F.coalesce(F.col("drug_name") != "", F.lit(False)).cast("double")), 4).alias("with_drug"), F.round(F.avg(F.col("graph").cast("double")), 4).alias("with_graph"), F.round(F.avg(F.col("molecule").cast("double")), 4).alias("with_molecule"), F.round(F.avg(size("question").cast("double")), 4).alias("question_words"), F.round(F.avg(size("gold_answer").cast("double")), 4).alias("answer_words"))
    skills = q.groupBy(*by, R.route_analysis().alias("skill")).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(T.counter_cell("skill", "c").alias("candidate_skills"))
    for part, mark in ((shapes, "_a"), (skills, "_b")):
        part = part.withColumnsRenamed({c: c + mark for c in by})
        rest = rest.join(part, [F.col(c).eqNullSafe(F.col(c + mark)) for c in by])
    return rest.select(*by, "n", "with_smiles", "with_drug", "with_graph", "with_molecule", "question_words", "answer_words", "answer_shapes", "candidate_skills")


@query
def answer_shape_counts(spark, d):
    """The counter cells of the inventory, read back and summed."""
    q = _qa(spark, d)
    by = ["source", "task_type", "input_type"]
    t = q.groupBy(*by, T.answer_shape("gold_answer").alias("shape")).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(T.counter_cell("shape", "c").alias("answer_shapes")).select(F.explode(T.parse_counter("answer_shapes")).alias("x"))
    return t.groupBy(F.col("x.k").alias("shape")).agg(F.sum("x.n").alias("n"))


def _cluster_text():
    """Fields as words, the slots that are filled, and the first 500 signs of the context."""
    no = F.lit(False)
    name = lambda k, c: F.concat(F.lit(f"{k}="), F.coalesce(c, F.lit("")))
    slots = [F.when(v, F.lit(f"has_{k}")) for k, v in R.data_slots(no, no).items()]
    return F.concat_ws(" ", name("source", F.col("source")), name("task", F.col("task_type")), name("input_type", F.col("input_type")), name("answer_shape", T.answer_shape("gold_answer")), *slots, "question", "task_type", "input_type", F.substring("input_molecule_or_context", 1, 500))


@query
def cluster_texts(spark, d):
    return _qa(spark, d).select("qa_id", _cluster_text().alias("text"))


@query
def text_cluster_quality(spark, d):
    """Clusters of the records' texts, as many as there are analysed skills, each with its top skill, and how well they agree."""
    q = cut(_qa(spark, d).select("qid", R.route_analysis().alias("skill"), _cluster_text().alias("text")))
    k = q.select("skill").distinct().count()  # at most nine
    c = cut(A.text_clusters(q.select("qid", "text"), k).join(q.select("qid", "skill"), "qid"))
    whole = A.cluster_quality(c).select("nmi", "ari").crossJoin(c.select("explained").limit(1))  # one row each
    return A.cluster_rows(c).crossJoin(F.broadcast(whole))


@query
def routing_agreement(spark, d):
    """How well the older routes, taken as clusters, agree with the analysed skills."""
    q = _qa(spark, d).select(R.route_legacy().alias("cluster"), R.route_analysis().alias("skill"))
    return A.cluster_quality(q)


@query
def routing_clusters(spark, d):
    q = _qa(spark, d).select(R.route_legacy().alias("cluster"), R.route_analysis().alias("skill"))
    return A.cluster_rows(q)


@query
def item_inventory(spark, d):
    """The first record of each data set and question type, and how many there are."""
    i = table(spark, d, "eval_items").withColumn("question_type", R.question_type())
    g = i.groupBy("dataset", "question_type").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("item_id", "task_type"), "item_id").alias("x"))
    return g.select("dataset", "question_type", "n", F.col("x.item_id").alias("first_item"), "x.task_type")


@query
def arrivals(spark, d):
    return arrival_counts(_facts(spark, d))


@query
def slot_fill_status(spark, d):
    """Required slots of each record that its input and its routed evidence fill."""
    f, s = _facts(spark, d), R.skill_table(spark)
    q = _qa(spark, d).withColumn("skill", R.route())
    found = Q.retrieve(q, f, "bm25_skillrouted", 3, s)
    ev = found.join(f.select("fact_idx", "source", "relation"), "fact_idx").groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.coalesce(F.col("source") == "fdarxbench_label", F.lit(False)) | F.coalesce(F.col("relation") == "label_context", F.lit(False)))).alias("label"),
        F.max(F.coalesce(F.col("source").isin("primekg", "drugchat_pubchem", "drugchat_chembl"), F.lit(False))).alias("fact"),
    )
    x = q.join(ev, "qid", "left")
    no = F.lit(False)
    has = lambda c: F.coalesce(F.col(c) != "", no)
    kind, task, question = F.coalesce("input_type", F.lit("")), F.coalesce(T.norm_text("task_type"), F.lit("")), F.coalesce(T.norm_text("question"), F.lit(""))
    label = F.coalesce("label", no)
    first = ((kind == "FDA label context") & has("input_molecule_or_context")) | label
    checks = {
        "label_context": first, "label_context_primary": first, "label_context_secondary": label & (F.coalesce("n", F.lit(0)) >= 2),
        "molecule_structure": has("decoded_smiles") | kind.isin("SELFIES", "SMILES"), "property_definition": task.contains("property") | question.contains("property"),
        "design_requirement": F.coalesce(F.trim("input_molecule_or_context") != "", no), "question_entities": F.coalesce(F.trim("question") != "", no), "biomedical_fact": F.coalesce("fact", no),
    }
    m = F.create_map(*[y for k, v in checks.items() for y in (F.lit(k), v)])
    x = x.join(F.broadcast(s.select("skill", "required_slots")), "skill").withColumn("m", m)
    filled = F.filter("required_slots", lambda r: F.element_at("m", r))
    return x.select("qa_id", "skill", F.array_join(filled, ",").alias("filled_slots"), F.array_join(F.array_except("required_slots", filled), ",").alias("missing_slots"), (F.size(filled) == F.size("required_slots")).alias("all_required_filled"))


@query
def method_deltas(spark, d):
    """What each method gives over the lexical one, a model and question type."""
    m = _scores(spark, d).groupBy("model_name", "question_type", "method_name").agg(F.count(F.lit(1)).alias("n"), F.avg("token_f1").alias("f"), F.avg(F.col("numeric_match").cast("double")).alias("x"))
    base = m.where("method_name = 'bm25'").select("model_name", "question_type", F.col("f").alias("bf"), F.col("x").alias("bx"))
    return m.where("method_name <> 'bm25'").join(base, ["model_name", "question_type"]).select("model_name", "question_type", "method_name", "n", F.round(F.col("f") - F.col("bf"), 6).alias("f1_delta"), F.round(F.col("x") - F.col("bx"), 6).alias("numeric_delta"))


# --- variants and splits -----------------------------------------------------------------------


@query
def noise_injected(spark, d):
    return _long(V.noise(_facts(spark, d), 0.5), "n_tokens")


@query
def decoys_made(spark, d):
    x = V.decoys(_facts(spark, d), 2, 0.3).withColumn("decoy_of", F.col("metadata")["decoy_of"]).withColumn("n_flags", F.size("metadata"))
    return _long(x.drop("metadata"), "copy", "n_tokens", "n_flags")


@query
def perturbed_counts(spark, d):
    f = _facts(spark, d)
    both = V.perturbed(f, "noisy").withColumn("mode", F.lit("noisy")).unionByName(V.perturbed(f, "decoy").withColumn("mode", F.lit("decoy")))
    return both.groupBy("mode", "source", "injected").agg(F.count(F.lit(1)).alias("n"))


@query
def split_by_hash(spark, d):
    return V.split_by_hash(_qa(spark, d), "qa_id", "task_type", 50, 10)


@query
def identity_holdout(spark, d):
    return V.identity_holdout(_qa(spark, d), "qa_id", V.identity_key("drug_name", "decoded_smiles"))


@query
def disjoint_proof(spark, d):
    return V.split_summary(cut(identity_holdout(spark, d)))


@query
def skill_holdout(spark, d):
    q = _qa(spark, d).withColumn("skill", R.route())
    x = q.select("qa_id", F.col("skill").alias("identity"), F.when(F.col("skill") == "molecule_design", "test").otherwise("train").alias("split"))
    return V.split_summary(x)


@query
def source_holdout(spark, d):
    x = _qa(spark, d).select("qa_id", F.col("source").alias("identity"), F.when(F.col("source") == "fdarxbench", "test").otherwise("train").alias("split"))
    return V.split_summary(x)
