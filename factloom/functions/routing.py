"""Routing of records to skills, and the table of skills. The tables are configuration: every function takes its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import col, metric_text, norm_text, sha1_bucket

# Skills with their sources, relations and evidence budgets, cues, and confusions.
_DRUGCHAT = ["drugchat_pubchem", "drugchat_chembl"]
_OPEN = "indication,off-label use,contraindication,drug_protein,disease_protein,drug_effect,drug_drug,disease_phenotype_positive,disease_phenotype_negative,instruction_fact,label_context".split(",")
SKILLS = {
    "fda_label_factual": (["fdarxbench_label"], ["label_context"], 3, ["label_context"], "short_label_grounded_answer", ["Locate the label section relevant to the question.", "Extract the exact fact asked for (event, dose, contraindication, population, ...).", "Answer concisely, grounded only in the label text."]),
    "fda_label_multihop": (["fdarxbench_label"], ["label_context"], 4, ["label_context_primary", "label_context_secondary"], "synthesized_label_answer", ["Identify the two or more label sections the question connects.", "Extract the key fact from each section.", "Combine them into one coherent, grounded answer."]),
    "molecule_property_numeric": (_DRUGCHAT, ["instruction_fact"], 3, ["molecule_structure", "property_definition"], "numeric_or_short_property_value", ["Read the molecular structure from the SELFIES/SMILES string.", "Identify the requested property (e.g., HOMO-LUMO gap, logP).", "Use similar retrieved molecules as reference, then give the numeric value only."]),
    "molecule_description": (_DRUGCHAT, ["instruction_fact"], 3, ["molecule_structure"], "natural_language_description", ["Parse the structure: identify its class, functional groups, or natural-product source.", "Use similar retrieved compound facts as reference.", "Write a concise natural-language description."]),
    "molecule_design": (_DRUGCHAT, ["instruction_fact"], 3, ["design_requirement"], "molecule_string", ["Read the design requirement (role, class, scaffold, target property).", "Recall similar molecules from the retrieved compound facts.", "Output a molecule string (SELFIES) that satisfies the requirement."]),
    "biomedical_open_qa": (["primekg", *_DRUGCHAT, "fdarxbench_label"], _OPEN, 3, ["question_entities", "biomedical_fact"], "concise_biomedical_answer", ["Identify the biomedical entities in the question (drug, disease, protein, pathway).", "Retrieve the relevant relations/facts for those entities.", "Answer concisely from the retrieved facts."]),
}
CUES = [
    ("molecule_design", ["design", "generate a molecule", "synthesize", "create a molecule", "propose a molecule"]),
    ("molecule_property_numeric", ["logp", "molecular weight", "homo-lumo", "how many", "predict the", "solubility", "what is the value"]),
    ("molecule_description", ["describe", "description", "what type of molecule", "what kind of molecule"]),
]
LABEL_CUES = ["contraindicat", "indicat", "dosage", "dose", "adverse", "warning", "label", "boxed", "black box"]
JOINT_CUES = [" and ", " both ", "combined", "as well as", "in addition", "along with"]
CONFUSED = {
    "fda_label_factual": "fda_label_multihop",
    "fda_label_multihop": "fda_label_factual",
    "molecule_property_numeric": "molecule_description",
    "molecule_description": "molecule_property_numeric",
    "molecule_design": "molecule_description",
    "biomedical_open_qa": "fda_label_factual",
}
# Heads of the parts of a skill prompt.
SKILL_EVIDENCE = "Skill-based retrieved knowledge:"
STEPS_HEAD = "How to solve:"
CONTEXT_HEAD = "Known information:"
SOURCES = ["primekg", "drugchat_pubchem", "drugchat_chembl", "fdarxbench_label"]


def skill_table(spark: SparkSession, skills: dict = SKILLS) -> DataFrame:
    """skill, sources, relations, top_k, required_slots, answer_format, steps; one row a skill."""
    rows = [(k, *v) for k, v in skills.items()]
    return spark.createDataFrame(rows, "skill string, sources array<string>, relations array<string>, top_k int, required_slots array<string>, answer_format string, steps array<string>")


def _any(c: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | c.contains(w)
    return test


def _fields(source, task, question, kind):
    s = F.coalesce(col(source), F.lit(""))
    return s, F.coalesce(norm_text(task), F.lit("")), F.coalesce(norm_text(question), F.lit("")), F.coalesce(col(kind), F.lit(""))


def route(source="source", task="task_type", question="question", kind="input_type") -> Column:
    """Six skills from the record's own fields: label questions, then property before design before description."""
    s, t, q, k = _fields(source, task, question, kind)
    label = (s == "fdarxbench") | (k == "FDA label context")
    return (
        F.when(label & (t == "multihop"), "fda_label_multihop").when(label, "fda_label_factual")
        .when(t.contains("property") | q.contains("molecular weight") | q.contains("logp"), "molecule_property_numeric")
        .when(t.contains("description guided") | t.contains("design") | q.contains("synthesize"), "molecule_design")
        .when(t.contains("molecular description") | q.contains("describe"), "molecule_description")
        .otherwise("biomedical_open_qa")
    )


def route_legacy(source="source", task="task_type", question="question", kind="input_type") -> Column:
    """Five skills; design before description before property."""
    s, t, q, k = _fields(source, task, question, kind)
    return (
        F.when((s == "fdarxbench") | (k == "FDA label context"), "fda_label_qa")
        .when(t.contains("description guided") | q.contains("synthesize") | t.contains("design"), "molecule_design")
        .when(t.contains("molecular description") | q.contains("describe"), "molecule_description")
        .when(t.contains("property") | q.contains("molecular weight") | q.contains("logp"), "molecule_property")
        .otherwise("biomedical_open_qa")
    )


def route_analysis(source="source", task="task_type", question="question", kind="input_type") -> Column:
    """Nine skills, on text without punctuation; refusals, relations and empty questions have their own."""
    s, k = F.coalesce(col(source), F.lit("")), F.coalesce(col(kind), F.lit(""))
    t, q = metric_text(task, "None"), metric_text(question, "None")
    label = (s == "fdarxbench") | (k == "FDA label context")
    return (
        F.when(label & (t == "multihop"), "fda_label_multihop").when(label & ((t == "refusal") | (k == "none")), "fda_label_refusal").when(label, "fda_label_factual")
        .when(t.contains("property") | q.contains("molecular weight") | q.contains("logp"), "molecule_property_numeric")
        .when(t.contains("description guided") | t.contains("design") | q.contains("synthesize"), "molecule_design")
        .when(t.contains("molecular description") | q.contains("describe"), "molecule_description")
        .when(_any(q, ["contraindication", "indication", "interact", "target", "protein", "side effect"]), "drug_relation_qa")
        .when(q == "", "unsupported_or_low_evidence")
        .otherwise("biomedical_open_qa")
    )


def route_question(question="question") -> Column:
    """Cues of the question alone decide."""
    q = F.coalesce(norm_text(question), F.lit(""))
    out = F
    for skill, words in CUES:
        out = out.when(_any(q, words), skill)
    return out.when(_any(q, LABEL_CUES) & _any(q, JOINT_CUES), "fda_label_multihop").when(_any(q, LABEL_CUES), "fda_label_factual").otherwise("biomedical_open_qa")


def route_random(key: Column | str, names: list[str] = list(SKILLS)) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), sha1_bucket(key, len(names)) + 1)


def route_wrong(skill: Column, confused: dict[str, str] = CONFUSED) -> Column:
    out = F
    for a, b in confused.items():
        out = out.when(skill == a, b)
    return out.otherwise("biomedical_open_qa")


def routed(override: str = "none", key: str = "id") -> Column:
    """The skill under an override: none or oracle (own fields), predicted (question only), random, wrong."""
    if override in ("none", "oracle"):
        return route()
    if override == "predicted":
        return route_question()
    if override == "random":
        return route_random(key)
    if override == "wrong":
        return route_wrong(route())
    raise ValueError(f"no such override: {override}")


ABLATABLE = {"skill_id", "solving_steps", "answer_format", "evidence_org", "source_routing"}


def parse_ablate(spec: str) -> frozenset[str]:
    """Components to leave out, as a comma list; unknown ones are an error."""
    wanted = frozenset(x.strip() for x in spec.split(",") if x.strip()) - {"none"}
    if wanted - ABLATABLE:
        raise ValueError(f"unknown components: {sorted(wanted - ABLATABLE)}")
    return wanted


def question_type(dataset="dataset", task="task_type") -> Column:
    t, d = metric_text(task, ""), F.coalesce(col(dataset), F.lit(""))
    return (
        F.when((d == "fdarxbench") & (t == "factual"), "fda_factual").when((d == "fdarxbench") & (t == "multihop"), "fda_multihop").when((d == "fdarxbench") & (t == "refusal"), "fda_refusal").when(d == "fdarxbench", "fda_other")
        .when(t.contains("description guided") | t.contains("design"), "molecule_design").when(t.contains("molecular description"), "molecule_description").when(t.contains("property"), "molecule_property")
        .otherwise("biomedical_open_qa")
    )


def allowed_sources(skill: Column, skills: dict = SKILLS) -> Column:
    """Sources of the skill; all for an unknown one."""
    out = F
    for name, spec in skills.items():
        out = out.when(skill == name, F.array(*map(F.lit, spec[0])))
    return out.otherwise(F.array(*map(F.lit, SOURCES)))


# The skill that a question type asks for, and the slots that an analysed skill needs.
SKILL_OF_TYPE = {
    "fda_factual": "fda_label_factual", "fda_multihop": "fda_label_multihop", "fda_refusal": "fda_label_factual", "molecule_property": "molecule_property_numeric",
    "molecule_description": "molecule_description", "molecule_design": "molecule_design", "biomedical_open_qa": "biomedical_open_qa",
}
ANALYSIS_SLOTS = {
    "fda_label_factual": ["label_context"], "fda_label_multihop": ["label_context_primary", "label_context_secondary"], "fda_label_refusal": ["label_context_check", "unsupported_flag"],
    "molecule_property_numeric": ["molecule_structure", "property_definition"], "molecule_description": ["molecule_structure"], "molecule_design": ["design_requirement"],
    "drug_relation_qa": ["question_entities", "relation_fact"], "biomedical_open_qa": ["question_entities", "biomedical_fact"],
}
NO_SLOTS = ["evidence_absence_reason"]


def allowed_by_type(question_type: Column) -> Column:
    """Sources of the skill that a question type asks for; all for an unknown one."""
    out = F
    for t, skill in SKILL_OF_TYPE.items():
        out = out.when(question_type == t, F.array(*map(F.lit, SKILLS[skill][0])))
    return out.otherwise(F.array(*map(F.lit, SOURCES)))


def analysis_slots(skill: Column) -> Column:
    out = F
    for name, slots in ANALYSIS_SLOTS.items():
        out = out.when(skill == name, F.array(*map(F.lit, slots)))
    return out.otherwise(F.array(*map(F.lit, NO_SLOTS)))


def data_slots(graph: Column, molecule: Column) -> dict[str, Column]:
    """Which slots a record fills by itself; graph and molecule say whether it has evidence of that kind."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    task, question, kind = metric_text("task_type", ""), metric_text("question", ""), F.coalesce("input_type", F.lit(""))
    label = (kind == "FDA label context") & has("input_molecule_or_context")
    return {
        "label_context": label, "label_context_primary": label, "label_context_secondary": task == "multihop", "label_context_check": F.coalesce(F.col("source") == "fdarxbench", F.lit(False)),
        "unsupported_flag": (task == "refusal") | (kind == "none"), "molecule_structure": has("decoded_smiles") | kind.isin("SELFIES", "SMILES"),
        "property_definition": task.contains("property") | question.contains("molecular weight") | question.contains("logp"), "design_requirement": has("input_molecule_or_context") & task.contains("design"),
        "question_entities": has("question"), "biomedical_fact": graph | molecule, "relation_fact": graph, "evidence_absence_reason": ~(graph | molecule),
    }
