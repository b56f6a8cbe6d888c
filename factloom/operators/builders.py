"""Building records, facts and prompts: instruction rows, label rows and graph edges become one numbered knowledge bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import fact_text, input_type, norm_text, present, probable_smiles, stable_id, strip, token_set
from factloom.storage import cut

# Lines and labels of prompts and facts, tasks of sources without one, and the fields that name a compound.
HEAD = [
    "You are answering a drug and molecular QA task with external knowledge.", "",
    "Use the provided information to answer the question. If the answer is not available, respond: Information not found!", "",
    "Answer in the same style as the gold answer.",
]
CONTEXT_LABEL = ("Label/context evidence", "Input")
EVIDENCE_HEAD = "Retrieved KB evidence:"
NO_EVIDENCE = "No KB evidence retrieved."
TASKS = {"drugchat_chembl": "drug property QA", "drugchat_pubchem": "drug description QA"}
NAMING = ["cid", "CID", "chembl_id", "molecule_chembl_id", "drug_name", "name"]
ANSWERING = ["object", "tail", "value", "answer"]
FAMILIES = ["primekg", "drugchat_chembl", "drugchat_pubchem", "fdarxbench_label"]
FACT_COLUMNS = ["id", "source", "source_id", "title", "text", "aliases", "relation", "tokens"]


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with a dense number from 0 in the order of the columns, which must be unique.

    Rows are sorted by ranges over all tasks; only the number of rows of each range comes to the driver.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in parts.groupBy("_part").agg(F.count(F.lit(1))).collect()}
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    if not start:
        return parts.withColumn(name, F.lit(0).cast("long")).drop("_part")
    offset = F.create_map(*[F.lit(x) for p, n in start.items() for x in (p, n)])[F.col("_part")]
    return parts.withColumn(name, (offset + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).cast("long")).drop("_part")


def task_of(source: str = "source", metadata: str = "metadata") -> Column:
    """The task that the metadata name, else that of the source, else the source."""
    named = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])
    return F.coalesce(present(F.col(metadata)["task"]), named[F.col(source)], F.col(source))


def instruction_records(rows: DataFrame) -> DataFrame:
    """Records of instruction rows (source, source_index, instruction, input, output, metadata) with rest of their columns."""
    said, given = strip(F.coalesce("instruction", F.lit(""))), strip(F.coalesce("input", F.lit("")))
    x = rows.withColumns({"question": said, "input_molecule_or_context": given})
    x = x.withColumns({"id": stable_id("source", "source_index", "question", "input_molecule_or_context", "output"), "input_type": input_type("source", "input_molecule_or_context"), "task_type": task_of()})
    return x.withColumnRenamed("output", "gold_answer").drop("instruction", "input")


def official_pool(records: DataFrame, key: str, split: Column, first: int) -> DataFrame:
    """key, source, pool: all rows of the official test split, and of each source the first other rows in file order.

    Of a source only its first rows are ranked, so a large source costs no more than a pass.
    """
    x = records.select(key, "source", F.col("source_index").try_cast("long").alias("at"), F.col("source_index").cast("string").alias("name"), (F.coalesce(split, F.lit("train")) == "test").alias("is_test"))
    w = Window.partitionBy("source").orderBy(F.col("at").asc_nulls_last(), "name", key)
    train = x.where("not is_test").withColumn("r", F.row_number().over(w)).where(F.col("r") <= first)
    return train.select(key, "source", F.lit("train").alias("pool")).unionByName(x.where("is_test").select(key, "source", F.lit("test").alias("pool")))


def label_passages(context: Column, most: int | None = None) -> Column:
    """"title: text", or the text, of each section of a label context (array of section_title, text); others are left out."""
    items = F.slice(context, 1, most) if most else context
    title, text = (lambda c: strip(F.coalesce(c["section_title"], F.lit("")))), (lambda c: strip(F.coalesce(c["text"], F.lit(""))))
    return F.filter(F.transform(items, lambda c: F.when(title(c) != "", F.concat(title(c), F.lit(": "), text(c))).otherwise(text(c))), lambda t: t != "")


def _finished(facts: DataFrame) -> DataFrame:
    x = facts.withColumn("id", stable_id("source", "title", "text"))
    return x.withColumn("tokens", token_set(fact_text())).select("row", *FACT_COLUMNS)


def edge_facts(edges: DataFrame) -> DataFrame:
    """Facts of graph edges: row, relation, x_name, y_name, x_type, y_type, display_relation."""
    shown = F.coalesce(present("display_relation"), "relation")
    none = lambda c: F.coalesce(c, F.lit("None"))
    arrow = F.concat(F.lit(" --"), shown, F.lit("--> "))
    text = F.concat(F.lit("PrimeKG relation: "), "x_name", F.lit(" ("), none("x_type"), F.lit(")"), arrow, "y_name", F.lit(" ("), none("y_type"), F.lit(")."))
    x = edges.select("row", F.lit("primekg").alias("source"), F.concat_ws("|", "x_name", "relation", "y_name").alias("source_id"), F.concat("x_name", arrow, "y_name").alias("title"), text.alias("text"), F.array("x_name", "y_name").alias("aliases"), "relation")
    return _finished(x)


def instruction_facts(rows: DataFrame) -> DataFrame:
    """Facts of instruction rows: row, source, source_index, instruction, input, output, metadata."""
    said, given, answer = (strip(F.coalesce(c, F.lit(""))) for c in ("instruction", "input", "output"))
    names = F.array(F.when(probable_smiles(given), given), *(present(F.col("metadata")[k]) for k in NAMING))
    title = F.coalesce(present(F.substring(said, 1, 180)), F.concat("source", F.lit(" fact")))
    text = F.concat(F.lit("Question: "), said, F.lit("\nInput: "), given, F.lit("\nAnswer: "), answer)
    x = rows.select("row", "source", F.concat("source", F.lit(":"), "source_index").alias("source_id"), title.alias("title"), text.alias("text"), F.array_compact(names).alias("aliases"), F.lit("instruction_fact").alias("relation"))
    return _finished(x)


def label_facts(rows: DataFrame, most: int = 4) -> DataFrame:
    """Facts of label rows (row, qid, drug_name, context) with up to `most` passages; a row without any gives none."""
    drug = strip(F.coalesce("drug_name", F.lit("")))
    x = rows.withColumn("p", label_passages(F.col("context"), most)).where(F.size("p") > 0)
    aliases = F.when(drug != "", F.array(drug)).otherwise(F.array().cast("array<string>"))
    x = x.select("row", F.lit("fdarxbench_label").alias("source"), F.col("qid").cast("string").alias("source_id"), F.concat(F.lit("FDA label evidence for "), drug).alias("title"), F.array_join("p", "\n\n").alias("text"), aliases.alias("aliases"), F.lit("label_context").alias("relation"))
    return _finished(x)


def knowledge_bank(*families: DataFrame) -> DataFrame:
    """fact_idx and the facts of all families, numbered in the order of the families and of their rows."""
    every = None
    for i, f in enumerate(families):
        f = f.withColumn("family", F.lit(i))
        every = f if every is None else every.unionByName(f)
    return numbered(every, "fact_idx", "family", "row").drop("row")


def alias_lists(facts: DataFrame, size: int = 1000) -> DataFrame:
    """alias, part, fact_ids (sorted, distinct) of each normalised alias. An alias of very many facts has several parts of
    about `size` ids, by the first digits of the ids, so that no list grows with the table."""
    a = facts.select(F.explode("aliases").alias("a"), stable_id("source", "title", "text").alias("fid")).select(norm_text("a").alias("alias"), "fid").where("alias <> ''").distinct()
    parts = a.groupBy("alias").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    part = F.floor(F.conv(F.substring("fid", 1, 4), 16, 10).cast("long") * F.col("parts") / 65536).cast("long")
    return a.join(parts, "alias").groupBy("alias", part.alias("part")).agg(F.array_join(F.sort_array(F.collect_list("fid")), ",").alias("fact_ids"))


def prompt(*blocks: Column, question: str = "question") -> Column:
    """The head, each block that is not null, and the question, joined by line ends."""
    none = F.array().cast("array<string>")
    lines = F.concat(F.array(*map(F.lit, HEAD)), *(F.when(b.isNotNull(), F.array(F.lit(""), b)).otherwise(none) for b in blocks))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("None")), F.lit("\nAnswer:"))


def context_block(context: str = "input_molecule_or_context", source: str = "source") -> Column:
    label = F.when(F.coalesce(F.col(source) == "fdarxbench", F.lit(False)), CONTEXT_LABEL[0]).otherwise(CONTEXT_LABEL[1])
    return F.concat(label, F.lit(":\n"), present(context))


def base_prompt() -> Column:
    return prompt(context_block())


def evidence_prompt(block: str = "block") -> Column:
    """The base prompt with the evidence that a retriever found."""
    return prompt(context_block(), F.concat(F.lit(EVIDENCE_HEAD + "\n"), F.coalesce(block, F.lit(NO_EVIDENCE))))


def messages(text: Column, answer: Column) -> Column:
    """A user's and an assistant's turn."""
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    return F.array(turn("user", text), turn("assistant", F.trim(F.coalesce(answer, F.lit("")))))


def provisional_answer(metadata: Column, text: Column) -> Column:
    """The first value that the metadata have, else the text."""
    return strip(F.coalesce(*(present(metadata[k]) for k in ANSWERING), text, F.lit("")))


def probes(pairs: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, provenance) of collisions, numbered in the order of their names. The sources stay out of the records."""
    f = facts.select(F.col("fact_idx").alias("gold_idx"), provisional_answer(F.col("metadata"), F.col("text")).alias("gold_answer"), F.col("relation").alias("gold_relation"))
    g = facts.select(F.col("fact_idx").alias("decoy_idx"), F.col("relation").alias("decoy_relation"))
    x = numbered(pairs.join(f, "gold_idx").join(g, "decoy_idx"), "source_index", "alias").withColumn("id", F.format_string("necessity_%05d", "source_index"))
    empty = x.withColumns({"input_molecule_or_context": F.lit(""), "source": F.lit("necessity_probe")})
    records = empty.select("id", "source", "source_index", "question", "input_molecule_or_context", F.lit("none").alias("input_type"), "gold_answer", F.lit("necessity_probe").alias("task_type"), F.col("alias").alias("drug_name"), base_prompt().alias("prompt"))
    return records, x.select("id", F.col("alias").alias("collision_alias"), "gold_source", "decoy_source", "gold_idx", "decoy_idx", "gold_relation", "decoy_relation", "similarity", "distinct_relation", F.lit(False).alias("validated"))
