"""Queries of the training-data operators; each takes (spark, directory of tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm.bpe import count_tokens, encode
from factloom.llm.defects import defects, one_defect
from factloom.llm.leaks import leak_report, leaks, remove_leaks
from factloom.llm.overlap import overlap_pairs, overlap_report
from factloom.llm.packing import containers, pack_texts
from factloom.llm.pii import personal_information, redacted
from factloom.llm.splits import assign_splits, linked_groups
from factloom.llm.vectors import neighbour_rows, neighbours, similar_pairs
from factloom.storage import table


def p1_found(spark, d):
    return similar_pairs(neighbours(table(spark, d, "fact_vectors"))).select("fact_a", "fact_b")


def p1_neighbours(spark, d):
    return neighbour_rows(neighbours(table(spark, d, "fact_vectors")))


def p2_found(spark, d):
    return linked_groups(table(spark, d, "qa_records")).where("group_id <> qa_id")


def p2_splits(spark, d):
    return assign_splits(table(spark, d, "qa_records"))


def p3_found(spark, d):
    return overlap_pairs(table(spark, d, "qa_records")).select("qa_a", "qa_b")


def p3_report(spark, d):
    return overlap_report(table(spark, d, "qa_records"))


def p4_found(spark, d):
    return one_defect(defects(table(spark, d, "predictions")))


def p4_labels(spark, d):
    return defects(table(spark, d, "predictions"))


def p6_found(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_report(spark, d):
    return leak_report(leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p6_cleaned(spark, d):
    return remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_ids(spark, d):
    return encode(table(spark, d, "documents"))


def p7_tokens_by_language(spark, d):
    docs = table(spark, d, "documents")
    n = count_tokens(docs.withColumn("key", F.struct(F.lower("lang").alias("lang"))), key="key")
    return n.groupBy(F.col("key.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p8_containers(spark, d):
    return pack_texts(table(spark, d, "documents"))


def p8_room(spark, d):
    return containers(pack_texts(table(spark, d, "documents")))


def p9_found(spark, d):
    return personal_information(table(spark, d, "documents"), table(spark, d, "given_names")).select("doc_id", "pii_type", "pii_value")


def p9_redacted(spark, d):
    return redacted(table(spark, d, "documents"), table(spark, d, "given_names"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_neighbours, p2_found, p2_splits, p3_found, p3_report, p4_found, p4_labels, p6_found, p6_report, p6_cleaned, p7_ids, p7_tokens_by_language, p8_containers, p8_room, p9_found, p9_redacted)
}
