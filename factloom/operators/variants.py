"""Perturbed knowledge banks and deterministic splits. What is random elsewhere is an order by a hash here, so results
do not depend on the number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import norm_text, token_set
from factloom.operators.hotkeys import key_quantiles

# Parts of made-up distractors and what decoys add to a text.
SUBJECTS = ["compound", "receptor", "pathway", "enzyme", "metabolite", "transporter", "ligand", "isoform", "assay", "biomarker", "cofactor", "substrate"]
PREDICATES = ["is associated with", "modulates", "is co-expressed with", "inhibits", "shares a scaffold with", "is annotated for", "is upregulated in", "has been reported alongside"]
OBJECTS = ["the mitochondrial matrix", "an orphan GPCR", "a phase-II conjugate", "the cytochrome P450 family", "a lysosomal disorder", "an off-target kinase", "a synthetic analogue", "an unrelated tissue panel"]
TITLE_A = ["Uncurated", "Auxiliary", "Peripheral", "Ancillary", "Tangential"]
TITLE_B = ["annotation", "note", "record", "observation", "entry"]
SUFFIXES = [" (cf. related source record)", " [duplicate annotation]", " -- see alternative source", " (mirrored entry)"]
#: A source is one of a bank's own if it has at least this part of its facts; so there are few of them.
SMALLEST = 0.01
SOURCES = ["drugchat_chembl", "drugchat_pubchem", "fdarxbench_label", "primekg"]


def pick(values: list[str] | Column, *seed: Column | str) -> Column:
    """One of the values, by the sha1 of the seed."""
    arr = F.array(*map(F.lit, values)) if isinstance(values, list) else values
    h = F.conv(F.substring(F.sha1(F.concat_ws("|", *(s if isinstance(s, Column) else F.lit(s) for s in seed))), 1, 8), 16, 10).cast("long")
    return F.element_at(arr, (h % F.size(arr) + 1).cast("int"))


def hash_order(key: Column | str, seed: int) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def first_by_hash(ids: DataFrame, key: str, n: int, total: int, seed: int) -> DataFrame:
    """The n first distinct keys in hash order. The last hash that counts is found by exact selection, not by a sort."""
    x = ids.select(key, F.conv(F.substring(hash_order(key, seed), 1, 15), 16, 10).cast("long").alias("_v"), F.lit(1).alias("_g"))
    last = key_quantiles(x, ["_g"], "_v", [max(n - 0.5, 0.0) / max(total, 1)]).first()
    return x.where(F.col("_v") <= (last["quantile"] if last and n > 0 else -1)).select(key)


def own_sources(facts: DataFrame, total: int) -> list[str]:
    """The bank's own sources, in order: those with at least SMALLEST of its facts, so there are few."""
    n = facts.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in n.where(F.col("n") >= total * SMALLEST).select("source").orderBy("source").collect()]


def noise(facts: DataFrame, share: float = 1.0, seed: int = 0) -> DataFrame:
    """id, source, source_id, title, relation, text, n_tokens: round(share * facts) distractors under the bank's own sources;
    their number follows the table. They have no aliases and no entities."""
    if share < 0:
        raise ValueError("share must not be negative")
    total = facts.count()
    known = own_sources(facts, total) or ["synthetic"]
    n = int(facts.agg(F.bround(F.count(F.lit(1)) * share)).first()[0])
    i = F.col("id").cast("string")
    tag = (F.lit(1000) + F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), i, F.lit("tag"))), 1, 8), 16, 10).cast("long") % 8999).cast("string")
    part = lambda values, mark: pick(values, str(seed), i, mark)
    text = F.concat(F.lit("The candidate "), part(SUBJECTS, "s"), F.lit(" #"), tag, F.lit(" "), part(PREDICATES, "p"), F.lit(" "), part(OBJECTS, "o"), F.lit("."))
    x = facts.sparkSession.range(n).select(
        F.concat(F.lit("noise_"), F.lpad(i, 8, "0")).alias("id"), part(known, "src").alias("source"), F.concat(F.lit("noise-"), tag).alias("source_id"),
        F.concat_ws(" ", part(TITLE_A, "a"), part(TITLE_B, "b"), tag).alias("title"), F.lit("distractor").alias("relation"), text.alias("text"),
    )
    return x.withColumn("n_tokens", F.size(token_set("text")))


def decoys(facts: DataFrame, per: int = 1, share: float = 1.0, seed: int = 0) -> DataFrame:
    """fact_idx, copy, id, source, true_source, title, relation, text, metadata, n_tokens: near-copies under a wrong source of
    a drawn share of facts. Wrong sources are the bank's own other ones, or the name with "_wrong" where there is none. Copies
    have no aliases, and metadata that say what they are."""
    if per < 0 or not 0 <= share <= 1:
        raise ValueError("per must not be negative, share must be from 0 to 1")
    total = facts.count()
    known = own_sources(facts, total)
    seeds = facts if share >= 1 else facts.join(first_by_hash(facts, "fact_idx", round(total * share), total, seed), "fact_idx", "left_semi")
    more = {c: F.col(c) if c in facts.columns else F.lit(None).cast("string") for c in ("id", "title", "relation")}
    about = F.col("metadata").cast("map<string,string>") if "metadata" in facts.columns else F.lit(None).cast("map<string,string>")
    x = seeds.select("fact_idx", "source", F.coalesce("text", F.lit("")).alias("t"), about.alias("md"), *(v.alias(k) for k, v in more.items()), F.explode(F.sequence(F.lit(0), F.lit(per - 1)) if per else F.array().cast("array<int>")).alias("copy"))
    key = (str(seed), F.col("fact_idx").cast("string"), F.col("copy").cast("string"))
    own = F.coalesce("source", F.lit(""))
    others = F.filter(F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"), lambda s: s != own)
    wrong = F.when(F.size(others) > 0, pick(F.when(F.size(others) > 0, others).otherwise(F.array(own)), *key, F.lit("src"))).otherwise(F.concat(own, F.lit("_wrong")))
    text = F.concat("t", pick(SUFFIXES, *key, F.lit("x")))
    flags = F.map_filter(F.coalesce("md", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("decoy", "decoy_of", "decoy_true_source"))
    flags = F.map_concat(flags, F.create_map(F.lit("decoy"), F.lit("true"), F.lit("decoy_of"), F.col("id"), F.lit("decoy_true_source"), F.col("source")))
    return x.select(
        "fact_idx", "copy", F.concat(F.lit("decoy_"), F.coalesce("id", F.col("fact_idx").cast("string")), F.lit("_"), F.col("copy").cast("string")).alias("id"), wrong.alias("source"), F.col("source").alias("true_source"),
        "title", "relation", text.alias("text"), flags.alias("metadata"), F.size(token_set(text)).alias("n_tokens"),
    )


def perturbed(facts: DataFrame, mode: str = "decoy", **how) -> DataFrame:
    """Originals and what is added, with a flag: source, relation, text, injected."""
    base = facts.select("source", "relation", "text", F.lit(False).alias("injected"))
    if mode == "noisy":
        return base.unionByName(noise(facts, **how).select("source", "relation", "text", F.lit(True).alias("injected")))
    if mode == "decoy":
        return base.unionByName(decoys(facts, **how).select("source", F.lit(None).cast("string").alias("relation"), "text", F.lit(True).alias("injected")))
    raise ValueError(f"no such mode: {mode}")


def split_by_hash(rows: DataFrame, key: str, group: str, train: int, dev: int, seed: int = 13) -> DataFrame:
    """key, group, split: the first rows of each group in hash order are train, the next dev, all others rest.

    The first train + dev rows of a group are found by a rank; the rest is not ranked, so a large group costs no more.
    """
    x = rows.select(key, group, hash_order(key, seed).alias("h"))
    w = Window.partitionBy(group).orderBy("h", key)
    top = x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= train + dev).select(key, F.col("r"))
    return x.join(top, key, "left").select(key, group, F.when(F.col("r") <= train, "train").when(F.col("r").isNotNull(), "dev").otherwise("rest").alias("split"))


def identity_key(*fields: str) -> Column:
    """The first field that is not blank, trimmed and lower-cased; null where all are."""
    return F.coalesce(*(F.nullif(norm_text(f), F.lit("")) for f in fields))


def identity_holdout(rows: DataFrame, key: str, identity: Column, share: float = 0.2, seed: int = 13) -> DataFrame:
    """key, identity, split: a share of the distinct identities, at least one, and all their rows, are test; others train."""
    x = rows.select(key, identity.alias("identity"))
    ids = x.where("identity is not null").select("identity").distinct()
    n = ids.count()
    test = first_by_hash(ids, "identity", max(1, round(n * share)), n, seed).withColumn("split", F.lit("test"))
    return x.join(test, "identity", "left").select(key, "identity", F.coalesce("split", F.lit("train")).alias("split"))




def split_summary(split: DataFrame) -> DataFrame:
    """split, n, n_identities, n_shared: how many identities a split shares with the other one; 0 proves them disjoint."""
    per = split.where("identity is not null").groupBy("identity").agg(F.count_distinct("split").alias("k"))
    s = split.join(per, "identity", "left")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("identity").alias("n_identities"), F.count_distinct(F.when(F.col("k") > 1, F.col("identity"))).alias("n_shared"))
