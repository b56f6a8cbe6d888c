"""Analyses of retrieved evidence and of records: source mix, divergence, planning metrics, coverage, clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.routing import SOURCES
from factloom.functions.text import RECALL_STOPWORDS, evidence_text, jaccard, metric_text
from factloom.storage import cut


def source_mix(found: DataFrame, facts: DataFrame, groups: DataFrame, by: str = "source") -> DataFrame:
    """grp, <by>, examples_with_evidence, avg_facts, mean_within_prompt_share: means over the queries that have the source."""
    x = found.select("qid", "fact_idx").join(facts.select("fact_idx", F.coalesce(by, F.lit("unknown")).alias(by)), "fact_idx").groupBy("qid", by).agg(F.count(F.lit(1)).alias("c"))
    x = x.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("qid")))  # a query has at most k facts
    return x.join(groups, "qid").groupBy("grp", by).agg(F.count(F.lit(1)).alias("examples_with_evidence"), F.round(F.avg("c"), 4).alias("avg_facts"), F.round(F.avg("share"), 4).alias("mean_within_prompt_share"))


def distribution(mix: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    """grp, source, share over a fixed support, renormalised; sources that a group lacks have 0."""
    s = mix.sparkSession.createDataFrame([(x, i) for i, x in enumerate(sources)], "source string, pos int")
    grid = mix.select("grp").distinct().crossJoin(F.broadcast(s))
    x = grid.join(mix.select("grp", "source", "mean_within_prompt_share"), ["grp", "source"], "left").withColumn("m", F.coalesce("mean_within_prompt_share", F.lit(0.0)))
    total = F.sum("m").over(Window.partitionBy("grp"))
    return x.withColumn("share", F.when(total > 0, F.col("m") / total).otherwise(0.0)).select("grp", "source", "pos", "share")


def plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def heterogeneity(dist: DataFrame, n_sources: int = len(SOURCES), allowed: DataFrame | None = None, support: DataFrame | None = None) -> DataFrame:
    """grp, dominant_source (ties: the first of the support), dominant_share, entropy_bits, normalized_entropy, effective_sources.

    With allowed (grp, allow) and support (grp, source, mean_gold_token_recall) also oracle_source_share and
    oracle_support_share, the parts that the allowed sources have of the evidence and of the support.
    """
    shares = []
    if allowed is not None and support is not None:
        dist = dist.join(allowed, "grp", "left").join(support.select("grp", "source", "mean_gold_token_recall"), ["grp", "source"], "left")
        dist = dist.withColumn("r", F.coalesce("mean_gold_token_recall", F.lit(0.0))).withColumn("in", F.coalesce(F.array_contains("allow", F.col("source")), F.lit(False)))
        shares = [F.sum(F.when(F.col("in"), F.col("share")).otherwise(0.0)).alias("os"), F.sum(F.when(F.col("in"), F.col("r")).otherwise(0.0)).alias("sr"), F.sum("r").alias("tr")]
    g = dist.groupBy("grp").agg(F.max_by("source", F.struct("share", (-F.col("pos")).alias("p"))).alias("dominant_source"), F.max("share").alias("d"), (-F.sum(plogp(F.col("share")))).alias("h"), *shares)
    more = [F.round("os", 4).alias("oracle_source_share"), F.round(F.when(F.col("tr") > 0, F.col("sr") / F.col("tr")).otherwise(0.0), 4).alias("oracle_support_share")] if shares else []
    return g.select(*more, "grp", "dominant_source", F.round("d", 4).alias("dominant_share"), F.round(F.col("h") + 0.0, 4).alias("entropy_bits"), F.round(F.col("h") / math.log2(n_sources) + 0.0, 4).alias("normalized_entropy"), F.round(F.pow(F.lit(2.0), F.col("h")), 4).alias("effective_sources"))


def divergence(dist: DataFrame) -> DataFrame:
    """grp_a, grp_b, js_divergence of each pair of groups, and a row ALL, MEAN with the mean of the unrounded values."""
    a = dist.select(F.col("grp").alias("grp_a"), "source", F.col("share").alias("p"))
    b = dist.select(F.col("grp").alias("grp_b"), "source", F.col("share").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    pairs = a.join(b, "source").where("grp_a < grp_b").groupBy("grp_a", "grp_b").agg((F.sum(kl(F.col("p"))) / 2 + F.sum(kl(F.col("q"))) / 2).alias("js"))
    mean = pairs.agg(F.avg("js").alias("js")).select(F.lit("ALL").alias("grp_a"), F.lit("MEAN").alias("grp_b"), "js")
    return pairs.unionByName(mean).select("grp_a", "grp_b", F.round(F.col("js") + 0.0, 4).alias("js_divergence"))


def evidence_words(found: DataFrame, facts: DataFrame, *by: str) -> DataFrame:
    """by, words (distinct) of the titles and texts that were found; a query has few facts."""
    x = found.select("qid", "fact_idx").join(facts.select("fact_idx", "source", "title", "text"), "fact_idx")
    return x.groupBy(*by).agg(F.array_distinct(_words(evidence_text(F.collect_list(F.struct("title", "text"))))).alias("words"))


def _words(c: Column) -> Column:
    return F.filter(F.split(metric_text(c, "none"), " "), lambda w: w != "")


def planning(found: DataFrame, facts: DataFrame, queries: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """qid, source_precision, wrong_source_rate, source_entropy_bits, skill_source_agreement (null for queries without
    evidence), evidence_recall_at_k (share of the distinct words of the gold answer that the evidence has; null where there
    is none) and evidence_utilization (that of the prediction; null where there is no prediction or it has no word).

    queries: qid, allow (allowed sources), gold_answer; predictions: qid, prediction, one row a query.
    """
    x = found.select("qid", "fact_idx").join(facts.select("fact_idx", F.coalesce("source", F.lit("None")).alias("source")), "fact_idx").groupBy("qid", "source").agg(F.count(F.lit(1)).alias("c"))
    g = x.groupBy("qid").agg(F.collect_list(F.struct("source", "c")).alias("s"), F.sum("c").alias("n"))
    r = queries.select("qid", "allow", "gold_answer").join(g, "qid", "left").join(evidence_words(found, facts, "qid"), "qid", "left")
    said = predictions.select("qid", F.coalesce("prediction", F.lit("None")).alias("said")) if predictions is not None else r.select("qid", F.lit(None).cast("string").alias("said")).limit(0)
    r = r.join(said, "qid", "left")
    on = F.aggregate("s", F.lit(0).cast("long"), lambda a, e: a + F.when(F.array_contains("allow", e["source"]), e["c"]).otherwise(0))
    p = lambda e: e["c"] / F.col("n")
    entropy = F.aggregate("s", F.lit(0.0), lambda a, e: a - p(e) * F.log2(p(e)))
    names = F.transform("s", lambda e: e["source"])
    have = F.coalesce("words", F.array().cast("array<string>"))
    part = lambda w: F.when(F.size(w) > 0, F.size(F.array_intersect(w, have)) / F.size(w))
    recall = part(F.array_distinct(_words(F.col("gold_answer"))))
    used = F.when(F.col("said").isNotNull(), part(F.array_distinct(_words(F.col("said")))))
    out = r.select("qid", (on / F.col("n")).alias("pr"), entropy.alias("en"), F.when(F.col("s").isNotNull(), jaccard(names, F.col("allow"))).alias("ag"), recall.alias("re"), used.alias("us"))
    return out.select(
        "qid", F.round("pr", 6).alias("source_precision"), F.round(1 - F.col("pr"), 6).alias("wrong_source_rate"), F.round(F.col("en") + 0.0, 6).alias("source_entropy_bits"), F.round("ag", 6).alias("skill_source_agreement"),
        F.round("re", 6).alias("evidence_recall_at_k"), F.round("us", 6).alias("evidence_utilization"),
    )


def source_support(found: DataFrame, facts: DataFrame, queries: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    """grp, source, n, mean_gold_token_recall: of each query and every source, also those without evidence, the share of the
    gold answer's words that the texts found in the source have. queries: qid, grp, gold_answer."""
    keep = lambda w: (F.length(w) > 2) & ~w.isin(RECALL_STOPWORDS)
    words = lambda c: F.filter(F.split(metric_text(c, ""), " "), keep)
    x = found.select("qid", "fact_idx").join(facts.select("fact_idx", "source", "text"), "fact_idx").where(F.col("source").isin(sources))
    held = x.groupBy("qid", "source").agg(F.flatten(F.collect_list(words(F.col("text")))).alias("w"))
    grid = queries.select("qid", "grp", words(F.col("gold_answer")).alias("g"), F.explode(F.array(*map(F.lit, sources))).alias("source"))
    r = grid.join(held, ["qid", "source"], "left")
    times = lambda c, t: F.size(F.filter(c, lambda z: z == t))
    common = F.aggregate(F.array_distinct("g"), F.lit(0), lambda a, t: a + F.least(times(F.col("g"), t), times(F.coalesce("w", F.array().cast("array<string>")), t)))
    r = r.withColumn("recall", F.when(F.size("g") > 0, common / F.size("g")).otherwise(0.0))
    return r.groupBy("grp", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("mean_gold_token_recall"))


def field_coverage(rows: DataFrame, by: str) -> DataFrame:
    """<by>, field, n, present: how many rows of the group have the field; empty texts, lists and maps count as missing."""
    tests = []
    for name, kind in rows.dtypes:
        if name != by:
            c = F.col(name)
            has = c.isNotNull() & (F.size(c) > 0 if kind.startswith(("array", "map")) else c != "" if kind == "string" else F.lit(True))
            tests.append(F.sum(F.when(has, 1).otherwise(0)).alias(name))
    wide = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"), *tests)
    fields = [n for n in rows.columns if n != by]
    return wide.unpivot([by, "_rows"], fields, "field", "present").withColumnRenamed("_rows", "n")


def cluster_rows(labelled: DataFrame) -> DataFrame:
    """cluster, n, top_skill (ties: the first by name), purity, skill_counts of each cluster."""
    c = labelled.groupBy("cluster", "skill").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "skill")))
    g = c.groupBy("cluster").agg(F.sum("n").alias("n"), order.alias("o"))
    cell = F.array_join(F.transform("o", lambda e: F.concat(e["skill"], F.lit(":"), (-e["m"]).cast("string"))), "|")
    return g.select("cluster", "n", F.col("o")[0]["skill"].alias("top_skill"), F.round(-F.col("o")[0]["m"] / F.col("n"), 6).alias("purity"), cell.alias("skill_counts"))


def cluster_quality(labelled: DataFrame) -> DataFrame:
    """n, purity, nmi, ari of cluster against skill, from the counts of their pairs."""
    c = labelled.groupBy("cluster", "skill").agg(F.count(F.lit(1)).alias("n"))
    rows, cols = c.groupBy("cluster").agg(F.sum("n").alias("a"), F.max("n").alias("m")), c.groupBy("skill").agg(F.sum("n").alias("b"))
    t = rows.agg(F.sum("a").alias("t"), F.sum("m").alias("m"), F.sum(F.col("a") * (F.col("a") - 1) / 2).alias("sa"), F.sum(F.col("a") * F.log("a")).alias("la"))
    u = cols.agg(F.sum(F.col("b") * (F.col("b") - 1) / 2).alias("sb"), F.sum(F.col("b") * F.log("b")).alias("lb"))
    v = c.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("sn"), F.sum(F.col("n") * F.log("n")).alias("ln"))
    x = t.crossJoin(u).crossJoin(v)  # one row each
    h1, h2 = F.log("t") - F.col("la") / F.col("t"), F.log("t") - F.col("lb") / F.col("t")
    mi = F.log("t") + (F.col("ln") - F.col("la") - F.col("lb")) / F.col("t")
    exp = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    ari = (F.col("sn") - exp) / ((F.col("sa") + F.col("sb")) / 2 - exp)
    return x.select(F.col("t").alias("n"), F.round(F.col("m") / F.col("t"), 6).alias("purity"), F.round(F.when(h1 + h2 > 0, 2 * mi / (h1 + h2)).otherwise(1.0), 6).alias("nmi"), F.round(ari, 6).alias("ari"))


def text_clusters(records: DataFrame, k: int, features: int = 2000, components: int = 20, seed: int = 13, starts: int = 20) -> DataFrame:
    """qid, cluster, explained (share of the variance in the first two components): K-means of TF-IDF vectors over words and
    pairs of words, reduced to principal components.

    records: qid, text. Frequencies are inverted as 1 + log((n + 1) / (df + 1)). The best of several starts by cost is kept.
    Fewer rows than clusters give fewer clusters; no rows give none.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, PCA, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer
    from pyspark.ml.linalg import Vectors

    x = records.select("qid", F.coalesce("text", F.lit("")).alias("text"))
    x = NGram(n=2, inputCol="w", outputCol="w2").transform(RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\b\w\w+\b", gaps=False).transform(x))
    x = cut(x.select("qid", F.concat("w", "w2").alias("terms")))
    if x.isEmpty():
        return records.sparkSession.createDataFrame([], records.select("qid", F.lit(0).alias("cluster"), F.lit(0.0).alias("explained")).schema)
    counted = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=features, minDF=2).fit(x).transform(x)
    idf = IDF(inputCol="tf", outputCol="ti").fit(counted).idf.toArray()
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf + 1.0), inputCol="tf", outputCol="ti").transform(counted)
    normal = Normalizer(inputCol="ti", outputCol="nv", p=2.0).transform(scaled)
    pca = PCA(k=min(components, max(2, len(idf) - 1)), inputCol="nv", outputCol="features").fit(normal)
    v = cut(pca.transform(normal).select("qid", "features"))
    models = [KMeans(k=k, seed=seed + i, maxIter=20).fit(v) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(v).select("qid", F.col("prediction").alias("cluster"), F.lit(float(sum(pca.explainedVariance.toArray()[:2]))).alias("explained"))
