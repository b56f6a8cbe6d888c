"""Scores of predictions against references, and their grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.routing import question_type
from factloom.functions.text import RECALL_STOPWORDS, col, metric_text, numeric_match, strip


def latest(rows: DataFrame, key: str = "pred_id", version: str = "loaded_at") -> DataFrame:
    """One row a key: of its repeated rows that with the latest version."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_x")).select(key, "_x.*")


def overlap(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """key, n_a, n_b, common: sizes of two bags of tokens and of their multiset intersection, in one exploded grouping."""
    one = lambda side: lambda t: F.struct(t.alias("t"), F.lit(1 - side).alias("x"), F.lit(side).alias("y"))
    none = F.array().cast("array<string>")
    flat = rows.select(key, F.explode_outer(F.concat(F.transform(F.coalesce(a, none), one(0)), F.transform(F.coalesce(b, none), one(1)))).alias("e")).select(key, "e.t", "e.x", "e.y")
    each = flat.groupBy(key, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("int")
    return each.groupBy(key).agg(total("x").alias("n_a"), total("y").alias("n_b"), F.coalesce(F.sum(F.least("x", "y")), F.lit(0)).alias("common"))


def words(c: Column | str, null: str = "none") -> Column:
    """Words of the normalised text; an empty text has none."""
    return F.filter(F.split(metric_text(c, null), " "), lambda x: x != "")


def f1(n_a: Column, n_b: Column, common: Column) -> Column:
    return F.when((n_a == 0) & (n_b == 0), 1.0).when((n_a == 0) | (n_b == 0) | (common == 0), 0.0).otherwise(2 * (common / n_a) * (common / n_b) / (common / n_a + common / n_b))


def score(preds: DataFrame) -> DataFrame:
    """pred_id and its grouping fields with exact, normalized_exact, token_f1, numeric_match (null where undefined), utility."""
    p = latest(preds)
    o = overlap(p, "pred_id", words("prediction"), words("reference_output"))
    x = p.select("pred_id", "dataset", "task_type", "model_name", "method_name", "prediction", "reference_output").join(o, "pred_id")
    none = lambda c: strip(F.coalesce(F.col(c), F.lit("None")))
    x = x.withColumns(
        {
            "exact": none("prediction") == none("reference_output"),
            "normalized_exact": metric_text("prediction", "none") == metric_text("reference_output", "none"),
            "token_f1": f1(F.col("n_a"), F.col("n_b"), F.col("common")),
            "numeric_match": numeric_match("prediction", "reference_output"),
            "question_type": question_type("dataset", "task_type"),
        }
    )
    return x.withColumn("utility", F.coalesce(F.col("numeric_match").cast("double"), "token_f1")).drop("prediction", "reference_output", "n_a", "n_b", "common")


def eval_summary(scored: DataFrame, *by: str) -> DataFrame:
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(mean("exact"), 6).alias("exact"), F.round(mean("normalized_exact"), 6).alias("normalized_exact"),
        F.count("numeric_match").alias("numeric_n"), F.round(mean("numeric_match"), 6).alias("numeric_accuracy"), F.round(mean("token_f1"), 6).alias("avg_token_f1"),
    )


def report_with_totals(scored: DataFrame) -> DataFrame:
    """Means by model, method and task, and by model and method over all tasks, in one grouping-sets pass."""
    x = scored.select("model_name", "method_name", F.coalesce("task_type", F.lit("unknown")).alias("task_type"), "token_f1", F.col("exact").cast("double").alias("e"))
    g = x.groupingSets([["model_name", "method_name", "task_type"], ["model_name", "method_name"]], "model_name", "method_name", "task_type")
    a = g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("token_f1"), 6).alias("token_f1"), F.round(F.avg("e"), 6).alias("exact"), F.grouping("task_type").alias("all"))
    return a.select("model_name", "method_name", F.when(F.col("all") == 1, "overall").otherwise(F.col("task_type")).alias("task_type"), "n", "token_f1", "exact")


def macro_average(scored: DataFrame) -> DataFrame:
    """Unweighted mean of the task means."""
    t = scored.groupBy("model_name", "method_name", "task_type").agg(F.avg("utility").alias("m"))
    return t.groupBy("model_name", "method_name").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("m"), 6).alias("macro"))


def weighted_mean(rows: DataFrame, by: str, value: str, n: str) -> DataFrame:
    """Mean over strata weighted by n, without undefined strata."""
    d = rows.where(F.col(value).isNotNull())
    return d.groupBy(by).agg(F.sum(n).alias("n"), F.round(F.sum(F.col(value) * F.col(n)) / F.sum(n), 6).alias(value))


def select_policies(scored: DataFrame, partition: Column) -> DataFrame:
    """Per model, dataset and question type the method with the best mean on the discovery half (ties: the largest name),
    and what it and the fixed best method give on the evaluation half."""
    x = scored.withColumn("part", partition)
    m = x.groupBy("model_name", "dataset", "question_type", "method_name", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("utility"), 6).alias("u"))
    disc, ev = m.where("part = 'discovery'"), m.where("part = 'evaluation'")
    best = Window.partitionBy("model_name", "dataset", "question_type").orderBy(F.col("u").desc(), F.col("method_name").desc())
    chosen = disc.withColumn("r", F.row_number().over(best)).where("r = 1").select("model_name", "dataset", "question_type", F.col("method_name").alias("selected_method"), F.col("u").alias("discovery_utility"))
    got = ev.select("model_name", "dataset", "question_type", F.col("method_name").alias("selected_method"), F.col("n").alias("evaluation_n"), F.col("u").alias("evaluation_utility"))
    return chosen.join(got, ["model_name", "dataset", "question_type", "selected_method"], "left")


def cells(scored: DataFrame) -> DataFrame:
    """method_name, model_name, cell ("mean F1 / share exact", a dash where there is none) over all methods and models."""
    s = scored.where("model_name is not null")
    g = s.groupBy("method_name", "model_name").agg(F.avg("token_f1").alias("f"), F.avg(F.col("exact").cast("double")).alias("e"))
    fixed = lambda c: F.format_string("%.3f", F.round(c, 3))
    # One row holds the names of both sides, which are the axes of a printed table.
    axes = g.agg(F.collect_set(F.struct("method_name")).alias("ms"), F.collect_set("model_name").alias("ns")).select(F.explode("ms").alias("m"), "ns").select("m.method_name", F.explode("ns").alias("model_name"))
    got = g.select(F.col("method_name").alias("_m"), F.col("model_name").alias("_n"), F.concat(fixed("f"), F.lit(" / "), fixed("e")).alias("cell"))
    return axes.join(got, F.col("method_name").eqNullSafe(F.col("_m")) & (F.col("model_name") == F.col("_n")), "left").select("method_name", "model_name", F.coalesce("cell", F.lit("-")).alias("cell"))


def pivot_cells(scored: DataFrame, models: list[str]) -> DataFrame:
    """Methods by the named models."""
    return cells(scored).groupBy("method_name").pivot("model_name", models).agg(F.first("cell")).fillna("-", models)


def ordering_check(scored: DataFrame, uniform: str, skill: str, oracle: str, tolerance: float = 0.0) -> DataFrame:
    """Per model and dataset whether uniform <= skill <= oracle within a tolerance; cells that lack a role are left out."""
    role = F.when(F.col("method_name") == uniform, "uniform").when(F.col("method_name") == skill, "skill").when(F.col("method_name") == oracle, "oracle")
    p = scored.withColumn("role", role).where("role is not null").groupBy("model_name", "dataset").pivot("role", ["uniform", "skill", "oracle"]).agg(F.avg("utility"))
    p = p.where("uniform is not null and skill is not null and oracle is not null")
    return p.select(
        "model_name", "dataset", F.round(F.col("skill") - F.col("uniform"), 4).alias("skill_gap"), F.round(F.col("oracle") - F.col("skill"), 4).alias("oracle_gap"),
        ((F.col("uniform") <= F.col("skill") + tolerance) & (F.col("skill") <= F.col("oracle") + tolerance)).alias("ordered"),
    )


def missing_cells(scored: DataFrame) -> DataFrame:
    """Cells of the grid of models, methods and tasks for which there is no score."""
    have = scored.select("model_name", "method_name", "dataset", "task_type").distinct()
    axes = have.agg(F.collect_set("model_name").alias("a"), F.collect_set("method_name").alias("b"), F.collect_set(F.struct("dataset", "task_type")).alias("c"))
    grid = axes.select(F.explode("a").alias("model_name"), "b", "c").select("model_name", F.explode("b").alias("method_name"), "c").select("model_name", "method_name", F.explode("c").alias("x")).select("model_name", "method_name", "x.dataset", "x.task_type")
    return grid.join(have, ["model_name", "method_name", "dataset", "task_type"], "left_anti")


def assert_complete(scored: DataFrame) -> DataFrame:
    """scored, if its grid has no missing cell; else an error that names some."""
    lacking = missing_cells(scored).limit(5).collect()
    if lacking:
        raise ValueError(f"no scores for {[tuple(r) for r in lacking]}")
    return scored


# Methods that use a skill's sources, and all method names, longest first.
SKILL_METHODS = ["skill_schema_v1", "skill_hybrid", "bm25_skillrouted", "dense_bge_skillrouted", "dense_bge_locked", "oracle_source"]
METHOD_NAMES = "dense_bge_skillrouted|dense_bge_locked|bm25_skillrouted|skill_schema_v1|skill_hybrid|oracle_source|dense_medcpt|dense_bge|rerank|rrf|hybrid|bm25|kg|none"


def method_family(method: Column) -> Column:
    return F.when(method.isin(SKILL_METHODS), "skill").otherwise("uniform")


def method_of_file(name: Column, pattern: str = f"({METHOD_NAMES})") -> Column:
    """The first group of the pattern in a file's name, else the name without its ending."""
    return F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.regexp_replace(name, r"\.[^.]*$", ""))


def headline(numeric: str = "numeric_acc", f1_: str = "token_f1") -> Column:
    return F.coalesce(numeric, f1_)


def recall_words(c: Column | str) -> Column:
    """Words of more than two letters that are no stopwords."""
    return F.filter(words(col(c), ""), lambda x: (F.length(x) > 2) & ~x.isin(RECALL_STOPWORDS))


def filename_fields(name: Column) -> list[Column]:
    """model, dataset, method, variant of an evaluation file's name; the longest method names are tried first."""
    # The methods and data sets of file names.
    methods = "bm25_skillrouted|dense_bge_skillrouted|dense_bge_locked|skill_schema_v1|oracle_source|skill_hybrid|dense_medcpt|dense_bge|skill_v1|closed_book|hybrid|rerank|routed|dense|bm25|none|rrf|kg"
    p = rf"^(.+?)_(fdarxbench_v2|fdarxbench|mol_instructions_v2|mol_instructions)_(?:({methods})_)?([a-z]+)_test_eval\.json$"
    part = lambda i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    return [part(1).alias("model"), part(2).alias("data"), F.coalesce(part(3), F.when(part(1).isNotNull(), "none")).alias("method"), part(4).alias("variant")]
