"""Readers and writers of the file forms that records come in: JSON lines, JSON arrays, CSV, result files by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.storage import cut

FACT = "id string, source string, source_id string, title string, text string, aliases array<string>, entities array<string>, relation string, metadata map<string,string>, tokens array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, missing_ok: bool = False, most: int = 0, order: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. A missing path is an error, or an empty table. With most, the first rows in the
    order of a column, which must be named."""
    if most and not order:
        raise ValueError("rows have no order of their own: name the column that says which come first")
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).json(path)
    return df.orderBy(order).limit(most) if most else df


def read_json_array(spark: SparkSession, path: str, schema: str | StructType, missing_ok: bool = False, most: int = 0, order: str | None = None) -> DataFrame:
    """Files that hold one JSON array each, or one object. most and order as in read_jsonl."""
    if most and not order:
        raise ValueError("rows have no order of their own: name the column that says which come first")
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.orderBy(order).limit(most) if most else df


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """CSV with a header, all columns text."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


#: Name of a result: a file, or a folder of files that one job wrote.
RESULT = r"(?:^|/)([^/]+_eval\.json)(?:/[^/]*)?$"


def read_results(spark: SparkSession, paths: list[str], schema: str, fields: list[Column] | None = None, methods: list[str] | None = None) -> DataFrame:
    """Result files (a list, or one object each) with their name as a column, and columns taken from it; of files of one name
    that in the first path counts. Files that can't be read are left out; with methods, so are those of other methods."""
    found = None
    for i, p in enumerate(paths):
        if exists(spark, p):
            df = spark.read.schema(schema + ", _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).json(p)
            path = F.col("_metadata.file_path")
            name = F.coalesce(F.nullif(F.regexp_extract(path, RESULT, 1), F.lit("")), F.col("_metadata.file_name"))
            df = cut(df.select("*", name.alias("file_name"), F.lit(i).alias("_at"))).where("_broken is null").drop("_broken")
            found = df if found is None else found.unionByName(df)
    if found is None:
        return spark.createDataFrame([], schema + ", file_name string")
    first = found.groupBy("file_name").agg(F.min("_at").alias("_at"))
    out = found.join(first, ["file_name", "_at"]).drop("_at").select("*", *(fields or []))
    return out.where(F.col("method").isin(methods)) if methods else out


def number_or_text(c: str) -> list[Column]:
    """The column as a number, null where it is none, and as it stands."""
    return [F.col(c).try_cast("double").alias(c), F.col(c).alias(f"{c}_text")]


def read_summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of summary CSVs: dataset, method, model, variant, subtask (the data set where it is blank), n, token_f1, exact,
    numeric_acc, file. What is no number is null."""
    text = ["dataset", "method", "model", "variant", "subtask"]
    numbers = ["n", "token_f1", "exact", "numeric_acc"]
    paths = [p for p in paths if exists(spark, p)]
    x = read_csv(spark, paths, [*text, *numbers, "file"]) if paths else spark.createDataFrame([], ", ".join(f"{c} string" for c in [*text, *numbers, "file"]))
    subtask = F.coalesce(F.nullif("subtask", F.lit("")), "dataset").alias("subtask")
    return x.select(*text[:4], subtask, *(number_or_text(c)[0] for c in numbers), "file")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key the last one; rows with a null key are dropped."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns, missing values as empty text."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def write_markdown(small: DataFrame, path: str, title: str, most: int = 1000) -> str:
    """A table of an aggregate as Markdown; refuses more than `most` rows."""
    rows = small.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table instead")
    cols = small.columns
    lines = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join("" if r[c] is None else str(r[c]) for c in cols) + " |" for r in rows)]
    text = "\n".join(lines) + "\n"
    small.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def write_json_object(df: DataFrame, path: str) -> str:
    """The one row of a summary as one JSON object."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    text = df.select(F.to_json(F.struct(*df.columns))).first()[0]
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def copy_table(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """A table beside a perturbed one as it stands; an empty table where there is none."""
    df = spark.read.parquet(source) if exists(spark, source) else spark.createDataFrame([], schema)
    df.write.mode("overwrite").parquet(target)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the path and renames, so that readers see the former table or the whole new one."""
    spark = df.sparkSession
    jvm, new, old = spark._jvm, f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)
