"""Text, identifier and number expressions; all are columns, none is a Python function a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists.
BLANK = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = "[a-z0-9][a-z0-9+.'-]*"
WORDS = r"[A-Za-z][A-Za-z0-9+.'-]*(?:\s+[A-Za-z][A-Za-z0-9+.'-]*){0,4}"
WORDS_PLAIN = r"[A-Za-z][A-Za-z0-9+.-]*(?:\s+[A-Za-z][A-Za-z0-9+.-]*){0,4}"
NUMBER = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
SMILES = r"^[A-Za-z0-9@+\-\[\]()=#$\\/%.]+$"
QUERY_STOPWORDS = "a an and answer are as be by can does for from given has have how in input is it its may molecule of on or patients question should task that the this to use used what when which why with".split()
RECALL_STOPWORDS = "a an and are as at be been by for from has have in is it its may of on or that the their this to was were which with".split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c: Column | str) -> Column:
    """Lower case, blanks collapsed, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(col(c)), BLANK + "+", " "))


def strip(c: Column | str) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(col(c), f"^{BLANK}+|{BLANK}+$", "")


def metric_text(c: Column | str, null: str | None = None) -> Column:
    """norm_text without ASCII punctuation; null becomes `null` (the word "none" for evaluation, empty for analysis)."""
    c = col(c) if null is None else F.coalesce(col(c), F.lit(null))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", ""), BLANK + "+", " "))


def tokens(c: Column | str) -> Column:
    """Tokens in order with repeats."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def token_set(c: Column | str) -> Column:
    return F.sort_array(F.array_distinct(tokens(c)))


def present(c: Column | str) -> Column:
    """The column, null where it is empty."""
    return F.nullif(col(c), F.lit(""))


def mentions(question: str, context: str | None = None, drug: str | None = None, smiles: str | None = None, task: str | None = None, pattern: str = WORDS) -> Column:
    """Distinct normalised phrases of a record: runs of up to five words of its texts, its drug with and without salt word,
    its molecule, and its whole input where that is short."""
    fields = [c for c in (question, drug, context, smiles, task) if c]
    text = F.concat_ws(" ", *(present(c) for c in fields))
    spans = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), norm_text), lambda x: F.length(x) >= 4)
    parts = [spans]
    if drug:
        d = norm_text(drug)
        parts.append(F.array(d, F.replace(F.replace(d, F.lit(" hydrochloride"), F.lit("")), F.lit(" hydrobromide"), F.lit(""))))
    if smiles:
        parts.append(F.array(norm_text(smiles)))
    if context:
        short = F.length(F.trim(col(context))) <= 300
        parts.append(F.array(F.when(short, norm_text(context))))
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")))


def field_mentions(*fields: str, drug: str | None = None, pattern: str = WORDS_PLAIN) -> Column:
    """Distinct normalised phrases of each field on its own, and the drug with and without salt word."""
    spans = [F.filter(F.transform(F.regexp_extract_all(F.coalesce(col(f), F.lit("")), F.lit(pattern), F.lit(0)), norm_text), lambda x: F.length(x) >= 4) for f in fields]
    d = norm_text(drug) if drug else F.lit(None).cast("string")
    more = F.array(d, F.replace(F.replace(d, F.lit(" hydrochloride"), F.lit("")), F.lit(" hydrobromide"), F.lit("")))
    return F.array_distinct(F.filter(F.concat(*spans, more), lambda x: x.isNotNull() & (x != "")))


def query_text(question="question", drug="drug_name", context="input_molecule_or_context", smiles="decoded_smiles", task="task_type") -> Column:
    return F.concat_ws(" ", *(present(c) for c in (question, drug, context, smiles, task)))


def fact_text(title="title", text="text", aliases="aliases") -> Column:
    return F.concat_ws(" ", present(title), present(text), present(F.array_join(col(aliases), " ")))


def passage_text(title="title", text="text") -> Column:
    """"title. text", or the text alone where it holds the title."""
    t, x = F.coalesce(col(title), F.lit("")), F.coalesce(col(text), F.lit(""))
    return F.when((t != "") & (F.instr(F.lower(x), F.lower(t)) == 0), F.concat(t, F.lit(". "), x)).otherwise(x)


def evidence_text(items: Column | str) -> Column:
    return F.array_join(F.filter(F.flatten(F.transform(col(items), lambda e: F.array(e["title"], e["text"]))), lambda x: x != ""), " ")


def entity_strings(aliases="aliases", entities="entities") -> Column:
    """Aliases and entity names without blank ones."""
    return F.filter(F.concat(F.coalesce(col(aliases), F.array().cast("array<string>")), F.coalesce(col(entities), F.array().cast("array<string>"))), lambda x: F.trim(x) != "")


def stable_id(*parts: Column | str, size: int = 20) -> Column:
    """First hex digits of the sha1 of the parts joined by two bars; null is the word None."""
    return F.substring(F.sha1(F.concat_ws("||", *(F.coalesce(col(p).cast("string"), F.lit("None")) for p in parts))), 1, size)


def sha1_bucket(c: Column | str, n: int) -> Column:
    """The sha1 of the text, as a number, modulo n."""
    h = F.sha1(F.coalesce(col(c), F.lit("")))
    digits = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, x: (a * 16 + x) % n)


def half_split(c: Column | str) -> Column:
    """discovery or evaluation, by the first byte of the sha256."""
    return F.when(F.substring(F.sha2(col(c), 256), 1, 1) < "8", "discovery").otherwise("evaluation")


def first_number(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), NUMBER, 0), F.lit("")).try_cast("double")


def is_number(c: Column | str) -> Column:
    return F.coalesce(F.regexp(strip(c), F.lit(f"^(?:{NUMBER})$")), F.lit(False))


def numeric_match(prediction: Column | str, reference: Column | str, abs_tol: float = 1e-3, rel_tol: float = 0.05) -> Column:
    """Null where the reference is no number; false where the prediction has none; else whether they are close."""
    p, r = first_number(prediction), first_number(strip(reference))
    return F.when(is_number(reference), F.coalesce(F.abs(p - r) <= F.greatest(F.lit(abs_tol), F.abs(r) * rel_tol), F.lit(False)))


def probable_smiles(c: Column | str) -> Column:
    t = strip(c)
    return F.coalesce(F.length(t).between(4, 300) & F.regexp(t, F.lit(SMILES)) & F.regexp(t, F.lit(r"[=#\[\]()]")), F.lit(False))


def input_type(source: Column | str, value: Column | str) -> Column:
    v = strip(F.coalesce(col(value), F.lit("")))
    return F.when(v == "", "none").when(col(source).startswith("drugchat"), "SMILES").when(v.startswith("["), "SELFIES").when(probable_smiles(v), "SMILES").otherwise("text")


def answer_shape(c: Column | str) -> Column:
    a = strip(F.coalesce(col(c), F.lit("")))
    return (
        F.when(a == "", "empty")
        .when(F.regexp(a, F.lit(f"^(?:{NUMBER})$")), "numeric")
        .when(a.startswith("[") & a.contains("]"), "molecule_string")
        .when(F.lower(a).isin("information not found!", "information not found"), "abstention")
        .when(a.contains("\n") | a.startswith("-"), "list_or_multiline")
        .when(F.size(F.split(a, r"\s+")) <= 8, "short_text")
        .otherwise("long_text")
    )


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Shared part of two sets; `empty` where both are empty (or, with 0, where either is)."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def counter_cell(df_key: str, df_count: str) -> Column:
    """Aggregate: key:count cells joined by bars, largest first, then by key."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(df_count)).alias("n"), F.col(df_key).alias("k")))), lambda x: F.concat(x["k"], F.lit(":"), (-x["n"]).cast("string"))), "|")


def parse_counter(c: Column | str) -> Column:
    """Entries (key, count) of a cell; the last colon parts them, entries without a whole number are left out."""
    parts = F.filter(F.split(col(c), r"\|"), lambda x: F.regexp(x, F.lit(r"^.*:-?\d+$")))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(.*):(-?\d+)$", 1).alias("k"), F.regexp_extract(x, r"^(.*):(-?\d+)$", 2).cast("long").alias("n")))
