"""Same or near-same records across splits: an exact prefix-filter join between evaluation and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.storage import checked_broadcast, cut

FIELDS = ["question", "input_molecule_or_context", "gold_answer"]
#: A word, or pair of words, in at most so many classes of records is a key of its own; a constant, so that a key stands for a
#: bounded number of comparisons however many records there are.
RARE = 256
#: Rows of a side that is broadcast, at most; more are merged.
FEW = 200_000
#: Training classes of a key of three words that one task compares with an evaluation class, at most about; a key with more is split.
BLOCK = 2000
#: Copies of one class that meet a partner in one task, at most about.
COPIES = 5000
#: A word in more than one in SHARE classes is hot: there are at most SHARE times the mean set size such words.
SHARE = 100


def word_set(fields: list[str]) -> Column:
    """Distinct words (runs of a-z and 0-9 after lower-casing) of all fields together; null counts as empty."""
    text = F.lower(F.concat_ws(" ", *fields))
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))


def _merged(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """Joined by sorting and merging: no side is ever sent to every task, and adaptive execution splits skewed parts."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def _latest(records: DataFrame, key: str, split: str, train: str, fields: list[str], version: str, *more: str) -> DataFrame:
    """k, in_train, w (sorted distinct words) and more of the latest row of each key; ties go to the row with the largest hash."""
    r = records.where(F.col(key).isNotNull() & F.col(split).isNotNull())
    order = F.struct(F.coalesce(F.col(version).cast("string"), F.lit("")).alias("a"), F.xxhash64(split, *fields, *more).alias("b"))
    held = F.struct((F.lower(F.trim(split)) == train).alias("in_train"), F.array_sort(word_set(fields)).alias("w"), *(F.col(c).alias(f"_m{i}") for i, c in enumerate(more)))
    return r.groupBy(F.col(key).alias("k")).agg(F.max_by(held, order).alias("x")).select("k", "x.*")


def _frequent(rows: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(hot, others): keys with their number of rows. At most SHARE keys times the mean number of keys a class are hot."""
    df = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("df")))
    most = max(n // SHARE, RARE)
    return df.where(F.col("df") > most), df.where(F.col("df") <= most)


def overlaps(records: DataFrame, key: str = "qa_id", split: str = "split", train: str = "train", fields: list[str] = FIELDS, least: float = 0.8, version: str = "loaded_at", more: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of classes of equal word sets whose Jaccard similarity is at least least, and who is in them.

    members: class_id, key, in_train and the columns `more`. A class is all records with one set of words, so copies are
    never compared with each other. pairs: train_class, eval_class, similarity; both sides may be one class. Of rows that
    repeat a key the latest version counts. Rows without any word, and rows whose split or key is null, overlap with nothing.

    Words are ordered by rising frequency. Different sets that are similar enough (least must be over 2/3) share at least
    three of the first n - ceil(least * n) + 3 words of either side. Either one of these is rare and a key of both, or two
    of them are a rare pair and a key of both, or all three pairs are frequent and the three are a key of both. Rare means
    in at most RARE classes, so a key stands for few comparisons at any size; the threes that are frequent are split over
    tasks by the number of classes that hold their pairs. Evaluation classes are indexed by their keys and training
    classes probe them, under filters on the lengths, on the place of the words and on 128 parity bits of the sets; the
    survivors are verified on the whole sets. Nothing is capped, so the join is exact.
    """
    if least <= 2 / 3:
        raise ValueError("least must be over 2/3")
    latest = _latest(records, key, split, train, fields, version, *more).where(F.size("w") > 0)
    latest = cut(latest.withColumn("class_id", F.sha2(F.array_join("w", " "), 256).substr(1, 32)))
    members = latest.select("class_id", F.col("k").alias(key), "in_train", *(F.col(f"_m{i}").alias(c) for i, c in enumerate(more)))
    sets = cut(latest.groupBy("class_id").agg(F.first("w").alias("w"), F.max("in_train").alias("t"), F.max(~F.col("in_train")).alias("e")))
    n = sets.count()

    words = sets.select("class_id", F.explode("w").alias("word"))
    hot, cold = _frequent(words, "word", n)
    # There are few hot words; should their sizes not fit, their rows are spread by the class, and others merge on the word.
    small, few = checked_broadcast(hot, FEW)
    if few:
        known = words.join(small, "word", "left")
    else:
        salted = words.withColumn("_s", F.pmod(F.xxhash64("class_id"), F.lit(64)))
        known = _merged(salted, hot.withColumn("_s", F.explode(F.expr("sequence(0L, 63L)"))), ["word", "_s"], "left").drop("_s")
    ranked = known.where("df is not null").unionByName(_merged(known.where("df is null").drop("df"), cold, "word"))
    ordered = ranked.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("word").alias("h")))).alias("o"))
    size = F.size("o")
    prefix = size - F.ceil(F.lit(least) * size - 1e-9) + 3
    # Each word turns one of 128 bits.
    parity = lambda side: F.expr(f"aggregate(o, 0L, (a, x) -> if(shiftrightunsigned(x.h, 40) & 1 = {side}, a ^ shiftleft(1L, cast(shiftrightunsigned(x.h, 7) & 63 as int)), a))")
    ordered = ordered.select("class_id", size.alias("n"), parity(0).alias("b1"), parity(1).alias("b2"), F.slice("o", 1, F.least(size, prefix).cast("int")).alias("p"))
    about = ["class_id", "n", "b1", "b2", "t", "e"]
    ordered = cut(_merged(ordered, sets.select("class_id", "t", "e"), "class_id"))

    # A pair of common words is named by a hash; places are of the first of the words.
    single = "transform(filter(transform(p, (x, i) -> named_struct('key', x.h, 'at', i, 'df', x.df)), x -> x.df <= {r}), x -> named_struct('key', x.key, 'at', x.at))"
    twos = (
        "flatten(transform(filter(sequence(0, size(p) - 1), i -> p[i].df > {r}), i -> transform(filter(sequence(i, size(p) - 1), j -> j > i and p[j].df > {r}),"
        " j -> named_struct('pair', xxhash64(p[i].h, p[j].h), 'i', i, 'j', j))))"
    )
    pair = ordered.where("size(p) > 1").select("class_id", F.explode(F.expr(twos.format(r=RARE))).alias("x")).select("class_id", "x.*")
    # How many classes hold a pair decides whether it is a key; one row a frequent pair.
    often = cut(pair.groupBy("pair").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > RARE))
    small, few = checked_broadcast(often, FEW)
    both = cut(pair.join(small, "pair", "left") if few else _merged(pair, often, "pair", "left"))
    lone = ordered.select(*about, F.explode(F.expr(single.format(r=RARE))).alias("x")).select(*about, "x.key", "x.at", F.lit(1).alias("parts"))
    rare = both.where("m is null").select("class_id", F.col("pair").alias("key"), F.col("i").alias("at"), F.lit(1).alias("parts"))
    frequent = both.where("m is not null").groupBy("class_id").agg(F.collect_list(F.struct("i", "j", "m")).alias("g"))
    threes = F.expr(
        "flatten(transform(g, a -> transform(filter(g, b -> b.i = a.j and exists(g, c -> c.i = a.i and c.j = b.j)),"
        " b -> named_struct('i', a.i, 'j', a.j, 'k', b.j, 'm', least(a.m, b.m, filter(g, c -> c.i = a.i and c.j = b.j)[0].m)))))"
    )
    three = _merged(frequent.select("class_id", F.explode(threes).alias("x")), ordered.select("class_id", "p"), "class_id")
    three = three.select("class_id", F.expr("xxhash64(p[x.i].h, p[x.j].h, p[x.k].h)").alias("key"), F.col("x.i").alias("at"), F.ceil(F.col("x.m") / BLOCK).cast("int").alias("parts"))
    entry = cut(lone.unionByName(_merged(rare.unionByName(three), ordered.select(*about), "class_id").select(lone.columns)))

    ev = entry.where("e").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts", "t", "e").alias("ev")
    tr = entry.where("t").withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")).drop("parts", "t", "e").alias("tr")
    ratio = F.lit(least)
    total = F.col("ev.n") + F.col("tr.n")
    must = F.ceil(ratio / (1 + ratio) * total - 1e-9)
    # Common words before the first word of a key are no more than either side has there, and so for those after it; the
    # parity bits in which two sets differ are no more than the words in which they differ.
    allowed = F.least("ev.at", "tr.at") + F.least(F.col("ev.n") - F.col("ev.at"), F.col("tr.n") - F.col("tr.at"))
    apart = F.bit_count(F.col("ev.b1").bitwiseXOR(F.col("tr.b1"))) + F.bit_count(F.col("ev.b2").bitwiseXOR(F.col("tr.b2")))
    meet = [
        F.col("ev.key") == F.col("tr.key"), F.col("ev.part") == F.col("tr.part"), F.col("ev.class_id") != F.col("tr.class_id"),
        F.col("tr.n") >= F.ceil(ratio * F.col("ev.n") - 1e-9), F.col("ev.n") >= F.ceil(ratio * F.col("tr.n") - 1e-9), allowed >= must, apart <= total - 2 * must,
    ]
    near = _merged(ev, tr, meet).select(F.col("ev.class_id").alias("eval_class"), F.col("tr.class_id").alias("train_class")).distinct()
    w = sets.select("class_id", "w")
    first = _merged(near, w.withColumnsRenamed({"class_id": "eval_class", "w": "a"}), "eval_class")
    pairs = _merged(first, w.withColumnsRenamed({"class_id": "train_class", "w": "b"}), "train_class")
    common = F.size(F.array_intersect("a", "b"))
    pairs = pairs.withColumn("similarity", common / (F.size("a") + F.size("b") - common)).where(F.col("similarity") >= least - 1e-12).select("train_class", "eval_class", "similarity")
    same = sets.where("t and e").select(F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class"), F.lit(1.0).alias("similarity"))
    return cut(pairs.unionByName(same)), members


def overlap_pairs(records: DataFrame, key: str = "qa_id", **how) -> DataFrame:
    """<key stem>_a, _b (smaller first), similarity: every pair of a training and an evaluation record that overlap.

    A class of very many training copies is cut into parts, each of which meets its partners in another task.
    """
    pairs, members = overlaps(records, key, **how)
    m = members.select("class_id", F.col(key).alias("_k"), "in_train")
    parts = m.where("in_train").groupBy("class_id").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("parts")).where("parts > 1")
    split = lambda df, c: _merged(df, parts.withColumnRenamed("class_id", c), c, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    tr = split(m.where("in_train").select(F.col("class_id").alias("train_class"), F.col("_k").alias("_t")), "train_class").withColumn("part", F.pmod(F.xxhash64("_t"), F.col("parts")).cast("int")).drop("parts")
    asked = split(pairs, "train_class").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    ev = m.where("not in_train").select(F.col("class_id").alias("eval_class"), F.col("_k").alias("_e"))
    both = _merged(_merged(asked, ev, "eval_class"), tr, ["train_class", "part"])
    stem = key.removesuffix("_id")
    return both.select(F.least("_t", "_e").alias(f"{stem}_a"), F.greatest("_t", "_e").alias(f"{stem}_b"), "similarity")


def overlap_report(records: DataFrame, key: str = "qa_id", split: str = "split", source: str = "source", version: str = "loaded_at", **how) -> DataFrame:
    """split, source, n_records, n_exact, n_near, n_links of the evaluation records.

    n_exact: records whose set of words is also that of a training record; n_near: those that only have nearly the same.
    n_links counts the training records that overlap, without expanding classes of copies into pairs. Split and source
    are those of the row of a key that counts.
    """
    pairs, members = overlaps(records, key, split, version=version, more=[split, source], **how)
    in_train = members.where("in_train").groupBy(F.col("class_id").alias("train_class")).agg(F.count(F.lit(1)).alias("copies"))
    links = _merged(pairs, in_train, "train_class").groupBy(F.col("eval_class").alias("class_id")).agg(F.max("similarity").alias("best"), F.sum("copies").alias("links"))
    ev = members.where("not in_train").groupBy("class_id", split, source).agg(F.count(F.lit(1)).alias("n"))
    x = _merged(ev, links, "class_id", "left")
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return x.groupBy(split, source).agg(F.sum("n").alias("n_records"), some(F.col("best") >= 1.0).alias("n_exact"), some(F.col("best") < 1.0).alias("n_near"), F.coalesce(F.sum(F.col("n") * F.col("links")), F.lit(0)).alias("n_links"))
