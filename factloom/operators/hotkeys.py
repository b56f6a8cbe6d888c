"""Per-key results when a few keys hold most rows.

Counts, distinct ids and exact order statistics are built from mergeable partial results only. The rows of a hot key
never meet in one task: a histogram of values a key gives the sizes of the keys, and for quantiles the range that holds
a rank is refined, with further histograms, until it is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.storage import checked_broadcast, cut

#: A histogram has at most 2 ** BITS ranges of values a key, and each refinement divides a range by as much.
BITS = 12
#: Ranges that are broadcast at most; more are merged.
BROADCAST_RANGES = 100_000


def clean_key(c: Column | str) -> Column:
    """Trimmed, lower-cased, each run of blanks, hyphens or underscores as one underscore. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    blank = r"[\s\x{00a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]"
    trimmed = F.regexp_replace(c, f"^{blank}+|{blank}+$", "")
    return F.regexp_replace(F.lower(trimmed), rf"(?:{blank}|[-_])+", "_")


class Histogram:
    """Counts of the rows of each key by ranges of a long value, mergeable and exact.

    A range is all values that agree in their bits from `shift` on; counts has a row a key and range that occurs, with how
    many rows, the least and the greatest value. Null values are a range of their own, null keys keys of their own.
    """

    def __init__(self, df: DataFrame, keys: list[str], value: str):
        self.keys, self.names = keys, [f"_k{i}" for i in range(len(keys))]
        self.rows = cut(df.select(*(F.col(k).alias(n) for k, n in zip(keys, self.names)), F.col(value).cast("long").alias("_v")))
        lo, hi = self.rows.agg(F.min("_v"), F.max("_v")).first()
        self.shift = 0
        while lo is not None and (hi >> self.shift) - (lo >> self.shift) >= 1 << BITS:
            self.shift += 1
        self.counts = cut(self._count(self.rows, self.shift))

    def _count(self, rows: DataFrame, shift: int, *by: str) -> DataFrame:
        return rows.groupBy(*self.names, *by, F.shiftright("_v", shift).alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    def named(self, df: DataFrame, *rest) -> DataFrame:
        return df.select(*(F.col(n).alias(k) for n, k in zip(self.names, self.keys)), *rest)

    def total(self) -> int:
        return self.counts.agg(F.sum("_c")).first()[0] or 0

    def sizes(self) -> DataFrame:
        """keys, n_rows: rows of each key, also those without a value."""
        return self.named(self.counts.groupBy(*self.names).agg(F.sum("_c").alias("n_rows")), "n_rows")

    def quantiles(self, probs: list[float]) -> DataFrame:
        """keys, prob, quantile: the smallest value whose rank is at least prob times the number of the key's values.

        A key without values has no row. A range that holds a rank is divided again until it is one value; only counts
        are shuffled, and a task that ranks has at most 2 ** BITS of them a key and prob.
        """
        names, shift = self.names, self.shift
        each = self.counts.where("_b is not null")
        n = F.sum("_c").over(Window.partitionBy(*names))
        upto = F.sum("_c").over(Window.partitionBy(*names).orderBy("_b"))
        seen = each.withColumn("_n", n).withColumn("_to", upto).withColumn("_p", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
        seen = seen.withColumn("_r", F.least(F.col("_n"), F.greatest(F.lit(1), F.ceil(F.col("_p") * F.col("_n")))))
        state = cut(self._holding(seen))
        while not state.where("_hi > _lo").isEmpty():
            open_ = state.where("_hi > _lo")
            wanted = checked_broadcast(open_.select(*names, F.col("_b").alias("_in")).distinct(), BROADCAST_RANGES, 128)[0]
            inside = self.rows.withColumn("_in", F.shiftright("_v", shift))
            inside = inside.join(wanted, [inside[c].eqNullSafe(wanted[c]) for c in [*names, "_in"]], "left_semi")
            shift = max(0, shift - BITS)
            finer = self._count(inside, shift, "_in").withColumnsRenamed({c: f"{c}_" for c in names})
            ranks = open_.select(*names, "_p", "_r", F.col("_b").alias("_o"))
            both = ranks.join(finer, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names] + [F.col("_o") == F.col("_in")])
            upto = F.sum("_c").over(Window.partitionBy(*names, "_p").orderBy("_b"))
            state = cut(state.where("_hi = _lo").unionByName(self._holding(both.withColumn("_to", upto))))
        return self.named(state, F.col("_p").alias("prob"), F.col("_lo").alias("quantile"))

    def _holding(self, seen: DataFrame) -> DataFrame:
        """The range that holds the rank, and the rank inside it."""
        before = F.col("_to") - F.col("_c")
        return seen.where((F.col("_to") >= F.col("_r")) & (before < F.col("_r"))).select(*self.names, "_p", (F.col("_r") - before).alias("_r"), "_b", "_lo", "_hi")


def key_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """keys, prob, quantile of a long value; see Histogram. An empty table has no rows."""
    return Histogram(df, keys, value).quantiles(probs)


def _loads(facts: DataFrame) -> Histogram:
    f = facts.select(clean_key("source").alias("source"), clean_key("relation").alias("relation"), F.unix_micros("loaded_at").alias("loaded"))
    return Histogram(f, ["source", "relation"], "loaded")


def key_report(facts: DataFrame, probs: list[float] = [0.5, 0.9, 1.0]) -> DataFrame:
    """source, relation, n_rows, n_ids, share, median_loaded, p90_loaded, latest_loaded of each cleaned pair.

    share is of all rows, also those with a null in either field, which belong to no pair. Rows are counted by the
    histogram of loads, ids in two steps, so that the ids of a hot pair spread over all tasks; null ids and null loads
    don't count. An empty table has no pairs.
    """
    keys = ["source", "relation"]
    loads = _loads(facts)
    named = lambda df: df.where("source is not null and relation is not null")
    ids = named(facts.select(clean_key("source").alias("source"), clean_key("relation").alias("relation"), "id")).where("id is not null").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ids"))
    wide = named(loads.quantiles(probs)).groupBy(*keys).pivot("prob", [float(p) for p in probs]).agg(F.first("quantile"))
    wide = wide.select(*keys, *(F.timestamp_micros(F.col(f"`{float(p)}`")).alias(n) for p, n in zip(probs, ["median_loaded", "p90_loaded", "latest_loaded"])))
    sizes = named(loads.sizes()).join(ids, keys, "left").join(wide, keys, "left").fillna(0, ["n_ids"])
    return sizes.withColumn("share", F.col("n_rows") / F.lit(max(loads.total(), 1)))


def hot_pairs(facts: DataFrame, least_share: float = 0.04) -> DataFrame:
    """Pairs that hold at least least_share of all rows, by the counts of the histogram of their loads."""
    loads = _loads(facts)
    return loads.sizes().where("source is not null and relation is not null").where(F.col("n_rows") >= least_share * max(loads.total(), 1)).select("source", "relation")
