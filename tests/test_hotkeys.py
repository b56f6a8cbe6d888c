import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.operators.hotkeys import clean_key, hot_pairs, key_quantiles, key_report

FACT = "source string, relation string, id string, loaded_at timestamp, extra string, _k0 string"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def test_clean_key(spark):
    rows = spark.createDataFrame([(" Drug-Drug ",), ("drug  _-drug",), (" DRUG DRUG",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(clean_key("x")).collect()] == ["drug_drug", "drug_drug", "drug_drug", "", None]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_quantiles_match_sorting(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([rng.randrange(-(10**15), 10**15), rng.randrange(5), None])) for _ in range(300)]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in key_quantiles(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", probs).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        vs = sorted(v for kk, v in rows if kk == k and v is not None)
        for p in probs:
            want[k, p] = vs[max(1, -(-int(p * 1000) * len(vs) // 1000)) - 1]
    assert got == want


def test_report_counts_rows_ids_and_latest(spark):
    rows = [("S", "Rel-A", "1", at(5), "x", "y"), ("s ", "rel a", "1", at(9), "x", "y"), ("s", "rel_a", None, None, "x", "y"), ("s", None, "9", at(1), None, None), (None, "rel_a", "9", at(1), None, None)]
    r = {(x["source"], x["relation"]): x for x in key_report(spark.createDataFrame(rows, FACT)).collect()}
    assert list(r) == [("s", "rel_a")]
    x = r["s", "rel_a"]
    assert (x["n_rows"], x["n_ids"], x["share"], x["median_loaded"], x["latest_loaded"]) == (3, 1, 0.6, at(5), at(9))


def test_hot_pairs_and_empty_table(spark):
    rows = [("a", "r", str(i), at(i), None, None) for i in range(96)] + [("b", "r", str(i), at(i), None, None) for i in range(4)]
    assert {tuple(r) for r in hot_pairs(spark.createDataFrame(rows, FACT)).collect()} == {("a", "r"), ("b", "r")}
    assert {tuple(r) for r in hot_pairs(spark.createDataFrame(rows, FACT), 0.05).collect()} == {("a", "r")}
    assert hot_pairs(spark.createDataFrame([], FACT)).count() == 0


def test_ties_all_equal(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), F.lit(7).alias("v"))
    assert {r["quantile"] for r in key_quantiles(df, ["k"], "v", [0.1, 0.5, 1.0]).collect()} == {7}


def test_extreme_values_and_keys_without_values(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([("a", -big - 1), ("a", big), ("a", 0), ("b", None), (None, 5)], "k string, v long")
    got = {(r["k"], r["prob"]): r["quantile"] for r in key_quantiles(df, ["k"], "v", [0.1, 0.5, 1.0]).collect()}
    assert got == {("a", 0.1): -big - 1, ("a", 0.5): 0, ("a", 1.0): big, (None, 0.1): 5, (None, 0.5): 5, (None, 1.0): 5}
