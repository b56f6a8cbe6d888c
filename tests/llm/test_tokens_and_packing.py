import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm.bpe import BYTE_BPE_50K, count_tokens, encode, merges
from factloom.llm.packing import containers, first_fit_decreasing, pack

ODD = ["", " ", "a", "aaaaaaa", "  \n\t x", "don't we'll", "é😀\u200b日本", "<|endoftext|>", "0" * 3001, "ab" * 20_000, "\x1c\x1d\x85\u3000z"]


def reference():
    t = Tokenizer.from_file(BYTE_BPE_50K)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_same_ids_as_the_public_tokenizer(texts):
    ids, begin = merges(BYTE_BPE_50K).encode_texts(texts)
    ref = reference()
    assert [ids[begin[i] : begin[i + 1]].tolist() for i in range(len(texts))] == [ref(t) for t in texts]


def test_encode_nulls_odd_texts_and_repeats(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(99, None, "x", 1), (0, ODD[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in encode(df).collect())
    ref = reference()
    assert got == sorted((r[0], tuple(ref(r[1] or ""))) for r in rows)
    assert sorted(map(tuple, count_tokens(df).collect())) == sorted((k, len(v)) for k, v in got)
    assert encode(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_first_fit_matches_a_linear_search(sizes):
    sizes = sorted(sizes, reverse=True)
    room, want = [], []
    for s in sizes:
        i = next((i for i, r in enumerate(room) if r >= s), len(room))
        if i == len(room):
            room.append(50)
        room[i] -= s
        want.append(i)
    assert first_fit_decreasing(sizes, 50) == want


def test_pack_splits_only_long_rows(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, None, 5, 700, 2048, 2049, 9000]), "z") for i in range(500)] + [(1, 10, "z")]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long, piece string")
    got = pack(df, 2048).collect()
    per = {}
    for r in got:
        per.setdefault(r["doc_id"], []).append(r["n_tokens"])
    for k in range(500):
        total = sum(n or 0 for i, n, _ in sizes if i == k)
        assert sum(per[k]) == total and (total > 2048 or k == 1 or len(per[k]) == 1)
    c = containers(pack(df, 2048)).collect()
    assert max(r["n_tokens"] for r in c) <= 2048 and sum(r["unused"] for r in c) / (2048 * len(c)) < 0.05
    assert pack(df.limit(0)).count() == 0
    assert pack(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(0).alias("n_tokens"))).select("container").distinct().count() == 1
