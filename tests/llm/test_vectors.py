import numpy as np

from factloom.llm.vectors import Settings, decode, encode, fit, neighbour_rows, neighbours, similar_pairs

SCHEMA = "fact_idx long, embedding array<float>, encoded_at timestamp, c long, h string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], None, 0, "x") for i, v in rows], SCHEMA)


def brute(rows, k=8):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids]).astype(np.float32).astype(float)
    out = {}
    for n, i in enumerate(ids):
        s = np.round(x @ x[n], 6)
        s[n] = -9
        order = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[: min(k, len(ids) - 1)]
        out[i] = [(ids[j], s[j]) for j in order]
    return out


def clustered(n, rng):
    centre = rng.normal(size=(12, 64))
    return [(i, (centre[i % 12] + 0.4 * rng.normal(size=64)).astype(np.float16).astype(np.float32)) for i in range(n)]


def test_recall_on_clustered_vectors(spark):
    rows = clustered(3000, np.random.default_rng(0))
    got = {r["fact_idx"]: {x["neighbour"] for x in r["near"]} for r in neighbours(table(spark, rows)).collect()}
    want = brute(rows)
    hits = sum(len(got[i] & {j for j, _ in w}) for i, w in want.items())
    assert len(got) == 3000 and hits / sum(map(len, want.values())) >= 0.9


def test_small_tables_are_exact_with_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=64).astype(np.float16).astype(np.float32)
    rows = [(i, v * (2.0 if i % 2 else 1.0)) for i in range(40)] + clustered(60, rng)[40:]
    bad = [(200, None), (201, np.zeros(64)), (202, np.full(64, np.nan)), (203, v[:10]), (204, np.r_[v[:63], np.inf]), (205, [])]
    s = Settings(rerank=(64, 64), probes=32)
    got = {r["fact_idx"]: [(x["neighbour"], x["cosine"]) for x in r["near"]] for r in neighbours(table(spark, rows + bad), s=s).collect()}
    assert got == {i: [(j, float(c)) for j, c in w] for i, w in brute(rows).items()}


def test_repeated_rows_single_row_and_empty(spark):
    v = np.ones(64)
    assert [list(r["near"]) for r in neighbours(table(spark, [(1, v), (1, v)])).collect()] == [[]]
    near = neighbours(table(spark, [(1, v), (1, v), (2, v)]))
    assert {(r["fact_a"], r["fact_b"]) for r in similar_pairs(near).collect()} == {(1, 2)}
    assert neighbour_rows(neighbours(table(spark, [(1, None)]))).count() == 0


def test_codes_get_closer_with_each_codebook():
    x = np.random.default_rng(2).normal(size=(2000, 64)).astype(np.float32)
    s = Settings(books=4)
    books = fit(x, [16], s)
    errors = [((x - decode(encode(x, books[:m], 3)[1], books[:m])) ** 2).sum(1).mean() for m in range(1, 6)]
    assert all(a > b for a, b in zip(errors, errors[1:]))
    assert ((x - decode(encode(x, books, 4)[1], books)) ** 2).sum() <= ((x - decode(encode(x, books, 1)[1], books)) ** 2).sum()


def test_cells_of_several_books_hold_as_much_at_any_size(spark):
    s = Settings()
    for n in (1_000, 300_000, 30_000_000, 3_000_000_000):
        cells = np.prod([float(x) for x in s.levels(n)])
        assert n / cells / s.hold < 2 and max(s.levels(n)) <= s.lead
    rows = clustered(3000, np.random.default_rng(3))
    small = Settings(hold=100, lead=4, words=16)
    assert len(small.levels(3000)) == 2
    got = {r["fact_idx"]: {x["neighbour"] for x in r["near"]} for r in neighbours(table(spark, rows), s=small).collect()}
    want = brute(rows)
    assert sum(len(got[i] & {j for j, _ in w}) for i, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_a_direction_of_very_many_keys_has_one_list(spark):
    v = np.random.default_rng(4).normal(size=(3, 64)).astype(np.float32)
    got = {r["fact_idx"]: [x["neighbour"] for x in r["near"]] for r in neighbours(table(spark, [(i, v[0]) for i in range(1100)] + [(2000, v[1]), (2001, v[2])])).collect()}
    assert len(got) == 1102 and got[1000] == list(range(8)) and got[3] == [0, 1, 2, 4, 5, 6, 7, 8] and len(got[2000]) == 8


def test_second_codebook_follows_the_vectors_around_each_word_of_the_first(spark):
    """clusters lie in other directions around each word, which one codebook for all words can't hold."""
    rng = np.random.default_rng(6)
    centre = np.repeat(3 * rng.normal(size=(16, 64)), 32, axis=0) + 0.4 * rng.normal(size=(512, 64))
    rows = [(i, (centre[i % 512] + 0.25 * rng.normal(size=64)).astype(np.float32)) for i in range(6400)]
    s = Settings(hold=50, lead=16, probes=1)
    assert s.levels(6400) == [16, 8]
    got = {r["fact_idx"]: {x["neighbour"] for x in r["near"]} for r in neighbours(table(spark, rows), s=s).collect()}
    want = brute(rows)
    assert sum(len(got[i] & {j for j, _ in w}) for i, w in want.items()) / sum(map(len, want.values())) >= 0.95
