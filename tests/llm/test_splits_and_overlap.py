import random

import pytest

from factloom.llm.overlap import overlap_pairs, overlap_report, overlaps
from factloom.llm.splits import assign_splits, drug_keys, linked_groups, molecule_key, stratify

REC = "qa_id long, drug_name string, decoded_smiles string, task_type string, source string, split string, question string, input_molecule_or_context string, gold_answer string, loaded_at string, k string, keys string"


def rec(i, drug=None, smiles=None, split="train", q="", c=None, a="", task="t", at="1"):
    return (i, drug, smiles, task, "s", split, q, c, a, at, "k", "keys")


@pytest.mark.parametrize("a, b", [("Foxazol", "FOXAZOL® 5 mg tablets"), ("Foxazol", "fox-azol  hydrochloride"), ("Foxazol", "'Fox\u00adazol'"), ("Foxazol", "Foxazol HCl (40 mg)"), ("Foxazol", "\tFoxazol(R) 0.5 mg/ml oral solution\n"), ("Po rsefamab", "Porsefamab"), ("Fóxazol", "foxazol")])
def test_one_drug_written_in_several_ways(a, b):
    assert drug_keys(a) == drug_keys(b) != []


def test_drugs_apart():
    assert drug_keys("Foxazol") != drug_keys("Foxazole")
    assert drug_keys("Foxazol + Barmab and Zixin") == ["foxazol", "barmab", "zixin"]
    for x in (None, "", "  ", "-", "N/A", "not specified", "Unknown", "?", "none"):
        assert drug_keys(x) == []
    assert molecule_key(" CC.Cl\n") == molecule_key("Cl.CC") != molecule_key("CC")
    for x in (None, "", " ", "-", "invalid", "None", "n/a"):
        assert molecule_key(x) is None


def test_groups_match_union_find(spark):
    rng = random.Random(5)
    rows = [rec(i, rng.choice([None, "unknown", "Hotmab", *[f"Drug{chr(97 + j)}x" for j in range(20)], "Drugax + Drugbx"]), rng.choice([None, "-", *[f"C{'C' * j}" for j in range(12)]])) for i in range(120)]
    rows += [rec(3, "Drugcx", "CCCC"), rec(None, "Hotmab", None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        if r[0] is not None:
            root(r[0])
            for k in [*drug_keys(r[1]), *([("m", molecule_key(r[2]))] if molecule_key(r[2]) else [])]:
                parent[root(k)] = root(r[0])
    first = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        first[root(i)] = min(i, first.get(root(i), i))
    got = {r["qa_id"]: r["group_id"] for r in linked_groups(spark.createDataFrame(rows, REC)).collect()}
    assert got == {i: first[root(i)] for i in got} and len(got) == 120


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(6)
    rows = [rec(i, f"Drug{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(20))}ix", None, task=rng.choice(["a", "a", "a", "b", None])) for i in range(900)] + [rec(900 + i, "Hotmab", None, task="b") for i in range(300)]
    got = assign_splits(spark.createDataFrame(rows, REC)).collect()
    by = {}
    for r in got:
        by.setdefault(r["group_id"], set()).add(r["assigned_split"])
    n = {s: sum(r["assigned_split"] == s for r in got) for s in ("train", "valid", "test")}
    assert len(got) == 1200 and all(len(v) == 1 for v in by.values())
    assert abs(n["train"] - 960) < 40 and abs(n["valid"] - 120) < 30 and abs(n["test"] - 120) < 30
    assert assign_splits(spark.createDataFrame([], REC)).count() == 0


def test_rarest_label_goes_first():
    want = [{"rare": 1.0, "c": 8.0}, {"rare": 1.0, "c": 2.0}]
    placed = stratify([("g1", 1, {"rare": 1}), ("g2", 1, {"rare": 1}), *[(f"c{i}", 1, {"c": 1}) for i in range(10)]], want, [9.0, 3.0])
    assert {placed["g1"], placed["g2"]} == {0, 1} and sum(placed[f"c{i}"] for i in range(10)) == 2


def test_overlaps_match_brute_force(spark):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(8)]
    rows = []
    for i in range(160):
        base = random.Random(i // 4).sample([f"x{j}" for j in range(400)], 12) + common[: rng.randrange(8)]
        base = [w if rng.random() > 0.08 else rng.choice(common) for w in base]
        rows.append(rec(i, split=rng.choice(["train", "valid", "test"]), q=" ".join(base[:5]), c=rng.choice([None, " ".join(base[5:])]) or " ".join(base[5:]), a="ÄB! ab"))
    rows += [rec(300, split="train", q="one"), rec(301, split="test", q="ONE"), rec(302, split="test", q=None, a=None), rec(303, split="train", q="!"), rec(304, split=None, q="one"), rec(300, split="train", q="old", at="0")]
    rows += [rec(400 + i, split="train" if i % 2 else "test", q="same words here") for i in range(30)]
    import re

    sets = {r[0]: (frozenset(re.findall("[a-z0-9]+", " ".join(x or "" for x in r[6:9]).lower())), r[5]) for r in rows if r[9] == "1" and r[5]}
    want = set()
    for i, (a, s) in sets.items():
        for j, (b, t) in sets.items():
            if i < j and (s == "train") != (t == "train") and a and b and len(a & b) / len(a | b) >= 0.8:
                want.add((i, j))
    df = spark.createDataFrame(rows, REC)
    assert {(r["qa_a"], r["qa_b"]) for r in overlap_pairs(df).collect()} == want and len(want) > 230
    pairs, members = overlaps(df)
    assert pairs.where("train_class = eval_class").count() >= 1 and members.count() == len({i for i, (a, _) in sets.items() if a})
    rep = {r["split"]: r for r in overlap_report(df).collect()}
    assert rep["test"]["n_exact"] >= 16 and sum(r["n_links"] for r in rep.values()) == len(want)
    assert overlap_pairs(df.limit(0)).count() == 0
