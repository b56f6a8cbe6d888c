import inspect
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from factloom.llm.defects import Endings, Languages, Seen, defects, models_of, one_defect, votes
from factloom.llm.labels import cutoff, fit, posterior
from factloom.llm import leaks as leaks_module
from factloom.llm.leaks import Automaton, leak_report, leaks, located_words, remove_leaks, words
from factloom.llm.pii import candidates, common_words, learn, personal_information, redacted

ITEM = "When the first valve is closed the second valve opens slowly and the pressure in the vessel falls to half of its former value"


def test_words_ignore_markup_and_line_ends():
    want = words(ITEM)
    for x in (ITEM.upper(), ITEM.replace(" ", "\n> "), ITEM.replace("slowly", "slow-\nly"), ITEM.replace("valve", "<b>valve</b><sup>2</sup>", 1), ITEM.replace("vessel", "ves\u00adsel [12, 14]"), "**" + ITEM.replace(",", "") + "**", ITEM.replace("pressure", "“pressure”²")):
        assert words(x) == want, x
    assert words(None) == words("") == words(" \u200b") == []


def test_longest_matches_equal_brute_force():
    rng = np.random.default_rng(3)
    items = [(k, [str(x) for x in rng.integers(0, 4, 25)]) for k in range(6)] + [(0, [str(x) for x in rng.integers(0, 4, 25)])]
    auto = Automaton(items, 3)
    for _ in range(40):
        doc = [str(x) for x in rng.integers(0, 5, 60)]
        want = {}
        for k, s in items:
            for a in range(len(s)):
                for b in range(len(s), a + 2, -1):
                    if any(doc[i : i + b - a] == s[a:b] for i in range(len(doc))):
                        want[k] = max(want.get(k, 0), b - a)
                        break
        assert auto.matches(doc, dict.fromkeys(range(6), 3)) == want


def test_leaks(spark):
    w = ITEM.split()
    items = spark.createDataFrame([(1, ITEM, "short answer", "z"), (2, None, ITEM + " today", "z"), (3, "", "", "z")], "item_id long, text string, gold_answer string, n_words string")
    docs = spark.createDataFrame([(10, "x " + " ".join(w[:12]) + " y", 0), (11, " ".join(w[:11]), 0), (12, None, 0), (13, "", 0), (14, "short answer", 0), (15, "a " * 50_000 + ITEM + " today", 0)], "doc_id long, text string, i int")
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in leaks(docs, items).collect()}
    assert got == {(10, 1): 12, (10, 2): 12, (15, 1): len(w), (15, 2): len(w) + 1}
    assert {r["item_id"]: r["n_whole"] for r in leak_report(leaks(docs, items)).collect()} == {1: 1, 2: 1}
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB é\u0301ßﬁ²\u00ad-‐\n\r >|<b>/[1]^&;amp&#39;†.,\u200b가\u1100\u1161İ5_"), max_size=60))
def test_words_are_located_where_they_stand(text):
    found, start, end = located_words(text)
    assert found == words(text)
    assert all(0 <= a < b <= len(text) for a, b in zip(start, end)) and start == sorted(start)


def test_removed_spans(spark, monkeypatch):
    w = ITEM.split()
    items = spark.createDataFrame([(1, ITEM, "six short words stand right here")], "item_id long, text string, gold_answer string")
    inside = "Before. " + "  ".join(w[:7]) + "<b> " + " ".join(w[7:13]).upper() + "</b>, after 5 &lt; 6."
    docs = spark.createDataFrame([(1, inside, 0), (2, "kept\n as  it is ", 0), (3, None, 0), (4, "", 0), (5, f"{ITEM} between {ITEM}", 0), (6, "so six short words stand right now", 0), (1, inside, 0)], "doc_id long, text string, n_removed int")
    for block_words in (400_000, 3):
        monkeypatch.setattr(leaks_module, "BLOCK_WORDS", block_words)
        got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in remove_leaks(docs, items).collect()), key=lambda r: r[0])
        clean = "Before. </b>, after 5 &lt; 6."
        assert got == [(1, clean, 13), (1, clean, 13), (2, "kept\n as  it is ", 0), (3, None, 0), (4, "", 0), (5, "between", 2 * len(w)), (6, "so six short words stand right now", 0)]
        short = {r["doc_id"]: (r["text"], r["n_removed"]) for r in remove_leaks(docs, items, coverage=0.8).collect()}
        assert short[6] == ("so now", 5)
        assert {(r["doc_id"], r["n_words"]) for r in leaks(docs, items, coverage=0.8).collect()} == {(1, 13), (5, len(w)), (6, 5)}
    assert remove_leaks(docs.limit(0), items).count() == 0 and remove_leaks(docs, items.limit(0)).where("n_removed > 0").count() == 0


def test_blocks_of_items_match_as_one(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20)), None) for i in range(9)], "item_id long, text string, gold_answer string")
    docs = items.selectExpr("item_id as doc_id", "concat('a b ', text) as text")
    monkeypatch.setattr(leaks_module, "BLOCK_WORDS", 50)
    assert {(r["doc_id"], r["item_id"], r["n_words"]) for r in leaks(docs, items).collect()} == {(i, i, 20) for i in range(9)}


def test_label_model_finds_reliabilities():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.15
    right = [0.95, 0.9, 0.7]
    votes_ = np.stack([np.where(rng.random(len(y)) < r, y, ~y).astype(int) for r in right], 1)
    p, n = np.unique(votes_, axis=0, return_counts=True)
    post = posterior(p, *fit(p, n.astype(float)))
    least = cutoff(post, n)
    guess = {tuple(a): b >= least for a, b in zip(p, post)}
    assert np.mean([guess[tuple(v)] == t for v, t in zip(votes_, y)]) > 0.93


SENTENCES = [f"The {a} of the {b} valve is {c} in the first hour." for a in ("pressure", "heat", "weight", "level") for b in ("upper", "lower", "inner") for c in ("low", "high", "stable")] * 12


def test_votes():
    end, lang = Endings(SENTENCES), Languages(SENTENCES)

    def top(q, a, task="t"):
        v = votes(q, a, task, end, lang)
        at = {"empty": v[:3], "refusal": v[3:10], "copied_question": v[10:13], "other_language": v[13:16], "truncated": v[16:]}
        return {k for k, x in at.items() if 1 in x}

    q = "What is the pressure of the upper valve?"
    for a in (None, "", " \n", "\u200b", "N/A", "**Answer:**", "<answer></answer>", "```\n```", "[no output]", "-", "[no content]", "(nothing here)", "no data available", "keine Antwort"):
        assert "empty" in top(q, a), a
    assert top(q, "I'm sorry, but I can't help with that.") == {"refusal"} and top(q, "I'm sorry, but I can't help with that.", "refusal") == set()
    assert top(q, "Patients who cannot swallow the tablet should not take it.") == set()
    for a in (q, "Q: " + q.upper() + "\nA:", q + "\n" + q, "Re: " + q[:-1]):
        assert "copied_question" in top(q, a), a
    assert "other_language" in top(q, "Der Druck ist in der ersten Stunde nicht hoch und wird dann von der Pumpe gehalten.")
    assert "truncated" in top(q, "The pressure of the upper (") and "truncated" in top(q, "The heat of the lower valve is high in the")
    assert top(q, "The heat of the lower valve is high in the first hour") == set()
    assert top(q, "1.25") == set() and top(q, "CC(=O)C1CCNCC1") == set()
    assert votes(None, "x", None, end, lang) and top(None, "The level of the inner valve is low in the first hour.") == set()


def test_languages_of_all_texts_at_once():
    lang = Languages(SENTENCES + ["Der Druck ist in der ersten Stunde nicht hoch und wird dann von der Pumpe gehalten."] * 40)
    texts = ["", "ab", *SENTENCES[:5], "Der Druck ist nicht hoch in der Pumpe", "x" * 5000, "Die Pumpe wird gehalten"]
    assert lang.of_all(texts) == [lang.of(t) for t in texts] and lang.of_all([]) == [] and lang.of_all(["", ""]) == [None, None]


def test_defects_of_a_table(spark):
    q = "What is the pressure of the upper valve?"
    rows = [(i, q, "t", s, s, f"2024-01-{1 + i % 9:02d}", "v") for i, s in enumerate(SENTENCES)]
    rows += [(1000 + i, q, "t", a, None, "2024-01-01", "v") for i, a in enumerate([None, " ", q, "I cannot help with this request.", "The pressure of the ("] * 4)]
    rows += [(1000, q, "t", "stale", "stale", "2023-01-01", "v"), (None, q, "t", None, None, None, "v")]
    df = spark.createDataFrame(rows, "pred_id long, question string, task_type string, prediction string, reference_output string, loaded_at string, p string")
    got = {(r["pred_id"], r["field_name"]): r["defect"] for r in one_defect(defects(df)).collect()}
    assert [got.get((1000 + i, "prediction")) for i in range(5)] == ["empty", "empty", "copied_question", "refusal", "truncated"]
    assert all(got[1000 + i, "reference_output"] == "empty" for i in range(20)) and len(got) == 40
    assert one_defect(defects(df.limit(0))).count() == 0


def test_models_come_from_all_rows(spark):
    german = ["Der Druck ist in der ersten Stunde nicht hoch und wird dann von der Pumpe gehalten.", "Die Pumpe wird mit der Hand bedient. Sie ist nicht schwer"]
    rows = [(i, f, "What is the pressure of the upper valve?", s) for i, s in enumerate(SENTENCES[:60] + german + [None, "", "x" * 50_000, "One more. Two more of 3.5 mg. The end is near!"]) for f in ("a", "b")]
    want_language = Languages([t for _, _, q, a in rows for t in (q, a) if t])
    seen = Seen()
    seen.add_sentences([a for *_, a in rows if a])
    assert seen.sentences == 2 * 63
    one = None
    for parts in (1, 5):
        end, lang = models_of(spark.createDataFrame(rows, "k long, field_name string, q string, a string").repartition(parts))
        assert np.array_equal(lang.log, want_language.log)
        assert end.known == frozenset(w for w, n in seen.words.items() if n >= 5) and "pressure" in end.known and "druck" not in end.known
        one = end if one is None else one
        assert np.array_equal(end.model.w, one.model.w) and end.model.w.any()
    # Nothing of the rows can be left out: each word and each sentence that is added shows.
    more = models_of(spark.createDataFrame([*rows, (999, "a", None, "The rotor is not heavy when it is empty.")], "k long, field_name string, q string, a string"))
    assert not np.array_equal(more[0].model.w, one.model.w) and not np.array_equal(more[1].log, want_language.log)
    assert "sample" not in inspect.signature(defects).parameters
    empty = models_of(spark.createDataFrame([], "k long, field_name string, q string, a string"))
    assert not empty[0].known and not empty[0].model.w.any()


def test_copies_of_a_cut_answer_are_found():
    q, short = "What is the pressure of the upper valve?", "The heat of the lower"
    lang = Languages(SENTENCES)
    once, often = (votes(q, short, "t", Endings(SENTENCES + [short] * n), lang)[16:] for n in (1, 200))
    assert once == often and 1 in often


NAMES = frozenset(["kyvi", "joric"])


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("Write to <a.b+c@x-y.test>.", "email", "a.b+c@x-y.test"),
        ("cc joe [at] mail [dot] example; no", "email", "joe [at] mail [dot] example"),
        ("Call 020 7946 0528 after six.", "phone", "020 7946 0528"),
        ("Llamar al (+34) 555010185.", "phone", "(+34) 555010185"),
        ("SSN QQ 12 53 25 C.", "id_number", "QQ 12 53 25 C"),
        ("Record number MRN QQ392050C was opened.", "id_number", "QQ392050C"),
        ("She lives at Flat 3, 120 Copper Mill Court, Dunmere PX4 7DF.", "address", "Flat 3, 120 Copper Mill Court, Dunmere PX4 7DF"),
        ("Wohnhaft in Am Mühlbach 192, 86300 Grauwinkel.", "address", "Am Mühlbach 192, 86300 Grauwinkel"),
        ("Elle habite 33, avenue du Puits, 18206 Lessignac.", "address", "33, avenue du Puits, 18206 Lessignac"),
        ("Signed: FENNOW, Kyvi\nThe end", "name", "FENNOW, Kyvi"),
        ("Mme R. Thorbova a signalé", "name", "R. Thorbova"),
        ("Herr Libet K. Pellhurst klagte", "name", "Libet K. Pellhurst"),
        ("Gezeichnet: A. Svedaux-Bravetti Telefon 030", "name", "A. Svedaux-Bravetti"),
        ("Then Kyvi QUAROVER-MARLOVA asked whether", "name", "Kyvi QUAROVER-MARLOVA"),
    ],
)
def test_candidate_spans(text, kind, value):
    assert (kind, value) in {(c[2], c[3]) for c in candidates(text, NAMES, frozenset(["the", "then", "signed"]))}


@pytest.mark.parametrize(
    "text, value",
    [
        ("Herr Libet Pellhurst, Am Mühlbach 192, 86300 Grauwinkel", "Libet Pellhurst"),
        ("Kyvi Fennow, Flat 3, 120 Copper Mill Court, Dunmere PX4 7DF", "Kyvi Fennow"),
        ("Kyvi Fennow, K.Fennow@x.test", "Kyvi Fennow"),
        ("Kyvi Fennow\n120 Copper Mill Court, Dunmere PX4 7DF", "Kyvi Fennow"),
        ("120 Copper Mill Court, Dunmere PX4 7DF, Kyvi Fennow", "Kyvi Fennow"),
    ],
)
def test_names_beside_addresses_and_emails(text, value):
    found = candidates(text, NAMES, frozenset())
    votes_ = {c[3]: c[4] for c in found if c[2] == "name"}
    assert votes_.keys() == {value} and votes_[value][5] == -1
    assert {"address", "email"} & {c[2] for c in found}
    assert next(c[4][5] for c in candidates("Kyvi Fennow 120 ran on", NAMES, frozenset())) == 0


def test_personal_information(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = spark.read.parquet(f"{sf}/given_names.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = personal_information(docs, names).collect()
    assert {r["pii_type"] for r in found} == {"email", "phone", "id_number", "address", "name"}
    assert all(r["pii_value"] in text[r["doc_id"]] for r in found)
    assert not any(re.search(r"cohort|syndrome|NCT|PMID", r["pii_value"]) for r in found)
    for r in redacted(docs, names).collect():
        if not text[r["doc_id"]]:
            assert r["text"] == text[r["doc_id"]]
        elif r["n_spans"]:
            assert re.search(r"\[(EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\]", r["text"])
    assert personal_information(docs.limit(0), names).count() == 0
    model, _ = learn(docs, names.limit(0))
    assert model.given == frozenset()


def test_names_of_repeated_documents_are_found(spark, sf):
    sf = sf.replace("0.001", "0.01")
    names = spark.read.parquet(f"{sf}/given_names.parquet").unionByName(spark.createDataFrame([("Kyvi", 1)], "given_name string, n_seen long"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    copied = "The tablet was stopped. Signed: Kyvi Fennow\nSeen by Dr Pellhurst on the ward. Mail k.fennow@x.test today."
    samples = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega"]
    near = [f"The {a} sample of {b} was taken. Signed: Joric Marlgate\nSeen by Dr Bravover on the ward." for a in samples for b in samples]
    many = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([copied] * 60 + near)], "doc_id long, text string")
    names = names.unionByName(spark.createDataFrame([("Joric", 1)], "given_name string, n_seen long"))
    docs = docs.unionByName(many)
    found = {}
    for r in personal_information(docs, names).where("doc_id >= 1000000 and pii_type = 'name'").collect():
        found.setdefault(r["doc_id"] - 10**6, set()).add(r["pii_value"])
    assert all(found.get(i) == {"Kyvi Fennow", "Pellhurst"} for i in range(60)), found.get(0)
    assert all(found.get(60 + i) == {"Joric Marlgate", "Bravover"} for i in range(49)), found.get(60)


def test_common_words_are_those_of_distinct_texts_in_lower_case(spark):
    rows = ["Dr Fennow saw the valve"] * 100 + [f"Dr Marlgate saw the valve {chr(97 + i % 26) * (2 + i // 26)} k.bravover@x.test" for i in range(100)]
    common, often = common_words(spark.createDataFrame([(r,) for r in rows], "t string"))
    assert common == {"saw", "the", "valve"} and often == {"dr", "marlgate"}


def test_a_rare_type_is_found_among_many_candidates(spark):
    rows = [f"On day {i} the valve was shut. Signed: Kyvi Fen{chr(97 + i % 26)}ow. Call +44 20 7946 {1000 + i} after six." for i in range(600)]
    rows += ["She lives at Flat 3, 120 Copper Mill Court, Dunmere PX4 7DF."] * 2
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    names = spark.createDataFrame([("Kyvi", 1)], "given_name string, n_seen long")
    model, scored = learn(docs, names, sample=60)
    assert {r["doc_id"] for r in scored.where("pii_type = 'address' and score > 0.5").collect()} == {600, 601}
    assert [s[2] for s in model.spans(rows[600])] == ["address"]


HELD_OUT = {
    "We have sent the bill to Harriet Penhaligon and heard nothing since.": "Harriet Penhaligon",
    "The rash came up after Ngozi Adeyemi doubled the tablets.": "Ngozi Adeyemi",
    "It was then decided with Priyanka Venkataraghavan Subramaniam, and nobody else, to wait.": "Priyanka Venkataraghavan Subramaniam",
    "Am Abend ist dann mit Wiebke Hollerstedt vereinbart worden, das Mittel abzusetzen.": "Wiebke Hollerstedt",
    "Le flacon fut remis à Solenne Kervadec, qui ne put le lire.": "Solenne Kervadec",
    "La caja fue entregada a Itziar Goikoetxea sin el prospecto.": "Itziar Goikoetxea",
    "Nobody but O. Tregellas had opened the cabinet.": "O. Tregellas",
}


def test_names_without_cue_or_list_in_other_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    given_names = spark.read.parquet("/root/testdata/sf0.01/given_names.parquet")
    more = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(HELD_OUT)], "doc_id long, text string")
    found = {}
    for r in personal_information(docs.unionByName(more), given_names).where("doc_id >= 1000000000 and pii_type = 'name'").collect():
        found.setdefault(r["doc_id"] - 10**9, set()).add(r["pii_value"])
    hits = sum(found.get(i) == {name} for i, name in enumerate(HELD_OUT.values()))
    assert hits >= 6, found


REWORDED = [
    "That's beyond my remit, so I'll leave it there.", "Answering this would be irresponsible of me.", "I'd prefer to stay away from this subject; it is not one for me.", "Questions of this kind are outside what our service may discuss.",
    "We are not in a position to say anything on that.", "I will pass on this one.", "Dazu möchte ich mich nicht äußern.", "Je préfère ne pas me prononcer, je ne suis pas en mesure de le dire.", "No puedo opinar sobre ese asunto.", "It would be wrong of me to guess here.",
]
PLAIN = [
    "Sorry outcomes were rare: 34 of 88 patients declined further treatment.", "Type I reactions must not be treated with this tablet.", "The tablet should not be given to patients who cannot swallow.", "No response was seen in 5 percent of the patients.",
    "Patients should ask a doctor before use.", "The effect is not known and the scope of the study was small.", "Factor I may not be raised in the first week.", "Treatment was refused by 3 of 40 patients.", "Das Präparat darf nicht gekaut werden.", "Avoid the sun after the infusion.",
]


def test_refusals_in_other_words(spark):
    p = spark.read.parquet("/root/testdata/sf0.01/predictions.parquet").select("pred_id", "question", "task_type", "prediction", "reference_output", "loaded_at")
    q = "What is the dose of the tablet in the first week after the infusion?"
    more = spark.createDataFrame([(10**9 + i, q, "factual", t, t) for i, t in enumerate(REWORDED + PLAIN + ["[no content]"])], "pred_id long, question string, task_type string, prediction string, reference_output string").withColumn("loaded_at", F.current_timestamp())
    got = {r["pred_id"] - 10**9: r["defect"] for r in one_defect(defects(p.unionByName(more))).where("pred_id >= 1000000000 and field_name = 'prediction'").collect()}
    refused = {i for i, d in got.items() if d == "refusal"}
    assert got.pop(20) == "empty"
    assert len(refused & set(range(10))) >= 9 and len(refused - set(range(10))) <= 1, got
