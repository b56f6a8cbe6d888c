"""Splits that keep linked records together: components over drugs and molecules, then grouped iterative stratification."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graphs import connected_components, lookup
from factloom.storage import cut

# Words that don't tell drugs apart, and what stands for "not known".
SALTS = """acetate adipate ascorbate aspartate axetil benzoate besilate besylate bisulfate bitartrate bromide calcium
carbonate chloride cilexetil citrate diacetate dihydrate dihydrochloride disodium disoproxil edisylate ethanolate
esylate fumarate gluceptate gluconate glucuronate glutamate hcl hbr hemihydrate hydrate hydrobromide hydrochloride
hydrochlorid iodide isethionate lactate lysine magnesium malate maleate medoxomil mesilate mesylate monohydrate
monosodium mucate napsylate nitrate oleate oxalate palmitate pamoate phosphate pivoxil potassium propionate salicylate
sesquihydrate sodium stearate succinate sulfate sulphate tartrate tosilate tosylate trihydrate tromethamine valerate
xinafoate zinc""".split()
FORMS = """aerosol ampoule ampoules amp buccal caplet caplets capsule capsules caps cap chewable concentrate coated cream
delayed depot drops elixir emulsion enema extended film foam for gel granules im immediate implant inhalation inhaler
infusion inj injectable injection intramuscular intravenous iv kit liquid lotion lozenge lozenges modified nasal
ointment ophthalmic oral patch patches pellets pen pill pills po powder prefilled release rectal sachet sachets sc
solution spray subcutaneous sublingual suppositories suppository suspension sustained syringe syrup tab tablet tablets
tabs topical transdermal vial vials xr er sr cr ir dr odt""".split()
UNKNOWN = """na nan none null nil unknown unspecified notspecified notavailable notknown notapplicable notstated
notreported notgiven notprovided missing invalid undefined tbd tba nodata noname nodrug unclear x xx xxx empty
blank""".split()
UNIT = r"(?:mg|mcg|µg|μg|ug|ng|g|kg|ml|l|dl|iu|i\.u\.|units?|u|meq|mmol|mol|percent|%)"
STRENGTH = re.compile(rf"\d+(?:[.,]\d+)?\s*{UNIT}(?:\s*/\s*(?:\d+(?:[.,]\d+)?\s*)?(?:{UNIT}|hours?|hr?|days?|dose|tablet|capsule|vial))?(?![a-z])")
MARKS = re.compile(r"[®™©℠]|\((?:r|tm|c|sm)\)")
SEVERAL = re.compile(r"[+;/&,|]|\s(?:and|with|plus|und|mit)\s")
#: Values of the labels that splits are stratified by, at most; their sums are on the driver.
MOST_LABELS = 100_000
PLAIN = frozenset(SALTS) | frozenset(FORMS)


def _folded(text: str) -> str:
    """Lower case without accents and invisible characters."""
    text = MARKS.sub(" ", "".join(c for c in text.casefold() if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n\r"))
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)) if unicodedata.category(c) != "Mn").casefold()


def drug_keys(name: str | None) -> list[str]:
    """One key for each drug that the name names; none if it says nothing."""
    if not name:
        return []
    keys = []
    for part in SEVERAL.split(STRENGTH.sub(" ", _folded(name))):
        words = [w for w in (re.sub(r"[\W_]", "", x) for x in part.split()) if w]
        own = [w for i, w in enumerate(words) if (w not in PLAIN or i == 0 and len(w) < 4) and not w.isdigit()] or [w for w in words if not w.isdigit() and w not in FORMS]
        key = "".join(own)
        if len(key) > 1 and key not in UNKNOWN and key not in keys:
            keys.append(key)
    return [] if re.sub(r"[\W_]", "", _folded(name)) in UNKNOWN else keys


def molecule_key(smiles: str | None) -> str | None:
    """The dot-separated parts in order, without blanks around; None if it says nothing."""
    s = "".join(c for c in smiles or "" if unicodedata.category(c) != "Cf").strip()
    if not re.search(r"[A-Za-z]", s) or re.sub(r"[\W_]", "", s).lower() in UNKNOWN:
        return None
    return ".".join(sorted(p.strip() for p in s.split(".") if p.strip()))


def link_keys(drug: pd.Series, smiles: pd.Series) -> pd.Series:
    keys = []
    for d, s in zip(drug, smiles):
        m = molecule_key(s)
        keys.append(["d:" + k for k in drug_keys(d)] + (["m:" + m] if m else []))
    return pd.Series(keys)


def linked_groups(records: DataFrame, key: str = "qa_id", drug: str = "drug_name", smiles: str = "decoded_smiles") -> DataFrame:
    """group_id, key: one row a distinct key; group_id is the least key of all records linked with it, also through others.

    Records that name no drug and no molecule are groups of their own. Rows of a repeated key are one record, with the
    links of all its rows; rows with a null key are left out. Links run between drugs and molecules, which are fewer than
    records, so a drug of a third of all records is one node, and no list of records is ever gathered.
    """
    keys_of = F.pandas_udf(link_keys, "array<string>")
    text = lambda c: F.col(c).cast("string")
    rows = cut(records.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), keys_of(text(drug), text(smiles)).alias("keys")))
    ends = rows.where("size(keys) > 0").select("k", F.col("keys")[0].alias("node"))
    in_row = rows.where("size(keys) > 1").select(F.col("keys")[0].alias("a"), F.explode(F.slice("keys", 2, F.size("keys"))).alias("b")).distinct()
    # Repeated keys link what their rows name.
    least_of = ends.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count_distinct("node").alias("n")).where("n > 1")
    again = ends.join(least_of.select("k", "a"), "k").select("a", F.col("node").alias("b"))
    nodes = connected_components(in_row.unionByName(again).unionByName(ends.select(F.col("node").alias("a"), F.col("node").alias("b"))), "a", "b")
    least = ends.groupBy("node").agg(F.min("k").alias("k"))
    of_node = nodes.join(least, "node", "left")
    first = of_node.groupBy("component").agg(F.min("k").alias("group_id"))
    group_of = cut(of_node.join(first, "component").select("node", "group_id"))
    linked = lookup(ends.groupBy("k").agg(F.min("node").alias("node")), group_of, "node").select("group_id", F.col("k").alias(key))
    single = rows.groupBy("k").agg(F.max(F.size("keys")).alias("n")).where("n = 0").select(F.col("k").alias("group_id"), F.col("k").alias(key))
    return linked.unionByName(single)


def stratify(groups: list[tuple[object, int, dict]], want: list[dict], room: list[float]) -> dict:
    """Split index of each group (id, size, counts by label): grouped iterative stratification.

    Again and again the label that fewest outstanding groups have is taken; its groups, those with most of it first, go to
    the split that needs most of the label, then most records, then the first. want and room are changed.
    """
    having: dict[object, set[int]] = {}
    for i, (_, _, labels) in enumerate(groups):
        for l in labels:
            having.setdefault(l, set()).add(i)
    placed: dict = {}
    while having:
        label = min(having, key=lambda l: (len(having[l]), str(l)))
        for i in sorted(having[label], key=lambda i: (-groups[i][2][label], -groups[i][1], str(groups[i][0]))):
            gid, size, labels = groups[i]
            s = max(range(len(room)), key=lambda s: (want[s].get(label, 0.0), room[s], -s))
            placed[gid] = s
            room[s] -= size
            for l, n in labels.items():
                want[s][l] = want[s].get(l, 0.0) - n
                if l != label:
                    having[l].discard(i)
                    if not having[l]:
                        del having[l]
        del having[label]
    return placed


def assign_splits(records: DataFrame, shares: dict[str, float] = {"train": 0.8, "valid": 0.1, "test": 0.1}, labels: list[str] = ["task_type", "source"], key: str = "qa_id", bucket: int = 4000) -> DataFrame:
    """group_id, key, assigned_split: linked records share a split; sizes and labels follow the shares as far as groups allow.

    A group's labels are summed into one vector. Groups with over a thousandth of all records, at most 1,000, are placed
    first, as what they take decides what is left; the others fill that in randomised buckets of about `bucket` groups,
    each with its part of every split's outstanding labels, so no task or driver holds all groups. Null labels count as
    a label; labels of more than MOST_LABELS values are an error. An empty table gives no rows.
    """
    names = list(shares)
    groups = cut(linked_groups(records, key))
    flat = records.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(F.coalesce(F.col(l).cast("string"), F.lit(""))).alias(f"_l{i}") for i, l in enumerate(labels)))
    tagged = groups.join(flat, key).select("group_id", F.explode(F.array(*(F.concat(F.lit(f"{l}="), F.col(f"_l{i}")) for i, l in enumerate(labels)))).alias("label"))
    vec = tagged.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    vec = cut(vec.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels"), (F.sum("n") / len(labels)).cast("long").alias("size")))
    n_groups, total = vec.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n_groups:
        return groups.withColumn("assigned_split", F.lit(None).cast("string"))
    limit = max(total // 1000, 1)
    sums = {r[0]: r[1] for r in vec.select(F.explode("labels")).groupBy("key").agg(F.sum("value")).limit(MOST_LABELS + 1).collect()}
    if len(sums) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: stratify by fields with fewer values")
    want = [{l: shares[s] * n for l, n in sums.items()} for s in names]
    room = [shares[s] * total for s in names]
    heavy = [(r[0], r[1], dict(r[2])) for r in vec.where(F.col("size") > limit).select("group_id", "size", "labels").collect()]  # at most 1,000
    placed = stratify(heavy, want, room)
    left = dict(sums)
    for _, _, ls in heavy:
        for l, n in ls.items():
            left[l] -= n
    n_left = max(total - sum(h[1] for h in heavy), 1)
    buckets = max(1, -(-n_groups // bucket))
    kind = records.schema[key].dataType.simpleString()

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(g, int(n), dict(ls)) for g, n, ls in zip(pdf["group_id"], pdf["size"], pdf["labels"])]
        mine: dict = {}
        for _, _, ls in own:
            for l, n in ls.items():
                mine[l] = mine.get(l, 0) + n
        part = sum(n for _, n, _ in own) / n_left
        wants = [{l: max(w[l], 0.0) * mine[l] / max(left[l], 1) for l in mine} for w in want]
        done = stratify(own, wants, [max(r, 0.0) * part for r in room])
        return pd.DataFrame({"group_id": list(done), "assigned_split": [names[s] for s in done.values()]})

    light = vec.where(F.col("size") <= limit).withColumn("_b", F.pmod(F.xxhash64("group_id"), F.lit(buckets)))
    small = light.groupBy("_b").applyInPandas(place, f"group_id {kind}, assigned_split string")
    big = records.sparkSession.createDataFrame([(g, names[s]) for g, s in placed.items()], f"group_id {kind}, assigned_split string")
    return lookup(groups, cut(small.unionByName(big)), "group_id")
