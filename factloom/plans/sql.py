"""The same results in SQL, for comparison with the queries on the same tables."""

from factloom.functions import text as T
from factloom.functions import routing as R
from factloom.functions.routing import CONFUSED, CUES, JOINT_CUES, LABEL_CUES, SKILLS
from factloom.operators import builders as B
from factloom.operators import knowledge as N
from factloom.operators import scoring as S_
from factloom.operators import variants as V


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def among(c: str, xs) -> str:
    return f"{c} in ({', '.join(q(x) for x in xs)})"


BLANKS = q(T.BLANK + "+")
norm = lambda c: f"trim(regexp_replace(lower({c}), {BLANKS}, ' ', 'g'))"
punct = q(r"[!-/:-@\[-`{-~]")
metric = lambda c, null: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, {q(null)})), {punct}, '', 'g'), {BLANKS}, ' ', 'g'))"
tokens = lambda c: f"regexp_extract_all(lower({c}), {q(T.TOKEN)})"
strip = lambda c: f"regexp_replace({c}, {q('^' + T.BLANK + '+|' + T.BLANK + '+$')}, '', 'g')"
has = lambda c: f"nullif({c}, '')"
words = lambda c, null="none": f"list_filter(string_split({metric(c, null)}, ' '), lambda x: x <> '')"
number = lambda c: f"try_cast(nullif(regexp_extract({c}, {q(T.NUMBER)}), '') as double)"
is_number = lambda c: f"coalesce(regexp_full_match({strip(c)}, {q(T.NUMBER)}), false)"
contains = lambda c, xs: "(" + " or ".join(f"contains({c}, {q(x)})" for x in xs) + ")"
stable = lambda size, *cs: "substr(sha1(" + " || '||' || ".join(f"coalesce(cast({c} as varchar), 'None')" for c in cs) + f"), 1, {size})"
bucket = lambda c, n: f"list_reduce(list_transform(range(1, 41), lambda i: cast('0x' || substr(sha1({c}), cast(i as int), 1) as int)), lambda a, x: (a * 16 + x) % {n}, 0)"
half = lambda c: f"case when substr(sha256({c}), 1, 1) < '8' then 'discovery' else 'evaluation' end"
h32 = lambda *seed: "cast('0x' || substr(sha1(" + " || '|' || ".join(seed) + "), 1, 8) as bigint)"
pick = lambda xs, *seed: f"{array(xs) if isinstance(xs, list) else xs}[cast({h32(*seed)} % len({array(xs) if isinstance(xs, list) else xs}) as int) + 1]"

QA = "qa as (select qa_id, " + ", ".join(f"min({c}) as {c}" for c in "id source question input_molecule_or_context input_type decoded_smiles gold_answer task_type drug_name split".split()) + " from qa_records where qa_id is not null group by 1)"
QTEXT = "concat_ws(' ', " + ", ".join(has(c) for c in ("question", "drug_name", "input_molecule_or_context", "decoded_smiles", "task_type")) + ")"
PRED = "pred as (select * from (select *, row_number() over (partition by pred_id order by loaded_at desc) as rn from predictions where pred_id is not null) where rn = 1)"

_n = {c: f"coalesce({norm(c)}, '')" for c in ("task_type", "question")}
_t, _q = _n["task_type"], _n["question"]
_label = "(coalesce(source, '') = 'fdarxbench' or coalesce(input_type, '') = 'FDA label context')"
ROUTE = f"""case when {_label} and {_t} = 'multihop' then 'fda_label_multihop' when {_label} then 'fda_label_factual'
 when contains({_t}, 'property') or {contains(_q, ['molecular weight', 'logp'])} then 'molecule_property_numeric'
 when {contains(_t, ['description guided', 'design'])} or contains({_q}, 'synthesize') then 'molecule_design'
 when contains({_t}, 'molecular description') or contains({_q}, 'describe') then 'molecule_description' else 'biomedical_open_qa' end"""
LEGACY = f"""case when {_label} then 'fda_label_qa' when {contains(_t, ['description guided', 'design'])} or contains({_q}, 'synthesize') then 'molecule_design'
 when contains({_t}, 'molecular description') or contains({_q}, 'describe') then 'molecule_description'
 when contains({_t}, 'property') or {contains(_q, ['molecular weight', 'logp'])} then 'molecule_property' else 'biomedical_open_qa' end"""
_mt, _mq = metric("task_type", "None"), metric("question", "None")
ANALYSIS = f"""case when {_label} and {_mt} = 'multihop' then 'fda_label_multihop' when {_label} and ({_mt} = 'refusal' or coalesce(input_type, '') = 'none') then 'fda_label_refusal' when {_label} then 'fda_label_factual'
 when contains({_mt}, 'property') or {contains(_mq, ['molecular weight', 'logp'])} then 'molecule_property_numeric'
 when {contains(_mt, ['description guided', 'design'])} or contains({_mq}, 'synthesize') then 'molecule_design'
 when contains({_mt}, 'molecular description') or contains({_mq}, 'describe') then 'molecule_description'
 when {contains(_mq, ['contraindication', 'indication', 'interact', 'target', 'protein', 'side effect'])} then 'drug_relation_qa'
 when {_mq} = '' then 'unsupported_or_low_evidence' else 'biomedical_open_qa' end"""
PREDICTED = "case " + " ".join(f"when {contains(_q, w)} then {q(s)}" for s, w in CUES) + f" when {contains(_q, LABEL_CUES)} and {contains(_q, JOINT_CUES)} then 'fda_label_multihop' when {contains(_q, LABEL_CUES)} then 'fda_label_factual' else 'biomedical_open_qa' end"
RANDOM = f"{array(SKILLS)}[{bucket(chr(99) + 'oalesce(id, ' + chr(39) * 2 + ')', 6)} + 1]"
wrong = lambda s: "case " + " ".join(f"when {s} = {q(a)} then {q(b)}" for a, b in CONFUSED.items()) + " end"
SKILL = "skill as (select * from (values " + ", ".join(f"({q(k)}, {array(v[0])}, {array(v[1])}, {v[2]}, {array(v[3])}, {q(v[4])}, {array(v[5])})" for k, v in SKILLS.items()) + ") t(skill, sources, relations, top_k, required_slots, answer_format, steps))"
qtype = lambda d, t: f"""case when coalesce({d}, '') = 'fdarxbench' then case {metric(t, '')} when 'factual' then 'fda_factual' when 'multihop' then 'fda_multihop' when 'refusal' then 'fda_refusal' else 'fda_other' end
 when {contains(metric(t, ''), ['description guided', 'design'])} then 'molecule_design' when contains({metric(t, '')}, 'molecular description') then 'molecule_description' when contains({metric(t, '')}, 'property') then 'molecule_property' else 'biomedical_open_qa' end"""  # noqa: E731
smiles = lambda c: f"coalesce(length({strip(c)}) between 4 and 300 and regexp_matches({strip(c)}, {q(T.SMILES)}) and regexp_matches({strip(c)}, '[=#\\[\\]()]'), false)"
shape = lambda c: f"""case when coalesce({strip(c)}, '') = '' then 'empty' when regexp_full_match({strip(c)}, {q(T.NUMBER)}) then 'numeric' when {strip(c)} like '[%' and contains({c}, ']') then 'molecule_string'
 when lower({strip(c)}) in ('information not found!', 'information not found') then 'abstention' when contains({strip(c)}, chr(10)) or {strip(c)} like '-%' then 'list_or_multiline'
 when len(regexp_split_to_array({strip(c)}, '\\s+')) <= 8 then 'short_text' else 'long_text' end"""  # noqa: E731

# Retrieval
FTOK = f"ftok as (select fact_idx, source, relation, list_distinct(coalesce(tokens, {tokens('text')}, [])) as terms from facts)"
POST = f"""{FTOK}, post as (select unnest(terms) as term, fact_idx, len(terms) as dl, source, relation from ftok),
 tot as (select count(*) as n, avg(len(terms)) as avgdl from ftok), df as (select term, count(*) as df from post group by 1),
 idf as (select term, df, ln((n - df + 0.5) / (df + 0.5) + 1.0) as idf from df, tot)"""
STOP = among("term", T.QUERY_STOPWORDS)
TERMS = f"""qt as (select * from (select qid, t.term, idf, df, row_number() over (partition by qid order by df, t.term) as term_rank from
 (select distinct qid, unnest({tokens('qtext')}) as term from queries) t join idf on t.term = idf.term where length(t.term) >= 3 and not (t.{STOP})) where term_rank <= 24)"""
LEX = "lex as (select qid, fact_idx, source, relation, sum(cast(idf * 2.2 / (1.0 + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))) as decimal(18,9))) as score from qt join post on qt.term = post.term, tot group by 1, 2, 3, 4)"
ITEMS = "queries as (select item_id as qid, concat_ws(' ', question, text) as qtext, dataset, task_type, gold_answer from eval_items)"
BM25 = f"{ITEMS}, {POST}, {TERMS}, {LEX}"
TOP8 = "top8 as (select qid, rank, fact_idx, score from (select qid, fact_idx, round(score, 4) as score, row_number() over (partition by qid order by round(score, 4) desc, fact_idx) as rank from lex where score > 0) where rank <= 8)"
spans = f"list_filter(list_transform(regexp_extract_all({QTEXT}, {q(T.WORDS)}), lambda x: {norm('x')}), lambda x: length(x) >= 4)"
MENTION = f"""asked as (select distinct qid, alias from (select qa_id as qid, unnest(list_concat({spans}, [{norm('drug_name')}, replace(replace({norm('drug_name')}, ' hydrochloride', ''), ' hydrobromide', ''), {norm('decoded_smiles')},
 case when length(trim(input_molecule_or_context)) <= 300 then {norm('input_molecule_or_context')} end])) as alias from qa) where alias is not null and alias <> '')"""
ALIAS = f"al as (select distinct alias, fact_idx, source, relation from (select {norm('a')} as alias, fact_idx, source, relation from (select unnest(aliases) as a, fact_idx, source, relation from facts)) where alias <> '')"


ITEM_RECORDS = "qa as (select item_id as qa_id, cast(item_id as varchar) as id, dataset as source, question, text as input_molecule_or_context, cast(null as varchar) as input_type, cast(null as varchar) as decoded_smiles, gold_answer, task_type, cast(null as varchar) as drug_name, 'test' as split from eval_items)"


def retrieve(method: str, skill: str = ROUTE, records: str = QA, routing: bool = True, cap: int | None = None) -> str:
    boost = 8 if method in ("kg", "hybrid", "skill_hybrid") else 0
    filt = "and list_contains(sources, source) and list_contains(relations, relation)" if method in ("skill_hybrid", "bm25_skillrouted") else ""
    filt = filt if routing else ""
    kept, limited = "", ""
    if cap:
        kept = f""" pr as (select qid, fact_idx, min(term_rank) as r from qt join post on qt.term = post.term group by 1, 2), pc as (select qid, r, count(*) as n from pr group by 1, 2),
 pk as (select qid, r, coalesce(sum(n) over (partition by qid order by r rows between unbounded preceding and 1 preceding), 0) as before from pc), pl as (select qid, max(r) as last from pk where before < {cap} group by 1), pf as (select pr.qid as qid, pr.fact_idx as fact_idx, true as kept from pr join pl on pr.qid = pl.qid and pr.r <= pl.last),"""
        limited = "left join pf on pf.qid = c.qid and pf.fact_idx = c.fact_idx where (alias_hit or kept)"
    cap = "8" if method == "bm25_skillrouted" else "least(8, top_k)"
    return f"""with {records}, {SKILL}, queries as (select qa_id as qid, {QTEXT} as qtext from qa), routed as (select qa_id as qid, {skill} as skill from qa), {POST}, {TERMS}, {LEX}, {MENTION}, {ALIAS},{kept}
 hit as (select distinct qid, fact_idx, source, relation from asked join al on asked.alias = al.alias),
 c as (select coalesce(lex.qid, hit.qid) as qid, coalesce(lex.fact_idx, hit.fact_idx) as fact_idx, coalesce(lex.source, hit.source) as source, coalesce(lex.relation, hit.relation) as relation, coalesce(score, 0) as s, hit.qid is not null as alias_hit from lex full join hit on lex.qid = hit.qid and lex.fact_idx = hit.fact_idx),
 d as (select c.*, round(s + case when alias_hit then {boost} + case when source = 'primekg' then 1 else 0 end else 0 end, 4) as score from c {'where alias_hit' if method == 'kg' else limited}),
 e as (select d.*, top_k, row_number() over (partition by d.qid order by score desc, alias_hit desc, fact_idx) as rank from d join routed on d.qid = routed.qid join skill on skill.skill = routed.skill where score > 0 {filt})
 select qid, rank, fact_idx, cast(score as double) as score, alias_hit from e where rank <= {cap}"""


VEC = """one as (select fact_idx, source, embedding from (select *, row_number() over (partition by fact_idx order by encoded_at desc) as rn from fact_vectors) where rn = 1),
 ok as (select fact_idx, source, cast(embedding as double[]) as e from one where len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: x is null or isnan(x)), true)),
 nv as (select fact_idx, source, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from ok), v as (select fact_idx, source, list_transform(e, lambda x: x / n) as v from nv where n > 0),
 qv as (select fact_idx as qid, source as qs, v as qv from v where fact_idx % 20 = 0)"""
dense = lambda k, cond="true": f"dn as (select * from (select qid, fact_idx, score, row_number() over (partition by qid order by score desc, fact_idx) as rank from (select qid, fact_idx, round(list_inner_product(qv, v), 6) as score from qv, v where qid <> fact_idx and {cond})) where rank <= {k})"

RRF = f"""{ITEMS}, {POST}, {TERMS}, {LEX}, la as (select * from (select qid, fact_idx, row_number() over (partition by qid order by score desc, fact_idx desc) as r1 from lex where score > 0) where r1 <= 50),
 q2 as (select qid, gold_answer as qtext from queries), qt2 as (select * from (select qid, t.term, idf, row_number() over (partition by qid order by df, t.term) as term_rank from (select distinct qid, unnest({tokens('qtext')}) as term from q2) t join idf on t.term = idf.term where length(t.term) >= 3 and not (t.{STOP})) where term_rank <= 24),
 lex2 as (select qid, fact_idx, sum(cast(idf * 2.2 / (1.0 + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))) as decimal(18,9))) as score from qt2 join post on qt2.term = post.term, tot group by 1, 2),
 lb as (select * from (select qid, fact_idx, row_number() over (partition by qid order by round(score, 4) desc, fact_idx) as r2 from lex2 where score > 0) where r2 <= 50),
 fu as (select qid, fact_idx, r1, r2, round(coalesce(1.0 / (60.0 + r1), 0.0) + coalesce(1.0 / (60.0 + r2), 0.0), 9) as score from la full join lb using (qid, fact_idx)),
 fr as (select *, row_number() over (partition by qid order by score desc, r1 nulls last, r2 nulls last) as rank from fu)"""
jac = lambda a, b, e: f"case when len(list_distinct(list_concat({a}, {b}))) = 0 then {e} else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end"

line = "cast(rank as varchar) || '. [' || coalesce(source, 'None') || ':' || coalesce(relation, 'None') || '; score=' || regexp_replace(cast(cast({s} as decimal(20,4)) as varchar), '(\\.\\d+?)0+$', '\\1') || '] ' || replace(coalesce(text, 'None'), chr(10), ' ')"
block = lambda found, most: f"""ln as (select qid, rank, {line.format(s='f.score')} as line from {found} f join facts using (fact_idx)), lu as (select *, sum(length(line)) over (partition by qid order by rank) as upto from ln),
 bl as (select qid, count(*) filter (where upto <= {most}) as n_lines, coalesce(string_agg(line, chr(10) order by rank) filter (where upto <= {most}), 'No KB evidence retrieved within budget.') as block from lu group by 1)"""  # noqa: E731


def prompts(ablate: set) -> str:
    r = retrieve("bm25_skillrouted")
    cte, last = r.rsplit(" select qid, rank", 1)
    steps = "" if "solving_steps" in ablate else " || chr(10) || 'How to solve:' || chr(10) || array_to_string(list_transform(range(1, len(steps) + 1), lambda i: '  ' || cast(i as varchar) || '. ' || steps[i]), chr(10))"
    head = "Retrieved KB evidence:" if "evidence_org" in ablate else "Skill-based retrieved knowledge:"
    return f"""{cte}, fnd as (select qid, rank, fact_idx, score from e where rank <= 3), {block('fnd', 3500)}
 select qa_id, skill.skill as skill, 'You are answering a drug and molecular QA task with external knowledge.' || chr(10) || chr(10) || 'Use the provided information to answer the question. If the answer is not available, respond: Information not found!' || chr(10) || chr(10) || 'Answer in the same style as the gold answer.' || chr(10) || chr(10)
 || 'Skill: ' || skill.skill{steps} || chr(10) || 'Answer format: ' || answer_format || case when coalesce(input_molecule_or_context, '') <> '' then chr(10) || chr(10) || 'Known information:' || chr(10) || input_molecule_or_context else '' end
 || chr(10) || chr(10) || {q(head)} || chr(10) || coalesce(block, 'No KB evidence retrieved.') || chr(10) || chr(10) || 'Question: ' || coalesce(question, 'None') || chr(10) || 'Answer:' as prompt, trim(coalesce(gold_answer, '')) as answer
 from qa join routed on qa.qa_id = routed.qid join skill on skill.skill = routed.skill left join bl on bl.qid = qa.qa_id"""


# Scores
BAGS = """ca as (select pred_id, unnest(a) as t, count(*) as x from bag group by 1, 2), cb as (select pred_id, unnest(b) as t, count(*) as y from bag group by 1, 2),
 ov as (select pred_id, cast(sum(least(x, y)) as bigint) as common from ca join cb using (pred_id, t) group by 1),
 sz as (select pred_id, len(a) as n_a, len(b) as n_b, coalesce(common, 0) as common from bag left join ov using (pred_id))"""
SCORE = f"""{PRED}, bag as (select pred_id, {words('prediction')} as a, {words('reference_output')} as b from pred), {BAGS},
 sc as (select pred_id, dataset, task_type, model_name, method_name, {strip("coalesce(prediction, 'None')")} = {strip("coalesce(reference_output, 'None')")} as exact, {metric('prediction', 'none')} = {metric('reference_output', 'none')} as normalized_exact,
 case when n_a = 0 and n_b = 0 then 1.0 when n_a = 0 or n_b = 0 or common = 0 then 0.0 else 2 * (cast(common as double) / n_a) * (cast(common as double) / n_b) / (cast(common as double) / n_a + cast(common as double) / n_b) end as token_f1,
 case when {is_number('reference_output')} then coalesce(abs({number('prediction')} - {number(strip('reference_output'))}) <= greatest(1e-3, abs({number(strip('reference_output'))}) * 0.05), false) end as numeric_match, {qtype('dataset', 'task_type')} as question_type from pred join sz using (pred_id)),
 scores as (select *, coalesce(cast(cast(numeric_match as int) as double), token_f1) as utility from sc)"""
EDGE = f"edge as (select fact_idx, relation, {norm('entities[1]')} as x, {norm('entities[2]')} as y from facts where source = 'primekg' and {among('relation', N.GRAPH_RELATIONS)} and len(entities) >= 2)"
WANT = f"want as (select distinct {norm('drug_name')} as name from qa where {norm('drug_name')} <> '')"
MIX = lambda by: f"""{BM25}, {TOP8}, ev as (select qid, coalesce({by}, 'unknown') as {by}, count(*) as c from top8 join facts using (fact_idx) group by 1, 2), es as (select *, c / sum(c) over (partition by qid) as share from ev),
 mix as (select concat_ws('|', dataset, task_type) as grp, {by}, count(*) as examples_with_evidence, round(avg(c), 4) as avg_facts, round(avg(share), 4) as mean_within_prompt_share from es join queries using (qid) group by 1, 2)"""  # noqa: E731
DIST = """sup as (select * from (values ('primekg', 0), ('drugchat_pubchem', 1), ('drugchat_chembl', 2), ('fdarxbench_label', 3)) t(source, pos)),
 gr as (select g.grp as grp, sup.source as source, pos, coalesce(mean_within_prompt_share, 0.0) as m from (select distinct grp from mix) g cross join sup left join mix on mix.grp = g.grp and mix.source = sup.source),
 dist as (select grp, source, pos, case when sum(m) over (partition by grp) > 0 then m / sum(m) over (partition by grp) else 0.0 end as share from gr)"""
HASHED = "sha1('{seed}|' || cast({c} as varchar))"
IDENT = f"""{QA}, idn as (select qa_id, coalesce(nullif({norm('drug_name')}, ''), nullif({norm('decoded_smiles')}, '')) as identity from qa), ids as (select identity, row_number() over (order by sha1('13|' || identity)) as r, count(*) over () as n from (select distinct identity from idn where identity is not null)),
 hold as (select qa_id, idn.identity as identity, case when r <= greatest(1, cast(round_even(n * 0.2, 0) as bigint)) then 'test' else 'train' end as split from idn left join ids on idn.identity = ids.identity)"""
SUMMARY = """per as (select identity, count(distinct split) as k from hold where identity is not null group by 1)
 select split, count(*) as n, count(distinct hold.identity) as n_identities, count(distinct case when k > 1 then hold.identity end) as n_shared from hold left join per on hold.identity = per.identity group by 1"""
_KEYED = """k as (select regexp_replace(lower(regexp_replace(source, '^[\\s]+|[\\s]+$', '', 'g')), '[\\s_-]+', '_', 'g') as source,
 regexp_replace(lower(regexp_replace(relation, '^[\\s]+|[\\s]+$', '', 'g')), '[\\s_-]+', '_', 'g') as relation, id, loaded_at from facts)"""
_DEC = "cast(fact_idx as varchar)"
KS = "ks as (select list(source order by source) as k from (select source from facts where source is not null group by 1 having count(*) >= 0.01 * (select count(*) from facts)))"
_tag = "cast(1000 + " + h32("'0'", "cast(id as varchar)", "'tag'") + " % 8999 as varchar)"
_part = lambda xs, mark: pick(xs, "'0'", "cast(id as varchar)", q(mark))
_noise = f"""select 'noise_' || lpad(cast(id as varchar), 8, '0') as id, {_part('ks.k', 'src').replace('len([ks.k])', 'len(ks.k)')} as source, 'noise-' || {_tag} as source_id, {_part(V.TITLE_A, 'a')} || ' ' || {_part(V.TITLE_B, 'b')} || ' ' || {_tag} as title, 'distractor' as relation,
 'The candidate ' || {_part(V.SUBJECTS, 's')} || ' #' || {_tag} || ' ' || {_part(V.PREDICATES, 'p')} || ' ' || {_part(V.OBJECTS, 'o')} || '.' as text
 from (select unnest(range(cast(round_even((select count(*) from facts) * {{share}}, 0) as bigint))) as id), ks"""
_others = "list_filter(ks.k, lambda s: s <> coalesce(source, ''))"
decoy = lambda per, share: f"""{KS}, seeds as (select * from (select *, row_number() over (order by sha1('0|' || {_DEC})) as hr, count(*) over () as hn from facts) where hr <= round_even(hn * {share}, 0)),
 cp as (select fact_idx, id, title, relation, metadata, source, coalesce(text, '') as t, unnest(range({per})) as copy from seeds),
 dc as (select fact_idx, id as own_id, title, relation, metadata, copy, {pick(_others, "'0'", _DEC, "cast(copy as varchar)", "'src'")} as source, source as true_source, t || {pick(V.SUFFIXES, "'0'", _DEC, "cast(copy as varchar)", "'x'")} as text from cp, ks)"""  # noqa: E731
_order = "list_position(['fdarxbench_label', 'drugchat_pubchem', 'drugchat_chembl', 'primekg'], source)"
_qtemplate = "case " + " ".join(f"when g_rel = {q(r)} then replace({q(t)}, '{{alias}}', alias)" for r, t in N.QUESTIONS.items()) + " else 'Regarding ' || alias || ', what does the knowledge base report for the ''' || coalesce(g_rel, 'fact') || ''' relation?' end"
_allow = "case g_source " + " ".join(f"when {q(s)} then {array(SKILLS[k][0])}" for s, k in N.INTENDED.items()) + " end"
FILE = r"^(.+?)_(fdarxbench_v2|fdarxbench|mol_instructions_v2|mol_instructions)_(?:(bm25_skillrouted|dense_bge_skillrouted|dense_bge_locked|skill_schema_v1|oracle_source|skill_hybrid|dense_medcpt|dense_bge|skill_v1|closed_book|hybrid|rerank|routed|dense|bm25|none|rrf|kg)_)?([a-z]+)_test_eval\.json$"
part = lambda i: f"nullif(regexp_extract(file_name, {q(FILE)}, {i}), '')"
_cov = "id source_path source_index question input_molecule_or_context input_type decoded_smiles gold_answer task_type drug_name split".split()
_spaces = lambda c: f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda x: x <> ''))"
_ATTACHED = f"""nm as (select distinct name from ev where length(name) >= 4 and regexp_matches(name, '[a-z0-9]{{3}}')), t as (select qa_id as qid, {norm(QTEXT)} as t from qa), held as (select qid, name from t, nm where contains(t.t, name)),
 att as (select distinct qid, fact_idx from held join ev using (name)), kge as (select * from (select qid, fact_idx, row_number() over (partition by qid order by fact_idx) as rank from att) where rank <= 6)"""
GRAPH = f"""{EDGE}, {WANT}, en as (select fact_idx, x as name, 0 as side from edge union all select fact_idx, y, 1 from edge), ev as (select * from (select name, row_number() over (partition by name order by fact_idx, side) as rank, fact_idx from en join want using (name)) where rank <= 6), {_ATTACHED}"""
WITH_EVIDENCE = f"""{GRAPH}, mo as (select trim(decoded_smiles) as m from qa where trim(decoded_smiles) <> '' group by 1 having count(*) > 1),
 qe as (select qa.*, qa_id in (select qid from kge) as graph, coalesce(trim(decoded_smiles) in (select m from mo), false) as molecule from qa)"""
INVENTORY = f"""sh as (select source, task_type, input_type, string_agg(shape || ':' || cast(c as varchar), '|' order by c desc, shape) as answer_shapes from (select source, task_type, input_type, {shape('gold_answer')} as shape, count(*) as c from qa group by 1, 2, 3, 4) group by 1, 2, 3),
 sk as (select source, task_type, input_type, string_agg(sk || ':' || cast(c as varchar), '|' order by c desc, sk) as candidate_skills from (select source, task_type, input_type, {ANALYSIS} as sk, count(*) as c from qa group by 1, 2, 3, 4) group by 1, 2, 3),
 inv as (select source, task_type, input_type, count(*) as n, round(avg(cast(coalesce(decoded_smiles <> '', false) as int)), 4) as with_smiles, round(avg(cast(coalesce(drug_name <> '', false) as int)), 4) as with_drug, round(avg(cast(graph as int)), 4) as with_graph, round(avg(cast(molecule as int)), 4) as with_molecule,
 round(avg({_spaces('question')}), 4) as question_words, round(avg({_spaces('gold_answer')}), 4) as answer_words from qe group by 1, 2, 3),
 ti as (select inv.*, answer_shapes, candidate_skills from inv join sh on inv.source is not distinct from sh.source and inv.task_type is not distinct from sh.task_type and inv.input_type is not distinct from sh.input_type
 join sk on inv.source is not distinct from sk.source and inv.task_type is not distinct from sk.task_type and inv.input_type is not distinct from sk.input_type)"""
_dt, _dq = metric("task_type", ""), metric("question", "")
_data_slots = {
    "label_context": "input_type = 'FDA label context' and input_molecule_or_context <> ''", "label_context_primary": "input_type = 'FDA label context' and input_molecule_or_context <> ''", "label_context_secondary": f"{_dt} = 'multihop'",
    "label_context_check": "source = 'fdarxbench'", "unsupported_flag": f"{_dt} = 'refusal' or coalesce(input_type, '') = 'none'", "molecule_structure": "coalesce(decoded_smiles <> '', false) or coalesce(input_type, '') in ('SELFIES', 'SMILES')",
    "property_definition": f"contains({_dt}, 'property') or {contains(_dq, ['molecular weight', 'logp'])}", "design_requirement": f"input_molecule_or_context <> '' and contains({_dt}, 'design')",
    "question_entities": "question <> ''", "biomedical_fact": "graph or molecule", "relation_fact": "graph", "evidence_absence_reason": "not (graph or molecule)",
}
_NEEDED = "case skill " + " ".join(f"when {q(k)} then {array(v)}" for k, v in R.ANALYSIS_SLOTS.items()) + f" else {array(R.NO_SLOTS)} end"
_FILLED = "list_filter([" + ", ".join(f"case when coalesce({v}, false) then {q(k)} end" for k, v in _data_slots.items()) + "], lambda z: z is not null)"
_CHARS = f"""length({q(chr(10).join(B.HEAD))}) + coalesce(case when input_molecule_or_context <> '' then 4 + length(input_molecule_or_context) + case when coalesce(source, '') = 'fdarxbench' then {len(B.CONTEXT_LABEL[0])} else {len(B.CONTEXT_LABEL[1])} end end, 0) + {len(chr(10) * 2 + 'Question: ' + chr(10) + 'Answer:')} + length(coalesce(question, 'None'))"""
context = f"case when input_molecule_or_context <> '' then chr(10) || chr(10) || case when coalesce(source, '') = 'fdarxbench' then {q(B.CONTEXT_LABEL[0])} else {q(B.CONTEXT_LABEL[1])} end || ':' || chr(10) || input_molecule_or_context else '' end"
_tail = "chr(10) || chr(10) || 'Question: ' || coalesce(question, 'None') || chr(10) || 'Answer:'"
_answer = "trim(coalesce(gold_answer, ''))"
_head = q(chr(10).join(B.HEAD))
_grp = "concat_ws('|', dataset, task_type)"
_rw = lambda c: f"list_filter({words(c, '')}, lambda x: length(x) > 2 and not ({among('x', T.RECALL_STOPWORDS)}))"
SUPPORTED = f"""hw as (select qid, source, unnest({_rw('text')}) as t from top8 join facts using (fact_idx)), hc as (select qid, source, t, count(*) as x from hw group by 1, 2, 3),
 gw as (select qid, unnest({_rw('gold_answer')}) as t from queries), gc as (select qid, t, count(*) as y from gw group by 1, 2), gn as (select qid, sum(y) as n from gc group by 1),
 cm as (select gc.qid as qid, source, sum(least(x, y)) as common from gc join hc on gc.qid = hc.qid and gc.t = hc.t group by 1, 2),
 four as (select * from (values ('primekg'), ('drugchat_pubchem'), ('drugchat_chembl'), ('fdarxbench_label')) z(source)), sg as (select qid, {_grp} as grp, four.source as source from queries, four),
 supp as (select sg.grp as grp, sg.source as source, count(*) as n, round(avg(case when gn.n > 0 then coalesce(cast(common as double), 0.0) / gn.n else 0.0 end), 6) as mean_gold_token_recall from sg left join gn on gn.qid = sg.qid left join cm on cm.qid = sg.qid and cm.source = sg.source group by 1, 2)"""
SUPPORT = f"{BM25}, {TOP8}, {SUPPORTED}"
_allow_type = "case t " + " ".join(f"when {q(t)} then {array(SKILLS[k][0])}" for t, k in R.SKILL_OF_TYPE.items()) + f" else {array(R.SOURCES)} end"
_route_sources = "case sk " + " ".join(f"when {q(k)} then {array(v[0])}" for k, v in SKILLS.items()) + " end"
_method = lambda c: f"coalesce(nullif(regexp_extract({c}, {q('(' + S_.METHOD_NAMES + ')')}, 1), ''), regexp_replace({c}, {q(chr(92) + '.[^.]*$')}, ''))"
_family = lambda c: f"case when {among(c, S_.SKILL_METHODS)} then 'skill' else 'uniform' end"
_mw = lambda c, null="none": f"list_distinct({words(c, null)})"


def planned(i: str, found: str, said: str = "") -> str:
    """Tables of planning metrics over the found table (qid, fact_idx); names end in i, the last is ro."""
    used = f"case when pd.qid is not null and len({_mw('pd.prediction', 'None')}) > 0 then len(list_intersect({_mw('pd.prediction', 'None')}, coalesce(w, []))) / len({_mw('pd.prediction', 'None')}) end" if said else "cast(null as double)"
    return f"""ea{i} as (select qid, coalesce(facts.source, 'None') as source, count(*) as c from {found} join facts using (fact_idx) group by 1, 2), eg{i} as (select qid, sum(c) as n, list(source) as names from ea{i} group by 1),
 ex{i} as (select qid, unnest({words("concat_ws(' ', nullif(title, ''), nullif(text, ''))")}) as z from {found} join facts using (fact_idx)), ew{i} as (select qid, list(distinct z) as w from ex{i} group by 1),
 al{i} as (select qa_id as qid, source as dataset, task_type, gold_answer, {_route_sources} as allow from (select *, {ROUTE} as sk from qa)),
 eq{i} as (select ea{i}.qid as qid, -sum(c / n * log2(c / n)) as en, sum(case when list_contains(allow, ea{i}.source) then c else 0 end) / any_value(n) as pr from ea{i} join eg{i} on ea{i}.qid = eg{i}.qid join al{i} on al{i}.qid = ea{i}.qid group by 1),
 me{i} as (select dataset, task_type, round(pr, 6) as pr, round(1 - pr, 6) as wr, round(en + 0.0, 6) as en, case when pr is not null then round({jac('names', 'allow', '1.0')}, 6) end as ag,
 round(case when len({_mw('gold_answer')}) > 0 then len(list_intersect({_mw('gold_answer')}, coalesce(w, []))) / len({_mw('gold_answer')}) end, 6) as re, round({used}, 6) as us
 from al{i} p left join eq{i} on eq{i}.qid = p.qid left join eg{i} on eg{i}.qid = p.qid left join ew{i} on ew{i}.qid = p.qid {said}),
 ro{i} as (select dataset, task_type, count(*) as n_records, round(avg(pr), 4) as source_precision, round(avg(wr), 4) as wrong_source_rate, round(avg(en), 4) as source_entropy_bits, round(avg(ag), 4) as skill_source_agreement, round(avg(re), 4) as evidence_recall_at_k, round(avg(us), 4) as evidence_utilization from me{i} group by 1, 2)"""


def found_of(method: str, records: str, name: str) -> str:
    """Tables of a retrieval, without the leading with, whose last one has the found facts."""
    cte, last = retrieve(method, records=records).removeprefix("with ").rsplit(" select qid, rank", 1)
    return f"{cte}, {name} as (select qid, rank{last})"


_raw = "raw as (select qa_id, source, source_index, trim(coalesce({0}, '')) as instruction, trim(coalesce({1}, '')) as input, {2} as output, metadata, split, input_type, drug_name from (select *, row_number() over (partition by qa_id order by loaded_at desc) as k from qa_records where qa_id is not null) where k = 1)".format(strip("question"), strip("input_molecule_or_context"), "gold_answer")
_kind = lambda c, src: f"case when {c} = '' then 'none' when {src} like 'drugchat%' then 'SMILES' when {c} like '[%' then 'SELFIES' when {smiles(c)} then 'SMILES' else 'text' end"
_meta = lambda k: f"metadata[{q(k)}]"
_fspans = lambda c: f"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), {q(T.WORDS_PLAIN)}), lambda x: {norm('x')}), lambda x: length(x) >= 4)"
CANDIDATES = f"""cand as (select qa_id, unnest(list_distinct(list_filter(list_concat({_fspans('question')}, list_concat({_fspans('input_molecule_or_context')}, list_concat({_fspans('task_type')}, list_concat({_fspans('drug_name')}, [{norm('drug_name')}, replace(replace({norm('drug_name')}, ' hydrochloride', ''), ' hydrobromide', '')])))), lambda x: x is not null and x <> ''))) as name from qa)"""
_item_ok = "list_filter(list_transform(string_split(coalesce(input, ''), chr(10)), lambda t: {0}), lambda t: t <> '')".format(strip("t"))
_tok = lambda c: f"len(list_distinct({tokens(c)}))"
BANK = f"""{QA}, {_raw}, {CANDIDATES}, {EDGE}, want as (select distinct name from cand), en as (select name, fact_idx, count(*) as n from (select fact_idx, unnest([x, y]) as name from edge) join want using (name) group by 1, 2),
 kp as (select *, coalesce(sum(n) over (partition by name order by fact_idx rows between unbounded preceding and 1 preceding), 0) as before from en), ke as (select distinct fact_idx from kp where before < 10),
 b0 as (select 0 as family, f.fact_idx as row_, 'primekg' as source, concat_ws('|', entities[1], relation, entities[2]) as source_id, entities[1] || ' --' || coalesce(nullif({_meta('display_relation')}, ''), relation) || '--> ' || entities[2] as title,
 'PrimeKG relation: ' || entities[1] || ' (' || coalesce({_meta('x_type')}, 'None') || ') --' || coalesce(nullif({_meta('display_relation')}, ''), relation) || '--> ' || entities[2] || ' (' || coalesce({_meta('y_type')}, 'None') || ').' as text, [entities[1], entities[2]] as aliases, relation from facts f join ke on ke.fact_idx = f.fact_idx),
 b1 as (select 1 as family, qa_id as row_, source, source || ':' || source_index as source_id, coalesce(nullif(substr(instruction, 1, 180), ''), source || ' fact') as title, 'Question: ' || instruction || chr(10) || 'Input: ' || input || chr(10) || 'Answer: ' || {strip("coalesce(output, '')")} as text,
 list_filter([case when {smiles('input')} then input end, {", ".join(f"nullif({_meta(k)}, '')" for k in B.NAMING)}], lambda x: x is not null) as aliases, 'instruction_fact' as relation from raw where source = 'mol_instructions'),
 lr as (select qa_id, {strip("coalesce(drug_name, '')")} as drug, list_filter(list_transform(string_split(coalesce(input_molecule_or_context, ''), chr(10))[1:4], lambda t: {strip('t')}), lambda t: t <> '') as p from (select *, row_number() over (partition by qa_id order by loaded_at desc) as k from qa_records where qa_id is not null) where k = 1 and input_type = 'FDA label context'),
 b2 as (select 2 as family, qa_id as row_, 'fdarxbench_label' as source, cast(qa_id as varchar) as source_id, 'FDA label evidence for ' || drug as title, array_to_string(p, chr(10) || chr(10)) as text, case when drug <> '' then [drug] else [] end as aliases, 'label_context' as relation from lr where len(p) > 0),
 bank as (select row_number() over (order by family, row_) - 1 as fact_idx, {stable(20, 'source', 'title', 'text')} as id, source, source_id, title, text, relation, aliases from (select * from b0 union all select * from b1 union all select * from b2))"""


_slots = {
    "label_context": "input_type = 'FDA label context' and input_molecule_or_context <> ''", "label_context_primary": "input_type = 'FDA label context' and input_molecule_or_context <> ''", "label_context_secondary": f"{_t} = 'multihop'",
    "molecule_structure": "decoded_smiles <> '' or input_type in ('SELFIES', 'SMILES')", "property_definition": f"contains({_t}, 'property') or contains({_q}, 'property')",
    "design_requirement": "trim(input_molecule_or_context) <> ''", "question_entities": "trim(question) <> ''", "biomedical_fact": "false",
}

_filled = {
    "label_context": "(input_type = 'FDA label context' and input_molecule_or_context <> '') or coalesce(label, false)", "label_context_primary": "(input_type = 'FDA label context' and input_molecule_or_context <> '') or coalesce(label, false)",
    "label_context_secondary": "coalesce(label, false) and coalesce(n, 0) >= 2", "molecule_structure": _slots["molecule_structure"], "property_definition": _slots["property_definition"],
    "design_requirement": _slots["design_requirement"], "question_entities": _slots["question_entities"], "biomedical_fact": "coalesce(fact, false)",
}
COLLISIONS = f"""with nm as (select distinct fact_idx, source, relation, text, {norm('e')} as alias from (select fact_idx, source, relation, text, unnest(list_concat(coalesce(aliases, []), coalesce(entities, []))) as e from facts where source is not null) where trim(e) <> ''),
 ok as (select * from nm where length(alias) >= 3 and not regexp_full_match(alias, '[0-9]+')), sp as (select alias from ok group by 1 having count(distinct source) >= 2), held as (select ok.* from ok join sp using (alias)),
 gd as (select * from (select alias, fact_idx as g_idx, source as g_source, relation as g_rel, text as g_text, row_number() over (partition by alias order by {_order}, fact_idx) as r from held where {_order} > 0) where r = 1),
 pr as (select held.alias as alias, g_idx, g_source, g_rel, fact_idx, source, relation, round({jac("list_distinct(" + tokens("coalesce(g_text, '')") + ")", "list_distinct(" + tokens("coalesce(text, '')") + ")", '0.0')}, 6) as similarity, relation is distinct from g_rel as distinct_relation from held join gd using (alias) where source <> g_source and not list_contains({_allow}, source))
 select alias, g_idx as gold_idx, g_source as gold_source, fact_idx as decoy_idx, source as decoy_source, similarity, distinct_relation, {_qtemplate} as question from (select *, row_number() over (partition by alias order by distinct_relation desc, similarity desc, fact_idx) as r from pr where similarity >= 0.05) where r = 1"""
_right = "trim(coalesce(" + ", ".join(f"nullif(g.metadata[{q(x)}], '')" for x in B.ANSWERING) + ", g.text, ''))"
PROBES = f"""with pb as ({COLLISIONS}), pn as (select *, row_number() over (order by alias) - 1 as i from pb), pj as (select pn.*, 'necessity_' || lpad(cast(i as varchar), 5, '0') as id, {_right} as gold_answer, g.relation as gold_relation, dd.relation as decoy_relation from pn join facts g on g.fact_idx = gold_idx join facts dd on dd.fact_idx = decoy_idx)"""
ROLLED = " union all ".join(f"select * from (with {found_of(m, ITEM_RECORDS, 'fd')}, {planned('p', 'fd')} select *, {q(m)} as method from rop)" for m in ("bm25", "hybrid", "bm25_skillrouted"))
SQL = {
    "family_rollup": f"""with ro as ({ROLLED}) select {_family('method')} as method_family, cast(sum(n_records) as bigint) as n, """ + ", ".join(f"round(sum({c} * n_records) / sum(case when {c} is not null then n_records end), 4) as {c}" for c in ("source_precision", "wrong_source_rate", "skill_source_agreement", "evidence_recall_at_k")) + " from ro group by 1",
    "probe_records": f"{PROBES} select id, 'necessity_probe' as source, i as source_index, question, '' as input_molecule_or_context, 'none' as input_type, gold_answer, 'necessity_probe' as task_type, alias as drug_name, {_head} || {_tail} as prompt from pj",
    "probe_provenance": f"{PROBES} select id, alias as collision_alias, gold_source, decoy_source, gold_idx, decoy_idx, gold_relation, decoy_relation, similarity, distinct_relation, false as validated from pj",
    "probe_counts": f"with pb as ({COLLISIONS}) select gold_source, decoy_source, count(*) as n, count(*) filter (where distinct_relation) as n_distinct from pb group by 1, 2",
    "slot_fill_status": retrieve("bm25_skillrouted").rsplit(" select qid, rank", 1)[0] + """, ev as (select qid, count(*) as n, bool_or(coalesce(facts.source = 'fdarxbench_label', false) or coalesce(facts.relation = 'label_context', false)) as label,
 bool_or(coalesce(facts.source in ('primekg', 'drugchat_pubchem', 'drugchat_chembl'), false)) as fact from e join facts using (fact_idx) where rank <= 3 group by 1),
 x as (select qa_id, skill.skill as skill, required_slots, list_filter([""" + ", ".join(f"case when coalesce({v}, false) then {q(k)} end" for k, v in _filled.items()) + """], lambda z: z is not null) as ok from qa join routed on routed.qid = qa.qa_id join skill on skill.skill = routed.skill left join ev on ev.qid = qa.qa_id)
 select qa_id, skill, array_to_string(list_filter(required_slots, lambda r: list_contains(ok, r)), ',') as filled_slots, array_to_string(list_filter(required_slots, lambda r: not list_contains(ok, r)), ',') as missing_slots, list_has_all(ok, required_slots) as all_required_filled from x""",
    "method_deltas": f"""with {SCORE}, m as (select model_name, question_type, method_name, count(*) as n, avg(token_f1) as f, avg(cast(numeric_match as int)) as x from scores group by 1, 2, 3)
 select m.model_name as model_name, m.question_type as question_type, m.method_name as method_name, m.n as n, round(m.f - b.f, 6) as f1_delta, round(m.x - b.x, 6) as numeric_delta from m join m b on b.method_name = 'bm25' and m.method_name <> 'bm25' and m.model_name = b.model_name and m.question_type = b.question_type""",
    "p5_found": f"with {_KEYED} select source, relation from k where source is not null and relation is not null group by 1, 2 having count(*) >= 0.04 * (select count(*) from facts)",
    "p5_report": f"""with {_KEYED} select source, relation, cast(count(*) as bigint) as n_rows, count(distinct id) as n_ids, quantile_disc(loaded_at, 0.5) as median_loaded, quantile_disc(loaded_at, 0.9) as p90_loaded,
 max(loaded_at) as latest_loaded, round(count(*) / (select count(*) from facts), 6) as share from k where source is not null and relation is not null group by 1, 2""",
    "fact_token_counts": f"""select fact_idx, len({tokens("coalesce(text, '')")}) as n_tokens, len(list_distinct({tokens("coalesce(text, '')")})) as n_distinct, length(concat_ws(' ', {has('title')}, {has('text')}, {has("array_to_string(list_filter(aliases, lambda x: x is not null), ' ')")})) as n_chars,
 array_to_string(list_sort(list_distinct({tokens("coalesce(text, '')")}))[1:5], ' ') as first_terms from facts""",
    "passages": "select fact_idx, case when coalesce(title, '') <> '' and not contains(lower(coalesce(text, '')), lower(title)) then title || '. ' || coalesce(text, '') else coalesce(text, '') end as passage from facts",
    "normal_forms": f"with {PRED} select pred_id, {norm('prediction')} as normal, {metric('prediction', 'none')} as metric, {metric('reference_output', '')} as reference_metric from pred",
    "stable_ids": f"select fact_idx, {stable(20, 'source', 'title', 'text')} as fid, {stable(16, 'source_id', 'fact_idx')} as rid from facts",
    "hash_buckets": f"select distinct id, cast({bucket('id', 6)} as bigint) as bucket, {half('id')} as half from qa_records",
    "mention_counts": f"with {QA}, {MENTION} select alias, count(*) as n from asked group by 1",
    "record_types": f"""with {QA} select qa_id, {smiles('decoded_smiles')} as smiles, case when coalesce({strip('input_molecule_or_context')}, '') = '' then 'none' when source like 'drugchat%' then 'SMILES' when {strip('input_molecule_or_context')} like '[%' then 'SELFIES' when {smiles('input_molecule_or_context')} then 'SMILES' else 'text' end as kind,
 {shape('gold_answer')} as shape, {qtype('source', 'task_type')} as question_type, coalesce(nullif({norm('drug_name')}, ''), nullif({norm('decoded_smiles')}, ''), nullif({norm('input_molecule_or_context')}, '')) as identity from qa""",
    "numbers": f"with {SCORE} select pred.pred_id as pred_id, {number('prediction')} as first_number, {is_number('reference_output')} as is_numeric, scores.numeric_match as matched from pred join scores using (pred_id)",
    "entity_names": f"select source, {norm('e')} as entity, count(*) as n from (select source, unnest(list_concat(coalesce(aliases, []), coalesce(entities, []))) as e from facts) where trim(e) <> '' group by 1, 2",
    "result_file_fields": f"select file_name, {part(1)} as model, {part(2)} as data, coalesce({part(3)}, case when {part(1)} is not null then 'none' end) as method, {part(4)} as variant from (select distinct concat_ws('_', model_name, dataset, method_name, 'ret_test_eval.json') as file_name from predictions)",
    "routes": f"with {QA} select qa_id, {ROUTE} as skill, {LEGACY} as legacy, {PREDICTED} as predicted, {ANALYSIS} as analysis, {RANDOM} as random, {wrong('(' + ROUTE + ')')} as wrong from qa",
    "router_confusion": f"with {QA}, r as (select {ROUTE} as gold, {PREDICTED} as predicted from qa) select gold, " + ", ".join(f"count(*) filter (where predicted = {q(s)}) as {s}" for s in SKILLS) + " from r group by 1",
    "router_accuracy": f"with {QA}, r as (select {ROUTE} as gold, {PREDICTED} as predicted from qa) select gold, count(*) as n, count(*) filter (where gold = predicted) as n_correct, round(avg(cast(gold = predicted as int)), 6) as accuracy from r group by 1",
    "skill_pools": f"with {SKILL} select skill, count(*) as n_facts, count(distinct source || '|' || relation) as n_pairs from facts join skill on list_contains(sources, source) and list_contains(relations, relation) group by 1",
    "slot_availability": f"""with {QA}, {WITH_EVIDENCE}, z as (select *, {ANALYSIS} as skill from qe), x as (select skill, {_FILLED} as ok, unnest({_NEEDED}) as slot from z) select skill, slot, count(*) as n, count(*) filter (where list_contains(ok, slot)) as filled from x group by 1, 2""",
    "skill_analysis": f"""with {QA}, {WITH_EVIDENCE}, z as (select qa_id, source as dataset, task_type, {ANALYSIS} as skill, {_FILLED} as ok, {_CHARS} as chars from qe), y as (select *, list_has_all(ok, {_NEEDED}) as complete from z),
 g as (select dataset, skill, task_type, count(*) as n, round(avg(chars), 2) as avg_prompt_chars, max(chars) as max_prompt_chars, round(avg(cast(complete as int)), 6) as all_required_slots_coverage from y group by 1, 2, 3),
 e as (select dataset, skill, task_type, facts.source as es, count(*) as k from kge join facts using (fact_idx) join y on y.qa_id = kge.qid group by 1, 2, 3, 4)
 select g.dataset as dataset, g.skill as skill, g.task_type as task_type, n, avg_prompt_chars, max_prompt_chars, all_required_slots_coverage, coalesce(es, 'none') as evidence_source, coalesce(k, 0) as retrieved_facts, round(coalesce(k, 0) / n, 6) as facts_per_example
 from g left join e on g.dataset is not distinct from e.dataset and g.skill = e.skill and g.task_type is not distinct from e.task_type""",
    "items_routed": retrieve("bm25_skillrouted", records=ITEM_RECORDS),
    "items_unrouted": retrieve("bm25_skillrouted", records=ITEM_RECORDS, routing=False),
    "items_capped": retrieve("hybrid", records=ITEM_RECORDS, cap=200),
    "run_counters": f"""with {found_of('hybrid', ITEM_RECORDS, 'fd')}, k as (select qid, count(*) as k, count(*) filter (where alias_hit) as h from fd group by 1)
 select routed.skill as skill, count(*) as records, count(*) filter (where k > 0) as with_evidence, cast(coalesce(sum(k), 0) as bigint) as facts, cast(coalesce(sum(h), 0) as bigint) as alias_hits from routed left join k on k.qid = routed.qid group by 1""",
    "baseline_prompts": f"""with {ITEM_RECORDS}, queries as (select qa_id as qid, {QTEXT} as qtext from qa), {POST}, {TERMS}, {LEX}, {TOP8}, {block('top8', 3500)}
 select qa_id, {_head} || {context} || chr(10) || chr(10) || {q(B.EVIDENCE_HEAD)} || chr(10) || coalesce(block, {q(B.NO_EVIDENCE)}) || {_tail} as prompt, {_answer} as answer from qa left join bl on bl.qid = qa.qa_id""",
    "augmented_records": f"""with {found_of('skill_hybrid', ITEM_RECORDS, 'fd')}, k as (select qid, count(*) as n, min(fact_idx) filter (where rank = 1) as f from fd group by 1), ks as (select qid, string_agg(src, ',' order by src) as s from (select distinct qid, coalesce(facts.source, 'unknown') as src from fd join facts using (fact_idx)) group by 1)
 select routed.qid as qa_id, routed.skill as skill, coalesce(n, 0) as n_evidence, f as first_fact, coalesce(s, '') as evidence_sources from routed left join k on k.qid = routed.qid left join ks on ks.qid = routed.qid""",
    "evidence_counts": f"""with {BM25}, {TOP8}, {QA}, {GRAPH}, r as (select qa_id, trim(decoded_smiles) as m from qa where trim(decoded_smiles) <> ''), mp as (select * from (select a.qa_id as qa_id, b.qa_id as other, row_number() over (partition by a.qa_id order by b.qa_id) as rank from r a join r b on a.m = b.m and a.qa_id <> b.qa_id) where rank <= 3),
 al as (select 'kb' as kind, coalesce(source, 'unknown') as source, coalesce(relation, 'unknown') as relation from top8 join facts using (fact_idx) union all select 'kg', 'corrected_primekg', null from kge union all select 'molecule', coalesce(qa.source, 'corrected_molecule'), null from mp join qa on qa.qa_id = mp.other) select kind, source, relation, count(*) as n from al group by 1, 2, 3""",
    "rrf_dense": f"""with {VEC}, {dense(50)}, queries as (select qid, coalesce(text, '') as qtext from qv join facts on facts.fact_idx = qv.qid), {POST}, {TERMS}, {LEX}, l1 as (select qid, fact_idx, row_number() over (partition by qid order by score desc, fact_idx desc) as r from lex where score > 0),
 la as (select qid, fact_idx, row_number() over (partition by qid order by r) as r2 from l1 where r <= 51 and qid <> fact_idx), lb as (select * from la where r2 <= 50), db as (select qid, fact_idx, rank as r1 from dn), fu as (select qid, fact_idx, r1, r2, round(coalesce(1.0 / (60.0 + r1), 0.0) + coalesce(1.0 / (60.0 + r2), 0.0), 9) as score from db full join lb using (qid, fact_idx))
 select * from (select qid, row_number() over (partition by qid order by score desc, r1 nulls last, r2 nulls last) as rank, fact_idx, score from fu) where rank <= 8""",
    "alias_lists": f"""with a as (select distinct {norm('a')} as alias, fid from (select unnest(aliases) as a, {stable(20, 'source', 'title', 'text')} as fid from facts) where {norm('a')} <> ''), p as (select alias, ceil(count(*) / 1000) as parts from a group by 1)
 select a.alias as alias, cast(floor(cast('0x' || substr(fid, 1, 4) as bigint) * parts / 65536) as bigint) as part, string_agg(fid, ',' order by fid) as fact_ids from a join p on p.alias = a.alias group by 1, 2""",
    "base_prompts": f"with {QA} select qa_id, {_head} || {context} || {_tail} as prompt, {_answer} as answer from qa",
    "built_records": f"""with {_raw} select qa_id, {stable(20, 'source', 'source_index', 'instruction', 'input', 'output')} as id, source, source_index, instruction as question, input as input_molecule_or_context, {_kind('input', 'source')} as input_type, output as gold_answer,
 coalesce(nullif({_meta('task')}, ''), case source {" ".join(f"when {q(k)} then {q(v)}" for k, v in B.TASKS.items())} end, source) as task_type from raw""",
    "built_pool": f"""with {_raw}, o as (select qa_id, source, try_cast(source_index as bigint) as pos, source_index, coalesce({_meta('split')}, split, 'train') = 'test' as t from raw)
 select qa_id, source, 'train' as pool from (select *, row_number() over (partition by source order by pos nulls last, source_index, qa_id) as r from o where not t) where r <= 200 union all select qa_id, source, 'test' from o where t""",
    "candidate_mentions": f"with {QA}, {CANDIDATES} select name, count(*) as n from cand group by 1",
    "label_contexts": f"""with {_raw} select qa_id, array_to_string({_item_ok}, chr(10) || chr(10)) as passages, len(list_filter(list_transform(string_split(coalesce(input_molecule_or_context, ''), chr(10))[1:4], lambda t: {strip('t')}), lambda t: t <> '')) as n_used
 from (select *, input_molecule_or_context as input from (select *, row_number() over (partition by qa_id order by loaded_at desc) as k from qa_records where qa_id is not null) where k = 1) where input_type = 'FDA label context'""",
    "built_bank": f"with {BANK} select fact_idx, id, source, source_id, title, text, relation, len(aliases) as n_aliases, {_tok('concat_ws(' + chr(39) + ' ' + chr(39) + ', nullif(title, ' + chr(39) * 2 + '), nullif(text, ' + chr(39) * 2 + '), nullif(array_to_string(aliases, ' + chr(39) + ' ' + chr(39) + '), ' + chr(39) * 2 + '))')} as n_tokens from bank",
    "source_support": f"with {SUPPORT} select * from supp",
    "best_sources": f"with {SUPPORT} select grp, source as best_source, mean_gold_token_recall as recall, n from (select *, row_number() over (partition by grp order by mean_gold_token_recall desc, list_position({array(R.SOURCES)}, source)) as r from supp) where r = 1",
    "source_shares": f"with {MIX('source')}, v as (select grp, source, avg_facts * examples_with_evidence as v from mix where {among('source', R.SOURCES)}) select grp, source, round(case when sum(v) over (partition by grp) > 0 then v / sum(v) over (partition by grp) else 0.0 end, 6) as share from v",
    "utility_matrix": f"""with {SCORE}, s as (select dataset, question_type, method_name, model_name, avg(utility) as u from scores group by 1, 2, 3, 4), m as (select dataset, question_type, method_name, round(avg(u), 6) as utility from s group by 1, 2, 3)
 select dataset, question_type, method_name, utility, round(utility - avg(utility) over (partition by dataset, question_type), 5) as centred, row_number() over (partition by dataset, question_type order by utility desc, method_name) = 1 as is_best from m""",
    "policy_gains": f"""with {SCORE}, m as (select model_name, question_type, method_name, avg(token_f1) as f from scores group by 1, 2, 3), x as (select m.model_name as model_name, m.question_type as question_type, m.method_name as method_name, round(m.f - b.f, 6) as f1_delta from m join m b on b.method_name = 'bm25' and m.method_name <> 'bm25' and m.model_name = b.model_name and m.question_type = b.question_type)
 select * from (select model_name, 'top' as "end", row_number() over (partition by model_name order by f1_delta desc, question_type, method_name) as place, question_type, method_name, f1_delta from x) where place <= 3 union all select * from (select model_name, 'bottom', row_number() over (partition by model_name order by f1_delta, question_type, method_name) as place, question_type, method_name, f1_delta from x) where place <= 3""",
    "closed_and_retrieved": f"with {SCORE} select case when method_name = 'none' then 'closed_book' else 'retrieval' end as origin, model_name, method_name, count(*) as n, round(avg(token_f1), 6) as token_f1 from scores where method_name in ('none', 'bm25', 'hybrid', 'kg') group by 1, 2, 3",
    "file_methods": f"select file_name, {_method('file_name')} as method, {_family(_method('file_name'))} as family from (select distinct concat_ws('_', model_name, dataset, method_name, 'test.jsonl') as file_name from predictions)",
    "zipped_deltas": f"""with {SCORE}, x as (select *, row_number() over (partition by model_name, dataset, method_name order by pred_id) as r from scores where method_name in ('none', 'hybrid') and model_name is not null and dataset is not null)
 select a.model_name as model_name, a.dataset as dataset, a.question_type as question_type, count(*) as n, round(avg(a.token_f1), 6) as base_f1, round(avg(b.token_f1), 6) as kb_f1, round(avg(b.token_f1) - avg(a.token_f1), 6) as delta
 from x a join x b on a.method_name = 'none' and b.method_name = 'hybrid' and a.model_name = b.model_name and a.dataset = b.dataset and a.r = b.r group by 1, 2, 3""",
    "collected_results": f"""with {SCORE}, s as (select model_name as model, dataset, method_name as method, count(*) as n, round(avg(token_f1), 6) as f, round(avg(cast(numeric_match as int)), 6) as x from scores where model_name is not null and dataset is not null and method_name is not null group by 1, 2, 3)
 select model, dataset, method, dataset as subtask, 'raw' as variant, n, round(coalesce(x, f), 6) as headline, case when method in ('rrf', 'bm25') then 'summary' else 'file' end as came_from from s where method in ('rrf', 'bm25') or regexp_matches(concat_ws('_', model, dataset, method, 'raw_test_eval.json'), {q(FILE)})""",
    "cluster_texts": f"""with {QA} select qa_id, concat_ws(' ', 'source=' || coalesce(source, ''), 'task=' || coalesce(task_type, ''), 'input_type=' || coalesce(input_type, ''), 'answer_shape=' || {shape('gold_answer')}, {", ".join(f"case when coalesce({v.replace('graph or molecule', 'false').replace('graph', 'false')}, false) then 'has_{k}' end" for k, v in _data_slots.items())}, question, task_type, input_type, substr(input_molecule_or_context, 1, 500)) as text from qa""",
    "routing_clusters": f"""with {QA}, r as (select {LEGACY} as cluster, {ANALYSIS} as skill from qa), c as (select cluster, skill, count(*) as n from r group by 1, 2), d as (select *, row_number() over (partition by cluster order by n desc, skill) as k from c)
 select cluster, cast(sum(n) as bigint) as n, max(case when k = 1 then skill end) as top_skill, round(max(n) / sum(n), 6) as purity, string_agg(skill || ':' || cast(n as varchar), '|' order by n desc, skill) as skill_counts from d group by 1""",
    "routing_agreement": f"""with {QA}, r as (select {LEGACY} as cluster, {ANALYSIS} as skill from qa), c as (select cluster, skill, count(*) as n from r group by 1, 2), a as (select cluster, sum(n) as a, max(n) as m from c group by 1), b as (select skill, sum(n) as b from c group by 1),
 t as (select cast(sum(a) as double) as t, cast(sum(m) as double) as m, cast(sum(a * (a - 1) / 2) as double) as sa, sum(a * ln(a)) as la from a), u as (select cast(sum(b * (b - 1) / 2) as double) as sb, sum(b * ln(b)) as lb from b), v as (select cast(sum(n * (n - 1) / 2) as double) as sn, sum(n * ln(n)) as ln_ from c)
 select cast(t as bigint) as n, round(m / t, 6) as purity, round(2 * (ln(t) + (ln_ - la - lb) / t) / ((ln(t) - la / t) + (ln(t) - lb / t)), 6) as nmi, round((sn - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) as ari from t, u, v""",
    "item_inventory": f"with i as (select *, {qtype('dataset', 'task_type')} as question_type from eval_items), m as (select dataset, question_type, count(*) as n, min(item_id) as first_item from i group by 1, 2) select m.dataset as dataset, m.question_type as question_type, n, first_item, i.task_type as task_type from m join i on i.item_id = first_item",
    "source_holdout": f"with {QA}, hold as (select qa_id, source as identity, case when source = 'fdarxbench' then 'test' else 'train' end as split from qa), {SUMMARY}",
    "bank_summary": "select '{" + '"total":' + "' || cast(count(*) as varchar) || '" + "".join(f',"{x}":' + f"' || cast(count(*) filter (where source = '{x}') as varchar) || '" for x in B.FAMILIES) + "}' as summary from facts",
    "bm25_topk": f"with {BM25}, {TOP8} select qid, rank, fact_idx, cast(score as double) as score from top8",
    "bm25_lexical_rank": f"with {BM25} select qid, rank, fact_idx from (select qid, fact_idx, row_number() over (partition by qid order by score desc, fact_idx desc) as rank from lex where score > 0) where rank <= 50",
    "candidate_cap": f"""with {BM25}, pr as (select qid, fact_idx, min(term_rank) as r from qt join post on qt.term = post.term group by 1, 2), pk as (select qid, r, coalesce(sum(count(*)) over (partition by qid order by r rows between unbounded preceding and 1 preceding), 0) as before from pr group by 1, 2)
 select pr.qid as qid, count(*) as n_candidates, max(pr.r) as last_term from pr join pk on pr.qid = pk.qid and pr.r = pk.r and before < 200 group by 1""",
    "kg_retrieve": retrieve("kg"),
    "hybrid_retrieve": retrieve("hybrid"),
    "skill_hybrid_retrieve": retrieve("skill_hybrid"),
    "bm25_routed": retrieve("bm25_skillrouted"),
    "bm25_routed_predicted": retrieve("bm25_skillrouted", PREDICTED),
    "bm25_routed_random": retrieve("bm25_skillrouted", RANDOM),
    "bm25_routed_wrong": retrieve("bm25_skillrouted", wrong("(" + ROUTE + ")")),
    "dense_topk": f"with {VEC}, {dense(8)} select qid, rank, fact_idx, score from dn",
    "dense_locked": f"with {VEC}, {dense(8, chr(115) + 'ource = ' + q('fdarxbench_label'))} select qid, rank, fact_idx, score from dn",
    "oracle_topk": f"with {VEC}, {dense(8, 'source = qs')} select qid, rank, fact_idx, score from dn",
    "dense_routed_pool": f"with {VEC}, {dense(300)}, rp as (select dn.qid as qid, dn.fact_idx as fact_idx, score, row_number() over (partition by dn.qid order by score desc, rank) as rank from dn join qv on dn.qid = qv.qid join v on v.fact_idx = dn.fact_idx and v.source = qs) select qid, rank, fact_idx, score from rp where rank <= 8",
    "rrf_fusion": f"with {RRF} select qid, rank, fact_idx, score from fr where rank <= 8",
    "rerank_overlap": f"""with {RRF}, rr as (select fr.qid as qid, fr.fact_idx as fact_idx, rank as pr, round({jac('list_distinct(' + tokens('qtext') + ')', 'list_distinct(' + tokens("coalesce(text, '')") + ')', '1.0')}, 6) as score from fr join queries on fr.qid = queries.qid join facts f on f.fact_idx = fr.fact_idx cross join lateral (select f.text as text) z where rank <= 50)
 select * from (select qid, fact_idx, score, row_number() over (partition by qid order by score desc, pr) as rank from rr) where rank <= 8""".replace(" cross join lateral (select f.text as text) z", "").replace("coalesce(text, '')", "coalesce(f.text, '')"),
    "evidence_blocks": f"with {BM25}, {TOP8}, {block('top8', 600)} select qid, n_lines, block from bl",
    "prompts": prompts(set()),
    "prompts_ablated": prompts({"solving_steps", "evidence_org"}),
    "alias_index": f"select alias, count(distinct fid) as n_facts, count(distinct source) as n_sources, min(fid) as first_id from (select {norm('a')} as alias, source, fid from (select unnest(aliases) as a, source, {stable(20, 'source', 'title', 'text')} as fid from facts)) where alias <> '' group by 1",
    "kg_edges_capped": f"""with {QA}, {EDGE}, {WANT}, en as (select name, fact_idx, count(*) as n from (select fact_idx, unnest([x, y]) as name from edge) join want using (name) group by 1, 2), kp as (select *, coalesce(sum(n) over (partition by name order by fact_idx rows between unbounded preceding and 1 preceding), 0) as before from en)
 select * from edge where fact_idx in (select fact_idx from kp where before < 10)""",
    "kg_evidence": f"with {QA}, {EDGE}, {WANT}, en as (select fact_idx, x as name, 0 as side from edge union all select fact_idx, y, 1 from edge) select * from (select name, row_number() over (partition by name order by fact_idx, side) as rank, fact_idx from en join want using (name)) where rank <= 6",
    "kg_evidence_attached": f"""with {QA}, {EDGE}, {WANT}, en as (select fact_idx, x as name, 0 as side from edge union all select fact_idx, y, 1 from edge), ev as (select * from (select name, row_number() over (partition by name order by fact_idx, side) as rank, fact_idx from en join want using (name)) where rank <= 6),
 nm as (select distinct name from ev where length(name) >= 4 and regexp_matches(name, '[a-z0-9]{{3}}')), t as (select qa_id as qid, {norm(QTEXT)} as t from qa),
 held as (select qid, name from t, nm where contains(t.t, name)), att as (select distinct qid, fact_idx from held join ev using (name)) select * from (select qid, fact_idx, row_number() over (partition by qid order by fact_idx) as rank from att) where rank <= 6""",
    "molecule_evidence": f"with {QA}, r as (select qa_id, trim(decoded_smiles) as m from qa where trim(decoded_smiles) <> '') select * from (select a.qa_id as qa_id, row_number() over (partition by a.qa_id order by b.qa_id) as rank, b.qa_id as other from r a join r b on a.m = b.m and a.qa_id <> b.qa_id) where rank <= 3",
    "collision_probe": COLLISIONS,
    "record_scores": f"with {SCORE} select pred_id, exact, normalized_exact, round(token_f1, 6) as token_f1, numeric_match, round(utility, 6) as utility from scores",
    "eval_summary": f"with {SCORE} select dataset, method_name, count(*) as n, round(avg(cast(exact as int)), 6) as exact, round(avg(cast(normalized_exact as int)), 6) as normalized_exact, count(numeric_match) as numeric_n, round(avg(cast(numeric_match as int)), 6) as numeric_accuracy, round(avg(token_f1), 6) as avg_token_f1 from scores group by 1, 2",
    "grouping_sets_report": f"with {SCORE}, x as (select model_name, method_name, coalesce(task_type, 'unknown') as task_type, token_f1, cast(exact as int) as e from scores) select model_name, method_name, case when grouping(task_type) = 1 then 'overall' else task_type end as task_type, count(*) as n, round(avg(token_f1), 6) as token_f1, round(avg(e), 6) as exact from x group by grouping sets ((model_name, method_name, task_type), (model_name, method_name))",
    "macro_average": f"with {SCORE}, t as (select model_name, method_name, task_type, avg(utility) as m from scores group by 1, 2, 3) select model_name, method_name, count(*) as n_tasks, round(avg(m), 6) as macro from t group by 1, 2",
    "weighted_mean": f"with {SCORE}, s as (select method_name, task_type, count(*) as n, avg(cast(numeric_match as int)) as numeric from scores group by 1, 2) select method_name, cast(sum(n) as bigint) as n, round(sum(numeric * n) / sum(n), 6) as numeric from s where numeric is not null group by 1",
    "performance_by_type": f"with {SCORE} select model_name, dataset, question_type, method_name, {half('cast(pred_id as varchar)')} as part, count(*) as n, round(avg(utility), 6) as utility from scores group by 1, 2, 3, 4, 5",
    "policy_select_holdout": f"""with {SCORE}, m as (select model_name, dataset, question_type, method_name, {half('cast(pred_id as varchar)')} as part, count(*) as n, round(avg(utility), 6) as u from scores group by 1, 2, 3, 4, 5),
 ch as (select * from (select *, row_number() over (partition by model_name, dataset, question_type order by u desc, method_name desc) as r from m where part = 'discovery') where r = 1)
 select ch.model_name as model_name, ch.dataset as dataset, ch.question_type as question_type, ch.method_name as selected_method, ch.u as discovery_utility, ev.n as evaluation_n, ev.u as evaluation_utility from ch left join m ev on ev.part = 'evaluation' and ev.model_name = ch.model_name and ev.dataset = ch.dataset and ev.question_type = ch.question_type and ev.method_name = ch.method_name""",
    "method_model_pivot": f"""with {SCORE}, g as (select method_name, model_name, printf('%.3f', round(avg(token_f1), 3)) || ' / ' || printf('%.3f', round(avg(cast(exact as int)), 3)) as cell from scores where model_name is not null group by 1, 2),
 gr as (select * from (select distinct method_name from scores where model_name is not null) cross join (select distinct model_name from scores where model_name is not null)) select gr.method_name as method_name, gr.model_name as model_name, coalesce(cell, '-') as cell from gr left join g on g.model_name = gr.model_name and g.method_name is not distinct from gr.method_name""",
    "ordering_check": f"""with {SCORE}, p as (select model_name, dataset, avg(utility) filter (where method_name = 'bm25') as u, avg(utility) filter (where method_name = 'hybrid') as s, avg(utility) filter (where method_name = 'rrf') as o from scores group by 1, 2)
 select model_name, dataset, round(s - u, 4) as skill_gap, round(o - s, 4) as oracle_gap, u <= s + 0.05 and s <= o + 0.05 as ordered from p where u is not null and s is not null and o is not null""",
    "completeness_anti": f"""with {PRED}, grid as (select * from (select distinct model_name from pred) cross join (select distinct method_name from pred) cross join (select distinct dataset, task_type from pred))
 select grid.model_name as model_name, grid.method_name as method_name, grid.dataset as dataset, grid.task_type as task_type from grid left join (select distinct model_name as a, method_name as b, dataset as c, task_type as d from pred) on model_name = a and method_name = b and dataset = c and task_type = d where a is null""",
    "answer_token_recall": f"""with {QA}, w as (select qa_id as pred_id, list_filter({words('input_molecule_or_context', '')}, lambda x: length(x) > 2 and not ({among('x', T.RECALL_STOPWORDS)})) as a, list_filter({words('gold_answer', '')}, lambda x: length(x) > 2 and not ({among('x', T.RECALL_STOPWORDS)})) as b from qa), bag as (select * from w), {BAGS}
 select pred_id as qa_id, round(case when n_b > 0 then cast(common as double) / n_b else 0.0 end, 6) as recall from sz""",
    "set_recall": f"with {QA}, w as (select qa_id, list_distinct({words('gold_answer', '')}) as g, list_distinct({words('input_molecule_or_context', '')}) as e from qa) select qa_id, round(case when len(g) > 0 then len(list_intersect(g, e)) / len(g) end, 6) as recall from w",
    "multiset_intersection": f"with {PRED}, bag as (select pred_id, {words('prediction')} as a, {words('reference_output')} as b from pred), {BAGS} select pred_id, n_a, n_b, common from sz",
    "source_mix": f"with {MIX('source')} select * from mix",
    "relation_mix": f"with {MIX('relation')} select * from mix",
    "heterogeneity": f"""with {MIX('source')}, {DIST}, {SUPPORTED}, gt as (select grp, {_allow_type} as allow from (select {_grp} as grp, min({qtype('dataset', 'task_type')}) as t from queries group by 1)),
 h as (select dist.grp as grp, arg_max(dist.source, share - pos * 1e-12) as dominant_source, max(share) as d, -sum(case when share > 0 then share * log2(share) else 0.0 end) as h, sum(case when list_contains(allow, dist.source) then share else 0.0 end) as os,
 sum(case when list_contains(allow, dist.source) then coalesce(mean_gold_token_recall, 0.0) else 0.0 end) as sr, sum(coalesce(mean_gold_token_recall, 0.0)) as tr from dist join gt on gt.grp = dist.grp left join supp on supp.grp = dist.grp and supp.source = dist.source group by 1)
 select grp, dominant_source, round(d, 4) as dominant_share, round(h + 0.0, 4) as entropy_bits, round(h / 2.0 + 0.0, 4) as normalized_entropy, round(pow(2.0, h), 4) as effective_sources, round(os, 4) as oracle_source_share, round(case when tr > 0 then sr / tr else 0.0 end, 4) as oracle_support_share from h""",
    "js_divergence": f"""with {MIX('source')}, {DIST}, pr as (select a.grp as grp_a, b.grp as grp_b, sum(case when a.share > 0 then a.share * log2(a.share / ((a.share + b.share) / 2)) else 0.0 end) / 2 + sum(case when b.share > 0 then b.share * log2(b.share / ((a.share + b.share) / 2)) else 0.0 end) / 2 as js from dist a join dist b on a.source = b.source and a.grp < b.grp group by 1, 2)
 select grp_a, grp_b, round(js, 4) as js_divergence from pr union all select 'ALL', 'MEAN', round(avg(js), 4) from pr""",
    "planning_metrics": f"""with {found_of('kg', QA, 'fd')}, {PRED}, pd as (select qa_id as qid, prediction from (select *, row_number() over (partition by qa_id order by pred_id desc) as k from pred where method_name = 'kg' and qa_id is not null) where k = 1), {planned('p', 'fd', 'left join pd on pd.qid = p.qid')} select *, 'kg' as method, 'uniform' as method_family from rop""",
    "field_coverage": " union all ".join(f"select source, count(*) over_n, {q(c)} as field, count(*) filter (where {c} <> '') as present from qa_records group by 1".replace("count(*) over_n", "count(*) as n") for c in _cov) + " union all select source, count(*), 'qa_id', count(qa_id) from qa_records group by 1 union all select source, count(*), 'created_at', count(created_at) from qa_records group by 1 union all select source, count(*), 'loaded_at', count(loaded_at) from qa_records group by 1 union all select source, count(*), 'metadata', count(*) filter (where cardinality(metadata) > 0) from qa_records group by 1",
    "task_inventory": f"with {QA}, {WITH_EVIDENCE}, {INVENTORY} select * from ti",
    "answer_shape_counts": f"with {QA} select {shape('gold_answer')} as shape, count(*) as n from qa group by 1",
    "arrivals": f"with {_KEYED} select date_trunc('day', loaded_at) as start, source, relation, count(*) as n from k where loaded_at is not null group by 1, 2, 3",
    "noise_injected": f"with {KS}, nz as ({_noise.format(share=0.5)}) select *, len(list_distinct({tokens('text')})) as n_tokens from nz",
    "decoys_made": f"with {decoy(2, 0.3)} select fact_idx, copy, 'decoy_' || coalesce(own_id, cast(fact_idx as varchar)) || '_' || cast(copy as varchar) as id, source, true_source, title, relation, text, len(list_distinct({tokens('text')})) as n_tokens, own_id as decoy_of, coalesce(cardinality(metadata), 0) + 3 as n_flags from dc",
    "perturbed_counts": f"""with {decoy(1, 1.0)}, nz as ({_noise.format(share=1.0)}), al as (select 'noisy' as mode, source, false as injected from facts union all select 'decoy', source, false from facts union all select 'noisy', source, true from nz union all select 'decoy', source, true from dc)
 select mode, source, injected, count(*) as n from al group by 1, 2, 3""",
    "split_by_hash": f"with {QA} select qa_id, task_type, case when r <= 50 then 'train' when r <= 60 then 'dev' else 'rest' end as split from (select qa_id, task_type, row_number() over (partition by task_type order by sha1('13|' || cast(qa_id as varchar)), qa_id) as r from qa)",
    "identity_holdout": f"with {IDENT} select qa_id, identity, split from hold",
    "disjoint_proof": f"with {IDENT}, {SUMMARY}",
    "skill_holdout": f"with {QA}, hold as (select qa_id, {ROUTE} as identity, case when {ROUTE} = 'molecule_design' then 'test' else 'train' end as split from qa), {SUMMARY}",
}
