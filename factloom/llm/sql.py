"""The same results in SQL, where it can compute them on whole tables. The other operators are tested against brute force."""

_SETS = """w as (select qa_id, split, source, lower(trim(split)) = 'train' as t, list_distinct(regexp_extract_all(lower(concat_ws(' ', question, input_molecule_or_context, gold_answer)), '[a-z0-9]+')) as w
 from (select *, row_number() over (partition by qa_id order by loaded_at desc) as k from qa_records where qa_id is not null and split is not null) where k = 1),
 p as (select a.qa_id as tid, b.qa_id as eid, a.w as tw, b.w as ew, len(list_intersect(a.w, b.w)) as common from w a, w b where a.t and not b.t and len(a.w) > 0 and len(b.w) > 0 and len(a.w) * 5 >= len(b.w) * 4 and len(b.w) * 5 >= len(a.w) * 4),
 o as (select tid, eid, common = len(tw) and common = len(ew) as same from p where common * 5 >= (len(tw) + len(ew) - common) * 4)"""

SQL = {
    "p3_found": f"with {_SETS} select least(tid, eid) as qa_a, greatest(tid, eid) as qa_b from o",
    "p3_report": f"""with {_SETS}, l as (select eid, count(*) as links, max(case when same then 1 else 0 end) as exact from o group by 1)
 select split, source, count(*) as n_records, count(*) filter (where exact = 1) as n_exact, count(*) filter (where exact = 0) as n_near, cast(coalesce(sum(links), 0) as bigint) as n_links from w left join l on l.eid = w.qa_id where not t and len(w.w) > 0 group by 1, 2""",
}
