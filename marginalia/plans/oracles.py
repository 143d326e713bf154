"""The same derived tables and results in DuckDB's SQL, to check the Spark jobs against."""

from __future__ import annotations

import re


def _norm(x: str) -> str:
    """Normalisation for matching, without look-around (the engine has none): the letter and the mark after are captured."""
    fold = "translate(regexp_replace(coalesce({x}, ''), '[\\x{{E000}}-\\x{{F8FF}}]', ' ', 'g'), '‘’‚‛“”„‟–—―−  ', '''''''''\"\"\"\"----  ')".format(x=x)
    drop = f"regexp_replace(replace({fold}, '…', '...'), '\\[\\^[0-9]+\\]', '', 'g')"
    digits = f"""regexp_replace({drop}, '([A-Za-z])[0-9]{{1,2}}([\\s\\x{{1c}}-\\x{{1f}}.,;:!?''")\\]]|$)', '\\1\\2', 'g')"""
    return f"trim(regexp_replace({digits}, '[\\s\\pZ\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', ' ', 'g'))"


def _pick(values: str, number: str) -> str:
    names = values.split()
    return f"[{', '.join(repr(n) for n in names)}][({number}) % {len(names)} + 1]"


_TYPES, _BASES, _RELATIONS = "definition claim method question background", "author author-data reported", "defines supports contrasts elaborates exemplifies motivates"

def singular(w: str) -> str:
    known = " ".join(f"when {w} = '{a}' then '{b}'" for a, b in {"wives": "wife", "lives": "life", "children": "child", "women": "woman", "men": "man", "feet": "foot", "teeth": "tooth"}.items())
    return f"case {known} when length({w}) <= 3 or ends_with({w}, 'ss') then {w} when ends_with({w}, 'ies') then left({w}, length({w}) - 3) || 'y' when regexp_matches({w}, '(ses|xes|zes|ches|shes)$') then left({w}, length({w}) - 2) when ends_with({w}, 's') then left({w}, length({w}) - 1) else {w} end"


#: Each view's SQL; a view may use any that stands before it.
VIEWS = {
    "page_no": "select doc_id, coalesce(source, '') as book_id, row_number() over (partition by coalesce(source, '') order by doc_id) - 1 as page_index from documents",
    "heads": """select book_id, page_index, case when page_index < 2 then '' when page_index % 50 between 30 and 35 then case when page_index % 2 = 0 then 'TABLE B: TOOLS' else 'ACCESSORIES' end
        when page_index % 50 between 40 and 41 then 'TABLE L' when page_index % 50 = 42 then 'FAMILY' when page_index % 50 between 43 and 44 then 'TABLE M' when page_index % 50 >= 47 then 'BIBLIOGRAPHY'
        when page_index % 3 = 0 then 'THE ' || upper(book_id) || ' BOOK' when page_index % 5 = 1 then 'CHAPTER ' || (1 + page_index // 8)::varchar || ': PART ' || (page_index // 8)::varchar
        else 'CHAPTER ' || (1 + page_index // 8)::varchar end as top_line from page_no""",
    "cut": "select doc_id, string_split(text, chr(10)) as lines from documents",
    "pages": """select n.book_id, n.page_index, n.doc_id, case when len(lines) > 1 then array_to_string(lines[1:len(lines) - 1], chr(10)) else lines[1] end as body, case when len(lines) > 1 then lines[len(lines)] else '' end as footnotes,
        case when n.page_index = 0 then 'i' when n.page_index = 1 then 'ii' when n.page_index = 7 then null when n.page_index >= 30 then (n.page_index - 29)::varchar else (n.page_index - 1)::varchar end as page_label,
        case when length(case when len(lines) > 1 then array_to_string(lines[1:len(lines) - 1], chr(10)) else lines[1] end) < 20 then 'blank' when n.doc_id % 17 = 0 then 'table' when n.doc_id % 13 = 0 then 'figure' else 'text' end as page_type, h.top_line
        from page_no n join cut using (doc_id) join heads h on h.book_id = n.book_id and h.page_index = n.page_index""",
    "norm": f"select book_id, page_index, doc_id, page_type, {_norm('body')} as body_norm, {_norm('footnotes')} as foot_norm from pages",
    "sents": """select book_id, page_index, doc_id, k - 1 as k, s[k] as sent from (select book_id, page_index, doc_id, s, unnest(range(1, len(s) + 1)) as k from (select book_id, page_index, doc_id,
        string_split(regexp_replace(body_norm, '([.!?]) ([A-Z''"(])', '\\1' || chr(10) || '\\2', 'g'), chr(10)) as s from norm where page_type = 'text'))""",
    "evidence": """select book_id, page_index, doc_id, k, 'e-' || k::varchar as evidence_id, case when (k * 7 + doc_id) % 29 = 0 then 'figure' else 'text' end as kind, 'body' as source, case when (k * 31 + doc_id) % 11 = 0 then sent || ' zzqx' else sent end as excerpt,
        case when k % 37 = 36 then page_index + 1 end as page_override, null::varchar as locator, case when k % 41 = 5 then 'greek' end as script, case when (k * 7 + doc_id) % 29 = 0 then 'Figure ' || k::varchar end as caption, case when k % 23 = 7 then 'in other words: ' || sent end as excerpt_translation from sents where length(sent) >= 15 and (k + page_index) % 3 = 0
        union all select book_id, page_index, doc_id, null, 'e-f', 'text', 'footnote', footnotes, null, (doc_id % 9)::varchar, null, null, null from pages where page_type = 'text' and doc_id % 4 = 0 and trim(footnotes) <> ''""",
    "statements": f"""select book_id, page_index, doc_id, k, 's-' || k::varchar as statement_id, case when (k * 13 + doc_id) % 101 = 0 then 'remark' else {_pick(_TYPES, 'k')} end as type, {_pick(_BASES, 'k')} as basis, left(excerpt, 80) as text,
        case when k % 6 = 0 then [evidence_id, 'e-f'] else [evidence_id] end as refs from evidence where source = 'body'""",
    "refs": "select book_id, page_index, statement_id, pos - 1 as pos, refs[pos] as evidence_id from (select *, unnest(range(1, len(refs) + 1)) as pos from statements)",
    "relations": f"select book_id, page_index, k as pos, statement_id as src, 's-' || (k + 3)::varchar as dst, {_pick(_RELATIONS, 'k')} as rel_type from statements",
    "flagged": f"""select e.*, case when kind <> 'text' then true else contains(coalesce(case when source = 'body' then body_norm else foot_norm end, ''), {_norm('excerpt')}) end as anchored
        from evidence e left join (select book_id, page_index, body_norm, foot_norm from norm) using (book_id, page_index)""",
    "kept_refs": "select r.* from refs r semi join (select * from flagged where anchored) a using (book_id, page_index, evidence_id)",
    "kept": "select s.book_id, s.page_index, s.statement_id, s.k, s.doc_id, s.type, s.basis, s.text, list(r.evidence_id order by r.pos) as refs from statements s join kept_refs r using (book_id, page_index, statement_id) group by all",
    "kept_evidence": "select * from flagged semi join kept_refs using (book_id, page_index, evidence_id) where anchored",
    "kept_relations": "select r.* from relations r semi join (select book_id, page_index, statement_id as src from kept) a using (book_id, page_index, src) semi join (select book_id, page_index, statement_id as dst from kept) b using (book_id, page_index, dst)",
    "dropped": """select book_id, page_index, 'evidence' as kind, evidence_id as id, 'quote not found on page' as reason from flagged where not anchored
        union all select book_id, page_index, 'statement', statement_id, 'ungrounded after anchor gate' from statements anti join kept using (book_id, page_index, statement_id)""",
    "page_terms": "select book_id, page_index, 't-' || k::varchar as term_id from statements where k % 5 = 0",
    "all_relations": "select book_id, page_index, src, dst from relations union all select book_id, page_index, statement_id, 't-' || (k - k % 5)::varchar from statements where k % 4 = 0",
    "ref_problems": """select book_id, page_index, 'missing evidence' as rule, statement_id as item, evidence_id as detail from refs anti join evidence using (book_id, page_index, evidence_id)
        union all select book_id, page_index, 'unknown endpoint', item, detail from (select book_id, page_index, src as item, src as detail from all_relations union all select book_id, page_index, src, dst from all_relations) x
        anti join (select book_id, page_index, statement_id as detail from statements union all select book_id, page_index, term_id from page_terms) y using (book_id, page_index, detail)
        union all select book_id, page_index, 'missing term', statement_id, term_id from (select book_id, page_index, statement_id, 't-' || (k - k % 5)::varchar as term_id from statements) anti join page_terms using (book_id, page_index, term_id)""",
    "schema_problems": "select book_id, page_index, 'type' as rule, statement_id as item, type as detail from statements where type = 'remark'",
    "untraced": f"""select e.book_id, e.page_index, case when n.book_id is null then 'missing page' else 'not found' end as rule, e.evidence_id as item, e.cited::varchar as detail
        from (select *, coalesce(page_override, page_index) as cited from evidence where kind = 'text') e left join norm n on n.book_id = e.book_id and n.page_index = e.cited
        where n.book_id is null or not contains(coalesce(case when e.source = 'body' then n.body_norm else n.foot_norm end, ''), {_norm('e.excerpt')})""",
    "floor_page": """select book_id, page_index, count(*) filter (what = 'st') as statements_total, count(*) filter (what = 'gr') as statements_grounded, count(*) filter (what = 'ex') as excerpts_total,
        greatest(count(*) filter (what = 'ex') - count(*) filter (what = 'un'), 0) as excerpts_anchored, count(*) filter (what = 're') as referential_problems, count(*) filter (what = 'sc') as schema_problems
        from (select book_id, page_index, 'st' as what from statements union all select book_id, page_index, 'gr' from statements where len(refs) > 0 union all select book_id, page_index, 'ex' from evidence where kind = 'text'
        union all select book_id, page_index, 'un' from untraced union all select book_id, page_index, 're' from ref_problems union all select book_id, page_index, 'sc' from schema_problems) group by all""",
    "present": "select distinct book_id, page_index from statements where doc_id % 19 <> 0",
    "expected": "select p.book_id, p.page_index, l.q = 1 as expected_notes from page_no p left join (select doc_id, max(quality) as q from labels group by doc_id) l using (doc_id)",
    "book_pages_list": """select book_id, bool_or(expected_notes is not null) as marked, coalesce(list(page_index order by page_index) filter (expected_notes), []) as want, coalesce(list(page_index order by page_index) filter (is_present), []) as had
        from (select book_id, page_index, expected_notes, p.page_index is not null as is_present from expected e left join (select *, page_index as pi from present) p using (book_id, page_index)) group by book_id""",
    "floor_book": """select b.book_id, coalesce(s.statements_total, 0) as statements_total, coalesce(s.statements_grounded, 0) as statements_grounded, coalesce(s.excerpts_total, 0) as excerpts_total, coalesce(s.excerpts_anchored, 0) as excerpts_anchored,
        coalesce(s.referential_problems, 0) as referential_problems, coalesce(s.schema_problems, 0) as schema_problems, len(w) as pages_expected, len(list_intersect(w, had)) as pages_present,
        array_to_string(w, ',') as expected_pages, array_to_string(had, ',') as present_pages, array_to_string(list_sort(list_filter(w, lambda x: not list_contains(had, x))), ',') as missing_pages
        from (select book_id, had, case when marked then want else had end as w from book_pages_list) b left join (select book_id, sum(statements_total)::bigint as statements_total, sum(statements_grounded)::bigint as statements_grounded, sum(excerpts_total)::bigint as excerpts_total,
        sum(excerpts_anchored)::bigint as excerpts_anchored, sum(referential_problems)::bigint as referential_problems, sum(schema_problems)::bigint as schema_problems from floor_page semi join present using (book_id, page_index) group by book_id) s using (book_id)""",
    "generation": "select book_id, page_index, case when doc_id % 23 = 0 and doc_id % 20 = 7 then null else 'm-mid|' || case when doc_id % 20 % 5 = 0 and page_index % 2 = 1 then 'high' else 'low' end || '|' || '8000' end as setting from page_no",
    "generation_book": """select book_id, setting, case when setting = 'mixed' then array_to_string(case when unk then list_append(settings, 'unknown') else settings end, ',') end as distinct_settings from (select book_id, settings, unk,
        case when len(settings) = 0 then 'unknown' when len(settings) = 1 and not unk then settings[1] else 'mixed' end as setting
        from (select book_id, coalesce(list_sort(list_distinct(list(setting) filter (setting is not null))), []) as settings, bool_or(setting is null) as unk from generation group by book_id))""",
    "streams": "select book_id, page_index, 'body' as stream, body_norm as norm from norm union all select book_id, page_index, 'footnote', foot_norm from norm",
    "covered_spans": f"""select distinct book_id, page_index, stream, strpos(norm, q) - 1 as a, strpos(norm, q) - 1 + length(q) as b from (select book_id, page_index, source as stream, {_norm('excerpt')} as q from evidence where kind = 'text') e
        join streams using (book_id, page_index, stream) where q <> '' and strpos(norm, q) > 0""",
    "intervals": """select book_id, page_index, stream, min(a) as start_at, max(b) as end_at from (select *, sum(new) over (partition by book_id, page_index, stream order by a, b rows unbounded preceding) as island
        from (select *, case when r is null or a > r then 1 else 0 end as new from (select *, max(b) over (partition by book_id, page_index, stream order by a, b rows between unbounded preceding and 1 preceding) as r from covered_spans))) group by book_id, page_index, stream, island""",
    "coverage": """select s.book_id, s.page_index, s.stream, length(norm)::bigint as total_chars, coalesce(c, 0)::bigint as covered_chars, case when length(norm) = 0 then 1.0::double else printf('%.3f', coalesce(c, 0)::double / length(norm))::double end as ratio
        from streams s left join (select book_id, page_index, stream, sum(end_at - start_at) as c from intervals group by all) using (book_id, page_index, stream)""",
    "places": """select *, a + length(sent) as b from (select *, coalesce(sum(length(sent) + 1) over (partition by book_id, page_index, stream order by sent_no rows between unbounded preceding and 1 preceding), 0) as a
        from (select book_id, page_index, stream, n - 1 as sent_no, s[n] as sent from (select *, unnest(range(1, len(s) + 1)) as n from (select book_id, page_index, stream,
        string_split(regexp_replace(norm, '([.!?]) ([A-Z''"(])', '\\1' || chr(10) || '\\2', 'g'), chr(10)) as s from streams where norm <> ''))))""",
    "gaps": """select book_id, page_index, stream, sent_no, text, printf('%.2f', coverage)::double as coverage from (select p.book_id, p.page_index, p.stream, p.sent_no, p.sent as text, coalesce(sum(greatest(0, least(p.b, i.end_at) - greatest(p.a, i.start_at))) filter (i.start_at is not null), 0)::double / (p.b - p.a) as coverage
        from places p left join intervals i using (book_id, page_index, stream) where length(p.sent) >= 15 group by p.book_id, p.page_index, p.stream, p.sent_no, p.sent, p.a, p.b) where coverage < 0.5""",
    "hdr": """select book_id, top_line, count(*) as n, min(page_index) as f from heads where top_line <> '' group by all having count(*) >= 2 or
        (length(regexp_replace(top_line, '[^\\pL]', '', 'g')) >= 4 and 5 * length(regexp_replace(top_line, '[^\\p{Lu}]', '', 'g')) >= 4 * length(regexp_replace(top_line, '[^\\pL]', '', 'g')))""",
    "titles": "select book_id, top_line as title from (select *, row_number() over (partition by book_id order by n desc, f) as r from (select book_id, top_line, count(*) as n, min(page_index) as f from heads where top_line <> '' group by all)) where r = 1",
    "grouped": """select book_id, page_index, header, chapter_key, sum(new) over (partition by book_id order by page_index rows unbounded preceding)::bigint as chapter_no from (select *, case when lag(chapter_key) over w is null or lag(chapter_key) over w <> chapter_key then 1 else 0 end as new
        from (select *, coalesce(last_value(own_key ignore nulls) over (partition by book_id order by page_index rows unbounded preceding), 'FRONT-MATTER') as chapter_key from (select book_id, page_index, header,
        case when regexp_matches(header, '^CHAPTER\\s+([0-9]+|[IVXLCDM]+)\\b') then 'CHAPTER ' || regexp_extract(header, '^CHAPTER\\s+([0-9]+|[IVXLCDM]+)\\b', 1) else header end as own_key
        from (select h.book_id, h.page_index, case when r.top_line is not null and h.top_line <> t.title then h.top_line end as header from heads h left join hdr r using (book_id, top_line) left join titles t using (book_id)))) window w as (partition by book_id order by page_index))""",
    "chapters": """select book_id, chapter_no, chapter_key, coalesce(first(header order by case when header is null then 2 when contains(header, ':') then 0 else 1 end, length(header) desc, page_index), 'Front matter') as title, list(page_index order by page_index) as pages from grouped group by book_id, chapter_no, chapter_key""",
    "sections": """select book_id, unnest(pages) as page_index, chapter_no, title, not (starts_with(upper(title), 'TABLE ') or starts_with(upper(title), 'INDEX ') or starts_with(upper(title), 'FIGURE')) and upper(title) not in ('FRONT MATTER', 'BIBLIOGRAPHY') as prose from chapters""",
    "cited": f"""select distinct r.book_id, 'p' || r.page_index::varchar || ':' || r.statement_id as key, r.page_index, s.type, e.quote from refs r join (select book_id, page_index, evidence_id, {_norm('excerpt')} as quote from evidence) e using (book_id, page_index, evidence_id)
        join statements s using (book_id, page_index, statement_id) where length(e.quote) >= 25""",
    "edges": """select distinct book_id || '/' || key as u, v from cited join (select book_id, type, quote, min(book_id || '/' || key) as v from cited group by all having count(*) > 1) f using (book_id, type, quote) where book_id || '/' || key <> v""",
    "labels_v": """select book_id, chapter_no, place, label from (select book_id, chapter_no, word as label, row_number() over (partition by book_id, chapter_no order by count(*) desc, word) as place
        from (select s.book_id, c.chapter_no, unnest(regexp_extract_all(lower(s.text), '[a-z]{5,}')) as word from statements s join sections c using (book_id, page_index) where c.prose) group by book_id, chapter_no, word)""",
    "store": f"""select book_id, term_id, label, key, n_chapters, row_number() over (partition by book_id order by n_chapters desc, key) as place from (select *, row_number() over (partition by book_id, term_id order by n_chapters desc, key) as r
        from (select book_id, key, count(*) as n_chapters, first(label order by chapter_no, place) as label, 't-' || first(label order by chapter_no, place) as term_id from (select *, {singular('label')} as key from labels_v) group by book_id, key)) where r = 1""",
    "words_of": f"""select book_id, page_index, statement_id, array_to_string(list_transform(list_filter(string_split_regex(lower(text), '[\\s\\pZ]+'), lambda w: w <> ''), lambda w: {singular('w')}), ' ') as words from statements""",
    "links": "select w.book_id, w.page_index, w.statement_id, s.term_id, s.place from words_of w join store s on w.book_id = s.book_id and contains(w.words, s.key)",
    "candidates": """select distinct i.book_id, i.chapter_no, i.page_index, i.statement_id from (select l.*, c.chapter_no from links l join sections c using (book_id, page_index) where c.prose) i
        semi join (select l.book_id, c.chapter_no, l.term_id from links l join sections c using (book_id, page_index) where c.prose group by all having count(*) between 2 and 12 and count(distinct l.page_index) >= 2) t using (book_id, chapter_no, term_id)""",
    "proposed": f"""select book_id, chapter_no, src, dst, rel_type, place from (select book_id, chapter_no, key as src, lead(key) over w as dst, row_number() over w as place, {_pick(_RELATIONS, 'row_number() over w')} as rel_type
        from (select book_id, chapter_no, page_index, statement_id, 'p' || page_index::varchar || ':' || statement_id as key from candidates) window w as (partition by book_id, chapter_no order by page_index, statement_id)) where dst is not null""",
    "accepted": "select book_id, min(chapter_no) as chapter_no, src, dst, rel_type, min(place) as place from proposed where regexp_extract(src, '^p([0-9]+):', 1) <> regexp_extract(dst, '^p([0-9]+):', 1) group by book_id, src, dst, rel_type",
    "reach": """select node, min(other) as cluster from (with recursive r(node, other) as (select u, v from edges union select v, u from edges union select r.node, x.b from r join (select u as a, v as b from edges union select v, u from edges) x on r.other = x.a) select node, least(node, other) as other from r) group by node""",
    "merges": """select book_id, merge_no, key, text, member_no from (select m.*, first_value(s.text) over (partition by m.merge_no order by m.member_no) as text from (select split_part(cluster, '/', 1) as book_id, split_part(node, '/', 2) as key, cluster as merge_no,
        row_number() over (partition by cluster order by regexp_extract(node, '/p([0-9]+):', 1)::int, node) as member_no, count(*) over (partition by cluster) as size from reach) m join (select book_id, 'p' || page_index::varchar || ':' || statement_id as key, text from statements) s using (book_id, key))""",
    "own": "select k.*, c.chapter_no, 'p' || k.page_index::varchar || ':' || k.statement_id as key from kept k join sections c using (book_id, page_index)",
    "member_merge": """select * from (select o.book_id, o.chapter_no, o.key, m.merge_no, m.member_no, m.text as merge_text, count(*) over (partition by o.book_id, o.chapter_no, m.merge_no) as n from own o join merges m using (book_id, key)) where n >= 2""",
    "unit_rows": "select o.*, m.merge_no, coalesce(m.member_no, 0) as member_no, m.merge_text, coalesce('m' || m.merge_no, o.key) as unit from own o left join member_merge m using (book_id, chapter_no, key)",
    "finals": """select book_id, chapter_no, unit, row_number() over (partition by book_id, chapter_no order by pg, st) as final_no, type, basis, text from (select book_id, chapter_no, unit, min(page_index) as pg, first(statement_id order by page_index, statement_id) as st,
        first(type order by member_no) as type, first(basis order by member_no) as basis, coalesce(any_value(merge_text), first(text)) as text from unit_rows group by book_id, chapter_no, unit)""",
    "members": "select u.book_id, u.chapter_no, u.page_index, u.statement_id, u.key, f.final_no, u.member_no, u.refs from unit_rows u join finals f using (book_id, chapter_no, unit)",
    "used": """select m.book_id, m.chapter_no, m.page_index, m.final_no, m.member_no, m.pos, m.evidence_id, e.kind, e.source, e.excerpt, e.locator, e.script, e.caption, e.excerpt_translation from (select *, refs[n] as evidence_id, n - 1 as pos from (select *, unnest(range(1, len(refs) + 1)) as n from members)) m
        join kept_evidence e using (book_id, page_index, evidence_id)""",
    "records": """select book_id, chapter_no, page_index, evidence_id, kind, source, excerpt, locator, script, caption, excerpt_translation, row_number() over (partition by book_id, chapter_no order by f, m, p) as evidence_no from (select *, final_no as f, member_no as m, pos as p,
        row_number() over (partition by book_id, chapter_no, page_index, evidence_id order by final_no, member_no, pos) as r from used) where r = 1""",
    "final_terms": "select m.book_id, m.chapter_no, m.final_no, list_sort(list_distinct(list(l.term_id))) as terms from members m join links l using (book_id, page_index, statement_id) group by all",
    "final_relations": """select book_id, chapter_no, row_number() over (partition by book_id, chapter_no order by part, pg, pos, src_no, dst_no, rel_type) as rel_no, src_no, dst_no, rel_type from (select a.book_id, a.chapter_no, a.final_no as src_no, b.final_no as dst_no, r.rel_type, part, pg, r.pos,
        row_number() over (partition by a.book_id, a.chapter_no, a.final_no, b.final_no, r.rel_type order by part, pg, r.pos) as once from (select book_id, 'p' || page_index::varchar || ':' || src as src, 'p' || page_index::varchar || ':' || dst as dst, rel_type, 0 as part, page_index as pg, pos from kept_relations
        union all select book_id, src, dst, rel_type, 1, 0, place from accepted) r join members a on a.book_id = r.book_id and a.key = r.src join members b on b.book_id = r.book_id and b.key = r.dst and b.chapter_no = a.chapter_no where a.final_no <> b.final_no) where once = 1""",
    "osc": """select *, coalesce(min(chapter_no) filter (brk) over (partition by book_id order by chapter_no rows between 2 following and unbounded following) - 1, max(chapter_no) over (partition by book_id)) as last_no
        from (select *, chapter_key <> lag(chapter_key, 2) over (partition by book_id order by chapter_no) as brk from chapters)""",
    "walk": """select book_id, pos, nxt, row_number() over (partition by book_id order by pos) as number from (with recursive w(book_id, pos, nxt) as (select book_id, chapter_no, case when last_no - chapter_no >= 2 then last_no + 1 else chapter_no + 1 end from osc where chapter_no = 1
        union all select w.book_id, w.nxt, case when o.last_no - w.nxt >= 2 then o.last_no + 1 else w.nxt + 1 end from w join osc o on o.book_id = w.book_id and o.chapter_no = w.nxt) select * from w)""",
    "oscillating": """select w.book_id, w.number as chapter_no, first(o.chapter_key order by contains(o.chapter_key, ':') desc, case when contains(o.chapter_key, ':') then 0 else -len(o.pages) end, o.chapter_no) as chapter_key,
        first(o.title order by contains(o.chapter_key, ':') desc, case when contains(o.chapter_key, ':') then 0 else -len(o.pages) end, o.chapter_no) as title, array_to_string(flatten(list(o.pages order by o.chapter_no)), ',') as pages from walk w join osc o on o.book_id = w.book_id and o.chapter_no >= w.pos and o.chapter_no < w.nxt group by all""",
    "tokens": """select doc_id, n - 1 as word_no, tok, sum(length(tok) + 1) over (partition by doc_id order by n rows unbounded preceding) - length(tok) - 1 as c0, total, last_line
        from (select doc_id, toks[n] as tok, n, total, last_line from (select *, unnest(range(1, len(toks) + 1)) as n from (select doc_id, string_split_regex(text, '[ \\n]') as toks, length(text) as total, case when contains(text, chr(10)) then length(list_last(string_split(text, chr(10)))) else 0 end as last_line from documents)))""",
    "words": """select p.book_id, p.page_index, t.word_no, t.tok as text, (6 * ((c0 % 100) % 50) + 320 * ((c0 % 100) // 50))::double as x0, (6 * ((c0 % 100) % 50) + 320 * ((c0 % 100) // 50) + 6 * length(tok))::double as x1, (12 * (c0 // 100))::double as top, (12 * (c0 // 100) + 10)::double as bottom,
        case when last_line > 0 and c0 >= total - last_line then 7.0::double else 10.0::double end as size from tokens t join page_no p using (doc_id) where tok <> ''""",
    "sizes": "select p.book_id, p.page_index, 640 as width, (12 * (coalesce(length(d.text), 0) // 100 + 1)) as height from page_no p join documents d using (doc_id)",
    "line_rows": """select book_id, page_index, line_no, line_top, max(bottom) as line_bottom, median(size) as line_size, count(*) as n_words, trim(string_agg(text, ' ' order by x0, word_no)) as line_text
        from (select *, dense_rank() over (partition by book_id, page_index order by top) as line_no, top as line_top from words) group by book_id, page_index, line_no, line_top""",
    "body_sizes": "select book_id, page_index, median(size) as body_size from words group by all",
    "crossings": """select s.book_id, s.page_index, x.x, coalesce(c.n, 0) as n from (select book_id, page_index, unnest(range(0, 642)) as x from sizes) x join sizes s using (book_id, page_index)
        left join (select book_id, page_index, x, count(*) as n from (select book_id, page_index, unnest(range(x0::int, least(641, x1::int) + 1)) as x from words) group by book_id, page_index, x) c on c.book_id = s.book_id and c.page_index = s.page_index and c.x = x.x""",
    "gutters": """select s.book_id, s.page_index, g.gutter from sizes s left join (select book_id, page_index, arg_max(a + long / 2, long * 1000 - a) as gutter from (select book_id, page_index, min(x) as a, count(*) as long from (select *, x - row_number() over (partition by book_id, page_index order by x) as island
        from (select *, min(n) filter (x between 192 and 448) over (partition by book_id, page_index) as least_n, max(n) over (partition by book_id, page_index) as top_n from crossings) where x between 192 and 448 and n = least_n and top_n > 0 and least_n < 0.5 * top_n) group by book_id, page_index, island) group by book_id, page_index) g using (book_id, page_index)""",
    "column_words": "select w.*, case when gutter is not null and (x0 + x1) / 2 >= gutter then 1 else 0 end as column_no from words w join gutters using (book_id, page_index)",
    "column_lines": """select *, row_number() over (partition by book_id, page_index, column_no order by line_top desc) as r, coalesce(n_words = 1 and (regexp_matches(trim(line_text, '.'), '^[0-9]+$') or regexp_matches(lower(trim(line_text, '.')), '^[ivxlcdm]+$')), false) as label, line_size < 0.85 * body_size as small
        from (select book_id, page_index, column_no, top as line_top, median(size) as line_size, count(*) as n_words, trim(string_agg(text, ' ' order by x0, word_no)) as line_text from column_words group by all) join body_sizes using (book_id, page_index)""",
    "fn_tops": """select f.book_id, f.page_index, f.column_no, coalesce(found, s.height::double) as fn_top from (select book_id, page_index, column_no, min(line_top) filter (not label and small and (stop is null or r < stop)) as found
        from (select *, min(r) filter (not label and not small) over (partition by book_id, page_index, column_no) as stop from column_lines) group by all) f join sizes s using (book_id, page_index)""",
    "shapes_v": "select book_id, page_index, word_no, word_no * 2 + k as shape_no, x0 - 5 + k as x0, x0 - 3 + k as x1, top + 2 as top, top + 6 as bottom from words cross join (values (0), (1)) v(k) where word_no % 6 = 1",
    "gaps_v": "select * from (select book_id, page_index, word_no as gap_no, top as row_top, x0 as right_x, lag(x1) over (partition by book_id, page_index, top order by x0, word_no) as left_x from words) where right_x - left_x > 2",
    "gap_shapes": "select g.book_id, g.page_index, g.gap_no, s.shape_no from gaps_v g join shapes_v s on s.book_id = g.book_id and s.page_index = g.page_index and s.top - 2 = g.row_top and (s.x0 + s.x1) / 2 > left_x - 1 and (s.x0 + s.x1) / 2 < right_x + 1",
    "gap_points": "select book_id, page_index, gap_no, p.x, p.y from (select g.book_id, g.page_index, g.gap_no, unnest([{x: s.x0, y: s.top}, {x: s.x1, y: s.top + s.word_no % 3}, {x: s.x0 + 1, y: s.bottom}]) as p from gap_shapes g join shapes_v s using (book_id, page_index, shape_no) where s.word_no % 4 <> 3)",
    "gap_scaled": "select book_id, page_index, gap_no, round_even((x - mx) / span * 1000, 0)::bigint as sx, round_even((y - my) / span * 1000, 0)::bigint as sy from (select *, min(x) over w as mx, min(y) over w as my, case when greatest(max(x) over w - min(x) over w, max(y) over w - min(y) over w) = 0 then 1.0 else greatest(max(x) over w - min(x) over w, max(y) over w - min(y) over w) end as span from gap_points window w as (partition by book_id, page_index, gap_no))",
    "glyphs": """select distinct book_id, page_index, gap_no, coalesce(glyph_id, '00000000') as glyph_id from gap_shapes left join
        (select book_id, page_index, gap_no, left(sha1('[' || string_agg('(' || sx::varchar || ', ' || sy::varchar || ')', ', ' order by sx, sy) || ']'), 8) as glyph_id from gap_scaled group by all) using (book_id, page_index, gap_no)""",
    "usage_v": """select conv_id, ['m-small', 'm-mid', 'm-large', 'm-other'][conv_id % 4 + 1] as model, i as input_tokens, o as output_tokens, i // 2 as cache_create, i // 8 as cache_1h, i // 3 as cache_read
        from (select conv_id, coalesce(sum(length(text)) filter (role = 'user'), 0)::bigint as i, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as o from conversations group by conv_id)""",
    "prices_v": "select * from (values ('m-small', 1.0::double, 5.0::double, 1.25::double, 2.0::double, 0.1::double), ('m-mid', 3.0, 15.0, 3.75, 6.0, 0.3), ('m-large', 5.0, 25.0, 6.25, 10.0, 0.5)) p(model, p_input, p_output, p_write_5m, p_write_1h, p_read)",
    "costs": "select u.*, (input_tokens::double * p_input + output_tokens::double * p_output + greatest(cache_create::double - cache_1h::double, 0.0) * p_write_5m + cache_1h::double * p_write_1h + cache_read::double * p_read) / 1000000 as cost from usage_v u left join prices_v using (model)",
    "outlines": "select book_id, string_agg(case when prose then '## ' else '### ' end || chapter_no::varchar || '. ' || title, chr(10) order by chapter_no) as text from (select distinct book_id, chapter_no, title, prose from sections) group by book_id",
    "spec_v": "select * from (values ('a', '14'), ('b', '14-18'), ('c', '14,16'), ('d', ' 3 , 2-4'), ('e', 'x,5'), ('f', '9-7'), ('g', '0-2'), ('h', '')) s(spec_id, spec)",
}


def sql(final: str) -> str:
    """A query with the views it needs, and those that these need, before it."""
    need: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in need and re.search(rf"(?<![\w.']){name}(?![\w'])", text):
                need.add(name)
                todo.append(body)
    return "with " + ", ".join(f"{name} as ({body})" for name, body in VIEWS.items() if name in need) + " " + final if need else final
