"""The same answers as llm.queries in plain SQL, for the queries that SQL can express."""

from __future__ import annotations


def _key(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


def _source(c: str) -> str:
    return f"nullif(regexp_replace(upper({c}), '[\\s_-]', '', 'g'), '')"


_FILLERS = "('N/A','NA','N.A.','#N/A','TBD','TBC','TBA','NONE','NULL','NIL','UNKNOWN','NOT AVAILABLE','NOT APPLICABLE','TO BE DEFINED','TO BE CONFIRMED','DUMMY','UNDEFINED','SEE DWG','SEE DRAWING')"


def _text(c: str) -> str:
    return f"({_key(c)} is not null and regexp_matches({_key(c)}, '[\\p{{L}}\\p{{N}}]') and {_key(c)} not in {_FILLERS} and not regexp_full_match({_key(c)}, 'X{{2,}}'))"


def _number(c: str) -> str:
    return f"({c} > 0 and {c} is not null and not (regexp_full_match(cast(cast(floor({c}) as bigint) as varchar), '9{{4,}}') and ({c} = floor({c}) or {c} - floor({c}) > 0.89)))"


_FIELDS = {f: _text(f) for f in ("source_part_number", "description", "category", "uom", "lifecycle_status", "manufacturer_part_number", "primary_plant")} | {f: _number(f) for f in ("standard_cost", "lead_time_days")}

P1 = (
    "with long as (" + " union all ".join(f"select entity_id, '{f}' field_name, {_key('part_id')} part_id, {_source('source_system')} s, last_updated u from golden_record_member where entity_id is not null and part_id is not null and {ok}" for f, ok in _FIELDS.items())
    + f"), ranked as (select l.*, row_number() over (partition by entity_id, field_name order by coalesce(t.reliability, -1) desc, coalesce(u, date '0001-01-01') desc, part_id) rn from long l left join (select {_source('source_system')} s, max(reliability) reliability from source_trust group by 1) t using (s)) select entity_id, field_name, part_id from ranked where rn = 1"
)

_P6 = f"""
with recursive last as (
  select least(a, b) a, greatest(a, b) b, arg_max({_key('band')}, scored_at) band
  from (select {_key('part_id_a')} a, {_key('part_id_b')} b, scored_at, coalesce({_key('band')}, 'UNRESOLVED') band from match_candidate) where a <> b group by 1, 2),
links as (select a, b from last where band <> 'UNRESOLVED' union select b, a from last where band <> 'UNRESOLVED'),
reach(part_id, other) as (select a, a from links union select r.part_id, l.b from reach r join links l on l.a = r.other),
groups as (select min(other) group_id, part_id from reach group by part_id)
"""
P6 = _P6 + "select group_id, part_id from groups"
P6_SIZES = _P6 + "select n_parts, count(*) n_groups from (select group_id, count(*) n_parts from groups group by 1) group by 1"

# invisible format characters, and words: runs of letters and digits in lower case without accents
_FORMAT = "[\\p{Cf}\\x{034F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{FE00}-\\x{FE0F}]"


def _words(c: str) -> str:
    return f"regexp_extract_all(lower(strip_accents(regexp_replace({c}, '{_FORMAT}', '', 'g'))), '[\\pL\\pN]+')"


P9 = f"""
with items as (select item_id, row_number() over () k, {_words('passage')} w from (select distinct item_id, passage from eval_item where item_id is not null and passage is not null)),
docs as (select doc_id, {_words('text')} w from (select distinct doc_id, text from documents where doc_id is not null and text is not null)),
iw as (select item_id, k, len(w) n, s, array_to_string(w[s:s + 4], ' ') g from (select *, unnest(generate_series(1, len(w) - 4)) s from items where len(w) > 4)),
dw as (select distinct doc_id, array_to_string(w[s:s + 4], ' ') g from (select *, unnest(generate_series(1, len(w) - 4)) s from docs where len(w) > 4)),
covered as (select distinct item_id, k, n, doc_id, unnest(generate_series(s, s + 4)) pos from iw join dw using (g))
select distinct item_id, doc_id from (select item_id, k, n, doc_id, count(*) c from covered group by all) where 2 * c >= n
"""

_P10 = """
with d as (select distinct doc_id, text from documents where doc_id is not null and length(text) >= 200),
w as (select doc_id, i, substring(text, i, 200) x from (select doc_id, text, unnest(generate_series(1, length(text) - 199)) i from d)),
twice as (select x from w group by x having count(distinct doc_id) > 1),
"""
P10 = _P10 + "hit as (select distinct doc_id from w where x in (select x from twice)) select doc_id from hit"
P10_SPANS = _P10 + """
starts as (select distinct doc_id, i from w where x in (select x from twice)),
runs as (select *, sum(fresh) over (partition by doc_id order by i) run from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end fresh from starts)),
spans as (select doc_id, run, min(i) - 1 lo, max(i) - min(i) + 200 len from runs group by doc_id, run),
per as (select doc_id, sum(len) n, count(*) k, string_agg('{"start":' || lo || ',"length":' || len || '}', ',' order by lo) js from spans group by doc_id),
sizes as (select doc_id, max(length(text)) n_chars from documents where doc_id is not null group by doc_id)
select doc_id, n_chars, cast(case when n_chars is not null then coalesce(n, 0) end as bigint) n_shared, case when n_chars > 0 then coalesce(n, 0) / n_chars when n_chars = 0 then 0.0 end as share, cast(coalesce(k, 0) as int) n_spans, '[' || coalesce(js, '') || ']' spans from sizes left join per using (doc_id)
"""

ORACLES = {"p1_found": P1, "p6_found": P6, "p6_sizes": P6_SIZES, "p9_found": P9, "p10_found": P10, "p10_spans": P10_SPANS}
