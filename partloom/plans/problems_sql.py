"""The same answers as plans.problems in plain SQL, for the queries that SQL can express."""

from __future__ import annotations


def key(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


_LINKS = f"""links as (
  select distinct p, c from (select {key('parent_part_key')} p, {key('child_part_key')} c from fact_bom_relationship) where p is not null and c is not null)"""

_BELOW = f"""{_LINKS},
roots as (select distinct p from links where p <> c and p not in (select c from links where p <> c)),
front(root, part, lvl) using key (root, part) as (
  select p, p, 0 from roots
  union
  select f.root, l.c, min(f.lvl) + 1 from front f join links l on l.p = f.part left join recurring.front r on r.root = f.root and r.part = l.c where r.part is null group by f.root, l.c)"""

P2 = f"""
with recursive {_BELOW},
reach(a, b) as (select p, c from links union select r.a, l.c from reach r join links l on l.p = r.b),
mutual as (select x.a, least(min(x.b), x.a) g from reach x join reach y on x.a = y.b and x.b = y.a group by x.a)
select 'below_root' kind, root root_part_key, part part_key, cast(lvl as bigint) n_levels from front where lvl > 0
union all
select 'on_cycle', g, a, cast(0 as bigint) from mutual
"""

P2_PATHS = f"""
with recursive {_BELOW},
ways(root, part, lvl, path) as (
  select p, p, 0, [p] from roots
  union all
  select w.root, l.c, w.lvl + 1, list_append(w.path, l.c) from ways w join links l on l.p = w.part join front f on f.root = w.root and f.part = l.c and f.lvl = w.lvl + 1)
select root, part, cast(lvl as bigint) as "level", array_to_string(min(path), '>') as path from ways group by root, part, lvl
"""

P4 = f"""
with refs as (
  select 'fact_bom_relationship' table_name, bom_rel_key record_key, 'parent_part_key' field_name, {key('parent_part_key')} k, min(_ingested_at) over (partition by bom_rel_key) seen from fact_bom_relationship
  union all
  select 'fact_bom_relationship', bom_rel_key, 'child_part_key', {key('child_part_key')}, min(_ingested_at) over (partition by bom_rel_key) from fact_bom_relationship
  union all
  select 'supplier_parts', supplier_part_id, 'part_id', {key('part_id')}, min(_ingested_at) over (partition by supplier_part_id) from supplier_parts),
parts as (select {key('part_id')} k, min(_ingested_at) first_seen, arg_max({key('_load_status')}, _ingested_at) status from part_master group by 1),
judged as (
  select r.table_name, r.record_key, r.field_name, strftime(seen, '%Y-%m') ref_month,
    case when p.k is null then 'missing' when p.status = 'DELETED' then 'deleted' when p.first_seen > r.seen then 'late' end kind
  from refs r left join parts p on p.k = r.k where r.k is not null)
select distinct * from judged where kind is not null
"""

P4_REPORT = P4.replace("select r.table_name,", "select distinct r.k, r.table_name,").replace(
    "select distinct * from judged where kind is not null",
    "select table_name, field_name, ref_month, kind, count(*) n_refs, count(distinct k) n_keys from judged where kind is not null group by all",
)

P5 = f"""
with kept as (
  select *, row_number() over (partition by _source_system_file, load_no, {key('part_key')} order by _ingested_at desc, description desc, category desc, lead_time_days desc) rn from dim_part),
base as (
  select _source_system_file feed, cast(load_no as bigint) load_no,
    case when {key('description')} is not null then description end d, case when {key('category')} is not null then category end c, lead_time_days t
  from kept where rn = 1),
stats as (
  select feed, load_no, 'description' column_name, avg((d is null)::int) nulls,
    avg((d is not null and not regexp_full_match(d, '[A-Z0-9]+([ ./-][A-Z0-9]+)*'))::int) bad, count(distinct d) / count(*) dist, coalesce(avg(length(d)), 0) centre from base group by all
  union all
  select feed, load_no, 'category', avg((c is null)::int), avg((c is not null and c not in (select category_code from product_category))::int), count(distinct c) / count(*), null from base group by all
  union all
  select feed, load_no, 'lead_time_days', avg((t is null)::int), avg((t is not null and not t between 1 and 365)::int), count(distinct t) / count(*), coalesce(median(t) filter (t between 1 and 365), 0) from base group by all),
shares as (
  select feed, load_no, category_code, coalesce(count(*) filter (c = category_code) / nullif(count(*) filter (c in (select category_code from product_category)), 0), 0) s
  from base cross join product_category group by all),
shares2 as (select l.feed, l.load_no, l.category_code, coalesce(s.x, 0) s from shares l left join (
    select feed, load_no, c category_code, count(*) / sum(count(*)) over (partition by feed, load_no) x from base where c in (select category_code from product_category) group by feed, load_no, c) s using (feed, load_no, category_code)),
mix as (select feed, load_no, sum(abs(s - m)) / 2 mix from (select *, median(s) over (partition by feed, category_code) m from shares2) group by all),
cmp as (
  select s.*, case when column_name = 'category' then x.mix end mix,
    median(nulls) over w nm, median(bad) over w bm, median(dist) over w dm, median(centre) over w cm
  from stats s left join mix x using (feed, load_no) window w as (partition by feed, column_name))
select feed, load_no, column_name, 'nulls' finding from cmp where abs(nulls - nm) > 0.103
union all select feed, load_no, column_name, 'pattern' from cmp where bad - bm > 0.103
union all select feed, load_no, column_name, 'distinct' from cmp where dist < 0.49 * dm
union all select feed, load_no, column_name, 'shift' from cmp where centre > 1.47 * cm or centre < cm / 1.47 or mix > 0.303
"""

_OBS = f"""obs as (
  select 'standard_cost' field_name, {key('part_id')} part_id, {key('plant_code')} plant_code, effective_from d, cast(standard_cost as varchar) v, _ingested_at t from standard_cost_history where standard_cost is not null
  union all
  select 'lifecycle_status', {key('part_id')}, '*', snapshot_date, {key('lifecycle_status')}, _ingested_at from part_master_snapshot where {key('lifecycle_status')} is not null),
days as (select field_name, part_id, plant_code, d, arg_max(v, t) v from obs where part_id is not null and d is not null group by all),
marked as (select *, v is distinct from lag(v) over (partition by field_name, part_id, plant_code order by d) starts from days)"""

P7 = f"with {_OBS} select field_name, part_id, plant_code, strftime(d, '%Y-%m-%d') valid_from from marked where starts"

P7_VERSIONS = f"""
with {_OBS},
runs as (select *, count(*) filter (starts) over (partition by field_name, part_id, plant_code order by d) run from marked),
vers as (select field_name, part_id, plant_code, run, min(d) valid_from, count(*) n_rows from runs group by all)
select field_name, part_id, plant_code, cast(valid_from as date) valid_from, cast(lead(valid_from) over (partition by field_name, part_id, plant_code order by run) - interval 1 day as date) valid_to, n_rows from vers
"""

ORACLES = {"p2_found": P2, "p2_paths": P2_PATHS, "p4_found": P4, "p4_report": P4_REPORT, "p5_found": P5, "p7_found": P7, "p7_versions": P7_VERSIONS}
