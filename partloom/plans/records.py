"""Queries on duplicate parts, survivorship, offers and proposals, each with the same in SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import documents, resolve, staging, survivorship
from partloom.plans.core_sql import issues_sql, with_tables
from partloom.plans.quality import issues_of
from partloom.session import Cuts, shuffles_dropped
from partloom.sources.binding import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, parts: dict[str, str] | None = None) -> None:
    QUERIES[name] = lambda spark, d: build(Tables(spark, d))
    if sql is not None:
        ORACLES[name] = with_tables(sql, parts)


# duplicate parts
_ALNUM = "regexp_replace(upper(coalesce({}, '')), '[^A-Z0-9]', '', 'g')"
_TEXT = "array_to_string(list_transform(string_split(trim(regexp_replace(upper(coalesce(description, '')), '\\s+', ' ', 'g')), ' '), lambda w: case w when 'SS' then 'STAINLESS' when 'ALUM' then 'ALUMINUM' when 'MFG' then 'MANUFACTURING' when 'INCORPORATED' then 'INC' when 'CORPORATION' then 'CORP' else w end), ' ')"
_ER = {
    "prep": f"""select *, list_distinct(list_filter(string_split(replace(txt, '-', ' '), ' '), lambda w: w <> '')) toks from (select part_key, coalesce(source_part_number, '') pn, {_ALNUM.format('source_part_number')} pn_norm, {_ALNUM.format('manufacturer_part_number')} mpn, {_TEXT} txt,
        coalesce(uom, '') uom, coalesce(category, '') category, cast(standard_cost as double) cost, cast(lead_time_days as double) lead_, coalesce(source_system, '') source from dim_part)""",
    "blocks": """select 'n:' || left(pn_norm, 6) block, part_key from prep where length(pn_norm) >= 6 union all select 'm:' || mpn, part_key from prep where mpn <> '' union all select 'c:' || category || '|' || list_min(toks), part_key from prep where len(toks) > 0 and category <> ''""",
    "cand": "select distinct x.part_key a, y.part_key b from blocks x join blocks y on x.block = y.block and x.part_key < y.part_key where x.block in (select block from blocks group by 1 having count(*) between 2 and 200)",
    "feat": """select a, b, cast(x.pn = y.pn and x.pn <> '' as double) part_number_exact, cast(x.pn_norm = y.pn_norm and x.pn_norm <> '' as double) part_number_normalized_match,
        case when len(x.toks) > 0 and len(y.toks) > 0 then len(list_intersect(x.toks, y.toks)) / len(list_distinct(list_concat(x.toks, y.toks))) else 0 end description_token_jaccard, cast(x.mpn = y.mpn and x.mpn <> '' as double) mpn_match,
        cast(x.uom = y.uom or x.uom = '' or y.uom = '' as double) uom_compatible, cast(x.category = y.category as double) category_match,
        case when x.cost is null or y.cost is null then 0 when greatest(abs(x.cost), abs(y.cost)) = 0 then 1 else least(abs(x.cost), abs(y.cost)) / greatest(abs(x.cost), abs(y.cost)) end cost_proximity, cast(x.source <> y.source as double) source_system_differs,
        case when x.lead_ is null or y.lead_ is null then 0 when greatest(abs(x.lead_), abs(y.lead_)) = 0 then 1 else least(abs(x.lead_), abs(y.lead_)) / greatest(abs(x.lead_), abs(y.lead_)) end lead_time_proximity
        from cand join prep x on x.part_key = a join prep y on y.part_key = b""",
}


def _prepared(t: Tables) -> DataFrame:
    return Cuts(t.spark, "resolve").write(resolve.prepared(t.dim_part))[0]


def _features(t: Tables) -> DataFrame:
    p = _prepared(t)
    return resolve.features(resolve.candidate_pairs(p), p)


def _truth(p: DataFrame) -> DataFrame:
    """Pairs of one maker number in different sources stand for labelled duplicates; easy if their units agree too."""
    s = p.where("length(mpn) >= 8").select("mpn", "part_key", "source", "uom")
    few = s.groupBy("mpn").agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 200").select("mpn")
    s = s.join(few, "mpn", "left_semi")
    both = s.select("mpn", F.col("part_key").alias("a"), F.col("source").alias("s"), F.col("uom").alias("u")).join(s.select("mpn", F.col("part_key").alias("b"), F.col("source").alias("t"), F.col("uom").alias("v")), "mpn").where("a < b and s <> t")
    return both.select("a", "b", F.when(F.col("u") == F.col("v"), "easy").otherwise("hard").alias("difficulty"))


def _evaluated(t: Tables) -> DataFrame:
    found, _, _ = Cuts(t.spark, "matches").write(resolve.find_matches(t.dim_part).select("a", "b", "band"))
    return resolve.evaluation_by_maker(found, _prepared(t))


add("er_normalize", lambda t: resolve.prepared(t.dim_part).select("part_key", "pn_norm", "mpn", F.col("text").alias("txt"), F.size("tokens").alias("n_tokens")), "select part_key, pn_norm, mpn, txt, cast(len(toks) as int) n_tokens from prep", _ER)
add("er_block", lambda t: resolve.candidate_pairs(_prepared(t)), "select a, b from cand", _ER)
add("er_features", lambda t: _features(t).drop("pn_a", "pn_b", "text_a", "text_b"), "select * from feat", _ER)
add("er_matches", lambda t: resolve.find_matches(t.dim_part))
add("er_evaluate", _evaluated)


_TRUTH = "select x.part_key a, y.part_key b from prep x join prep y on x.mpn = y.mpn and x.part_key < y.part_key and x.source <> y.source where length(x.mpn) >= 8 and x.mpn in (select mpn from prep group by 1 having count(*) between 2 and 200)"


def _candidate_recall(t: Tables) -> DataFrame:
    p = _prepared(t)
    return resolve.candidate_recall(resolve.candidate_pairs(p), _truth(p))


add("er_candidate_recall", _candidate_recall, "select count(*) labelled, count(c.a) as_candidates, round(coalesce(count(c.a) / nullif(count(*), 0), 0), 4) recall from lab l left join cand c on c.a = l.a and c.b = l.b", _ER | {"lab": _TRUTH})


def _trained(t: Tables) -> DataFrame:
    """Metrics of the learned scores. Every step is written once and what it came from is dropped, so the disk holds one step at a time."""
    cuts = Cuts(t.spark, "learned")
    with shuffles_dropped(t.spark):
        p, _, parts_at = cuts.write(resolve.prepared(staging.parts_to_match(t.raw("part_master"))).drop("pn_norm", "tokens"))
        full, _, full_at = cuts.write(resolve.matches_within_blocks(p, 0.3))
        lab = _truth(p).select("a", "b", F.lit(1).alias("label"))
        labelled, _, labelled_at = cuts.write(full.join(lab, ["a", "b"], "left").na.fill(0, ["label"]))
        cuts.drop(parts_at)
        cuts.drop(full_at)
        data, _, _ = cuts.write(resolve.split(resolve.pair_groups(labelled)))
        cuts.drop(labelled_at)
        return reduce(DataFrame.unionByName, [resolve.train(data, m)[2] for m in ("logistic", "boosted")])


add("er_learned", _trained)

# survivorship
_GOLD = {
    "mem": "select distinct entity_id, part_id, coalesce(source_system, '') source_system, last_updated, source_part_number, description, category, uom, lifecycle_status, manufacturer_part_number, standard_cost, lead_time_days, primary_plant from golden_record_member",
    "lng": " union all ".join(f"select entity_id, part_id, source_system, last_updated, '{f}' field_name, cast({f} as varchar) val from mem where {f} is not null and cast({f} as varchar) <> ''" for f in survivorship.FIELDS),
    "newest": "select entity_id, max(last_updated) mx from mem group by 1",
    "sc": """select l.*, count(*) over (partition by entity_id, field_name, val) / count(*) over (partition by entity_id, field_name) agr,
        case source_system when 'SAP_ECC' then 0.92e0 when 'ORACLE_EBS' then 0.85e0 when 'LEGACY_MFG' then 0.65e0 when 'PLM_TEAMCENTER' then 0.88e0 when 'SUPPLIER_PORTAL' then 0.72e0 else 0.6e0 end base,
        case field_name || '|' || source_system when 'description|PLM_TEAMCENTER' then 0.10e0 when 'standard_cost|SAP_ECC' then 0.10e0 when 'standard_cost|ORACLE_EBS' then 0.05e0 when 'lead_time_days|SUPPLIER_PORTAL' then 0.25e0 when 'uom|SAP_ECC' then 0.05e0 else 0e0 end bonus,
        coalesce(greatest(0e0, 1e0 - (mx - last_updated) / 1460e0), 0.5e0) rec from lng l join newest using (entity_id)""",
    "scored": "select *, cast(round(cast(0.45e0 * (base + bonus) + 0.25e0 * rec + 0.30e0 * agr as decimal(12, 8)), 4) as decimal(8, 4)) score from sc",
    "best": "select *, lead(score) over (partition by entity_id, field_name order by score desc, part_id, val) nxt, row_number() over (partition by entity_id, field_name order by score desc, part_id, val) rn from scored",
}
_CONF = "cast(round(least(cast(1 as decimal(18, 8)), score * (0.7 + least(0.3, case when nxt is null then score else score - nxt end))), 4) as double)"
# numbers are compared as text, which the engines write differently; the value itself is left to the fields of text
add("golden_fields", lambda t: survivorship.decide(t.raw("golden_record_member")).select("entity_id", "field_name", "source_record", "source_system", "confidence"), f"select entity_id, field_name, part_id source_record, source_system, {_CONF} confidence from best where rn = 1", _GOLD)
add("golden_flat", lambda t: survivorship.flat(survivorship.decide(t.raw("golden_record_member"))).drop("standard_cost", "lead_time_days"), "select entity_id, " + ", ".join(f"max(val) filter (field_name = '{f}') {f}" for f in survivorship.FIELDS if f not in ("standard_cost", "lead_time_days")) + " from best where rn = 1 group by 1", _GOLD)
add("golden_alternatives", lambda t: survivorship.decide(t.raw("golden_record_member")).select("entity_id", "field_name", F.size("alternatives").alias("n_alternatives"), "reason"), """select entity_id, field_name, cast(count(*) filter (val <> bv) as int) n_alternatives, any_value(reason) reason from best join (select entity_id, field_name, val bv, 'source_reliability(' || source_system || ')' || case when agr > 0.5 then ' + cross_source_agreement(' || cast(round(agr * 100) as int) || '%)' else '' end || case when bonus > 0 then ' + domain_preference(' || field_name || ')' else '' end reason from best where rn = 1) using (entity_id, field_name) group by 1, 2""", _GOLD)

# offers
def _pages(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.lit(1).alias("page_no"), "text")


def _extracted_sql() -> str:
    cells = " union all ".join(f"select doc_id, '{n}' field_name, nullif(regexp_extract(txt, '{documents.pattern(n)}', 1), '') val from pages" for n in documents.FIELDS)
    ok = """case when val is null then 0 when field_name = 'currency' then case when val in ('USD', 'EUR', 'GBP', 'INR', 'CNY', 'MXN', 'JPY') then 0.95 else 0.4 end
        when field_name = 'unit_price' then case when try_cast(val as double) is null then 0.2 when try_cast(val as double) <= 0 then 0.3 else 0.95 end
        when field_name in ('min_order_qty', 'lead_time_days') then case when try_cast(val as int) is null then 0.2 when try_cast(val as int) < 0 then 0.3 else 0.95 end else 0.95 end"""
    return f"select doc_id, field_name, val, cast({ok} as double) conf from ({cells})"


_DOC = {"pages": "select doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') txt from documents", "ext": _extracted_sql()}
add("doc_extract", lambda t: documents.extract(_pages(t)).select("doc_id", "field_name", F.col("value").alias("val"), "confidence", "page_no", "needs_review"), "select doc_id, field_name, val, conf confidence, case when val is not null then 1 end page_no, conf < 0.8 needs_review from ext", _DOC)
add("doc_injection", lambda t: documents.flagged(_pages(t)), f"select doc_id, 1 page_no, regexp_extract(text, '{documents.INSTRUCTIONS}', 0) passage from documents where regexp_matches(text, '{documents.INSTRUCTIONS}')")


def _compared(t: Tables) -> DataFrame:
    """Each offer is of the supplier of its id; where a document names no part it has, the document's own part counts."""
    d = t.raw("documents").where("doc_type = 'quotation'").select("doc_id", F.concat(F.lit("SUP"), F.lpad((F.col("doc_id") % 40).cast("string"), 5, "0")).alias("supplier_id"), F.upper(F.trim("part_id")).alias("own"))
    o = documents.offers(documents.extract(_pages(t).join(d.select("doc_id"), "doc_id", "left_semi"))).join(d.select("doc_id", "own"), "doc_id").withColumn("part_id", F.when(F.col("doc_id") % 5 > 0, F.col("own")).otherwise(F.col("part_id")))
    return documents.discrepancies(o, d.select("doc_id", "supplier_id"), t.supplier_part).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("document_value").alias("n_document"), F.count("erp_value").alias("n_erp"))


add("doc_compare", _compared, """select kind, count(*) n, count(dv) n_document, count(ev) n_erp from (
    select 'unmatchable_document' kind, null dv, null ev from j where part_id is null union all select 'no_erp_relationship', part_id, null from j where part_id is not null and k is null
    union all select 'price_discrepancy', unit_price, 'x' from j where ep > 0 and abs(cast(unit_price as double) - ep) > 0.10e0 * ep union all select 'lead_time_discrepancy', lead_, 'x' from j where abs(cast(lead_ as int) - el) > 7) group by 1""",
    _DOC | {"o": "select doc_id, 'SUP' || lpad(cast(doc_id % 40 as varchar), 5, '0') supplier_id, upper(case when doc_id % 5 > 0 then own else max(val) filter (field_name = 'part_id') end) part_id, max(val) filter (field_name = 'unit_price') unit_price, max(val) filter (field_name = 'lead_time_days') lead_ from ext join (select doc_id, upper(trim(part_id)) own from documents where doc_type = 'quotation') using (doc_id) group by doc_id, own",
            "erp": "select supplier_id, part_id, min(supplier_part_id) k, arg_min(cast(unit_price as double), supplier_part_id) ep, arg_min(lead_time_days, supplier_part_id) el from (select *, row_number() over (partition by supplier_id, part_id order by supplier_part_id) rn from supplier_part where supplier_id is not null and part_id is not null) where rn = 1 group by 1, 2",
            "j": "select o.*, k, ep, el from o left join erp using (supplier_id, part_id)"})


# questions and proposals
_ASK = ("Why was {} flagged as a duplicate?", "Which rules fail for {}?", "Which assemblies depend on {}?", "Which obsolete parts have demand?", "Which supplier has the greatest risk exposure?", "Which issues are there at PL07?", "When did the model abstain?", "Please approve {}", "What about {}?", "Hello there")


def _questions(t: Tables) -> DataFrame:
    i = F.pmod(F.ascii(F.right("part_key", F.lit(1))), F.lit(10))
    q = F.replace(F.element_at(F.array(*[F.lit(a) for a in _ASK]), i + 1), F.lit("{}"), F.col("part_key"))
    return documents.classify(t.dim_part.select("part_key", q.alias("question")), "question").groupBy("kind", "refused").agg(F.count(F.lit(1)).alias("n"), F.count("part_id").alias("n_parts"), F.count("plant").alias("n_plants"))


_KINDS = ("duplicate_explanation", "failed_rules", "reverse_dependencies", "obsolete_demand", "supplier_risk", "plant_issues", "abstentions", "mutation_request", "entity_issues", "unsupported")
add("lookup_questions", _questions, "select kind, kind = 'mutation_request' refused, count(*) n, case when kind in ('duplicate_explanation', 'failed_rules', 'reverse_dependencies', 'mutation_request', 'entity_issues') then count(*) else 0 end n_parts, case when kind = 'plant_issues' then count(*) else 0 end n_plants from (select [" + ", ".join(f"'{k}'" for k in _KINDS) + "][ascii(right(part_key, 1)) % 10 + 1] kind from dim_part) group by 1")


def _proposed(t: Tables) -> DataFrame:
    i = issues_of(t).withColumn("rule_id", F.col("rule_id"))
    e = i.select("issue_id", F.concat(F.lit("E"), "issue_id").alias("evidence_id"), "field", "failed_value").unionByName(i.where("failed_value is not null").select("issue_id", F.concat(F.lit("V"), "issue_id").alias("evidence_id"), "field", "failed_value")).distinct()
    return documents.proposals(documents.evidence_bundles(i, e))


def _actions(t: Tables) -> DataFrame:
    return _proposed(t).groupBy("action", "abstained").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


add("remediation_proposals", _actions, """select action, abstained, count(*) n, round(avg(c), 4) avg_confidence from (select case when failed_value is null then 'insufficient_evidence' else case left(rule_id, 4) when 'UNIQ' then 'merge_records' when 'GRPH' then 'escalate' else 'correct_field' end end as action, failed_value is null abstained, case when failed_value is null then 0.2e0 else 0.7e0 end c from (select distinct issue_id, rule_id, failed_value from issues)) group by 1, 2""", issues_sql())
