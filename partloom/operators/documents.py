"""Fields of offers in documents, instruction-like passages, and the comparison with supplier parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: labels of each field as offers print them, and the form of its value
FIELDS: dict[str, tuple[tuple[str, ...], str]] = {
    "quote_id": (("Quotation Reference", "Our reference"), r"\S+"),
    "supplier_name": (("Supplier Name",), r".+?"),
    "supplier_part_number": (("Supplier Part Number",), r"\S+"),
    "part_id": (("Internal Part Reference", "Buyer item"), r"\S+"),
    "description": (("Item text",), r".+?"),
    "unit_price": (("Unit Price", "Price each"), r"[0-9]+\.[0-9]+"),
    "currency": (("Currency", r"Price each: +[0-9]+\.[0-9]+"), r"[A-Z]{3}"),
    "min_order_qty": (("Minimum Order Quantity", "Lot size"), r"[0-9]+"),
    "lead_time_days": (("Lead Time Days", "Days to deliver"), r"[0-9]+"),
    "valid_from": (("Valid From",), r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    "valid_to": (("Valid To", "Open until"), r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
}
#: fixed values: currencies an offer may name, and passages that address automation
CURRENCIES = ("USD", "EUR", "GBP", "INR", "CNY", "MXN", "JPY")
INSTRUCTIONS = r"(?i)(ignore (all |previous )?instructions|system note|ai assistant|disregard .{0,40}(rules|policy)|approve this)"
REVIEW_BELOW, PRICE_TOLERANCE, LEAD_TOLERANCE = 0.8, 0.10, 7


def pattern(name: str) -> str:
    labels, value = FIELDS[name]
    return rf"(?m)^(?:{'|'.join(labels)}):? *({value})(?: [A-Z]{{3}})?$" if name == "unit_price" else rf"(?m)^(?:{'|'.join(labels)}):? *({value})$"


def _lines(c: str) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def confidence(name: str, value: Column) -> Column:
    """How far a value is to be trusted: 0 if there is none, less if it breaks the field's limits."""
    good = F.lit(0.95)
    if name == "currency":
        good = F.when(value.isin(*CURRENCIES), 0.95).otherwise(0.4)
    elif name == "unit_price":
        good = F.when(value.try_cast("double").isNull(), 0.2).when(value.try_cast("double") <= 0, 0.3).otherwise(0.95)
    elif name in ("min_order_qty", "lead_time_days"):
        good = F.when(value.try_cast("int").isNull(), 0.2).when(value.try_cast("int") < 0, 0.3).otherwise(0.95)
    return F.when(value.isNull(), 0.0).otherwise(good)


def extract(pages: DataFrame) -> DataFrame:
    """(doc_id, field_name, value, confidence, page_no, needs_review): one row per document and field.

    pages: (doc_id, page_no, text). Of several pages that hold a field the first counts; within a page its first
    line. A document without the field has value null, confidence 0 and needs review. Null texts hold nothing.
    """
    text = pages.select("doc_id", "page_no", _lines("text").alias("text"))
    value = lambda n: F.nullif(F.regexp_extract("text", pattern(n), 1), F.lit(""))
    hit = text.select("doc_id", "page_no", *[value(n).alias(n) for n in FIELDS])
    first = hit.groupBy("doc_id").agg(*[F.min(F.when(F.col(n).isNotNull(), F.struct("page_no", F.col(n).alias("value")))).alias(n) for n in FIELDS])
    cells = [F.struct(F.lit(n).alias("field_name"), F.col(n)["value"].alias("value"), confidence(n, F.col(n)["value"]).alias("confidence"), F.col(n)["page_no"].alias("page_no")) for n in FIELDS]
    return first.select("doc_id", F.inline(F.array(*cells))).withColumn("needs_review", F.col("confidence") < REVIEW_BELOW)


def flagged(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, passage): pages with a passage that addresses automation, and the first such passage."""
    passage = F.regexp_extract("text", INSTRUCTIONS, 0)
    return pages.select("doc_id", "page_no", passage.alias("passage")).where("passage <> ''")


def offers(fields: DataFrame) -> DataFrame:
    """(doc_id, part_id, unit_price, lead_time_days, ...): the extracted fields as columns."""
    return fields.groupBy("doc_id").agg(*[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in FIELDS])


def discrepancies(quotes: DataFrame, suppliers: DataFrame, supplied: DataFrame) -> DataFrame:
    """(doc_id, kind, document_value, erp_value): what offers say against the supplier parts.

    suppliers: (doc_id, supplier_id). Of several supplier parts of a supplier and part the one of the smallest key counts.
    kinds: unmatchable_document (no part), no_erp_relationship, price_discrepancy, lead_time_discrepancy.
    """
    erp = supplied.where("supplier_id is not null and part_id is not null").groupBy("supplier_id", "part_id").agg(F.min(F.struct("supplier_part_id", "unit_price", "lead_time_days")).alias("erp"))
    both = quotes.select("doc_id", F.upper("part_id").alias("part_id"), "unit_price", "lead_time_days").join(suppliers, "doc_id", "left").join(erp, ["supplier_id", "part_id"], "left")
    price, own = F.col("unit_price").try_cast("double"), F.col("erp.unit_price").cast("double")
    lead = F.col("lead_time_days").try_cast("int")
    case = lambda cond, kind, a, b: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("document_value"), b.cast("string").alias("erp_value")))
    none = F.lit(None)
    found = [
        case(F.col("part_id").isNull(), "unmatchable_document", none, none), case(F.col("part_id").isNotNull() & F.col("erp").isNull(), "no_erp_relationship", F.col("part_id"), none),
        case((own > 0) & (F.abs(price - own) > PRICE_TOLERANCE * own), "price_discrepancy", F.col("unit_price"), F.col("erp.unit_price")), case(F.abs(lead - F.col("erp.lead_time_days")) > LEAD_TOLERANCE, "lead_time_discrepancy", lead, F.col("erp.lead_time_days")),
    ]
    return both.select("doc_id", F.inline(F.array_compact(F.array(*found))))


#: fixed values: kinds of questions, the first whose words are all found; what would change data is refused
QUESTIONS: list[tuple[str, str]] = [
    ("mutation_request", r"\b(approve|reject|apply|merge now|delete|update|fix it|change the)\b"), ("duplicate_explanation", r"duplicate.*prt\d|prt\d.*duplicate"), ("failed_rules", r"(?=.*rule)(?=.*fail)(?=.*prt\d)"),
    ("reverse_dependencies", r"(?=.*(depend|assembl))(?=.*prt\d)"), ("obsolete_demand", r"(?=.*obsolete)(?=.*demand)"), ("supplier_risk", r"(?=.*supplier)(?=.*(risk|exposure))"),
    ("plant_issues", r"(?=.*\bpl\d\d)(?=.*(issue|risk))"), ("abstentions", r"abstain|abstention"), ("entity_issues", r"\bprt\d"),
]


def classify(questions: DataFrame, text: str) -> DataFrame:
    """questions with kind, refused, and the part and plant asked about; unsupported if nothing fits."""
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    kind = reduce(lambda e, q: e.when(low.rlike(q[1]), q[0]), QUESTIONS, F.when(low.isNull(), "unsupported")).otherwise("unsupported")
    return questions.withColumns({"kind": kind, "refused": kind == "mutation_request", "part_id": F.nullif(F.upper(F.regexp_extract(low, r"\b(prt\d+)", 1)), F.lit("")), "plant": F.nullif(F.upper(F.regexp_extract(low, r"\b(pl\d\d)\b", 1)), F.lit(""))})


def evidence_bundles(issues: DataFrame, evidence: DataFrame) -> DataFrame:
    """(issue_id, rule_id, items): what there is on each issue, as sorted (evidence_id, field, failed_value); issues have bounded evidence."""
    e = evidence.groupBy("issue_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", "field", "failed_value"))).alias("items"))
    return issues.select("issue_id", "rule_id").distinct().join(e, "issue_id", "left").withColumn("items", F.coalesce("items", F.expr("array()").cast("array<struct<evidence_id: string, field: string, failed_value: string>>")))


#: fixed values: the action proposed for each family of rules
ACTIONS = {"UNIQ": "merge_records", "VALD": "correct_field", "REFI": "correct_field", "COMP": "correct_field", "GRPH": "escalate", "TEMP": "correct_field"}


def proposals(bundles: DataFrame, least: int = 2) -> DataFrame:
    """(issue_id, action, confidence, refs, abstained): a rule-made proposal grounded in the bundle; fewer than `least` items abstain."""
    n = F.size("items")
    family = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    refs = F.transform("items", lambda i: i["evidence_id"])
    action = F.when(n < least, "insufficient_evidence").otherwise(F.coalesce(F.try_element_at(family, F.split("rule_id", "-")[0]), F.lit("correct_field")))
    return bundles.select("issue_id", action.alias("action"), F.when(n < least, 0.2).otherwise(F.least(F.lit(0.95), 0.5 + 0.1 * n)).alias("confidence"), refs.alias("refs"), (n < least).alias("abstained"))


def ungrounded(made: DataFrame, bundles: DataFrame) -> DataFrame:
    """Proposals that refer to evidence their bundle doesn't hold, with those references."""
    held = bundles.select("issue_id", F.transform("items", lambda i: i["evidence_id"]).alias("held"))
    return made.join(held, "issue_id", "left").withColumn("foreign", F.array_except("refs", F.coalesce("held", F.expr("array()").cast("array<string>")))).where(F.size("foreign") > 0).select("issue_id", "foreign")
