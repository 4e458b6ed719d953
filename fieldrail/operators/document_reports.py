"""Whole reports of a batch: documents with coverage and costs, the batch's row, its dashboard, what is left open.

A document's counters and coverage are one aggregate over its fields, its costs one over its pages; the
batch's row and the dashboard are one aggregate each over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import ACCEPT, ESCALATE, FLAG, HUMAN, OVERRIDE, RETRY, TERMINAL
from ..functions.text import blank, first_reason
from ..functions.typed import ratio
from .ledger import total
from .oversight import workflow_state
from .reporting import IDLE, ORACLE, PRODUCED, _n, batch_summary, unify_receipts

RESOLVED = ("INAPPLICABLE", *TERMINAL)
STATES = (ACCEPT, FLAG, OVERRIDE, RETRY, ESCALATE, HUMAN, "INAPPLICABLE")
# Fixed names: cost components with what their figures rest on, forms whose fields are known.
COMPONENTS = {
    "primary_ocr": "MEASURED",
    "retry_ocr": "MEASURED",
    "other_local": "MEASURED",
    "local": "MEASURED",
    "input_tokens": "MEASURED",
    "output_tokens": "MEASURED",
    "projected_input_tokens": "OFFLINE_ORACLE",
    "projected_output_tokens": "OFFLINE_ORACLE",
    "measured_api": "MEASURED",
    "projected_api": "OFFLINE_ORACLE",
    "measured": "MEASURED",
    "projected": "PROJECTED",
}
SCHEMAS = ("cms1500", "ub04")
HIGH, MEDIUM = 0.85, 0.60
#: What a person's look at a field is assumed to cost.
HUMAN_USD = 0.03
#: Counters that a batch and its dashboard add up over documents.
COVERAGE = ("applicable_fields", "fields_produced", "validated_fields", "critical_fields", "critical_resolved", "confidence_high", "confidence_medium", "confidence_low")


def _usd(name: str) -> str:
    return f"{name}_usd"


def with_workflow(fields: DataFrame, refusal: Column) -> DataFrame:
    """fields with ``eligible``, ``calls``, ``workflow`` and ``not_called``; the last three speak of open or escalated fields only.

    fields: decision, escalated, sent, model, criticality, paid (criticalities that the page's mode pays for), optional, external;
    refusal: why the workspace makes no calls. A call of the model's double isn't one.
    """
    c = F.col
    eligible = F.coalesce(c("external"), F.lit(True)) & F.array_contains("paid", F.coalesce("criticality", F.lit("med"))) & ~F.coalesce("optional", F.lit(False))
    concerned = ~F.coalesce(c("decision").isin(*RESOLVED), F.lit(False)) | c("escalated")
    called = c("escalated") & c("sent") & (F.coalesce("model", F.lit("")) != ORACLE.removeprefix("escalate_"))
    why = first_reason((c("escalated"), ""), (c("decision") == HUMAN, "human review required by governor"), (~c("eligible"), "not eligible under field policy"), otherwise="_")
    out = fields.withColumn("eligible", eligible)
    return out.withColumns({"calls": F.when(concerned & called, 1).otherwise(0), "workflow": F.when(concerned, workflow_state(c("escalated"), c("decision"), c("eligible"))), "not_called": F.when(concerned, F.when(why == "_", refusal).otherwise(why))})


def document_reports(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """A row a document: what unify_receipts has, and states, coverage, costs by component, tokens, rates, message and warnings.

    pages: doc_id, page, document_type, latency_ms, input_tokens, output_tokens and ``<component>_usd``; fields: with_workflow()
    with doc_id, value, confidence, retry_count. Coverage (of what was extracted, never of what is right) is null where the
    document's form isn't known or it has no fields.
    """
    c = F.col
    usable = c("decision") != "INAPPLICABLE"
    sure = F.coalesce("confidence", F.lit(0.0))
    critical = usable & (c("criticality") == "high")
    counts = (
        *(_n(c("decision") == s).alias(f"state_{s.lower()}") for s in STATES),
        _n(usable).alias("applicable_fields"),
        _n(usable & ~blank(c("value"))).alias("fields_produced"),
        _n(c("decision").isin(*TERMINAL)).alias("validated_fields"),
        _n(critical).alias("critical_fields"),
        _n(critical & c("decision").isin(*TERMINAL)).alias("critical_resolved"),
        _n(usable & (sure >= HIGH)).alias("confidence_high"),
        _n(usable & (sure >= MEDIUM) & (sure < HIGH)).alias("confidence_medium"),
        _n(usable & (sure < MEDIUM)).alias("confidence_low"),
    )
    sums = tuple(F.bround(F.coalesce(total(c(_usd(n))), F.lit(0.0)), 9).alias(_usd(n)) for n in COMPONENTS if n not in ("measured", "projected"))
    tokens = tuple(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("input_tokens", "output_tokens"))
    out = unify_receipts(pages, fields, (*sums, *tokens), counts)
    known = c("document_type").isin(*SCHEMAS) & (c("fields") > 0)
    out = out.withColumns({n: F.when(known, c(n)) for n in COVERAGE} | {"coverage_available": known})
    rate = lambda a, b: ratio(a, b, 6)
    shares = {
        "extraction_coverage": rate(c("fields_produced"), c("applicable_fields")),
        "validated_coverage": rate(c("validated_fields"), c("applicable_fields")),
        "critical_resolution_rate": rate(c("critical_resolved"), c("critical_fields")),
        "primary_resolution_rate": rate(c("accepted_without_retry"), c("applicable_fields")),
        "retry_resolution_rate": F.when(known, rate(c("accepted_after_local_retry"), c("fields_retried"))),
        "multimodal_resolution_rate": F.when(known, rate(F.greatest(F.lit(0), c("multimodal_attempted") - c("multimodal_failed")), c("multimodal_attempted"))),
        "human_review_rate": rate(c("pending_human_review"), c("applicable_fields")),
    }
    empty = F.format_string("Document classified as %s; no fields were extracted, so it was not processed.", "document_type")
    notes = F.array(F.when(c("fields") == 0, empty), *(F.when(c(n) > 0, F.concat(c(n).cast("string"), F.lit(text))) for n, text in (("pending_human_review", " field(s) require human review."), ("pending_local_retry", " field(s) remain pending local retry."))))
    message = first_reason((c("fields") == 0, "No meaningful fields were extracted"), (c("unresolved_fields") > 0, "Processing completed with unresolved fields"), otherwise="Processing completed")
    return out.withColumns(shares | {"message": message, "warnings": F.array_compact(notes)})


def batch_report(documents: DataFrame) -> DataFrame:
    """batch_summary with states, confidence bands, tokens, review and pending work of documents with output.

    documents: document_reports() with review_completed.
    """
    made = F.col("processing_status").isin(*PRODUCED)
    names = (*(f"state_{s.lower()}" for s in STATES if s not in (ACCEPT, FLAG, "INAPPLICABLE")), "confidence_high", "confidence_medium", "confidence_low", "pending_local_retry", "multimodal_eligible", "paid_calls_avoided", "review_completed", "input_tokens", "output_tokens")
    return batch_summary(documents, tuple(F.coalesce(F.sum(F.when(made, F.col(n))), F.lit(0)).alias(n) for n in names))


def dashboard(documents: DataFrame, human_usd: float = HUMAN_USD) -> DataFrame:
    """(section, name, basis, value) of costs, unit costs, the review that is assumed, volumes and counters; bases are never added up.

    Documents that nothing was done for don't count. A cost of nothing a unit is null.
    """
    c = F.col
    counters = {"total_fields": c("fields"), "fields_resolved_locally": c("accepted_without_retry") + c("accepted_after_local_retry"), "retry_fields": c("fields_retried"), "multimodal_eligible_fields": c("multimodal_eligible"), "multimodal_attempted_fields": c("multimodal_attempted"), "paid_calls_avoided": c("paid_calls_avoided"), "external_calls": c("external_calls"), "input_tokens": c("input_tokens"), "output_tokens": c("output_tokens")}
    num = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    # every sum is over the rows of one aggregate; what follows works on its row
    one = documents.filter(~c("processing_status").isin(*IDLE)).agg(
        *(F.bround(F.coalesce(total(c(_usd(n))), F.lit(0.0)), 9).alias(_usd(n)) for n in COMPONENTS),
        *(num(x).alias(f"n_{n}") for n, x in counters.items()),
        F.count("*").alias("documents"),
        num(c("page_count")).alias("pages"),
        num(c("validated_fields")).alias("validated"),
        num(c("pending_human_review")).alias("review"),
    )
    row = lambda section, name, basis, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.lit(basis).alias("basis"), value.cast("double").alias("value"))
    rows = [row("component", n, basis, c(_usd(n))) for n, basis in COMPONENTS.items()]
    rows += [row("unit", f"cost_per_{n}", "MEASURED", ratio(c("measured_usd"), c(k), 9)) for n, k in (("page", "pages"), ("document", "documents"), ("validated_field", "validated"))]
    rows += [row("human_review", "fields", None, c("review")), row("human_review", "usd_a_field", "ASSUMED", F.lit(human_usd)), row("human_review", "total", "ASSUMED", F.bround(c("review") * human_usd, 9))]
    rows += [row("volume", n, "PROJECTED", F.bround(F.try_divide(c("projected_usd"), c("pages").cast("double")) * pages, 6)) for n, pages in (("one_million_pages", 1e6), ("ten_million_pages", 1e7))]
    rows += [row("counter", n, None, c(f"n_{n}")) for n in counters]
    return one.select(F.inline(F.array(*rows)))


def unresolved_items(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, page, field_name, decision, criticality) that documents with output leave open."""
    made = documents.filter(F.col("processing_status").isin(*PRODUCED)).select("doc_id")
    open_ = fields.filter(~F.coalesce(F.col("decision").isin(*RESOLVED), F.lit(False)))
    return open_.join(made, "doc_id", "left_semi").select("doc_id", "page", "field_name", "decision", F.coalesce("criticality", F.lit("med")).alias("criticality"))
