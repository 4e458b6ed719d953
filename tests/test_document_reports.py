"""Batch reports against a plain count; documents without fields, unknown forms, empty tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

from fieldrail.operators import document_reports as R

USD = [f"{n}_usd" for n in R.COMPONENTS]
PAGE = "doc_id string, page int, document_type string, latency_ms double, input_tokens long, output_tokens long, " + ", ".join(f"{n} double" for n in USD)
FIELD = "doc_id string, page int, field_name string, value string, decision string, retry_count int, escalated boolean, sent boolean, model string, confidence double, criticality string, optional boolean, external boolean, paid array<string>"
DONE = {"ACCEPT", "ACCEPT_WITH_FLAG", "ACCEPT_WITH_OVERRIDE"}


def data(seed=3):
    r = random.Random(seed)
    kinds = ["cms1500", "ub04", "letter"]
    pages = [(f"d{d}", p, kinds[d % 3] if d % 7 else r.choice(kinds), 10.5 * p, 5 * p, p, *[round(r.random() / 100, 6) for _ in USD]) for d in range(20) for p in range(1 + d % 3)]
    fields = [
        (d, p, f"f{k}", r.choice(["x", "", None, " "]), r.choice(R.STATES), r.randrange(3), r.random() < 0.2, r.random() < 0.7, r.choice(["offline-oracle", "small", None]), r.choice([None, 0.85, 0.6, 0.59, 0.99]), r.choice(["high", "med", "low", None]), r.choice([True, False, None]), r.choice([True, True, False, None]), r.choice([["high"], ["high", "med"]]))
        for d, p, *_ in pages for k in range(r.randrange(5)) if d != "d4"
    ]
    return pages, fields


def plain(pages, fields):
    out = {}
    for doc in {p[0] for p in pages}:
        own, c = [f for f in fields if f[0] == doc], Counter()
        types = {p[2] for p in pages if p[0] == doc}
        kind = types.pop() if len(types) == 1 else "mixed"
        for _, _, _, value, state, tries, up, sent, model, conf, crit, optional, external, paid in own:
            done, open_, usable = state in DONE, state not in DONE | {"INAPPLICABLE"}, state != "INAPPLICABLE"
            eligible = external is not False and (crit or "med") in paid and not optional
            c.update({"fields": 1, f"state_{state.lower()}": 1, "multimodal_eligible": eligible, "unresolved_fields": open_, "fields_retried": tries > 0, "multimodal_attempted": up})
            c.update({"external_calls": int(up and sent and model != "offline-oracle"), "multimodal_failed": up and open_, "pending_human_review": open_ and not up})
            c.update({"accepted_without_retry": done and not up and not tries, "accepted_after_local_retry": done and not up and tries > 0, "pending_local_retry": state == "RETRY"})
            c.update({"applicable_fields": usable, "fields_produced": usable and bool(value), "validated_fields": done, "critical_fields": usable and crit == "high", "critical_resolved": done and crit == "high"})
            c.update({"confidence_high": usable and (conf or 0) >= 0.85, "confidence_medium": usable and 0.6 <= (conf or 0) < 0.85, "confidence_low": usable and (conf or 0) < 0.6})
        c["paid_calls_avoided"] = max(0, c["fields"] - c["state_inapplicable"] - c["external_calls"])
        out[doc] = (kind, kind in ("cms1500", "ub04") and bool(own), c)
    return out


def test_documents_equal_a_plain_count(spark):
    pages, fields = data()
    flows = R.with_workflow(spark.createDataFrame(fields, FIELD), F.lit("off"))
    docs = R.document_reports(spark.createDataFrame(pages, PAGE), flows)
    want = plain(pages, fields)
    got = {x.doc_id: x for x in docs.collect()}
    assert set(got) == set(want)
    names = {n for _, _, c in want.values() for n in c} - set(R.COVERAGE)
    for doc, (kind, known, c) in want.items():
        x = got[doc]
        assert (x.document_type, x.coverage_available) == (kind, known)
        assert {n: x[n] for n in names} == {n: int(c[n]) for n in names}
        assert [x[n] for n in R.COVERAGE] == [int(c[n]) if known else None for n in R.COVERAGE]
        assert x.processing_status == ("FAILED_EXTRACTION" if not c["fields"] else "PARTIAL" if c["unresolved_fields"] else "COMPLETED")
        assert (x.extraction_coverage is not None) == (known and c["applicable_fields"] > 0)
    assert got["d4"].warnings == ["Document classified as ub04; no fields were extracted, so it was not processed."] and got["d4"].fields == 0
    cost = sum(p[6] for p in pages if p[0] == "d5")
    assert abs(got["d5"].primary_ocr_usd - cost) < 1e-9
    reasons = {(x.decision, x.eligible, x.escalated, x.not_called) for x in flows.collect()}
    assert ("RETRY", True, False, "off") in reasons and ("RETRY", False, False, "not eligible under field policy") in reasons
    assert all(x[3] == "human review required by governor" for x in reasons if x[0] == "HUMAN_REVIEW" and not x[2]) and all(x[3] == "" for x in reasons if x[2])
    assert all(x[3] is None for x in reasons if x[0] in DONE and not x[2])


def test_batch_and_dashboard(spark):
    pages, fields = data(5)
    flows = R.with_workflow(spark.createDataFrame(fields, FIELD), F.lit("off"))
    docs = R.document_reports(spark.createDataFrame(pages, PAGE), flows).withColumn("review_completed", F.lit(1))
    docs = docs.withColumn("processing_status", F.when(F.col("doc_id") == "d1", "SKIPPED").when(F.col("doc_id") == "d2", "FAILED").otherwise(F.col("processing_status")))
    want = plain(pages, fields)
    made = {d for d, (_, _, c) in want.items() if c["fields"] and d not in ("d1", "d2")}
    one = R.batch_report(docs).first()
    assert one.files == 20 and one.skipped == 1 and one.failed == 1 and one.review_completed == len(made)
    for n in ("fields", "unresolved_fields", "paid_calls_avoided", "state_retry", "pending_local_retry"):
        assert one[n] == sum(int(want[d][2][n]) for d in made), n
    for n in R.COVERAGE:
        assert one[n] == sum(int(want[d][2][n]) for d in made if want[d][1]), n
    lines = {(x.section, x.name): x for x in R.dashboard(docs).collect()}
    counted = set(want) - {"d1"}
    assert lines["counter", "total_fields"].value == sum(want[d][2]["fields"] for d in counted)
    spent = sum(p[6 + list(R.COMPONENTS).index("measured")] for p in pages if p[0] in counted)
    assert abs(lines["component", "measured"].value - spent) < 1e-9 and lines["component", "projected_api"].basis == "OFFLINE_ORACLE"
    n_pages = sum(p[0] in counted for p in pages)
    assert abs(lines["unit", "cost_per_page"].value - spent / n_pages) < 1e-8
    review = sum(want[d][2]["pending_human_review"] for d in counted)
    assert lines["human_review", "fields"].value == review and abs(lines["human_review", "total"].value - 0.03 * review) < 1e-9
    left = R.unresolved_items(docs, flows).collect()
    assert len(left) == sum(want[d][2]["unresolved_fields"] for d in made) and {x.doc_id for x in left} <= made


def test_empty_batches(spark):
    flows = R.with_workflow(spark.createDataFrame([], FIELD), F.lit("off"))
    docs = R.document_reports(spark.createDataFrame([], PAGE), flows).withColumn("review_completed", F.lit(0))
    assert docs.count() == 0
    one = R.batch_report(docs).first()
    assert (one.files, one.pages, one.measured_usd, one.human_review_rate) == (0, 0, 0.0, None)
    lines = {(x.section, x.name): x.value for x in R.dashboard(docs).collect()}
    assert lines["unit", "cost_per_page"] is None and lines["counter", "total_fields"] == 0 and lines["volume", "one_million_pages"] is None
