"""A batch after its documents: review and what follows from it, evaluation against a dataset, second readings as a rung."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import ACCEPT, ESCALATE, FLAG, HUMAN, OVERRIDE, RETRY, TERMINAL
from ..functions.text import blank
from ..functions.typed import ratio
from .local_retry import claim_judge

RESOLVED = (*TERMINAL, "INAPPLICABLE")
Judge = Callable[[Column, Column, Column], Column]


def review_queue(evidence: DataFrame, providers: DataFrame) -> DataFrame:
    """(doc, page, field_name, ..., provider_state) of fields that nothing has resolved, with what became of their paid call.

    providers: (doc, page, field_name, final_workflow_state); of several rows of a field the last by ``seq`` counts.
    """
    keys = ["doc", "page", "field_name"]
    last = providers.groupBy(*keys).agg(F.max_by("final_workflow_state", "seq").alias("provider_state"))
    open_ = evidence.filter(~F.coalesce(F.col("state").isin(*RESOLVED), F.lit(False)))
    return open_.join(last, keys, "left").withColumn("provider_state", F.coalesce("provider_state", F.lit("HUMAN_REVIEW_REQUIRED")))


def _review(fields: DataFrame, actions: DataFrame, judge: Judge) -> DataFrame:
    """fields after review, with ``action``, ``failures``, ``resolution`` and ``_touched``: whether their document has an action.

    Fields and actions are dealt once, by document; a field's last action, its page's values and what its document
    has are windows over rows that lie together. A document's rows share a task.
    """
    c, keys = F.col, ["doc", "page", "field_name"]
    columns = [n for n in fields.columns if n != "action"]
    earlier = c("action") if "action" in fields.columns else F.lit(None).cast("string")
    said = actions.filter("doc is not null").select(*keys, F.struct("action", "new_value").alias("_a"), c("seq").alias("_seq"))
    rows = fields.select(*columns, earlier.alias("_earlier"), F.lit(True).alias("_field")).unionByName(said, allowMissingColumns=True).repartition("doc")
    field, page, doc = (Window.partitionBy(*keys[:n]) for n in (3, 2, 1))
    named = c("page").isNotNull() & c("field_name").isNotNull()
    own = c("_a").isNotNull() & (c("_a.action") != "REJECT_DOCUMENT") & named
    act, new = c("_last.action"), c("_last.new_value")
    value = F.when(act == "EDIT", new).when(~act.isin("MARK_BLANK", "MARK_NOT_APPLICABLE") | act.isNull(), c("value"))
    rows = rows.withColumn("_last", F.max_by(F.when(own, c("_a")), F.when(own, c("_seq"))).over(field))
    rows = rows.withColumns({"value": value, "_edited": F.count(F.when(c("_a.action").isin("EDIT", "MARK_BLANK") & c("page").isNotNull(), 1)).over(page) > 0, "_touched": F.count("_a").over(doc) > 0})
    # a page has at most as many fields as its form
    pair = F.when(c("_field") & c("_edited"), F.struct("field_name", F.coalesce("value", F.lit("")).alias("value")))
    rows = rows.withColumn("_pairs", F.collect_list(pair).over(page)).filter("_field")
    edits = act.isin("EDIT", "MARK_BLANK")
    out = rows.withColumn("_values", F.when(edits, F.map_from_entries("_pairs"))).withColumn("failures", F.when(edits, judge(c("field_name"), F.coalesce("value", F.lit("")), c("_values"))["failures"]))
    ok = c("failures") == 0
    state = F.when(edits & ok, OVERRIDE).when(edits | (act == "LEAVE_UNRESOLVED"), HUMAN).when(act == "MARK_NOT_APPLICABLE", "INAPPLICABLE").otherwise(c("state"))
    out = out.withColumns({"state": state, "action": F.when(c("_touched"), act).otherwise(c("_earlier")), "resolution": F.when(edits & ok, "HUMAN_CORRECTED").when(edits, "VALIDATION_FAILED")})
    return out.select(*columns, "action", "failures", "resolution", "_touched")


def reviewed_fields(fields: DataFrame, actions: DataFrame, judge: Judge = claim_judge) -> DataFrame:
    """fields (doc, page, field_name, value, state) after review, with ``action``, ``failures`` and ``resolution``.

    actions: (doc, page, field_name, seq, action, new_value); a field's last one counts. Only fields with an edit are judged: their
    page's values after all edits are what the rules see. The rows of other pages go through as they are.
    """
    return _review(fields.drop("action"), actions, judge).drop("_touched")


def document_counters(fields: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(doc, fields, unresolved, inapplicable, flagged, accepted, overridden, coverage, review_required, review_completed, status) of documents."""
    c = F.col
    resolved = F.coalesce(c("state").isin(*RESOLVED), F.lit(False))
    n = lambda cond: F.count_if(cond)
    counts = fields.groupBy("doc").agg(
        F.count("*").alias("fields"), n(~resolved).alias("unresolved"), n(c("state") == "INAPPLICABLE").alias("inapplicable"), n(c("state") == FLAG).alias("flagged"), n(c("state") == ACCEPT).alias("accepted"), n(c("state") == OVERRIDE).alias("overridden"),
        n(resolved & (c("state") != "INAPPLICABLE")).alias("_covered"), n(c("action").isNotNull() & resolved).alias("review_completed"),
    )
    out = counts.withColumns({"coverage": ratio(c("_covered"), c("fields") - c("inapplicable"), 6), "review_required": c("unresolved"), "status": F.when(c("unresolved") > 0, "PARTIAL").otherwise("COMPLETED")}).drop("_covered")
    if rejected is None:
        return out
    gone = rejected.select("doc").distinct().withColumn("_gone", F.lit(True))
    return out.join(gone, "doc", "left").withColumn("status", F.when(c("_gone"), "FAILED").otherwise(c("status"))).drop("_gone")


def revalidate(fields: DataFrame, counters: DataFrame, actions: DataFrame, judge: Judge = claim_judge) -> tuple[DataFrame, DataFrame]:
    """(fields, counters) after review: documents without an action keep the counters that they had; the others' are counted anew.

    fields: as for reviewed_fields, with the ``action`` of earlier reviews or null.
    """
    done = _review(fields, actions, judge)
    anew = document_counters(done.filter("_touched"), actions.filter("action = 'REJECT_DOCUMENT'"))
    rest = counters.join(actions.select("doc").distinct(), "doc", "left_anti")
    return done.drop("_touched"), anew.unionByName(rest.select(*anew.columns))


def dataset_evaluation(documents: DataFrame, links: DataFrame, expected: DataFrame, compared: DataFrame, false_positives: DataFrame) -> DataFrame:
    """One row: how documents were paired with expected records, and how right their fields are.

    documents: (doc, role, status); links: (doc, status, matched); expected: (record); compared: (doc, field_name, outcome, critical);
    false_positives: (doc, field_name). Only documents that produced output are paired and compared.
    """
    c = F.col
    claim = c("role") == "CLAIM_DOCUMENT"
    found = documents.agg(F.count_if(claim & ~c("status").isin("DUPLICATE", "CANCELLED")).alias("documents_found"))
    produced = documents.filter(c("status").isin("COMPLETED", "PARTIAL")).select("doc").distinct()
    sure = (c("status") == "deterministic") & c("matched").isNotNull()
    paired = links.join(produced, "doc", "left_semi").agg(
        F.count_if(c("status") == "deterministic").alias("deterministic_pairs"), F.count_if(c("status") == "ambiguous").alias("ambiguous_pairs"), F.count_if(c("status") == "no_match").alias("documents_without_match"), F.count_distinct(F.when(sure, c("matched"))).alias("_matched")
    )
    records = expected.agg(F.count_distinct("record").alias("expected_records_found"))
    own = compared.join(produced, "doc", "left_semi")
    is_ = lambda k: F.count_if(c("outcome") == k)
    right = c("outcome") == "correct"
    fields = own.agg(
        F.count_distinct("doc").alias("documents_evaluated"), F.count("*").alias("evaluated_fields"), is_("correct").alias("correct_fields"), is_("incorrect").alias("incorrect_fields"), is_("missing").alias("missing_fields"), F.count_if("critical").alias("critical_fields"), F.count_if(c("critical") & right).alias("critical_correct_fields")
    )
    wrong = false_positives.join(produced, "doc", "left_semi").agg(F.count("*").alias("false_positive_fields"))
    one = found.join(paired).join(records).join(fields).join(wrong)  # a row each
    return one.withColumns(
        {
            "unmatched_documents": c("documents_found") - c("deterministic_pairs"),
            "unmatched_expected_records": F.greatest(F.lit(0), c("expected_records_found") - c("_matched")),
            "accuracy": ratio(c("correct_fields"), c("evaluated_fields"), 6),
            "precision": ratio(c("correct_fields"), c("correct_fields") + c("incorrect_fields") + c("false_positive_fields"), 6),
            "recall": ratio(c("correct_fields"), c("evaluated_fields"), 6),
            "critical_accuracy": ratio(c("critical_correct_fields"), c("critical_fields"), 6),
        }
    ).drop("_matched")


def evaluation_by_field(compared: DataFrame, false_positives: DataFrame) -> DataFrame:
    """(field_name, evaluated, correct, incorrect, missing, false_positives, accuracy), fields that are only false positives too."""
    c = F.col
    rows = compared.select("field_name", "outcome").unionByName(false_positives.select("field_name", F.lit("false_positive").alias("outcome")))
    is_ = lambda k: F.count_if(c("outcome") == k)
    out = rows.groupBy("field_name").agg(F.count_if(c("outcome") != "false_positive").alias("evaluated"), is_("correct").alias("correct"), is_("incorrect").alias("incorrect"), is_("missing").alias("missing"), is_("false_positive").alias("false_positives"))
    return out.withColumn("accuracy", ratio(c("correct"), c("evaluated"), 6))


def retry_arms(fields: DataFrame) -> DataFrame:
    """(retry_on, tier, fields, accuracy, shares of states, retried, resolved, still_wrong, retry_usd, usd_per_retried): both arms, by tier and overall.

    fields: (retry_on, tier, state, correct, retried, retry_usd).
    """
    c = F.col
    share = lambda s: F.bround(100.0 * F.count_if(c("state") == s) / F.count("*"), 4).alias(f"{s.lower()}_pct")
    usd = F.sum(F.when(c("retried"), c("retry_usd")).otherwise(0.0).cast("decimal(38,10)"))
    out = fields.groupingSets([["retry_on", "tier"], ["retry_on"]], "retry_on", "tier").agg(
        F.count("*").alias("fields"), F.bround(F.count_if("correct") / F.count("*"), 6).alias("accuracy"), *(share(s) for s in (ACCEPT, FLAG, RETRY, ESCALATE, HUMAN)),
        F.count_if("retried").alias("retried"), F.count_if(c("retried") & c("correct") & c("state").isin(ACCEPT, FLAG)).alias("resolved"), F.count_if(c("retried") & ~c("correct")).alias("still_wrong"), usd.cast("double").alias("retry_usd"),
    )
    return out.withColumn("usd_per_retried", F.bround(F.coalesce(F.try_divide(c("retry_usd"), c("retried")), F.lit(0.0)), 10))


def retry_ablation(arms: DataFrame) -> DataFrame:
    """One row: what second readings save of paid calls, from the overall rows of retry_arms."""
    c = F.col
    whole = arms.filter("tier is null")
    on, off = (whole.filter(c("retry_on") == flag).select(*(c(n).alias(f"{name}_{n}") for n in whole.columns)) for name, flag in (("on", True), ("off", False)))
    both = on.join(off)  # a row each
    need, still = c("off_retry_pct"), c("on_escalate_pct")
    return both.select(
        need.alias("needing_more_pct"), still.alias("still_paid_pct"), F.bround(need - still, 4).alias("avoided_pct"), ratio(c("on_resolved"), c("on_retried"), 6).alias("resolved_share"), c("on_usd_per_retried").alias("usd_per_avoided"), c("off_accuracy").alias("accuracy_off"), c("on_accuracy").alias("accuracy_on")
    )


def display_rows(fields: DataFrame) -> DataFrame:
    """(doc, page, field_name, shown, label, confidence_pct) as a table of fields shows them, the open ones first."""
    c = F.col
    label = F.when(c("state") == HUMAN, "needs review").when(c("state") == FLAG, "accepted with flag").when(c("state") == OVERRIDE, "corrected").when(c("state") == "INAPPLICABLE", "not applicable").when(c("state").isin(RETRY, ESCALATE), "in progress").otherwise("accepted")
    rows = fields.select("doc", "page", "field_name", F.when(blank(c("value")), "-").otherwise(c("value")).alias("shown"), label.alias("label"), F.bround(100 * c("confidence"), 1).alias("confidence_pct"), F.coalesce(c("state").isin(*RESOLVED), F.lit(False)).alias("resolved"))
    return rows
