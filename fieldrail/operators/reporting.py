"""Reports over pages, fields and documents: runs by tier, receipts, batches, benchmark, bake-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import ACCEPT, ESCALATE, FLAG, HUMAN, RETRY, TERMINAL
from ..functions.text import blank, first_reason
from ..functions.typed import ratio
from .ledger import percentiles, total

#: Places of rates in reports.
PLACES = 8
_LOCAL_OPERATIONS = {"primary_ocr_usd": "ocr_", "retry_ocr_usd": "retry_"}
#: Fixed names: operations of a model's double, and those that are no call.
ORACLE, NO_CALLS = "escalate_offline-oracle", ("escalate_intent", "escalate_blocked")
# Fixed names of document states.
PRODUCED = ("COMPLETED", "PARTIAL")
IDLE = ("SKIPPED", "DUPLICATE", "CANCELLED")


def _n(when: Column) -> Column:
    return F.count_if(F.coalesce(when, F.lit(False)))


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def _rates(frame: DataFrame, pairs: dict[str, tuple[Column, Column]], places: int = PLACES) -> DataFrame:
    return frame.withColumns({name: ratio(a, b, places) for name, (a, b) in pairs.items()})


def _terminal(state: str) -> Column:
    return F.col(state).isin(*TERMINAL)


def run_report(fields: DataFrame, pages: DataFrame, by: str = "tier") -> DataFrame:
    """A frozen run by tier and as a whole (tier null): counts, rates, costs a page, latency, throughput.

    fields: tier, included, right, criticality, first_state, before_state (before a model), state, retried.
    pages: tier, doc_id, wall_ms, local_usd, projected_usd.
    """
    c = F.col
    own = fields.groupingSets([[by], []], by).agg(
        F.count("*").alias("routed_fields"),
        _n(c("included")).alias("evaluated_fields"),
        _n(c("included") & c("right")).alias("correct_fields"),
        _n(c("included") & (c("criticality") == "high")).alias("critical_fields"),
        _n(c("included") & (c("criticality") == "high") & c("right")).alias("critical_correct"),
        _n(c("included") & c("right") & _terminal("state")).alias("automated_correct"),
        _n(_terminal("first_state")).alias("primary_resolved"),
        _n(c("retried")).alias("retried_fields"),
        _n(c("retried") & _terminal("before_state")).alias("retry_resolved"),
        _n(c("before_state") == ESCALATE).alias("escalated_fields"),
        _n((c("before_state") == ESCALATE) & _terminal("state")).alias("escalated_resolved"),
        _n((c("before_state") == ESCALATE) & _terminal("state") & c("right")).alias("escalated_correct"),
        _n(c("state") == FLAG).alias("flagged"),
        _n(c("state") == HUMAN).alias("human"),
    )
    own = _rates(
        own,
        {
            "field_accuracy": (c("correct_fields"), c("evaluated_fields")),
            "critical_field_accuracy": (c("critical_correct"), c("critical_fields")),
            "automated_exact_match_rate": (c("automated_correct"), c("evaluated_fields")),
            "primary_local_resolution_rate": (c("primary_resolved"), c("routed_fields")),
            "local_retry_rate": (c("retried_fields"), c("routed_fields")),
            "local_retry_resolution_rate": (c("retry_resolved"), c("retried_fields")),
            "escalation_rate": (c("escalated_fields"), c("routed_fields")),
            "escalation_resolution_rate": (c("escalated_resolved"), c("escalated_fields")),
            "accept_with_flag_rate": (c("flagged"), c("routed_fields")),
            "human_review_rate": (c("human"), c("routed_fields")),
        },
    )
    costs = pages.groupingSets([[by], []], by).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pages"), total(c("wall_ms")).alias("wall_ms"), total(c("local_usd")).alias("local_usd"), total(c("projected_usd")).alias("projected_usd"))
    # every page counts for its tier and for the whole
    twice = pages.select(F.explode(F.array(c(by), F.lit(None).cast("string"))).alias(by), "wall_ms")
    ranks = percentiles(twice, by, "wall_ms").withColumnsRenamed({"p50": "p50_latency_ms", "p95": "p95_latency_ms"})
    out = own.withColumnRenamed(by, "_t").join(costs, c("_t").eqNullSafe(costs[by])).drop("_t").withColumnRenamed(by, "_t")
    out = out.join(ranks, c("_t").eqNullSafe(ranks[by])).drop("_t")
    return _rates(
        out,
        {
            "local_usd_per_page": (c("local_usd"), c("pages")),
            "projected_api_usd_per_page": (c("projected_usd"), c("pages")),
            "projected_usd_per_page": (c("local_usd") + c("projected_usd"), c("pages")),
            "projected_usd_per_correct_escalated": (c("projected_usd"), c("escalated_correct")),
            "latency_ms_per_page": (c("wall_ms"), c("pages")),
            "pages_per_minute": (c("pages") * 60_000, c("wall_ms")),
            "pages_per_hour": (c("pages") * 3_600_000, c("wall_ms")),
        },
    )


PAGE_COUNTS = ("total_fields", "primary_resolved", "retry_routed", "retry_resolved", "escalated", "unresolved", "human", "correct", "critical", "critical_correct")


def escalation_report(pages: DataFrame, fields: DataFrame, expected: DataFrame, by: str = "tier") -> DataFrame:
    """Counts by tier and blended (tier null) of a run with model calls; blended only if each expected (doc_id, tier) is there.

    pages: doc_id, tier, PAGE_COUNTS, local_usd, latency_ms.
    fields (what was escalated): tier, state, right, rejected, cached, api_usd, projected_usd.
    """
    c = F.col
    own = pages.groupingSets([[by], []], by).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pages"), *map(_sum, PAGE_COUNTS), total(c("local_usd")).alias("local_usd"), total(c("latency_ms")).alias("latency_ms"))
    calls = fields.groupingSets([[by], []], by).agg(
        _n(_terminal("state")).alias("escalated_resolved"),
        _n(_terminal("state") & c("right")).alias("escalated_correct"),
        _n(c("rejected")).alias("grounding_rejected"),
        _n(c("cached")).alias("cache_hits"),
        total(c("api_usd")).alias("api_usd"),
        total(c("projected_usd")).alias("projected_usd"),
    )
    out = own.withColumnRenamed(by, "_t").join(calls, c("_t").eqNullSafe(calls[by]), "left").drop(by).withColumnRenamed("_t", by)
    names = ("escalated_resolved", "escalated_correct", "grounding_rejected", "cache_hits")
    out = out.fillna(0, list(names)).fillna(0.0, ["api_usd", "projected_usd"])
    missing = expected.select("doc_id", by).distinct().join(pages.select("doc_id", by).distinct(), ["doc_id", by], "left_anti").limit(1).agg(F.count("*").alias("_missing"))
    out = out.crossJoin(F.broadcast(missing)).filter(c(by).isNotNull() | (c("_missing") == 0)).drop("_missing")
    return _rates(
        out,
        {
            "primary_resolution_rate": (c("primary_resolved"), c("total_fields")),
            "retry_routing_rate": (c("retry_routed"), c("total_fields")),
            "retry_resolution_rate": (c("retry_resolved"), c("retry_routed")),
            "escalation_rate": (c("escalated"), c("total_fields")),
            "escalation_resolution_rate": (c("escalated_resolved"), c("escalated")),
            "grounding_rejection_rate": (c("grounding_rejected"), c("escalated")),
            "cache_hit_rate": (c("cache_hits"), c("escalated")),
            "unresolved_rate": (c("unresolved"), c("total_fields")),
            "human_review_rate": (c("human"), c("total_fields")),
            "field_accuracy": (c("correct"), c("total_fields")),
            "critical_field_accuracy": (c("critical_correct"), c("critical")),
            "latency_ms_per_page": (c("latency_ms"), c("pages")),
            "pages_per_minute": (c("pages") * 60_000, c("latency_ms")),
            "local_usd_per_page": (c("local_usd"), c("pages")),
            "api_usd_per_page": (c("api_usd"), c("pages")),
            "projected_api_usd_per_page": (c("projected_usd"), c("pages")),
            "usd_per_page": (c("local_usd") + c("api_usd"), c("pages")),
            "projected_total_usd_per_page": (c("local_usd") + c("projected_usd"), c("pages")),
            "usd_per_correct_escalated": (c("api_usd"), c("escalated_correct")),
            "projected_usd_per_correct_escalated": (c("projected_usd"), c("escalated_correct")),
        },
    )


def failures_by_field(fields: DataFrame) -> DataFrame:
    """(field_name, failures): escalated fields that are wrong or that nothing ended."""
    return fields.filter(~F.col("right") | ~_terminal("state")).groupBy("field_name").agg(F.count("*").alias("failures"))


def field_receipts(fields: DataFrame, attempts: DataFrame, stamps: DataFrame, keys: list[str]) -> DataFrame:
    """A row a field: its source, label, verdicts, first candidate of each rung, costs by basis.

    fields: keys, value, state, confidence, criticality; attempts: keys, attempt_no, rung, engine, value,
    latency_ms, cost_usd; stamps: keys, validator, verdict.
    """
    c = F.col
    final = attempts.join(fields.select(*keys, c("value").alias("_final")), keys)
    last = F.struct(F.coalesce(c("value") == c("_final"), F.lit(False)).alias("m"), c("attempt_no"))
    candidate = lambda rung: F.min_by("value", F.when(c("rung") == rung, c("attempt_no")))
    oracle = c("engine") == "offline-oracle"
    own = final.groupBy(*keys).agg(
        F.max_by("engine", last).alias("source_engine"),
        _n(c("rung") == "retry_ocr").alias("retry_count"),
        _n(c("rung") == "multimodal").alias("model_count"),
        candidate("primary_ocr").alias("primary_candidate"),
        candidate("retry_ocr").alias("retry_candidate"),
        candidate("multimodal").alias("model_candidate"),
        F.bround(total(c("latency_ms")), 2).alias("latency_ms"),
        F.bround(F.coalesce(total(F.when(~oracle, c("cost_usd"))), F.lit(0.0)), 8).alias("measured_usd"),
        F.bround(F.coalesce(total(F.when(oracle, c("cost_usd"))), F.lit(0.0)), 8).alias("projected_usd"),
    )
    seen = stamps.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("verdict")), ", ").alias("verdicts"), F.max((c("validator") == "service_line_activation") & (c("verdict") == "INAPPLICABLE")).alias("inapplicable"))
    out = fields.join(own, keys, "left").join(seen, keys, "left").fillna(0, ["retry_count", "model_count"]).fillna(0.0, ["latency_ms", "measured_usd", "projected_usd"])
    off = F.coalesce(c("inapplicable"), F.lit(False))
    label = first_reason((off, "Inapplicable"), (c("state") == HUMAN, "Human review"), (c("state") == FLAG, "Flagged"), (c("model_count") > 0, "AI escalated"), (c("retry_count") > 0, "Retried locally"), otherwise="Accepted")
    return out.select(
        *keys,
        "value",
        F.bround("confidence", 4).alias("confidence"),
        "criticality",
        F.coalesce("source_engine", F.lit("unknown")).alias("source_engine"),
        F.when(off, "INAPPLICABLE").otherwise(c("state")).alias("decision"),
        label.alias("status"),
        F.coalesce(F.nullif(c("verdicts"), F.lit("")), F.lit("NOT_APPLICABLE")).alias("verdicts"),
        c("retry_count").cast("long").alias("retry_count"),
        (c("model_count") > 0).alias("escalated"),
        "primary_candidate",
        "retry_candidate",
        "model_candidate",
        "latency_ms",
        "measured_usd",
        "projected_usd",
    )


def receipt_funnel(receipts: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    alone = (c("decision") == ACCEPT) & (c("retry_count") == 0) & ~c("escalated")
    out = receipts.groupBy(*keys).agg(F.count("*").alias("fields_detected"), _n(alone).alias("accepted_locally"), _n(c("decision") == FLAG).alias("accepted_with_flag"), _n(c("retry_count") > 0).alias("locally_retried"), _n(c("escalated")).alias("escalated"), _n(c("decision") == HUMAN).alias("human_review"))
    return out.withColumn("api_calls_avoided", c("fields_detected") - c("escalated"))


def receipt_costs(ledger: DataFrame, prices: DataFrame, keys: list[str], oracle_price: str) -> DataFrame:
    """A page's costs by basis and kind, and its tokens; token prices by model, the double's by ``oracle_price``.

    ledger: keys, operation, cost_usd, model, input_tokens, output_tokens; prices: model, input_usd, output_usd
    a million tokens. A model is also looked up by what follows its last slash.
    """
    c = F.col
    op = c("operation")
    oracle = op == ORACLE
    live = op.startswith("escalate_") & ~op.isin(ORACLE, *NO_CALLS)
    local = ~op.startswith("escalate_")
    short = F.element_at(F.split(c("model"), "/"), -1)
    named = ledger.withColumns({"_m": F.when(oracle, F.lit(oracle_price)).otherwise(c("model")), "_s": F.when(oracle, F.lit(oracle_price)).otherwise(short)})
    cost = prices.select(c("model").alias("_pm"), c("input_usd").alias("_i"), c("output_usd").alias("_o"))
    priced = named.join(cost, c("_m") == c("_pm"), "left").withColumnsRenamed({"_i": "_i1", "_o": "_o1"}).drop("_pm").join(cost, c("_s") == c("_pm"), "left")
    usd = lambda tokens, price: F.coalesce(c(tokens) * F.coalesce(c(f"_{price}1"), c(f"_{price}")) / 1_000_000, F.lit(0.0))
    sums = {name: total(F.when(local & op.startswith(prefix), c("cost_usd")).otherwise(0.0)) for name, prefix in _LOCAL_OPERATIONS.items()}
    sums |= {
        "local_usd": total(F.when(local, c("cost_usd")).otherwise(0.0)),
        "projected_api_usd": total(F.when(oracle, c("cost_usd")).otherwise(0.0)),
        "measured_api_usd": total(F.when(live, c("cost_usd")).otherwise(0.0)),
        "input_tokens_usd": total(F.when(live, usd("input_tokens", "i")).otherwise(0.0)),
        "output_tokens_usd": total(F.when(live, usd("output_tokens", "o")).otherwise(0.0)),
        "projected_input_tokens_usd": total(F.when(oracle, usd("input_tokens", "i")).otherwise(0.0)),
        "projected_output_tokens_usd": total(F.when(oracle, usd("output_tokens", "o")).otherwise(0.0)),
    }
    tokens = {n: F.coalesce(F.sum(F.when(oracle | live, c(n))), F.lit(0)) for n in ("input_tokens", "output_tokens")}
    out = priced.groupBy(*keys).agg(*(x.alias(n) for n, x in (sums | tokens).items()))
    out = out.withColumns({"other_local_usd": F.greatest(F.lit(0.0), c("local_usd") - c("primary_ocr_usd") - c("retry_ocr_usd")), "measured_usd": c("local_usd") + c("measured_api_usd"), "projected_usd": c("local_usd") + c("projected_api_usd")})
    return out.withColumns({n: F.bround(n, 8) for n in out.columns if n.endswith("_usd")})


def unify_receipts(pages: DataFrame, receipts: DataFrame, page_sums: tuple[Column, ...] = (), field_counts: tuple[Column, ...] = ()) -> DataFrame:
    """A document's pages as one: its type or mixed, counters of its fields, costs, state.

    page_sums and field_counts are further aggregates of the same passes; counts of documents without fields are 0.

    pages: doc_id, page, document_type, latency_ms, measured_usd, projected_usd.
    receipts: doc_id, page, decision, retry_count, escalated, eligible, calls, workflow (null: not with a model).
    """
    c = F.col
    one = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.min("document_type").alias("_lo"), F.max("document_type").alias("_hi"), F.bround(total(c("latency_ms")), 3).alias("latency_ms"), F.bround(total(c("measured_usd")), 9).alias("measured_usd"), F.bround(total(c("projected_usd")), 9).alias("projected_usd"), *page_sums)
    here = c("decision").isin(*TERMINAL) & ~c("escalated")
    counts = receipts.groupBy("doc_id").agg(
        F.count("*").alias("fields"),
        _n(here & (c("retry_count") == 0)).alias("accepted_without_retry"),
        _n(here & (c("retry_count") > 0)).alias("accepted_after_local_retry"),
        _n(c("decision") == ACCEPT).alias("accepted"),
        _n(c("decision") == FLAG).alias("accepted_with_flag"),
        _n(c("decision") == "INAPPLICABLE").alias("inapplicable"),
        _n(c("retry_count") > 0).alias("fields_retried"),
        _n(c("decision") == RETRY).alias("pending_local_retry"),
        _n(c("escalated")).alias("multimodal_attempted"),
        _n(c("eligible")).alias("multimodal_eligible"),
        _n(c("workflow") == "MULTIMODAL_FAILED").alias("multimodal_failed"),
        _n(c("workflow") == "HUMAN_REVIEW_REQUIRED").alias("pending_human_review"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("external_calls"),
        _n(~c("decision").isin("INAPPLICABLE", *TERMINAL)).alias("unresolved_fields"),
        *field_counts,
    )
    names = [n for n in counts.columns if n != "doc_id"]
    out = one.join(counts, "doc_id", "left").fillna(0, names)
    out = out.withColumns({"document_type": F.when(c("_lo") == c("_hi"), c("_lo")).otherwise("mixed"), "paid_calls_avoided": F.greatest(F.lit(0), c("fields") - c("inapplicable") - c("external_calls"))})
    state = first_reason((c("fields") == 0, "FAILED_EXTRACTION"), (c("unresolved_fields") > 0, "PARTIAL"), otherwise="COMPLETED")
    return out.withColumn("processing_status", state).drop("_lo", "_hi")


BATCH_SUMS = ("fields", "accepted", "accepted_with_flag", "fields_retried", "accepted_after_local_retry", "accepted_without_retry", "unresolved_fields", "inapplicable", "multimodal_attempted", "multimodal_failed", "pending_human_review", "external_calls", "applicable_fields", "fields_produced", "validated_fields", "critical_fields", "critical_resolved")


def batch_summary(documents: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row of a batch: states, counters of documents with output, rates, costs, throughput; accuracy is never claimed here.

    more: further aggregates of the same pass.

    documents: unify_receipts() with applicable_fields, fields_produced, validated_fields, critical_fields, critical_resolved.
    """
    c, state = F.col, F.col("processing_status")
    made, counted = state.isin(*PRODUCED), ~state.isin(*IDLE)
    own = lambda name: F.coalesce(F.sum(F.when(made, c(name))), F.lit(0)).alias(name)
    out = documents.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.when(counted, c("page_count"))), F.lit(0)).alias("pages"),
        *(_n(state == s).alias(s.lower()) for s in ("COMPLETED", "PARTIAL", "FAILED_EXTRACTION", "FAILED", "CANCELLED")),
        _n(state.isin("SKIPPED", "DUPLICATE")).alias("skipped"),
        _n(counted).alias("_counted"),
        *map(own, BATCH_SUMS),
        F.bround(F.coalesce(total(F.when(counted, c("measured_usd"))), F.lit(0.0)), 9).alias("measured_usd"),
        F.bround(F.coalesce(total(F.when(counted, c("projected_usd"))), F.lit(0.0)), 9).alias("projected_usd"),
        F.bround(F.coalesce(total(F.when(counted, c("latency_ms"))), F.lit(0.0)), 3).alias("latency_ms"),
        *more,
    )
    out = _rates(
        out,
        {
            "critical_resolution_rate": (c("critical_resolved"), c("critical_fields")),
            "primary_resolution_rate": (c("accepted_without_retry"), c("applicable_fields")),
            "retry_resolution_rate": (c("accepted_after_local_retry"), c("fields_retried")),
            "multimodal_resolution_rate": (F.greatest(F.lit(0), c("multimodal_attempted") - c("multimodal_failed")), c("multimodal_attempted")),
            "human_review_rate": (c("pending_human_review"), c("applicable_fields")),
            "mean_latency_ms": (c("latency_ms"), c("_counted")),
            "pages_per_minute": (c("pages") * 60_000, c("latency_ms")),
        },
        6,
    )
    return out.drop("_counted")


def document_types(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("processing_status").isin(*PRODUCED)).groupBy("document_type").agg(F.count("*").alias("documents"))


def benchmark_tiers(containers: DataFrame, records: DataFrame) -> DataFrame:
    """A row a tier, and one for all (tier null) whose accuracy is withheld while any container has no sure record.

    containers: tier, page_count, status, evaluated, correct, present, local_usd, claim_page_right (null: can't be
    judged), attachments, attachments_right; records: tier, records.
    """
    c = F.col
    out = containers.groupingSets([["tier"], []], "tier").agg(
        F.count("*").alias("containers"),
        _sum("page_count"),
        _n(c("status") == "deterministic").alias("deterministic"),
        _sum("evaluated"),
        _sum("correct"),
        _sum("present"),
        total(c("local_usd")).alias("local_usd"),
        _n(c("claim_page_right")).alias("claim_page_right"),
        F.count("claim_page_right").alias("claim_page_evaluable"),
        _sum("attachments"),
        _sum("attachments_right"),
    )
    parsed = records.groupingSets([["tier"], []], "tier").agg(F.sum("records").alias("records")).withColumnRenamed("tier", "_t")
    out = out.join(parsed, c("tier").eqNullSafe(c("_t")), "left").drop("_t").withColumn("ambiguous", c("containers") - c("deterministic"))
    told = c("tier").isNotNull() | (c("ambiguous") == 0)
    out = _rates(out, {"field_accuracy": (c("correct"), c("evaluated")), "present_rate": (c("present"), c("evaluated")), "claim_page_accuracy": (c("claim_page_right"), c("claim_page_evaluable")), "attachment_accuracy": (c("attachments_right"), c("attachments"))})
    return out.withColumns({n: F.when(told, c(n)) for n in ("field_accuracy", "present_rate")})


def router_report(rows: DataFrame) -> DataFrame:
    """By tier and as a whole: router accuracy, pages with ink failures, clean pages that were changed, quality before and after."""
    c = F.col
    mean = lambda name, places: F.bround(F.avg(c(name).cast("decimal(20,8)")).cast("double"), places)
    out = rows.groupingSets([["tier"], []], "tier").agg(F.count("*").alias("pages"), _n(c("routed") == c("form")).alias("right"), _n(c("ink_failures") > 0).alias("ink_failures"), _n((c("tier") == "clean") & (c("ops") > 0)).alias("clean_modified"), mean("q_before", 3).alias("q_before"), mean("q_after", 3).alias("q_after"), mean("ms", 1).alias("mean_ms"))
    return out.withColumn("router_accuracy", ratio(c("right"), c("pages"), 4)).drop("right")


def router_errors(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("routed") != F.col("form")).select("doc_id", "tier", "routed")


def _mean(value: Column) -> Column:
    return F.bround(F.avg(value.cast("decimal(20,8)")).cast("double"), 4)


def bakeoff_matrix(rows: DataFrame) -> DataFrame:
    """(engine, prep, tier) with means of accuracy, recall, time and cost, and the share of failures."""
    c = F.col
    return rows.groupBy("engine", "prep", "tier").agg(_mean(c("field_acc")).alias("field_acc"), _mean(c("word_recall")).alias("word_recall"), _mean(c("ocr_ms")).alias("ocr_ms"), _mean(c("cost_usd")).alias("cost_usd"), _mean(c("fail").cast("int")).alias("failure_rate"), F.count("*").alias("pages"))


def accuracy_per_dollar(rows: DataFrame) -> DataFrame:
    """Engines over prepared pages, the best first: accuracy for a dollar (a missing cost counts as 1e-9)."""
    c = F.col
    out = rows.filter("prep").groupBy("engine").agg(_mean(c("field_acc")).alias("acc"), _mean(c("cost_usd")).alias("cost"))
    cost = F.when(c("cost") == 0, 1e-9).otherwise(c("cost"))
    return out.withColumn("acc_per_dollar", F.bround(c("acc") / cost, 0).cast("long")).orderBy(F.desc("acc_per_dollar"), "engine")


def top_missed(rows: DataFrame, hits: str, k: int = 12) -> DataFrame:
    """The k fields that prepared pages miss most; hits is a map of field to whether it was right."""
    one = rows.filter("prep").select(F.explode(hits).alias("field_name", "ok")).filter("not ok")
    return one.groupBy("field_name").agg(F.count("*").alias("misses")).orderBy(F.desc("misses"), "field_name").limit(k)


def session_report(calls: DataFrame, limit_usd: float) -> DataFrame:
    """A session's calls: what was spent, what it would have been without the cache, and the difference as a saving.

    calls: session, decision (ALLOW or a reuse), billed_usd, avoided_usd.
    """
    c = F.col
    paid = c("decision") == "ALLOW"
    out = calls.groupBy("session").agg(_n(paid).alias("calls_made"), _n(c("decision").isin("REUSED_CACHED_RESULT", "BLOCKED_DUPLICATE_REQUEST")).alias("paid_calls_avoided"), F.coalesce(total(F.when(paid, c("billed_usd"))), F.lit(0.0)).alias("m"), F.coalesce(total(F.when(~paid, c("avoided_usd"))), F.lit(0.0)).alias("a"))
    out = out.withColumns({"measured_usd": F.bround("m", 8), "projected_uncached_usd": F.bround(c("m") + c("a"), 8)})
    return out.withColumns({"cache_savings_usd": F.bround(c("projected_uncached_usd") - c("measured_usd"), 8), "remaining_usd": F.bround(limit_usd - c("m"), 8)}).drop("m", "a")


def metric_list(tiers: DataFrame, metrics: dict[str, str], scope: str = "tier") -> DataFrame:
    """(scope, metric, value, evidence): columns of a report as labelled rows; each metric has its class of evidence."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(e).alias("evidence")) for m, e in metrics.items()))
    return tiers.select(F.coalesce(F.col(scope), F.lit("all")).alias("scope"), F.inline(pairs))


def stamps_for_display(stamps: DataFrame) -> DataFrame:
    """Stamps with a severity and a dash for no detail."""
    return stamps.withColumns({"severity": F.when(F.col("verdict") == "FAIL", "ERROR").otherwise("INFO"), "message": F.when(blank(F.col("detail")), "—").otherwise(F.col("detail"))})


def evaluation_display(pairs: Column, denominator: Column, accuracy: Column) -> Column:
    """An accuracy, or null where nothing was compared."""
    return F.when((F.coalesce(pairs, F.lit(0)) > 0) & (F.coalesce(denominator, F.lit(0)) > 0), accuracy)


def eligible_queue(queue: DataFrame, escalations: DataFrame, keys: list[str]) -> DataFrame:
    """What of the review queue a model may be asked about."""
    able = escalations.filter(F.col("eligible") & (F.col("workflow") == "HUMAN_REVIEW_REQUIRED")).select(*keys).distinct()
    return queue.join(able, keys, "left_semi")
