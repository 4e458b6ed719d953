"""Queries of run reports, receipts, batches and the benchmark, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reporting as R
from . import bind as B

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = B.exact_rounds(sql)
        return f

    return keep


_DONE = "('ACCEPT', 'ACCEPT_WITH_FLAG', 'ACCEPT_WITH_OVERRIDE')"


def _count(when: str, name: str) -> str:
    return f"COUNT(*) FILTER ({when}) AS {name}"


def _money(x: str) -> str:
    return f"COALESCE(CAST(SUM(CAST({x} AS DECIMAL(38,8))) AS DOUBLE), 0)"


def _rates(pairs: dict[str, tuple[str, str]], places: int = R.PLACES) -> str:
    return ", ".join(f"round_even(CAST({a} AS DOUBLE) / NULLIF({b}, 0), {places}) AS {n}" for n, (a, b) in pairs.items())


# runs ---------------------------------------------------------------------------
_RUN = "SELECT tier, NOT optional OR value <> '' AS included, correct AS `right`, criticality, CASE WHEN event_id % 7 < 4 THEN 'ACCEPT' ELSE 'RETRY' END AS first_state, CASE WHEN event_id % 9 = 0 THEN 'ESCALATE' ELSE state END AS before_state, state, retried FROM (" + B.FIELDS + ") f"
_RUN_PAGES = "SELECT CAST(user_id AS STRING) AS doc_id, CASE WHEN user_id % 3 = 0 THEN 'clean' WHEN user_id % 3 = 1 THEN 'noisy' ELSE 'ugly' END AS tier, event_id % 911 / 1e1 AS wall_ms, (event_id % 40) / 1e5 AS local_usd, (event_id % 7) / 1e4 AS projected_usd FROM {events}"


def _ansi(sql: str) -> str:
    return B.duck(sql).replace("`", '"')


_RUN_RATES = {
    "field_accuracy": ("correct_fields", "evaluated_fields"),
    "critical_field_accuracy": ("critical_correct", "critical_fields"),
    "automated_exact_match_rate": ("automated_correct", "evaluated_fields"),
    "primary_local_resolution_rate": ("primary_resolved", "routed_fields"),
    "local_retry_rate": ("retried_fields", "routed_fields"),
    "local_retry_resolution_rate": ("retry_resolved", "retried_fields"),
    "escalation_rate": ("escalated_fields", "routed_fields"),
    "escalation_resolution_rate": ("escalated_resolved", "escalated_fields"),
    "accept_with_flag_rate": ("flagged", "routed_fields"),
    "human_review_rate": ("human", "routed_fields"),
    "local_usd_per_page": ("local_usd", "pages"),
    "projected_api_usd_per_page": ("projected_usd", "pages"),
    "projected_usd_per_page": ("local_usd + projected_usd", "pages"),
    "projected_usd_per_correct_escalated": ("projected_usd", "escalated_correct"),
    "latency_ms_per_page": ("wall_ms", "pages"),
    "pages_per_minute": ("pages * 60000", "wall_ms"),
    "pages_per_hour": ("pages * 3600000", "wall_ms"),
}


@query(f"""WITH f AS ({_ansi(_RUN)}), p AS ({_ansi(_RUN_PAGES)}),
a AS (SELECT tier, COUNT(*) AS routed_fields, {_count('included', 'evaluated_fields')}, {_count('included AND "right"', 'correct_fields')}, {_count("included AND criticality = 'high'", 'critical_fields')},
  {_count("included AND criticality = 'high' AND " + '"right"', 'critical_correct')}, {_count(f'included AND "right" AND state IN {_DONE}', 'automated_correct')}, {_count(f'first_state IN {_DONE}', 'primary_resolved')}, {_count('retried', 'retried_fields')},
  {_count(f'retried AND before_state IN {_DONE}', 'retry_resolved')}, {_count("before_state = 'ESCALATE'", 'escalated_fields')}, {_count(f"before_state = 'ESCALATE' AND state IN {_DONE}", 'escalated_resolved')},
  {_count(f"before_state = 'ESCALATE' AND state IN {_DONE} AND " + '"right"', 'escalated_correct')}, {_count("state = 'ACCEPT_WITH_FLAG'", 'flagged')}, {_count("state = 'HUMAN_REVIEW'", 'human')} FROM f GROUP BY GROUPING SETS ((tier), ())),
b AS (SELECT tier, COUNT(DISTINCT doc_id) AS documents, COUNT(*) AS pages, {_money('wall_ms')} AS wall_ms, {_money('local_usd')} AS local_usd, {_money('projected_usd')} AS projected_usd, quantile_disc(wall_ms, 0.5) AS p50_latency_ms, quantile_disc(wall_ms, 0.95) AS p95_latency_ms FROM p GROUP BY GROUPING SETS ((tier), ())),
j AS (SELECT a.*, b.* EXCLUDE (tier) FROM a JOIN b ON a.tier IS NOT DISTINCT FROM b.tier)
SELECT *, {_rates(_RUN_RATES)} FROM j""")
def frozen_report(spark: SparkSession, d: str) -> DataFrame:
    """A frozen run by tier and as a whole."""
    return R.run_report(B.bind(spark, d, _RUN), B.bind(spark, d, _RUN_PAGES))


_ESC_PAGES = "SELECT CAST(user_id AS STRING) AS doc_id, CASE WHEN user_id % 3 = 0 THEN 'clean' WHEN user_id % 3 = 1 THEN 'noisy' ELSE 'ugly' END AS tier, event_id % 30 + 20 AS total_fields, event_id % 11 AS primary_resolved, event_id % 8 + 2 AS retry_routed, event_id % 5 AS retry_resolved, event_id % 6 + 1 AS escalated, event_id % 4 AS unresolved, event_id % 3 AS human, event_id % 17 + 3 AS correct, event_id % 9 + 4 AS critical, event_id % 9 AS critical_correct, (event_id % 40) / 1e5 AS local_usd, event_id % 911 / 1e1 AS latency_ms FROM {events}"
_ESC_FIELDS = "SELECT tier, field_name, state, correct AS `right`, event_id % 4 = 0 AS rejected, event_id % 5 = 0 AS cached, (event_id % 3) / 1e3 AS api_usd, projected_usd FROM (" + B.FIELDS + ") f WHERE event_id % 9 = 0"
_ESC_RATES = {
    "primary_resolution_rate": ("primary_resolved", "total_fields"),
    "retry_routing_rate": ("retry_routed", "total_fields"),
    "retry_resolution_rate": ("retry_resolved", "retry_routed"),
    "escalation_rate": ("escalated", "total_fields"),
    "escalation_resolution_rate": ("escalated_resolved", "escalated"),
    "grounding_rejection_rate": ("grounding_rejected", "escalated"),
    "cache_hit_rate": ("cache_hits", "escalated"),
    "unresolved_rate": ("unresolved", "total_fields"),
    "human_review_rate": ("human", "total_fields"),
    "field_accuracy": ("correct", "total_fields"),
    "critical_field_accuracy": ("critical_correct", "critical"),
    "latency_ms_per_page": ("latency_ms", "pages"),
    "pages_per_minute": ("pages * 60000", "latency_ms"),
    "local_usd_per_page": ("local_usd", "pages"),
    "api_usd_per_page": ("api_usd", "pages"),
    "projected_api_usd_per_page": ("projected_usd", "pages"),
    "usd_per_page": ("local_usd + api_usd", "pages"),
    "projected_total_usd_per_page": ("local_usd + projected_usd", "pages"),
    "usd_per_correct_escalated": ("api_usd", "escalated_correct"),
    "projected_usd_per_correct_escalated": ("projected_usd", "escalated_correct"),
}


@query(f"""WITH p AS ({_ansi(_ESC_PAGES)}), f AS ({_ansi(_ESC_FIELDS)}),
a AS (SELECT tier, COUNT(DISTINCT doc_id) AS documents, COUNT(*) AS pages, {', '.join(f'CAST(SUM({n}) AS BIGINT) AS {n}' for n in R.PAGE_COUNTS)}, {_money('local_usd')} AS local_usd, {_money('latency_ms')} AS latency_ms FROM p GROUP BY GROUPING SETS ((tier), ())),
b AS (SELECT tier, {_count(f'state IN {_DONE}', 'escalated_resolved')}, {_count(f'state IN {_DONE} AND "right"', 'escalated_correct')}, {_count('rejected', 'grounding_rejected')}, {_count('cached', 'cache_hits')}, {_money('api_usd')} AS api_usd, {_money('projected_usd')} AS projected_usd FROM f GROUP BY GROUPING SETS ((tier), ())),
j AS (SELECT a.*, b.* EXCLUDE (tier) FROM a JOIN b ON a.tier IS NOT DISTINCT FROM b.tier)
SELECT *, {_rates(_ESC_RATES)} FROM j""")
def escalation_report(spark: SparkSession, d: str) -> DataFrame:
    """A run with model calls by tier, blended as every document is there."""
    pages = B.bind(spark, d, _ESC_PAGES)
    return R.escalation_report(pages, B.bind(spark, d, _ESC_FIELDS), pages.select("doc_id", "tier"))


@query(f"""SELECT field_name, COUNT(*) AS failures FROM ({_ansi(_ESC_FIELDS)}) f WHERE NOT "right" OR state NOT IN {_DONE} GROUP BY field_name""")
def failures_by_field(spark: SparkSession, d: str) -> DataFrame:
    """Escalated fields that failed, by name."""
    return R.failures_by_field(B.bind(spark, d, _ESC_FIELDS))


# receipts -------------------------------------------------------------------------
_KEYS = ["doc", "field"]
_REC_FIELDS = "SELECT user_id AS doc, event_type AS field, 'v' || CAST(MIN(event_id) AS STRING) AS value, CASE WHEN MIN(event_id) % 5 = 0 THEN 'HUMAN_REVIEW' WHEN MIN(event_id) % 5 = 1 THEN 'ACCEPT_WITH_FLAG' WHEN MIN(event_id) % 5 = 2 THEN 'RETRY' ELSE 'ACCEPT' END AS state, (MIN(event_id) % 1000) / 1e3 AS confidence, CASE WHEN MIN(event_id) % 3 = 0 THEN 'high' ELSE 'low' END AS criticality FROM {events} GROUP BY user_id, event_type"
_REC_ATTEMPTS = "SELECT user_id AS doc, event_type AS field, event_id AS attempt_no, CASE WHEN event_id % 5 < 3 THEN 'primary_ocr' WHEN event_id % 5 = 3 THEN 'retry_ocr' ELSE 'multimodal' END AS rung, CASE WHEN event_id % 4 = 0 THEN 'offline-oracle' WHEN event_id % 4 = 1 THEN 'paddle' ELSE 'tess' END AS engine, 'v' || CAST(event_id AS STRING) AS value, (event_id % 500) / 1e1 AS latency_ms, (event_id % 90) / 1e5 AS cost_usd FROM {events} WHERE event_id % 6 <> 5"
_REC_STAMPS = "SELECT user_id AS doc, event_type AS field, CASE WHEN event_id % 40 = 0 THEN 'service_line_activation' ELSE 'currency_format' END AS validator, CASE WHEN event_id % 40 = 0 THEN 'INAPPLICABLE' WHEN event_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'd' || CAST(event_id % 9 AS STRING) END AS detail FROM {events} WHERE event_id % 4 <> 1"
_RECEIPTS = f"""f AS ({_ansi(_REC_FIELDS)}), a AS (SELECT x.*, f.value AS fin FROM ({_ansi(_REC_ATTEMPTS)}) x JOIN f ON x.doc = f.doc AND x.field = f.field), s AS ({_ansi(_REC_STAMPS)}),
ag AS (SELECT doc, field, COALESCE(arg_max(engine, attempt_no) FILTER (value = fin), arg_max(engine, attempt_no)) AS engine, {_count("rung = 'retry_ocr'", 'rc')}, {_count("rung = 'multimodal'", 'mc')}, arg_min(value, attempt_no) FILTER (rung = 'primary_ocr') AS primary_candidate,
  arg_min(value, attempt_no) FILTER (rung = 'retry_ocr') AS retry_candidate, arg_min(value, attempt_no) FILTER (rung = 'multimodal') AS model_candidate, round_even({_money('latency_ms')}, 2) AS latency_ms,
  round_even({_money("CASE WHEN engine <> 'offline-oracle' THEN cost_usd END")}, 8) AS measured_usd, round_even({_money("CASE WHEN engine = 'offline-oracle' THEN cost_usd END")}, 8) AS projected_usd FROM a GROUP BY doc, field),
sg AS (SELECT doc, field, array_to_string(list_sort(list_distinct(list(verdict))), ', ') AS verdicts, bool_or(validator = 'service_line_activation' AND verdict = 'INAPPLICABLE') AS off FROM s GROUP BY doc, field),
receipts AS (SELECT f.doc, f.field, f.value, round_even(confidence, 4) AS confidence, criticality, COALESCE(engine, 'unknown') AS source_engine, CASE WHEN COALESCE(off, false) THEN 'INAPPLICABLE' ELSE state END AS decision,
  CASE WHEN COALESCE(off, false) THEN 'Inapplicable' WHEN state = 'HUMAN_REVIEW' THEN 'Human review' WHEN state = 'ACCEPT_WITH_FLAG' THEN 'Flagged' WHEN COALESCE(mc, 0) > 0 THEN 'AI escalated' WHEN COALESCE(rc, 0) > 0 THEN 'Retried locally' ELSE 'Accepted' END AS status,
  COALESCE(verdicts, 'NOT_APPLICABLE') AS verdicts, COALESCE(rc, 0) AS retry_count, COALESCE(mc, 0) > 0 AS escalated, primary_candidate, retry_candidate, model_candidate, COALESCE(latency_ms, 0) AS latency_ms, COALESCE(measured_usd, 0) AS measured_usd, COALESCE(projected_usd, 0) AS projected_usd
  FROM f LEFT JOIN ag ON f.doc = ag.doc AND f.field = ag.field LEFT JOIN sg ON f.doc = sg.doc AND f.field = sg.field)
"""


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    return R.field_receipts(B.bind(spark, d, _REC_FIELDS), B.bind(spark, d, _REC_ATTEMPTS), B.bind(spark, d, _REC_STAMPS), _KEYS)


@query(f"WITH {_RECEIPTS} SELECT * FROM receipts")
def field_receipts(spark: SparkSession, d: str) -> DataFrame:
    """A receipt for each field."""
    return _receipts(spark, d)


@query(f"""WITH {_RECEIPTS} SELECT doc, COUNT(*) AS fields_detected, {_count("decision = 'ACCEPT' AND retry_count = 0 AND NOT escalated", 'accepted_locally')}, {_count("decision = 'ACCEPT_WITH_FLAG'", 'accepted_with_flag')}, {_count('retry_count > 0', 'locally_retried')}, {_count('escalated', 'escalated')},
  {_count("decision = 'HUMAN_REVIEW'", 'human_review')}, COUNT(*) - COUNT(*) FILTER (escalated) AS api_calls_avoided FROM receipts GROUP BY doc""")
def receipt_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How a page's fields were resolved."""
    return R.receipt_funnel(_receipts(spark, d), ["doc"])


@query(f"""SELECT doc, field, validator, verdict, detail, CASE WHEN verdict = 'FAIL' THEN 'ERROR' ELSE 'INFO' END AS severity, CASE WHEN detail = '' THEN '—' ELSE detail END AS message FROM ({_ansi(_REC_STAMPS)}) s""")
def stamps_for_display(spark: SparkSession, d: str) -> DataFrame:
    """Stamps as a person reads them."""
    return R.stamps_for_display(B.bind(spark, d, _REC_STAMPS))


_COSTS = "SELECT user_id AS doc, CASE event_id % 7 WHEN 0 THEN 'ocr_paddle' WHEN 1 THEN 'retry_tess' WHEN 2 THEN 'escalate_offline-oracle' WHEN 3 THEN 'escalate_live' WHEN 4 THEN 'escalate_intent' WHEN 5 THEN 'map' ELSE 'escalate_blocked' END AS operation, (event_id % 90) / 1e5 AS cost_usd, CASE WHEN event_id % 3 = 0 THEN 'host/small' WHEN event_id % 3 = 1 THEN 'large' ELSE 'none' END AS model, event_id % 900 AS input_tokens, event_id % 70 AS output_tokens FROM {events}"
_PRICES = (("small", 0.05, 0.2), ("large", 0.4, 1.6))


@query(f"""WITH l AS (SELECT *, operation LIKE 'escalate#_%' ESCAPE '#' AS e FROM ({_ansi(_COSTS)}) x), p(model, i, o) AS (VALUES {', '.join(map(str, _PRICES))}),
k AS (SELECT l.*, operation = 'escalate_offline-oracle' AS oracle, operation = 'escalate_live' AS live, p.i, p.o FROM l LEFT JOIN p ON p.model = CASE WHEN operation = 'escalate_offline-oracle' THEN 'large' ELSE regexp_replace(l.model, '^.*/', '') END),
s AS (SELECT doc, {_money("CASE WHEN operation LIKE 'ocr#_%' ESCAPE '#' THEN cost_usd END")} AS primary_ocr_usd, {_money("CASE WHEN operation LIKE 'retry#_%' ESCAPE '#' THEN cost_usd END")} AS retry_ocr_usd, {_money('CASE WHEN NOT e THEN cost_usd END')} AS local_usd,
  {_money('CASE WHEN oracle THEN cost_usd END')} AS projected_api_usd, {_money('CASE WHEN live THEN cost_usd END')} AS measured_api_usd, {_money('CASE WHEN live THEN input_tokens * i / 1e6 END')} AS input_tokens_usd, {_money('CASE WHEN live THEN output_tokens * o / 1e6 END')} AS output_tokens_usd,
  {_money('CASE WHEN oracle THEN input_tokens * i / 1e6 END')} AS projected_input_tokens_usd, {_money('CASE WHEN oracle THEN output_tokens * o / 1e6 END')} AS projected_output_tokens_usd,
  CAST(COALESCE(SUM(input_tokens) FILTER (oracle OR live), 0) AS BIGINT) AS input_tokens, CAST(COALESCE(SUM(output_tokens) FILTER (oracle OR live), 0) AS BIGINT) AS output_tokens FROM k GROUP BY doc)
SELECT *, round_even(greatest(0, local_usd - primary_ocr_usd - retry_ocr_usd), 8) AS other_local_usd, round_even(local_usd + measured_api_usd, 8) AS measured_usd, round_even(local_usd + projected_api_usd, 8) AS projected_usd FROM s""")
def receipt_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs of each page by basis and kind."""
    prices = spark.createDataFrame(list(_PRICES), "model string, input_usd double, output_usd double")
    return R.receipt_costs(B.bind(spark, d, _COSTS), prices, ["doc"], "large")


# documents ---------------------------------------------------------------------------
_DOC_PAGES = "SELECT user_id AS doc_id, event_type AS page, CASE WHEN user_id % 4 = 0 AND MIN(event_id) % 2 = 0 THEN 'ub04' ELSE 'cms1500' END AS document_type, SUM(event_id % 100) / 1e1 AS latency_ms, SUM(event_id % 7) / 1e4 AS measured_usd, SUM(event_id % 5) / 1e4 AS projected_usd FROM {events} GROUP BY user_id, event_type"
_DOC_FIELDS = "SELECT user_id AS doc_id, event_type AS page, CASE WHEN user_id % 6 = 1 THEN 'ACCEPT' WHEN event_id % 8 < 4 THEN 'ACCEPT' WHEN event_id % 8 = 4 THEN 'ACCEPT_WITH_FLAG' WHEN event_id % 8 = 5 THEN 'RETRY' WHEN event_id % 8 = 6 THEN 'INAPPLICABLE' ELSE 'HUMAN_REVIEW' END AS decision, event_id % 3 AS retry_count, event_id % 11 = 0 AS escalated, event_id % 5 <> 0 AS eligible, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS calls, CASE WHEN event_id % 22 = 0 THEN 'MULTIMODAL_FAILED' WHEN event_id % 11 = 0 THEN 'MULTIMODAL_ATTEMPTED' WHEN event_id % 8 = 7 THEN 'HUMAN_REVIEW_REQUIRED' END AS workflow FROM {events} WHERE user_id % 9 <> 2"
_UNIFIED = f"""p AS ({_ansi(_DOC_PAGES)}), f AS ({_ansi(_DOC_FIELDS)}), a AS (SELECT doc_id, COUNT(*) AS page_count, CASE WHEN COUNT(DISTINCT document_type) = 1 THEN MIN(document_type) ELSE 'mixed' END AS document_type, round_even({_money('latency_ms')}, 3) AS latency_ms, round_even({_money('measured_usd')}, 9) AS measured_usd, round_even({_money('projected_usd')}, 9) AS projected_usd FROM p GROUP BY doc_id),
b AS (SELECT doc_id, COUNT(*) AS fields, {_count(f'decision IN {_DONE} AND NOT escalated AND retry_count = 0', 'accepted_without_retry')}, {_count(f'decision IN {_DONE} AND NOT escalated AND retry_count > 0', 'accepted_after_local_retry')}, {_count("decision = 'ACCEPT'", 'accepted')}, {_count("decision = 'ACCEPT_WITH_FLAG'", 'accepted_with_flag')},
  {_count("decision = 'INAPPLICABLE'", 'inapplicable')}, {_count('retry_count > 0', 'fields_retried')}, {_count("decision = 'RETRY'", 'pending_local_retry')}, {_count('escalated', 'multimodal_attempted')}, {_count('eligible', 'multimodal_eligible')}, {_count("workflow = 'MULTIMODAL_FAILED'", 'multimodal_failed')},
  {_count("workflow = 'HUMAN_REVIEW_REQUIRED'", 'pending_human_review')}, CAST(SUM(calls) AS BIGINT) AS external_calls, {_count(f"decision NOT IN {_DONE} AND decision <> 'INAPPLICABLE'", 'unresolved_fields')} FROM f GROUP BY doc_id),
u AS (SELECT a.*, {{}} FROM a LEFT JOIN b ON a.doc_id = b.doc_id),
unified AS (SELECT *, greatest(0, fields - inapplicable - external_calls) AS paid_calls_avoided, CASE WHEN fields = 0 THEN 'FAILED_EXTRACTION' WHEN unresolved_fields > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS processing_status FROM u)
""".format(", ".join(f"COALESCE(b.{n}, 0) AS {n}" for n in ("fields", "accepted_without_retry", "accepted_after_local_retry", "accepted", "accepted_with_flag", "inapplicable", "fields_retried", "pending_local_retry", "multimodal_attempted", "multimodal_eligible", "multimodal_failed", "pending_human_review", "external_calls", "unresolved_fields")))


def _unified(spark: SparkSession, d: str) -> DataFrame:
    return R.unify_receipts(B.bind(spark, d, _DOC_PAGES), B.bind(spark, d, _DOC_FIELDS))


@query(f"WITH {_UNIFIED} SELECT * FROM unified")
def unified_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a document as one."""
    return _unified(spark, d)


_BATCH = f"""{_UNIFIED}, w AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'SKIPPED' WHEN doc_id % 17 = 0 THEN 'FAILED' WHEN doc_id % 19 = 0 THEN 'CANCELLED' ELSE processing_status END AS st, doc_id % 30 + 10 AS applicable_fields, doc_id % 20 AS fields_produced, doc_id % 10 AS validated_fields, doc_id % 8 + 1 AS critical_fields, doc_id % 5 AS critical_resolved FROM unified)"""


def _batch(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    state = F.when(i % 13 == 0, "SKIPPED").when(i % 17 == 0, "FAILED").when(i % 19 == 0, "CANCELLED").otherwise(F.col("processing_status"))
    return _unified(spark, d).withColumns({"processing_status": state, "applicable_fields": i % 30 + 10, "fields_produced": i % 20, "validated_fields": i % 10, "critical_fields": i % 8 + 1, "critical_resolved": i % 5})


_IDLE = "('SKIPPED', 'DUPLICATE', 'CANCELLED')"
_BATCH_RATES = {
    "critical_resolution_rate": ("critical_resolved", "critical_fields"),
    "primary_resolution_rate": ("accepted_without_retry", "applicable_fields"),
    "retry_resolution_rate": ("accepted_after_local_retry", "fields_retried"),
    "multimodal_resolution_rate": ("greatest(0, multimodal_attempted - multimodal_failed)", "multimodal_attempted"),
    "human_review_rate": ("pending_human_review", "applicable_fields"),
    "mean_latency_ms": ("latency_ms", "n_counted"),
    "pages_per_minute": ("pages * 60000", "latency_ms"),
}


@query(f"""WITH {_BATCH}, s AS (SELECT COUNT(*) AS files, CAST(SUM(page_count) FILTER (st NOT IN {_IDLE}) AS BIGINT) AS pages, {', '.join(_count(f"st = '{x}'", x.lower()) for x in ('COMPLETED', 'PARTIAL', 'FAILED_EXTRACTION', 'FAILED', 'CANCELLED'))}, {_count("st IN ('SKIPPED', 'DUPLICATE')", 'skipped')}, {_count(f'st NOT IN {_IDLE}', 'n_counted')},
  {', '.join(f"CAST(COALESCE(SUM({n}) FILTER (st IN ('COMPLETED', 'PARTIAL')), 0) AS BIGINT) AS {n}" for n in R.BATCH_SUMS)}, {', '.join(f'round_even({_money(f"CASE WHEN st NOT IN {_IDLE} THEN {n} END")}, {p}) AS {n}' for n, p in (('measured_usd', 9), ('projected_usd', 9), ('latency_ms', 3)))} FROM w)
SELECT * EXCLUDE (n_counted), {_rates(_BATCH_RATES, 6)} FROM s""")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row of a batch."""
    return R.batch_summary(_batch(spark, d))


@query(f"WITH {_BATCH} SELECT document_type, COUNT(*) AS documents FROM w WHERE st IN ('COMPLETED', 'PARTIAL') GROUP BY document_type")
def document_types(spark: SparkSession, d: str) -> DataFrame:
    """Documents with output by type."""
    return R.document_types(_batch(spark, d))


# benchmark and bake-off -----------------------------------------------------------------
_CONTAINERS = "SELECT CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS tier, event_id % 3 + 1 AS page_count, CASE WHEN event_id % 10 = 0 THEN 'ambiguous' ELSE 'deterministic' END AS status, event_id % 30 AS evaluated, event_id % 20 AS correct, event_id % 25 AS present, (event_id % 40) / 1e5 AS local_usd, CASE WHEN event_id % 4 = 1 AND event_id % 8 <> 1 THEN event_id % 3 = 0 END AS claim_page_right, event_id % 2 AS attachments, event_id % 2 * (event_id % 3 % 2) AS attachments_right FROM {events}"
_TIER_RATES = {"field_accuracy": ("correct", "evaluated"), "present_rate": ("present", "evaluated"), "claim_page_accuracy": ("claim_page_right", "claim_page_evaluable"), "attachment_accuracy": ("attachments_right", "attachments")}


@query(f"""WITH k AS ({_ansi(_CONTAINERS)}), s AS (SELECT tier, COUNT(*) AS containers, CAST(SUM(page_count) AS BIGINT) AS page_count, {_count("status = 'deterministic'", 'deterministic')}, CAST(SUM(evaluated) AS BIGINT) AS evaluated, CAST(SUM(correct) AS BIGINT) AS correct, CAST(SUM(present) AS BIGINT) AS present, {_money('local_usd')} AS local_usd,
  {_count('claim_page_right', 'claim_page_right')}, COUNT(claim_page_right) AS claim_page_evaluable, CAST(SUM(attachments) AS BIGINT) AS attachments, CAST(SUM(attachments_right) AS BIGINT) AS attachments_right FROM k GROUP BY GROUPING SETS ((tier), ())),
r AS (SELECT *, {_rates(_TIER_RATES)} FROM s)
SELECT * EXCLUDE (field_accuracy, present_rate), CASE tier WHEN 'A' THEN 3 WHEN 'B' THEN 5 WHEN 'C' THEN 7 WHEN 'D' THEN 9 ELSE 24 END AS records, containers - deterministic AS ambiguous, CASE WHEN tier IS NOT NULL OR containers = deterministic THEN field_accuracy END AS field_accuracy, CASE WHEN tier IS NOT NULL OR containers = deterministic THEN present_rate END AS present_rate FROM r""")
def benchmark_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark by tier; the combined figure is withheld while a link is ambiguous."""
    records = spark.createDataFrame([("A", 3), ("B", 5), ("C", 7), ("D", 9)], "tier string, records long")
    return R.benchmark_tiers(B.bind(spark, d, _CONTAINERS), records)


_ROUTES = "SELECT event_id AS doc_id, CASE WHEN user_id % 3 = 0 THEN 'clean' WHEN user_id % 3 = 1 THEN 'noisy' ELSE 'ugly' END AS tier, CASE WHEN event_id % 2 = 0 THEN 'cms1500' ELSE 'ub04' END AS form, CASE WHEN event_id % 29 = 0 THEN 'abstain' WHEN event_id % 2 = 0 THEN 'cms1500' ELSE 'ub04' END AS routed, event_id % 31 % 2 AS ink_failures, event_id % 5 AS ops, (event_id % 100) / 1e2 AS q_before, (event_id % 97) / 9.6e1 AS q_after, (event_id % 700) / 1e1 AS ms FROM {events}"


def _avg(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(20,8))) AS DOUBLE) / COUNT(*)"


@query(f"""SELECT tier, COUNT(*) AS pages, {_count('ink_failures > 0', 'ink_failures')}, {_count("tier = 'clean' AND ops > 0", 'clean_modified')}, round_even({_avg('q_before')}, 3) AS q_before, round_even({_avg('q_after')}, 3) AS q_after, round_even({_avg('ms')}, 1) AS mean_ms, round_even(COUNT(*) FILTER (routed = form) / COUNT(*), 4) AS router_accuracy
FROM ({_ansi(_ROUTES)}) r GROUP BY GROUPING SETS ((tier), ())""".replace("COUNT(*) FILTER (tier = 'clean'", "COUNT(*) FILTER (tier = 'clean'"))
def router_report(spark: SparkSession, d: str) -> DataFrame:
    """The router by tier and as a whole."""
    return R.router_report(B.bind(spark, d, _ROUTES))


@query(f"SELECT doc_id, tier, routed FROM ({_ansi(_ROUTES)}) r WHERE routed <> form")
def router_errors(spark: SparkSession, d: str) -> DataFrame:
    """Pages that went to the wrong form."""
    return R.router_errors(B.bind(spark, d, _ROUTES))


_OCR = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'paddle' ELSE 'tess' END AS engine, event_id % 3 <> 0 AS prep, CASE WHEN user_id % 3 = 0 THEN 'clean' WHEN user_id % 3 = 1 THEN 'noisy' ELSE 'ugly' END AS tier, (event_id % 100) / 1e2 AS field_acc, (event_id % 90) / 9e1 AS word_recall, (event_id % 700) / 1e1 AS ocr_ms, (event_id % 50) / 1e4 AS cost_usd, event_id % 13 = 0 AS fail FROM {events}"
_MEANS = ", ".join(f"round_even({_avg(x)}, 4) AS {n}" for n, x in (("field_acc", "field_acc"), ("word_recall", "word_recall"), ("ocr_ms", "ocr_ms"), ("cost_usd", "cost_usd"), ("failure_rate", "CAST(fail AS INT)")))


@query(f"SELECT engine, prep, tier, {_MEANS}, COUNT(*) AS pages FROM ({_ansi(_OCR)}) o GROUP BY engine, prep, tier")
def bakeoff_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Engines by preparation and tier."""
    return R.bakeoff_matrix(B.bind(spark, d, _OCR))


@query(f"WITH s AS (SELECT engine, round_even({_avg('field_acc')}, 4) AS acc, round_even({_avg('cost_usd')}, 4) AS cost FROM ({_ansi(_OCR)}) o WHERE prep GROUP BY engine) SELECT *, CAST(round_even(acc / CASE WHEN cost = 0 THEN 1e-9 ELSE cost END, 0) AS BIGINT) AS acc_per_dollar FROM s")
def accuracy_per_dollar(spark: SparkSession, d: str) -> DataFrame:
    """Engines by accuracy for a dollar."""
    return R.accuracy_per_dollar(B.bind(spark, d, _OCR))


_HITS = [f"f{k}" for k in range(20)]


@query(f"SELECT n AS field_name, COUNT(*) AS misses FROM ({_ansi(_OCR)}) o, (VALUES {', '.join(f"('{n}', {k})" for k, n in enumerate(_HITS))}) t(n, k) WHERE prep AND event_id % (k + 3) = 0 GROUP BY n ORDER BY misses DESC, n LIMIT 12")
def top_missed(spark: SparkSession, d: str) -> DataFrame:
    """The twelve fields that are missed most."""
    hits = F.create_map(*(x for k, n in enumerate(_HITS) for x in (F.lit(n), F.col("event_id") % (k + 3) != 0)))
    return R.top_missed(B.bind(spark, d, _OCR).withColumn("hits", hits), "hits")


_SESSION = "SELECT CAST(user_id AS STRING) AS session, CASE WHEN event_id % 4 < 2 THEN 'ALLOW' WHEN event_id % 4 = 2 THEN 'REUSED_CACHED_RESULT' ELSE 'BLOCKED_CROP' END AS decision, (event_id % 9) / 1e3 AS billed_usd, CASE WHEN event_id % 4 = 2 THEN (event_id % 7) / 1e3 END AS avoided_usd FROM {events}"


@query(f"""WITH s AS (SELECT session, {_count("decision = 'ALLOW'", 'calls_made')}, {_count("decision = 'REUSED_CACHED_RESULT'", 'paid_calls_avoided')}, {_money("CASE WHEN decision = 'ALLOW' THEN billed_usd END")} AS m, {_money("CASE WHEN decision <> 'ALLOW' THEN avoided_usd END")} AS a FROM ({_ansi(_SESSION)}) x GROUP BY session)
SELECT session, calls_made, paid_calls_avoided, round_even(m, 8) AS measured_usd, round_even(m + a, 8) AS projected_uncached_usd, round_even(a, 8) AS cache_savings_usd, round_even(0.5 - m, 8) AS remaining_usd FROM s""")
def session_report(spark: SparkSession, d: str) -> DataFrame:
    """Spend of each session and what the cache saved."""
    return R.session_report(B.bind(spark, d, _SESSION), 0.5)


@query(f"""WITH f AS ({_ansi(B.FIELDS)}), s AS (SELECT COALESCE(tier, 'all') AS scope, COUNT(*) AS fields, COUNT(*) FILTER (correct) AS correct_fields, COUNT(*) FILTER (state = 'HUMAN_REVIEW') AS human FROM f GROUP BY GROUPING SETS ((tier), ()))
SELECT scope, 'fields' AS metric, CAST(fields AS DOUBLE) AS value, 'MEASURED' AS evidence FROM s UNION ALL SELECT scope, 'accuracy', round_even(CAST(correct_fields AS DOUBLE) / fields, 8), 'SYNTHETIC' FROM s UNION ALL SELECT scope, 'human', CAST(human AS DOUBLE), 'MEASURED' FROM s""")
def metric_list(spark: SparkSession, d: str) -> DataFrame:
    """A report as labelled rows."""
    from ..operators.evaluation import per_tier

    return R.metric_list(per_tier(B.bind(spark, d, B.FIELDS), "tier"), {"fields": "MEASURED", "accuracy": "SYNTHETIC", "human": "MEASURED"})


@query(f"""WITH q AS (SELECT doc_id, page, decision, event_no FROM (SELECT *, row_number() OVER () AS event_no FROM ({_ansi(_DOC_FIELDS)}) x) y WHERE decision IN ('RETRY', 'HUMAN_REVIEW')), e AS (SELECT DISTINCT doc_id, page FROM ({_ansi(_DOC_FIELDS)}) x WHERE eligible AND workflow = 'HUMAN_REVIEW_REQUIRED')
SELECT q.doc_id, q.page, q.decision FROM q JOIN e ON q.doc_id = e.doc_id AND q.page = e.page""")
def eligible_queue(spark: SparkSession, d: str) -> DataFrame:
    """Queued fields that a model may be asked about."""
    f = B.bind(spark, d, _DOC_FIELDS)
    return R.eligible_queue(f.filter(F.col("decision").isin("RETRY", "HUMAN_REVIEW")).select("doc_id", "page", "decision"), f, ["doc_id", "page"])


@query(f"""WITH k AS ({_ansi(_CONTAINERS)}), s AS (SELECT tier, page_count, {_count("status = 'deterministic' AND evaluated > 28", 'pairs')}, CAST(SUM(evaluated) AS BIGINT) AS denominator, round_even(CAST(SUM(correct) AS DOUBLE) / NULLIF(SUM(evaluated), 0), 6) AS acc FROM k GROUP BY tier, page_count)
SELECT tier, page_count, CASE WHEN pairs > 0 AND denominator > 0 THEN acc END AS accuracy FROM s""")
def evaluation_display(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy where something was compared."""
    c = F.col
    s = B.bind(spark, d, _CONTAINERS).groupBy("tier", "page_count").agg(F.count_if((c("status") == "deterministic") & (c("evaluated") > 28)).alias("pairs"), F.sum("evaluated").alias("n"), F.sum("correct").alias("ok"))
    return s.select("tier", "page_count", R.evaluation_display(c("pairs"), c("n"), F.bround(F.try_divide(c("ok").cast("double"), c("n").cast("double")), 6)).alias("accuracy"))
