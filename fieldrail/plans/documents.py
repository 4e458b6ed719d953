"""Queries of whole batch reports, with their SQL: customers are documents, their orders pages, the lines of these fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import document_reports as R
from . import bind as B

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = B.exact_rounds(sql)
        return f

    return keep


_USD = ("primary_ocr", "retry_ocr", "other_local", "local", "input_tokens", "output_tokens", "projected_input_tokens", "projected_output_tokens", "measured_api", "projected_api")
_TYPE = "CASE WHEN o_custkey % 11 = 3 THEN 'letter' WHEN o_custkey % 5 = 0 AND o_orderpriority = '5-LOW' THEN 'ub04' ELSE 'cms1500' END"
# cents of a price, dealt to kinds of costs
_PAGES = f"""SELECT p.*, primary_ocr_usd + retry_ocr_usd + other_local_usd + measured_api_usd AS measured_usd, primary_ocr_usd + retry_ocr_usd + other_local_usd + projected_api_usd AS projected_usd, primary_ocr_usd + retry_ocr_usd + other_local_usd AS local_usd FROM (
SELECT o_custkey AS doc_id, o_orderkey AS page, {_TYPE} AS document_type, CAST(floor(o_totalprice) AS BIGINT) % 90000 / 1e1 AS latency_ms, CAST(floor(o_totalprice) AS BIGINT) % 900 AS input_tokens, CAST(floor(o_totalprice) AS BIGINT) % 70 AS output_tokens,
 CAST(floor(o_totalprice) AS BIGINT) % 31 / 1e4 AS primary_ocr_usd, CAST(floor(o_totalprice) AS BIGINT) % 7 / 1e5 AS retry_ocr_usd, CAST(floor(o_totalprice) AS BIGINT) % 3 / 1e5 AS other_local_usd,
 CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 900 / 1e6 ELSE 0e0 END AS input_tokens_usd, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 70 / 1e6 ELSE 0e0 END AS output_tokens_usd,
 CASE WHEN o_orderstatus = 'F' THEN 0e0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 900 / 1e6 END AS projected_input_tokens_usd, CASE WHEN o_orderstatus = 'F' THEN 0e0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 70 / 1e6 END AS projected_output_tokens_usd,
 CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 970 / 1e6 ELSE 0e0 END AS measured_api_usd, CASE WHEN o_orderstatus = 'F' THEN 0e0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 970 / 1e6 END AS projected_api_usd FROM {{orders}}) p"""
# a line's quantity says what was decided, its tax and discount what was tried
_FIELDS = """SELECT o_custkey AS doc_id, o_orderkey AS page, 'line' || CAST(l_linenumber AS STRING) || '_charges' AS field_name,
 CASE WHEN l_returnflag = 'R' AND l_discount < 0.025 THEN '' WHEN l_returnflag = 'A' AND l_discount < 0.015 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS value,
 CASE WHEN l_quantity >= 44 THEN 'INAPPLICABLE' WHEN l_quantity >= 32 THEN 'ACCEPT_WITH_FLAG' WHEN l_quantity >= 31 THEN 'ACCEPT_WITH_OVERRIDE' WHEN l_quantity >= 8 OR o_custkey % 3 = 0 THEN 'ACCEPT' WHEN l_quantity >= 6 THEN 'RETRY' WHEN l_quantity >= 4 THEN 'ESCALATE' ELSE 'HUMAN_REVIEW' END AS decision,
 CASE WHEN l_discount > 0.085 THEN 2 WHEN l_discount > 0.065 THEN 1 ELSE 0 END AS retry_count, l_tax > 0.065 AS escalated, l_tax > 0.075 AS sent, CASE WHEN l_linestatus = 'O' THEN 'offline-oracle' ELSE 'small' END AS model,
 CASE WHEN l_discount < 0.005 THEN NULL ELSE l_suppkey % 101 / 1e2 END AS confidence, CASE WHEN l_linenumber < 3 THEN 'high' WHEN l_linenumber < 5 THEN 'med' ELSE 'low' END AS criticality, l_linenumber = 6 AS optional, l_linenumber <> 4 AS external,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high,med,low' WHEN '2' THEN 'high,med' ELSE 'high' END AS paid
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_custkey % 29 <> 5"""
_REFUSAL = "disabled by policy"
_DONE = "('ACCEPT', 'ACCEPT_WITH_FLAG', 'ACCEPT_WITH_OVERRIDE')"
_OPEN = f"(decision NOT IN {_DONE} AND decision <> 'INAPPLICABLE')"


def _n(when: str, name: str) -> str:
    return f"count(*) FILTER ({when}) AS {name}"


def _sum(x: str, places: int) -> str:
    return f"round_even(coalesce(CAST(sum(CAST({x} AS DECIMAL(38,10))) AS DOUBLE), 0), {places}) AS {x}"


def _share(a: str, b: str, name: str, when: str = "ok") -> str:
    return f"CASE WHEN {when} THEN round_even(CAST({a} AS DOUBLE) / nullif({b}, 0), 6) END AS {name}"


_COUNTS = {
    "fields": "true", "accepted_without_retry": f"decision IN {_DONE} AND NOT escalated AND retry_count = 0", "accepted_after_local_retry": f"decision IN {_DONE} AND NOT escalated AND retry_count > 0",
    "accepted": "decision = 'ACCEPT'", "accepted_with_flag": "decision = 'ACCEPT_WITH_FLAG'", "inapplicable": "decision = 'INAPPLICABLE'", "fields_retried": "retry_count > 0", "pending_local_retry": "decision = 'RETRY'", "multimodal_attempted": "escalated",
    "multimodal_eligible": "eligible", "multimodal_failed": "workflow = 'MULTIMODAL_FAILED'", "pending_human_review": "workflow = 'HUMAN_REVIEW_REQUIRED'", "external_calls": "calls = 1", "unresolved_fields": _OPEN,
} | {f"state_{s.lower()}": f"decision = '{s}'" for s in R.STATES}
_COVERED = {
    "applicable_fields": "usable", "fields_produced": "usable AND coalesce(value, '') <> ''", "validated_fields": f"decision IN {_DONE}", "critical_fields": "usable AND criticality = 'high'", "critical_resolved": f"criticality = 'high' AND decision IN {_DONE}",
    "confidence_high": "usable AND coalesce(confidence, 0) >= 0.85e0", "confidence_medium": "usable AND coalesce(confidence, 0) >= 0.6e0 AND confidence < 0.85e0", "confidence_low": "usable AND coalesce(confidence, 0) < 0.6e0",
}
_FLOW = f"""f AS (SELECT *, decision <> 'INAPPLICABLE' AS usable, external AND NOT optional AND list_contains(string_split(paid, ','), criticality) AS eligible FROM ({B.duck(_FIELDS)}) x),
g AS (SELECT *, CASE WHEN ({_OPEN} OR escalated) AND escalated AND sent AND model <> 'offline-oracle' THEN 1 ELSE 0 END AS calls, CASE WHEN escalated AND {_OPEN} THEN 'MULTIMODAL_FAILED' WHEN escalated THEN 'MULTIMODAL_ATTEMPTED' WHEN {_OPEN} THEN 'HUMAN_REVIEW_REQUIRED' END AS workflow,
 CASE WHEN escalated THEN '' WHEN NOT {_OPEN} THEN NULL WHEN decision = 'HUMAN_REVIEW' THEN 'human review required by governor' WHEN NOT eligible THEN 'not eligible under field policy' ELSE '{_REFUSAL}' END AS not_called FROM f)"""
_DOCS = f"""{_FLOW}, p AS ({B.duck(_PAGES)}),
a AS (SELECT doc_id, count(*) AS page_count, CASE WHEN count(DISTINCT document_type) = 1 THEN min(document_type) ELSE 'mixed' END AS document_type, {_sum('latency_ms', 3)}, {_sum('measured_usd', 9)}, {_sum('projected_usd', 9)}, {', '.join(_sum(f'{n}_usd', 9) for n in _USD)}, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM p GROUP BY doc_id),
b AS (SELECT doc_id, {', '.join(_n(w, n) for n, w in _COUNTS.items())}, {', '.join(_n(w, n) for n, w in _COVERED.items())} FROM g GROUP BY doc_id),
u AS (SELECT a.*, {', '.join(f'coalesce(b.{n}, 0) AS {n}' for n in (*_COUNTS, *_COVERED))} FROM a LEFT JOIN b ON a.doc_id = b.doc_id),
v AS (SELECT *, document_type IN ('cms1500', 'ub04') AND fields > 0 AS ok FROM u),
docs AS (SELECT * EXCLUDE ({', '.join(_COVERED)}, ok), {', '.join(f'CASE WHEN ok THEN {n} END AS {n}' for n in _COVERED)}, ok AS coverage_available, greatest(0, fields - inapplicable - external_calls) AS paid_calls_avoided, CASE WHEN fields = 0 THEN 'FAILED_EXTRACTION' WHEN unresolved_fields > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS processing_status,
 {_share('fields_produced', 'applicable_fields', 'extraction_coverage')}, {_share('validated_fields', 'applicable_fields', 'validated_coverage')}, {_share('critical_resolved', 'critical_fields', 'critical_resolution_rate')}, {_share('accepted_without_retry', 'applicable_fields', 'primary_resolution_rate')}, {_share('accepted_after_local_retry', 'fields_retried', 'retry_resolution_rate')},
 {_share('greatest(0, multimodal_attempted - multimodal_failed)', 'multimodal_attempted', 'multimodal_resolution_rate')}, {_share('pending_human_review', 'applicable_fields', 'human_review_rate')},
 CASE WHEN fields = 0 THEN 'No meaningful fields were extracted' WHEN unresolved_fields > 0 THEN 'Processing completed with unresolved fields' ELSE 'Processing completed' END AS message,
 concat_ws(chr(10), CASE WHEN fields = 0 THEN 'Document classified as ' || document_type || '; no fields were extracted, so it was not processed.' END, CASE WHEN pending_human_review > 0 THEN pending_human_review || ' field(s) require human review.' END, CASE WHEN pending_local_retry > 0 THEN pending_local_retry || ' field(s) remain pending local retry.' END) AS warnings FROM v),
w AS (SELECT docs.* REPLACE (coalesce(CASE WHEN c_acctbal < -900 THEN 'FAILED' WHEN c_acctbal < -700 THEN 'SKIPPED' WHEN c_acctbal < -600 THEN 'DUPLICATE' WHEN c_acctbal < -500 THEN 'CANCELLED' END, processing_status) AS processing_status), CASE WHEN c_mktsegment = 'BUILDING' THEN pending_human_review ELSE 0 END AS review_completed FROM docs JOIN customer ON c_custkey = doc_id)"""


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return R.with_workflow(B.bind(spark, d, _FIELDS).withColumn("paid", F.split("paid", ",")), F.lit(_REFUSAL))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return R.document_reports(B.bind(spark, d, _PAGES), _fields(spark, d))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """Documents, some of them never worked on or failed."""
    c = F.col
    own = spark.read.parquet(f"{d}/customer.parquet").select(c("c_custkey").alias("doc_id"), "c_acctbal", "c_mktsegment")
    state = F.when(c("c_acctbal") < -900, "FAILED").when(c("c_acctbal") < -700, "SKIPPED").when(c("c_acctbal") < -600, "DUPLICATE").when(c("c_acctbal") < -500, "CANCELLED").otherwise(c("processing_status"))
    both = _documents(spark, d).join(own, "doc_id")
    return both.withColumns({"processing_status": state, "review_completed": F.when(c("c_mktsegment") == "BUILDING", c("pending_human_review")).otherwise(0)}).drop("c_acctbal", "c_mktsegment")


@query(f"WITH {_FLOW} SELECT doc_id, page, field_name, eligible, calls, workflow, not_called FROM g")
def field_workflows(spark: SparkSession, d: str) -> DataFrame:
    """How each field's way ends, and why no model was asked."""
    return _fields(spark, d).select("doc_id", "page", "field_name", "eligible", "calls", "workflow", "not_called")


@query(f"WITH {_DOCS} SELECT * FROM docs")
def document_reports(spark: SparkSession, d: str) -> DataFrame:
    """Documents with all counters, coverage, costs and warnings."""
    return _documents(spark, d).withColumn("warnings", F.array_join("warnings", "\n"))


_IDLE = "('SKIPPED', 'DUPLICATE', 'CANCELLED')"
_MADE = "processing_status IN ('COMPLETED', 'PARTIAL')"
_SUMS = ("fields", "accepted", "accepted_with_flag", "fields_retried", "accepted_after_local_retry", "accepted_without_retry", "unresolved_fields", "inapplicable", "multimodal_attempted", "multimodal_failed", "pending_human_review", "external_calls", *_COVERED, *(f"state_{s}" for s in ("accept_with_override", "retry", "escalate", "human_review")), "pending_local_retry", "multimodal_eligible", "paid_calls_avoided", "review_completed", "input_tokens", "output_tokens")


@query(f"""WITH {_DOCS}, s AS (SELECT count(*) AS files, CAST(coalesce(sum(page_count) FILTER (processing_status NOT IN {_IDLE}), 0) AS BIGINT) AS pages, {', '.join(_n(f"processing_status = '{x}'", x.lower()) for x in ('COMPLETED', 'PARTIAL', 'FAILED_EXTRACTION', 'FAILED', 'CANCELLED'))}, {_n("processing_status IN ('SKIPPED', 'DUPLICATE')", 'skipped')},
 {_n(f'processing_status NOT IN {_IDLE}', 'n_counted')}, {', '.join(f'CAST(coalesce(sum({n}) FILTER ({_MADE}), 0) AS BIGINT) AS {n}' for n in _SUMS)}, {', '.join(f'round_even(coalesce(CAST(sum(CAST({n} AS DECIMAL(38,10))) FILTER (processing_status NOT IN {_IDLE}) AS DOUBLE), 0), {k}) AS {n}' for n, k in (('measured_usd', 9), ('projected_usd', 9), ('latency_ms', 3)))} FROM w)
SELECT * EXCLUDE (n_counted), {_share('critical_resolved', 'critical_fields', 'critical_resolution_rate', 'true')}, {_share('accepted_without_retry', 'applicable_fields', 'primary_resolution_rate', 'true')}, {_share('accepted_after_local_retry', 'fields_retried', 'retry_resolution_rate', 'true')}, {_share('greatest(0, multimodal_attempted - multimodal_failed)', 'multimodal_attempted', 'multimodal_resolution_rate', 'true')},
 {_share('pending_human_review', 'applicable_fields', 'human_review_rate', 'true')}, {_share('latency_ms', 'n_counted', 'mean_latency_ms', 'true')}, {_share('pages * 60000', 'latency_ms', 'pages_per_minute', 'true')} FROM s""")
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    """One row of a batch, whole."""
    return R.batch_report(_batch(spark, d))


@query(f"""WITH {_DOCS}, s AS (SELECT {', '.join(_sum(f'{n}_usd', 9) for n in (*_USD, 'measured', 'projected'))}, {', '.join(f'CAST(coalesce(sum({x}), 0) AS BIGINT) AS {n}' for n, x in (('total_fields', 'fields'), ('fields_resolved_locally', 'accepted_without_retry + accepted_after_local_retry'), ('retry_fields', 'fields_retried'), ('multimodal_eligible_fields', 'multimodal_eligible'), ('multimodal_attempted_fields', 'multimodal_attempted'), ('paid_calls_avoided', 'paid_calls_avoided'), ('external_calls', 'external_calls'), ('input_tokens', 'input_tokens'), ('output_tokens', 'output_tokens'), ('pages', 'page_count'), ('validated', 'validated_fields'), ('review', 'pending_human_review')))}, count(*) AS documents FROM w WHERE processing_status NOT IN {_IDLE})
{' UNION ALL '.join(f"SELECT 'component' AS section, '{n}' AS name, '{b}' AS basis, {n}_usd AS value FROM s" for n, b in (('primary_ocr', 'MEASURED'), ('retry_ocr', 'MEASURED'), ('other_local', 'MEASURED'), ('local', 'MEASURED'), ('input_tokens', 'MEASURED'), ('output_tokens', 'MEASURED'), ('projected_input_tokens', 'OFFLINE_ORACLE'), ('projected_output_tokens', 'OFFLINE_ORACLE'), ('measured_api', 'MEASURED'), ('projected_api', 'OFFLINE_ORACLE'), ('measured', 'MEASURED'), ('projected', 'PROJECTED')))}
 UNION ALL {' UNION ALL '.join(f"SELECT 'unit', 'cost_per_{n}', 'MEASURED', round_even(measured_usd / nullif({k}, 0), 9) FROM s" for n, k in (('page', 'pages'), ('document', 'documents'), ('validated_field', 'validated')))}
 UNION ALL SELECT 'human_review', 'fields', NULL, review FROM s UNION ALL SELECT 'human_review', 'usd_a_field', 'ASSUMED', 0.03e0 UNION ALL SELECT 'human_review', 'total', 'ASSUMED', round_even(review * 0.03e0, 9) FROM s
 UNION ALL SELECT 'volume', 'one_million_pages', 'PROJECTED', round_even(projected_usd / nullif(pages, 0) * 1e6, 6) FROM s UNION ALL SELECT 'volume', 'ten_million_pages', 'PROJECTED', round_even(projected_usd / nullif(pages, 0) * 1e7, 6) FROM s
 UNION ALL {' UNION ALL '.join(f"SELECT 'counter', '{n}', NULL, {n} FROM s" for n in ('total_fields', 'fields_resolved_locally', 'retry_fields', 'multimodal_eligible_fields', 'multimodal_attempted_fields', 'paid_calls_avoided', 'external_calls', 'input_tokens', 'output_tokens'))}""")
def batch_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """A batch's costs by basis, units, assumed review, volumes and counters."""
    return R.dashboard(_batch(spark, d))


@query(f"WITH {_DOCS} SELECT g.doc_id, page, field_name, decision, criticality FROM g JOIN w ON w.doc_id = g.doc_id WHERE {_OPEN} AND {_MADE}")
def unresolved_items(spark: SparkSession, d: str) -> DataFrame:
    """Fields that documents with output leave open."""
    return R.unresolved_items(_batch(spark, d), _fields(spark, d))
