"""Queries of review, dataset evaluation and the retry rung, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches
from . import bind as B

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = B.exact_rounds(sql)
        return f

    return keep


# orders as documents, their lines as pages' fields: a total, two charges, dates
_FIELDS = """SELECT o_custkey AS doc, o_orderkey AS page, n AS field_name,
 CASE n WHEN 'total_charge' THEN CAST(CAST((a + b) / 100 AS DECIMAL(18,2)) AS STRING) WHEN 'line1_charges' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'illegible' ELSE CAST(CAST(a / 100 AS DECIMAL(18,2)) AS STRING) END WHEN 'line2_charges' THEN CAST(CAST(b / 100 AS DECIMAL(18,2)) AS STRING) WHEN 'patient_dob' THEN '01/02/1980' ELSE '03/04/2024' END AS value,
 CASE WHEN (o_orderkey + k) % 4 = 0 THEN 'HUMAN_REVIEW' WHEN (o_orderkey + k) % 4 = 1 THEN 'ACCEPT_WITH_FLAG' ELSE 'ACCEPT' END AS state, (o_orderkey * 7 + k) % 101 / 1e2 AS confidence
 FROM (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 90000 + 1000 AS a, o_custkey % 700 + 10 AS b FROM {orders}) o, (VALUES (1, 'total_charge'), (2, 'line1_charges'), (3, 'line2_charges'), (4, 'patient_dob'), (5, 'line1_date_from')) t(k, n)"""
# two reviewers: the second one's word is later
_ACTIONS = """SELECT o_custkey AS doc, o_orderkey AS page, CASE o_orderkey % 5 WHEN 0 THEN 'line1_charges' WHEN 1 THEN 'total_charge' WHEN 2 THEN 'line1_date_from' ELSE 'line2_charges' END AS field_name, s AS seq,
 CASE WHEN s = 2 AND o_orderkey % 11 = 0 THEN 'LEAVE_UNRESOLVED' WHEN o_orderkey % 13 = 0 THEN 'MARK_NOT_APPLICABLE' WHEN o_orderkey % 17 = 0 THEN 'MARK_BLANK' WHEN o_orderkey % 401 = 0 THEN 'REJECT_DOCUMENT' ELSE 'EDIT' END AS action,
 CASE o_orderkey % 5 WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN '01/01/1979' ELSE '05/06/2024' END ELSE CAST(CAST(CASE o_orderkey % 5 WHEN 0 THEN a WHEN 1 THEN a + b + o_orderkey % 2 ELSE b END / 100 AS DECIMAL(18,2)) AS STRING) END AS new_value
 FROM (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 90000 + 1000 AS a, o_custkey % 700 + 10 AS b FROM {orders} WHERE o_orderdate < CAST('1995-06-01' AS TIMESTAMP)) o, (VALUES (1), (2)) t(s)"""
_REVIEWED = f"""WITH f AS ({B.duck(_FIELDS)}), a AS ({B.duck(_ACTIONS)}),
l AS (SELECT * FROM a WHERE action <> 'REJECT_DOCUMENT' QUALIFY row_number() OVER (PARTITION BY doc, page, field_name ORDER BY seq DESC) = 1),
e AS (SELECT f.doc, f.page, f.field_name, f.state, l.action, CASE WHEN l.action = 'EDIT' THEN new_value WHEN l.action IN ('MARK_BLANK', 'MARK_NOT_APPLICABLE') THEN NULL ELSE value END AS value FROM f LEFT JOIN l ON l.doc = f.doc AND l.page = f.page AND l.field_name = f.field_name),
c AS (SELECT *, CASE WHEN regexp_matches(value, '^[0-9]{{1,7}}[.][0-9][0-9]$') THEN CAST(replace(value, '.', '') AS BIGINT) END AS cents FROM e),
p AS (SELECT doc, page, max(cents) FILTER (field_name = 'total_charge') AS total, sum(cents) FILTER (field_name LIKE 'line%charges') AS lines, count(*) FILTER (field_name LIKE 'line%charges' AND cents IS NULL) AS unread FROM c GROUP BY doc, page),
j AS (SELECT c.*, CASE WHEN action IN ('EDIT', 'MARK_BLANK') THEN CAST(coalesce(value, '') = '' OR (field_name <> 'line1_date_from' AND cents IS NULL) AS INT)
  + CAST(coalesce(field_name <> 'line1_date_from' AND total IS NOT NULL AND unread = 0 AND lines <> total, false) AS INT) + CAST(coalesce(field_name = 'line1_date_from' AND value = '01/01/1979', false) AS INT) END AS failures FROM c JOIN p ON p.doc = c.doc AND p.page = c.page),
r AS (SELECT doc, page, field_name, value, action, failures, CASE WHEN failures = 0 THEN 'ACCEPT_WITH_OVERRIDE' WHEN failures > 0 OR action = 'LEAVE_UNRESOLVED' THEN 'HUMAN_REVIEW' WHEN action = 'MARK_NOT_APPLICABLE' THEN 'INAPPLICABLE' ELSE state END AS state, CASE WHEN failures = 0 THEN 'HUMAN_CORRECTED' WHEN failures > 0 THEN 'VALIDATION_FAILED' END AS resolution FROM j)
"""


def _review(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fields, actions = B.bind(spark, d, _FIELDS).drop("confidence"), B.bind(spark, d, _ACTIONS)
    before = batches.document_counters(fields.withColumn("action", F.lit(None).cast("string")))
    return batches.revalidate(fields, before, actions)


@query(_REVIEWED + "SELECT doc, page, field_name, value, state, action, failures, resolution FROM r")
def review_revalidated(spark: SparkSession, d: str) -> DataFrame:
    """Fields after review: edited ones judged among their page's values as they are now."""
    return _review(spark, d)[0]


@query(_REVIEWED + """SELECT doc, count(*) AS fields, count(*) FILTER (state = 'HUMAN_REVIEW') AS unresolved, count(*) FILTER (state = 'INAPPLICABLE') AS inapplicable, count(*) FILTER (state = 'ACCEPT_WITH_FLAG') AS flagged, count(*) FILTER (state = 'ACCEPT') AS accepted, count(*) FILTER (state = 'ACCEPT_WITH_OVERRIDE') AS overridden,
 round_even(count(*) FILTER (state NOT IN ('HUMAN_REVIEW', 'INAPPLICABLE')) / nullif(count(*) FILTER (state <> 'INAPPLICABLE'), 0), 6) AS coverage, count(*) FILTER (state = 'HUMAN_REVIEW') AS review_required, count(*) FILTER (action IS NOT NULL AND state <> 'HUMAN_REVIEW') AS review_completed,
 CASE WHEN doc IN (SELECT doc FROM a WHERE action = 'REJECT_DOCUMENT') THEN 'FAILED' WHEN count(*) FILTER (state = 'HUMAN_REVIEW') > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM r GROUP BY doc""")
def review_counters(spark: SparkSession, d: str) -> DataFrame:
    """Documents' counters after review, counted anew only where something was done."""
    return _review(spark, d)[1]


_PROVIDERS = "SELECT o_custkey AS doc, o_orderkey AS page, 'total_charge' AS field_name, s AS seq, CASE WHEN s = 1 THEN 'SENT' WHEN o_orderkey % 3 = 0 THEN 'PROVIDER_FAILED' ELSE 'ANSWERED' END AS final_workflow_state FROM {orders}, (VALUES (1), (2)) t(s) WHERE o_orderkey % 2 = 0"


@query(f"""WITH f AS ({B.duck(_FIELDS)}), p AS (SELECT * FROM ({B.duck(_PROVIDERS)}) WHERE seq = 2) SELECT f.doc, f.page, f.field_name, value, state, confidence, coalesce(final_workflow_state, 'HUMAN_REVIEW_REQUIRED') AS provider_state FROM f LEFT JOIN p ON p.doc = f.doc AND p.page = f.page AND p.field_name = f.field_name WHERE state = 'HUMAN_REVIEW'""")
def review_queue_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What waits for people, with what became of paid calls."""
    return batches.review_queue(B.bind(spark, d, _FIELDS), B.bind(spark, d, _PROVIDERS))


@query(f"""SELECT doc, page, field_name, CASE WHEN coalesce(trim(value), '') = '' THEN '-' ELSE value END AS shown, CASE state WHEN 'HUMAN_REVIEW' THEN 'needs review' WHEN 'ACCEPT_WITH_FLAG' THEN 'accepted with flag' ELSE 'accepted' END AS label, round_even(100 * confidence, 1) AS confidence_pct, state <> 'HUMAN_REVIEW' AS resolved FROM ({B.duck(_FIELDS)})""")
def field_table(spark: SparkSession, d: str) -> DataFrame:
    """Fields as a table shows them."""
    return batches.display_rows(B.bind(spark, d, _FIELDS))


_DOCS = "SELECT doc_id AS doc, CASE WHEN n_chars % 9 = 0 THEN 'EXPECTED_OUTPUT' ELSE 'CLAIM_DOCUMENT' END AS role, CASE n_chars % 10 WHEN 0 THEN 'DUPLICATE' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM {documents}"
_PAIRS = "SELECT doc_id AS doc, CASE n_chars % 4 WHEN 0 THEN 'no_match' WHEN 1 THEN 'ambiguous' ELSE 'deterministic' END AS status, CASE WHEN n_chars % 4 > 1 AND n_chars % 16 <> 3 THEN n_chars % 57 END AS matched FROM {documents}"
_OUTCOMES = "SELECT doc_id AS doc, CASE k WHEN 1 THEN 'units' WHEN 2 THEN 'total_charge' ELSE 'patient_name' END AS field_name, CASE WHEN (n_chars + k) % 6 = 0 THEN 'missing' WHEN (n_chars + k) % 6 = 1 THEN 'incorrect' ELSE 'correct' END AS outcome, k > 1 AS critical FROM {documents}, (VALUES (1), (2), (3)) t(k) WHERE n_chars % 4 > 1"
_EXTRA = "SELECT doc_id AS doc, CASE WHEN n_chars % 2 = 0 THEN 'units' ELSE 'note' END AS field_name FROM {documents} WHERE n_chars % 5 = 0"
_RECORDS = "SELECT item_id AS record FROM {benchmark}"
_DATASET = f"WITH d AS ({B.duck(_DOCS)}), p AS (SELECT DISTINCT doc FROM d WHERE status IN ('COMPLETED', 'PARTIAL')), l AS (SELECT * FROM ({B.duck(_PAIRS)}) WHERE doc IN (SELECT doc FROM p)), o AS (SELECT * FROM ({B.duck(_OUTCOMES)}) WHERE doc IN (SELECT doc FROM p)), x AS (SELECT * FROM ({B.duck(_EXTRA)}) WHERE doc IN (SELECT doc FROM p)), e AS ({B.duck(_RECORDS)})"


@query(_DATASET + """, m AS (SELECT (SELECT count(*) FROM d WHERE role = 'CLAIM_DOCUMENT' AND status NOT IN ('DUPLICATE', 'CANCELLED')) AS documents_found, (SELECT count(*) FROM l WHERE status = 'deterministic') AS deterministic_pairs, (SELECT count(*) FROM l WHERE status = 'ambiguous') AS ambiguous_pairs, (SELECT count(*) FROM l WHERE status = 'no_match') AS documents_without_match,
 (SELECT count(DISTINCT record) FROM e) AS expected_records_found, (SELECT count(DISTINCT doc) FROM o) AS documents_evaluated, (SELECT count(*) FROM o) AS evaluated_fields, (SELECT count(*) FROM o WHERE outcome = 'correct') AS correct_fields, (SELECT count(*) FROM o WHERE outcome = 'incorrect') AS incorrect_fields, (SELECT count(*) FROM o WHERE outcome = 'missing') AS missing_fields,
 (SELECT count(*) FROM o WHERE critical) AS critical_fields, (SELECT count(*) FROM o WHERE critical AND outcome = 'correct') AS critical_correct_fields, (SELECT count(*) FROM x) AS false_positive_fields, (SELECT count(DISTINCT matched) FROM l WHERE status = 'deterministic') AS matched)
SELECT * EXCLUDE (matched), documents_found - deterministic_pairs AS unmatched_documents, greatest(0, expected_records_found - matched) AS unmatched_expected_records, round_even(correct_fields / evaluated_fields, 6) AS accuracy, round_even(correct_fields / (correct_fields + incorrect_fields + false_positive_fields), 6) AS "precision", round_even(correct_fields / (correct_fields + incorrect_fields + missing_fields), 6) AS recall, round_even(critical_correct_fields / critical_fields, 6) AS critical_accuracy FROM m""")
def dataset_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Documents paired with expected records and the rates over what was paired."""
    return batches.dataset_evaluation(*(B.bind(spark, d, s) for s in (_DOCS, _PAIRS, _RECORDS, _OUTCOMES, _EXTRA)))


@query(_DATASET + """, u AS (SELECT field_name, outcome FROM (SELECT * FROM (""" + B.duck(_OUTCOMES) + """)) UNION ALL SELECT field_name, 'false_positive' FROM (""" + B.duck(_EXTRA) + """))
SELECT field_name, count(*) FILTER (outcome <> 'false_positive') AS evaluated, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'incorrect') AS incorrect, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'false_positive') AS false_positives, round_even(count(*) FILTER (outcome = 'correct') / nullif(count(*) FILTER (outcome <> 'false_positive'), 0), 6) AS accuracy FROM u GROUP BY field_name""")
def dataset_fields(spark: SparkSession, d: str) -> DataFrame:
    """Rates by field, fields that nothing expected too."""
    return batches.evaluation_by_field(B.bind(spark, d, _OUTCOMES), B.bind(spark, d, _EXTRA))


_ARMS = """SELECT e.event_id % 2 = 0 AS retry_on, CASE WHEN user_id % 3 = 0 THEN 'clean' WHEN user_id % 3 = 1 THEN 'noisy' ELSE 'ugly' END AS tier, CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 'RETRY' WHEN event_id % 2 = 0 AND event_id % 7 = 0 THEN 'ESCALATE' WHEN event_id % 9 = 0 THEN 'HUMAN_REVIEW' WHEN event_id % 4 = 0 THEN 'ACCEPT_WITH_FLAG' ELSE 'ACCEPT' END AS state,
 event_id % 6 <> 0 AS correct, event_id % 2 = 0 AND event_id % 3 = 0 AS retried, (event_id % 13) / 1e6 AS retry_usd FROM {events} e"""
_ARM = ", ".join(f"round_even(100.0 * count(*) FILTER (state = '{s}') / count(*), 4) AS {s.lower()}_pct" for s in ("ACCEPT", "ACCEPT_WITH_FLAG", "RETRY", "ESCALATE", "HUMAN_REVIEW"))
_ARM_SQL = f"""WITH f AS ({B.duck(_ARMS)}), a AS (SELECT retry_on, tier, count(*) AS fields, round_even(count(*) FILTER (correct) / count(*), 6) AS accuracy, {_ARM}, count(*) FILTER (retried) AS retried, count(*) FILTER (retried AND correct AND state IN ('ACCEPT', 'ACCEPT_WITH_FLAG')) AS resolved, count(*) FILTER (retried AND NOT correct) AS still_wrong,
 CAST(sum(CAST(CASE WHEN retried THEN retry_usd ELSE 0 END AS DECIMAL(38,10))) AS DOUBLE) AS retry_usd FROM f GROUP BY GROUPING SETS ((retry_on, tier), (retry_on))), z AS (SELECT *, round_even(coalesce(retry_usd / nullif(retried, 0), 0), 10) AS usd_per_retried FROM a)
"""


@query(_ARM_SQL + "SELECT * FROM z")
def retry_arms(spark: SparkSession, d: str) -> DataFrame:
    """The funnel with and without second readings."""
    return batches.retry_arms(B.bind(spark, d, _ARMS))


@query(_ARM_SQL + "SELECT f.retry_pct AS needing_more_pct, n.escalate_pct AS still_paid_pct, round_even(f.retry_pct - n.escalate_pct, 4) AS avoided_pct, round_even(n.resolved / n.retried, 6) AS resolved_share, n.usd_per_retried AS usd_per_avoided, f.accuracy AS accuracy_off, n.accuracy AS accuracy_on FROM z n, z f WHERE n.tier IS NULL AND f.tier IS NULL AND n.retry_on AND NOT f.retry_on")
def retry_ablation(spark: SparkSession, d: str) -> DataFrame:
    """What second readings save of paid calls."""
    return batches.retry_ablation(batches.retry_arms(B.bind(spark, d, _ARMS)))
