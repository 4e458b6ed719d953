"""Queries of live-call gates, usage, prompts, retries and masks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy as P
from ..streaming import authorization
from . import bind as B

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = B.exact_rounds(sql)
        return f

    return keep


_REQUESTS = """SELECT event_id, event_id % 53 <> 0 AS enabled, event_id % 47 <> 0 AS adapter, event_id % 43 <> 0 AS test_flag, CASE WHEN event_id % 41 = 0 THEN '  ' ELSE 'k' END AS key, event_id % 37 <> 0 AS synthetic,
 CASE WHEN event_id % 31 = 0 THEN 'crop too small' END AS crop_refusal, CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 29 = 1 THEN ' Auto' WHEN event_id % 29 = 2 THEN 'x/y:FREE' ELSE 'x/y' END AS model, event_id % 23 <> 0 AS listed,
 CASE WHEN event_id % 19 > 1 THEN true WHEN event_id % 19 = 1 THEN false END AS vision, event_id % 17 = 0 AS seen, event_id % 13 = 0 AS in_flight, CAST(event_id % 12 = 1 AS INT) AS paid_field, CAST(event_id % 11 = 1 AS INT) AS calls_field, event_id % 10 % 3 AS calls_page, event_id % 9 % 4 AS calls_document,
 event_id % 7 AS calls_batch, (event_id % 25) / 1e3 AS session_usd, (event_id % 8) / 1e3 AS document_usd FROM {events}"""
_MODEL = "lower(trim(model))"
_GATE = f"""CASE WHEN NOT enabled THEN 'BLOCKED_LIVE_PATH_DISABLED' WHEN NOT adapter THEN 'BLOCKED_ADAPTER_DISABLED' WHEN NOT test_flag THEN 'BLOCKED_LIVE_TEST_FLAG_UNSET' WHEN trim(key) = '' THEN 'BLOCKED_NO_API_KEY' WHEN NOT synthetic THEN 'BLOCKED_NOT_SYNTHETIC'
 WHEN crop_refusal IS NOT NULL THEN 'BLOCKED_NOT_A_CROP' WHEN {_MODEL} IN ('', 'auto', 'openrouter/auto') OR {_MODEL} LIKE '%:free' THEN 'BLOCKED_MODEL_REFUSED' WHEN NOT listed THEN 'BLOCKED_MODEL_NOT_ALLOWLISTED' WHEN NOT COALESCE(vision, false) THEN 'BLOCKED_MODEL_NOT_VISION'
 WHEN seen THEN 'REUSED_CACHED_RESULT' WHEN in_flight THEN 'BLOCKED_PARALLEL_CALL' WHEN paid_field >= 1 THEN 'BLOCKED_FIELD_PAID_ATTEMPTS' WHEN calls_field >= 1 THEN 'BLOCKED_FIELD_CALL_LIMIT' WHEN calls_page >= 2 THEN 'BLOCKED_PAGE_CALL_LIMIT' WHEN calls_document >= 3 THEN 'BLOCKED_DOCUMENT_CALL_LIMIT'
 WHEN calls_batch >= 5 THEN 'BLOCKED_BATCH_CALL_LIMIT' WHEN session_usd >= 0.02 THEN 'BLOCKED_SESSION_BUDGET' WHEN document_usd >= 0.005 THEN 'BLOCKED_DOCUMENT_BUDGET' ELSE 'ALLOW' END"""


@query(f"SELECT event_id, {_GATE} AS decision, CASE WHEN {_MODEL} = '' THEN 'none' WHEN {_MODEL} IN ('auto', 'openrouter/auto') THEN 'auto router' WHEN {_MODEL} LIKE '%:free' THEN 'free variant' END AS refusal FROM ({B.duck(_REQUESTS)})")
def live_gates(spark: SparkSession, d: str) -> DataFrame:
    """The first gate that stops each request; a preview, as nothing is reserved."""
    r = B.bind(spark, d, _REQUESTS)
    return r.select("event_id", P.live_gate({n: F.col(n) for n in r.columns if n != "event_id"}).alias("decision"), P.model_refusal(F.col("model")).alias("refusal"))


_USAGE = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('{"prompt_tokens": ', event_id, ', "completion_tokens": 7, "cost": 0.25}') WHEN 1 THEN concat('{"prompt_tokens": true, "completion_tokens": "9", "cost": false}')
 WHEN 2 THEN concat('{"prompt_tokens": 12, "prompt_tokens_details": {"cached_tokens": ', event_id % 50, '}, "completion_tokens_details": {"reasoning_tokens": 3}}') WHEN 3 THEN 'no json' WHEN 4 THEN '{}' ELSE concat('{"cost": ', event_id % 9, ', "prompt_tokens": null, "prompt_tokens_details": {"image_tokens": 4}}') END AS usage FROM {events}"""


def _number(path: str, kind: str) -> str:
    return f"CASE WHEN json_type(j, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(j, '{path}') AS {kind}) END"


@query(f"""WITH u AS (SELECT event_id, TRY_CAST(usage AS JSON) AS j FROM ({_USAGE.replace('{events}', 'events')}))
SELECT event_id, {_number('$.prompt_tokens', 'BIGINT')} AS input_tokens, {_number('$.completion_tokens', 'BIGINT')} AS output_tokens, {_number('$.prompt_tokens_details.image_tokens', 'BIGINT')} AS image_tokens, {_number('$.prompt_tokens_details.cached_tokens', 'BIGINT')} AS cached_tokens,
 {_number('$.completion_tokens_details.reasoning_tokens', 'BIGINT')} AS reasoning_tokens, {_number('$.cost', 'DOUBLE')} AS reported_usd FROM u""")
def provider_usage(spark: SparkSession, d: str) -> DataFrame:
    """Token counts as providers report them; what is missing stays null."""
    k = F.col("event_id")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit('{"prompt_tokens": '), k, F.lit(', "completion_tokens": 7, "cost": 0.25}')))
        .when(k % 6 == 1, '{"prompt_tokens": true, "completion_tokens": "9", "cost": false}')
        .when(k % 6 == 2, F.concat(F.lit('{"prompt_tokens": 12, "prompt_tokens_details": {"cached_tokens": '), k % 50, F.lit('}, "completion_tokens_details": {"reasoning_tokens": 3}}')))
        .when(k % 6 == 3, "no json")
        .when(k % 6 == 4, "{}")
        .otherwise(F.concat(F.lit('{"cost": '), k % 9, F.lit(', "prompt_tokens": null, "prompt_tokens_details": {"image_tokens": 4}}')))
    )
    return B.bind(spark, d, "SELECT event_id FROM {events}").select("event_id", P.usage(text).alias("u")).select("event_id", "u.*")


_NAMED = ("patient_name", "line2_charges", "line1_cpt_code", "line3_service_date", "diagnosis_code_b", "principal_dx_code", "provider_npi", "insured_id", "anything", "line1_units", "federal_tax_id", "billing_provider_npi")
_NAMES = "CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMED)) + " END"
_TEXTS = f"SELECT p_partkey, {_NAMES} AS name, CASE p_partkey % 5 WHEN 0 THEN concat('$', p_partkey, ',', p_size, '.5') WHEN 1 THEN concat(' ', p_name, ' ') WHEN 2 THEN concat(p_size, ' / ', p_partkey, ' / 2024') WHEN 3 THEN 'T' ELSE CAST(p_partkey AS STRING) END AS text, CASE p_partkey % 9 WHEN 0 THEN 'date' WHEN 1 THEN 'money' WHEN 2 THEN 'quantity' WHEN 3 THEN 'identifier' WHEN 4 THEN 'diagnosis_code' WHEN 5 THEN 'procedure_code' WHEN 6 THEN 'code' ELSE 'text' END AS kind FROM {{part}}"
_EXPECTED = "CASE " + " ".join(f"WHEN name = '{n}' OR regexp_replace(name, '^line[0-9]+_', '') = '{n}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for n, t in P.EXPECTATIONS.items()) + " WHEN contains(name, 'date') THEN 'a date, MM DD YYYY' WHEN contains(name, 'code') OR regexp_matches(name, '^(line[0-9]+_)?diagnosis') THEN 'an ICD-10 diagnosis code' ELSE 'a short printed value' END"


@query(f"""WITH t AS (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS d, regexp_extract_all(replace(text, ',', ''), '[0-9]+') AS g FROM ({B.duck(_TEXTS)}))
SELECT p_partkey, name, {_EXPECTED} AS expectation, CASE WHEN name = 'line3_service_date' THEN right(d, 8) WHEN name = 'line2_charges' THEN CASE WHEN len(g) >= 2 THEN g[1] || '.' || right(g[-1], 2) WHEN d <> '' THEN d || '.00' ELSE '' END WHEN name = 'line1_units' THEN CASE WHEN d <> '' THEN d WHEN contains(upper(text), 'T') THEN '1' ELSE '' END
 WHEN name = 'billing_provider_npi' THEN substr(d, 1, 10) WHEN name = 'federal_tax_id' THEN substr(d, 1, 9) ELSE trim(text) END AS retried, CASE WHEN p_partkey % 8 = 0 THEN 'checkbox-mark-detection' ELSE CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.RETRY_MODES.items())} END END AS mode,
 CASE WHEN p_partkey % 3 = 0 AND text <> '' THEN '[hidden]' ELSE text END AS shown FROM t""")
def retry_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a field is, how it is read again, what comes of it, and what a screenshot shows."""
    c = F.col
    t = B.bind(spark, d, _TEXTS)
    return t.select("p_partkey", "name", P.expectation(c("name")).alias("expectation"), P.retry_value(c("name"), c("text")).alias("retried"), P.retry_mode(c("kind"), c("p_partkey") % 8 == 0).alias("mode"), P.shown(c("text"), c("p_partkey") % 3 == 0).alias("shown"))


_BOXES = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'admission_date' WHEN l_partkey % 3 = 1 THEN 'patient_dob' ELSE 'units' END AS name, CASE WHEN l_suppkey % 2 = 0 THEN 'ub04' ELSE 'cms1500' END AS form, CASE WHEN l_partkey % 4 = 0 THEN ' ' WHEN l_partkey % 4 = 1 THEN NULL ELSE 'v' END AS value, CASE WHEN l_suppkey % 3 = 0 THEN 'ACCEPT' WHEN l_suppkey % 3 = 1 THEN 'ACCEPT_WITH_FLAG' ELSE 'RETRY' END AS state, l_linenumber % 2 AS retries, CAST(l_partkey % 700 AS DOUBLE) AS x, CAST(l_suppkey % 90 AS DOUBLE) AS y, (l_partkey % 101) / 1e2 AS confidence, l_linenumber % 5 <> 0 AS boxed FROM {lineitem}"
_CUT = "form = 'cms1500' AND name = 'admission_date'"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, x AS x0, CASE WHEN {_CUT} THEN y + 0.55e0 * 20 ELSE y END AS y0, CASE WHEN {_CUT} THEN x + 0.75e0 * 100 ELSE x + 100 END AS x1, y + 20 AS y1,
 CASE WHEN form = 'ub04' AND name = 'patient_dob' AND state IN ('ACCEPT', 'ACCEPT_WITH_FLAG') AND retries = 0 THEN 'RETRY' ELSE state END AS confirmed, CASE WHEN {_CUT} AND COALESCE(trim(value), '') = '' THEN 'ACCEPT' ELSE state END AS blank_state,
 CASE WHEN {_CUT} AND COALESCE(trim(value), '') = '' THEN NULL ELSE value END AS blank_value, CASE WHEN {_CUT} AND COALESCE(trim(value), '') = '' THEN 'INAPPLICABLE' END AS verdict, CASE WHEN {_CUT} AND COALESCE(trim(value), '') = '' THEN 'template_blank_policy' END AS stamp FROM ({B.duck(_BOXES)})""")
def value_regions(spark: SparkSession, d: str) -> DataFrame:
    """Value parts of boxes, dates of birth that wait for a second reading, optional blanks."""
    c = F.col
    b = B.bind(spark, d, _BOXES)
    box = F.struct(c("x").alias("x0"), c("y").alias("y0"), (c("x") + 100).alias("x1"), (c("y") + 20).alias("y1"))
    out = b.withColumns({"r": P.value_region(c("form"), c("name"), box), "p": P.blank_policy(c("form"), c("name"), c("value"), c("state"))})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "r.x0", "r.y0", "r.x1", "r.y1", P.confirmed(c("form"), c("name"), c("state"), c("retries")).alias("confirmed"), c("p.state").alias("blank_state"), c("p.value").alias("blank_value"), "p.verdict", "p.stamp")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN boxed AND {_CUT} THEN y + 11 WHEN boxed THEN y END AS y0, CASE WHEN boxed AND {_CUT} THEN NULL ELSE value END AS value, CASE WHEN boxed AND {_CUT} THEN 0 ELSE confidence END AS confidence, CASE WHEN boxed AND {_CUT} THEN 'RETRY' ELSE state END AS state,
 CASE WHEN boxed AND {_CUT} THEN 'a::0.0|b::0.0' ELSE 'a:' || COALESCE(value, '') || ':0.5|b:w:0.25' END AS attempts FROM ({B.duck(_BOXES)})""")
def labels_read_again(spark: SparkSession, d: str) -> DataFrame:
    """Fields whose first reading took in their label: emptied with all their attempts, cut, and retried."""
    c = F.col
    b = B.bind(spark, d, _BOXES)
    box = F.when(c("boxed"), F.struct(c("x").alias("x0"), c("y").alias("y0"), (c("x") + 100).alias("x1"), (c("y") + 20).alias("y1")))
    attempts = F.array(*(F.struct(F.lit(e).alias("engine"), v.alias("value"), F.lit(k).alias("confidence")) for e, v, k in (("a", c("value"), 0.5), ("b", F.lit("w"), 0.25))))
    r = b.select("l_orderkey", "l_linenumber", "l_partkey", P.label_read_again(c("form"), c("name"), box, F.struct("value", "confidence", "state"), attempts).alias("r"))
    text = F.array_join(F.transform("r.attempts", lambda a: F.concat_ws(":", a["engine"], F.coalesce(a["value"], F.lit("")), a["confidence"].cast("string"))), "|")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", c("r.bbox.y0").alias("y0"), "r.value", "r.confidence", "r.state", text.alias("attempts"))


@query("""SELECT c_custkey, CASE WHEN l < 0 OR l > 1 THEN 'local_accept_confidence' WHEN m IS NULL OR m > 1 THEN 'multimodal_accept_confidence' WHEN c_custkey % 7 = 0 THEN 'paid_escalation_criticalities' WHEN c_custkey % 11 = 0 THEN 'allow_optional_escalation' END AS error
FROM (SELECT c_custkey, c_custkey % 13 / 1e1 - 0.1 AS l, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 12 / 1e1 END AS m FROM customer)""")
def mode_checks(spark: SparkSession, d: str) -> DataFrame:
    """Operating modes that break a rule."""
    k = F.col("c_custkey")
    c = B.bind(spark, d, "SELECT c_custkey, c_custkey % 13 / 1e1 - 0.1 AS l, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 12 / 1e1 END AS m FROM {customer}")
    paid = F.when(k % 7 == 0, F.array(F.lit("high"), F.lit("some"))).otherwise(F.array(F.lit("high"), F.lit("med")))
    return c.select("c_custkey", P.mode_error(F.col("l"), F.col("m"), paid, k % 11 == 0).alias("error"))


# authorization with memory ---------------------------------------------------------------------
_CALLS = """SELECT event_id, CAST(floor(event_id / 40) AS BIGINT) AS session, event_id * 2 AS seq, md5(concat(CAST(user_id % 3 AS STRING), event_type, CAST(event_id % 3 AS STRING))) AS fingerprint, CAST(user_id % 3 AS STRING) AS doc, 'p' || CAST(event_id % 2 AS STRING) AS page, event_type AS field,
 event_id % 31 <> 0 AS enabled, event_id % 29 <> 0 AS adapter, event_id % 37 <> 0 AS test_flag, CASE WHEN event_id % 41 = 0 THEN ' ' ELSE 'k' END AS key, event_id % 43 <> 0 AS synthetic, CASE WHEN event_id % 47 = 0 THEN NULL ELSE (event_id % 52) / 2e2 END AS fraction,
 CASE WHEN event_id % 53 = 0 THEN 'a/b:free' ELSE 'a/b' END AS model, event_id % 59 <> 0 AS listed, event_id % 61 <> 0 AS vision,
 CASE WHEN event_id % 83 = 0 THEN 'none' WHEN event_id % 6 = 0 THEN 'release' ELSE 'complete' END AS ending, event_id * 2 + 1 + 2 * (event_id % 3) AS done, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 0e0 ELSE (event_id % 9) / 1e3 END AS billed_usd, event_id % 8 <> 0 AS called FROM {events}"""


def call_events(spark: SparkSession, d: str) -> DataFrame:
    """Requests and ends of calls, forty requests a session."""
    c = F.col
    calls = B.bind(spark, d, _CALLS).withColumn("crop_refusal", P.crop_refusal(c("fraction")))
    gates = {n: c(n) for n in ("enabled", "adapter", "test_flag", "key", "synthetic", "crop_refusal", "model", "listed", "vision")}
    own = ["session", c("event_id").alias("call_id"), "fingerprint", "doc", "page", "field"]
    asked = calls.select("seq", F.lit("request").alias("kind"), P.static_gate(gates).alias("blocked"), F.lit(None).cast("double").alias("billed_usd"), F.lit(None).cast("boolean").alias("called"), *own)
    ended = calls.filter("ending != 'none'").select(c("done").alias("seq"), c("ending").alias("kind"), F.lit(None).cast("string").alias("blocked"), "billed_usd", "called", *own)
    return asked.unionByName(ended)


@query(f"""WITH RECURSIVE c AS ({B.duck(_CALLS)}),
g AS (SELECT *, CASE WHEN NOT enabled THEN 'BLOCKED_LIVE_PATH_DISABLED' WHEN NOT adapter THEN 'BLOCKED_ADAPTER_DISABLED' WHEN NOT test_flag THEN 'BLOCKED_LIVE_TEST_FLAG_UNSET' WHEN trim(key) = '' THEN 'BLOCKED_NO_API_KEY' WHEN NOT synthetic THEN 'BLOCKED_NOT_SYNTHETIC'
  WHEN fraction IS NULL OR fraction > 0.25 THEN 'BLOCKED_NOT_A_CROP' WHEN model LIKE '%:free' THEN 'BLOCKED_MODEL_REFUSED' WHEN NOT listed THEN 'BLOCKED_MODEL_NOT_ALLOWLISTED' WHEN NOT vision THEN 'BLOCKED_MODEL_NOT_VISION' END AS blocked,
  coalesce(billed_usd, CASE WHEN called THEN 0.005e0 ELSE 0e0 END) AS charged FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY moment) AS k FROM (SELECT *, seq AS moment, 'request' AS kind FROM g UNION ALL SELECT *, done, ending FROM g WHERE ending <> 'none')),
w AS (
  SELECT session, 0 AS k, CAST(NULL AS BIGINT) AS flying, CAST([] AS STRUCT(f VARCHAR, d VARCHAR, p VARCHAR, n VARCHAR, usd DOUBLE, call BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS call_id, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS BIGINT) AS reused_from, CAST(NULL AS DOUBLE) AS avoided_usd FROM (SELECT DISTINCT session FROM e)
  UNION ALL
  SELECT session, k, CASE WHEN decision = 'ALLOW' THEN event_id WHEN kind <> 'request' AND flying = event_id THEN NULL ELSE flying END,
    CASE WHEN kind = 'complete' AND flying = event_id THEN list_append(held, struct_pack(f := fingerprint, d := doc, p := page, n := field, usd := charged, call := event_id)) ELSE held END,
    moment, event_id, decision, CASE WHEN decision = 'REUSED_CACHED_RESULT' THEN same[1].call END, CASE WHEN decision = 'REUSED_CACHED_RESULT' THEN same[1].usd END
  FROM (SELECT *, CASE WHEN kind <> 'request' THEN NULL WHEN blocked IS NOT NULL THEN blocked WHEN len(same) > 0 THEN 'REUSED_CACHED_RESULT' WHEN flying IS NOT NULL THEN 'BLOCKED_PARALLEL_CALL'
      WHEN len(list_filter(of_field, lambda x: x.usd > 0)) >= 1 THEN 'BLOCKED_FIELD_PAID_ATTEMPTS' WHEN len(of_field) >= 1 THEN 'BLOCKED_FIELD_CALL_LIMIT' WHEN len(of_page) >= 2 THEN 'BLOCKED_PAGE_CALL_LIMIT' WHEN len(of_doc) >= 3 THEN 'BLOCKED_DOCUMENT_CALL_LIMIT' WHEN len(held) >= 5 THEN 'BLOCKED_BATCH_CALL_LIMIT'
      WHEN coalesce(list_sum(list_transform(held, lambda x: x.usd)), 0) >= 0.02e0 THEN 'BLOCKED_SESSION_BUDGET' WHEN coalesce(list_sum(list_transform(of_doc, lambda x: x.usd)), 0) >= 0.005e0 THEN 'BLOCKED_DOCUMENT_BUDGET' ELSE 'ALLOW' END AS decision
    FROM (SELECT e.* EXCLUDE (seq), w.flying, w.held, list_filter(w.held, lambda x: x.f = e.fingerprint) AS same, list_filter(w.held, lambda x: x.d = e.doc AND x.p = e.page AND x.n = e.field) AS of_field, list_filter(w.held, lambda x: x.d = e.doc AND x.p = e.page) AS of_page, list_filter(w.held, lambda x: x.d = e.doc) AS of_doc
      FROM w JOIN e ON e.session = w.session AND e.k = w.k + 1)))
SELECT session, seq, call_id, decision, reused_from, avoided_usd FROM w WHERE decision IS NOT NULL""")
def live_authorization(spark: SparkSession, d: str) -> DataFrame:
    """Every request decided by its session's memory: what was answered, what is in flight, counts and money so far."""
    return authorization.authorize_table(call_events(spark, d))
