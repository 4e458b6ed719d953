"""Queries of views, exports, templates, applied candidates and single rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators import candidates, evaluation, exports, oversight, review
from ..sources import fixed_width, records
from . import bind as B
from . import summaries as S

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = B.exact_rounds(sql)
        return f

    return keep


@query(f"WITH {S._RECEIPTS} SELECT doc, field, value, decision, confidence FROM receipts")
def result_view(spark: SparkSession, d: str) -> DataFrame:
    """Fields as a customer gets them."""
    return exports.result_view(S._receipts(spark, d))


@query(f"WITH {S._RECEIPTS} SELECT * EXCLUDE (value, primary_candidate, retry_candidate, model_candidate) FROM receipts")
def audit_view(spark: SparkSession, d: str) -> DataFrame:
    """Fields as an audit sees them, without values."""
    return exports.audit_view(S._receipts(spark, d))


@query("SELECT event_id, event_type AS kind, event_id % 5 AS shown, len(list_filter(range(0, event_id % 4), lambda i: true)) AS parts FROM events")
def public_view(spark: SparkSession, d: str) -> DataFrame:
    """Private fields of structs in arrays and of maps are gone."""
    e = B.bind(spark, d, "SELECT event_id, event_type AS kind, value AS _raw FROM {events}")
    inner = F.struct((F.col("event_id") % 5).alias("shown"), F.lit("s").alias("_secret"))
    rows = e.withColumns({"m": F.create_map(F.lit("a"), inner, F.lit("_b"), inner), "parts": F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("event_id") % 4), lambda i: F.struct(i.alias("i"), F.lit(1).alias("_i")))})
    out = exports.public_view(rows)
    return out.select("event_id", "kind", F.when(F.size("m") == 1, F.col("m")["a"]["shown"]).alias("shown"), F.size("parts").cast("long").alias("parts"))


_ROWS = "SELECT event_id AS page, event_type AS field_name, 'v' || CAST(event_id AS STRING) AS value, CASE WHEN event_id % 3 = 0 THEN 'ACCEPT' ELSE 'RETRY' END AS state, (event_id % 100) / 1e2 AS confidence, (event_id % 7) / 1e4 AS cost_usd, 'med' AS criticality FROM {events}"


@query(f"""WITH r AS ({B.duck(_ROWS)}) SELECT *, NULL AS coverage_json, NULL AS cost_dashboard_json FROM r UNION ALL SELECT NULL, '__DOCUMENT_SUMMARY__', NULL, NULL, NULL, NULL, NULL, '{{"fields":' || COUNT(*) || '}}', '{{"accepted":' || COUNT(*) FILTER (state = 'ACCEPT') || '}}' FROM r""")
def document_csv(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a document's CSV with their summary."""
    r = B.bind(spark, d, _ROWS)
    return exports.document_rows(r, r.agg(F.count("*").alias("fields")), r.agg(F.count_if(F.col("state") == "ACCEPT").alias("accepted")))


@query("SELECT c_mktsegment AS grp, COUNT(*) FILTER (c_custkey % 50 <> 0) AS images, COUNT(*) FILTER (c_custkey % 50 = 0) AS outputs, COUNT(*) FILTER (c_custkey % 50 = 0) = 1 AS sound FROM customer GROUP BY c_mktsegment")
def group_layout(spark: SparkSession, d: str) -> DataFrame:
    """Groups of files with exactly one output."""
    c = B.bind(spark, d, "SELECT c_custkey, c_mktsegment FROM {customer}")
    name = F.when(F.col("c_custkey") % 50 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(".TXT"))).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".tif")))
    return exports.group_layout(c.select(F.concat(F.lit("s3://x/in/"), "c_mktsegment", F.lit("/"), name).alias("path")))


_RENDERED = "SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'cms1500' ELSE 'ub04' END AS form, l_linenumber AS variant, l_orderkey AS seed, 'f' || CAST(l_partkey % 37 AS STRING) AS field_name, MIN(l_partkey) AS box FROM {lineitem} GROUP BY 1, 2, 3, 4"


@query(f"""WITH b AS ({B.duck(_RENDERED)}), f AS (SELECT form, variant, field_name, MIN(seed) AS seed, arg_min(box, seed) AS box FROM b GROUP BY form, variant, field_name),
p AS (SELECT form, variant, seed, row_number() OVER (PARTITION BY form, variant ORDER BY seed) AS k FROM (SELECT DISTINCT form, variant, seed FROM b)), g AS (SELECT p.* FROM p SEMI JOIN f ON p.form = f.form AND p.variant = f.variant AND p.seed = f.seed),
w AS (SELECT *, k - COALESCE(lag(k) OVER (PARTITION BY form, variant ORDER BY k), 0) AS gap FROM g), u AS (SELECT form, variant, MIN(seed) AS until FROM w WHERE gap > 20 GROUP BY form, variant)
SELECT f.* FROM f LEFT JOIN u ON f.form = u.form AND f.variant = u.variant WHERE until IS NULL OR f.seed < until""")
def build_template(spark: SparkSession, d: str) -> DataFrame:
    """The first box of each field, while pages still show new ones."""
    return exports.build_template(B.bind(spark, d, _RENDERED)).select("form", "variant", "field_name", "seed", "box")


_ANSWERED = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'new' || CAST(event_id AS STRING) END AS candidate, event_id % 7 % 2 AS fails, event_id % 4 AS rules, CASE WHEN event_id % 3 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS outcome, (event_id % 90) / 1e2 AS answer_confidence, event_id % 2 AS calls, (event_id % 9) / 1e4 AS usd FROM {events} WHERE event_id % 6 < 4"


@query(f"""WITH f AS (SELECT event_id, value, state, local_conf AS confidence FROM ({B.duck(B.FIELDS)})), j AS (SELECT f.*, a.* EXCLUDE (event_id), a.candidate <> '' AND a.rules > 0 AND a.fails = 0 AND a.outcome = 'ACCEPTED' AS took FROM f LEFT JOIN ({B.duck(_ANSWERED)}) a ON f.event_id = a.event_id)
SELECT event_id, CASE WHEN took THEN candidate ELSE value END AS value, CASE WHEN took THEN answer_confidence ELSE confidence END AS confidence, CASE WHEN took THEN 'ACCEPT' WHEN outcome IS NOT NULL THEN 'HUMAN_REVIEW' ELSE state END AS state,
 CASE WHEN took THEN 'MULTIMODAL_ATTEMPTED' WHEN outcome IS NOT NULL THEN 'MULTIMODAL_FAILED' END AS workflow, COALESCE(calls, 0) AS external_calls, CASE WHEN NOT COALESCE(took, false) AND COALESCE(calls, 0) > 0 THEN 1 ELSE 0 END AS failed_calls, COALESCE(usd, 0) AS measured_usd FROM j""")
def apply_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Fields after a model's answers."""
    f = B.bind(spark, d, B.FIELDS).select("event_id", "value", "state", F.col("local_conf").alias("confidence"))
    return exports.apply_candidates(f, B.bind(spark, d, _ANSWERED), ["event_id"])


# single rules -----------------------------------------------------------------------------
_RULED = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || CAST(event_id AS STRING) WHEN event_id % 3 = 1 THEN NULL ELSE 'V' || CAST(event_id AS STRING) END AS expected, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'v' || CAST(event_id AS STRING) END AS value, event_id % 5 < 2 AS optional, event_id % 7 = 0 AS override, CASE WHEN event_id % 2 = 0 THEN 'ACCEPT_WITH_OVERRIDE' ELSE 'ACCEPT' END AS state, CASE WHEN event_id % 14 = 0 THEN '' ELSE 'me' END AS reviewer, event_id % 11 <> 0 AS external, CASE WHEN event_id % 6 = 0 THEN 'high' WHEN event_id % 6 < 3 THEN 'med' ELSE 'low' END AS criticality FROM {events}"


@query(f"""SELECT event_id, COALESCE(expected, '') <> '' OR NOT optional OR value <> '' AS included, CASE WHEN expected IS NULL THEN value = '' ELSE lower(expected) = lower(value) END AS right_value, CASE WHEN override THEN state = 'ACCEPT_WITH_OVERRIDE' AND reviewer <> '' ELSE state <> 'ACCEPT_WITH_OVERRIDE' END AS state_allowed,
 external AND criticality IN ('high', 'med') AND NOT optional AS eligible FROM ({B.duck(_RULED)})""")
def field_rules(spark: SparkSession, d: str) -> DataFrame:
    """Inclusion, correctness without an expectation, allowed states, eligibility."""
    c = F.col
    r = B.bind(spark, d, _RULED)
    return r.select("event_id", evaluation.included(c("expected"), c("optional"), c("value")).alias("included"), evaluation.correct(c("expected"), c("value")).alias("right_value"), D.state_allowed(c("state"), c("override"), c("reviewer"), F.lit("why")).alias("state_allowed"), review.eligible(c("external"), c("criticality"), F.array(F.lit("high"), F.lit("med")), c("optional")).alias("eligible"))


_TOKENS = "SELECT DISTINCT user_id AS page, 't' || CAST(event_id % 50 AS STRING) AS token FROM {events} WHERE event_id % 2 = 0"


@query(f"""WITH t AS (SELECT user_id AS page, 't' || (event_id % 50) AS value FROM events WHERE event_id % 3 = 0), k AS ({B.duck(_TOKENS)}) SELECT t.page, COUNT(*) AS values, COUNT(k.token) AS found, round_even(CAST(COUNT(k.token) AS DOUBLE) / COUNT(*), 6) AS recall FROM t LEFT JOIN k ON t.page = k.page AND t.value = k.token GROUP BY t.page""".replace("AS values", 'AS "values"'))
def token_recall(spark: SparkSession, d: str) -> DataFrame:
    """Truth values among a page's tokens."""
    truth = B.bind(spark, d, "SELECT user_id AS page, 't' || CAST(event_id % 50 AS STRING) AS value FROM {events} WHERE event_id % 3 = 0")
    return evaluation.token_recall(truth, B.bind(spark, d, _TOKENS), ["page"])


@query(f"""WITH c AS (SELECT user_id AS doc, event_type AS field_name, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'a' END AS actual, CASE WHEN event_id % 3 = 0 THEN 'correct' ELSE 'incorrect' END AS outcome FROM events)
SELECT doc, COUNT(*) AS evaluated, COUNT(*) FILTER (outcome = 'correct') AS "right", COUNT(*) FILTER (actual <> '') AS present, COUNT(*) AS entries FROM c GROUP BY doc""")
def private_rows(spark: SparkSession, d: str) -> DataFrame:
    """What of a comparison may leave."""
    c = B.bind(spark, d, "SELECT user_id AS doc, event_type AS field_name, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'a' END AS actual, CASE WHEN event_id % 3 = 0 THEN 'correct' ELSE 'incorrect' END AS outcome FROM {events}")
    return oversight.private_row(c, ["doc"]).select("doc", "evaluated", "right", "present", F.size("fields").cast("long").alias("entries"))


_FAMILIES = ("line1_date_from", "units", "billing_provider_npi", "federal_tax_id", "line2_cpt_code", "diagnosis_code_a")


@query("""WITH s AS (SELECT p_partkey, p_size, CAST(p_partkey AS VARCHAR) AS k FROM part), n AS (SELECT *, lpad(k, 8, '1') AS d8, lpad(k, 10, '2') AS d10, lpad(k, 9, '3') AS d9, lpad(k, 5, '4') AS d5 FROM s)
SELECT p_partkey, name, value FROM (SELECT p_partkey, 'line1_date_from' AS name, d8 AS value FROM n UNION ALL SELECT p_partkey, 'units', CAST(p_size AS VARCHAR) FROM n UNION ALL SELECT p_partkey, 'billing_provider_npi', d10 FROM n UNION ALL SELECT p_partkey, 'federal_tax_id', d9 FROM n UNION ALL SELECT p_partkey, 'line2_cpt_code', d5 FROM n UNION ALL SELECT p_partkey, 'diagnosis_code_a', 'A1' || (p_size % 10) || '.' || d5[1:2] FROM n)""")
def candidate_families(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every family but money, from one clean span each."""
    s = B.bind(spark, d, "SELECT p_partkey, p_size, CAST(p_partkey AS STRING) AS k FROM {part}")
    texts = (F.lpad("k", 8, "1"), F.col("p_size").cast("string"), F.lpad("k", 10, "2"), F.lpad("k", 9, "3"), F.lpad("k", 5, "4"), F.concat(F.lit("A1"), (F.col("p_size") % 10).cast("string"), F.lit("."), F.substring(F.lpad("k", 5, "4"), 1, 2)))
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.array(t).alias("texts")) for n, t in zip(_FAMILIES, texts)))
    return candidates.explode(s.select("p_partkey", F.inline(pairs)), "name", "texts", ["p_partkey"]).select("p_partkey", "name", "value")


# 192-character files -------------------------------------------------------------------------
def _ub(spark: SparkSession, d: str) -> DataFrame:
    """Orders as written 192-character files of several splits: every plain field filled, all slots of records 50, 60 and 61; every ninth claim lacks its patient row."""
    o = B.bind(spark, d, "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS cents FROM {orders}")
    key = F.col("o_orderkey").cast("string")
    cents = F.lpad((F.col("cents") % 10_000_000).cast("string"), 10, "0")

    def row(tag: str, more: dict[int, tuple[int, Column]] | None = None) -> Column:
        cells = {a: (b - a + 1, F.concat(F.lit(n[:1].upper()), F.right(key, F.lit(b - a)))) for n, (t, a, b) in fixed_width.UB_FIELDS.items() if t == tag} | (more or {})
        parts, at = [F.lit(tag)], len(tag) + 1
        for start in sorted(cells):
            width, value = cells[start]
            parts += [F.lit(" " * (start - at)), F.rpad(value, width, " ")]
            at = start + width
        return F.rpad(F.concat(*parts), 192, " ")

    def slots(tag: str) -> dict[int, tuple[int, Column]]:
        """All slots but the last one of orders that are divisible by 5."""
        cells = {}
        for k, (revenue, code, units, charge) in enumerate(fixed_width.UB_SLOTS[tag]):
            off = (F.col("o_orderkey") % 5 == 0) & F.lit(k + 1 == len(fixed_width.UB_SLOTS[tag]))
            held = [(revenue, f"0{tag}{k}"), (code, "99213"), (units, f"{k + 1}0"), (charge, None)]
            for (a, b), text in ((x, t) for x, t in held if x):
                cells[a] = (b - a + 1, F.when(off, "").otherwise(F.right(cents, F.lit(b - a + 1)) if text is None else F.lit(text)))
        return cells

    name = {25: (20, F.concat(F.lit("LAST"), key)), 45: (9, F.lit("FIRST")), 54: (1, F.lit("M"))}
    patient = F.when(F.col("o_orderkey") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(row("20", name)))
    rows = F.concat(F.array(row("10")), patient, F.array(row("40"), row("50", slots("50")), row("60", slots("60")), row("61", slots("61")), row("70"), row("80"), row("90", {43: (10, cents)})))
    return B.written_blocks(spark, o, "o_orderkey", rows, "UB192", "\n")


_UB = f"o AS (SELECT * FROM (SELECT CAST(o_orderkey // {B.FILE_KEYS} AS VARCHAR) AS path, o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, CAST(floor(o_totalprice) AS BIGINT) % 10000000 AS cents, row_number() OVER (PARTITION BY o_orderkey // {B.FILE_KEYS} ORDER BY o_orderkey) AS ordinal FROM orders) WHERE o_orderkey % 9 <> 0)"
_UB_PLAIN = " UNION ALL ".join(f"SELECT path, ordinal, 'UB192' AS format_name, '{n}' AS field_name, '{n[:1].upper()}'" + (f" || right(k, {b - a})" if b > a else "") + " AS value FROM o" for n, (_, a, b) in fixed_width.UB_FIELDS.items())


@query(f"""WITH {_UB} {_UB_PLAIN} UNION ALL SELECT path, ordinal, 'UB192', 'patient_name', 'LAST' || k || ', FIRST M' FROM o UNION ALL SELECT path, ordinal, 'UB192', 'total_charges', CAST(CAST(cents / 100 AS DECIMAL(28,2)) AS VARCHAR) FROM o""")
def ub_records(spark: SparkSession, d: str) -> DataFrame:
    """All fields of 192-character claims."""
    return fixed_width.records(_ub(spark, d), "UB192")


@query(f"""WITH {_UB}, m AS (SELECT *, CAST(CAST(cents / 100 AS DECIMAL(18,2)) AS VARCHAR) AS c FROM o),
s AS (SELECT * FROM (VALUES (50, 0, 4), (50, 1, 4), (50, 2, 4), (50, 3, 4), (60, 0, 3), (60, 1, 3), (60, 2, 3), (61, 0, 3), (61, 1, 3), (61, 2, 3)) t(tag, slot, n)),
l AS (SELECT path, ordinal, c, tag, slot, row_number() OVER (PARTITION BY path, ordinal ORDER BY tag, slot) AS line_no FROM m, s WHERE NOT (o_orderkey % 5 = 0 AND slot + 1 = n))
SELECT path, ordinal, line_no, f AS field_name, CASE f WHEN 'charge' THEN c WHEN 'revenue_code' THEN '0' || tag || slot WHEN 'procedure_code' THEN CASE tag WHEN 50 THEN '' ELSE '99213' END ELSE (slot + 1) || '0' END AS value
FROM l, (VALUES ('revenue_code'), ('procedure_code'), ('units'), ('charge')) b(f)""")
def ub_lines(spark: SparkSession, d: str) -> DataFrame:
    """All slots of 192-character claims that are filled."""
    return fixed_width.service_lines(_ub(spark, d), "UB192")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, [CAST(192 + p_size AS INT)] AS widths FROM part WHERE p_size % 3 <> 0")
def bad_widths(spark: SparkSession, d: str) -> DataFrame:
    """Files with rows of another width."""
    p = B.bind(spark, d, "SELECT CAST(p_partkey AS STRING) AS path, p_size FROM {part}")
    wide = F.when(F.col("p_size") % 3 == 0, 192).otherwise(192 + F.col("p_size"))
    content = F.encode(F.concat(F.rpad(F.lit("10"), 192, " "), F.lit("\n"), F.rpad(F.lit("20"), wide, F.lit(" "))), "ISO-8859-1")
    return fixed_width.bad_widths(fixed_width.lines(p.select("path", content.alias("content"))), "UB192")


@query("SELECT user_id AS doc_id, event_type AS page_id, COUNT(DISTINCT event_id % 5) AS fields FROM events GROUP BY ALL")
def page_json(spark: SparkSession, d: str) -> DataFrame:
    """Pages as JSON objects, read again and counted."""
    e = B.bind(spark, d, "SELECT DISTINCT user_id AS doc_id, event_type AS page_id, 'f' || CAST(event_id % 5 AS STRING) AS field_name, 'v' AS value, 'ACCEPT' AS state, 0.5e0 AS confidence FROM {events}")
    out = records.page_json(e)
    return out.select("doc_id", "page_id", F.size(F.json_object_keys("json")).cast("long").alias("fields"))
