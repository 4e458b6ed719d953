"""Queries of text, typed values, rules, routing, candidates, regions and links, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import text as X
from ..functions import typed as Y
from ..functions import validators as V
from ..operators import candidates, evaluation, linkage, regions, review
from ..sources import dims, files, fixed_width, records
from ..sources.spread import spread
from . import bind as B

Q: dict = {}
SQL: dict[str, str] = {}
_SP = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = B.exact_rounds(sql)
        return f

    return keep


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return B.bind(spark, d, "SELECT doc_id, text, lang, source, n_chars FROM {documents}")


# text -----------------------------------------------------------------------
@query(f"SELECT doc_id, md5(lower(regexp_replace(text, '{_SP}+', '', 'g'))) AS norm, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS squash, md5(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]', '', 'g')) AS compact FROM documents")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(X.norm(t)).alias("norm"), F.md5(X.squash(t)).alias("squash"), F.md5(X.compact(t)).alias("compact"))


@query("""SELECT doc_id, CASE WHEN w = '' THEN 'empty' WHEN regexp_matches(w, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches(w, '^[A-Za-z]+$') THEN 'alphabetic' ELSE 'mixed' END AS char_type,
  CASE WHEN n = 0 THEN '0' WHEN n <= 4 THEN '1-4' WHEN n <= 9 THEN '5-9' WHEN n <= 19 THEN '10-19' ELSE '20+' END AS bucket
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g') AS w, length(coalesce(text, '')) AS n FROM documents)""")
def classify_chars(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.char_type(F.col("text")).alias("char_type"), X.length_bucket(F.length(F.coalesce("text", F.lit("")))).alias("bucket"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def dedup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return files.mark_duplicates(_docs(spark, d), F.col("text"), "doc_id").select("doc_id", "id", "duplicate")


@query()
def nfkc_fold(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.span_text(F.col("text")).alias("text"))


_SEEN = "regexp_replace(upper(replace(t, 'ß', 'ss')), '[^A-Z0-9]', '', 'g')"
_MARKED = "SELECT page_id, COALESCE(html, '') || CASE page_id % 4 WHEN 0 THEN ' Uniform Bill, Revenue; patient' WHEN 1 THEN ' CMS-1500 Insured' WHEN 2 THEN ' UB-04 / Insured' ELSE '' END AS t FROM {pages}"


@query(f"""WITH p AS (SELECT page_id, {_SEEN} AS t FROM ({B.duck(_MARKED)})), s AS (SELECT page_id, {' + '.join(f"CAST(contains(t, '{m}') AS INT)" for m in X.CMS_MARKERS)} AS cms, {' + '.join(f"CAST(contains(t, '{m}') AS INT)" for m in X.UB_MARKERS)} AS ub FROM p)
SELECT page_id, CASE WHEN ub > cms THEN 'ub04' ELSE 'cms1500' END AS form, cms, ub FROM s""")
def marker_classify(spark: SparkSession, d: str) -> DataFrame:
    p, t = B.bind(spark, d, _MARKED), F.col("t")
    return p.select("page_id", X.form_of(t).alias("form"), X.marker_score(t, X.CMS_MARKERS).alias("cms"), X.marker_score(t, X.UB_MARKERS).alias("ub"))


_PG = "SELECT o_custkey AS doc, o_orderkey AS page, CASE WHEN o_orderkey % 5 = 0 THEN 'Health Insurance Claim Form for the insured' WHEN o_orderkey % 5 = 1 THEN 'patient letter' ELSE 'fax' END AS t FROM {orders}"


@query(f"""WITH p AS (SELECT doc, page, CASE WHEN t LIKE 'Health%' THEN 2 WHEN t LIKE 'patient%' THEN 1 ELSE 0 END AS s FROM ({B.duck(_PG)})), m AS (SELECT doc, MAX(s) AS top FROM p GROUP BY doc)
SELECT m.doc, CASE WHEN top >= 2 AND COUNT(*) FILTER (s = top) = 1 THEN MAX(page) FILTER (s = top) END AS winner, CAST(top AS INT) AS top, COUNT(*) FILTER (s = top) AS winners FROM p JOIN m ON p.doc = m.doc GROUP BY m.doc, top""")
def select_page_unique_winner(spark: SparkSession, d: str) -> DataFrame:
    return linkage.select_claim_page(B.bind(spark, d, _PG), "doc", "page", "t")


_SCORES = "SELECT l_orderkey AS page, l_returnflag || l_linestatus AS form, MAX(l_partkey % 101) / 1e2 AS score FROM {lineitem} GROUP BY l_orderkey, l_returnflag || l_linestatus"


@query(f"""WITH s AS ({B.duck(_SCORES)}), r AS (SELECT *, row_number() OVER w AS k, COALESCE(lead(score) OVER w, 0.0) AS second FROM s WINDOW w AS (PARTITION BY page ORDER BY score DESC, form))
SELECT page, CASE WHEN score >= 0.75 AND score - second >= 0.05 THEN form END AS routed, score AS best, second FROM r WHERE k = 1""")
def router_winner(spark: SparkSession, d: str) -> DataFrame:
    return linkage.route(B.bind(spark, d, _SCORES), "page", "form", "score")


_LETTER = """SELECT c_custkey, 'Patient Name: ' || replace(c_name, '#', ' ') || '  DOB 0' || CAST(c_custkey % 9 + 1 AS STRING) || '/1' || CAST(c_custkey % 9 AS STRING) || '/1985 total charge: $' || CAST(c_custkey * 13 AS STRING) || '.50 NPI ' || CAST(1000000000 + c_custkey AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' Patient Account No: AC-' || CAST(c_custkey AS STRING) || '-Z' END || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' ICD-10 Code: B' || CAST(c_custkey % 90 + 10 AS STRING) || '.' || CAST(c_custkey % 10 AS STRING) END AS t FROM {customer}"""


@query(f"""WITH c AS (SELECT c_custkey, upper(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM ({B.duck(_LETTER)}))
SELECT c_custkey, trim(regexp_extract(t, '(?:PATIENT|MEMBER)\\s+NAME\\s*[:#-]?\\s*([A-Z][A-Z ,.''-]{{3,45}})', 1)) AS patient_name, regexp_extract(t, 'DOB\\s*[:#-]?\\s*([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', 1) AS patient_dob,
  trim(regexp_extract(t, 'TOTAL CHARGE\\s*[:$#-]?\\s*(\\$?\\s*[0-9][0-9,]*\\.\\d{{2}})', 1)) AS total_charge, regexp_extract(t, 'NPI\\s*[:#-]?\\s*(\\d{{10}})', 1) AS provider_npi,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'AC-' || c_custkey || '-Z' END AS patient_account_no, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'B' || (c_custkey % 90 + 10) || '.' || (c_custkey % 10) END AS diagnosis_1 FROM c""")
def label_extract(spark: SparkSession, d: str) -> DataFrame:
    c = B.bind(spark, d, _LETTER).withColumn("m", X.labelled(F.col("t")))
    return c.select("c_custkey", *(F.coalesce(F.col("m")[n], F.lit("")).alias(n) for n in X.LABELS))


# typed values ----------------------------------------------------------------
_PARTS = "regexp_extract_all(printed, '[0-9]+')"


def _ymd(y: str, m: str, d: str) -> str:
    return f"try_strptime(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d')"


_CENT = "CASE WHEN length({0}) = 2 THEN CASE WHEN TRY_CAST({0} AS INT) <= {1} THEN '20' ELSE '19' END || {0} ELSE {0} END"


@query(f"""WITH p AS (SELECT o_orderkey, {_PARTS} AS a, regexp_replace(printed, '[^0-9]', '', 'g') AS g FROM ({B.duck(B.DATES)})),
k AS (SELECT *, len(a) = 3 AND length(a[1]) || '' || length(a[2]) || length(a[3]) IN ('222','224','124','214','114','122','212','112') AS three, length(g) IN (6, 8) AS run FROM p),
r AS (SELECT *, CASE WHEN three THEN a[1] WHEN run THEN g[1:2] END AS m, CASE WHEN three THEN a[2] WHEN run THEN g[3:4] END AS dd, CASE WHEN three THEN a[3] WHEN run THEN g[5:] END AS y FROM k)
SELECT o_orderkey, strftime(CAST({_ymd(_CENT.format('y', 26), 'm', 'dd')} AS DATE), '%Y-%m-%d') AS printed_date,
  COALESCE(strftime(CASE WHEN length(g) = 6 THEN {_ymd(_CENT.format('g[5:6]', 68), 'g[1:2]', 'g[3:4]')} WHEN length(g) = 8 THEN COALESCE({_ymd('g[1:4]', 'g[5:6]', 'g[7:8]')}, {_ymd('g[5:8]', 'g[1:2]', 'g[3:4]')}) END, '%Y%m%d'), g) AS compared_date FROM r""")
def typed_date_two_pivots(spark: SparkSession, d: str) -> DataFrame:
    p = B.bind(spark, d, B.DATES)
    return p.select("o_orderkey", F.date_format(Y.printed_date(F.col("printed")), "yyyy-MM-dd").alias("printed_date"), Y.compared_date(F.col("printed")).alias("compared_date"))


_MONEY = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 6 = 0 THEN '$' || CAST(l_partkey AS STRING) || ',0' || CAST(l_suppkey % 90 + 10 AS STRING) || '.5' WHEN l_partkey % 6 = 1 THEN CAST(l_partkey AS STRING) WHEN l_partkey % 6 = 2 THEN 'n/a' WHEN l_partkey % 6 = 3 THEN CAST(l_suppkey AS STRING) || '.0' WHEN l_partkey % 6 = 4 THEN '1-2' ELSE '' END AS v FROM {lineitem}"


@query(f"""WITH m AS (SELECT *, regexp_replace(v, '[^0-9.-]', '', 'g') AS n FROM ({B.duck(_MONEY)}))
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v = '' THEN '' ELSE COALESCE(CAST(CAST(TRY_CAST(n AS DECIMAL(30,10)) AS DECIMAL(28,2)) AS VARCHAR), n) END AS money,
  CASE WHEN v = '' THEN '' ELSE COALESCE(regexp_replace(regexp_replace(CAST(TRY_CAST(n AS DECIMAL(30,10)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), regexp_replace(upper(v), '[^A-Z0-9]', '', 'g')) END AS quantity FROM m""")
def money_and_quantity(spark: SparkSession, d: str) -> DataFrame:
    m = B.bind(spark, d, _MONEY)
    return m.select("l_orderkey", "l_linenumber", "l_partkey", Y.compared_value(F.lit("line1_charges"), F.col("v")).alias("money"), Y.compared_value(F.lit("units"), F.col("v")).alias("quantity"))


# Names of fields and the families they belong to, written out; # is the line's number.
_FAMILIES = (("line#_date_from", "date"), ("line#_charges", "money"), ("line#_units", "quantity"), ("line#_cpt_code", "text"), ("patient_dob", "date"), ("total_charge", "money"), ("units", "quantity"), ("diagnosis_1", "code"), ("mystery_field_#", "text"), ("type_of_bill", "text"), ("provider_npi", "code"), ("x#_service_date", "date"))
_NAMED = "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 12 " + " ".join(f"WHEN {k} THEN replace('{n}', '#', CAST(l_linenumber AS STRING))" for k, (n, _) in enumerate(_FAMILIES)) + " END AS name FROM {lineitem}"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, name, CASE l_partkey % 12 {' '.join(f"WHEN {k} THEN '{f}'" for k, (_, f) in enumerate(_FAMILIES))} END AS family FROM ({B.duck(_NAMED)})")
def classify_field(spark: SparkSession, d: str) -> DataFrame:
    """The family of every line's field by its name."""
    return B.bind(spark, d, _NAMED).withColumn("family", Y.family(F.col("name")))


_NPI = "SELECT c_custkey, CAST(1000000000 + c_custkey * 7919 AS STRING) AS npi FROM {customer}"
_LUHN = " + ".join(f"(CASE WHEN {k} > 9 THEN {k} - 9 ELSE {k} END)" for k in [f"CAST(substr(x, {i}, 1) AS INT) * {2 if (15 - i) % 2 else 1}" for i in range(1, 16)])


@query(f"WITH n AS (SELECT c_custkey, npi, '80840' || npi AS x FROM ({B.duck(_NPI)})) SELECT c_custkey, ({_LUHN}) % 10 = 0 AS valid FROM n")
def luhn_npi(spark: SparkSession, d: str) -> DataFrame:
    return B.bind(spark, d, _NPI).select("c_custkey", Y.npi_valid(F.col("npi")).alias("valid"))


# rules ------------------------------------------------------------------------
_VALUES = """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN '99213' WHEN 1 THEN 'E11.9' WHEN 2 THEN CAST(p_size AS STRING) || '.50' WHEN 3 THEN 'Parker, Lori' WHEN 4 THEN '0450' WHEN 5 THEN '55456-1234' WHEN 6 THEN '12-3456789'
  WHEN 7 THEN upper(substr(p_type, 1, 6)) || '77' WHEN 8 THEN 'i10 ' WHEN 9 THEN 'Parker, Lori Parker, Lori' WHEN 10 THEN CAST(p_size AS STRING) ELSE p_name END AS v FROM {part}"""
_SHAPES = {
    "cpt_format": r"regexp_matches(t, '^\d{5}$')",
    "cpt_dictionary": "t IN (" + ", ".join(f"'{c}'" for c in V.CPT) + ")",
    "icd10_format": r"regexp_matches(upper(t), '^[A-TV-Z]\d[0-9A-Z](\.[0-9A-Z]{1,4})?$')",
    "icd10_dictionary": "regexp_replace(upper(t), '[^A-Z0-9]', '', 'g') IN (" + ", ".join(f"'{c.replace('.', '')}'" for c in V.ICD10) + ")",
    "currency_format": r"regexp_matches(t, '^\d{1,7}\.\d{2}$')",
    "numeric_format": r"regexp_matches(t, '^\d{1,4}$')",
    "zip_format": r"regexp_matches(t, '^\d{5}(-\d{4})?$')",
    "tax_id_format": r"regexp_matches(t, '^\d{2}-?\d{7}$')",
    "id_format": r"regexp_matches(upper(t), '^[A-Z0-9]{6,15}$')",
    "name_format": r"length(t) BETWEEN 2 AND 40 AND length(t) - length(replace(t, ',', '')) = 1 AND regexp_matches(t, '^[A-Za-z .''-]+,\s*[A-Za-z .''-]+$')",
    "org_name_format": r"length(t) BETWEEN 2 AND 60 AND regexp_matches(t, '^[A-Za-z0-9 .,''&\-]+$') AND regexp_matches(t, '[A-Za-z]')",
    "revenue_code_format": r"t IN (" + ", ".join(f"'{c}'" for c in V.REVENUE) + r") OR regexp_matches(t, '^0\d{3}$')",
}


@query(f"WITH v AS (SELECT p_partkey, trim(v) AS t FROM ({B.duck(_VALUES)})) " + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS rule, CASE WHEN {x} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v" for n, x in _SHAPES.items()))
def format_validators(spark: SparkSession, d: str) -> DataFrame:
    v = B.bind(spark, d, _VALUES)
    made = F.array(*(F.struct(F.lit(n).alias("rule"), V.check(n, F.col("v"))["verdict"].alias("verdict")) for n in _SHAPES))
    return v.select("p_partkey", F.inline(made))


@query(f"""SELECT o_orderkey, CASE WHEN lines = 0 OR total_cents IS NULL THEN 'INAPPLICABLE' WHEN line_cents = total_cents THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({B.duck(B.CLAIMS)})""")
def claim_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    c = B.bind(spark, d, B.CLAIMS)
    ctx = V.Context(total=F.col("total_cents"), line_cents=F.col("line_cents"), lines=F.col("lines"))
    return c.select("o_orderkey", V.check("claim_arithmetic", F.lit("x"), ctx)["verdict"].alias("verdict"))


_DOB = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '01/15/1950' WHEN o_orderkey % 4 = 1 THEN '06/30/2001' WHEN o_orderkey % 4 = 2 THEN 'soon' ELSE '03 03 1870' END AS dob, date_format_(o_orderdate, '%m/%d/%Y') AS served FROM {orders}"""


@query(f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN DATE '1950-01-15' WHEN 1 THEN DATE '2001-06-30' WHEN 3 THEN DATE '1870-03-03' END AS b, CAST(o_orderdate AS DATE) AS s FROM orders)
SELECT o_orderkey, CASE WHEN b IS NOT NULL AND s < b THEN 'FAIL' WHEN s > DATE '2026-12-31' THEN 'FAIL' ELSE 'PASS' END AS service, CASE WHEN b IS NULL OR b >= s THEN 'FAIL' WHEN date_part('year', s) - date_part('year', b) - CASE WHEN strftime(s, '%m%d') < strftime(b, '%m%d') THEN 1 ELSE 0 END > 125 THEN 'FAIL' ELSE 'PASS' END AS dob FROM t""")
def date_chronology(spark: SparkSession, d: str) -> DataFrame:
    t = B.bind(spark, d, _DOB)
    ctx = V.Context(dob=F.col("dob"), claim_dates=F.array(Y.printed_date(F.col("served"))))
    return t.select("o_orderkey", V.check("dob_before_service", F.col("served"), ctx)["verdict"].alias("service"), V.check("patient_dob_valid", F.col("dob"), ctx)["verdict"].alias("dob"))


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, value, rule, optional FROM ({B.duck(B.ROUTED)}) WHERE rule <> '')
SELECT l_orderkey, l_linenumber, l_partkey, rule AS validator, CASE WHEN value = '' THEN CASE WHEN optional THEN 'INAPPLICABLE' ELSE 'FAIL' END WHEN rule = 'currency_format' AND regexp_matches(value, '^\\d{{1,7}}\\.\\d{{2}}$') THEN 'PASS'
  WHEN rule = 'id_format' AND regexp_matches(upper(value), '^[A-Z0-9]{{6,15}}$') THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""")
def validator_stamps_long(spark: SparkSession, d: str) -> DataFrame:
    r = B.bind(spark, d, B.ROUTED).filter("rule <> ''").select("l_orderkey", "l_linenumber", "l_partkey", "value", "rule", "optional")
    s = V.stamps(F.col("value"), F.array("rule"), F.col("optional"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", F.inline(s)).select("l_orderkey", "l_linenumber", "l_partkey", "validator", "verdict")


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'line3_charges' WHEN 1 THEN 'patient_address' WHEN 2 THEN 'amount_paid' WHEN 3 THEN 'patient_sex' ELSE 'unheard_of' END AS field_name FROM part)
SELECT p_partkey, field_name, CASE p_partkey % 5 WHEN 0 THEN 3 END AS line_no, CASE p_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 3 THEN 'low' ELSE 'med' END AS criticality, p_partkey % 5 = 2 AS optional, p_partkey % 5 IN (1, 3) AS allow_flag, p_partkey % 5 <> 1 AS external_allowed,
  CASE p_partkey % 5 WHEN 0 THEN 'currency_format,claim_arithmetic' WHEN 2 THEN 'currency_format' ELSE '' END AS rules FROM p""")
def policy_defaults_join(spark: SparkSession, d: str) -> DataFrame:
    p = B.bind(spark, d, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'line3_charges' WHEN 1 THEN 'patient_address' WHEN 2 THEN 'amount_paid' WHEN 3 THEN 'patient_sex' ELSE 'unheard_of' END AS field_name FROM {part}")
    out = dims.with_policy(p)
    return out.select("p_partkey", "field_name", dims.line_no(F.col("field_name")).alias("line_no"), "criticality", "optional", "allow_flag", "external_allowed", F.array_join("validators", ",").alias("rules"))


# routing ------------------------------------------------------------------------
_FIT = """CASE WHEN value = '' OR rule = '' THEN 0.5 WHEN rule = 'currency_format' AND regexp_matches(value, '^[\\d.,$ ]+$') THEN 1.0 WHEN rule = 'name_format' AND regexp_matches(value, '^[A-Za-z .,''\\-]+$') THEN 1.0 WHEN rule = 'id_format' AND regexp_matches(value, '^[A-Za-z0-9 ]+$') THEN 1.0 ELSE 0.0 END"""
_SPANFIT = "CASE WHEN n_spans = 0 THEN 0.0 WHEN n_spans <= 3 THEN 1.0 ELSE greatest(0.2, 1.0 - 0.15 * (n_spans - 3)) END"
_ROUTED = f"(SELECT * FROM ({B.duck(B.ROUTED)}))"
_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return B.bind(spark, d, B.ROUTED)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(0.55 * conf + 0.15 * quality + 0.15 * ({_SPANFIT}) + 0.15 * ({_FIT}), 4) AS confidence FROM {_ROUTED}")
def confidence_fusion(spark: SparkSession, d: str) -> DataFrame:
    r = _routed(spark, d)
    rules = F.when(F.col("rule") != "", F.array("rule")).otherwise(F.array().cast("array<string>"))
    return r.select(*_KEYS, D.fuse(F.col("conf"), F.col("quality"), F.col("n_spans"), F.col("value"), rules).alias("confidence"))


_DECIDE = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, criticality, CASE WHEN value = '' AND optional THEN 'ACCEPT' WHEN failing OR (value = '' AND rule <> '') THEN nxt WHEN conf >= 0.88 THEN 'ACCEPT' WHEN conf >= 0.60 AND flaggable THEN 'ACCEPT_WITH_FLAG' ELSE nxt END AS state
FROM (SELECT *, CASE WHEN retries < 1 THEN 'RETRY' WHEN external AND escalations < 1 THEN 'ESCALATE' WHEN NOT failing AND conf >= 0.60 AND flaggable THEN 'ACCEPT_WITH_FLAG' ELSE 'HUMAN_REVIEW' END AS nxt FROM (SELECT *, allow_flag AND criticality <> 'high' AS flaggable FROM {_ROUTED}))"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    r, c = _routed(spark, d), F.col
    accept, escalate, flag = D.PRESETS["balanced"]
    fails = F.when(c("failing"), F.array("rule")).otherwise(F.array().cast("array<string>"))
    rules = F.when(c("rule") != "", F.array("rule")).otherwise(F.array().cast("array<string>"))
    out = D.decide(c("value"), c("conf"), fails, rules, c("optional"), c("allow_flag"), c("external"), c("criticality"), c("retries"), c("escalations"), F.lit(accept), F.lit(escalate), F.lit(flag))
    return r.select(*_KEYS, "criticality", out.alias("d")).select(*_KEYS, "criticality", "d.state", "d.reason")


_REASON = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, criticality, state, CASE WHEN value = '' AND optional THEN 'optional field legitimately empty'
  WHEN failing OR (value = '' AND rule <> '') THEN CASE WHEN NOT failing AND state = 'ACCEPT_WITH_FLAG' THEN spent ELSE CASE WHEN failing THEN 'validator FAIL: ' || rule ELSE 'empty value on required field' END || tail END
  WHEN conf >= 0.88 THEN 'validators clean, conf ' || c || ' >= accept' WHEN conf >= 0.60 AND flaggable THEN criticality || ' criticality, validators clean, conf ' || c || ' tolerable'
  WHEN state = 'ACCEPT_WITH_FLAG' THEN spent ELSE 'conf ' || c || ' below accept threshold' || tail END AS reason
FROM (SELECT *, CASE state WHEN 'RETRY' THEN '; retry budget available' WHEN 'ESCALATE' THEN '; retry exhausted' ELSE '; attempt budget exhausted' END AS tail, 'attempts exhausted; validators clean, conf ' || c || ' tolerable for ' || criticality || ' criticality' AS spent
FROM (SELECT *, printf('%.2f', conf) AS c, CASE WHEN value = '' AND optional THEN 'ACCEPT' WHEN failing OR (value = '' AND rule <> '') THEN nxt WHEN conf >= 0.88 THEN 'ACCEPT' WHEN conf >= 0.60 AND flaggable THEN 'ACCEPT_WITH_FLAG' ELSE nxt END AS state
FROM (SELECT *, CASE WHEN retries < 1 THEN 'RETRY' WHEN external AND escalations < 1 THEN 'ESCALATE' WHEN NOT failing AND conf >= 0.60 AND flaggable THEN 'ACCEPT_WITH_FLAG' ELSE 'HUMAN_REVIEW' END AS nxt FROM (SELECT *, allow_flag AND criticality <> 'high' AS flaggable FROM {_ROUTED}))))"""


@query(_REASON)
def governor_decide(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)


@query(f"WITH g AS ({_DECIDE}) SELECT criticality, COUNT(*) AS fields, " + ", ".join(f"round_even(100e0 * COUNT(*) FILTER (state = '{s}') / COUNT(*), 4) AS {s.lower()}" for s in D.AUTOMATED) + " FROM g GROUP BY criticality")
def governor_funnel(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.funnel(_decided(spark, d), "criticality", D.AUTOMATED)


_TURNS = """SELECT conv_id, turn, t AS v, CASE WHEN turn % 3 = 0 THEN t WHEN turn % 3 = 1 THEN upper(replace(t, 'ß', 'ss')) ELSE 'other' END AS n,
  (conv_id * 7 % 100) / 1e2 AS c, (conv_id * 11 % 100) / 1e2 AS nc, conv_id % 3 = 0 AS f, conv_id % 4 = 0 AS nf, conv_id % 5 = 0 AS optional FROM (SELECT conv_id, turn, COALESCE(text, '') AS t FROM {conversations}) d"""
_N = "lower(regexp_replace(%s, '" + _SP + "+', '', 'g'))"


@query(f"""WITH t AS (SELECT *, {_N % 'v'} = {_N % 'n'} AND n <> '' AS agree FROM ({B.duck(_TURNS)})), u AS (SELECT *, CASE WHEN agree THEN least(1e0, nc + 0.1) ELSE nc END AS r FROM t),
w AS (SELECT *, CASE WHEN agree THEN 'agree' WHEN f AND NOT nf THEN 'retry_passes_validators' WHEN NOT f AND nf THEN 'keep_primary_validators' WHEN r > c + 0.05 THEN 'retry_higher_confidence' ELSE 'disagree_unresolved' END AS decision FROM u)
SELECT conv_id, turn, v, decision, round_even(CASE WHEN decision = 'agree' THEN least(1e0, greatest(c, r)) WHEN decision LIKE 'retry%' THEN r WHEN decision = 'disagree_unresolved' THEN least(c, 0.6e0) ELSE c END, 6) AS confidence FROM w""")
def retry_merge(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    t = B.bind(spark, d, _TURNS)
    return t.withColumn("m", D.merge_retry(c("v"), c("c"), c("f"), c("n"), c("nc"), c("nf"))).select("conv_id", "turn", "v", "m.decision", F.bround("m.confidence", 6).alias("confidence"))


@query(f"""WITH w AS (SELECT *, CASE WHEN nf AND NOT f THEN 'keep_primary_validators' WHEN f AND NOT nf THEN 'escalation_passes_validators' WHEN f AND nf THEN 'both_fail_validators' WHEN nc > c THEN 'escalation_higher_confidence' ELSE 'keep_primary_confidence' END AS decision FROM ({B.duck(_TURNS)}))
SELECT conv_id, turn, decision, CASE WHEN decision LIKE 'escalation%' THEN n ELSE v END AS value, CASE WHEN decision LIKE 'escalation%' THEN nc ELSE c END AS confidence FROM w""")
def model_merge(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    t = B.bind(spark, d, _TURNS)
    return t.withColumn("m", D.merge_model(c("v"), c("c"), c("f"), c("n"), c("nc"), c("nf"))).select("conv_id", "turn", "m.decision", "m.value", "m.confidence")


@query(f"""WITH t AS (SELECT conv_id, turn, optional, trim(CASE WHEN conv_id % 6 = 0 THEN '' WHEN conv_id % 6 = 1 THEN CAST(conv_id AS VARCHAR) ELSE n END) AS own, trim(repeat(v, CAST(turn % 9 AS INT))) AS seen FROM ({B.duck(_TURNS)})),
s AS (SELECT *, regexp_replace(lower(own), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(seen), '[^a-z0-9]', '', 'g') AS b, replace(own, ' ', '') AS bare FROM t)
SELECT conv_id, turn, own, CASE WHEN own = '' THEN CASE WHEN optional THEN '' ELSE 'empty value on a non-optional field' END ELSE
  array_to_string(list_filter([CASE WHEN b = '' THEN 'no visible_text evidence supplied' WHEN NOT contains(b, a) THEN 'ungrounded' END, CASE WHEN length(seen) > 120 THEN 'visible_text too long' END, CASE WHEN NOT regexp_matches(bare, '^\\$?\\s*[\\d,]+(\\.\\d{{1,2}})?$') THEN 'type mismatch: currency' END], lambda x: x IS NOT NULL), '; ') END AS rejects FROM s""")
def grounding_rejects(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    t = B.bind(spark, d, _TURNS)
    own = F.trim(F.when(c("conv_id") % 6 == 0, "").when(c("conv_id") % 6 == 1, c("conv_id").cast("string")).otherwise(c("n")))
    seen = F.repeat(c("v"), (c("turn") % 9).cast("int"))
    return t.select("conv_id", "turn", own.alias("own"), F.array_join(D.grounding_rejects(F.lit("line2_charges"), own, seen, c("optional"), F.lit(None).cast("string")), "; ").alias("rejects"))


_CALLS = "SELECT event_id, event_id % 700 AS status, CASE WHEN event_id % 3 = 0 THEN (event_id % 9) / 1e3 END AS reported, CASE WHEN event_id % 2 = 0 THEN (event_id % 7) / 1e3 END AS measured, event_id % 5 <> 0 AS called, CASE WHEN event_id % 4 = 0 THEN 'oracle' ELSE 'live' END AS mode, event_id % 6 = 0 AS cached, event_id % 13 <> 0 AS external, event_id % 7 <> 0 AS approved, event_id % 40 AS w, event_id % 90 AS h FROM {events}"


@query(f"""SELECT event_id, CASE WHEN status IN (401, 403) THEN 'AUTHENTICATION_ERROR' WHEN status = 408 THEN 'TIMEOUT' WHEN status = 429 THEN 'RATE_LIMIT' WHEN status >= 500 THEN 'PROVIDER_5XX' ELSE 'UNKNOWN_PROVIDER_ERROR' END AS category, status IN (408, 429) OR status >= 500 AS retryable,
  CASE WHEN NOT called THEN 0.0 ELSE COALESCE(reported, measured, 0.005) END AS billed, CASE WHEN mode = 'oracle' OR cached THEN 0.0 ELSE COALESCE(measured, 0.0) END AS measured_usd, CASE WHEN mode = 'oracle' AND NOT cached THEN COALESCE(measured, 0.0) ELSE 0.0 END AS projected_usd,
  CASE WHEN reported IS NOT NULL THEN 'reported' WHEN measured IS NOT NULL THEN 'measured' ELSE 'unknown' END AS basis,
  CASE WHEN NOT external THEN 'BLOCKED_EXTERNAL_FORBIDDEN' WHEN NOT approved THEN 'BLOCKED_MODEL_NOT_APPROVED' WHEN w < 8 OR h < 8 OR w * h > 900 THEN 'BLOCKED_CROP' WHEN cached THEN 'REUSED_CACHED_RESULT' ELSE 'CALL' END AS gate FROM ({B.duck(_CALLS)})""")
def provider_calls(spark: SparkSession, d: str) -> DataFrame:
    c, no = F.col, F.lit(False)
    e = B.bind(spark, d, _CALLS)
    costs = D.cost_columns(c("mode"), F.coalesce("measured", F.lit(0.0)), c("cached"))
    refusal = D.crop_allowed(c("w"), c("h"), F.lit(60), F.lit(60))
    kind = D.status_category(c("status"))
    return e.select(
        "event_id",
        kind.alias("category"),
        kind.isin(*D.RETRYABLE).alias("retryable"),
        D.billed(c("reported"), c("measured"), c("called"), F.lit(0.005)).alias("billed"),
        costs["measured_usd"].alias("measured_usd"),
        costs["projected_usd"].alias("projected_usd"),
        D.cost_basis(c("reported"), c("measured"), F.lit(None).cast("double"))["basis"].alias("basis"),
        D.policy_gate(c("external"), c("approved"), F.lit(0), F.lit(1), no, refusal, c("cached")).alias("gate"),
    )


# candidates ---------------------------------------------------------------------
_CAND = "SELECT event_id AS candidate_no, user_id, event_type, lower(event_type) || CAST(event_id % 4 AS STRING) AS key, event_id % 3 AS failures, event_id % 2 AS passes, (event_id % 50) / 5e1 AS confidence, event_id % 5 AS attempt_index FROM {events}"


@query(f"WITH c AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id, event_type, key) AS agreement FROM ({B.duck(_CAND)})), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY failures, passes DESC, agreement DESC, confidence DESC, attempt_index, candidate_no) AS k FROM c) SELECT * EXCLUDE (k) FROM r WHERE k = 1")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    return candidates.rank(B.bind(spark, d, _CAND), ["user_id", "event_type"])


@query(f"SELECT user_id, event_type, key, MIN(candidate_no) AS candidate_no FROM ({B.duck(_CAND)}) GROUP BY ALL")
def candidate_dedup(spark: SparkSession, d: str) -> DataFrame:
    return candidates.first_seen(B.bind(spark, d, _CAND), ["user_id", "event_type"], "key", "candidate_no").select("user_id", "event_type", "key", "candidate_no")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey AS VARCHAR) AS a, CAST(l_partkey % 97 + 10 AS VARCHAR) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, arg_min(v.value, v.n) AS value, CAST(min(v.n) AS INT) AS candidate_no
FROM (SELECT *, unnest([{'value': a || '.' || right(b, 2), 'n': 0, 'key': CAST(a || '.' || right(b, 2) AS DECIMAL(28,2))}, {'value': '$' || a, 'n': 1, 'key': CAST(a AS DECIMAL(28,2))}, {'value': b, 'n': 2, 'key': CAST(b AS DECIMAL(28,2))}, {'value': '$' || a || ' ' || b, 'n': 3, 'key': CAST(a || b AS DECIMAL(28,2))}]) AS v FROM s)
GROUP BY l_orderkey, l_linenumber, l_partkey, v.key""")
def candidate_money(spark: SparkSession, d: str) -> DataFrame:
    s = B.bind(spark, d, "SELECT l_orderkey, l_linenumber, l_partkey, '$' || CAST(l_partkey AS STRING) AS a, CAST(l_partkey % 97 + 10 AS STRING) AS b FROM {lineitem}")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = s.select(*keys, F.lit("line1_charges").alias("name"), F.array("a", "b").alias("texts"))
    return candidates.explode(rows, "name", "texts", keys).select(*keys, "value", "candidate_no")


_MARKS = "SELECT l_orderkey AS page, l_returnflag AS option, MAX(l_partkey % 100) / 1e2 AS fill FROM {lineitem} GROUP BY l_orderkey, l_returnflag"


@query(f"""WITH r AS (SELECT *, COALESCE(lead(fill) OVER w, 0.0) AS second, row_number() OVER w AS k FROM ({B.duck(_MARKS)}) WINDOW w AS (PARTITION BY page ORDER BY fill DESC, option))
SELECT page, CASE WHEN fill - second >= 0.03 THEN option END AS marked, CASE WHEN fill - second >= 0.03 THEN round_even(least(0.99, 0.70 + (fill - second)), 6) END AS confidence FROM r WHERE k = 1""")
def checkbox_mark(spark: SparkSession, d: str) -> DataFrame:
    return candidates.mark(B.bind(spark, d, _MARKS), ["page"], "fill", "option").withColumn("confidence", F.bround("confidence", 6))


# regions ---------------------------------------------------------------------
_TEMPLATE = [("cms1500", f"f{i}{j}", i / 4, j / 5, i / 4 + 0.22, j / 5 + 0.15) for i in range(4) for j in range(5)]
_REGION = ", ".join(f"('{n}', {x0 * 1000 - 8}e0, {y0 * 1000 - 8}e0, {x1 * 1000 + 8}e0, {y1 * 1000 + 8}e0)" for _, n, x0, y0, x1, y1 in _TEMPLATE)


def _template(spark: SparkSession) -> DataFrame:
    t = spark.createDataFrame(_TEMPLATE, "form string, field_name string, x0 double, y0 double, x1 double, y1 double")
    return regions.resolve(t, (0.0, 0.0, 1000.0, 1000.0))


@query(f"""WITH s AS ({B.duck(B.SPANS)}), r(field_name, a, b, c, d) AS (VALUES {_REGION}), g AS (SELECT DISTINCT page FROM s),
h AS (SELECT s.*, field_name, round_even((y0 + y1) / 2 / 14, 0) AS line FROM s, r WHERE least(y1, d) > greatest(y0, b) AND least(x1, c) > greatest(x0, a) AND (least(y1, d) - greatest(y0, b)) / greatest(1e0, y1 - y0) >= 0.5
  AND ((least(x1, c) - greatest(x0, a)) / greatest(1e0, x1 - x0) >= 0.5 OR (least(x1, c) - greatest(x0, a)) / (c - a) >= 0.5)),
m AS (SELECT page, field_name, string_agg(text, ' ' ORDER BY line, x0, span_no) AS value, round_even(CAST(SUM(CAST(conf AS DECIMAL(20,8))) AS DOUBLE) / COUNT(*), 4) AS conf, COUNT(*) AS n_spans FROM h GROUP BY page, field_name)
SELECT g.page, r.field_name, COALESCE(value, '') AS value, COALESCE(n_spans, 0) AS n_spans FROM g CROSS JOIN r LEFT JOIN m ON g.page = m.page AND r.field_name = m.field_name""")
def region_join(spark: SparkSession, d: str) -> DataFrame:
    s = B.bind(spark, d, B.SPANS)
    pages = s.select("page", "form").distinct()
    return regions.map_fields(s, _template(spark), pages, ["page"]).select("page", "field_name", "value", "n_spans")


@query(f"""WITH s AS ({B.duck(B.SPANS)}), r(field_name, a, b, c, d) AS (VALUES {_REGION}) SELECT page, field_name, COUNT(*) AS hits FROM s, r WHERE (x0 + x1) / 2 BETWEEN a AND c AND (y0 + y1) / 2 BETWEEN b AND d GROUP BY page, field_name""")
def center_join(spark: SparkSession, d: str) -> DataFrame:
    t = _template(spark).withColumnsRenamed({"fx0": "bx0", "fy0": "by0", "fx1": "bx1", "fy1": "by1"}).drop("form")
    found = B.bind(spark, d, B.SPANS).join(F.broadcast(t), regions.centre_in(0.0))
    return found.groupBy("page", "field_name").agg(F.count("*").alias("hits"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(0e0, x - 8) AS x0, greatest(0e0, y - 8) AS y0, least(1000e0, x + 48) AS x1, least(1000e0, y + 28) AS y1, round_even((least(1000e0, x + 48) - greatest(0e0, x - 8)) * (least(1000e0, y + 28) - greatest(0e0, y - 8)) / 1e6, 8) AS share
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 1000 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 1000 AS DOUBLE) AS y FROM lineitem)""")
def crop_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = B.bind(spark, d, "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 1000 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 1000 AS DOUBLE) AS y FROM {lineitem}")
    c = regions.crop(F.col("x"), F.col("y"), F.col("x") + 40, F.col("y") + 20, F.lit(1000.0), F.lit(1000.0))
    return b.withColumn("c", c).select("l_orderkey", "l_linenumber", "l_partkey", "c.x0", "c.y0", "c.x1", "c.y1", F.bround("c.share", 8).alias("share"))


_SIG = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 101) / 1e2 AS blur, (l_suppkey % 91) / 9e1 AS contrast, (l_partkey % 83) / 82e0 AS noise, CAST(l_suppkey % 17 AS DOUBLE) AS skew, l_partkey % 2 = 0 AS ok, (l_partkey % 20) / 1e2 AS illum, CAST(l_suppkey % 40 + 215 AS DOUBLE) AS bright FROM {lineitem}"


@query(f"""WITH s AS (SELECT *, round_even(0.30 * blur + 0.25 * contrast + 0.25 * (1 - noise) + 0.10 * (1 - least(1e0, skew / 12)) + 0.10 * CASE WHEN ok THEN 1 ELSE 0 END, 6) AS score FROM ({B.duck(_SIG)}))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score, CASE WHEN 0.30 * blur + 0.25 * contrast + 0.25 * (1 - noise) + 0.10 * (1 - least(1e0, skew / 12)) + 0.10 * CASE WHEN ok THEN 1 ELSE 0 END >= 0.72 THEN 'good' WHEN 0.30 * blur + 0.25 * contrast + 0.25 * (1 - noise) + 0.10 * (1 - least(1e0, skew / 12)) + 0.10 * CASE WHEN ok THEN 1 ELSE 0 END >= 0.55 THEN 'fair' ELSE 'poor' END AS band, array_to_string(list_filter([CASE WHEN skew >= 8 THEN 'deskew' END, CASE WHEN illum >= 0.075 THEN 'illumination' END, CASE WHEN noise >= 0.3 THEN 'denoise' END, CASE WHEN bright < 238 THEN 'contrast' END], lambda x: x IS NOT NULL), ',') AS ops FROM s""")
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    s = B.bind(spark, d, _SIG)
    q = regions.quality(c("blur"), c("contrast"), c("noise"), c("skew"), c("ok"))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround(q["score"], 6).alias("score"), q["band"].alias("band"), F.array_join(regions.repairs(c("skew"), c("illum"), c("noise"), c("bright")), ",").alias("ops"))


# links --------------------------------------------------------------------------
_ANCHORS = """WITH a AS (SELECT DISTINCT item_id AS record, regexp_replace(upper(replace(w, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS anchor FROM (SELECT item_id, unnest(list_transform(range(0, CAST(ceil(length(text) / 30) AS BIGINT)), lambda i: substr(text, i * 30 + 1, 30))) AS w FROM benchmark)),
f AS (SELECT a.*, CASE WHEN COUNT(*) OVER (PARTITION BY anchor) = 1 THEN 3 ELSE 1 END AS weight FROM a WHERE length(anchor) >= 5 AND NOT regexp_matches(anchor, '^0*$')),
h AS (SELECT doc_id AS doc, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS hay FROM documents), s AS (SELECT doc, record, SUM(weight) AS score, COUNT(*) AS hits FROM h, f WHERE contains(hay, anchor) GROUP BY doc, record),
r AS (SELECT *, row_number() OVER w AS k, COALESCE(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY doc ORDER BY score DESC, hits DESC, record DESC)),
links AS (SELECT h.doc, CASE WHEN score IS NULL THEN 'no_match' WHEN score - second <= 0 THEN 'ambiguous' ELSE 'deterministic' END AS status, CASE WHEN score - second > 0 THEN record END AS record, CAST(COALESCE(score, 0) AS BIGINT) AS score, CAST(COALESCE(score - second, 0) AS BIGINT) AS margin, COALESCE(hits, 0) AS evidence FROM h LEFT JOIN r ON h.doc = r.doc AND k = 1)
"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    items = B.bind(spark, d, "SELECT item_id, text FROM {benchmark}").filter(F.length("text") > 0)
    parts = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("text"), F.lit(30)), lambda i: F.substring("text", i, F.lit(30)))).alias("v"))
    docs = _docs(spark, d)
    hits = linkage.anchor_hits(docs, linkage.anchors(parts, "item_id", "v"), "doc_id", "text")
    return linkage.link(docs, hits, "doc_id")


@query(_ANCHORS + "SELECT * FROM links")
def record_link(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)


@query(_ANCHORS + ", c AS (SELECT doc, row_number() OVER (PARTITION BY record ORDER BY score DESC, margin DESC, doc) AS k FROM links WHERE status = 'deterministic') SELECT l.doc, CASE WHEN c.k > 1 THEN 'ambiguous' ELSE status END AS status, CASE WHEN c.k > 1 THEN NULL ELSE record END AS record, score, margin, evidence FROM links l LEFT JOIN c ON l.doc = c.doc")
def link_collision(spark: SparkSession, d: str) -> DataFrame:
    return linkage.one_to_one(_links(spark, d))


_EXP = "SELECT doc_id AS doc, 'line1_charges' AS field_name, CAST(quality AS STRING) || '.00' AS value FROM {labels} UNION ALL SELECT doc_id, 'units', CAST(toxic AS STRING) FROM {labels}"
_ACT = "SELECT doc_id AS doc, 'line1_charges' AS field_name, CASE WHEN n_chars % 5 = 0 THEN '' ELSE CAST(n_chars % 2 AS STRING) END AS value FROM {documents} UNION ALL SELECT doc_id, 'units', CAST(n_chars % 3 AS STRING) || '.0' FROM {documents} WHERE n_chars % 7 <> 0"
_CMP = f"""WITH e AS ({B.duck(_EXP)}), x AS ({B.duck(_ACT)}), c AS (SELECT e.doc, e.field_name, e.value AS expected, x.value AS actual FROM e LEFT JOIN x ON e.doc = x.doc AND e.field_name = x.field_name)
"""


@query(_CMP + "SELECT *, CASE WHEN TRY_CAST(actual AS DOUBLE) = CAST(expected AS DOUBLE) THEN 'correct' WHEN COALESCE(actual, '') = '' THEN 'missing' ELSE 'incorrect' END AS outcome FROM c")
def expected_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.compare(B.bind(spark, d, _EXP), B.bind(spark, d, _ACT), ["doc"])


@query(_CMP + "SELECT x.doc, x.field_name, x.value FROM x WHERE value <> '' AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc = x.doc AND e.field_name = x.field_name)")
def false_positives(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.unexpected(B.bind(spark, d, _EXP), B.bind(spark, d, _ACT), ["doc"])


@query(_CMP + "SELECT COALESCE(e.doc, x.doc) AS doc, COALESCE(e.field_name, x.field_name) AS field_name, e.doc IS NOT NULL AS in_truth, x.doc IS NOT NULL AS in_page FROM e FULL JOIN x ON e.doc = x.doc AND e.field_name = x.field_name")
def full_outer_names(spark: SparkSession, d: str) -> DataFrame:
    e = B.bind(spark, d, _EXP).select("doc", "field_name", F.lit(True).alias("t"))
    x = B.bind(spark, d, _ACT).select("doc", "field_name", F.lit(True).alias("p"))
    return e.join(x, ["doc", "field_name"], "full").select("doc", "field_name", F.col("t").isNotNull().alias("in_truth"), F.col("p").isNotNull().alias("in_page"))


# fixed width -----------------------------------------------------------------------
def _nsf(spark: SparkSession, d: str) -> DataFrame:
    """Orders as written 320-character files of several splits, with every place of a field filled; every seventh claim lacks its patient row."""
    o = B.bind(spark, d, "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS cents FROM {orders}")
    key = F.col("o_orderkey").cast("string")

    def row(tag: str, cells: dict[int, tuple[int, Column]]) -> Column:
        parts, at = [F.lit(tag)], len(tag) + 1
        for start in sorted(cells):
            width, value = cells[start]
            parts += [F.lit(" " * (start - at)), F.rpad(value, width, " ")]
            at = start + width
        return F.rpad(F.concat(*parts), 320, " ")

    def fields(tag: str) -> dict[int, tuple[int, Column]]:
        return {a: (b - a + 1, F.concat(F.lit(name[:1].upper()), F.right(key, F.lit(b - a)))) for name, (t, a, b) in fixed_width.NSF_FIELDS.items() if t == tag and name != "patient_account_no"}

    money = F.lpad((F.col("cents") % 10_000_000).cast("string"), 7, "0")
    ca = row("CA0", fields("CA0") | {23: (20, F.concat(F.lit("LAST"), key)), 43: (12, F.lit("FIRST")), 55: (1, F.lit("M"))})
    da = row("DA0", fields("DA0") | {182: (20, F.concat(F.lit("OWNER"), key)), 202: (12, F.lit("")), 214: (1, F.lit(""))})
    ea = row("EA0", fields("EA0") | {6: (17, F.concat(F.lit("A"), key))})
    fa = row("FA0", {40: (8, F.lit("20240102")), 48: (8, F.lit("20240103")), 56: (2, F.lit("11")), 60: (5, F.lit("99213")), 65: (6, F.lit("25")), 71: (7, money), 78: (4, F.lit("1")), 82: (4, F.lit("0010"))})
    xa = row("XA0", {78: (7, money)})
    none = F.array().cast("array<string>")
    rows = F.concat(F.array(row("BA0", fields("BA0"))), F.when(F.col("o_orderkey") % 7 == 0, none).otherwise(F.array(ca)), F.array(da, ea, fa, xa))
    return B.written_blocks(spark, o, "o_orderkey", rows, "NSF320", "\r\n")


_CLAIM = f"o AS (SELECT CAST(o_orderkey // {B.FILE_KEYS} AS VARCHAR) AS path, o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, CAST(floor(o_totalprice) AS BIGINT) % 10000000 AS cents, row_number() OVER (PARTITION BY o_orderkey // {B.FILE_KEYS} ORDER BY o_orderkey) AS ordinal FROM orders)"
_PLAIN_FIELDS = " UNION ALL ".join(f"SELECT path, ordinal, 'NSF320' AS format_name, '{n}' AS field_name, '{n[:1].upper()}' || right(k, {b - a}) AS value, o_orderkey FROM o" for n, (_, a, b) in fixed_width.NSF_FIELDS.items() if n != "patient_account_no" and b > a)


@query(f"""WITH {_CLAIM}, f AS ({_PLAIN_FIELDS} UNION ALL SELECT path, ordinal, 'NSF320', 'patient_sex', 'P', o_orderkey FROM o UNION ALL SELECT path, ordinal, 'NSF320', 'patient_account_no', 'A' || k, o_orderkey FROM o
  UNION ALL SELECT path, ordinal, 'NSF320', 'patient_name', 'LAST' || k || ', FIRST M', o_orderkey FROM o UNION ALL SELECT path, ordinal, 'NSF320', 'insured_name', 'OWNER' || k, o_orderkey FROM o
  UNION ALL SELECT path, ordinal, 'NSF320', 'total_charge', CAST(CAST(cents / 100 AS DECIMAL(18,2)) AS VARCHAR), o_orderkey FROM o)
SELECT path, ordinal, format_name, field_name, value FROM f WHERE o_orderkey % 7 <> 0""")
def fixed_width_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return fixed_width.records(_nsf(spark, d), "NSF320")


@query(f"""WITH {_CLAIM} SELECT path, ordinal, 1 AS line_no, n AS field_name, CASE n WHEN 'charge' THEN CAST(CAST(cents / 100 AS DECIMAL(18,2)) AS VARCHAR) ELSE v END AS value
FROM o, (VALUES ('service_from', '20240102'), ('service_to', '20240103'), ('place_of_service', '11'), ('procedure_code', '99213'), ('modifiers', '25'), ('diagnosis_pointer', '1'), ('units', '1.0'), ('charge', '')) t(n, v) WHERE o_orderkey % 7 <> 0""")
def fixed_width_lines(spark: SparkSession, d: str) -> DataFrame:
    return fixed_width.service_lines(_nsf(spark, d), "NSF320")


_BODIES = """SELECT page_id, CASE page_id % 7 WHEN 0 THEN '{"fields": {"a": 1}, "n": ' || CAST(page_id AS STRING) || '}' WHEN 1 THEN 'NSF 320 Spec: ' || t WHEN 2 THEN rpad('BA0' || t, 320, '.') WHEN 3 THEN rpad('10' || t, 192, '.') WHEN 4 THEN '  ' WHEN 5 THEN '%PDF-1.7 ' || t ELSE t END AS body
 FROM (SELECT page_id, regexp_replace(COALESCE(html, ''), '[^a-z0-9<>/ ]+', '') AS t FROM pages)"""
_WIDTH = "len(list_distinct(list_transform(list_filter(string_split_regex(body, '\\r\\n|\\r|\\n'), lambda x: trim(x) <> ''), lambda x: length(x)))) = 1 AND length(list_filter(string_split_regex(body, '\\r\\n|\\r|\\n'), lambda x: trim(x) <> '')[1])"


@query(f"""WITH p AS ({_BODIES.replace("+', '')", "+', '', 'g')")}), f AS (SELECT page_id, body, CASE WHEN contains(body[1:1024], '%PDF-') THEN 'PDF' WHEN trim(body) = '' THEN 'EMPTY' WHEN {_WIDTH} = 320 THEN 'NSF320' WHEN {_WIDTH} = 192 THEN 'UB192' WHEN json_type(TRY_CAST(body AS JSON)) = 'OBJECT' THEN 'JSON' ELSE 'TEXT' END AS format FROM p)
SELECT page_id, format, CASE WHEN format = 'PDF' THEN CASE WHEN page_id % 2 = 0 THEN 'attachment' ELSE 'claim_document' END WHEN format IN ('NSF320', 'UB192') THEN 'expected_output' WHEN format = 'JSON' AND json_type(TRY_CAST(body AS JSON), '$.fields') = 'OBJECT' THEN 'expected_output'
 WHEN format = 'TEXT' AND ({' OR '.join(f"contains(regexp_replace(upper(CASE WHEN page_id % 2 = 0 THEN 'fax_cover.txt' ELSE 'page.txt' END || ' ' || body[1:4096]), '[^A-Z0-9]+', ' ', 'g'), '{m}')" for m in files.SPEC_MARKERS)}) THEN 'specification' ELSE 'unknown' END AS role FROM f""")
def sniff_formats(spark: SparkSession, d: str) -> DataFrame:
    """Formats and roles of files whose bodies are the pages' own text, some of them dressed up."""
    p = B.bind(spark, d, "SELECT page_id, html FROM {pages}")
    t = F.regexp_replace(F.coalesce("html", F.lit("")), "[^a-z0-9<>/ ]+", "")
    k = F.col("page_id") % 7
    body = F.when(k == 0, F.concat(F.lit('{"fields": {"a": 1}, "n": '), "page_id", F.lit("}"))).when(k == 1, F.concat(F.lit("NSF 320 Spec: "), t)).when(k == 2, F.rpad(F.concat(F.lit("BA0"), t), 320, ".")).when(k == 3, F.rpad(F.concat(F.lit("10"), t), 192, ".")).when(k == 4, "  ").when(k == 5, F.concat(F.lit("%PDF-1.7 "), t)).otherwise(t)
    name = F.when(F.col("page_id") % 2 == 0, "fax_cover.txt").otherwise("page.txt")
    f = p.select("page_id", F.encode(body, "UTF-8").alias("content"), name.alias("name")).withColumn("format", files.detect_format(F.col("content")))
    return f.select("page_id", "format", files.role(F.col("name"), F.col("format"), F.col("content")).alias("role"))


@query("""SELECT o_orderkey, 'line' || n || '_' || k AS field_name, CASE k WHEN 'charges' THEN CAST(o_orderkey % 50 + n AS VARCHAR) ELSE '1' END AS value FROM orders, (VALUES (1), (2), (3)) a(n), (VALUES ('charges'), ('units')) b(k) WHERE n <= o_orderkey % 3 + 1""")
def flatten_lines(spark: SparkSession, d: str) -> DataFrame:
    o = B.bind(spark, d, "SELECT o_orderkey FROM {orders}")
    lines = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), lambda n: F.create_map(F.lit("charges"), (F.col("o_orderkey") % 50 + n).cast("string"), F.lit("units"), F.lit("1")))
    return records.flatten_lines(o.withColumn("lines", lines), "lines", ["o_orderkey"])


@query("""SELECT user_id, event_type, MIN(event_id) FILTER (event_id % 3 <> 0) AS first_page, CASE WHEN COUNT(*) FILTER (event_id % 3 <> 0) > 0 THEN 'v' || MIN(event_id) FILTER (event_id % 3 <> 0) END AS value FROM events GROUP BY ALL""")
def first_value_over_pages(spark: SparkSession, d: str) -> DataFrame:
    e = B.bind(spark, d, "SELECT user_id, event_type, event_id AS page_no, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' || CAST(event_id AS STRING) END AS value FROM {events}")
    out = review.first_blankless(e, ["user_id", "event_type"])
    return out.select("user_id", "event_type", F.substring("value", 2, 20).try_cast("long").alias("first_page"), "value")


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines, dealt to as many tasks as there are lines for."""
    lines = B.bind(spark, d, "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem}")
    n = spread(lines)
    orders = B.bind(spark, d, "SELECT o_orderkey FROM {orders}").repartition(n, "o_orderkey")
    return orders.join(lines.repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))


@query("""WITH a AS (SELECT o_orderkey AS doc, l_linenumber AS line_no, COUNT(*) FILTER (l_partkey % 2 = 0) AS passed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, l_linenumber) SELECT *, passed >= 2 AS active, passed = 0 AS blank FROM a""")
def line_activation(spark: SparkSession, d: str) -> DataFrame:
    a = _order_lines(spark, d).select(F.col("o_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no"), F.when(F.col("l_partkey") % 2 == 0, "PASS").otherwise("FAIL").alias("verdict"))
    return review.active_lines(a, ["doc"])


_LINES = "SELECT o_orderkey AS doc, 'line' || CAST(l_linenumber AS STRING) || '_charges' AS field_name, CAST(l_partkey AS STRING) AS value, CASE WHEN l_partkey % 3 = 0 THEN 'RETRY' ELSE 'HUMAN_REVIEW' END AS state FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, 'total_charge', '1', 'ACCEPT' FROM {orders}"


@query(f"""WITH a AS (SELECT o_orderkey AS doc, l_linenumber AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING COUNT(*) FILTER (l_partkey % 2 = 0) = 0), f AS ({B.duck(_LINES)})
SELECT f.doc, field_name, CASE WHEN a.doc IS NULL THEN value END AS value, CASE WHEN a.doc IS NOT NULL THEN 'ACCEPT' ELSE state END AS state, CASE WHEN a.doc IS NOT NULL THEN 'INAPPLICABLE' END AS verdict FROM f LEFT JOIN a ON f.doc = a.doc AND field_name = 'line' || n || '_charges'""")
def blank_inactive_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fields of lines that aren't active are blanked."""
    c = F.col
    lines = _order_lines(spark, d).select(c("o_orderkey").alias("doc"), F.concat(F.lit("line"), c("l_linenumber").cast("string"), F.lit("_charges")).alias("field_name"), c("l_partkey").cast("string").alias("value"), F.when(c("l_partkey") % 3 == 0, "RETRY").otherwise("HUMAN_REVIEW").alias("state"))
    totals = B.bind(spark, d, "SELECT o_orderkey AS doc, 'total_charge' AS field_name, '1' AS value, 'ACCEPT' AS state FROM {orders}")
    return review.blank_inactive_lines(lines.unionByName(totals), line_activation(spark, d), ["doc"])


@query("""WITH a AS (SELECT user_id, event_id, event_id % 3 = 0 AS m FROM events) SELECT user_id, COALESCE(MAX(event_id) FILTER (m), MAX(event_id)) AS attempt_no FROM a GROUP BY user_id""")
def source_attempt(spark: SparkSession, d: str) -> DataFrame:
    a = B.bind(spark, d, "SELECT user_id, event_id AS attempt_no, event_type AS engine, 'primary' AS rung, CASE WHEN event_id % 3 = 0 THEN 'f' ELSE 'x' END AS value, 'f' AS final_value FROM {events}")
    return review.source_attempt(a, ["user_id"]).select("user_id", "attempt_no")


# answers, denominators, oversight -----------------------------------------------
def _oversight():
    from ..operators import oversight

    return oversight


_SAID = "SELECT conv_id, turn, COALESCE(text, '') AS t, (conv_id + turn) % 6 AS k FROM {conversations}"
_FOLDED = f"regexp_replace(translate(t, '{X.MARKS.replace(chr(39), chr(39) * 2)}', '{X.PLAIN.replace(chr(39), chr(39) * 2)}'), '^{_SP}+|{_SP}+$', '', 'g')"


@query(f"""SELECT conv_id, turn, CASE WHEN k IN (3, 5) THEN NULLIF({_FOLDED}, '') END AS value, CASE k WHEN 3 THEN 'x' WHEN 4 THEN {_FOLDED} WHEN 5 THEN {_FOLDED} END AS visible_text, CASE k WHEN 3 THEN 1e0 WHEN 5 THEN (conv_id % 10) / 1e1 ELSE 0e0 END AS confidence, CASE k WHEN 3 THEN substr(t, 1, 120) WHEN 4 THEN '' WHEN 5 THEN 'r' END AS reason,
 CASE k WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'response keys must be exactly confidence, reason, value, visible_text' WHEN 2 THEN 'response keys must be exactly confidence, reason, value, visible_text' END AS error FROM ({B.duck(_SAID)})""")
def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns as answers of several shapes, right and wrong."""
    c, t = F.col, F.col("t")
    s = B.bind(spark, d, _SAID)
    made = lambda **parts: F.to_json(F.struct(*(v.alias(n) for n, v in parts.items())))
    text = (
        F.when(c("k") == 0, F.concat(F.lit("I think it says "), t))
        .when(c("k") == 1, made(value=t, visible_text=t))
        .when(c("k") == 2, F.to_json(F.array(t)))
        .when(c("k") == 3, made(value=t, visible_text=F.lit(" x "), confidence=F.lit(1.5), reason=t))
        .when(c("k") == 4, made(value=F.lit(""), visible_text=t, confidence=F.lit("low"), reason=F.lit("")))
        .otherwise(made(reason=F.lit("r"), value=t, visible_text=t, confidence=(c("conv_id") % 10) / 10.0))
    )
    return s.withColumn("a", _oversight().parse_answer(text)).select("conv_id", "turn", "a.value", "a.visible_text", "a.confidence", "a.reason", "a.error")


_KINDS = f"""SELECT conv_id, turn, t, k, v, CASE WHEN trim(t) = '' AND k = 0 THEN 'empty' WHEN k = 0 THEN 'no JSON' WHEN k = 1 THEN 'no object' WHEN k = 2 THEN 'missing keys' WHEN k = 3 THEN 'more keys' WHEN k = 4 THEN 'value type' WHEN k = 5 THEN 'visible type' WHEN k = 6 THEN 'confidence type' WHEN k = 7 THEN 'confidence bounds'
 WHEN k = 8 AND v <> '' THEN 'unseen value' WHEN k >= 8 AND length(v) > 120 THEN 'too long' WHEN k = 10 AND v <> '' AND NOT regexp_matches(replace(v, ' ', ''), '^\\d{{5}}(-\\d{{4}})?$') THEN 'shape' END AS reject
FROM (SELECT conv_id, turn, t, (conv_id + turn) % 11 AS k, {_FOLDED} AS v FROM (SELECT conv_id, turn, COALESCE(text, '') AS t FROM conversations))"""


@query(f"""SELECT conv_id, turn, CASE WHEN reject IS NULL THEN NULLIF(v, '') END AS value, CASE WHEN reject IS NULL THEN k <> 8 END AS visible, CASE WHEN reject IS NULL THEN (conv_id % 10) / 1e1 END AS confidence, reject FROM ({_KINDS})""")
def contract_answers(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns as three-key answers, right and wrong in each way."""
    c, t = F.col, F.col("t")
    s = B.bind(spark, d, "SELECT conv_id, turn, COALESCE(text, '') AS t, (conv_id + turn) % 11 AS k FROM {conversations}")
    made = lambda **parts: F.to_json(F.struct(*(v.alias(n) for n, v in parts.items())))
    yes, conf = F.lit(True), (c("conv_id") % 10) / 10.0
    text = F.when(c("k") == 0, F.when(F.trim(t) == "", t).otherwise(F.concat(F.lit("says "), t)))
    wrong = (F.to_json(F.array(t)), made(value=t, visible=yes), made(value=t, visible=yes, confidence=conf, reason=t), made(value=c("turn"), visible=yes, confidence=conf), made(value=t, visible=F.lit("yes"), confidence=conf), made(value=t, visible=yes, confidence=F.lit("1")), made(value=t, visible=yes, confidence=F.lit(1.5)), made(value=t, visible=F.lit(False), confidence=conf))
    for k, w in enumerate(wrong, 1):
        text = text.when(c("k") == k, w)
    text = text.otherwise(F.concat(F.lit("```json\n"), made(value=t, visible=yes, confidence=conf), F.lit("\n```")))
    name = F.when(c("k") == 10, "patient_zip").otherwise("patient_name")
    return s.select("conv_id", "turn", _oversight().contract_answer(text, name).alias("a")).select("conv_id", "turn", "a.*")


_REC = "SELECT o_orderkey AS rec, CASE WHEN o_orderkey % 2 = 0 THEN 'NSF320' ELSE 'UB192' END AS format_name, f AS field_name, CASE WHEN f = 'attending_qualifier' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'XX' ELSE 'YY' END WHEN o_orderkey % 5 = 0 AND f = 'diagnosis_2' THEN '' ELSE f || CAST(o_orderkey AS STRING) END AS value FROM {orders}, (SELECT DISTINCT CASE r_regionkey WHEN 0 THEN 'provider_name' WHEN 1 THEN 'diagnosis_2' WHEN 2 THEN 'attending_qualifier' WHEN 3 THEN 'attending_identifier' ELSE 'referring_npi' END AS f FROM {region}) x"


@query(f"""WITH r AS ({B.duck(_REC)}) SELECT rec, CASE WHEN field_name = 'provider_name' AND format_name = 'NSF320' THEN 'billing_provider_name' WHEN field_name = 'diagnosis_2' THEN 'diagnosis_code_b' WHEN field_name = 'referring_npi' THEN 'referring_provider_npi' WHEN field_name = 'attending_identifier' THEN 'attending_npi' ELSE field_name END AS field_name, value
FROM r WHERE value <> '' AND NOT (field_name = 'attending_identifier' AND rec % 3 <> 0)""")
def expected_names(spark: SparkSession, d: str) -> DataFrame:
    return _oversight().expected_names(B.bind(spark, d, _REC), ["rec"])


@query("""SELECT o_orderkey AS rec, 'line' || n || '_' || CASE WHEN o_orderkey % 2 = 0 THEN CASE f WHEN 'charge' THEN 'charges' ELSE 'cpt_code' END ELSE CASE f WHEN 'charge' THEN 'charges' ELSE 'hcpcs' END END AS field_name, CAST(n AS VARCHAR) AS value
FROM orders, (VALUES (1), (2), (3)) a(n), (VALUES ('charge'), ('procedure_code')) b(f)""")
def expected_lines(spark: SparkSession, d: str) -> DataFrame:
    o = B.bind(spark, d, "SELECT o_orderkey AS rec, CASE WHEN o_orderkey % 2 = 0 THEN 'NSF320' ELSE 'UB192' END AS format_name FROM {orders}")
    lines = o.withColumn("line_no", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("field_name", F.explode(F.array(*map(F.lit, ("charge", "procedure_code", "modifiers"))))).withColumn("value", F.col("line_no").cast("string"))
    return _oversight().expected_lines(lines, ["rec"])


@query("""SELECT l_orderkey AS rec, COUNT(*) AS extended, COUNT(*) FILTER (l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 0)) AS "primary", COUNT(*) FILTER (l_returnflag = 'R') AS unknown FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem) GROUP BY l_orderkey""")
def conditional_denominators(spark: SparkSession, d: str) -> DataFrame:
    e = B.bind(spark, d, "SELECT DISTINCT l_orderkey AS rec, l_returnflag || CAST(l_linenumber AS STRING) AS field_name, 'x' AS value, l_linenumber FROM {lineitem}")
    policy = spark.createDataFrame([(f"{k}{n}", s) for n in range(1, 8) for k, s in (("A", "primary_scored"), ("N", "conditional_scored"))], "field_name string, status string")
    return _oversight().denominators(e, policy, e.filter("l_linenumber % 2 = 0"), ["rec"])


@query("""SELECT COUNT(*) FILTER (event_id % 2 = 0) AS eligible, COUNT(*) FILTER (event_id % 4 = 0) AS retried, COUNT(*) FILTER (event_id % 4 = 0 AND event_id % 3 = 0) AS wrong_retried, COUNT(*) FILTER (event_id % 4 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0) AS right_low_retried,
 COUNT(*) FILTER (event_id % 4 = 0 AND event_id % 7 = 0) AS blank_retried, COUNT(*) FILTER (event_id % 4 = 0 AND event_id % 11 = 0) AS candidates_right, COUNT(*) FILTER (event_id % 4 = 0 AND event_id % 13 = 0) AS selected, COUNT(*) FILTER (event_id % 6 = 0) AS unresolved FROM events""")
def retry_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _oversight().retry_funnel(B.bind(spark, d, "SELECT event_id % 2 = 0 AS eligible, event_id % 4 = 0 AS retried, event_id % 3 <> 0 AS primary_correct, CASE WHEN event_id % 5 = 0 THEN 'high' ELSE 'low' END AS category, event_id % 7 = 0 AS blank, event_id % 11 = 0 AS candidate_correct, event_id % 13 = 0 AS selected, event_id % 6 <> 0 AS final_correct FROM {events}"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'disabled by policy' WHEN event_id % 3 = 0 THEN 'model not configured' WHEN event_id % 5 = 0 THEN 'credential missing' ELSE 'external calls are not executed by the local workspace' END AS reason,
 CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'MULTIMODAL_FAILED' WHEN event_id % 3 = 0 THEN 'MULTIMODAL_ATTEMPTED' ELSE 'HUMAN_REVIEW_REQUIRED' END AS workflow,
 CASE WHEN event_id % 2 = 0 THEN 'CONFIGURATION_ERROR' WHEN event_id % 3000 > 2000 THEN 'UNSUPPORTED_IMAGE size' WHEN event_id % 7 = 0 THEN 'UNSUPPORTED_IMAGE provenance' WHEN event_id % 100 > 25 THEN 'UNSUPPORTED_IMAGE page' END AS refusal FROM events""")
def provider_states(spark: SparkSession, d: str) -> DataFrame:
    o, e = _oversight(), F.col("event_id")
    rows = B.bind(spark, d, "SELECT event_id FROM {events}")
    state = F.when(e % 4 == 0, "HUMAN_REVIEW").otherwise("ACCEPT")
    share = F.when(e % 7 != 0, (e % 100) / 100)
    return rows.select("event_id", o.provider_reason(e % 2 != 0, F.when(e % 3 != 0, "m"), e % 5 != 0).alias("reason"), o.workflow_state(e % 3 == 0, state, F.lit(True)).alias("workflow"), o.request_refusal(e % 2 != 0, e % 3000 * 1000, share).alias("refusal"))


@query("SELECT COUNT(*) FILTER (c_custkey % 10 = 0) AS overlap, 0 AS repeated, 0 AS unknown, COUNT(*) FILTER (c_custkey % 7 = 0 AND c_custkey % 10 <> 0) AS unsplit, COUNT(*) FILTER (c_custkey % 9 = 0) AS uneven_tiers FROM customer")
def split_integrity(spark: SparkSession, d: str) -> DataFrame:
    c = B.bind(spark, d, "SELECT c_custkey AS doc_id FROM {customer}")
    split = c.filter("doc_id % 7 != 0").withColumn("part", F.lit("test")).union(c.filter("doc_id % 10 = 0").withColumn("part", F.lit("calibration"))).union(c.filter("doc_id % 10 = 0").withColumn("part", F.lit("test")))
    truth = c.withColumn("tier", F.explode(F.array(F.lit("clean"), F.lit("ugly")))).withColumn("field_name", F.when((F.col("doc_id") % 9 == 0) & (F.col("tier") == "ugly"), "g").otherwise("f"))
    return _oversight().split_integrity(split, c, truth)


@query()
def oracle_double(spark: SparkSession, d: str) -> DataFrame:
    p = B.bind(spark, d, "SELECT p_partkey, p_name, CAST(p_partkey AS STRING) AS doc FROM {part}")
    return p.withColumn("a", _oversight().oracle_answer(F.col("doc"), F.lit("patient_name"), F.lit("clean"), F.col("p_name"))).select("p_partkey", "a.kind", "a.value", "a.visible")


@query("""WITH p AS (SELECT p_partkey, 'ab' || CAST(p_partkey AS VARCHAR) AS v FROM part) SELECT p_partkey, CASE WHEN regexp_matches(v, '[01258]') THEN regexp_extract(v, '^[^01258]*', 0) || translate(regexp_extract(v, '[01258]', 0), '01258', 'OIZSB') || regexp_extract(v, '^[^01258]*[01258](.*)$', 1) ELSE substr(v, 1, length(v) - 1) END AS corrupted FROM p""")
def glyph_corruption(spark: SparkSession, d: str) -> DataFrame:
    p = B.bind(spark, d, "SELECT p_partkey, 'a' || CAST(p_partkey AS STRING) AS w FROM {part}")
    return p.select("p_partkey", F.concat(F.lit("a"), _oversight().corrupt(F.translate(F.concat(F.lit("_"), F.substring("w", 2, 20)), "_", "ß"))).alias("c")).select("p_partkey", F.replace("c", F.lit("ß"), F.lit("b")).alias("corrupted"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round_even((list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - a.m) * (b.v[i] - b.m)))) / sqrt(list_sum(list_transform(a.v, lambda x: (x - a.m) * (x - a.m))) * list_sum(list_transform(b.v, lambda x: (x - b.m) * (x - b.m)))), 6) AS r
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_avg(CAST(embedding AS DOUBLE[])) AS m FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_avg(CAST(embedding AS DOUBLE[])) AS m FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def profile_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = B.bind(spark, d, "SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM {embeddings}".replace("CAST(embedding AS ARRAY<DOUBLE>)", "embedding")).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    a, b = e.select(F.col("vec_id").alias("a"), F.col("v").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("v").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.bround(_oversight().correlation(F.col("x"), F.col("y")), 6).alias("r"))


@query(f"""WITH f AS ({B.duck(B.FIELDS)}), s AS (SELECT COUNT(DISTINCT doc_id) AS pages, COUNT(*) AS fields, COUNT(*) FILTER (state = 'HUMAN_REVIEW') AS human, CAST(SUM(CAST((event_id % 9) / 1e5 AS DECIMAL(38,8))) AS DOUBLE) AS local_usd, CAST(SUM(CAST(CASE WHEN optional THEN projected_usd ELSE 0 END AS DECIMAL(38,8))) AS DOUBLE) AS measured_usd,
 CAST(SUM(CAST(projected_usd AS DECIMAL(38,8))) AS DOUBLE) AS projected_usd, COUNT(*) FILTER (correct AND state IN ('ACCEPT', 'ACCEPT_WITH_FLAG')) AS resolved FROM f)
SELECT *, round_even((local_usd + measured_usd) / pages, 9) AS measured_per_page_usd, round_even((local_usd + measured_usd) / resolved, 9) AS measured_per_resolved_usd, round_even(human * 0.03, 6) AS assumed_human_usd, round_even(local_usd / pages * 1000000, 4) AS local_at_1m_usd, round_even(local_usd / pages * 10000000, 4) AS local_at_10m_usd FROM s""")
def cost_dashboard(spark: SparkSession, d: str) -> DataFrame:
    f = B.bind(spark, d, B.FIELDS).withColumns({"local_usd": (F.col("event_id") % 9) / 1e5, "measured_usd": F.when(F.col("optional"), F.col("projected_usd")).otherwise(0.0)})
    return _oversight().cost_dashboard(f)
