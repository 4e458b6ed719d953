"""Queries of intake: folders, uploads, JSON and CSV files written and read again, manifests, boxes, local candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions, typed, validators
from ..operators import candidates, exports, oversight, regions, review
from ..sources import files, records, scratch
from . import bind as B
from .extraction import SQL as _EXTRACTION

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = B.exact_rounds(sql)
        return f

    return keep


# documents as files: their texts as they are or below the first bytes of other formats; pages are counted by their lines
_FILES = """SELECT '/data/' || CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'Box/' ELSE lang || '/in/' END || CASE WHEN n_chars % 3 = 0 THEN 'Fax_Cover_' WHEN n_chars % 3 = 1 THEN 'scan' ELSE 'SCAN' END || CAST(doc_id AS STRING) || '.dat' AS path,
 CASE WHEN n_chars % 8 < 2 THEN '%PDF-1.7 ' || text WHEN n_chars % 8 = 2 THEN chr(123) || '"fields": ' || chr(123) || '"lang": "' || lang || '"' || chr(125) || chr(125) WHEN n_chars % 8 = 3 THEN chr(123) || '"rows": [' || CAST(n_chars AS STRING) || ']' || chr(125) WHEN n_chars % 8 = 4 THEN 'NSF 320 spec. ' || text WHEN n_chars % 8 = 5 THEN rpad(lang, 320, '.') WHEN n_chars % 40 = 6 THEN '' ELSE text END AS body,
 n_chars % 130 AS pages, doc_id % 31 = 7 AS link, doc_id % 37 <> 5 AS readable FROM {documents}"""
_KIND = "list_distinct(list_transform(list_filter(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> ''), lambda x: length(x)))"
_INVENTORY = f"""f AS (SELECT path[7:] AS relative_path, CASE WHEN link OR NOT readable THEN '' ELSE coalesce(body, '') END AS body, pages, link, readable FROM ({B.duck(_FILES)}) x),
k AS (SELECT *, string_split(relative_path, '/')[-1] AS name, coalesce(nullif(regexp_extract(relative_path, '^(.*)/[^/]*$', 1), ''), '.') AS grp, substr(sha256(CASE WHEN link OR NOT readable THEN relative_path ELSE body END), 1, 12) AS id, strlen(body) AS size,
 CASE WHEN link THEN 'SYMLINK' WHEN NOT readable THEN 'UNREADABLE' WHEN starts_with(body, '%PDF-') THEN 'PDF' WHEN trim(regexp_replace(body, '\\s+', ' ', 'g')) = '' THEN 'EMPTY' WHEN {_KIND} = [320] THEN 'NSF320' WHEN {_KIND} = [192] THEN 'UB192' WHEN starts_with(body, '{{') THEN 'JSON' ELSE 'TEXT' END AS format FROM f),
r AS (SELECT *, CASE format WHEN 'SYMLINK' THEN 'unsupported' WHEN 'PDF' THEN CASE WHEN contains(lower(name), 'fax_cover') THEN 'attachment' ELSE 'claim_document' END WHEN 'NSF320' THEN 'expected_output' WHEN 'UB192' THEN 'expected_output' WHEN 'JSON' THEN CASE WHEN starts_with(body, '{{"fields"') THEN 'expected_output' ELSE 'unknown' END
 WHEN 'TEXT' THEN CASE WHEN {' OR '.join(f"contains(regexp_replace(upper(name || ' ' || body[1:4096]), '[^A-Z0-9]+', ' ', 'g'), '{m}')" for m in files.SPEC_MARKERS)} THEN 'specification' ELSE 'unknown' END ELSE 'unknown' END AS role FROM k),
w AS (SELECT *, format = 'PDF' AND pages > 100 AS much, format = 'PDF' AND pages < 1 AS none, first_value(name) OVER p AS first_name, size > 0 AND row_number() OVER p > 1 AS copy FROM r WINDOW p AS (PARTITION BY id, size > 0 ORDER BY lower(relative_path), relative_path)),
inventory AS (SELECT relative_path, grp, name, id, format, role, CASE WHEN format = 'PDF' AND NOT much THEN pages END AS page_count, size, CASE WHEN copy THEN 'DUPLICATE' WHEN much OR none OR format = 'UNREADABLE' THEN 'ERROR' WHEN role = 'unsupported' THEN 'UNSUPPORTED' WHEN role = 'unknown' THEN 'UNKNOWN' ELSE 'READY' END AS status,
 CASE WHEN copy THEN 'Duplicate content; first seen as ' || first_name || '.' WHEN link THEN 'Symbolic links are not followed.' WHEN NOT readable THEN 'File could not be read.' WHEN much THEN 'Document page limit is 100; received ' || pages || ' pages.' WHEN none THEN 'The document could not be decoded.' WHEN role = 'unknown' THEN 'File role or content format is not recognized.' ELSE '' END AS warning, much FROM w)"""


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    own = B.bind(spark, d, _FILES)
    return files.folder_inventory(own.select("path", F.encode("body", "UTF-8").alias("content"), "pages", "link", "readable"), "/data")


@query(f"WITH {_INVENTORY} SELECT * EXCLUDE (much) FROM inventory")
def folder_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files by case-folded path with format, role, pages, status and warning."""
    return _inventory(spark, d)


@query(f"""WITH {_INVENTORY} SELECT count(*) AS files_discovered, count(*) FILTER (role NOT IN ('unsupported', 'unknown') AND status <> 'ERROR') AS supported_files, count(*) FILTER (role IN ('unsupported', 'unknown')) AS unsupported_files, count(*) FILTER (role = 'claim_document') AS claim_documents,
 count(*) FILTER (role = 'expected_output') AS expected_output_files, count(*) FILTER (role = 'specification') AS specifications, count(*) FILTER (status = 'DUPLICATE') AS duplicate_files, CAST(sum(size) AS BIGINT) AS bytes FROM inventory""")
def scan_counters(spark: SparkSession, d: str) -> DataFrame:
    """A scan's counters."""
    return files.scan_counters(_inventory(spark, d))


_UPLOADS = "SELECT doc_id, n_chars % 11 <> 4 AS attested, 'up' || CAST(doc_id AS STRING) || CASE WHEN n_chars % 5 = 0 THEN '.JPG' WHEN n_chars % 5 = 1 THEN '.tiff' WHEN n_chars % 5 = 2 THEN '.pdf' WHEN n_chars % 5 = 3 THEN '.png' ELSE '.txt' END AS name, CASE WHEN n_chars % 23 = 0 THEN 0 ELSE n_chars * n_chars END AS size, CASE WHEN n_chars % 13 = 0 THEN 'ZIP' ELSE 'PDF' END AS kind, n_chars % 3 AS pages FROM {documents}"


@query(f"""SELECT doc_id, CASE WHEN NOT attested THEN 'not attested as synthetic' WHEN name LIKE '%.txt' THEN 'extension' WHEN size = 0 THEN 'empty' WHEN size > 10485760 THEN 'too large' WHEN kind = 'ZIP' THEN 'format' WHEN pages > 1 THEN 'more than one page' END AS refusal FROM ({B.duck(_UPLOADS)}) x""")
def upload_refusals(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that an upload breaks."""
    c = F.col
    return B.bind(spark, d, _UPLOADS).select("doc_id", files.upload_refusal(c("attested"), c("name"), c("size"), c("kind"), c("pages")).alias("refusal"))


@query("SELECT doc_id // 100 AS batch, 'batch-' || substr(sha256('balanced|' || string_agg(substr(sha256(coalesce(text, '')), 1, 12), ',' ORDER BY substr(sha256(coalesce(text, '')), 1, 12))), 1, 12) AS batch_id FROM documents GROUP BY doc_id // 100")
def batch_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of batches of at most a hundred documents, whatever their order."""
    docs = B.bind(spark, d, "SELECT doc_id DIV 100 AS batch, substr(sha2(coalesce(text, ''), 256), 1, 12) AS id FROM {documents}")
    return docs.groupBy("batch").agg(files.batch_id(F.lit("balanced"), F.collect_list("id")).alias("batch_id"))


# logs and truth as JSON files ------------------------------------------------------------
_LOG = "SELECT CAST(event_id AS STRING) AS ts, CAST(user_id AS STRING) AS doc_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'p' || CAST(event_id % 3 AS STRING) END AS page_id, event_type AS operation, value / 7e0 AS cost_usd, value * 1e1 AS latency_ms, CAST(event_id % 5 AS STRING) AS model FROM {events}"


@query(f"""SELECT operation, model, count(*) AS calls, count(DISTINCT doc_id) AS documents, count(*) FILTER (page_id = '') AS without_page, round_even(CAST(sum(CAST(round_even(cost_usd, 8) AS DECIMAL(38,8))) AS DOUBLE), 6) AS cost_usd FROM ({B.duck(_LOG)}) x GROUP BY operation, model""")
def ledger_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """A log appended to twice as JSON lines, read again and added up."""
    log = B.bind(spark, d, _LOG).withColumn("meta", F.create_map(F.lit("model"), "model")).withColumn("field", F.lit("")).drop("model")
    path = scratch.folder(spark, "ledger")
    records.append_jsonl(log.filter("ts % 2 = 0"), path)
    records.append_jsonl(log.filter("ts % 2 = 1"), path)
    read = records.read_jsonl(spark, path, records.LEDGER)
    return read.groupBy("operation", F.col("meta")["model"].alias("model")).agg(F.count("*").alias("calls"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("page_id") == "").alias("without_page"), F.bround(F.sum(F.col("cost_usd").cast("decimal(38,8)")).cast("double"), 6).alias("cost_usd"))


_TRUTH = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'cms1500' ELSE 'ub04' END AS form, o_orderpriority AS tier, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS total, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS state FROM {orders}"


@query(f"""SELECT 'd' || o_orderkey AS doc_id, 'p1' AS page_id, form, tier, n AS field_name, CASE n WHEN 'total_charge' THEN total ELSE state END AS value FROM ({B.duck(_TRUTH)}) x, (VALUES ('total_charge'), ('patient_state')) t(n)""")
def truth_fields(spark: SparkSession, d: str) -> DataFrame:
    """Truth documents written as JSON, read again as a row a field."""
    c = F.col
    own = B.bind(spark, d, _TRUTH)
    entry = lambda v: F.struct(v.alias("value"), F.array(F.lit(0.0), F.lit(1.5)).alias("bbox"))
    path = scratch.folder(spark, "truth")
    own.select(F.concat(F.lit("d"), "o_orderkey").alias("doc_id"), F.lit("p1").alias("page_id"), "form", "tier", F.lit(7).alias("seed"), F.struct(entry(c("total")).alias("total_charge"), entry(c("state")).alias("patient_state")).alias("fields")).write.json(path)
    return records.truth_fields(records.read_jsonl(spark, path, records.TRUTH))


_ROWS = "SELECT user_id AS page, event_type AS field_name, 'v \"' || CAST(event_id AS STRING) || '\", x' AS value, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'RETRY' END AS state FROM {events}"


@query(f"SELECT * FROM ({B.duck(_ROWS)}) x")
def csv_written(spark: SparkSession, d: str) -> DataFrame:
    """Rows with quotes and commas through a CSV file."""
    path = scratch.folder(spark, "csv")
    exports.write_csv(B.bind(spark, d, _ROWS), path)
    return spark.read.csv(path, schema="page long, field_name string, value string, state string", header=True, escape="\\", emptyValue="").fillna("", ["state"])


_DOCS = "SELECT 'b1' AS batch_job_id, CAST(doc_id AS STRING) AS safe_source_id, 'f' || CAST(doc_id AS STRING) AS source_file, 'TEXT' AS source_format, CASE WHEN n_chars % 2 = 0 THEN 'COMPLETED' ELSE 'PARTIAL' END AS processing_status, lang AS document_type, 1 AS page_count, n_chars % 5 AS unresolved_fields, n_chars / 1e6 AS measured_cost_usd, n_chars / 1e5 AS projected_cost_usd, n_chars / 1e1 AS latency_ms, CAST(NULL AS DOUBLE) AS accuracy, '' AS warning, n_chars % 50 AS applicable_fields, n_chars % 40 AS fields_produced, n_chars % 30 AS validated_fields FROM {documents}"


@query(f"""WITH r AS ({B.duck(_DOCS)}) SELECT r.*, s.summary_json FROM r, (SELECT '{{"files":' || count(*) || ',"unresolved":' || sum(unresolved_fields) || '}}' AS summary_json FROM r) s""")
def batch_csv(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a batch's CSV."""
    r = B.bind(spark, d, _DOCS)
    return exports.batch_rows(r, r.agg(F.count("*").alias("files"), F.sum("unresolved_fields").alias("unresolved")))


# manifests: a later state in which line ends, a text or a name have changed -------------
@query("""WITH f AS (SELECT doc_id, 'f' || CASE WHEN n_chars % 13 = 0 THEN 'x' ELSE '' END || doc_id AS now, coalesce(text, '') || CASE WHEN n_chars % 7 = 0 THEN ' ' ELSE '' END AS later, coalesce(text, '') AS text FROM documents),
a AS (SELECT 'f' || doc_id AS name, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS was FROM f), b AS (SELECT now AS name, sha256(replace(replace(later, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS "is" FROM f)
SELECT coalesce(a.name, b.name) AS name, was, "is" FROM a FULL JOIN b ON a.name = b.name WHERE was IS DISTINCT FROM "is" """)
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files whose hash, whatever their line ends, isn't what was frozen."""
    docs = B.bind(spark, d, "SELECT doc_id, n_chars, coalesce(text, '') AS text FROM {documents}")
    was = docs.select(F.concat(F.lit("f"), "doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"))
    later = F.replace(F.concat("text", F.when(F.col("n_chars") % 7 == 0, " ").otherwise("")), F.lit("\n"), F.lit("\r\n"))
    now = docs.select(F.concat(F.lit("f"), F.when(F.col("n_chars") % 13 == 0, "x").otherwise(""), "doc_id").alias("name"), F.encode(later, "UTF-8").alias("content"))
    return oversight.manifest_differences(oversight.file_hashes(was), oversight.file_hashes(now))


# boxes, stops, local candidates, values ---------------------------------------------------
_BOXES = "SELECT l_orderkey, l_linenumber, l_quantity * 1e1 AS x0, l_discount * 1e3 AS y0, l_quantity * 1e1 + 40e0 AS x1, l_discount * 1e3 + 12e0 AS y1, l_tax * 1e2 - 4e0 AS degrees FROM {lineitem}"
_TURNED = ", ".join(f"300e0 + (x - 300e0) * cos(a) - (y - 200e0) * sin(a) AS px{k}, 200e0 + (x - 300e0) * sin(a) + (y - 200e0) * cos(a) AS py{k}".replace("x -", f"{x} -").replace("y -", f"{y} -") for k, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))


@query(f"""WITH b AS (SELECT *, radians(degrees) AS a FROM ({B.duck(_BOXES)}) x), c AS (SELECT l_orderkey, l_linenumber, {_TURNED} FROM b)
SELECT l_orderkey, l_linenumber, round(least(px0, px1, px2, px3), 4) AS x0, round(least(py0, py1, py2, py3), 4) AS y0, round(greatest(px0, px1, px2, px3), 4) AS x1, round(greatest(py0, py1, py2, py3), 4) AS y1 FROM c""")
def boxes_turned(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of boxes on a page that is set straight."""
    c = F.col
    box = regions.rotate(c("x0"), c("y0"), c("x1"), c("y1"), c("degrees"), F.lit(300.0), F.lit(200.0))
    turned = B.bind(spark, d, _BOXES).select("l_orderkey", "l_linenumber", box.alias("b"))
    return turned.select("l_orderkey", "l_linenumber", *(F.round(f"b.{n}", 4).alias(n) for n in ("x0", "y0", "x1", "y1")))


_TRIES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'keep_primary_agreed' WHEN l_quantity < 15 THEN 'rejected_by_grounding' ELSE 'accept_model' END AS decision, CASE WHEN l_quantity < 5 THEN 'B ' || CAST(l_suppkey % 5 AS STRING) ELSE 'f' END AS final, CASE WHEN l_discount < 0.015 THEN '' WHEN l_discount > 0.085 THEN NULL ELSE 'a' END AS primary, l_partkey % 101 / 1e2 AS primary_conf, CASE WHEN l_tax < 0.015 THEN NULL ELSE 'b ' || CAST(l_suppkey % 5 AS STRING) END AS retry, CASE WHEN l_tax < 0.025 THEN NULL ELSE l_suppkey % 101 / 1e2 END AS retry_conf, CAST(l_tax * 100 AS INT) % 3 AS stamps, CAST(l_tax * 100 AS INT) % 2 AS failures FROM {lineitem}"


@query(f"""WITH t AS (SELECT *, decision LIKE 'keep#_primary%' ESCAPE '#' OR decision = 'rejected_by_grounding' AS keep, coalesce(retry, '') <> '' AND (coalesce("primary", '') = '' OR coalesce(retry_conf, 0) > coalesce(primary_conf, 0) + 0.05e0) AS take FROM ({B.duck(_TRIES).replace("AS primary,", 'AS "primary",')}) x)
SELECT l_orderkey, l_linenumber, CASE WHEN keep THEN final WHEN take THEN retry ELSE "primary" END AS value, CASE WHEN keep THEN CASE WHEN lower(final) = lower(retry) THEN coalesce(retry_conf, 0) ELSE coalesce(primary_conf, 0) END WHEN take THEN coalesce(retry_conf, 0) ELSE coalesce(primary_conf, 0) END AS confidence, coalesce(retry_conf >= 0.8e0, false) AND stamps > 0 AND failures = 0 AS stops FROM t""")
def local_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What local attempts alone would have given, and whether another attempt is made."""
    c = F.col
    t = B.bind(spark, d, _TRIES)
    own = t.withColumns({"c": decisions.local_candidate(c("decision"), c("final"), c("primary"), c("primary_conf"), c("retry"), c("retry_conf")), "stops": F.coalesce(candidates.should_stop(c("retry_conf"), F.lit(0.8), c("stamps"), c("failures")), F.lit(False))})
    return own.select("l_orderkey", "l_linenumber", "c.value", "c.confidence", "stops")


@query(f"""WITH t AS ({_EXTRACTION['typed_date_two_pivots']}) SELECT o_orderkey, CASE WHEN printed_date IS NULL THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN printed_date IS NULL THEN 'unparseable date' ELSE '' END AS detail FROM t""")
def dates_valid(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on printed dates."""
    return B.bind(spark, d, B.DATES).select("o_orderkey", validators.date_valid(F.col("printed"), None).alias("v")).select("o_orderkey", "v.verdict", "v.detail")


_CODES = "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'type_of_bill' WHEN 1 THEN 'diagnosis_1' WHEN 2 THEN 'line1_units' ELSE 'patient_name' END AS field_name, CASE l_linenumber % 4 WHEN 0 THEN '0' || CAST(100 + l_partkey % 800 AS STRING) WHEN 1 THEN 'e' || CAST(l_partkey % 90 + 10 AS STRING) || '.' || CAST(l_suppkey % 9 AS STRING) WHEN 2 THEN CAST(l_partkey % 60 AS STRING) || '.50' ELSE ' Doe-' || CAST(l_partkey % 60 AS STRING) || ', J. ' END AS value FROM {lineitem}"


@query(f"""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN right(value, 3) WHEN 1 THEN upper(replace(value, '.', '')) WHEN 2 THEN replace(value, '.50', '.5') ELSE regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') END AS compared FROM ({B.duck(_CODES)}) x""")
def compared_values(spark: SparkSession, d: str) -> DataFrame:
    """Bill types, codes, quantities and names in the form in which they are compared."""
    return B.bind(spark, d, _CODES).select("l_orderkey", "l_linenumber", typed.compared_value(F.col("field_name"), F.col("value")).alias("compared"))


# claims drawn from orders' keys --------------------------------------------------------------
def _draw(what: str, n: int) -> str:
    return f"(CAST('0x' || substr(sha256(s || ':' || {what}), 1, 8) AS BIGINT) % {n})"


def _pick(what: str, of: tuple[str, ...]) -> str:
    return f"([{', '.join(repr(x) for x in of)}])[{_draw(repr(what), len(of))} + 1]"


def _npi(what: str) -> str:
    nine = f"('1' || lpad(CAST({_draw(repr(what), 100_000_000)} AS VARCHAR), 8, '0'))"
    digits = f"list_transform(range(0, 14), lambda i: CAST(('80840' || {nine})[14 - i] AS INT) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)"
    return f"{nine} || CAST((10 - list_sum(list_transform({digits}, lambda d: CASE WHEN d > 9 THEN d - 9 ELSE d END)) % 10) % 10 AS INT)"


_MONTH = f"lpad(CAST({_draw(repr('month'), 5)} + 1 AS VARCHAR), 2, '0')"
_UB = f"""o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s FROM orders),
c AS (SELECT o_orderkey, s, rev_code, hcpcs, row_number() OVER (PARTITION BY o_orderkey ORDER BY {_draw("'code:' || rev_code", 1 << 30)}, rev_code) AS n, CAST({_draw("'units:' || rev_code", 4)} + 1 AS VARCHAR) AS units, {_draw("'cents:' || rev_code", 7020)} * 25 + 9500 AS cents, {_MONTH} || lpad(CAST({_draw(repr('day'), 28)} + 1 AS VARCHAR), 2, '0') || '26' AS service_date
 FROM o, (VALUES {', '.join(map(str, records.UB_PROCEDURES.items()))}) t(rev_code, hcpcs)),
l AS (SELECT *, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS charges FROM c WHERE n <= {_draw(repr('lines'), 2)} + 2)"""


@query(f"""WITH {_UB}, t AS (SELECT o_orderkey AS k, sum(cents) AS cents FROM l GROUP BY o_orderkey)
SELECT o_orderkey, {_pick('bill', records.UB_BILL_TYPES)} AS type_of_bill, 'PC' || ({_draw(repr('control'), 9_000_000)} + 1000000) AS patient_control_no, 'MR' || ({_draw(repr('record'), 900_000)} + 100000) AS medical_record_no, ({_draw(repr('tax'), 90)} + 10) || '-' || ({_draw(repr('tax no'), 9_000_000)} + 1000000) AS federal_tax_no,
 {_MONTH} || lpad(CAST({_draw(repr('day'), 28)} + 1 AS VARCHAR), 2, '0') || '26' AS statement_from, {_MONTH} || lpad(CAST(least({_draw(repr('day'), 28)} + 1 + {_draw(repr('stay'), 4)}, 28) AS VARCHAR), 2, '0') || '26' AS statement_to, {_MONTH} || lpad(CAST({_draw(repr('day'), 28)} + 1 AS VARCHAR), 2, '0') || '26' AS admission_date,
 {_pick('sex', ('M', 'F'))} AS patient_sex, {_pick('payer', records.UB_PAYERS)} AS payer_name, {_pick('dx', records.UB_DIAGNOSES)} AS principal_dx, {_npi('provider')} AS provider_npi, {_npi('attending')} AS attending_npi, ('ABCDEFGHJK')[{_draw(repr('letter'), 10)} + 1] || ({_draw(repr('insured'), 900_000_000)} + 100000000) AS insured_id,
 CAST(t.cents // 100 AS BIGINT) || '.' || lpad(CAST(CAST(t.cents % 100 AS BIGINT) AS VARCHAR), 2, '0') AS total_charges FROM o JOIN t ON t.k = o_orderkey""")
def ub_claims(spark: SparkSession, d: str) -> DataFrame:
    """Hospital claims drawn from orders' keys."""
    return records.synthetic_ub_claims(B.bind(spark, d, "SELECT o_orderkey FROM {orders}"), "o_orderkey").drop("lines")


@query(f"""WITH {_UB} SELECT o_orderkey, 'line' || n || '_' || k AS field_name, CASE k WHEN 'rev_code' THEN rev_code WHEN 'hcpcs' THEN hcpcs WHEN 'service_date' THEN service_date WHEN 'units' THEN units ELSE charges END AS value FROM l, (VALUES ('rev_code'), ('hcpcs'), ('service_date'), ('units'), ('charges')) f(k)""")
def ub_claim_lines(spark: SparkSession, d: str) -> DataFrame:
    """Their lines' fields, a row each."""
    claims = records.synthetic_ub_claims(B.bind(spark, d, "SELECT o_orderkey FROM {orders}"), "o_orderkey")
    return records.flatten_lines(claims, "lines", ["o_orderkey"])


_MARKED = "SELECT l_orderkey AS page, 'line' || CAST(l_linenumber AS STRING) || '_charges' AS field_name, l_quantity < 4 AS inactive, l_discount < 0.015 AS off, CASE WHEN l_returnflag = 'R' AND l_tax > 0.065 THEN 'MARK_NOT_APPLICABLE' WHEN l_returnflag = 'A' THEN 'EDIT' END AS action FROM {lineitem}"
_STAMPED = "SELECT l_orderkey AS page, 'line' || CAST(l_linenumber AS STRING) || '_charges' AS field_name, v AS validator, CASE WHEN v = 'currency_format' AND l_extendedprice > 50000 THEN 'FAIL' ELSE 'PASS' END AS verdict, '' AS detail FROM {lineitem}, (VALUES ('currency_format'), ('claim_arithmetic')) t(v)"


@query(f"""WITH f AS (SELECT *, CASE WHEN action = 'MARK_NOT_APPLICABLE' THEN 'human_review' WHEN inactive THEN 'service_line_activation' WHEN off THEN 'template_blank_policy' END AS own FROM ({B.duck(_MARKED)}) x)
SELECT page, field_name, own AS validator, 'INAPPLICABLE' AS verdict, CASE own WHEN 'human_review' THEN '' WHEN 'service_line_activation' THEN 'service line has no valid activation anchors' ELSE 'optional CMS-1500 value region is blank' END AS detail FROM f WHERE own IS NOT NULL
UNION ALL SELECT page, field_name, validator, verdict, detail FROM ({B.duck(_STAMPED)}) s WHERE NOT EXISTS (SELECT 1 FROM f WHERE own IS NOT NULL AND f.page = s.page AND f.field_name = s.field_name)""")
def workspace_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Rules' stamps, and those of inactive lines, blanks and reviewers in their place."""
    return review.workspace_stamps(B.bind(spark, d, _MARKED), B.bind(spark, d, _STAMPED), ["page"])
