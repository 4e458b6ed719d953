"""Queries of second readings, splits and form profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import local_retry, oversight
from ..sources import records
from . import bind as B

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = B.exact_rounds(sql)
        return f

    return keep


_CROPS = """SELECT CAST(floor(l_orderkey / 16) AS BIGINT) AS page, l_orderkey * 10 + l_linenumber AS crop_no, md5(CAST(l_partkey % 11 AS STRING)) AS key, CAST(60 + (l_partkey % 11) * 170 AS INT) AS width, CAST(10 + (l_partkey % 11) * 7 AS INT) AS height, l_suppkey % 7 = 0 AS is_blank FROM {lineitem}"""
_SHEETS = f"""WITH RECURSIVE c AS ({B.duck(_CROPS)}), u AS (SELECT page, key, any_value(width) AS w, any_value(height) AS h, row_number() OVER (PARTITION BY page ORDER BY min(crop_no), key) AS k FROM c WHERE NOT is_blank GROUP BY page, key),
g AS (SELECT page, greatest(least(1800, greatest(1024, max(w))), max(w) + 48) AS wide, count(*) AS n FROM u GROUP BY page),
s AS (SELECT page, 0 AS k, wide, n, CAST(NULL AS VARCHAR) AS key, 24 AS x, 24 AS y, 0 AS tall, 0 AS x0, 0 AS y0, 0 AS w, 0 AS h FROM g
 UNION ALL SELECT page, k, wide, n, key, px + w + 24, py, greatest(pt, h), px, py, w, h FROM (
   SELECT s.page, u.k, s.wide, s.n, u.key, u.w, u.h, CASE WHEN s.x + u.w + 24 > s.wide AND s.x > 24 THEN 24 ELSE s.x END AS px, CASE WHEN s.x + u.w + 24 > s.wide AND s.x > 24 THEN s.y + s.tall + 24 ELSE s.y END AS py, CASE WHEN s.x + u.w + 24 > s.wide AND s.x > 24 THEN 0 ELSE s.tall END AS pt
   FROM s JOIN u ON u.page = s.page AND u.k = s.k + 1)),
p AS (SELECT page, key, x0, y0, x0 + w AS x1, y0 + h AS y1, CAST(wide AS INT) AS sheet_width, max(CASE WHEN k = n THEN y + tall + 24 END) OVER (PARTITION BY page) AS sheet_height, CAST(n AS INT) AS unique_crops FROM s WHERE k > 0)
"""


@query(_SHEETS + "SELECT page, key, x0, y0, x1, y1, sheet_width, CAST(sheet_height AS INT) AS sheet_height, unique_crops FROM p")
def crop_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Every page's crops on one sheet, equal ones once."""
    return local_retry.pack(B.bind(spark, d, _CROPS))


_SEEN = "SELECT CAST(floor(l_orderkey / 16) AS BIGINT) AS page, 'w' || CAST(l_orderkey * 10 + l_linenumber AS STRING) AS text, CAST((l_partkey * 37 + l_orderkey) % 1700 AS DOUBLE) AS x0, CAST((l_suppkey * 11 + l_linenumber) % 260 AS DOUBLE) AS y0, CAST((l_partkey * 37 + l_orderkey) % 1700 + 40 AS DOUBLE) AS x1, CAST((l_suppkey * 11 + l_linenumber) % 260 + 10 AS DOUBLE) AS y1 FROM {lineitem}"


@query(_SHEETS + f""", v AS ({B.duck(_SEEN)}), w AS (SELECT p.page, p.key, string_agg(v.text, ' ' ORDER BY v.x0, v.text) AS words FROM p JOIN v ON v.page = p.page AND (v.x0 + v.x1) / 2 BETWEEN p.x0 AND p.x1 AND (v.y0 + v.y1) / 2 BETWEEN p.y0 AND p.y1 GROUP BY p.page, p.key)
SELECT c.page, c.crop_no, CASE WHEN NOT is_blank THEN p.x0 END AS x0, CASE WHEN is_blank THEN '' ELSE coalesce(words, '') END AS words FROM c LEFT JOIN p ON p.page = c.page AND p.key = c.key LEFT JOIN w ON w.page = c.page AND w.key = c.key""")
def sheet_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that were read on the sheets, back at their crops."""
    crops = B.bind(spark, d, _CROPS)
    return local_retry.put_back(crops, local_retry.pack(crops), B.bind(spark, d, _SEEN))


_CLAIM_FIELDS = """SELECT o_orderkey AS page, o_custkey, CAST(floor(o_totalprice) AS BIGINT) % 90000 + 1000 AS a, CAST(o_custkey AS BIGINT) % 700 + 10 AS b, (o_orderkey % 21) / 2e1 AS quality FROM {orders}"""
_MONEY = "CAST(CAST({} / 100 AS DECIMAL(18,2)) AS VARCHAR)"


@query(f"""WITH RECURSIVE o AS (SELECT *, a + b AS t FROM ({B.duck(_CLAIM_FIELDS)})),
m AS (SELECT *, {_MONEY.format('a')} AS ma, {_MONEY.format('b')} AS mb, {_MONEY.format('t')} AS mt, {_MONEY.format('(t + 100)')} AS off FROM o),
f AS (SELECT page, quality, MAP {{'line1_charges': CASE WHEN page % 3 = 0 THEN 'x' || ma ELSE ma END, 'line2_charges': CASE WHEN page % 5 = 0 THEN '' ELSE mb END, 'total_charge': CASE WHEN page % 2 = 0 THEN off ELSE mt END, 'patient_dob': '01/02/1980', 'line1_date_from': CASE WHEN page % 7 = 0 THEN '01/02/1970' ELSE '03/04/2024' END}} AS v,
  MAP {{'line1_charges': 0.6e0, 'line2_charges': 0.5e0, 'total_charge': 0.7e0, 'line1_date_from': 0.4e0}} AS known, ma, mb, mt FROM m),
t AS (SELECT page, k, n, CASE k WHEN 1 THEN ma WHEN 2 THEN mb WHEN 3 THEN CASE WHEN page % 11 = 0 THEN '' ELSE mt END ELSE CASE WHEN page % 13 = 0 THEN 'no date' ELSE '03/04/2024' END END AS new, CASE k WHEN 1 THEN 0.55e0 WHEN 2 THEN 0.9e0 WHEN 3 THEN 0.65e0 ELSE 0.8e0 END AS c, k AS spans FROM f, (VALUES (1, 'line1_charges'), (2, 'line2_charges'), (3, 'total_charge'), (4, 'line1_date_from')) x(k, n)),
r AS (SELECT page, 0 AS k, quality, known, v, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS confidence, 0 AS failures, false AS took, false AS changed FROM f
 UNION ALL
 SELECT page, k, quality, known, CASE WHEN took THEN among ELSE v END, n, CASE WHEN took THEN new ELSE old END, CASE WHEN took THEN round_even(CAST(0.55e0 * c + 0.15e0 * quality + 0.15e0 * CASE WHEN spans <= 3 THEN 1 ELSE 1 - 0.15e0 * (spans - 3) END + 0.15e0 * 0.5e0 AS DECIMAL(28,12)), 4) ELSE known[n] END, CASE WHEN took THEN fa ELSE fb END, took, took AND regexp_replace(old, '^x', '') <> new
 FROM (SELECT *, new <> '' AND (old = '' OR fa < fb OR (fa = fb AND (pa > pb OR (pa = pb AND c > known[n])))) AS took FROM (
  SELECT *, {{fa}} AS fa, {{pa}} AS pa, {{fb}} AS fb, {{pb}} AS pb FROM (
   SELECT *, CASE WHEN len(list_filter(nm, lambda x: x IS NULL)) = 0 THEN nm[1] + nm[2] = nm[3] END AS adda, CASE WHEN len(list_filter(om, lambda x: x IS NULL)) = 0 THEN om[1] + om[2] = om[3] END AS addb FROM (
    SELECT *, list_transform([among['line1_charges'], among['line2_charges'], among['total_charge']], lambda x: CASE WHEN regexp_matches(x, '^[0-9]{{{{1,7}}}}[.][0-9][0-9]$') THEN CAST(replace(x, '.', '') AS BIGINT) END) AS nm,
      list_transform([v['line1_charges'], v['line2_charges'], v['total_charge']], lambda x: CASE WHEN regexp_matches(x, '^[0-9]{{{{1,7}}}}[.][0-9][0-9]$') THEN CAST(replace(x, '.', '') AS BIGINT) END) AS om FROM (
     SELECT t.*, r.quality, r.known, r.v, r.v[t.n] AS old, MAP {{'line1_charges': CASE WHEN t.n = 'line1_charges' THEN t.new ELSE r.v['line1_charges'] END, 'line2_charges': CASE WHEN t.n = 'line2_charges' THEN t.new ELSE r.v['line2_charges'] END, 'total_charge': CASE WHEN t.n = 'total_charge' THEN t.new ELSE r.v['total_charge'] END,
       'patient_dob': r.v['patient_dob'], 'line1_date_from': CASE WHEN t.n = 'line1_date_from' THEN t.new ELSE r.v['line1_date_from'] END}} AS among
     FROM r JOIN t ON t.page = r.page AND t.k = r.k + 1))))))
SELECT page, name, value, CAST(confidence AS DOUBLE) AS confidence, failures, took, changed, CASE WHEN failures > 0 OR value = '' THEN 'HUMAN_REVIEW' WHEN confidence >= 0.8 THEN 'ACCEPT' WHEN confidence >= 0.5 THEN 'ACCEPT_WITH_FLAG' ELSE 'HUMAN_REVIEW' END AS state FROM r WHERE k > 0""".replace("{{{{1,7}}}}", "{1,7}").replace("{{1,7}}", "{1,7}").replace("{fa}", "{FA}"))
def retry_fold(spark: SparkSession, d: str) -> DataFrame:
    """Charges, totals and dates that were read again, one after the other: what was taken before counts for what comes next."""
    c = F.col
    o = B.bind(spark, d, _CLAIM_FIELDS)
    money = lambda x: (x.cast("decimal(18,2)") / F.lit(100).cast("decimal(18,2)")).cast("decimal(18,2)").cast("string")
    ma, mb, mt, off = money(c("a")), money(c("b")), money(c("a") + c("b")), money(c("a") + c("b") + 100)
    key = c("page")
    field = lambda n, v, k: F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(k).cast("double").alias("confidence"))
    fields = F.array(
        field("line1_charges", F.when(key % 3 == 0, F.concat(F.lit("x"), ma)).otherwise(ma), 0.6),
        field("line2_charges", F.when(key % 5 == 0, "").otherwise(mb), 0.5),
        field("total_charge", F.when(key % 2 == 0, off).otherwise(mt), 0.7),
        field("patient_dob", F.lit("01/02/1980"), None),
        field("line1_date_from", F.when(key % 7 == 0, "01/02/1970").otherwise("03/04/2024"), 0.4),
    )
    again = lambda no, n, v, k: F.struct(F.lit(no).alias("no"), F.lit(n).alias("name"), v.alias("value"), F.lit(k).alias("confidence"), F.lit(no).alias("n_spans"))
    tries = F.array(
        again(1, "line1_charges", ma, 0.55),
        again(2, "line2_charges", mb, 0.9),
        again(3, "total_charge", F.when(key % 11 == 0, "").otherwise(mt), 0.65),
        again(4, "line1_date_from", F.when(key % 13 == 0, "no date").otherwise("03/04/2024"), 0.8),
    )
    return local_retry.retry_fold(o.select("page", "quality", fields.alias("fields"), tries.alias("tries")))


def _judged(value: str, adds: str) -> tuple[str, str]:
    """SQL of failures and passes of a value; adds: whether charges add up, or null."""
    money = "n IN ('line1_charges', 'line2_charges', 'total_charge')"
    form = f"CASE WHEN {value} = '' THEN false WHEN {money} THEN regexp_matches({value}, '^[0-9]{{1,7}}[.][0-9][0-9]$') ELSE {value} <> 'no date' END"
    later = f"CASE WHEN n = 'line1_date_from' AND {value} NOT IN ('', 'no date') THEN {value} <> '01/02/1970' END"
    parts = (form, f"CASE WHEN {money} THEN {adds} END", later)
    return " + ".join(f"coalesce(CAST(NOT ({p}) AS INT), 0)" for p in parts), " + ".join(f"coalesce(CAST(({p}) AS INT), 0)" for p in parts)


for _name, _text in zip(("{FA}", "{pa}", "{fb}", "{pb}"), (*_judged("new", "adda"), *_judged("old", "addb"))):
    SQL["retry_fold"] = SQL["retry_fold"].replace(_name, _text)


@query("""WITH h AS (SELECT doc_id, lang AS form, CAST('0x' || substr(sha256('9:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY h) AS k, count(*) OVER (PARTITION BY form) AS n FROM h)
SELECT doc_id, form, CASE WHEN k <= floor(n * CAST('0.4' AS DECIMAL(6,4))) THEN 'calibration' ELSE 'test' END AS part FROM r""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents parted for calibration and test, two fifths of each language."""
    return records.split_documents(B.bind(spark, d, "SELECT doc_id, lang AS form FROM {documents}"), 9)


_VARIANTS = "SELECT vec_id, embedding FROM {embeddings}"


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT vec_id, e[1:32] AS r, e[33:64] AS c FROM v),
z AS (SELECT vec_id, list_transform(r, lambda x: (x - list_avg(r)) / sqrt(list_sum(list_transform(r, lambda y: (y - list_avg(r)) * (y - list_avg(r)))))) AS r, list_transform(c, lambda x: (x - list_avg(c)) / sqrt(list_sum(list_transform(c, lambda y: (y - list_avg(c)) * (y - list_avg(c)))))) AS c FROM p),
f AS (SELECT vec_id AS variant, CASE WHEN vec_id % 2 = 0 THEN 'cms1500' ELSE 'ub04' END AS form, r, c FROM z WHERE vec_id < 5),
s AS (SELECT z.vec_id, f.form, f.variant, round(0.45e0 * list_max(list_transform(range(-4, 5), lambda k: list_sum(list_transform(range(32), lambda i: z.r[i + 1] * f.r[(i - k + 32) % 32 + 1])))) + 0.55e0 * list_max(list_transform(range(-4, 5), lambda k: list_sum(list_transform(range(32), lambda i: z.c[i + 1] * f.c[(i - k + 32) % 32 + 1])))), 9) AS score FROM z, f),
b AS (SELECT vec_id, form, max(score) AS score, max_by(variant, (score, variant)) AS variant FROM s GROUP BY vec_id, form),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, form) AS k, coalesce(lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, form), 0) AS second FROM b)
SELECT vec_id, CASE WHEN score >= 0.5e0 AND score - second >= 0.05e0 THEN form ELSE 'unknown' END AS form, CASE WHEN score >= 0.5e0 AND score - second >= 0.05e0 THEN variant END AS variant, round_even(score, 6) AS score FROM w WHERE k = 1""")
def profile_routes(spark: SparkSession, d: str) -> DataFrame:
    """Pages routed by their row and column profiles against forms' variants, over small circular shifts."""
    c = F.col
    v = B.bind(spark, d, _VARIANTS).select("vec_id", c("embedding").cast("array<double>").alias("e"))
    pages = v.select("vec_id", F.slice("e", 1, 32).alias("rows"), F.slice("e", 33, 32).alias("cols"))
    forms = pages.filter("vec_id < 5").select(F.when(c("vec_id") % 2 == 0, "cms1500").otherwise("ub04").alias("form"), c("vec_id").alias("variant"), "rows", "cols")
    return oversight.profile_routes(pages, forms, "vec_id", least=0.5).select("vec_id", "form", "variant", F.bround("score", 6).alias("score"))
