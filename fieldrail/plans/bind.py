"""Input tables of the queries: the driver's tables in the roles of the extraction data.

Each binding is plain SQL that both engines run: names in braces are tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixed_width, scratch
from ..sources.spread import spread

# events as the cost ledger
LEDGER = """
SELECT event_id, ts, CAST(user_id AS STRING) AS doc_id,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE 'p' || CAST(event_id % 3 AS STRING) END AS page_id,
  event_type AS operation, CAST(floor(value * 1000) AS BIGINT) / 1e6 AS cost_usd, CAST(floor(value * 100) AS BIGINT) / 1e1 AS latency_ms,
  CASE WHEN user_id % 3 = 0 THEN 'clean' WHEN user_id % 3 = 1 THEN 'noisy' ELSE 'ugly' END AS tier
FROM {events}"""

# events as routed fields with a recorded cohort of decisions
FIELDS = """
SELECT event_id, CAST(user_id AS STRING) AS doc_id, event_type AS field_name,
  CASE WHEN user_id % 3 = 0 THEN 'clean' WHEN user_id % 3 = 1 THEN 'noisy' ELSE 'ugly' END AS tier,
  CASE WHEN event_id % 5 = 0 THEN 'low' WHEN event_id % 5 < 3 THEN 'med' ELSE 'high' END AS criticality,
  event_id % 11 = 0 AS optional, event_id % 13 <> 0 AS external,
  (event_id * 37 % 101) / 1e2 AS local_conf, event_id % 4 <> 0 AS local_valid, event_id % 6 <> 0 AS local_correct, event_id % 17 <> 0 AS retried,
  (event_id * 53 % 97) / 96e0 AS model_conf, event_id % 9 <> 0 AS model_usable, event_id % 8 <> 0 AS model_correct, event_id % 7 <> 0 AS recorded_correct,
  (event_id % 50) / 1e5 AS projected_usd,
  CASE WHEN event_id % 10 < 6 THEN 'ACCEPT' WHEN event_id % 10 < 8 THEN 'ACCEPT_WITH_FLAG' WHEN event_id % 10 = 8 THEN 'RETRY' ELSE 'HUMAN_REVIEW' END AS state,
  event_id % 6 <> 0 AS correct, CASE WHEN event_id % 19 = 0 THEN '' ELSE 'v' || CAST(event_id AS STRING) END AS value,
  event_id % 3 <> 0 AS validated, event_id % 4 = 0 AS flagged, event_id % 5 <> 4 AS has_validators
FROM {events}"""

# events as pages of a batch
PAGES = """
SELECT user_id, COUNT(*) + 40 AS total_fields, COUNT(*) + 30 AS correct_fields, COUNT(*) + 10 AS critical_fields, COUNT(*) + 8 AS critical_correct,
  (user_id % 40) / 1e5 AS local_usd
FROM {events} GROUP BY user_id"""

# order dates as printed dates of several shapes, some of them broken
DATES = """
SELECT o_orderkey,
  CASE o_orderkey % 9
    WHEN 0 THEN date_format_(o_orderdate, '%m/%d/%Y') WHEN 1 THEN date_format_(o_orderdate, '%m %d %y') WHEN 2 THEN date_format_(o_orderdate, '%m%d%y')
    WHEN 3 THEN date_format_(o_orderdate, '%m%d%Y') WHEN 4 THEN date_format_(o_orderdate, '%Y%m%d') WHEN 5 THEN '13 45 26' WHEN 6 THEN '022750'
    WHEN 7 THEN '1/2/' || CAST(o_orderkey % 100 AS STRING) ELSE 'n/a ' || CAST(o_orderkey % 1000 AS STRING) END AS printed
FROM {orders}"""

# claims: the total of every other order is that of its lines
CLAIMS = """
SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 2 = 0 THEN l.cents ELSE CAST(floor(o.o_totalprice * 100) AS BIGINT) END AS total_cents, l.cents AS line_cents, COALESCE(l.n, 0) AS lines
FROM {orders} o LEFT JOIN (SELECT l_orderkey, SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS cents, COUNT(*) AS n FROM {lineitem} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey"""

# line items as routed fields
ROUTED = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT) AS q,
  CASE WHEN l_partkey % 17 = 0 THEN '' WHEN l_partkey % 5 = 0 THEN CAST(l_partkey AS STRING) || '.00' ELSE 'Abc ' || CAST(l_partkey AS STRING) END AS value,
  (l_partkey * 7 % 101) / 1e2 AS conf, (l_suppkey % 21) / 2e1 AS quality, l_partkey % 9 AS n_spans,
  CASE WHEN l_partkey % 4 = 0 THEN 'currency_format' WHEN l_partkey % 4 = 1 THEN 'name_format' WHEN l_partkey % 4 = 2 THEN 'id_format' ELSE '' END AS rule,
  l_partkey % 6 = 0 AS optional, l_partkey % 3 = 0 AS allow_flag, l_partkey % 11 <> 0 AS external,
  CASE WHEN l_partkey % 3 = 0 THEN 'low' WHEN l_partkey % 3 = 1 THEN 'med' ELSE 'high' END AS criticality,
  l_suppkey % 2 AS retries, l_suppkey % 3 % 2 AS escalations, l_partkey % 7 = 0 AS failing
FROM {lineitem}"""

# lines as spans of a page
SPANS = """
SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS span_no, 'w' || CAST(l_partkey AS STRING) AS text, 'cms1500' AS form,
  CAST(l_partkey * 13 % 900 AS DOUBLE) AS x0, CAST(l_suppkey * 29 % 1000 AS DOUBLE) AS y0,
  CAST(l_partkey * 13 % 900 + 30 + l_partkey % 60 AS DOUBLE) AS x1, CAST(l_suppkey * 29 % 1000 + 12 + l_suppkey % 9 AS DOUBLE) AS y1, (l_partkey % 100) / 1e2 AS conf
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}) d"""

def exact_rounds(sql: str) -> str:
    """round_even() over decimals, so that halves are those of the shortest decimal form."""
    out, at = "", 0
    while (i := sql.find("round_even(", at)) >= 0:
        depth, comma, j = 1, -1, i + len("round_even(")
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            comma = j if c == "," and depth == 1 else comma
            j += 1
        inner = exact_rounds(sql[i + len("round_even(") : comma])
        out += sql[at:i] + f"CAST(round_even(CAST({inner} AS DECIMAL(28,12)),{sql[comma + 1 : j - 1]}) AS DOUBLE)"
        at = j
    return out + sql[at:]


_NAMES = re.compile(r"\{(\w+)\}")


def duck(sql: str) -> str:
    """A binding as DuckDB reads it."""
    return _NAMES.sub(r"\1", sql).replace("date_format_(", "strftime(")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for a, b in (("%m/%d/%Y", "MM/dd/yyyy"), ("%m %d %y", "MM dd yy"), ("%m%d%y", "MMddyy"), ("%m%d%Y", "MMddyyyy"), ("%Y%m%d", "yyyyMMdd")):
        sql = sql.replace(a, b)
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in set(_NAMES.findall(sql))}
    return spark.sql(sql.replace("date_format_(", "date_format("), **tables)


#: Keys of orders that share a written file.
FILE_KEYS = 32768


def written_blocks(spark: SparkSession, orders: DataFrame, key: str, rows: Column, kind: str, end: str) -> DataFrame:
    """Blocks of orders written as compressed fixed-width files in the order of their keys, read again; path is the file's number.

    Orders are dealt by file before their rows are made; rows are mostly blanks, so files are compressed.
    """
    path = scratch.folder(spark, kind)
    dealt = orders.withColumn("file", F.floor(F.col(key) / FILE_KEYS)).repartition(spread(orders), "file").sortWithinPartitions("file", key)
    dealt.select("file", F.array_join(rows, end).alias("value")).write.partitionBy("file").option("lineSep", end).option("compression", "gzip").text(path)
    return fixed_width.read_blocks(spark, path, kind, r"/file=(\d+)/")
