"""Queries of ledger, evaluation and calibration reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import text as X
from ..operators import calibration, evaluation, ledger, review
from ..sources import records
from ..streaming import ledger as stream
from . import bind as B

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = B.exact_rounds(sql)
        return f

    return keep


L, FIELDS, PAGES = B.duck(B.LEDGER), B.duck(B.FIELDS), B.duck(B.PAGES)
DEC = "CAST(CAST(SUM(CAST({} AS DECIMAL(38,8))) AS DOUBLE) AS DOUBLE)"


@query(f"""WITH l AS ({L}), s AS (
  SELECT operation, COUNT(*) AS calls, round_even({DEC.format('cost_usd')}, 6) AS cost_usd, round_even({DEC.format('latency_ms')}, 1) AS latency_ms,
    COUNT(DISTINCT CASE WHEN page_id <> '' THEN doc_id || '/' || page_id END) AS pages
  FROM l GROUP BY GROUPING SETS ((operation), ()))
SELECT *, CASE WHEN pages = 0 THEN 0.0 ELSE round_even(cost_usd / pages, 6) END AS cost_per_page_usd FROM s""")
def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.summary(B.bind(spark, d, B.LEDGER))


@query(f"WITH l AS ({L}) SELECT operation, COUNT(*) AS calls, round_even({DEC.format('cost_usd')}, 8) AS cost_usd FROM l GROUP BY operation")
def stage_costs(spark: SparkSession, d: str) -> DataFrame:
    return ledger.stage_costs(B.bind(spark, d, B.LEDGER))


@query(f"WITH l AS ({L}) SELECT operation, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM l GROUP BY operation")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ledger.percentiles(B.bind(spark, d, B.LEDGER), "operation", "latency_ms")


@query(f"""WITH l AS ({L}) SELECT doc_id, page_id, operation, min_by(event_id, event_id) AS event_id, min_by(cost_usd, event_id) AS cost_usd FROM l GROUP BY doc_id, page_id, operation""")
def ledger_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    rows = B.bind(spark, d, B.LEDGER).select("doc_id", "page_id", "operation", "event_id", "cost_usd")
    return ledger.first_of_key(rows, ["doc_id", "page_id", "operation"], "event_id")


@query(f"""WITH l AS ({L}) SELECT doc_id, page_id, operation, max(event_id) AS event_id, max_by(cost_usd, event_id) AS cost_usd FROM l GROUP BY doc_id, page_id, operation""")
def ledger_last_of_key(spark: SparkSession, d: str) -> DataFrame:
    rows = B.bind(spark, d, B.LEDGER).select("doc_id", "page_id", "operation", "event_id", "cost_usd")
    return ledger.last_of_key(rows, ["doc_id", "page_id", "operation"], "event_id")


_VOLUMES = (1_000, 10_000, 100_000, 1_000_000, 10_000_000, 100_000_000)


@query(f"""WITH l AS ({L}), s AS (SELECT {DEC.format('cost_usd')} / COUNT(DISTINCT CASE WHEN page_id <> '' THEN doc_id || '/' || page_id END) AS c FROM l)
SELECT CAST(v AS BIGINT) AS volume, round_even(c * v, 4) AS local_usd, round_even(0.0000227 * v, 4) AS api_usd, round_even((c + 0.0000227) * v, 4) AS automated_usd, round_even(0.0196 * v * 0.03, 4) AS human_usd
FROM s, (VALUES {', '.join(f'({v})' for v in _VOLUMES)}) t(v)""")
def cost_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = B.bind(spark, d, B.LEDGER)
    page = F.when(~X.blank(F.col("page_id")), F.struct("doc_id", "page_id"))
    per = rows.agg((ledger.total(F.col("cost_usd")) / F.count_distinct(page)).alias("c"))
    made = per.crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in _VOLUMES], "volume long")))
    out = made.select("volume", ledger.projection(F.col("c"), F.lit(0.0000227), F.lit(0.0196), F.col("volume")).alias("p"))
    return out.select("volume", *(F.bround(f"p.{c}", 4).alias(c) for c in ("local_usd", "api_usd", "automated_usd", "human_usd")))


_PRICES = (("small", 0.05, 0.20), ("large", 0.40, 1.60))


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'small' WHEN event_id % 3 = 1 THEN 'large' ELSE 'none' END AS model, event_id % 900 + 50 AS ti, event_id % 70 + 5 AS t_o FROM events)
SELECT e.model, COUNT(*) AS calls, COUNT(p.model) AS priced, round_even({DEC.format('ti / 1e6 * p.i + t_o / 1e6 * p.o')}, 6) AS usd
FROM e LEFT JOIN (VALUES ('small', 0.05, 0.20), ('large', 0.40, 1.60)) p(model, i, o) ON e.model = p.model GROUP BY e.model""")
def mode_price_projection(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.typed import token_cost

    e = B.bind(spark, d, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'small' WHEN event_id % 3 = 1 THEN 'large' ELSE 'none' END AS model, event_id % 900 + 50 AS ti, event_id % 70 + 5 AS t_o FROM {events}")
    p = spark.createDataFrame(list(_PRICES), "model string, i double, o double").withColumn("has", F.lit(1))
    out = e.join(F.broadcast(p), "model", "left").withColumn("usd", token_cost(F.col("ti"), F.col("t_o"), F.col("i"), F.col("o")))
    return out.groupBy("model").agg(F.count("*").alias("calls"), F.count("has").alias("priced"), F.bround(ledger.total(F.col("usd")), 6).alias("usd"))


@query(f"""WITH f AS ({FIELDS}), s AS (SELECT tier, COUNT(*) AS fields, COUNT(*) FILTER (correct) AS correct_fields, COUNT(*) FILTER (criticality = 'high') AS critical_fields,
  COUNT(*) FILTER (criticality = 'high' AND correct) AS critical_correct, COUNT(*) FILTER (state = 'HUMAN_REVIEW') AS human, COUNT(*) FILTER (state = 'ACCEPT_WITH_FLAG') AS flagged,
  COUNT(*) FILTER (state IN ('ACCEPT', 'ACCEPT_WITH_FLAG') AND correct) AS automated_correct FROM f GROUP BY GROUPING SETS ((tier), ()))
SELECT *, round_even(correct_fields / fields, 8) AS accuracy, round_even(critical_correct / critical_fields, 8) AS critical_accuracy, round_even(human / fields, 8) AS human_rate, round_even(automated_correct / fields, 8) AS automated_rate FROM s""")
def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = B.bind(spark, d, B.FIELDS)
    return evaluation.per_tier(rows, "tier", rows.select("doc_id", "tier"), ["doc_id", "tier"])


_STATES = ("ACCEPT", "ACCEPT_WITH_FLAG", "RETRY", "HUMAN_REVIEW")


@query(f"""WITH f AS ({FIELDS}) SELECT tier, COUNT(*) AS fields, {', '.join(f"round_even(100.0 * COUNT(*) FILTER (state = '{s}') / COUNT(*), 4) AS {s.lower()}" for s in _STATES)} FROM f GROUP BY tier""")
def resolution_funnel(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.funnel(B.bind(spark, d, B.FIELDS), "tier", _STATES)


@query(f"""WITH f AS (SELECT * FROM ({FIELDS}) WHERE has_validators), s AS (SELECT tier, COUNT(*) FILTER (NOT correct) AS errors, COUNT(*) FILTER (NOT correct AND flagged) AS caught, COUNT(*) FILTER (correct) AS "right",
  COUNT(*) FILTER (correct AND flagged) AS alarms, round_even(CAST(SUM(CAST(local_conf AS DECIMAL(20,10))) AS DOUBLE) / COUNT(*), 4) AS mean_conf FROM f GROUP BY tier)
SELECT *, round_even(caught / errors, 4) AS catch_rate, round_even(alarms / "right", 4) AS false_alarm_rate FROM s""")
def catch_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.catch_rates(B.bind(spark, d, B.FIELDS).withColumn("conf", F.col("local_conf")), "tier")


@query(f"""WITH f AS ({FIELDS}), s AS (SELECT tier, COUNT(*) AS applicable, COUNT(*) FILTER (value <> '') AS produced, COUNT(*) FILTER (validated) AS validated, COUNT(*) FILTER (local_conf >= 0.85) AS high,
  COUNT(*) FILTER (local_conf >= 0.60 AND local_conf < 0.85) AS medium, COUNT(*) FILTER (local_conf < 0.60) AS low, COUNT(*) FILTER (criticality = 'high') AS critical,
  COUNT(*) FILTER (criticality = 'high' AND state IN ('ACCEPT', 'ACCEPT_WITH_FLAG', 'ACCEPT_WITH_OVERRIDE')) AS critical_resolved FROM f GROUP BY tier)
SELECT *, CASE WHEN tier <> 'ugly' THEN round_even(produced / applicable, 6) END AS produced_share, CASE WHEN tier <> 'ugly' THEN round_even(validated / applicable, 6) END AS validated_share,
  CASE WHEN tier <> 'ugly' THEN round_even(critical_resolved / critical, 6) END AS critical_share FROM s""")
def coverage_bands(spark: SparkSession, d: str) -> DataFrame:
    f = B.bind(spark, d, B.FIELDS).withColumns({"confidence": F.col("local_conf"), "critical": F.col("criticality") == "high", "known": F.col("tier") != "ugly"})
    return evaluation.coverage(f, "tier")


@query(f"""WITH f AS ({FIELDS}), s AS (SELECT doc_id, COUNT(*) FILTER (state = 'HUMAN_REVIEW') AS h, COUNT(*) FILTER (state = 'ACCEPT_WITH_FLAG') AS g, CAST(doc_id AS BIGINT) % 10 = 3 AS x FROM f GROUP BY doc_id)
SELECT doc_id, CASE WHEN x THEN 'FAILED' WHEN h > 9 THEN 'NEEDS_REVIEW' WHEN g > 12 THEN 'COMPLETED_WITH_FLAGS' ELSE 'COMPLETED' END AS status FROM s""")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    f = B.bind(spark, d, B.FIELDS).groupBy("doc_id").agg(F.count_if(F.col("state") == "HUMAN_REVIEW").alias("h"), F.count_if(F.col("state") == "ACCEPT_WITH_FLAG").alias("g"))
    more = lambda c, n: F.greatest(F.col(c) - n, F.lit(0))
    return f.select("doc_id", evaluation.document_status(F.col("doc_id").cast("long") % 10 == 3, more("h", 9), more("g", 12)).alias("status"))


@query(f"""WITH f AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 'x' || value ELSE value END AS truth FROM ({FIELDS})), k AS (SELECT tier,
  CASE WHEN state = 'HUMAN_REVIEW' THEN 'FN' WHEN lower(truth) = lower(value) THEN 'TP' WHEN value = '' THEN 'FN' ELSE 'FP' END AS kind FROM f),
s AS (SELECT tier, COUNT(*) FILTER (kind = 'TP') AS tp, COUNT(*) FILTER (kind = 'FP') AS fp, COUNT(*) FILTER (kind = 'FN') AS fn FROM k GROUP BY tier)
SELECT *, round_even(tp / (tp + fp), 8) AS precision, round_even(tp / (tp + fn), 8) AS recall FROM s""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    f = B.bind(spark, d, B.FIELDS).withColumn("truth", F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("x"), "value")).otherwise(F.col("value")))
    return evaluation.precision_recall(f.withColumn("kind", evaluation.partition(F.col("state"), F.col("truth"), F.col("value"))), "kind", ["tier"])


@query(f"""WITH f AS (SELECT tier, field_name, CASE WHEN event_id % 23 = 0 THEN 'false_positive' WHEN value = '' THEN 'missing' WHEN correct THEN 'correct' ELSE 'incorrect' END AS o FROM ({FIELDS})),
s AS (SELECT tier, field_name, COUNT(*) FILTER (o = 'correct') AS correct, COUNT(*) FILTER (o = 'incorrect') AS incorrect, COUNT(*) FILTER (o = 'missing') AS missing, COUNT(*) FILTER (o = 'false_positive') AS false_positive
  FROM f GROUP BY GROUPING SETS ((), (tier), (field_name)))
SELECT *, round_even(correct / (correct + incorrect + false_positive), 6) AS precision, round_even(correct / (correct + incorrect + missing), 6) AS recall FROM s""")
def evaluation_by_group(spark: SparkSession, d: str) -> DataFrame:
    o = F.when(F.col("event_id") % 23 == 0, "false_positive").when(F.col("value") == "", "missing").when(F.col("correct"), "correct").otherwise("incorrect")
    return evaluation.by_group(B.bind(spark, d, B.FIELDS).select("tier", "field_name", o.alias("outcome")), ["tier", "field_name"])


_ARMS = ("ocr_only", "prep", "validators", "retry", "full")


def _arms(f: DataFrame) -> DataFrame:
    e = F.col("event_id")
    made = [F.struct((e % (k + 3) != 0).alias("correct"), F.when(e % (k + 5) == 0, "HUMAN_REVIEW").otherwise("ACCEPT").alias("state"), ((e % 10 + k) / 10000.0).alias("cost_usd"), ((e % 300 + k) / 10.0).alias("latency_ms")).alias(n) for k, n in enumerate(_ARMS)]
    return f.withColumn("ablation", F.struct(*made))


@query("WITH f AS (" + FIELDS + "), a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS arm, criticality, event_id % {k + 3} <> 0 AS c, event_id % {k + 5} = 0 AS h, (event_id % 10 + {k}) / 1e4 AS usd, (event_id % 300 + {k}) / 1e1 AS ms FROM f" for k, n in enumerate(_ARMS)) + f"""),
s AS (SELECT arm, COUNT(*) AS fields, COUNT(*) FILTER (c) AS "right", COUNT(*) FILTER (criticality = 'high') AS critical, COUNT(*) FILTER (criticality = 'high' AND c) AS critical_right, COUNT(*) FILTER (h) AS unresolved, {DEC.format('usd')} AS cost_usd, round_even(CAST(SUM(CAST(ms AS DECIMAL(20,8))) AS DOUBLE) / COUNT(*), 4) AS mean_latency_ms FROM a GROUP BY arm)
SELECT *, round_even("right" / fields, 6) AS accuracy, round_even(critical_right / critical, 6) AS critical_accuracy FROM s""")
def ablation_arms(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.arms(_arms(B.bind(spark, d, B.FIELDS)), "ablation")


@query(f"""WITH f AS (SELECT tier, retried, CAST(local_conf AS DECIMAL(20,8)) AS v FROM ({FIELDS})),
s AS (SELECT tier, round_even(CAST(SUM(v) FILTER (NOT retried) AS DOUBLE) / COUNT(*) FILTER (NOT retried), 6) AS "without", round_even(CAST(SUM(v) FILTER (retried) AS DOUBLE) / COUNT(*) FILTER (retried), 6) AS "with" FROM f GROUP BY tier)
SELECT *, round_even("with" - "without", 6) AS gain FROM s""")
def prep_uplift_pivot(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.uplift(B.bind(spark, d, B.FIELDS), ["tier"], "retried", "local_conf")


@query("""WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'paddle' ELSE 'tess' END AS engine, event_id % 3 <> 0 AS hit FROM events),
h AS (SELECT DISTINCT user_id, event_type FROM e WHERE engine = 'tess' AND hit), m AS (SELECT user_id, event_type FROM e WHERE engine = 'paddle' AND NOT hit)
SELECT COUNT(*) AS misses, COUNT(h.user_id) AS rescued, round_even(COUNT(h.user_id) / COUNT(*), 6) AS rate FROM m LEFT JOIN h ON m.user_id = h.user_id AND m.event_type = h.event_type""")
def engine_rescue(spark: SparkSession, d: str) -> DataFrame:
    rows = B.bind(spark, d, "SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'paddle' ELSE 'tess' END AS engine, event_id % 3 <> 0 AS hit FROM {events}")
    return evaluation.rescue(rows, ["user_id", "event_type"], "paddle", "tess")


# calibration ---------------------------------------------------------------
_GRID = """SELECT 'local-' || printf('%.2f', a) || '_model-' || printf('%.2f', m) || '_paid-' || p || '_flags-' || f AS point_id, a, m, p, f = 'on' AS flags
FROM (VALUES (0.80), (0.84), (0.88), (0.92), (0.95)) x(a), (VALUES (0.88), (0.90), (0.92), (0.95)) y(m), (VALUES ('high'), ('high-med'), ('high-med-low')) z(p), (VALUES ('on'), ('off')) w(f)"""
_SWEEP = f"""WITH f AS ({FIELDS}), g AS ({_GRID}), pg AS ({PAGES}),
a AS (SELECT g.*, f.*, local_valid AND local_conf >= a AS loc, '-' || p || '-' LIKE '%-' || criticality || '-%' AND external AND NOT optional AND retried AS eligible FROM f, g),
b AS (SELECT *, NOT loc AND eligible AS called, NOT loc AND eligible AND model_usable AND model_conf >= m AS usable FROM a),
c AS (SELECT *, CASE WHEN loc OR usable THEN 'A' WHEN flags AND criticality IN ('low', 'med') AND local_valid THEN 'F' ELSE 'H' END AS st, CASE WHEN usable THEN model_correct ELSE local_correct END AS ok FROM b),
s AS (SELECT point_id, COUNT(*) FILTER (called) AS escalated, COUNT(*) FILTER (st = 'H') AS human, COUNT(*) FILTER (st = 'F') AS flagged, COUNT(*) FILTER (ok) AS rc, COUNT(*) FILTER (criticality = 'high') AS cr, COUNT(*) FILTER (criticality = 'high' AND ok) AS crc,
  COUNT(*) FILTER (ok AND st <> 'H') AS tc, {DEC.format('CASE WHEN called THEN projected_usd ELSE 0 END')} AS api FROM c GROUP BY point_id),
o AS (SELECT COUNT(*) FILTER (recorded_correct) AS was, COUNT(*) FILTER (criticality = 'high') AS crows, COUNT(*) FILTER (criticality = 'high' AND recorded_correct) AS cwas FROM f),
w AS (SELECT COUNT(*) AS np, CAST(SUM(total_fields) AS BIGINT) AS total, CAST(SUM(correct_fields) AS BIGINT) AS okf, CAST(SUM(critical_fields) AS BIGINT) AS ct, CAST(SUM(critical_correct) AS BIGINT) AS cok, {DEC.format('local_usd')} AS lu FROM pg),
points AS (SELECT point_id, okf - was + rc AS correct_fields, round_even((okf - was + rc) / total, 6) AS field_accuracy, round_even((cok - cwas + crc) / (ct - crows + cr), 6) AS critical_field_accuracy, escalated, human,
  round_even(human / total, 6) AS human_review_rate, flagged, okf - was + tc AS automated_correct, round_even((lu + api) / np, 6) AS cost_per_page_usd FROM s, o, w)
"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    return calibration.simulate(B.bind(spark, d, B.FIELDS), B.bind(spark, d, B.PAGES), calibration.grid(spark))


@query(_SWEEP + "SELECT * FROM points")
def calibration_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d)


@query(_SWEEP + ", r AS (SELECT *, MAX(field_accuracy) OVER (ORDER BY cost_per_page_usd, field_accuracy DESC, human_review_rate, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM points) SELECT * EXCLUDE (b) FROM r WHERE field_accuracy > COALESCE(b, -1)")
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    return calibration.frontier(_points(spark, d))


@query(_SWEEP + ", e AS (SELECT * FROM points WHERE point_id LIKE '%paid-high-med#_%' ESCAPE '#' AND point_id LIKE '%flags-on' AND critical_field_accuracy >= 0.5) SELECT * FROM e WHERE field_accuracy >= (SELECT MAX(field_accuracy) FROM e) - 0.001 ORDER BY cost_per_page_usd, human_review_rate, point_id LIMIT 1")
def recommend_point(spark: SparkSession, d: str) -> DataFrame:
    return calibration.recommend(_points(spark, d), 0.5)


# failures ------------------------------------------------------------------
_FAIL = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'clean' WHEN l_partkey % 3 = 1 THEN 'noisy' ELSE 'ugly' END AS tier, l_returnflag AS field_name, CASE WHEN l_suppkey % 9 < 5 THEN 'cms1500' ELSE 'ub04' END AS document_type, CASE WHEN l_suppkey % 8 < 3 THEN 'high' WHEN l_suppkey % 8 < 6 THEN 'med' ELSE 'low' END AS criticality,
  CASE WHEN l_partkey % 11 <> 0 THEN 'none' WHEN l_suppkey % 2 = 0 THEN 'currency_format' ELSE 'claim_arithmetic;currency_format' END AS validator_failure, CASE WHEN l_partkey % 3 = 0 THEN 'clean' WHEN l_partkey % 3 = 1 THEN 'noisy' ELSE 'ugly' END AS image_quality,
  CASE WHEN l_suppkey % 4 = 0 THEN 'HUMAN_REVIEW' ELSE 'ACCEPT' END AS state, l_suppkey % 5 = 0 AS correct, l_partkey % 11 = 0 AS rule_failed, l_partkey % 13 = 0 AS rejected,
  CASE WHEN l_partkey % 7 = 0 THEN 'Alphabetic Truth Of Some Length' WHEN l_partkey % 7 = 1 THEN 'ab' ELSE 'T' || CAST(l_partkey AS STRING) || '-x' END AS truth,
  CASE WHEN l_partkey % 5 = 0 THEN 'T' || CAST(l_partkey AS STRING) || 'X' WHEN l_partkey % 5 = 1 THEN '' ELSE 'zz' END AS final_value,
  CASE WHEN l_suppkey % 3 = 0 THEN '' WHEN l_suppkey % 3 = 1 THEN 'T' || CAST(l_partkey AS STRING) || '-x' ELSE 'q' END AS primary_value,
  CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE 'r' END AS retry_value, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 's' END AS model_value, CAST(l_partkey % 300 AS INT) AS w, CAST(l_suppkey % 200 + 20 AS INT) AS h
FROM {lineitem}"""
_CAUSES = f"""WITH f AS (SELECT * FROM ({B.duck(_FAIL)}) WHERE state NOT IN ('ACCEPT', 'ACCEPT_WITH_FLAG', 'ACCEPT_WITH_OVERRIDE') OR NOT correct),
n AS (SELECT *, CASE WHEN primary_value = '' THEN 'missing' WHEN lower(replace(primary_value, ' ', '')) = lower(replace(truth, ' ', '')) THEN 'correct' ELSE 'incorrect' END AS primary_outcome,
  CASE WHEN retry_value = '' THEN 'missing' ELSE 'incorrect' END AS retry_outcome, CASE WHEN model_value = '' THEN 'missing' ELSE 'incorrect' END AS escalation_outcome,
  lower(regexp_replace(truth, '[^A-Za-z0-9_]', '', 'g')) AS bt, lower(regexp_replace(final_value, '[^A-Za-z0-9_]', '', 'g')) AS bf, lower(regexp_replace(primary_value, '[^A-Za-z0-9_]', '', 'g')) AS bp,
  lower(replace(truth, ' ', '')) AS nt, lower(replace(final_value, ' ', '')) AS nf, lower(replace(primary_value, ' ', '')) AS np,
  CASE WHEN regexp_matches(regexp_replace(truth, '[^A-Za-z0-9]', '', 'g'), '^[A-Za-z]+$') THEN 'alphabetic' WHEN regexp_matches(regexp_replace(truth, '[^A-Za-z0-9]', '', 'g'), '^[0-9]+$') THEN 'numeric' ELSE 'mixed' END AS character_type,
  CASE WHEN length(truth) <= 4 THEN '1-4' WHEN length(truth) <= 9 THEN '5-9' WHEN length(truth) <= 19 THEN '10-19' ELSE '20+' END AS character_length, CASE WHEN w * h < 10000 THEN 'small' WHEN w * h < 30000 THEN 'medium' ELSE 'large' END AS crop FROM f),
c AS (SELECT *, CASE WHEN state = 'HUMAN_REVIEW' AND correct THEN 'governor_threshold' WHEN rule_failed AND correct THEN 'validator_strictness' WHEN nf <> nt AND bf = bt THEN 'normalization'
  WHEN rejected OR (primary_outcome = 'correct' AND escalation_outcome = 'incorrect') THEN 'oracle_limitation' WHEN np <> nt AND bp = bt THEN 'normalization' WHEN least(w, h) < 50 THEN 'crop_accuracy'
  WHEN primary_outcome = 'missing' OR retry_outcome = 'missing' OR length(truth) <= 2 THEN 'ocr_segmentation' WHEN length(truth) >= 20 AND character_type = 'alphabetic' THEN 'field_mapping' WHEN tier = 'ugly' THEN 'preprocessing' ELSE 'genuinely_unreadable_source' END AS cause FROM n),
r AS (SELECT *, CASE cause WHEN 'governor_threshold' THEN 'governor_threshold_calibration' WHEN 'validator_strictness' THEN 'validator_correction' WHEN 'normalization' THEN 'deterministic_normalization' WHEN 'oracle_limitation' THEN 'multimodal_escalation'
  WHEN 'crop_accuracy' THEN 'better_local_crop_strategy' WHEN 'ocr_segmentation' THEN 'field_specific_ocr_mode' WHEN 'field_mapping' THEN 'better_local_crop_strategy' WHEN 'preprocessing' THEN 'better_local_crop_strategy' ELSE 'human_review_only' END AS resolution FROM c)
"""
_DIMS = ("tier", "document_type", "field_name", "criticality", "validator_failure", "image_quality", "primary_outcome", "retry_outcome", "escalation_outcome", "character_type", "character_length", "crop", "cause", "resolution")


def _failures(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    f = B.bind(spark, d, _FAIL).filter(~c("state").isin(*D.TERMINAL) | ~c("correct"))
    f = f.withColumns({"primary_outcome": X.outcome(c("primary_value"), c("truth")), "retry_outcome": X.outcome(c("retry_value"), c("truth")), "escalation_outcome": X.outcome(c("model_value"), c("truth"))})
    f = f.withColumns({"character_type": X.char_type(c("truth")), "character_length": X.length_bucket(F.length("truth")), "crop": X.area_bucket(c("w"), c("h"))})
    why = D.root_cause(c("state"), c("correct"), c("rule_failed"), c("truth"), c("final_value"), c("primary_value"), c("rejected"), c("primary_outcome"), c("retry_outcome"), c("escalation_outcome"), F.least("w", "h"), c("character_type"), c("tier"))
    return f.withColumn("cause", why)


@query(_CAUSES + "SELECT l_orderkey, l_linenumber, l_partkey, cause, resolution FROM r")
def root_cause(spark: SparkSession, d: str) -> DataFrame:
    return _failures(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "cause").withColumn("resolution", D.resolution_of(F.col("cause")))


@query(_CAUSES + " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS value, COUNT(*) AS n FROM r GROUP BY {x}" for x in _DIMS))
def failure_histograms(spark: SparkSession, d: str) -> DataFrame:
    return calibration.histograms(_failures(spark, d), list(_DIMS[:-1]), {"resolution": D.resolution_of(F.col("cause"))})


@query(_CAUSES + "SELECT tier, document_type, field_name, cause, resolution, COUNT(*) AS n FROM r GROUP BY ALL ORDER BY n DESC, tier, document_type, field_name, cause, resolution LIMIT 20")
def failure_clusters(spark: SparkSession, d: str) -> DataFrame:
    return calibration.clusters(_failures(spark, d).withColumn("resolution", D.resolution_of(F.col("cause"))), ["tier", "document_type", "field_name", "cause", "resolution"])


@query(_CAUSES + f"SELECT x AS resolution, COUNT(r.resolution) AS n FROM (VALUES {', '.join(f"('{x}')" for x in calibration.RESOLUTIONS)}) t(x) LEFT JOIN r ON r.resolution = x GROUP BY x")
def resolution_counts(spark: SparkSession, d: str) -> DataFrame:
    return calibration.resolution_counts(_failures(spark, d).select(D.resolution_of(F.col("cause")).alias("resolution")))


# resume, sets, review -------------------------------------------------------
@query("SELECT event_id, user_id FROM events e WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0) ORDER BY event_id LIMIT 500")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    e = B.bind(spark, d, "SELECT event_id, user_id FROM {events}")
    return records.resume(e, e.filter("event_id % 3 = 0"), ["event_id"], ["event_id"], 500)


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 4 <> 0 EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 4 = 0")
def append_once(spark: SparkSession, d: str) -> DataFrame:
    e = B.bind(spark, d, "SELECT event_id, user_id, event_type FROM {events}")
    return records.append_once(e.filter("event_id % 4 = 0"), e.filter("event_id % 4 != 0"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("""SELECT (SELECT COUNT(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS missing, (SELECT COUNT(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS stray,
 (SELECT COUNT(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)) AS common, (SELECT COUNT(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1)) AS repeated""")
def set_checks(spark: SparkSession, d: str) -> DataFrame:
    o, li = (B.bind(spark, d, f"SELECT {c} AS k FROM {{{t}}}") for c, t in (("o_orderkey", "orders"), ("l_orderkey", "lineitem")))
    keys = B.bind(spark, d, "SELECT l_orderkey, l_linenumber FROM {lineitem}")
    one = lambda frame, name: frame.agg(F.count("*").alias(name))
    parts = [one(o.subtract(li), "missing"), one(li.subtract(o), "stray"), one(o.intersect(li), "common"), one(keys.groupBy(*keys.columns).agg(F.count("*").alias("n")).filter("n > 1"), "repeated")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query(f"""WITH f AS (SELECT event_id, value, state FROM ({FIELDS})), a AS (SELECT event_id // 2 AS event_id, max_by({{'a': CASE event_id % 5 WHEN 0 THEN 'EDIT' WHEN 1 THEN 'MARK_BLANK' WHEN 2 THEN 'MARK_NOT_APPLICABLE' WHEN 3 THEN 'LEAVE_UNRESOLVED' ELSE 'REJECT_DOCUMENT' END, 'v': event_id % 3 <> 0, 'n': 'n' || event_id}}, event_id) AS x FROM events WHERE event_id % 7 < 4 GROUP BY event_id // 2)
SELECT f.event_id, CASE WHEN x.a = 'EDIT' THEN x.n WHEN x.a IN ('MARK_BLANK', 'MARK_NOT_APPLICABLE') THEN '' ELSE value END AS value,
  CASE WHEN x.a IN ('EDIT', 'MARK_BLANK') THEN CASE WHEN x.v THEN 'ACCEPT_WITH_OVERRIDE' ELSE 'HUMAN_REVIEW' END WHEN x.a = 'MARK_NOT_APPLICABLE' THEN 'ACCEPT_WITH_OVERRIDE' WHEN x.a IS NOT NULL THEN 'HUMAN_REVIEW' ELSE state END AS state, x.a AS action
FROM f LEFT JOIN a ON f.event_id = a.event_id""")
def review_overlay(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    f = B.bind(spark, d, B.FIELDS).select("event_id", "value", "state")
    names = F.when(e % 5 == 0, "EDIT").when(e % 5 == 1, "MARK_BLANK").when(e % 5 == 2, "MARK_NOT_APPLICABLE").when(e % 5 == 3, "LEAVE_UNRESOLVED").otherwise("REJECT_DOCUMENT")
    a = B.bind(spark, d, "SELECT event_id FROM {events}").filter("event_id % 7 < 4").select(F.floor(e / 2).alias("event_id"), names.alias("action"), F.concat(F.lit("n"), e.cast("string")).alias("new_value"), (e % 3 != 0).alias("valid"), e.alias("seq"))
    return review.overlay(f, a, ["event_id"])


@query("WITH v AS (SELECT event_id, user_id, event_id * 31 % 17 AS unresolved FROM events) SELECT event_id, user_id, unresolved, LAG(unresolved) OVER w AS before, unresolved - LAG(unresolved) OVER w AS change FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def retry_delta(spark: SparkSession, d: str) -> DataFrame:
    return review.deltas(B.bind(spark, d, "SELECT event_id, user_id, event_id * 31 % 17 AS unresolved FROM {events}"), "user_id", "event_id", "unresolved")


_BUDGET = "SELECT CAST(user_id AS STRING) AS session, event_id AS call_id, ts, event_type || CAST(event_id % 4 AS STRING) AS fingerprint, (event_id % 9) / 1e3 AS cost_usd FROM {events}"


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, call_id) AS k FROM ({B.duck(_BUDGET)})),
r AS (SELECT session, k, call_id, 'ALLOW' AS decision, 1 AS n, cost_usd AS usd, [fingerprint] AS seen FROM o WHERE k = 1
  UNION ALL SELECT o.session, o.k, o.call_id, d, r.n + CASE WHEN d = 'ALLOW' THEN 1 ELSE 0 END, r.usd + CASE WHEN d = 'ALLOW' THEN o.cost_usd ELSE 0 END, CASE WHEN d = 'ALLOW' THEN list_append(r.seen, o.fingerprint) ELSE r.seen END
  FROM r JOIN o ON o.session = r.session AND o.k = r.k + 1, LATERAL (SELECT CASE WHEN list_contains(r.seen, o.fingerprint) THEN 'REUSED_CACHED_RESULT' WHEN r.n >= 5 THEN 'BLOCKED_CALL_COUNT' WHEN r.usd + o.cost_usd > 0.02 THEN 'BLOCKED_SESSION_BUDGET' ELSE 'ALLOW' END AS d) x)
SELECT session, call_id, decision, usd AS spent_usd FROM r""")
def budget_fold(spark: SparkSession, d: str) -> DataFrame:
    return stream.budget_fold(B.bind(spark, d, _BUDGET))
