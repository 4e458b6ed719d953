"""Threshold sweeps over recorded decisions, the accuracy-cost frontier, failure analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.typed import ratio

# Fixed grid: 5 x 4 x 3 x 2 points.
LOCAL = (0.80, 0.84, 0.88, 0.92, 0.95)
MODEL = (0.88, 0.90, 0.92, 0.95)
PAID = (("high",), ("high", "med"), ("high", "med", "low"))
RESOLUTIONS = ("better_local_crop_strategy", "field_specific_ocr_mode", "deterministic_normalization", "validator_correction", "multimodal_escalation", "human_review_only", "governor_threshold_calibration")


def grid(spark: SparkSession) -> DataFrame:
    """(point_id, local_step, model_step, paid, flags): a fixed number of rows; steps count the thresholds up to the point's."""
    rows = [(f"local-{a:.2f}_model-{m:.2f}_paid-{'-'.join(p)}_flags-{'on' if f else 'off'}", i, j, list(p), f) for i, a in enumerate(LOCAL, 1) for j, m in enumerate(MODEL, 1) for p in PAID for f in (False, True)]
    return spark.createDataFrame(rows, "point_id string, local_step int, model_step int, paid array<string>, flags boolean")


def steps(confidence: Column, thresholds: tuple[float, ...]) -> Column:
    """How many of the ascending thresholds a confidence reaches."""
    return sum((F.coalesce(confidence >= t, F.lit(False)).cast("int") for t in thresholds), F.lit(0))


def simulate(rows: DataFrame, pages: DataFrame, points: DataFrame) -> DataFrame:
    """Every point replayed over the cohort; fields outside of it enter as constants.

    rows: criticality, optional, external, local_conf, local_valid, local_correct, retried,
    model_conf, model_usable, model_correct, recorded_correct, projected_usd.
    pages: total_fields, correct_fields, critical_fields, critical_correct, local_usd.
    Rows that every point treats alike are counted first: what a point asks of a row are flags and
    how many thresholds its confidences reach, some thousand groups whatever the cohort's size.
    Only these groups meet the points.
    """
    c = F.col
    alike = ["criticality", "optional", "external", "local_valid", "local_correct", "retried", "model_usable", "model_correct"]
    banded = rows.withColumns({"local_band": steps(c("local_conf"), LOCAL), "model_band": steps(c("model_conf"), MODEL)})
    groups = banded.groupBy(*alike, "local_band", "model_band").agg(F.count("*").alias("n"), F.sum(c("projected_usd").cast("decimal(28,8)")).alias("usd"))
    local = c("local_valid") & (c("local_band") >= c("local_step"))
    eligible = F.array_contains("paid", c("criticality")) & c("external") & ~c("optional") & c("retried")
    called = ~local & eligible
    usable = called & c("model_usable") & (c("model_band") >= c("model_step"))
    flagged = ~local & ~usable & c("flags") & c("criticality").isin("low", "med") & c("local_valid")
    state = F.when(local | usable, "ACCEPT").when(flagged, "ACCEPT_WITH_FLAG").otherwise("HUMAN_REVIEW")
    decided = groups.crossJoin(F.broadcast(points)).withColumns({"called": called, "state": state, "right": F.when(usable, c("model_correct")).otherwise(c("local_correct"))})
    crit = c("criticality") == "high"
    n = lambda when: F.coalesce(F.sum(F.when(when, c("n"))), F.lit(0))
    per = decided.groupBy("point_id").agg(
        F.sum("n").alias("cohort"),
        n(c("called")).alias("escalated"),
        n(c("state") == "HUMAN_REVIEW").alias("human"),
        n(c("state") == "ACCEPT_WITH_FLAG").alias("flagged"),
        n(c("right")).alias("row_correct"),
        n(crit).alias("crit"),
        n(crit & c("right")).alias("crit_correct"),
        n(c("right") & (c("state") != "HUMAN_REVIEW")).alias("terminal_correct"),
        F.coalesce(F.sum(F.when(c("called"), c("usd"))), F.lit(0)).cast("double").alias("api_usd"),
    )
    fixed = rows.agg(F.count_if("recorded_correct").alias("was"), F.count_if(crit).alias("crit_rows"), F.count_if(crit & c("recorded_correct")).alias("crit_was"))
    whole = pages.agg(F.count("*").alias("n_pages"), F.sum("total_fields").alias("total"), F.sum("correct_fields").alias("ok"), F.sum("critical_fields").alias("crit_total"), F.sum("critical_correct").alias("crit_ok"), F.sum(c("local_usd").cast("decimal(38,8)")).cast("double").alias("local_usd"))
    one = whole.crossJoin(fixed)
    out = per.crossJoin(F.broadcast(one))
    right = c("ok") - c("was") + c("row_correct")
    return out.select(
        "point_id",
        right.alias("correct_fields"),
        ratio(right, c("total"), 6).alias("field_accuracy"),
        ratio(c("crit_ok") - c("crit_was") + c("crit_correct"), c("crit_total") - c("crit_rows") + c("crit"), 6).alias("critical_field_accuracy"),
        "escalated",
        "human",
        ratio(c("human"), c("total"), 6).alias("human_review_rate"),
        "flagged",
        (c("ok") - c("was") + c("terminal_correct")).alias("automated_correct"),
        ratio(c("local_usd") + c("api_usd"), c("n_pages"), 6).alias("cost_per_page_usd"),
    )


def frontier(points: DataFrame) -> DataFrame:
    """Points that no cheaper one reaches in accuracy; a fixed number of points, so one window holds them."""
    order = Window.orderBy("cost_per_page_usd", F.desc("field_accuracy"), "human_review_rate", "point_id").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("before", F.max("field_accuracy").over(order)).filter(F.col("field_accuracy") > F.coalesce("before", F.lit(-1.0))).drop("before")


def recommend(points: DataFrame, least_critical: float = 0.995) -> DataFrame:
    """The cheapest point within a thousandth of the best accuracy, paid for high and medium, with flags."""
    able = points.filter(F.col("point_id").contains("paid-high-med_") & F.col("point_id").endswith("flags-on") & (F.col("critical_field_accuracy") >= least_critical))
    best = able.agg(F.max("field_accuracy").alias("best"))
    return able.crossJoin(F.broadcast(best)).filter(F.col("field_accuracy") >= F.col("best") - 0.001).drop("best").orderBy("cost_per_page_usd", "human_review_rate", "point_id").limit(1)


def histograms(failures: DataFrame, dimensions: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """(dimension, value, n) of each dimension by itself: rows are grouped by all of them once, and only groups unfold.

    derived: dimensions that follow from others, by name.
    """
    groups = failures.groupBy(*dimensions).agg(F.count("*").alias("n")).withColumns(derived or {})
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in [*dimensions, *(derived or {})]))
    return groups.select(F.inline(pairs), "n").groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def clusters(failures: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    return failures.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(k)


def resolution_counts(failures: DataFrame) -> DataFrame:
    """A row for each way out, those without failures too."""
    names = failures.sparkSession.createDataFrame([(r,) for r in RESOLUTIONS], "resolution string")
    return names.join(failures.groupBy("resolution").agg(F.count("*").alias("n")), "resolution", "left").select("resolution", F.coalesce("n", F.lit(0)).alias("n"))
