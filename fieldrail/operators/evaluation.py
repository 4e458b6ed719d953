"""Expected against extracted fields, and the reports built on that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import ACCEPT, FLAG, HUMAN, TERMINAL
from ..functions.text import blank, same
from ..functions.typed import compared_value, ratio


def compare(expected: DataFrame, extracted: DataFrame, keys: list[str], name: str = "field_name") -> DataFrame:
    """expected ⟕ extracted with both values in compared form: correct, missing or incorrect."""
    e = expected.select(*keys, name, F.col("value").alias("expected"))
    x = extracted.select(*keys, name, F.col("value").alias("actual"))
    both = e.join(x, [*keys, name], "left")
    a, b = compared_value(F.col(name), F.col("expected")), compared_value(F.col(name), F.col("actual"))
    return both.withColumn("outcome", F.when(a == b, "correct").when(blank(F.col("actual")), "missing").otherwise("incorrect"))


def unexpected(expected: DataFrame, extracted: DataFrame, keys: list[str], name: str = "field_name") -> DataFrame:
    """Extracted values that aren't blank and that nothing expects."""
    return extracted.filter(~blank(F.col("value"))).join(expected.select(*keys, name).distinct(), [*keys, name], "left_anti")


def included(expected: Column, optional: Column, value: Column) -> Column:
    """Whether a field counts for accuracy."""
    return ~blank(expected) | ~optional | ~blank(value)


def correct(expected: Column, value: Column) -> Column:
    """An unexpected field is right only when it is blank."""
    return F.when(expected.isNull(), blank(value)).otherwise(same(expected, value))


def partition(state: Column, expected: Column, value: Column) -> Column:
    """TP, FP or FN: what a person must look at is missed even if it is right."""
    return F.when(state == HUMAN, "FN").when(same(expected, value), "TP").when(blank(value), "FN").otherwise("FP")


def precision_recall(rows: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    counts = [F.count_if(F.col(kind) == k).alias(k.lower()) for k in ("TP", "FP", "FN")]
    out = rows.groupBy(*(by or [])).agg(*counts)
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 8), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 8)})


def by_group(outcomes: DataFrame, groups: list[str]) -> DataFrame:
    """Overall and by each group alone: precision c / (c + i + fp), recall c / (c + i + m)."""
    n = {k: F.count_if(F.col("outcome") == k).alias(k) for k in ("correct", "incorrect", "missing", "false_positive")}
    out = outcomes.groupingSets([[], *([g] for g in groups)], *groups).agg(*n.values())
    c, i, m, fp = (F.col(k) for k in n)
    return out.withColumns({"precision": ratio(c, c + i + fp, 6), "recall": ratio(c, c + i + m, 6)})


def coverage(fields: DataFrame, by: str) -> DataFrame:
    """Shares of fields produced, validated, confident; null for documents of an unknown type."""
    c = F.col
    out = fields.groupBy(by).agg(
        F.count("*").alias("applicable"),
        F.count_if(~blank(c("value"))).alias("produced"),
        F.count_if(c("validated")).alias("validated"),
        F.count_if(c("confidence") >= 0.85).alias("high"),
        F.count_if((c("confidence") >= 0.60) & (c("confidence") < 0.85)).alias("medium"),
        F.count_if(c("confidence") < 0.60).alias("low"),
        F.count_if(c("critical")).alias("critical"),
        F.count_if(c("critical") & c("state").isin(*TERMINAL)).alias("critical_resolved"),
        F.max("known").alias("known"),
    )
    share = lambda x: F.when(c("known"), ratio(c(x), c("applicable"), 6))
    return out.withColumns({"produced_share": share("produced"), "validated_share": share("validated"), "critical_share": F.when(c("known"), ratio(c("critical_resolved"), c("critical"), 6))}).drop("known")


def document_status(failed: Column, human: Column, flagged: Column) -> Column:
    return F.when(failed, "FAILED").when(human > 0, "NEEDS_REVIEW").when(flagged > 0, "COMPLETED_WITH_FLAGS").otherwise("COMPLETED")


def funnel(fields: DataFrame, by: str, states: tuple[str, ...]) -> DataFrame:
    """Share of each state in percent, a column a state."""
    out = fields.groupBy(by).pivot("state", list(states)).agg(F.count(F.lit(1)))
    n = sum((F.coalesce(s, F.lit(0)) for s in states), F.lit(0))
    return out.select(by, n.cast("long").alias("fields"), *(ratio(100 * F.coalesce(s, F.lit(0)), n, 4).alias(s.lower()) for s in states))


def catch_rates(rows: DataFrame, by: str) -> DataFrame:
    """Of fields with rules: wrong ones that a rule stopped, right ones that one stopped, mean confidence."""
    own = rows.filter("has_validators")
    out = own.groupBy(by).agg(F.count_if(~F.col("correct")).alias("errors"), F.count_if(~F.col("correct") & F.col("flagged")).alias("caught"), F.count_if(F.col("correct")).alias("right"), F.count_if(F.col("correct") & F.col("flagged")).alias("alarms"), F.bround(F.avg(F.col("conf").cast("decimal(20,10)")).cast("double"), 4).alias("mean_conf"))
    return out.withColumns({"catch_rate": ratio(F.col("caught"), F.col("errors"), 4), "false_alarm_rate": ratio(F.col("alarms"), F.col("right"), 4)})


def per_tier(rows: DataFrame, tier: str, expected: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts and rates by tier and blended (tier null); blended only if every expected key is there."""
    c = F.col
    out = rows.groupingSets([[tier], []], tier).agg(
        F.count("*").alias("fields"),
        F.count_if(c("correct")).alias("correct_fields"),
        F.count_if(c("criticality") == "high").alias("critical_fields"),
        F.count_if((c("criticality") == "high") & c("correct")).alias("critical_correct"),
        F.count_if(c("state") == HUMAN).alias("human"),
        F.count_if(c("state") == FLAG).alias("flagged"),
        F.count_if(c("state").isin(ACCEPT, FLAG) & c("correct")).alias("automated_correct"),
    )
    rates = {"accuracy": ratio(c("correct_fields"), c("fields"), 8), "critical_accuracy": ratio(c("critical_correct"), c("critical_fields"), 8), "human_rate": ratio(c("human"), c("fields"), 8), "automated_rate": ratio(c("automated_correct"), c("fields"), 8)}
    out = out.withColumns(rates)
    if expected is None:
        return out
    missing = expected.select(*keys).distinct().join(rows.select(*keys).distinct(), keys, "left_anti").limit(1).agg(F.count("*").alias("missing"))
    return out.crossJoin(F.broadcast(missing)).filter(c(tier).isNotNull() | (c("missing") == 0)).drop("missing")


def arms(rows: DataFrame, arm_struct: str) -> DataFrame:
    """A struct of ablation arms as rows, aggregated by arm."""
    names = rows.schema[arm_struct].dataType.names
    one = rows.select("criticality", F.inline(F.array(*(F.struct(F.lit(n).alias("arm"), F.col(f"{arm_struct}.{n}.correct").alias("correct"), F.col(f"{arm_struct}.{n}.state").alias("state"), F.col(f"{arm_struct}.{n}.cost_usd").alias("cost_usd"), F.col(f"{arm_struct}.{n}.latency_ms").alias("latency_ms")) for n in names))))
    crit = F.col("criticality") == "high"
    out = one.groupBy("arm").agg(F.count("*").alias("fields"), F.count_if("correct").alias("right"), F.count_if(crit).alias("critical"), F.count_if(crit & F.col("correct")).alias("critical_right"), F.count_if(~F.col("state").isin(*TERMINAL)).alias("unresolved"), F.sum(F.col("cost_usd").cast("decimal(38,8)")).cast("double").alias("cost_usd"), F.bround(F.avg(F.col("latency_ms").cast("decimal(20,8)")).cast("double"), 4).alias("mean_latency_ms"))
    return out.withColumns({"accuracy": ratio(F.col("right"), F.col("fields"), 6), "critical_accuracy": ratio(F.col("critical_right"), F.col("critical"), 6)})


def uplift(rows: DataFrame, by: list[str], flag: str, value: str) -> DataFrame:
    """Mean of value without and with the flag, side by side, and the difference."""
    out = rows.groupBy(*by).pivot(flag, [False, True]).agg(F.avg(F.col(value).cast("decimal(20,8)")).cast("double"))
    out = out.withColumnsRenamed({"false": "without", "true": "with"})
    return out.withColumns({"without": F.bround("without", 6), "with": F.bround("with", 6)}).withColumn("gain", F.bround(F.col("with") - F.col("without"), 6))


def rescue(rows: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Fields that one engine missed and another had: (misses, rescued, rate)."""
    miss = rows.filter((F.col("engine") == first) & ~F.col("hit")).select(*keys)
    hit = rows.filter((F.col("engine") == second) & F.col("hit")).select(*keys).distinct().withColumn("saved", F.lit(1))
    out = miss.join(hit, keys, "left").agg(F.count("*").alias("misses"), F.coalesce(F.sum("saved"), F.lit(0)).alias("rescued"))
    return out.withColumn("rate", ratio(F.col("rescued"), F.col("misses"), 6))


def token_recall(truth: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The share of truth values found among the tokens of their page."""
    found = truth.join(tokens.select(*keys, F.col("token").alias("value")).distinct().withColumn("seen", F.lit(1)), [*keys, "value"], "left")
    return found.groupBy(*keys).agg(F.count("*").alias("values"), F.count("seen").alias("found")).withColumn("recall", ratio(F.col("found"), F.col("values"), 6))
