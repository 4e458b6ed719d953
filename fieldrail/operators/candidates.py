"""Retry candidates: generation by field family, de-duplication, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.typed import compared_value, digits, family
from ..sources.spread import spread


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _windows(text: Column, size: int) -> Column:
    def windows(text: Column) -> Column:
        n = F.length(text) - (size - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return let(text, windows)


def generate(name: Column, texts: Column) -> Column:
    """Array of candidate values of a field from its spans' texts, in order of preference, blanks left out."""
    spans = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != "")
    return let(spans, lambda spans: let(F.struct(F.array_join(spans, " ").alias("joined"), family(name).alias("kind")), lambda x: _generate(name, spans, x["joined"], x["kind"])))


def _generate(name: Column, spans: Column, joined: Column, kind: Column) -> Column:
    none = F.array().cast("array<string>")
    runs = F.transform(spans, digits)
    groups = _all(F.replace(joined, F.lit(","), F.lit("")), r"\d+")
    money = let(groups, lambda g: F.when(F.size(g) >= 2, F.concat(g[0], F.lit("."), F.right(F.element_at(g, -1), F.lit(2)))).when(F.size(g) == 1, F.concat(g[0], F.lit(".00"))))
    quantity = F.when(digits(joined) != "", digits(joined)).when(F.upper(joined).contains("T"), "1")
    upper = F.upper(joined)
    extra = (
        F.when(kind == "date", F.filter(F.concat(runs, F.array(F.array_join(runs, ""))), lambda d: F.length(d).isin(6, 8)))
        .when(kind == "quantity", F.array(quantity))
        .when(name.endswith("provider_npi"), _windows(digits(joined), 10))
        .when(name == "federal_tax_id", _windows(digits(joined), 9))
        .when(name.startswith("diagnosis_code_") | (name == "principal_dx"), _all(upper, r"[A-TV-Z]\d[0-9A-Z](?:\.[0-9A-Z]{1,4})?"))
        .when(name.endswith("_cpt_code"), _all(joined, r"(?<!\d)\d{5}(?!\d)"))
        .when(name == "insured_id", _all(upper, r"\b[A-Z0-9]{6,15}\b"))
        .when(kind == "code", _all(upper, r"\b[A-Z0-9]{1,10}\b"))
        .otherwise(none)
    )
    first = F.when(kind == "money", F.array_compact(F.array(money))).otherwise(none)
    return F.filter(F.transform(F.array_compact(F.concat(first, spans, F.array(joined), extra)), lambda v: F.trim(v)), lambda v: v != "")


def explode(rows: DataFrame, name: str, texts: str, keys: list[str]) -> DataFrame:
    """(keys, name, candidate_no, value, key): the first candidate of each compared form.

    Texts are dealt by keys before candidates are made of them, so that candidates of one field already share a task.
    """
    c = F.col
    dealt = rows.select(*keys, name, texts).repartition(spread(rows), *(keys or [name]))
    one = dealt.select(*keys, name, F.posexplode(generate(c(name), c(texts))).alias("candidate_no", "value"))
    return first_seen(one.withColumn("key", compared_value(c(name), c("value"))).filter("key != ''"), [*keys, name], "key", "candidate_no")


def first_seen(rows: DataFrame, group: list[str], key: str, order: str) -> DataFrame:
    by = Window.partitionBy(*group, key).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")


def rank(rows: DataFrame, group: list[str]) -> DataFrame:
    """The best candidate of each group: fewest failures, most passes, agreement, confidence, earliest attempt; then the first."""
    agree = rows.withColumn("agreement", F.count("*").over(Window.partitionBy(*group, "key")))
    order = Window.partitionBy(*group).orderBy("failures", F.desc("passes"), F.desc("agreement"), F.desc("confidence"), "attempt_index", "candidate_no")
    return agree.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def should_stop(confidence: Column, least: Column, n_stamps: Column, failures: Column) -> Column:
    return (confidence >= least) & (n_stamps > 0) & (failures == 0)


def mark(rows: DataFrame, group: list[str], fill: str, option: str, margin: float = 0.03) -> DataFrame:
    """The darkest option of a checkbox if it leads by the margin, with its confidence."""
    order = Window.partitionBy(*group).orderBy(F.desc(fill), option)
    top = rows.withColumn("second", F.coalesce(F.lead(fill).over(order), F.lit(0.0))).withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    lead = F.col(fill) - F.col("second")
    return top.select(*group, F.when(lead >= margin, F.col(option)).alias("marked"), F.when(lead >= margin, F.least(F.lit(0.99), 0.70 + lead)).alias("confidence"))
