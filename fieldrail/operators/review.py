"""Human review: actions over fields, retry history, queue, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import HUMAN, OVERRIDE, TERMINAL
from ..functions.text import blank
from ..sources.spread import spread


def overlay(fields: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """fields after the last action on each: EDIT, MARK_BLANK, MARK_NOT_APPLICABLE, LEAVE_UNRESOLVED, REJECT_DOCUMENT."""
    last = actions.groupBy(*keys).agg(F.max_by(F.struct("action", "new_value", "valid"), "seq").alias("a"))
    out = fields.join(last, keys, "left")
    act, ok = F.col("a.action"), F.coalesce("a.valid", F.lit(False))
    edits = act.isin("EDIT", "MARK_BLANK")
    state = F.when(edits & ok, OVERRIDE).when(edits, HUMAN).when(act == "MARK_NOT_APPLICABLE", OVERRIDE).when(act.isin("LEAVE_UNRESOLVED", "REJECT_DOCUMENT"), HUMAN).otherwise(F.col("state"))
    value = F.when(act == "EDIT", F.col("a.new_value")).when(act.isin("MARK_BLANK", "MARK_NOT_APPLICABLE"), "").otherwise(F.col("value"))
    return out.withColumns({"value": value, "state": state, "action": act}).drop("a")


def deltas(versions: DataFrame, document: str, version: str, unresolved: str) -> DataFrame:
    """Each version with the unresolved fields before it and the change."""
    by = Window.partitionBy(document).orderBy(version)
    before = F.lag(unresolved).over(by)
    return versions.withColumn("before", before).withColumn("change", F.col(unresolved) - F.col("before"))


def queue(fields: DataFrame) -> DataFrame:
    """Fields that no one has resolved, most critical first."""
    weight = F.when(F.col("criticality") == "high", 0).when(F.col("criticality") == "med", 1).otherwise(2)
    return fields.filter(~F.col("state").isin(*TERMINAL)).orderBy(weight, "doc_id", "field_name")


def source_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The last attempt with the final value, else the last attempt."""
    order = F.struct((F.col("value") == F.col("final_value")).alias("m"), F.col("attempt_no").alias("n"))
    return attempts.groupBy(*keys).agg(F.max_by("engine", order).alias("engine"), F.max_by("attempt_no", order).alias("attempt_no"), F.min_by("value", F.when(F.col("rung") == "primary", F.col("attempt_no"))).alias("primary_value"))


def active_lines(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Service lines by how many of their three anchors pass: active from two on, blank with none."""
    n = F.count_if(F.col("verdict") == "PASS")
    return anchors.groupBy(*keys, "line_no").agg(n.alias("passed")).withColumns({"active": F.col("passed") >= 2, "blank": F.col("passed") == 0})


def blank_inactive_lines(fields: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """fields (keys, field_name, value, state) of service lines without any passing anchor are blanked and accepted as inapplicable."""
    number = F.regexp_extract("field_name", r"^line([0-9]+)_", 1).try_cast("int")
    by, n = [*keys, "_line"], spread(fields)
    off = lines.filter("blank").select(*keys, F.col("line_no").alias("_line"), F.lit(True).alias("_off")).repartition(n, *by)
    # fields of no line meet nothing; dealt by page and number, sides share as many tasks as there are fields for
    out = fields.withColumn("_line", number).repartition(n, *by).join(off, by, "left")
    gone = F.coalesce("_off", F.lit(False))
    return out.withColumns({"value": F.when(~gone, F.col("value")), "state": F.when(gone, "ACCEPT").otherwise(F.col("state")), "verdict": F.when(gone, "INAPPLICABLE")}).drop("_line", "_off")


# Fixed names and details of stamps that no rule of a field gives.
WORKSPACE_STAMPS = {
    "service_line_activation": "service line has no valid activation anchors",
    "template_blank_policy": "optional CMS-1500 value region is blank",
    "human_review": "",
}


def workspace_stamps(fields: DataFrame, stamps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field_name, validator, verdict, detail): stamps with what the workspace puts in their place.

    fields: keys, field_name, inactive (its service line), off (optional and blank), action (a reviewer's last one). What a field
    is marked as takes the place of all its rules' stamps: not applicable by a reviewer, else of an inactive line, else blank.
    """
    c, by = F.col, [*keys, "field_name"]
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    name = F.when(c("action") == "MARK_NOT_APPLICABLE", "human_review").when(flag("inactive"), "service_line_activation").when(flag("off"), "template_blank_policy")
    marked = fields.select(*by, name.alias("validator")).filter("validator IS NOT NULL")
    detail = F.element_at(F.create_map(*(F.lit(x) for pair in WORKSPACE_STAMPS.items() for x in pair)), c("validator"))
    own = marked.select(*by, "validator", F.lit("INAPPLICABLE").alias("verdict"), detail.alias("detail"))
    return stamps.select(*by, "validator", "verdict", "detail").join(marked.select(*by).distinct(), by, "left_anti").unionByName(own)


def eligible(external: Column, criticality: Column, paid: Column, optional: Column) -> Column:
    return external & F.array_contains(paid, criticality) & ~optional


def first_blankless(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The first value over a document's pages that isn't blank."""
    return pages.groupBy(*keys).agg(F.min_by("value", F.when(~blank(F.col("value")), F.col("page_no"))).alias("value"))
