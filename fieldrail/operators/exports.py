"""What leaves: public views, CSV rows with a summary, writers; template building and folder checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decisions import ACCEPT, HUMAN
from ..functions.text import blank

# Fixed names: the summary row, and the columns of both files.
SUMMARY = "__DOCUMENT_SUMMARY__"
DOCUMENT_COLUMNS = ("page", "field_name", "value", "state", "confidence", "cost_usd", "criticality")
BATCH_COLUMNS = ("batch_job_id", "safe_source_id", "source_file", "source_format", "processing_status", "document_type", "page_count", "unresolved_fields", "measured_cost_usd", "projected_cost_usd", "latency_ms", "accuracy", "warning", "applicable_fields", "fields_produced", "validated_fields")


def _public(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if not f.name.startswith("_")]
        return F.when(value.isNotNull(), F.struct(*(_public(value[f.name], f.dataType).alias(f.name) for f in kept)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _public(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.transform_values(F.map_filter(value, lambda k, _: ~k.startswith("_")), lambda _, v: _public(v, kind.valueType))
    return value


def public_view(rows: DataFrame) -> DataFrame:
    """rows without what begins with an underscore: columns, fields of structs and keys of maps, at any depth."""
    return rows.select(*(_public(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields if not f.name.startswith("_")))


def result_view(receipts: DataFrame) -> DataFrame:
    """What a customer gets of a field."""
    return receipts.select("doc", "field", "value", "decision", "confidence")


def audit_view(receipts: DataFrame) -> DataFrame:
    """How a field came about, without its values."""
    return receipts.select(*(c for c in receipts.columns if c != "value" and not c.endswith("_candidate")))


def document_rows(fields: DataFrame, coverage: DataFrame, dashboard: DataFrame) -> DataFrame:
    """Rows of a document's CSV: its fields, then one summary with both reports (one row each) as JSON."""
    last = coverage.select(F.to_json(F.struct("*")).alias("coverage_json")).crossJoin(dashboard.select(F.to_json(F.struct("*")).alias("cost_dashboard_json")))
    last = last.withColumn("field_name", F.lit(SUMMARY)).withColumn("_last", F.lit(1))
    return fields.select(*DOCUMENT_COLUMNS).withColumn("_last", F.lit(0)).unionByName(last, allowMissingColumns=True).orderBy("_last", "page", "field_name").drop("_last")


def batch_rows(documents: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows of a batch's CSV: its documents, each with the batch's summary (one row) as JSON."""
    one = summary.select(F.to_json(F.struct("*")).alias("summary_json"))
    return documents.select(*BATCH_COLUMNS).crossJoin(F.broadcast(one))


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; nested values must be JSON by now."""
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    public_view(rows).write.mode("overwrite").json(path)


def group_layout(files: DataFrame) -> DataFrame:
    """(grp, images, outputs, sound) of paths ``.../group/name``: a group has exactly one .txt."""
    parts = F.split("path", "/")
    text = F.lower(F.element_at(parts, -1)).endswith(".txt")
    out = files.groupBy(F.element_at(parts, -2).alias("grp")).agg(F.count_if(~text).alias("images"), F.count_if(text).alias("outputs"))
    return out.withColumn("sound", F.col("outputs") == 1)


def build_template(boxes: DataFrame, stale: int = 20) -> DataFrame:
    """(form, variant, field_name, box, seed): each field's box of the first seed that shows it.

    Rendered pages are looked at in the order of seeds; once ``stale`` of a variant's pages in a row
    show no new field the rest isn't looked at.  boxes: form, variant, seed, field_name, box.
    """
    first = boxes.groupBy("form", "variant", "field_name").agg(F.min("seed").alias("seed"), F.min_by("box", "seed").alias("box"))
    # pages are few hundred a variant: their numbers, and those of them that show a new field
    pages = boxes.groupBy("form", "variant").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
    grown = first.groupBy("form", "variant").agg(F.array_sort(F.collect_set("seed")).alias("grown"))
    place = F.transform("grown", lambda s: F.array_position("seeds", s))
    gaps = F.transform(F.sequence(F.lit(1), F.size("place")), lambda i: F.col("place")[i - 1] - F.when(i == 1, 0).otherwise(F.get("place", i - 2)))
    stop = F.array_position(F.transform("gaps", lambda g: g > stale), True)
    cut = pages.join(grown, ["form", "variant"]).withColumn("place", place).withColumn("gaps", gaps)
    cut = cut.select("form", "variant", F.when(stop > 0, F.get("grown", (stop - 1).cast("int"))).alias("until"))
    return first.join(cut, ["form", "variant"]).filter(F.col("until").isNull() | (F.col("seed") < F.col("until"))).drop("until")


def apply_candidates(fields: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """fields with a model's candidates: taken if it isn't blank, no rule fails and its receipt accepts it, else for a person.

    answers: keys, candidate, fails (rules that fail), rules (rules that ran), outcome, answer_confidence, calls, usd.
    """
    c = F.col
    out = fields.join(answers, keys, "left")
    asked = c("outcome").isNotNull()
    took = F.coalesce(~blank(c("candidate")) & (c("rules") > 0) & (c("fails") == 0) & (c("outcome") == "ACCEPTED"), F.lit(False))
    called = F.coalesce(c("calls"), F.lit(0))
    new = {
        "value": F.when(took, c("candidate")).otherwise(c("value")),
        "confidence": F.when(took, c("answer_confidence")).otherwise(c("confidence")),
        "state": F.when(took, ACCEPT).when(asked, HUMAN).otherwise(c("state")),
        "workflow": F.when(took, "MULTIMODAL_ATTEMPTED").when(asked, "MULTIMODAL_FAILED"),
        "external_calls": called,
        "failed_calls": F.when(took, 0).otherwise(F.when(called > 0, 1).otherwise(0)),
        "measured_usd": F.coalesce(c("usd"), F.lit(0.0)),
    }
    return out.withColumns(new).drop("candidate", "fails", "rules", "outcome", "answer_confidence", "calls", "usd")
