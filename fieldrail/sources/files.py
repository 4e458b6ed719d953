"""Files of a folder: format by content, role, duplicates, inventory counters, upload guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_reason, hash_id

# Fixed markers.
SPEC_MARKERS = ("NSF MATRIX", "NSF 320 SPEC", "UB92 FILE SPEC", "UB 92 FILE SPEC", "UB192 SPEC", "UB 192 SPEC", "FILE SPECIFICATION")
ATTACHMENT_TOKENS = ("attachment", "fax_cover", "fax-cover", "cover_sheet", "cover-sheet")
MOST_BYTES = 10 * 1024 * 1024


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, content) of all files below a folder; files without a byte have no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def _text(content: Column) -> Column:
    utf = F.try_validate_utf8(content.cast("string")) if hasattr(F, "try_validate_utf8") else content.cast("string")
    return F.regexp_replace(F.coalesce(utf, F.decode(content, "ISO-8859-1")), "^﻿", "")


def detect_format(content: Column) -> Column:
    """By magic bytes, else by line widths, else JSON object or text."""
    head = F.hex(F.substring(content, 1, 8))
    text = _text(content)
    widths = F.array_distinct(F.transform(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != ""), F.length))
    one = F.when(F.size(widths) == 1, widths[0])
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF")
        .when(F.hex(F.substring(content, 1, 1024)).contains("255044462D"), "PDF")
        .when(head.startswith("504B0304"), "ZIP")
        .when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "EMPTY")
        .when(one == 320, "NSF320")
        .when(one == 192, "UB192")
        .when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), "JSON")
        .otherwise("TEXT")
    )


def is_specification(name: Column, text: Column) -> Column:
    hay = F.regexp_replace(F.upper(F.concat(name, F.lit(" "), F.substring(text, 1, 4096))), "[^A-Z0-9]+", " ")
    return F.exists(F.array(*map(F.lit, SPEC_MARKERS)), lambda m: F.contains(hay, m))


def role(name: Column, kind: Column, content: Column) -> Column:
    attached = F.exists(F.array(*map(F.lit, ATTACHMENT_TOKENS)), lambda t: F.contains(F.lower(name), t))
    text = _text(content)
    has_fields = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.fields", "variant")).startswith("OBJECT")
    return (
        F.when(kind.isin("PNG", "JPEG", "TIFF", "PDF") & attached, "attachment")
        .when(kind.isin("PNG", "JPEG", "TIFF", "PDF"), "claim_document")
        .when(kind.isin("NSF320", "UB192"), "expected_output")
        .when((kind == "JSON") & F.coalesce(has_fields, F.lit(False)), "expected_output")
        .when((kind == "TEXT") & is_specification(name, text), "specification")
        .when(kind == "ZIP", "unsupported")
        .otherwise("unknown")
    )


def mark_duplicates(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """rows with id (12 hex digits of the content's sha256) and duplicate: not the first by order.

    The first is found by an aggregate, so copies of one content needn't meet in a task; rows that
    share the first place are all first.
    """
    marked = rows.withColumn("id", hash_id(key))
    first = marked.groupBy("id").agg(F.min(order).alias("_first"))
    return marked.join(first, "id").withColumn("duplicate", F.col(order) > F.col("_first")).drop("_first")


def inventory(files: DataFrame) -> DataFrame:
    """(path, name, id, format, role, size, status), duplicates marked and kept."""
    kind = files.withColumn("format", detect_format(F.col("content")))
    known = kind.withColumn("role", role(F.col("name"), F.col("format"), F.col("content")))
    marked = mark_duplicates(known, F.col("content"), "path")
    status = first_reason((F.col("duplicate"), "DUPLICATE"), (F.col("format") == "EMPTY", "EMPTY"), (F.col("role") == "unsupported", "UNSUPPORTED"), otherwise="READY")
    return marked.select("path", "name", "id", "format", "role", "size", status.alias("status"))


def inventory_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("READY", "DUPLICATE", "EMPTY", "UNSUPPORTED")), F.sum("size").alias("bytes"))


def folder_inventory(files: DataFrame, base: str = "", most_pages: int = 100) -> DataFrame:
    """(relative_path, grp, name, id, format, role, page_count, size, status, warning) of files below base; one row a file.

    files: path, content; optional: pages (as a decoder counted them; null: couldn't be decoded), readable, link.
    Of equal contents the first by case-folded path counts, the others are duplicates of it; empty files never are.
    Status: DUPLICATE over ERROR, UNSUPPORTED and UNKNOWN; READY otherwise. Links and unreadable files are told apart by
    their path, as there is no content.
    """
    c = F.col
    has = set(files.columns)
    flag = lambda name, default: F.coalesce(c(name), F.lit(default)) if name in has else F.lit(default)
    path = F.when(c("path").startswith(base), F.substr("path", F.lit(len(base) + 1))).otherwise(c("path")) if base else c("path")
    own = files.withColumns({"relative_path": F.regexp_replace(path, "^/+", ""), "_link": flag("link", False), "_read": flag("readable", True)})
    content = F.when(~c("_link") & c("_read"), F.coalesce("content", F.lit(b""))).otherwise(F.lit(b""))
    own = own.withColumns({"content": content, "name": F.element_at(F.split("relative_path", "/"), -1), "grp": F.coalesce(F.nullif(F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))})
    kind = F.when(c("_link"), "SYMLINK").when(~c("_read"), "UNREADABLE").otherwise(detect_format(c("content")))
    known = own.withColumn("format", kind).withColumn("role", F.when(c("_link"), "unsupported").when(~c("_read"), "unknown").otherwise(role(c("name"), c("format"), c("content"))))
    paged = c("role").isin("claim_document", "attachment")
    count = c("pages") if "pages" in has else F.lit(1)
    out = known.withColumns(
        {
            "id": hash_id(F.when(c("_link") | ~c("_read"), F.encode("relative_path", "UTF-8")).otherwise(c("content"))),
            "size": F.octet_length("content"),
            "page_count": F.when(paged & (count <= most_pages), count),
            "_order": F.struct(F.lower("relative_path").alias("a"), c("relative_path").alias("b")),
            "_why": first_reason(
                (c("_link"), "Symbolic links are not followed."),
                (~c("_read"), "File could not be read."),
                (paged & F.coalesce(count > most_pages, F.lit(False)), "pages"),
                (paged & F.coalesce(count < 1, F.lit(True)), "The document could not be decoded."),
                (c("role") == "unsupported", "format"),
                (c("role") == "unknown", "File role or content format is not recognized."),
                otherwise="",
            ),
        }
    )
    out = out.withColumn("_why", F.when(c("_why") == "pages", F.concat(F.lit(f"Document page limit is {most_pages}; received "), count.cast("string"), F.lit(" pages."))).when(c("_why") == "format", F.concat(F.lit("Detected "), c("format"), F.lit("; no decoder is available."))).otherwise(c("_why")))
    # copies of one content needn't meet: the first of each is an aggregate
    first = out.filter("size > 0").groupBy(c("id").alias("_id")).agg(F.min(F.struct("_order", "name")).alias("_first"))
    out = out.join(first, (c("id") == c("_id")) & (c("size") > 0), "left")
    copy = F.coalesce(c("_order") > c("_first._order"), F.lit(False))
    state = first_reason((copy, "DUPLICATE"), (c("_why") == "", "READY"), (~c("_link") & (~c("_read") | paged), "ERROR"), (c("role") == "unsupported", "UNSUPPORTED"), otherwise="UNKNOWN")
    warning = F.when(copy, F.concat(F.lit("Duplicate content; first seen as "), c("_first.name"), F.lit("."))).otherwise(c("_why"))
    return out.select("relative_path", "grp", "name", "id", "format", "role", "page_count", "size", state.alias("status"), warning.alias("warning"))


def scan_counters(inventory: DataFrame) -> DataFrame:
    """One row of a folder_inventory()'s counters; copies count as what they are, too."""
    c = F.col
    away = c("role").isin("unsupported", "unknown")
    error = (c("status") == "ERROR") | c("warning").startswith("Document page limit")
    n = lambda when, name: F.count_if(when).alias(name)
    return inventory.agg(F.count("*").alias("files_discovered"), n(~away & ~error, "supported_files"), n(away, "unsupported_files"), n(c("role") == "claim_document", "claim_documents"), n(c("role") == "expected_output", "expected_output_files"), n(c("role") == "specification", "specifications"), n(c("status") == "DUPLICATE", "duplicate_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def upload_refusal(attested: Column, name: Column, size: Column, kind: Column, pages: Column) -> Column:
    """The first rule that an upload breaks, or null."""
    out = first_reason(
        (~attested, "not attested as synthetic"),
        (~F.lower(name).rlike(r"\.(png|jpe?g|tiff?|pdf)$"), "extension"),
        (size == 0, "empty"),
        (size > MOST_BYTES, "too large"),
        (~kind.isin("PNG", "JPEG", "TIFF", "PDF"), "format"),
        (pages > 1, "more than one page"),
        otherwise="",
    )
    return F.nullif(out, F.lit(""))


def batch_id(mode: Column, ids: Column) -> Column:
    """Doesn't depend on the order of the items."""
    return F.concat(F.lit("batch-"), hash_id(F.concat(mode, F.lit("|"), F.array_join(F.array_sort(ids), ","))))
