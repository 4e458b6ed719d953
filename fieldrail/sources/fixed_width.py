"""Fixed-width claim files: 320-character and 192-character records as field and line tables.

Files come as (path, content); each file's rows are numbered and grouped into blocks by a
running sum over anchor rows.  A block without its patient row is skipped but keeps its
number, so ordinals may have gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import known
from ..functions.typed import person, record_money
from .scratch import put
from .spread import spread_rows

# Fixed layouts: field: record type and inclusive places, from 1.
NSF_FIELDS = {
    "patient_control_no": ("CA0", 6, 22),
    "patient_dob": ("CA0", 59, 66),
    "patient_sex": ("CA0", 67, 67),
    "patient_address": ("CA0", 69, 98),
    "patient_city": ("CA0", 129, 148),
    "patient_state": ("CA0", 149, 150),
    "patient_zip": ("CA0", 151, 159),
    "insurance_plan_name": ("DA0", 36, 68),
    "patient_relationship": ("DA0", 155, 156),
    "insured_id": ("DA0", 157, 181),
    "referring_npi": ("EA0", 140, 149),
    "admission_date": ("EA0", 150, 157),
    "diagnosis_1": ("EA0", 174, 180),
    "diagnosis_2": ("EA0", 181, 187),
    "diagnosis_3": ("EA0", 188, 194),
    "diagnosis_4": ("EA0", 195, 201),
    "federal_tax_id": ("BA0", 32, 40),
    "provider_npi": ("BA0", 48, 62),
    "provider_name": ("BA0", 165, 197),
    "patient_account_no": ("EA0", 6, 22),
}
NSF_NAMES = {"patient_name": ("CA0", (23, 42), (43, 54), (55, 55)), "insured_name": ("DA0", (182, 201), (202, 213), (214, 214))}
NSF_LINE = {"service_from": (40, 47), "service_to": (48, 55), "place_of_service": (56, 57), "procedure_code": (60, 64), "modifiers": (65, 70), "diagnosis_pointer": (78, 81)}
UB_FIELDS = {
    "federal_tax_no": ("10", 8, 17),
    "provider_name": ("10", 97, 121),
    "patient_control_no": ("20", 5, 24),
    "patient_sex": ("20", 55, 55),
    "patient_dob": ("20", 56, 63),
    "patient_address": ("20", 67, 122),
    "admission_date": ("20", 123, 130),
    "statement_from": ("20", 133, 140),
    "statement_to": ("20", 141, 148),
    "medical_record_no": ("20", 173, 189),
    "type_of_bill": ("40", 25, 27),
    "principal_dx": ("70", 25, 31),
    "attending_qualifier": ("80", 25, 26),
    "attending_identifier": ("80", 27, 42),
}
UB_NAMES = {"patient_name": ("20", (25, 44), (45, 53), (54, 54))}
# Slots of line records: revenue code, procedure code or none, units, charge.
UB_SLOTS = {
    "50": (((25, 28), None, (38, 41), (42, 51)), ((67, 70), None, (80, 83), (84, 93)), ((109, 112), None, (122, 125), (126, 135)), ((151, 154), None, (164, 167), (168, 177))),
    "60": (((25, 28), (29, 33), (38, 44), (45, 54)), ((81, 84), (85, 89), (94, 100), (101, 110)), ((137, 140), (141, 145), (150, 156), (157, 166))),
    "61": (((25, 28), (29, 33), (38, 44), (51, 60)), ((81, 84), (85, 89), (94, 100), (107, 116)), ((137, 140), (141, 145), (150, 156), (163, 172))),
}
FORMATS = {"NSF320": (320, "BA0", "CA0", 3), "UB192": (192, "10", "20", 2)}


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, row_no, row) of Latin-1 files."""
    text = F.regexp_replace(F.decode(F.col(content), "ISO-8859-1"), r"(?:\r\n|\r|\n)\z", "")
    return files.select("path", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("row_no", "row"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of anchor rows of their split up to themselves; a task gets its splits one after the other."""
    before, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        path, split, anchor = (batch.column(n) for n in ("path", "split", "anchor"))
        code, begin = path.dictionary_encode().indices.to_numpy(), split.to_numpy()
        starts = np.flatnonzero((np.diff(code) != 0) | (np.diff(begin) != 0)) + 1
        own, local = anchor.to_numpy(zero_copy_only=False), np.empty(batch.num_rows, np.int64)
        for i, j in zip((0, *starts), (*starts, batch.num_rows)):
            here = (path[int(i)].as_py(), int(begin[i]))
            local[i:j] = np.cumsum(own[i:j]) + (count if here == before else 0)
            before, count = here, int(local[j - 1])
        yield pa.RecordBatch.from_arrays([path, split, batch.column("n"), batch.column("row"), pa.array(local)], names=["path", "split", "n", "row", "local"])


def read_blocks(spark: SparkSession, path: str, kind: str, name: str = "") -> DataFrame:
    """(path, row_no, row, ordinal, tag) of large files, what blocks() makes of lines(), read in splits and dealt by block.

    Each split's rows are numbered by themselves where they are read; ordinals add the anchor rows of the splits before, of
    which a written table has one number each. Rows before a split's first anchor go on with the last block of the split
    before. The files are read twice, no task takes a whole one, and rows are shuffled once, by their block. Files
    with a row of another width are left out. name: a pattern whose first group names a file by its path.
    """
    width, anchor, _, tag = FORMATS[kind]
    meta = F.col("_metadata")
    file = F.regexp_extract(meta["file_path"], name, 1) if name else meta["file_path"]
    row = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    text = spark.read.text(path).select(file.alias("path"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("n"), row.alias("row")).withColumn("anchor", F.col("row").startswith(anchor))
    splits = put(text.groupBy("path", "split").agg(F.count_if("anchor").alias("anchors"), F.count_if(F.length("row") != width).alias("bad"), F.count("*").alias("rows")), "splits")
    whole, before = Window.partitionBy("path"), Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("path", "split", F.coalesce(F.sum("anchors").over(before), F.lit(0)).alias("offset"), F.sum("bad").over(whole).alias("bad"))
    numbered = text.mapInArrow(_running, "path string, split long, n long, row string, local long").join(F.broadcast(offsets), ["path", "split"], "left")
    # a split that the first reading didn't have would have no number
    offset = F.coalesce("offset", F.raise_error(F.lit("the files' splits changed between two readings")).cast("long"))
    # splits of a file come in the order of their begins, and so do numbers of rows
    place = F.struct("split", "n")
    found = numbered.withColumn("ordinal", offset + F.col("local")).filter("bad = 0 AND ordinal > 0").select("path", place.alias("row_no"), "row", "ordinal", F.substring("row", 1, tag).alias("tag"))
    n = splits.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return found.repartition(spread_rows(found, n), "path", "ordinal")


def bad_widths(rows: DataFrame, kind: str) -> DataFrame:
    """(path, widths): files with a row of another width than the format's."""
    width = FORMATS[kind][0]
    return rows.filter(F.length("row") != width).groupBy("path").agg(F.array_sort(F.collect_set(F.length("row"))).alias("widths"))


def _at(row: Column, a: int, b: int) -> Column:
    return F.trim(F.coalesce(F.substring(row, a, b - a + 1), F.lit("")))


def blocks(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with their block's ordinal and record type; of files whose rows all have the right width."""
    width, anchor, _, tag = FORMATS[kind]
    sound = rows.join(bad_widths(rows, kind), "path", "left_anti")
    run = Window.partitionBy("path").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = sound.withColumn("ordinal", F.sum(F.col("row").startswith(anchor).cast("int")).over(run))
    return numbered.filter("ordinal > 0").withColumn("tag", F.substring("row", 1, tag))


def records(rows: DataFrame, kind: str) -> DataFrame:
    """(path, ordinal, format_name, field_name, value): the first row of each record type counts; rows of lines() or read_blocks()."""
    patient = FORMATS[kind][2]
    tagged = rows if "ordinal" in rows.columns else blocks(rows, kind)
    fields, names = (NSF_FIELDS, NSF_NAMES) if kind == "NSF320" else (UB_FIELDS, UB_NAMES)
    tags = sorted({t for t, *_ in fields.values()} | {"XA0" if kind == "NSF320" else "90"})
    first = tagged.filter(F.col("tag").isin(*tags, patient)).groupBy("path", "ordinal").agg(*(F.min_by(F.when(F.col("tag") == t, F.col("row")), F.when(F.col("tag") == t, F.col("row_no"))).alias(f"r{t}") for t in tags))
    claims = first.filter(F.col(f"r{patient}").isNotNull())
    values = {n: _at(F.col(f"r{t}"), a, b) for n, (t, a, b) in fields.items()}
    values |= {n: person(*(_at(F.col(f"r{t}"), a, b) for a, b in parts)) for n, (t, *parts) in names.items()}
    if kind == "NSF320":
        values["total_charge"] = record_money(_at(F.col("rXA0"), 78, 84))
    else:
        both = [F.coalesce(known(record_money(_at(F.col("r90"), a, b))).try_cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)")) for a, b in ((43, 52), (63, 72))]
        values["total_charges"] = (both[0] + both[1]).cast("decimal(28,2)").cast("string")
    pairs = F.array(*(F.struct(F.lit(n).alias("field_name"), v.alias("value")) for n, v in values.items()))
    return claims.select("path", "ordinal", F.lit(kind).alias("format_name"), F.inline(pairs))


def service_lines(rows: DataFrame, kind: str) -> DataFrame:
    """(path, ordinal, line_no, field_name, value) of the repeating records, in record, row and slot order."""
    patient = FORMATS[kind][2]
    tagged = rows if "ordinal" in rows.columns else blocks(rows, kind)
    pairs = lambda values: F.array(*(F.struct(F.lit(n).alias("field_name"), v.alias("value")) for n, v in values.items()))
    if kind == "NSF320":
        slots = F.array(pairs({n: _at(F.col("row"), a, b) for n, (a, b) in NSF_LINE.items()} | {"charge": record_money(_at(F.col("row"), 71, 77)), "units": record_money(_at(F.col("row"), 82, 85), 1)}))
        repeating, held = ("FA0",), F.lit(1)
    else:
        slots, held, repeating = F.lit(None), F.lit(0), tuple(UB_SLOTS)
        for tag, specs in UB_SLOTS.items():
            made = []
            for revenue, code, units, charge in specs:
                made.append(pairs({"revenue_code": _at(F.col("row"), *revenue), "procedure_code": _at(F.col("row"), *code) if code else F.lit(""), "units": _at(F.col("row"), *units), "charge": record_money(_at(F.col("row"), *charge))}))
            slots = F.when(F.col("tag") == tag, F.array(*made)).otherwise(slots)
            held = F.when(F.col("tag") == tag, sum(((_at(F.col("row"), *revenue) != "").cast("int") for revenue, *_ in specs), F.lit(0))).otherwise(held)
        slots = F.filter(slots, lambda x: x[0]["value"] != "")
    # rows are numbered by how many slots the rows before them hold, and taken apart after that
    block = Window.partitionBy("path", "ordinal")
    before = block.orderBy("tag", "row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = tagged.filter(F.col("tag").isin(*repeating, patient)).withColumn("_held", F.when(F.col("tag") != patient, held).otherwise(0))
    rows = rows.withColumns({"_before": F.coalesce(F.sum("_held").over(before), F.lit(0)), "_claim": F.max(F.col("tag") == patient).over(block)})
    one = rows.filter(F.col("_claim") & (F.col("tag") != patient)).select("path", "ordinal", "_before", F.posexplode(slots).alias("slot", "items"))
    return one.select("path", "ordinal", (F.col("_before") + F.col("slot") + 1).cast("int").alias("line_no"), F.inline("items"))
