"""How document filters overlap: every order of five filters from one pass over the texts.

1. A text's failures become a mask, one bit a filter.  Filter E (the text stands in a document of
   a smaller id) needs the smallest id of each text: rows are first counted by digest,
   part and labels, so a text that a third of all rows share is a few rows by then.
2. Masks are counted by part: all rows, rows of quality 1, toxic rows.
3. These histograms, stacked as rows of 32 masks, are multiplied by integer matrices of
   32 masks by 600 (order, step) columns, one each for what is kept, removed, redundant and
   only failed here.  Each part is a few rows of such products; nothing is collected.

Defined results: null text is an empty one, which has no words and so fails A only (and E, where a smaller id has one);
null part is ''; a null id has no labels, never fails E and makes nobody fail it; several labels of an id
count as the largest; rows of one id and one text don't fail E for each other; repeated rows
count each; an empty table has no parts and gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
_KINDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def steps(filters: str = FILTERS) -> list[tuple[str, int]]:
    """(order, step from 0) of the columns."""
    return [("".join(p), s) for p in permutations(filters) for s in range(len(filters))]


def incidence(filters: str = FILTERS) -> dict[str, np.ndarray]:
    """0/1 matrices, a row each mask and a column each (order, step)."""
    masks = np.arange(1 << len(filters))[:, None]
    bit = {f: 1 << k for k, f in enumerate(filters)}
    own = np.array([bit[o[s]] for o, s in steps(filters)])
    before = np.array([sum(bit[f] for f in o[:s]) for o, s in steps(filters)])
    fails, gone = (masks & own) != 0, (masks & before) != 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == own}
    return {name: matrix.astype(np.int64) for name, matrix in found.items()}


def text_failures(text: F.Column) -> F.Column:
    """The mask of filters A to D: few words, repeated words, capitals, signs."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))


def masks_by_part(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows, rows of quality 1 and toxic rows with that mask."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = slim.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("id is not null")
    known = known.groupBy("id").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    flag = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    held = rows.filter("id is not null").join(known, "id", "left").select("id", "part", "mask", "digest", "n", *flag)
    # what differs in id only is one row: how many rows there are, the smallest id and how many rows it has
    alike = held.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("at_low"))
    first = F.when(F.col("low") == F.min("low").over(Window.partitionBy("digest")), F.col("at_low")).otherwise(F.lit(0))
    alike = alike.withColumn("first", first)
    e = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(e)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    judged = alike.select("part", "good", "toxic", F.inline(both))
    judged = judged.unionByName(rows.filter("id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    sums = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic"))]
    return judged.filter("n > 0").groupBy("part", "mask").agg(*sums)


def outcomes(histograms: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """Every count by (part, column) of (part, 3, mask) histograms: all, good and toxic rows."""
    parts, kinds, masks = histograms.shape
    stacked = histograms.reshape(parts * kinds, masks)
    made = {name: (stacked @ matrix).reshape(parts, kinds, -1) for name, matrix in incidence(filters).items()}
    out = {name: made[name][:, 0] for name in ("kept", "removed", "redundant", "unique_fails")}
    out |= {"good_lost": made["removed"][:, 1], "toxic_lost": made["removed"][:, 2]}
    letter = np.array([filters.index(o[s]) for o, s in steps(filters)])
    same = (letter[:, None] == letter[None, :]).astype(np.int64)
    return out | {"shapley": out["removed"] @ same}


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, counts): all orders of all parts of (part, mask, n, good, toxic)."""
    columns = steps(filters)
    # at most one entry a mask
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, places = pa.array([o for o, _ in columns]), pa.array([s + 1 for _, s in columns], pa.int32())
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                counts = np.zeros((some.num_rows, 3, 1 << len(filters)), np.int64)
                for i, held in enumerate(some.column(1).to_pylist()):
                    for x in held:
                        counts[i, :, x["mask"]] = x["n"], x["good"], x["toxic"]
                found = outcomes(counts, filters)
                for i, part in enumerate(some.column(0).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns), pa.string()), orders, places, *(pa.array(found[k][i]) for k in _KINDS)], ["part", "filter_order", "step", *_KINDS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in _KINDS))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """All orders of the five filters over the whole texts of docs, by part."""
    return audit(masks_by_part(docs, labels, id_col, text_col, part_col))
