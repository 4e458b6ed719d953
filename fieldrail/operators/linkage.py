"""Linking documents to records by rare anchors, with abstention; page selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CMS_MARKERS, compact, marker_score

LEAST_ANCHOR = 5
#: Classes of anchors: (least length, stride): texts give a gram at every stride-th place, and an anchor those at its first ``stride`` places.
CLASSES = ((LEAST_ANCHOR, 1), (20, 8), (48, 24))
#: Grams of anchors up to which tasks hold them all.
HELD_GRAMS = 1 << 20


def anchors(records: DataFrame, record: str, value: str) -> DataFrame:
    """(record, anchor, weight): compact values of five characters or more that aren't all zeros; 3 if one record has it, else 1."""
    rows = records.select(F.col(record).alias("record"), compact(F.col(value)).alias("anchor")).filter((F.length("anchor") >= LEAST_ANCHOR) & ~F.col("anchor").rlike("^0*$")).distinct()
    owners = rows.groupBy("anchor").agg(F.count("*").alias("owners"))
    return rows.join(owners, "anchor").select("record", "anchor", F.when(F.col("owners") == 1, 3).otherwise(1).alias("weight"))


def _grams(found: DataFrame, least: int, stride: int, most: int | None) -> DataFrame:
    """(gram, shift, record, anchor, weight) of the anchors of one class."""
    size = least - stride + 1
    own = found.filter(F.length("anchor") >= least)
    own = own.filter(F.length("anchor") < most) if most else own
    shifts = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(stride - 1))).alias("shift"))
    return shifts.select(F.xxhash64(F.substring(F.col("anchor").cast("binary"), F.col("shift") + 1, F.lit(size))).alias("gram"), "shift", "record", "anchor", "weight")


def anchor_hits(docs: DataFrame, found: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, record, score, hits) of documents that contain anchors.

    Whatever place a long anchor stands at, one of its first ``stride`` places is a multiple of the stride; so texts give hashed
    grams at these multiples only, and an anchor one for each shift. Grams that meet are compared with the text itself.
    Where the anchors' grams are few (counted first), tasks hold them and a text is looked through where it is. Otherwise narrow rows
    (document, place, gram) are joined, and only the places that met return to their texts.
    """
    hay = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), compact(F.col(text)).cast("binary").alias("hay"))
    tops = [*(least for least, _ in CLASSES[1:]), None]
    length = F.length("anchor")
    counts = found.agg(*(F.count_if((length >= least) & ((length < top) if top else F.lit(True))).alias(str(least)) for (least, _), top in zip(CLASSES, tops))).first()
    few = sum(counts[str(least)] * stride for least, stride in CLASSES) <= HELD_GRAMS
    pairs = None
    for (least, stride), top in zip(CLASSES, tops):
        if not counts[str(least)]:
            continue
        size, grams = least - stride + 1, _grams(found, least, stride, top)
        places = F.sequence(F.lit(1), F.octet_length("hay") - F.lit(size - 1), F.lit(stride))
        begin = F.col("place") - F.col("shift")
        there = (begin > 0) & (F.substring("hay", begin, F.octet_length("anchor")) == F.col("anchor").cast("binary"))
        long = hay.filter(F.octet_length("hay") >= size)
        if few:
            met = long.select("doc", "hay", F.explode(places).alias("place")).withColumn("gram", F.xxhash64(F.substring("hay", F.col("place"), F.lit(size))))
            own = met.join(F.broadcast(grams), "gram").filter(there)
        else:
            narrow = long.select("doc", F.explode(places).alias("place"), "hay").select("doc", "place", F.xxhash64(F.substring("hay", F.col("place"), F.lit(size))).alias("gram"))
            met = narrow.join(grams, "gram").filter(begin > 0).select("doc", "place", "shift", "record", "anchor", "weight")
            own = met.join(hay, "doc").filter(there)
        own = own.select("doc", "record", "anchor", "weight")
        pairs = own if pairs is None else pairs.unionByName(own)
    if pairs is None:
        return found.select(F.lit(None).cast(docs.schema[doc].dataType).alias("doc"), "record", F.col("weight").cast("long").alias("score"), F.lit(0).cast("long").alias("hits")).filter("false")
    return pairs.distinct().groupBy("doc", "record").agg(F.sum("weight").alias("score"), F.count("*").alias("hits"))


def link(docs: DataFrame, hits: DataFrame, doc: str) -> DataFrame:
    """(doc, status, record, score, margin, evidence): the unique winner, or ambiguous, or no_match."""
    order = Window.partitionBy("doc").orderBy(F.desc("score"), F.desc("hits"), F.desc("record"))
    ranked = hits.withColumn("k", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0)))
    best = ranked.filter("k = 1").withColumn("margin", F.col("score") - F.col("second"))
    out = docs.select(F.col(doc).alias("doc")).join(best, "doc", "left")
    status = F.when(F.col("score").isNull(), "no_match").when(F.col("margin") <= 0, "ambiguous").otherwise("deterministic")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc", status.alias("status"), F.when(status == "deterministic", F.col("record")).alias("record"), zero("score"), zero("margin"), F.coalesce("hits", F.lit(0)).cast("long").alias("evidence"))


def one_to_one(links: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Of documents of a group that claim one record the best by (score, margin) keeps it; the rest become ambiguous.

    Record numbers of different groups have nothing to do with each other.
    """
    keys = [*(group or []), "record"]
    rank = F.struct(-F.col("score"), -F.col("margin"), "doc")
    best = links.filter("status = 'deterministic'").groupBy(*keys).agg(F.min_by("doc", rank).alias("_best"))
    out = links.join(best, keys, "left")
    gone = (F.col("status") == "deterministic") & (F.col("doc") != F.col("_best"))
    return out.withColumns({"status": F.when(gone, "ambiguous").otherwise(F.col("status")), "record": F.when(~gone, F.col("record"))}).drop("_best").select(*links.columns)


def unique_best(rows: DataFrame, group: str, score: str, item: str, least: float) -> DataFrame:
    """(group, winner, top, winners): the one item with the top score if that reaches least; else null."""
    by = Window.partitionBy(group)
    top = rows.withColumn("top", F.max(score).over(by))
    out = top.groupBy(group).agg(F.max("top").alias("top"), F.count_if(F.col(score) == F.col("top")).alias("winners"), F.max(F.when(F.col(score) == F.col("top"), F.col(item))).alias("item"))
    return out.select(group, F.when((F.col("top") >= least) & (F.col("winners") == 1), F.col("item")).alias("winner"), "top", "winners")


def select_claim_page(pages: DataFrame, group: str, page: str, text: str) -> DataFrame:
    """The page with the most claim markers, at least two, if no other has as many."""
    return unique_best(pages.withColumn("markers", marker_score(F.col(text), CMS_MARKERS)), group, "markers", page, 2)


def route(scores: DataFrame, page: str, form: str, score: str, least: float = 0.75, margin: float = 0.05) -> DataFrame:
    """The best form of a page if it scores least and leads by margin."""
    order = Window.partitionBy(page).orderBy(F.desc(score), form)
    ranked = scores.withColumn("k", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead(score).over(order), F.lit(0.0)))
    best = ranked.filter("k = 1")
    sure = (F.col(score) >= least) & (F.col(score) - F.col("second") >= margin)
    return best.select(page, F.when(sure, F.col(form)).alias("routed"), F.col(score).alias("best"), "second")
