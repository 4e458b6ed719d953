"""Spans and template regions: overlap and centre joins, reading order, box geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = 8.0


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def resolve(template: DataFrame, extent: tuple[float, float, float, float], pad: float = PAD, page: tuple[float, float] | None = None) -> DataFrame:
    """Template fractions as page boxes, padded, and within a page of the given width and height."""
    x0, y0, x1, y1 = extent
    w, h = x1 - x0, y1 - y0
    out = template.withColumns({"fx0": x0 + F.col("x0") * w - pad, "fy0": y0 + F.col("y0") * h - pad, "fx1": x0 + F.col("x1") * w + pad, "fy1": y0 + F.col("y1") * h + pad}).drop("x0", "y0", "x1", "y1")
    if page is None:
        return out
    limits = {"fx0": page[0], "fy0": page[1], "fx1": page[0], "fy1": page[1]}
    return out.withColumns({n: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col(n))) for n, most in limits.items()})


def hits(line: float = 14.0) -> tuple[Column, Column]:
    """(condition, reading order) of a span (x0, y0, x1, y1) in a region (fx0, fy0, fx1, fy1)."""
    c = F.col
    oy, ox = overlap(c("y0"), c("y1"), c("fy0"), c("fy1")), overlap(c("x0"), c("x1"), c("fx0"), c("fx1"))
    one = F.lit(1.0)
    tall = oy / F.greatest(one, c("y1") - c("y0")) >= 0.5
    wide = (ox / F.greatest(one, c("x1") - c("x0")) >= 0.5) | (ox / (c("fx1") - c("fx0")) >= 0.5)
    return (oy > 0) & (ox > 0) & tall & wide, F.struct(F.bround((c("y0") + c("y1")) / 2 / line).alias("row"), c("x0").alias("x"), c("span_no").alias("n"))


def map_fields(spans: DataFrame, regions: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each page (keys) and region of its form: value in reading order, confidence, box, spans.

    The regions of forms are few and are broadcast. What was found is dealt once, by page, and joined a page at a time;
    the rows of a page's fields are made after that. Pages without spans in a region keep an empty field.
    """
    c = F.col
    condition, order = hits()
    regions = F.broadcast(regions)
    found = spans.join(regions, "form").filter(condition & c("field_name").isNotNull()).repartition(*keys)
    boxes = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), "text")))
    stats = {
        "value": F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), " ")),
        "conf": F.coalesce(F.bround(F.avg("conf"), 4), F.lit(0.0)),
        "n_spans": F.count("*"),
    }
    grouped = found.groupBy(*keys, "field_name").agg(*(x.alias(n) for n, x in stats.items()), *boxes)
    names = [*stats, "x0", "y0", "x1", "y1"]
    # lists of one group are in one order and have no nulls; those that nobody asks for aren't made
    listed = grouped.groupBy(*keys).agg(F.collect_list("field_name").alias("_names"), *(F.collect_list(n).alias(f"_{n}") for n in names))
    out = pages.select(*keys, "form").join(listed, keys, "left").join(regions, "form").withColumn("_at", F.array_position("_names", c("field_name")).cast("int"))
    got = {n: F.when(c("_at") > 0, F.element_at(c(f"_{n}"), c("_at"))) for n in names}
    got |= {n: F.coalesce(got[n], F.lit(none)) for n, none in (("value", ""), ("conf", 0.0), ("n_spans", 0))}
    return out.select(*keys, "field_name", *(got[n].alias(n) for n in names))


def centre_in(pad: float = PAD) -> Column:
    """Whether a span's centre lies in a box (bx0, by0, bx1, by1), widened by pad."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return x.between(F.col("bx0") - pad, F.col("bx1") + pad) & y.between(F.col("by0") - pad, F.col("by1") + pad)


def rotate(x0: Column, y0: Column, x1: Column, y1: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    """The envelope of a box's four corners, turned around a centre."""
    a = F.radians(degrees)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    xs = [cx + (x - cx) * F.cos(a) - (y - cy) * F.sin(a) for x, y in corners]
    ys = [cy + (x - cx) * F.sin(a) + (y - cy) * F.cos(a) for x, y in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def crop(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, pad: float = PAD) -> Column:
    """A padded box within its page, and its share of the page."""
    a, b = F.greatest(F.lit(0.0), x0 - pad), F.greatest(F.lit(0.0), y0 - pad)
    c, d = F.least(width, x1 + pad), F.least(height, y1 + pad)
    return F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"), ((c - a) * (d - b) / (width * height)).alias("share"))


def quality(blur: Column, contrast: Column, noise: Column, skew: Column, density_ok: Column) -> Column:
    """(score, band) of a page's signals."""
    score = 0.30 * blur + 0.25 * contrast + 0.25 * (1 - noise) + 0.10 * (1 - F.least(F.lit(1.0), skew / 12)) + 0.10 * density_ok.cast("double")
    return F.struct(score.alias("score"), F.when(score >= 0.72, "good").when(score >= 0.55, "fair").otherwise("poor").alias("band"))


def repairs(skew: Column, illumination: Column, noise: Column, bright: Column) -> Column:
    """The operations that a page's signals ask for, in their order."""
    return F.array_compact(F.array(F.when(F.abs(skew) >= 8.0, "deskew"), F.when(illumination >= 0.075, "illumination"), F.when(noise >= 0.30, "denoise"), F.when(bright < 238, "contrast")))
