"""Second readings of a page's fields: crops packed on one sheet, words put back to crops, and the fold of what was read.

A page has at most as many crops and retried fields as its form has fields, so they stand in arrays of one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import RETRY, decide, fuse
from ..functions.text import blank, let, strip
from ..functions.typed import compared_value, family, printed_date
from ..functions.validators import check

# Fixed measures of a sheet, in pixels.
PADDING, LEAST_WIDE, MOST_WIDE = 24, 1024, 1800


def pack(crops: DataFrame, page: str = "page") -> DataFrame:
    """(page, key, x0, y0, x1, y1, sheet_width, sheet_height, unique_crops) of (page, crop_no, key, width, height, is_blank).

    Crops of one key are placed once, in the order of their first numbers: on shelves, a new one where the next crop
    doesn't fit in the width. Blank crops aren't placed; a page of only these has no sheet.
    """
    c = F.col
    unique = crops.filter(~c("is_blank")).groupBy(page, "key").agg(F.min("crop_no").alias("first"), F.min_by("width", "crop_no").alias("w"), F.min_by("height", "crop_no").alias("h"))
    pages = unique.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("first", "key", "w", "h"))).alias("crops"))
    widest = F.array_max(F.transform("crops", lambda x: x["w"]))
    pages = pages.withColumn("wide", F.greatest(F.least(F.lit(MOST_WIDE), F.greatest(F.lit(LEAST_WIDE), widest)), widest + 2 * PADDING))
    spot = "array<struct<key: string, x0: int, y0: int, x1: int, y1: int>>"
    start = F.struct(F.lit(PADDING).alias("x"), F.lit(PADDING).alias("y"), F.lit(0).alias("tall"), F.array().cast(spot).alias("placed"))

    def place(s: Column, crop: Column) -> Column:
        new = (s["x"] + crop["w"] + PADDING > c("wide")) & (s["x"] > PADDING)
        x, y = F.when(new, PADDING).otherwise(s["x"]), F.when(new, s["y"] + s["tall"] + PADDING).otherwise(s["y"])
        tall = F.greatest(F.when(new, 0).otherwise(s["tall"]), crop["h"])
        own = F.struct(crop["key"].alias("key"), x.alias("x0"), y.alias("y0"), (x + crop["w"]).alias("x1"), (y + crop["h"]).alias("y1"))
        return F.struct((x + crop["w"] + PADDING).alias("x"), y.alias("y"), tall.alias("tall"), F.concat(s["placed"], F.array(own)).alias("placed"))

    done = pages.withColumn("s", F.aggregate(F.transform("crops", lambda x: F.struct(x["key"].alias("key"), x["w"].cast("int").alias("w"), x["h"].cast("int").alias("h"))), start, place))
    return done.select(page, F.inline("s.placed"), c("wide").cast("int").alias("sheet_width"), (c("s.y") + c("s.tall") + PADDING).cast("int").alias("sheet_height"), F.size("crops").alias("unique_crops"))


def put_back(crops: DataFrame, sheets: DataFrame, words: DataFrame, page: str = "page") -> DataFrame:
    """(page, crop_no, x0, words): every crop, equal ones alike, with the sheet's words whose centre it holds, from left to right.

    words: (page, text, x0, y0, x1, y1) on the sheet. A blank crop has no place and no words.
    """
    c = F.col
    placed = sheets.select(page, "key", *(c(n).alias("_" + n) for n in ("x0", "y0", "x1", "y1")))
    centre = words.select(page, "text", c("x0").alias("left"), ((c("x0") + c("x1")) / 2).alias("cx"), ((c("y0") + c("y1")) / 2).alias("cy"))
    near = placed.join(centre, page).filter(c("cx").between(c("_x0"), c("_x1")) & c("cy").between(c("_y0"), c("_y1")))
    held = near.groupBy(page, "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ").alias("words"))
    active = crops.filter(~c("is_blank")).select(page, "crop_no", "key").join(placed.select(page, "key", c("_x0").alias("x0")), [page, "key"]).join(held, [page, "key"], "left")
    rest = crops.filter("is_blank").select(page, "crop_no", F.lit(None).cast("int").alias("x0"), F.lit("").alias("words"))
    return active.select(page, "crop_no", "x0", F.coalesce("words", F.lit("")).alias("words")).unionByName(rest)


#: (facts of a name and its value, (failures, passes) of such facts among the facts of all the page's fields, a map by field).
Rules = tuple[Callable[[Column, Column], Column], Callable[[Column, Column], Column]]


def _cents(value: Column) -> Column:
    """A printed amount in cents; null if it isn't one."""
    return let(strip(value), lambda own: F.when(own.rlike(r"^\d{1,7}\.\d{2}\z"), F.regexp_replace(own, r"\.", "").cast("long")))


def claim_facts(name: Column, value: Column) -> Column:
    """What the rules ask of a value by itself: its family and form, its cents or day, whether it is a line's charge.

    An amount has its form (currency_format) where its cents can be read, a date (date_valid) where its day can.
    """

    def facts(kind: Column) -> Column:
        cents, day = F.when(kind == "money", _cents(value)), F.when(kind == "date", printed_date(value))
        return let(F.struct(kind.alias("kind"), cents.alias("cents"), day.alias("day")), whole)

    def whole(x: Column) -> Column:
        kind = x["kind"]
        form = F.when(kind == "money", x["cents"].isNotNull()).when(kind == "date", x["day"].isNotNull()).when(kind == "quantity", check("numeric_format", value)["verdict"] == "PASS").otherwise(True)
        line = (kind == "money") & name.rlike(r"^line\d+_charges\z")
        return F.struct(name.alias("name"), kind.alias("kind"), (~blank(value) & form).alias("form"), x["cents"].alias("cents"), x["day"].alias("day"), line.alias("line"))

    return let(family(name), facts)


def claim_verdict(own: Column, facts: Column) -> Column:
    """(failures, passes) of a value's facts among the page's: its form, and the rules between fields.

    Charges must add up to the total where all of them can be read; a service date isn't before the date of birth.
    """
    all_facts = F.map_values(facts)
    # an amount that can't be read makes the sum null
    lines = F.aggregate(all_facts, F.lit(0).cast("long"), lambda s, x: F.when(x["line"], s + x["cents"]).otherwise(s))
    adds = F.when((own["kind"] == "money") & F.exists(all_facts, lambda x: x["line"]), lines == facts["total_charge"]["cents"])
    later = F.when((own["kind"] == "date") & (own["name"] != "patient_dob"), own["day"] >= facts["patient_dob"]["day"])
    one = lambda x: x.cast("int")
    none = F.lit(0)
    return let(
        F.struct(own["form"].alias("form"), adds.alias("adds"), later.alias("later")),
        lambda r: F.struct(
            (one(~r["form"]) + F.coalesce(one(~r["adds"]), none) + F.coalesce(one(~r["later"]), none)).alias("failures"),
            (one(r["form"]) + F.coalesce(one(r["adds"]), none) + F.coalesce(one(r["later"]), none)).alias("passes"),
        ),
    )


CLAIM_RULES: Rules = (claim_facts, claim_verdict)


def claim_judge(name: Column, value: Column, values: Column) -> Column:
    """(failures, passes) of a value among the page's values (a map by field)."""
    return claim_verdict(claim_facts(name, value), F.transform_values(values, claim_facts))


def retry_fold(pages: DataFrame, rules: Rules = CLAIM_RULES, accept: float = 0.8, escalate: float = 0.5) -> DataFrame:
    """(page, name, value, confidence, failures, took, changed, state) of the retried fields of (page, quality, fields, tries).

    fields: an array of (name, value, confidence); tries: of (no, name, value, confidence, n_spans), one a retried field. They are
    taken in the order of ``no``: the better of what stood there and what was read again stays (fewer failures, more passes,
    agreement, confidence, the first), and a value that is taken changes what the rules of the next fields see.

    Facts of values are worked out once each, before the fold, which only compares; what no later field sees comes after it.
    """
    c = F.col
    facts, verdict = rules
    text = lambda x: F.coalesce(x["value"], F.lit(""))
    seen = lambda name, value: F.struct(value.alias("value"), facts(name, value).alias("facts"))
    stood = pages.select(
        "page",
        "quality",
        F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], facts(f["name"], text(f))))).alias("facts"),
        F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], F.struct(text(f).alias("value"), F.coalesce(f["confidence"], F.lit(0.0)).alias("confidence"))))).alias("stood"),
        F.transform(F.sort_array("tries"), lambda t: F.struct(t["name"].alias("name"), t["confidence"].alias("confidence"), t["n_spans"].alias("n_spans"), seen(t["name"], text(t)).alias("new"))).alias("tries"),
    )
    row = "array<struct<name: string, old: string, new: string, sure: double, confidence: double, n_spans: bigint, failures: int, took: boolean>>"
    start = F.struct(c("facts").alias("facts"), c("stood").alias("stood"), F.array().cast(row).alias("out"))

    def put(of: Column, name: Column, value: Column) -> Column:
        return F.map_concat(F.map_filter(of, lambda k, v: k != name), F.create_map(name, value))

    def step(s: Column, t: Column) -> Column:
        name = t["name"]
        own = F.coalesce(s["facts"][name], facts(name, F.lit("")))
        before = lambda among: F.struct(among.alias("among"), verdict(own, s["facts"]).alias("before"), verdict(t["new"]["facts"], among).alias("after"))
        return let(let(put(s["facts"], name, t["new"]["facts"]), before), lambda j: chosen(s, t, j))

    def chosen(s: Column, t: Column, j: Column) -> Column:
        name, new = t["name"], t["new"]["value"]
        old, sure = F.coalesce(s["stood"][name]["value"], F.lit("")), F.coalesce(s["stood"][name]["confidence"], F.lit(0.0))
        # agreement is the same for both, so it decides nothing between two
        rank = lambda j, confidence, attempt: F.struct(j["failures"].alias("a"), (-j["passes"]).alias("b"), (-confidence).alias("c"), F.lit(attempt).alias("d"))
        took = ~blank(new) & (blank(old) | (rank(j["after"], t["confidence"], 0) < rank(j["before"], sure, -1)))
        return let(took, lambda took: done(s, t, j, old, sure, took))

    def done(s: Column, t: Column, j: Column, old: Column, sure: Column, took: Column) -> Column:
        name, new = t["name"], t["new"]["value"]
        failures = F.when(took, j["after"]["failures"]).otherwise(j["before"]["failures"])
        own = F.struct(name.alias("name"), old.alias("old"), new.alias("new"), sure.alias("sure"), t["confidence"].cast("double").alias("confidence"), t["n_spans"].cast("long").alias("n_spans"), failures.alias("failures"), took.alias("took"))
        # the sureness that a field is compared with stays the one that it came with
        value = F.struct(new.alias("value"), sure.alias("confidence"))
        return F.struct(
            F.when(took, j["among"]).otherwise(s["facts"]).alias("facts"),
            F.when(took, put(s["stood"], name, value)).otherwise(s["stood"]).alias("stood"),
            F.concat(s["out"], F.array(own)).alias("out"),
        )

    out = stood.select("page", "quality", F.inline(F.aggregate("tries", start, step, lambda s: s["out"])))
    none, rule, off = F.array().cast("array<string>"), F.array(F.lit("claim")), F.lit(False)
    fused = F.when(c("took"), fuse(c("confidence"), c("quality"), c("n_spans"), c("new"), none)).otherwise(c("sure")).cast("double")
    changed = F.when(c("took") & (c("old") != c("new")), compared_value(c("name"), c("old")) != compared_value(c("name"), c("new"))).otherwise(False)
    out = out.select("page", "name", F.when(c("took"), c("new")).otherwise(c("old")).alias("value"), fused.alias("confidence"), "failures", "took", changed.alias("changed"))
    fails = F.when(c("failures") > 0, rule).otherwise(none)
    state = decide(c("value"), c("confidence"), fails, rule, off, F.lit(True), off, F.lit("med"), F.lit(1), F.lit(1), F.lit(accept), F.lit(escalate), F.lit(True))["state"]
    return out.withColumn("state", state)


def needs_retry(fields: DataFrame) -> DataFrame:
    """Fields that wait for a second reading and have a box to read."""
    return fields.filter((F.col("state") == RETRY) & F.col("bbox").isNotNull())
