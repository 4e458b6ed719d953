"""Sheets of crops and the fold of second readings against plain Python."""

import random

from pyspark.sql import functions as F

from fieldrail.operators import local_retry as L
from fieldrail.operators import oversight as O


def sheet(crops):
    """The placements of (key, width, height), one by one."""
    wide = max(min(1800, max(1024, max(w for _, w, _ in crops))), max(w for _, w, _ in crops) + 48)
    x = y = 24
    tall, out = 0, {}
    for key, w, h in crops:
        if x + w + 24 > wide and x > 24:
            x, y, tall = 24, y + tall + 24, 0
        out[key] = (x, y, x + w, y + h, wide)
        x, tall = x + w + 24, max(tall, h)
    return out, y + tall + 24


def test_sheets_equal_a_plain_fold(spark):
    r = random.Random(1)
    rows, sizes = [], {f"k{i}": (r.choice([30, 200, 900, 1790, 2500]), r.randint(5, 90)) for i in range(14)}
    for page in range(12):
        for no in range(r.randint(1, 30)):
            key = f"k{r.randrange(14)}"
            rows.append((page, no, key, *sizes[key], r.random() < 0.2 or page == 3))
    crops = spark.createDataFrame(rows, "page int, crop_no int, key string, width int, height int, is_blank boolean").repartition(3)
    got = {}
    for x in L.pack(crops).collect():
        got.setdefault(x.page, {})[x.key] = (x.x0, x.y0, x.x1, x.y1, x.sheet_width, x.sheet_height, x.unique_crops)
    for page in range(12):
        first = dict.fromkeys(k for p, _, k, _, _, off in rows if p == page and not off)
        if not first:
            assert page not in got
            continue
        want, high = sheet([(k, *sizes[k]) for k in first])
        assert got[page] == {k: (*v, high, len(first)) for k, v in want.items()}
    words = [(p, f"w{n}", *(box := (r.uniform(0, 1700), r.uniform(0, 300))), box[0] + 30.0, box[1] + 8.0) for p in range(12) for n in range(60)]
    back = {(x.page, x.crop_no): (x.x0, x.words) for x in L.put_back(crops, L.pack(crops), spark.createDataFrame(words, "page int, text string, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert len(back) == len(rows)
    for p, no, key, _, _, off in rows:
        if off:
            assert back[p, no] == (None, "")
            continue
        x0, y0, x1, y1 = got[p][key][:4]
        inside = sorted((a, t) for q, t, a, b, c, d in words if q == p and x0 <= (a + c) / 2 <= x1 and y0 <= (b + d) / 2 <= y1)
        assert back[p, no] == (x0, " ".join(t for _, t in inside))


def test_what_was_taken_counts_for_the_next_field(spark):
    fields = [("line1_charges", "10.00", 0.9), ("line2_charges", "x", 0.5), ("total_charge", "99.00", 0.6), ("patient_dob", "01/02/1980", 0.9), ("line1_date_from", "01/02/1979", 0.7), ("note", None, 0.1)]
    tries = [(4, "line1_date_from", "01/02/2020", 0.6, 1), (1, "total_charge", "30.00", 0.7, 1), (2, "line2_charges", "20.00", 0.4, 1), (3, "line1_charges", "11.00", 0.99, 1), (5, "note", "", 0.9, 0)]
    kinds = "page int, quality double, fields array<struct<name:string,value:string,confidence:double>>, tries array<struct<no:int,name:string,value:string,confidence:double,n_spans:int>>"
    got = {x.name: x for x in L.retry_fold(spark.createDataFrame([(1, 1.0, fields, tries), (2, 1.0, fields, [])], kinds)).collect()}
    # the total is read before the second line can be, so form and confidence decide; the second line then completes the sum
    assert got["total_charge"].value == "30.00" and got["total_charge"].took and got["total_charge"].failures == 0
    assert got["line2_charges"].value == "20.00" and got["line2_charges"].failures == 0
    # a surer reading of the first line would break the sum, which only holds by what was taken before
    assert got["line1_charges"].value == "10.00" and not got["line1_charges"].took
    assert got["line1_date_from"].value == "01/02/2020" and got["line1_date_from"].changed
    assert got["note"].value == "" and not got["note"].took and got["note"].state == "HUMAN_REVIEW"
    assert all(x.page == 1 for x in got.values())


def test_shifted_profiles_find_their_form(spark):
    r = random.Random(2)
    shapes = {(f, v): ([r.random() for _ in range(20)], [r.random() for _ in range(20)]) for f in ("cms1500", "ub04") for v in (1, 2)}
    pages = [(k, a[s:] + a[:s], [2 * x + 1 for x in b[-s:] + b[:-s]] if s else b) for k, ((_, s), (a, b)) in enumerate(zip([(0, 0), (0, 3), (0, 4), (0, 1)], shapes.values()))] + [(9, [1.0] * 20, [2.0] * 20)]
    forms = spark.createDataFrame([(f, v, a, b) for (f, v), (a, b) in shapes.items()], "form string, variant int, rows array<double>, cols array<double>")
    got = {x.page: x for x in O.profile_routes(spark.createDataFrame(pages, "page int, rows array<double>, cols array<double>"), forms, "page").collect()}
    assert [(got[k].form, got[k].variant) for k in range(4)] == list(shapes) and all(abs(got[k].score - 1) < 1e-6 for k in range(4))
    assert (got[9].form, got[9].variant) == ("unknown", None)


def test_fields_that_wait(spark):
    rows = spark.createDataFrame([("a", "RETRY", [1.0]), ("b", "RETRY", None), ("c", "ACCEPT", [1.0])], "n string, state string, bbox array<double>")
    assert [x.n for x in L.needs_retry(rows).collect()] == ["a"] and rows.filter(F.col("n") == "z").count() == 0
