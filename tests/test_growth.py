"""What keeps the work of rules and operators in proportion to their rows."""

from pyspark.sql import functions as F

from fieldrail.functions import typed
from fieldrail.operators import batches, candidates, regions, review
from fieldrail.sources import fixed_width, spread


def test_dates_are_split_once(spark):
    """Rules inside array functions are interpreted: each copy of a split in the expression is one more split."""
    for rule, what in ((typed.printed_date, "split("), (typed.compared_date, "regexp_replace(")):
        assert str(rule(F.col("x"))).count(what) == 1
    texts = ["01/02/1980", "1/2/80", "010226", "01022027", "02/30/2020", "13 45 26", "1980", "", None, "1//2//3", "12/31/0000", "a1b2c30"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(typed.printed_date(F.col("x")).cast("string").alias("d")).collect()
    assert [r.d for r in rows] == ["1980-01-02", "1980-01-02", "2026-01-02", "2027-01-02", None, None, None, None, None, None, None, "1930-01-02"]


def test_candidates_are_made_where_they_are_compared(spark):
    """Texts are shuffled, not what is made of them; spans are joined once."""
    rows = spark.createDataFrame([(1, ["$12", "34"]), (1, ["12", "34"]), (2, [" ", "x"])], "k int, texts array<string>").withColumn("name", F.lit("line1_charges"))
    out = candidates.explode(rows, "name", "texts", ["k"])
    got = sorted((r.k, r.candidate_no, r.value) for r in out.collect())
    assert [(k, no) for k, no, _ in got] == [(1, 0), (1, 1), (1, 2), (1, 3)] and got[0][2] == "12.34"
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert str(candidates.generate(F.col("name"), F.col("texts"))).count("array_join(") <= 2


def test_rows_of_files_are_shuffled_once(spark, tmp_path):
    """Rows are numbered where they are read, over batches, splits and files, and dealt once, by block."""
    row = lambda tag, text="": (tag + text).ljust(320)
    for k in range(3):
        rows = [r for i in range(40) for r in (row("BA0"), row("CA0", f"  {k}-{i}"), *[row("FA0", f"{j:>37}") for j in range(i % 4)])]
        (tmp_path / f"f{k}.txt").write_text("\r\n".join(rows))
    old = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        read = fixed_width.read_blocks(spark, str(tmp_path), "NSF320", r"/(f\d)[.]txt")
        lines = fixed_width.service_lines(read, "NSF320")
        got = {(r.path, r.ordinal, r.line_no) for r in lines.collect()}
        names = {(r.path, r.ordinal, r.value) for r in fixed_width.records(read, "NSF320").filter("field_name = 'patient_control_no'").collect()}
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
    assert got == {(f"f{k}", i + 1, j + 1) for k in range(3) for i in range(40) for j in range(i % 4)}
    assert names == {(f"f{k}", i + 1, f"{k}-{i}") for k in range(3) for i in range(40)}
    plan = lines._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning" in x and ("ordinal" in x or "split" in x)]) == 1


def test_tasks_grow_with_rows(spark):
    """Lines and fields are dealt to as many tasks as there are rows for, not to a fixed number."""
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread.spread(spark.range(30), 4) == 8 and spread.spread(spark.range(3)) == few and spread.spread_rows(spark.range(1), 20_000_001) == 21
    lines = spark.createDataFrame([(1, 2, True)], "doc int, line_no int, blank boolean")
    fields = spark.createDataFrame([(1, "line2_units", "3", "RETRY"), (1, "total", "1", "RETRY")], "doc int, field_name string, value string, state string")
    out = review.blank_inactive_lines(fields, lines, ["doc"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    assert {(r.field_name, r.value, r.state, r.verdict) for r in out.collect()} == {("line2_units", None, "ACCEPT", "INAPPLICABLE"), ("total", "1", "RETRY", None)}


def exchanges(frame):
    return [x for x in frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in x]


def test_reviewed_fields_are_shuffled_once(spark):
    """Fields and their actions are dealt by document; keys without a value have no action, earlier actions of other documents stay."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(d, p, n, "10.00", "HUMAN_REVIEW", "EDIT" if d == 2 else None, d) for d in (1, 2, None) for p in (1, None) for n in ("total_charge", "line1_charges")]
        fields = spark.createDataFrame(rows, "doc int, page int, field_name string, value string, state string, action string, other int")
        said = [(1, 1, "line1_charges", 1, "EDIT", "10.00"), (1, 1, "line1_charges", 2, None, "x"), (1, None, "total_charge", 3, "EDIT", "9.00"), (None, 1, "total_charge", 4, "EDIT", "9.00"), (1, 1, None, 5, "EDIT", "8.00")]
        actions = spark.createDataFrame(said, "doc int, page int, field_name string, seq int, action string, new_value string")
        counters = batches.document_counters(fields)
        done, counted = batches.revalidate(fields, counters, actions)
        assert len(exchanges(done)) == 1
        got = {(r.doc, r.page, r.field_name): (r.value, r.state, r.action, r.failures, r.other) for r in done.collect()}
        assert {x.doc: x.overridden for x in counted.collect()} == {1: 1, 2: 0, None: 0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {(d, p, n): (v, s, a, None, o) for d, p, n, v, s, a, o in rows}
    want[1, 1, "line1_charges"] = ("10.00", "ACCEPT_WITH_OVERRIDE", "EDIT", 0, 1)
    assert got == want and len(rows) == len(got)


def test_pages_are_joined_before_their_fields_are_made(spark):
    """Rows of a page's fields aren't shuffled; pages without a span, or without a key, have empty fields."""
    template = spark.createDataFrame([("f", "a", 0.0, 0.0, 100.0, 50.0), ("f", "b", 0.0, 60.0, 100.0, 99.0)], "form string, field_name string, fx0 double, fy0 double, fx1 double, fy1 double")
    spans = [(p, "f", n, t, x, y, x + 10, y + 5, q) for p, n, t, x, y, q in ((1, 2, "two", 30.0, 1.0, 0.5), (1, 1, "one", 5.0, 1.0, 1.0), (1, 3, "low", 5.0, 70.0, None), (2, 4, "off", 500.0, 1.0, 1.0), (None, 5, "lost", 5.0, 1.0, 1.0))]
    frame = spark.createDataFrame(spans, "page int, form string, span_no int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    pages = spark.createDataFrame([(1, "f"), (2, "f"), (3, "f"), (None, "f"), (4, "g")], "page int, form string")
    out = regions.map_fields(frame, template, pages, ["page"])
    assert not any("field_name" in x for x in exchanges(out))
    got = {(r.page, r.field_name): (r.value, r.conf, r.n_spans, r.x0, r.y0, r.x1, r.y1) for r in out.collect()}
    none = ("", 0.0, 0, None, None, None, None)
    assert got == {(p, f): none for p in (1, 2, 3, None) for f in "ab"} | {(1, "a"): ("one two", 0.75, 2, 5.0, 1.0, 40.0, 6.0), (1, "b"): ("low", 0.0, 1, 5.0, 70.0, 15.0, 75.0)}
