"""Review against a recompute of everything; progress of streams; duplicates in streams."""

import random

from pyspark.sql import functions as F

from fieldrail.operators import batches as T
from fieldrail.sources.records import append_once
from fieldrail.streaming import progress as G

FIELDS = "doc int, page int, field_name string, value string, state string"
ACTIONS = "doc int, page int, field_name string, seq int, action string, new_value string"


def data(seed=1):
    r = random.Random(seed)
    names = ["total_charge", "line1_charges", "line2_charges", "patient_dob", "line1_date_from"]
    fields = [(d, p, n, r.choice(["10.00", "20.00", "30.00", "x", None, "01/02/2020"]), r.choice(["ACCEPT", "ACCEPT_WITH_FLAG", "HUMAN_REVIEW", "RETRY"])) for d in range(12) for p in range(3) for n in names]
    acts = [(r.randrange(6), r.randrange(3), r.choice(names), k, r.choice(["EDIT"] * 4 + ["MARK_BLANK", "MARK_NOT_APPLICABLE", "LEAVE_UNRESOLVED"]), r.choice(["10.00", "30.00", "01/01/1990", "03/03/2021", ""])) for k in range(40)]
    return fields, [*acts, (2, None, None, 99, "REJECT_DOCUMENT", None), (5, 0, "no such field", 98, "EDIT", "1.00")]


def test_touched_documents_alone_equal_a_recompute(spark):
    fields, acts = data()
    f, a = spark.createDataFrame(fields, FIELDS), spark.createDataFrame(acts, ACTIONS)
    before = T.document_counters(f.withColumn("action", F.lit(None).cast("string")))
    got_fields, got = T.revalidate(f, before, a)
    everything = T.reviewed_fields(f, a)
    assert sorted(map(repr, got_fields.collect())) == sorted(map(repr, everything.select(*got_fields.columns).collect()))
    whole = T.document_counters(everything, a.filter("action = 'REJECT_DOCUMENT'"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.select(*got.columns).collect()))
    by = {x.doc: x for x in got.collect()}
    assert len(by) == 12 and by[2].status == "FAILED" and all(x.fields == 15 for x in by.values())
    # documents without an action weren't counted again: other counters of theirs come through
    marked = before.withColumn("unresolved", F.when(F.col("doc") >= 6, 77).otherwise(F.col("unresolved")))
    assert {x.unresolved for x in T.revalidate(f, marked, a)[1].collect() if x.doc >= 6} == {77}
    none = a.filter("false")
    assert sorted(map(repr, T.revalidate(f, before, none)[1].collect())) == sorted(map(repr, before.select(*got.columns).collect()))


def test_edits_are_judged_among_the_pages_values(spark):
    page = [(1, 1, n, v, "HUMAN_REVIEW") for n, v in (("total_charge", "30.00"), ("line1_charges", "x"), ("line2_charges", "20.00"))]
    judged = lambda *acts: {x.field_name: x for x in T.reviewed_fields(spark.createDataFrame(page, FIELDS), spark.createDataFrame([(1, 1, *x) for x in acts], ACTIONS)).collect()}
    assert judged(("line1_charges", 1, "EDIT", "10.00"))["line1_charges"].state == "ACCEPT_WITH_OVERRIDE"
    bad = judged(("line1_charges", 1, "EDIT", "11.00"))["line1_charges"]
    assert (bad.state, bad.resolution, bad.failures) == ("HUMAN_REVIEW", "VALIDATION_FAILED", 1)
    # the later word counts, and an edit of the total is seen by the line's rule
    both = judged(("line1_charges", 1, "EDIT", "11.00"), ("total_charge", 2, "EDIT", "31.00"))
    assert {x.state for n, x in both.items() if n != "line2_charges"} == {"ACCEPT_WITH_OVERRIDE"}
    gone = judged(("line1_charges", 1, "EDIT", "10.00"), ("line1_charges", 2, "MARK_NOT_APPLICABLE", None))["line1_charges"]
    assert (gone.value, gone.state, gone.failures) == (None, "INAPPLICABLE", None)


def test_progress_and_bounded_duplicates(spark, tmp_path):
    rows = [(k % 7, f"2026-01-01 00:{k:02d}:00", k) for k in range(30)]
    frame = spark.createDataFrame(rows, "call int, ts string, n int").withColumn("ts", F.to_timestamp("ts"))
    for b in range(3):
        frame.filter((F.col("n") >= 10 * b) & (F.col("n") < 10 * b + 10)).coalesce(1).write.json(str(tmp_path / "in" / f"b={b}"))
    listener = G.ProgressTable(spark, str(tmp_path / "progress"))
    assert G.read_progress(spark, str(tmp_path / "progress")).count() == 0
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "b=*"))
        q = G.first_of_each(source, ["call"], "ts").writeStream.format("parquet").queryName("firsts").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {x.call for x in out.collect()} == {x.call for x in append_once(frame.limit(0), frame, ["call"]).collect()} and out.count() == 7
    one = G.stage_table(G.read_progress(spark, str(tmp_path / "progress"))).collect()
    assert [(x.query, x.stage, x.input_rows, x.state_rows, x.error) for x in one] == [("firsts", "COMPLETED", 30, 7, None)] and one[0].batches >= 3
