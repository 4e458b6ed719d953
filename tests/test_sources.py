"""Files, records, links and streams."""

import random

from fieldrail.operators import evaluation, ledger, linkage
from fieldrail.sources import files, fixed_width, records
from fieldrail.streaming import ledger as stream
from pyspark.sql import functions as F


def row(width, tag, **cells):
    out = list(tag.ljust(width))
    for place, text in cells.items():
        at = int(place[1:]) - 1
        out[at : at + len(text)] = text
    return "".join(out)


def parsed(spark, kind, *rows, path="f"):
    content = bytearray("\r\n".join(rows).encode("latin-1") + b"\r\n")
    lines = fixed_width.lines(spark.createDataFrame([(path, content)], "path string, content binary"))
    return lines, fixed_width.records(lines, kind), fixed_width.service_lines(lines, kind)


def test_nsf(spark):
    claim = [row(320, "BA0"), row(320, "CA0", p23="EXAMPLÉ", p43="PATIENT", p59="20010102"), row(320, "EA0", p174="A123456"), row(320, "FA0", p60="99213", p71="0012345"), row(320, "XA0", p78="001234-")]
    _, fields, lines = parsed(spark, "NSF320", row(320, "AA0"), *claim, row(320, "BA0"), row(320, "ZA0"), *claim)
    got = {(r.ordinal, r.field_name): r.value for r in fields.collect()}
    assert got[1, "patient_name"] == "EXAMPLÉ, PATIENT" and got[1, "total_charge"] == "-12.34" and got[1, "diagnosis_1"] == "A123456"
    assert {o for o, _ in got} == {1, 3}  # the block without a patient keeps its number
    assert {(r.ordinal, r.field_name): r.value for r in lines.collect()}[3, "charge"] == "123.45"


def test_ub(spark):
    claim = [row(192, "10"), row(192, "20"), row(192, "40", p25="111"), row(192, "60", p25="0450", p81="0300"), row(192, "50", p67="0120"), row(192, "90", p43="0000001000", p63="0000002500")]
    _, fields, lines = parsed(spark, "UB192", *claim)
    got = {r.field_name: r.value for r in fields.collect()}
    assert got["total_charges"] == "35.00" and got["type_of_bill"] == "111"
    order = [r.value for r in lines.filter("field_name = 'revenue_code'").orderBy("line_no").collect()]
    assert order == ["0120", "0450", "0300"]


def test_widths(spark):
    lines, fields, _ = parsed(spark, "NSF320", row(320, "BA0"), "short")
    assert [tuple(r.widths) for r in fixed_width.bad_widths(lines, "NSF320").collect()] == [(5,)] and fields.count() == 0


def test_inventory(spark, tmp_path):
    made = {"a.txt": row(320, "BA0"), "b.txt": row(320, "BA0"), "c.json": '{"fields": {}}', "d.json": "[1]", "e.bin": " \n", "sub/f.txt": "UB 92 File Spec", "g.txt": "{broken"}
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "h_attachment.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    got = {r.name: (r.format, r.role, r.status) for r in files.inventory(files.scan(spark, f"file://{tmp_path}")).collect()}
    assert got["a.txt"] == ("NSF320", "expected_output", "READY") and got["b.txt"][2] == "DUPLICATE"
    assert got["c.json"][:2] == ("JSON", "expected_output") and got["d.json"][:2] == ("TEXT", "unknown") and got["e.bin"][2] == "EMPTY"
    assert got["f.txt"][1] == "specification" and got["h_attachment.png"][:2] == ("PNG", "attachment") and got["g.txt"][0] == "TEXT"


def test_jsonl_and_truth(spark, tmp_path):
    assert records.read_jsonl(spark, str(tmp_path / "none.jsonl"), records.LEDGER).count() == 0
    (tmp_path / "l.jsonl").write_text('{"doc_id": "a", "cost_usd": 1.5}\n\n{"doc_id": "b"}\n')
    assert records.read_jsonl(spark, str(tmp_path / "l.jsonl"), records.LEDGER).count() == 2
    (tmp_path / "t.json").write_text('{"doc_id": "d", "fields": {"x": {"value": "1", "bbox": [1, 2]}, "y": {"value": null}}}')
    truth = records.truth_fields(spark.read.schema(records.TRUTH).json(str(tmp_path / "t.json")))
    assert {(r.field_name, r.value) for r in truth.collect()} == {("x", "1"), ("y", None)}


def test_synthetic_claims_are_valid(spark):
    from fieldrail.functions.typed import npi_valid

    claims = records.synthetic_claims(spark, 50)
    assert claims.filter(~npi_valid(F.col("billing_provider_npi"))).count() == 0
    assert claims.filter("total_cents != aggregate(lines, 0L, (a, x) -> a + x.cents)").count() == 0
    parts = records.split_documents(claims.withColumn("form", F.lit("f")), 1).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"calibration": 20, "test": 30}


def test_links(spark):
    items = spark.createDataFrame([(1, "ALPHA-1"), (1, "COMMON"), (2, "BRAVO"), (2, "COMMON"), (3, "00000")], "r int, v string")
    docs = spark.createDataFrame([("a", "alpha 1 person common"), ("b", "common"), ("c", "nobody 00000"), ("d", "Alpha-1")], "doc string, t string")
    links = linkage.link(docs, linkage.anchor_hits(docs, linkage.anchors(items, "r", "v"), "doc", "t"), "doc")
    got = {r.doc: (r.status, r.record, r.score, r.margin) for r in links.collect()}
    assert got == {"a": ("deterministic", 1, 4, 3), "b": ("ambiguous", None, 1, 0), "c": ("no_match", None, 0, 0), "d": ("deterministic", 1, 3, 3)}
    assert {r.doc: r.status for r in linkage.one_to_one(links).collect()} == {"a": "deterministic", "b": "ambiguous", "c": "no_match", "d": "ambiguous"}


def test_long_anchors_and_long_texts(spark, monkeypatch):
    """Anchors of all lengths, with other classes of lengths too, against a plain search."""
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("ABCDE1") for _ in range(n))
    texts = [letters(r.randint(0, 400)) for _ in range(30)]
    anchors = [(k, r.choice(texts)[i : i + r.choice((5, 8, 40, 120))]) for k in range(60) if (i := r.randrange(200)) >= 0]
    items = spark.createDataFrame(anchors, "r int, v string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, t string")
    found = linkage.anchors(items, "r", "v")
    rows = [(x.record, x.anchor, x.weight) for x in found.collect()]
    want = {}
    for i, t in enumerate(texts):
        for rec, anchor, weight in rows:
            if anchor in t:
                s, n = want.get((i, rec), (0, 0))
                want[i, rec] = s + weight, n + 1
    for classes in (linkage.CLASSES, ((5, 1), (8, 4), (40, 2))):
        monkeypatch.setattr(linkage, "CLASSES", classes)
        got = {(x.doc, x.record): (x.score, x.hits) for x in linkage.anchor_hits(docs, found, "doc", "t").collect()}
        assert got == want and any(len(a) > 48 for _, a, _ in rows)


def test_records_of_other_groups_do_not_collide(spark):
    rows = [("a", "g1", "deterministic", 1, 5, 2), ("b", "g1", "deterministic", 1, 5, 1), ("c", "g2", "deterministic", 1, 1, 1), ("d", "g2", "no_match", None, 0, 0)]
    links = spark.createDataFrame(rows, "doc string, grp string, status string, record int, score long, margin long")
    got = {r.doc: (r.status, r.record) for r in linkage.one_to_one(links, ["grp"]).collect()}
    assert got == {"a": ("deterministic", 1), "b": ("ambiguous", None), "c": ("deterministic", 1), "d": ("no_match", None)}


def test_nearest_ranks_equal_sorting(spark):
    r = random.Random(9)
    rows = [(k % 3, float(r.choice((r.randrange(5), r.randrange(10_000))))) for k in range(3000)] + [(3, 7.0), (4, None)]
    got = {x.k: (x.p5, x.p50, x.p95, x.p100) for x in ledger.percentiles(spark.createDataFrame(rows, "k int, v double"), "k", "v", (0.05, 0.5, 0.95, 1.0)).collect()}
    for k in range(4):
        own = sorted(v for i, v in rows if i == k)
        assert got[k] == tuple(own[-(-len(own) * q // 100) - 1] for q in (5, 50, 95, 100))
    assert set(got) == {0, 1, 2, 3}


def test_blended_needs_every_document(spark):
    rows = spark.createDataFrame([("a", "t1", True, "high", "ACCEPT")], "doc string, tier string, correct boolean, criticality string, state string")
    want = spark.createDataFrame([("a",), ("b",)], "doc string")
    assert [r.tier for r in evaluation.per_tier(rows, "tier", want, ["doc"]).collect()] == ["t1"]
    assert evaluation.per_tier(rows, "tier", want.filter("doc = 'a'"), ["doc"]).count() == 2


def ledger_files(tmp_path, n=40):
    (tmp_path / "in").mkdir()
    for k in range(4):
        lines = [f'{{"ts": "2026-01-01T0{i % 9}:00:00", "doc_id": "d{i % 30}", "operation": "op{i % 3}", "cost_usd": 0.001}}' for i in range(k * n // 4, (k + 1) * n // 4)]
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(lines))
    return str(tmp_path / "in")


def test_stream_appends_once(spark, tmp_path):
    folder = ledger_files(tmp_path)
    for _ in range(2):
        for check in ("c1", "c2"):  # a second query reads the files anew and adds nothing
            q = stream.append_stream(stream.read_ledger_stream(spark, folder, records.LEDGER), str(tmp_path / "out"), ["doc_id"], str(tmp_path / check))
            q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("doc_id").distinct().count() == 30


def test_stream_summary_equals_batch(spark, tmp_path):
    folder = ledger_files(tmp_path)
    rows = stream.read_ledger_stream(spark, folder, records.LEDGER).withColumn("ts", F.col("ts").cast("timestamp"))
    q = stream.running_summary(rows).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.operation): r.calls for r in spark.table("running").selectExpr("w.start", "operation", "calls").collect()}
    batch = spark.read.schema(records.LEDGER).json(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.start, r.operation): r.calls for r in stream.running_summary(batch).selectExpr("w.start", "operation", "calls").collect()}
    assert got == want and got


def test_budgets_fold(spark):
    calls = [("s", k, k, f"f{k % 4}", 0.004) for k in range(12)] + [("t", k, k, f"g{k}", 0.009) for k in range(4)]
    got = stream.budget_fold(spark.createDataFrame(calls, "session string, call_id long, ts long, fingerprint string, cost_usd double"), most_calls=3).collect()
    by = {(r.session, r.call_id): r.decision for r in got}
    assert [by["s", k] for k in range(5)] == ["ALLOW", "ALLOW", "ALLOW", "BLOCKED_CALL_COUNT", "REUSED_CACHED_RESULT"]
    assert [by["t", k] for k in range(4)] == ["ALLOW", "ALLOW", "BLOCKED_SESSION_BUDGET", "BLOCKED_SESSION_BUDGET"]


def test_budget_stream_equals_fold(spark, tmp_path):
    schema = "session string, call_id long, ts long, fingerprint string, cost_usd double"
    calls = [("s", k, k, f"f{k % 4}", 0.004) for k in range(12)] + [("t", k, k, f"g{k}", 0.009) for k in range(4)]
    rows = spark.createDataFrame(calls, schema)
    rows.coalesce(1).write.json(str(tmp_path / "calls"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(schema).json(str(tmp_path / "calls"))
        q = stream.budget_stream(source, most_calls=3).writeStream.format("memory").queryName("budgets").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    key = lambda r: (r.session, r.call_id, r.decision)
    assert sorted(map(key, spark.table("budgets").collect())) == sorted(map(key, stream.budget_fold(rows, most_calls=3).collect()))


def test_blocks_read_in_splits_equal_whole_files(spark, tmp_path):
    """Small splits, files with a lead before the first anchor, and one bad file."""
    def file(n, lead=()):
        rows = list(lead)
        for k in range(n):
            rows += [row(320, "BA0"), *([] if k % 5 == 3 else [row(320, "CA0", p6=f"acct{k}", p23="LAST", p43="F")]), row(320, "FA0", p60="99213", p71="0001000"), row(320, "XA0", p78="0001000")]
        return "\r\n".join(rows) + "\r\n"

    (tmp_path / "f").mkdir()
    for name, text in (("a", file(40)), ("b", file(25, [row(320, "AA0")])), ("c", file(1)), ("d", file(3) + "short\r\n")):
        (tmp_path / "f" / f"{name}.dat").write_bytes(text.encode("latin-1"))
    whole = spark.read.format("binaryFile").load(str(tmp_path / "f")).select("path", "content")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        split = fixed_width.read_blocks(spark, str(tmp_path / "f"), "NSF320")
        short = lambda frame: sorted(tuple(r[1:]) + (r.path.rsplit("/", 1)[-1],) for r in frame.collect())
        assert short(fixed_width.records(split, "NSF320")) == short(fixed_width.records(fixed_width.lines(whole), "NSF320"))
        assert short(fixed_width.service_lines(split, "NSF320")) == short(fixed_width.service_lines(fixed_width.lines(whole), "NSF320"))
        assert {r.path.rsplit("/", 1)[-1] for r in split.select("path").distinct().collect()} == {"a.dat", "b.dat", "c.dat"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_stream_reads_only_the_days_of_a_batch(spark, tmp_path):
    folder = ledger_files(tmp_path)
    for check in ("c1", "c2"):
        rows = stream.read_ledger_stream(spark, folder, records.LEDGER).withColumn("day", F.substring("ts", 1, 10))
        stream.append_stream(rows, str(tmp_path / "out"), ["day", "doc_id"], str(tmp_path / check), "day").awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("doc_id").distinct().count() == 30 and (tmp_path / "out" / "day=2026-01-01").exists()


def test_nothing_private_leaves(spark, tmp_path):
    from fieldrail.operators import exports

    inner = "struct<a:int,_b:int>"
    rows = spark.createDataFrame([(1, {"x": (1, 2), "_y": (3, 4)}, [(5, 6)], (7, 8), 9), (2, None, None, None, None)], f"k int, m map<string,{inner}>, l array<{inner}>, s {inner}, _p int")
    got = [r.asDict(True) for r in exports.public_view(rows).orderBy("k").collect()]
    assert got == [{"k": 1, "m": {"x": {"a": 1}}, "l": [{"a": 5}], "s": {"a": 7}}, {"k": 2, "m": None, "l": None, "s": None}]
    exports.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["k", "l", "m", "s"]
    exports.write_csv(rows.select("k"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_anchors_are_found_at_every_place(spark, monkeypatch):
    """Anchors of all classes at all shifts, by both ways of joining, against a plain search."""
    import random

    from fieldrail.operators import linkage

    r = random.Random(3)
    letters = "ABC0"
    text = ["".join(r.choice(letters) for _ in range(r.randint(0, 400))) for _ in range(40)] + ["", None, "A-b c" * 30]
    values = [(k % 7, t[(i := r.randint(0, max(0, len(t) - n))) : i + n]) for k, n in enumerate([5, 6, 9, 19, 20, 21, 27, 28, 47, 48, 49, 60, 71, 72, 90, 200] * 6) if (t := text[r.randrange(40)])]
    values += [(1, "000000"), (2, "abc"), (3, "A-B CAB"), (4, None)]
    docs = spark.createDataFrame([*enumerate(text), (None, text[0])], "doc long, text string")
    found = linkage.anchors(spark.createDataFrame(values, "record int, value string"), "record", "value")
    rows = [(x.record, x.anchor, x.weight) for x in found.collect()]
    assert {len(x[1]) for x in rows} >= {5, 19, 20, 48, 90} and all(len(x[1]) >= 5 and set(x[1]) != {"0"} for x in rows)
    import re

    want = {}
    for k, t in enumerate(text):
        hay = re.sub("[^A-Z0-9]", "", (t or "").upper())
        for record, anchor, weight in rows:
            if anchor in hay:
                s, n = want.get((k, record), (0, 0))
                want[k, record] = (s + weight, n + 1)
    for most in (1 << 20, 0):
        monkeypatch.setattr(linkage, "HELD_GRAMS", most)
        got = {(x.doc, x.record): (x.score, x.hits) for x in linkage.anchor_hits(docs, found, "doc", "text").collect()}
        assert got == want
    assert linkage.anchor_hits(docs, found.filter("false"), "doc", "text").count() == 0
