"""Folders of real files, what can't be read, copies, manifests over bytes, logs appended to."""

import hashlib
import json

from pyspark.sql import functions as F

from fieldrail.operators.oversight import file_hashes, manifest_differences
from fieldrail.operators.review import workspace_stamps
from fieldrail.sources import files, records

SCHEMA = "path string, content binary, pages int, link boolean, readable boolean"


def test_a_folder_of_files(spark, tmp_path):
    put = {
        "b/Claim.pdf": b"%PDF-1.7 one", "B/attachment_2.pdf": b"%PDF-1.7 two", "a.pdf": b"%PDF-1.7 one", "z/page.png": b"\x89PNG\r\n\x1a\n..",
        "spec.txt": b"UB92 file spec", "notes.txt": b"caf\xe9 and so on", "t.json": b'\xef\xbb\xbf{"fields": {}}', "u.json": b'{"fields": []}', "x.bin": b"PK\x03\x04...", "w.dat": b"A" * 320 + b"\r\n" + b"B" * 320, "s.txt": b" \n ",
    }
    for name, body in put.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    base = f"file:{tmp_path}"
    got = {x.relative_path: x for x in files.folder_inventory(files.scan(spark, f"file://{tmp_path}"), base).collect()}
    assert set(got) == set(put)
    assert all(got[n].id == hashlib.sha256(b).hexdigest()[:12] and got[n].size == len(b) for n, b in put.items())
    kinds = {n: (x.format, x.role, x.status) for n, x in got.items()}
    assert kinds["a.pdf"] == ("PDF", "claim_document", "READY") and kinds["b/Claim.pdf"] == ("PDF", "claim_document", "DUPLICATE")
    assert got["b/Claim.pdf"].warning == "Duplicate content; first seen as a.pdf." and got["b/Claim.pdf"].grp == "b" and got["a.pdf"].grp == "."
    assert kinds["B/attachment_2.pdf"][1] == "attachment" and kinds["z/page.png"][0] == "PNG" and kinds["w.dat"] == ("NSF320", "expected_output", "READY")
    assert kinds["spec.txt"][1:] == ("specification", "READY") and kinds["notes.txt"][1:] == ("unknown", "UNKNOWN") and kinds["x.bin"][1:] == ("unsupported", "UNSUPPORTED")
    assert kinds["t.json"] == ("JSON", "expected_output", "READY") and kinds["u.json"] == ("JSON", "unknown", "UNKNOWN") and kinds["s.txt"][0] == "EMPTY"


def test_what_has_no_content_and_page_limits(spark):
    pdf = b"%PDF-1.4 "
    rows = [("/d/1.pdf", pdf + b"a", 100, None, None), ("/d/2.pdf", pdf + b"b", 101, False, True), ("/d/3.pdf", pdf + b"c", None, False, True), ("/d/4.pdf", pdf, 0, False, True), ("/d/link", b"x", None, True, True), ("/d/gone", None, None, False, False), ("/d/e1", b"", None, None, None), ("/d/e2", b"", None, None, None), ("/d/A.txt", b"same", None, None, None), ("/d/a.txt", b"same", None, None, None)]
    inventory = files.folder_inventory(spark.createDataFrame(rows, SCHEMA), "/d/")
    got = {x.relative_path: x for x in inventory.collect()}
    assert {n: x.status for n, x in got.items()} == {"1.pdf": "READY", "2.pdf": "ERROR", "3.pdf": "ERROR", "4.pdf": "ERROR", "link": "UNSUPPORTED", "gone": "ERROR", "e1": "UNKNOWN", "e2": "UNKNOWN", "A.txt": "UNKNOWN", "a.txt": "DUPLICATE"}
    assert got["2.pdf"].warning == "Document page limit is 100; received 101 pages." and got["3.pdf"].warning == "The document could not be decoded."
    assert (got["link"].format, got["gone"].format, got["gone"].id) == ("SYMLINK", "UNREADABLE", hashlib.sha256(b"gone").hexdigest()[:12])
    one = files.scan_counters(inventory).first()
    assert (one.files_discovered, one.supported_files, one.claim_documents, one.duplicate_files) == (10, 1, 4, 1)
    empty = files.folder_inventory(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and files.scan_counters(empty).first().bytes == 0


def test_manifests_are_over_bytes(spark):
    rows = [("a", "é\r\nx\ry".encode()), ("b", b"\xff\x00\n"), ("c", b"")]
    frame = spark.createDataFrame(rows, "name string, content binary")
    got = {x.name: x.sha256 for x in file_hashes(frame).collect()}
    assert got == {n: hashlib.sha256(b.replace(b"\r\n", b"\n").replace(b"\r", b"\n")).hexdigest() for n, b in rows}
    later = spark.createDataFrame([("a", "é\nx\ny".encode()), ("b", b"\xff\x01\n"), ("d", b"")], "name string, content binary")
    assert {x.name for x in manifest_differences(file_hashes(frame), file_hashes(later)).collect()} == {"b", "c", "d"}


def test_log_lines_stay(spark, tmp_path):
    row = [("t", "d", "p", "f", "ocr", 0.123456789, 1.239, {"model": "m"})]
    frame = spark.createDataFrame(row, records.LEDGER)
    for _ in range(3):
        records.append_jsonl(frame, str(tmp_path / "log"))
    records.append_jsonl(frame.withColumn("cost_usd", F.lit(None).cast("double")), str(tmp_path / "log"))
    lines = [json.loads(x) for p in (tmp_path / "log").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 4 and sorted(x["cost_usd"] for x in lines) == [0.0] + [0.12345679] * 3 and lines[0]["latency_ms"] == 1.24
    assert records.read_jsonl(spark, str(tmp_path / "log"), records.LEDGER).filter("meta['model'] = 'm'").count() == 4


def test_hospital_claims_are_sound(spark):
    claims = records.synthetic_ub_claims(spark.range(60).union(spark.createDataFrame([(7,), (None,)], "id long")), "id")
    rows = claims.collect()
    assert len(rows) == 62 and sum(x.id == 7 for x in rows) == 2 and len({str(x) for x in rows if x.id == 7}) == 1
    for x in rows:
        cents = [int(line["charges"].replace(".", "")) for line in x.lines]
        assert int(x.total_charges.replace(".", "")) == sum(cents) and len(cents) in (2, 3) and all(9500 <= c < 185000 and c % 25 == 0 for c in cents)
        assert len({line["rev_code"] for line in x.lines}) == len(cents) and all(records.UB_PROCEDURES[line["rev_code"]] == line["hcpcs"] and line["service_date"] == x.statement_from for line in x.lines)
        assert x.statement_from[:2] == x.statement_to[:2] and 0 <= int(x.statement_to[2:4]) - int(x.statement_from[2:4]) <= 3
        for npi in (x.provider_npi, x.attending_npi):
            digits = [int(c) for c in reversed("80840" + npi)]
            assert len(npi) == 10 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert {len(x.lines) for x in rows} == {2, 3} and {x.type_of_bill for x in rows} == set(records.UB_BILL_TYPES)
    assert records.flatten_lines(claims, "lines", ["id"]).count() == 5 * sum(len(x.lines) for x in rows)


def test_workspace_stamps_take_the_place_of_rules(spark):
    fields = spark.createDataFrame([(1, "a", True, True, "MARK_NOT_APPLICABLE"), (1, "b", True, True, None), (1, "c", None, True, "EDIT"), (1, "d", None, None, None), (2, "a", False, False, None)], "page int, field_name string, inactive boolean, off boolean, action string")
    stamps = spark.createDataFrame([(p, n, v, "PASS", None) for p, n in ((1, "a"), (1, "c"), (1, "d"), (2, "a")) for v in ("x", "y")], "page int, field_name string, validator string, verdict string, detail string")
    got = sorted((x.page, x.field_name, x.validator, x.verdict) for x in workspace_stamps(fields, stamps, ["page"]).collect())
    assert got == [(1, "a", "human_review", "INAPPLICABLE"), (1, "b", "service_line_activation", "INAPPLICABLE"), (1, "c", "template_blank_policy", "INAPPLICABLE"), *((p, n, v, "PASS") for p, n in ((1, "d"), (2, "a")) for v in ("x", "y"))]
    assert workspace_stamps(fields.limit(0), stamps, ["page"]).count() == 8 and workspace_stamps(fields, stamps.limit(0), ["page"]).count() == 3
