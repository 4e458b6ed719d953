"""Input and output pairs of rules, typed values, routing and grounding."""

import itertools
import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fieldrail.functions import decisions as D
from fieldrail.functions import text as X
from fieldrail.functions import typed as Y
from fieldrail.functions import validators as V
from fieldrail.operators import candidates
from fieldrail.sources import dims


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def table(spark, values, build):
    """build(column) over a column of values, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


PAIRS = [
    ("npi_checksum", "1393521954", "PASS"),
    ("npi_checksum", "1393521955", "FAIL"),
    ("npi_checksum", "123", "FAIL"),
    ("cpt_dictionary", "99213", "PASS"),
    ("cpt_dictionary", "99999", "FAIL"),
    ("icd10_format", "E11.9", "PASS"),
    ("icd10_format", "11.9E", "FAIL"),
    ("icd10_dictionary", "E119", "PASS"),
    ("date_valid", "02 27 26", "PASS"),
    ("date_valid", "13 45 26", "FAIL"),
    ("currency_format", "1172.50", "PASS"),
    ("currency_format", "1,172.50", "FAIL"),
    ("currency_format", "1172.50\n", "PASS"),
    ("zip_format", "55456", "PASS"),
    ("name_format", "Parker, Lori", "PASS"),
    ("name_format", "Parker, Lori Parker, Lori", "FAIL"),
    ("org_name_format", "Clinic & Sons", "PASS"),
    ("org_name_format", "12 34", "FAIL"),
    ("revenue_code_format", "0999", "PASS"),
    ("revenue_code_format", "999", "FAIL"),
    ("tax_id_format", "12-3456789", "PASS"),
    ("id_format", "abc123", "PASS"),
    ("numeric_format", "12345", "FAIL"),
]


def test_pairs(spark):
    got = [one(spark, F.struct(*(V.check(r, F.lit(v))["verdict"].alias(f"c{k}") for k, (r, v, _) in enumerate(PAIRS))))]
    assert list(got[0]) == [w for *_, w in PAIRS]


def test_every_rule_has_a_verdict_for_odd_values(spark):
    odd = ["", " ", " ", "999999999999999999999999", "a" * 5000, "٠١", "1e309", "--", "$"]
    for rule in V.RULES:
        assert all(x in ("PASS", "FAIL", "INAPPLICABLE") for x in table(spark, odd, lambda v, rule=rule: V.check(rule, v)["verdict"]))


def test_service_dates(spark):
    ctx = V.Context(dob=F.lit("01 10 1946"))
    assert one(spark, V.check("dob_before_service", F.lit("02 27 26"), ctx)).verdict == "PASS"
    assert one(spark, V.check("dob_before_service", F.lit("02 27 1940"), ctx)).verdict == "FAIL"
    day = lambda *d: F.array(F.lit(date(*d)))
    strict = lambda v, *d: one(spark, V.check("patient_dob_valid", F.lit(v), V.Context(claim_dates=day(*d)))).detail
    assert strict("01/10/1946", 2026, 1, 1) == "" and strict("19460110", 2026, 1, 1) == ""
    assert strict("01/10-1946", 2026, 1, 1) == "DOB must be one complete printed date"
    assert strict("01/10/2026", 2026, 1, 10) == "DOB is not before claim dates"
    assert strict("01/11/1900", 2026, 1, 10) == "" and strict("01/10/1900", 2026, 1, 10) == "DOB exceeds plausible age range"
    assert one(spark, V.check("patient_dob_valid", F.lit("01/10/1946"))).detail == "claim date unavailable for DOB chronology"


def test_claim_arithmetic(spark):
    ctx = lambda t, s, n: V.Context(F.lit(None).cast("string"), None, F.lit(t).cast("long"), F.lit(s).cast("long"), F.lit(n))
    ask = lambda *a: one(spark, V.check("claim_arithmetic", F.lit("x"), ctx(*a)))
    assert ask(117250, 53950 + 11625 + 51675, 3).verdict == "PASS"
    assert ask(117250, 50000 + 11625 + 51675, 3).detail == "lines sum 113300 != total 117250"
    assert ask(None, 1, 1).verdict == "INAPPLICABLE" and ask(1, None, 0).detail == "no line charges"
    assert table(spark, ["1172.50", "x", "", None, "1e400", "-3"], Y.cents)[:4] == [117250, None, None, None]


def parse(s):
    """A printed date, plainly."""
    parts = "".join(c if c in "0123456789" else " " for c in s).split()
    run = "".join(parts)
    if len(parts) == 3 and "".join(str(len(p)) for p in parts) in Y.PART_LENGTHS:
        m, d, y = parts
    elif len(run) in (6, 8):
        m, d, y = run[:2], run[2:4], run[4:]
    else:
        return None
    year = int(y) + (2000 if int(y) <= 26 else 1900) if len(y) == 2 else int(y)
    try:
        return date(year, int(m), int(d))
    except ValueError:
        return None


def test_printed_dates_over_a_grid(spark):
    values = [f"{m}{s}{d}{s}{y}" for m, d, y, s in itertools.product(("1", "02", "12", "13", "00"), ("1", "29", "31"), ("26", "27", "1999", "2024", "0000", "9"), ("", "/", " ", "--"))]
    assert table(spark, values, Y.printed_date) == [parse(v) for v in values]


def compare_date(s):
    d = "".join(c for c in s if c in "0123456789")
    for fmt in {6: ("%m%d%y",), 8: ("%Y%m%d", "%m%d%Y")}.get(len(d), ()):
        try:
            return datetime.strptime(d, fmt).strftime("%Y%m%d").zfill(8)
        except ValueError:
            pass
    return d


def test_compared_dates_over_a_grid(spark):
    values = [f"{a}{b}{c}" for a, b, c in itertools.product(("01", "12", "20", "19"), ("02", "29", "31", "68"), ("68", "69", "24", "1999", "0230", "2000"))]
    assert table(spark, values, Y.compared_date) == [compare_date(v) for v in values]


@pytest.mark.parametrize(
    "name, value, want",
    [
        ("patient_dob", "01/02/2001", "20010102"),
        ("total_charge", "$1,234.50", "1234.50"),
        ("total_charge", "0.125", "0.12"),
        ("total_charge", "1-2", "1-2"),
        ("diagnosis_1", "A12.3456", "A123456"),
        ("type_of_bill", "0117", "117"),
        ("line1_units", "1.0", "1"),
        ("line1_units", "100", "100"),
        ("line1_charges", "1500", "1500.00"),
        ("mystery_field", "03152024", "03152024"),
        ("units", None, ""),
    ],
)
def test_compared_values(spark, name, value, want):
    assert one(spark, Y.compared_value(F.lit(name), F.lit(value).cast("string"))) == want


def test_families(spark):
    assert table(spark, ["line1_date_from", "line2_charges", "line1_units", "line1_cpt_code", "provider_npi"], Y.family) == ["date", "money", "quantity", "text", "code"]


def test_text(spark):
    assert table(spark, ["Friedman， Jennifer", "Smith：John", "ﬁne ①", None, " x "], X.span_text) == ["Friedman, Jennifer", "Smith:John", unicodedata.normalize("NFKC", "ﬁne ①"), None, "x"]
    assert table(spark, [" A b C", None], X.norm) == ["abc", ""]
    assert table(spark, ["```json\n{\"a\": 1}\n```", " plain "], X.strip_fence) == ['{"a": 1}', "plain"]
    assert table(spark, ["a\r\nb", "a\nb"], X.stable_hash)[0] == table(spark, ["a\nb"], X.stable_hash)[0]
    assert table(spark, ["12a", "12", "ab", "-"], X.char_type) == ["mixed", "numeric", "alphabetic", "empty"]
    assert table(spark, ["Member name: ROE, JANE Q 123"], X.labelled) == [{"patient_name": "ROE, JANE Q"}]


def decide(spark, value, conf, fails=(), required=("r",), optional=False, flag=False, external=True, criticality="high", retries=0, escalations=0, preset="balanced"):
    accept, escalate, allow = D.PRESETS[preset]
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    lit = F.lit
    return one(spark, D.decide(lit(value), lit(conf), arr(fails), arr(required), lit(optional), lit(flag), lit(external), lit(criticality), lit(retries), lit(escalations), lit(accept), lit(escalate), lit(allow))).state


def test_routing_ladder(spark):
    assert decide(spark, "1", 0.95) == "ACCEPT" and decide(spark, "1", 0.99, ["r"]) == "RETRY"
    assert [decide(spark, "1", 0.4, ["r"], retries=a, escalations=b) for a, b in ((0, 0), (1, 0), (1, 1))] == ["RETRY", "ESCALATE", "HUMAN_REVIEW"]
    assert decide(spark, "", 0.0, optional=True) == "ACCEPT" and decide(spark, "", 0.0, ["r"], optional=True) == "ACCEPT"
    assert decide(spark, "", 0.0, ["r"]) == "RETRY"
    assert decide(spark, "x", 0.80, required=(), flag=True, criticality="low") == "ACCEPT_WITH_FLAG"
    assert decide(spark, "x", 0.80, required=(), flag=True, criticality="low", preset="accuracy") == "RETRY"
    assert decide(spark, "x", 0.5, external=False, retries=1) == "HUMAN_REVIEW"


def test_routing_over_a_grid(spark):
    grid = list(itertools.product(("", "v"), (0.3, 0.7, 0.95), (False, True), (False, True), (False, True), ("low", "high"), (0, 1), (0, 1)))
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(grid)], "i int, v string, c double, f boolean, o boolean, x boolean, k string, r int, e int")
    c, no = F.col, F.array().cast("array<string>")
    out = rows.select("i", D.decide(c("v"), c("c"), F.when(c("f"), F.array(F.lit("r"))).otherwise(no), F.array(F.lit("r")), c("o"), F.lit(True), c("x"), c("k"), c("r"), c("e"), F.lit(0.88), F.lit(0.6), F.lit(True))["state"].alias("s"))
    got = {r.i: r.s for r in out.collect()}
    for i, (v, conf, fail, optional, external, crit, retries, escal) in enumerate(grid):
        tolerable = conf >= 0.6 and crit != "high"
        rung = "RETRY" if retries < 1 else "ESCALATE" if external and escal < 1 else "ACCEPT_WITH_FLAG" if not fail and tolerable else "HUMAN_REVIEW"
        want = "ACCEPT" if not v and optional else rung if fail or not v else "ACCEPT" if conf >= 0.88 else "ACCEPT_WITH_FLAG" if tolerable else rung
        assert got[i] == want and got[i] in D.AUTOMATED


def test_grounding(spark):
    ask = lambda name, value, seen, optional=False, error="": one(spark, D.grounding_rejects(F.lit(name), F.lit(value), F.lit(seen), F.lit(optional), F.lit(error)))
    assert ask("patient_zip", "55456", "ZIP 55456") == [] and ask("patient_zip", "5545", "5545") == ["type mismatch: zip"]
    assert ask("x", "", "", True) == [] and ask("x", "", "") == ["empty value on a non-optional field"]
    assert ask("x", "abc", "") == ["no visible_text evidence supplied"] and ask("x", "abc", "abd") == ["ungrounded"]
    assert ask("x", "a", "a" * 121) == ["visible_text too long"] and ask("x", "a", "a", error="bad json") == ["unstructured: bad json"]


def test_fusion_and_merges(spark):
    rules = F.array(F.lit("currency_format"))
    assert one(spark, D.fuse(F.lit(1.0), F.lit(1.0), F.lit(1), F.lit("1.00"), rules)) == 1.0
    assert one(spark, D.span_sanity(F.lit(9))) == 0.2 and one(spark, D.charset_fit(F.lit(""), rules)) == 0.5
    m = one(spark, D.merge_retry(F.lit("A b"), F.lit(0.5), F.lit(True), F.lit("ab"), F.lit(0.7), F.lit(True)))
    assert m.decision == "agree" and abs(m.confidence - 0.8) < 1e-9 and m.value == "A b"
    assert one(spark, D.state_allowed(F.lit(D.OVERRIDE), F.lit(True), F.lit("me"), F.lit("")))is False


def test_candidates(spark):
    ask = lambda name, *t: one(spark, candidates.generate(F.lit(name), F.array(*map(F.lit, t))))
    assert ask("line1_charges", "$1,234", "50")[0] == "1234.50" and ask("total_charge", "6")[0] == "6.00"
    assert "012826" in ask("patient_dob", "01 28", "26") and "1" in ask("line1_units", "T")
    assert "1393521954" in ask("billing_provider_npi", "NPI: 1393521954x") and ask("line1_cpt_code", "a99213b") == ["a99213b", "a99213b", "99213"]


def test_policy_defaults(spark):
    rows = spark.createDataFrame([("line12_cpt_code",), ("patient_dob",), ("nothing",), ("cpt_code",)], "field_name string")
    got = {r.field_name: r for r in dims.with_policy(rows).collect()}
    assert got["line12_cpt_code"].validators == ["cpt_format", "cpt_dictionary"] and got["patient_dob"].criticality == "high"
    assert got["nothing"].criticality == got["cpt_code"].criticality == "med" and got["cpt_code"].validators == []


def test_span_text_equals_plain_python(spark):
    values = ["plain ascii ", "ﬁne ①", "Ａ１：２", "　x　", "é", "it’s “so”", None, "", "ß—–"]
    marks = str.maketrans(X.MARKS, X.PLAIN)
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", X.span_text(F.col("v")).alias("t")).collect()
    assert {r.k: r.t for r in rows} == {k: None if v is None else unicodedata.normalize("NFKC", v).translate(marks).strip() for k, v in enumerate(values)}


def test_the_double_answers_by_a_checksum(spark):
    import zlib

    from fieldrail.operators import oversight as O

    rows = [(f"d{k}", f"f{k % 3}", "clean", f"Value {k}") for k in range(400)]
    got = spark.createDataFrame(rows, "doc string, field string, tier string, truth string").withColumn("a", O.oracle_answer(F.col("doc"), F.col("field"), F.col("tier"), F.col("truth"))).collect()
    kinds = set()
    for r in got:
        roll, kind, edge = zlib.crc32(f"{r.doc}|{r.field}|{r.tier}".encode()) / 2**32, "right", 0.0
        for name, share in reversed(O.MIX):
            edge = sum(s for n, s in O.MIX[: [n for n, _ in O.MIX].index(name) + 1])
            if roll < edge:
                kind = name
        kinds.add(kind)
        assert r.a.kind == kind
        at = next((i for i, c in enumerate(r.truth) if c in O.CONFUSED), None)
        bad = r.truth[:at] + O.CONFUSION[O.CONFUSED.index(r.truth[at])] + r.truth[at + 1 :] if at is not None else r.truth[:-1]
        assert r.a.value == {"prose": "", "blank": "", "ungrounded": bad, "wrong": bad, "right": r.truth}[kind]
        assert r.a.visible == {"prose": "", "blank": "", "ungrounded": r.truth, "wrong": bad, "right": r.truth}[kind]
    assert len(kinds) == 5


def test_budgets_equal_a_plain_fold(spark):
    import random

    from fieldrail.streaming import ledger as stream

    r = random.Random(2)
    rows = [(f"s{r.randrange(4) // 2}", k, f"2026-01-01 00:{r.randrange(60):02d}:00", f"f{r.randrange(12)}", r.randrange(9) / 1000) for k in range(300)]
    calls = spark.createDataFrame(rows, "session string, call_id long, ts string, fingerprint string, cost_usd double").withColumn("ts", F.to_timestamp("ts"))
    want, state = {}, {}
    for s, k, _, f, usd in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        n, spent, seen = state.setdefault(s, [0, 0.0, set()])
        decision = "REUSED_CACHED_RESULT" if f in seen else "BLOCKED_CALL_COUNT" if n >= 5 else "BLOCKED_SESSION_BUDGET" if spent + usd > 0.02 else "ALLOW"
        if decision == "ALLOW":
            seen.add(f)
            state[s] = [n + 1, spent + usd, seen]
        want[k] = decision
    got = {x.call_id: x.decision for x in stream.budget_fold(calls).collect()}
    assert got == want and len(set(want.values())) >= 3
