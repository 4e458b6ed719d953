"""Authorization with memory: the stream, the table and a plain fold."""

import random
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from fieldrail.functions import policy as P
from fieldrail.streaming import authorization as A

SCHEMA = "session long, seq long, kind string, call_id long, fingerprint string, doc string, page string, field string, blocked string, billed_usd double, called boolean"


def events(seed, sessions=8, calls=30):
    r, out, k = random.Random(seed), [], 0
    for s in range(sessions):
        seq = 0
        for _ in range(calls):
            k += 1
            key = (f"f{r.randrange(14)}", f"d{r.randrange(4)}", f"p{r.randrange(2)}", f"n{r.randrange(3)}")
            seq += 4
            out.append((s, seq, "request", k, *key, r.choice([None] * 9 + ["BLOCKED_NO_API_KEY"]), None, None))
            if r.random() < 0.97:
                out.append((s, seq + r.choice([1, 1, 5, 9]) + 2 * r.random().__trunc__(), r.choice(["complete"] * 4 + ["release"]), k, *key, None, r.choice([None, 0.0, 0.001, 0.004, 0.009]), r.random() < 0.8))
    # a session's events have places of their own
    out.sort(key=lambda e: (e[0], e[1], e[2] == "request", e[3]))
    return [(e[0], n, *e[2:]) for n, e in enumerate(out)]


def plain(rows, limits, reuse):
    state, out = {}, {}
    for s, seq, kind, call, fp, doc, page, field, blocked, billed, called in rows:
        m = state.setdefault(s, {"fly": None, "done": []})
        if kind != "request":
            if m["fly"] and m["fly"][0] == call:
                if kind == "complete":
                    usd = billed if billed is not None else limits["document_usd"] if called else 0.0
                    m["done"].append((*m["fly"], usd))
                m["fly"] = None
            continue
        done = m["done"]
        old = next((x for x in done if x[1] == fp), None)
        of = lambda n: [x for x in done if x[2 : 2 + n] == (doc, page, field)[:n]]
        usd = lambda some: reduce(add, (x[5] for x in some), 0.0)  # noqa: E731  (sum() would compensate)
        if blocked:
            got = (blocked, None, None)
        elif old:
            got = ("REUSED_CACHED_RESULT" if reuse else "BLOCKED_DUPLICATE_REQUEST", old[0], old[5])
        elif m["fly"]:
            got = ("BLOCKED_PARALLEL_CALL", None, None)
        else:
            checks = [
                (sum(x[5] > 0 for x in of(3)), "paid_per_field", "BLOCKED_FIELD_PAID_ATTEMPTS"), (len(of(3)), "per_field", "BLOCKED_FIELD_CALL_LIMIT"), (len(of(2)), "per_page", "BLOCKED_PAGE_CALL_LIMIT"),
                (len(of(1)), "per_document", "BLOCKED_DOCUMENT_CALL_LIMIT"), (len(done), "per_batch", "BLOCKED_BATCH_CALL_LIMIT"), (usd(done), "session_usd", "BLOCKED_SESSION_BUDGET"), (usd(of(1)), "document_usd", "BLOCKED_DOCUMENT_BUDGET"),
            ]
            got = (next((d for used, name, d in checks if used >= limits[name]), "ALLOW"), None, None)
            if got[0] == "ALLOW":
                m["fly"] = (call, fp, doc, page, field)
        out[s, seq] = (call, *got)
    return out


def rows_of(frame):
    return {(x.session, x.seq): (x.call_id, x.decision, x.reused_from, x.avoided_usd) for x in frame.collect()}


def test_table_equals_a_plain_fold(spark):
    seen = set()
    for seed, limits, reuse in ((1, P.LIMITS, True), (2, P.LIMITS | {"per_field": 2, "per_page": 9, "per_document": 2, "per_batch": 30, "document_usd": 0.5, "session_usd": 5.0}, False), (3, P.LIMITS | {"per_batch": 2, "document_usd": 0.5, "per_document": 50}, True), (4, P.LIMITS | {"per_page": 50, "per_document": 50, "per_batch": 50, "session_usd": 0.2}, True)):
        rows = events(seed)
        want = plain(rows, limits, reuse)
        assert rows_of(A.authorize_table(spark.createDataFrame(rows, SCHEMA).repartition(3), limits, reuse)) == want
        seen |= {w[1] for w in want.values()}
    assert seen >= {"ALLOW", "REUSED_CACHED_RESULT", "BLOCKED_DUPLICATE_REQUEST", "BLOCKED_PARALLEL_CALL", "BLOCKED_FIELD_PAID_ATTEMPTS", "BLOCKED_FIELD_CALL_LIMIT", "BLOCKED_PAGE_CALL_LIMIT", "BLOCKED_DOCUMENT_CALL_LIMIT", "BLOCKED_BATCH_CALL_LIMIT", "BLOCKED_SESSION_BUDGET", "BLOCKED_DOCUMENT_BUDGET", "BLOCKED_NO_API_KEY"}


def test_stream_equals_the_table(spark, tmp_path):
    rows = events(7, sessions=5, calls=24)
    frame = spark.createDataFrame(rows, SCHEMA)
    cut = rows[-1][1] // 3
    for k in range(4):  # micro-batches in the order of places
        frame.filter((F.col("seq") >= k * cut) & (F.col("seq") < (k + 1) * cut)).coalesce(1).write.json(str(tmp_path / "in" / f"b={k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "b=*"))
        q = A.authorize_stream(source).writeStream.format("memory").queryName("decisions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert rows_of(spark.table("decisions")) == rows_of(A.authorize_table(frame)) == plain(rows, P.LIMITS, True)


def test_no_events(spark):
    assert A.authorize_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_static_gates_and_charges(spark):
    row = dict(enabled=True, adapter=True, test_flag=True, key="k", synthetic=True, crop_refusal=None, model="a/b", listed=True, vision=True)
    bad = [({}, None), ({"enabled": False, "key": ""}, "BLOCKED_LIVE_PATH_DISABLED"), ({"adapter": False}, "BLOCKED_ADAPTER_DISABLED"), ({"test_flag": False}, "BLOCKED_LIVE_TEST_FLAG_UNSET"), ({"key": " "}, "BLOCKED_NO_API_KEY"), ({"synthetic": False}, "BLOCKED_NOT_SYNTHETIC"),
           ({"crop_refusal": "x"}, "BLOCKED_NOT_A_CROP"), ({"model": "x:free", "listed": False}, "BLOCKED_MODEL_REFUSED"), ({"listed": False}, "BLOCKED_MODEL_NOT_ALLOWLISTED"), ({"vision": None}, "BLOCKED_MODEL_NOT_VISION")]
    frame = spark.createDataFrame([{**row, **b, "want": w} for b, w in bad], "enabled boolean, adapter boolean, test_flag boolean, key string, synthetic boolean, crop_refusal string, model string, listed boolean, vision boolean, want string")
    assert all(x.got == x.want for x in frame.select("want", P.static_gate({c: F.col(c) for c in row}).alias("got")).collect())
    money = spark.createDataFrame([(None, True), (None, False), (None, None), (0.25, True), (0.0, True)], "b double, c boolean").select(P.charge(F.col("b"), F.col("c")).alias("x")).collect()
    assert [m.x for m in money] == [0.005, 0.0, 0.0, 0.25, 0.0]
    crops = spark.createDataFrame([(None,), (0.25,), (0.26,)], "f double").select(P.crop_refusal(F.col("f")).alias("x")).collect()
    assert [c.x is None for c in crops] == [False, True, False]
