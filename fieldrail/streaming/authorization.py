"""Authorization of paid calls with its memory: a stream by keyed state, and the same over a whole table.

Events of a session come in the order of ``seq``: a request, and later the completion of its call (``complete``, with what
it cost) or its end without a call (``release``). A request is decided by what was completed before it. An allowed one
is in flight until its end; only completed calls count. Ends of calls that weren't allowed change nothing.

(session, seq, kind, call_id, fingerprint, doc, page, field, blocked, billed_usd, called): ``blocked`` is the decision of
the gates that need no memory (policy.static_gate), or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.policy import LIMITS, charge, counted_gates
from ..sources.scratch import put

DECIDED = "session long, seq long, call_id long, decision string, reused_from long, avoided_usd double"


class Authorizer(StatefulProcessor):
    """Counters by field, page and document, what was answered, the call in flight, and the session's totals."""

    def __init__(self, limits: dict[str, float], reuse: bool) -> None:
        self.limits, self.reuse = limits, reuse

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "calls long, usd double")
        self.flying = handle.getValueState("flying", "call_id long, fingerprint string, doc string, page string, field string")
        self.used = handle.getMapState("used", "doc string, page string, field string", "calls long, paid long, usd double")
        self.answered = handle.getMapState("answered", "fingerprint string", "usd double, call_id long")

    def _used(self, *key: str) -> tuple[int, int, float]:
        key = (*key, *("",) * (3 - len(key)))
        return self.used.getValue(key) if self.used.containsKey(key) else (0, 0, 0.0)

    def _book(self, flying: tuple, usd: float) -> None:
        _, fingerprint, doc, page, field = flying
        for key in ((doc, "", ""), (doc, "p:" + page, ""), (doc, "p:" + page, "f:" + field)):
            calls, paid, spent = self._used(*key)
            self.used.updateValue(key, (calls + 1, paid + (usd > 0), spent + usd))
        calls, spent = self.total.get() if self.total.exists() else (0, 0.0)
        self.total.update((calls + 1, spent + usd))
        self.answered.updateValue((fingerprint,), (usd, flying[0]))

    def _decide(self, row: object) -> tuple[str, int | None, float | None]:
        if isinstance(row.blocked, str):
            return row.blocked, None, None
        if self.answered.containsKey((row.fingerprint,)):
            usd, call = self.answered.getValue((row.fingerprint,))
            return "REUSED_CACHED_RESULT" if self.reuse else "BLOCKED_DUPLICATE_REQUEST", int(call), float(usd)
        if self.flying.exists():
            return "BLOCKED_PARALLEL_CALL", None, None
        most = self.limits
        page, field = "p:" + row.page, "f:" + row.field
        of_field, of_page, of_doc = self._used(row.doc, page, field), self._used(row.doc, page), self._used(row.doc)
        calls, usd = self.total.get() if self.total.exists() else (0, 0.0)
        for used, name, decision in (
            (of_field[1], "paid_per_field", "BLOCKED_FIELD_PAID_ATTEMPTS"),
            (of_field[0], "per_field", "BLOCKED_FIELD_CALL_LIMIT"),
            (of_page[0], "per_page", "BLOCKED_PAGE_CALL_LIMIT"),
            (of_doc[0], "per_document", "BLOCKED_DOCUMENT_CALL_LIMIT"),
            (calls, "per_batch", "BLOCKED_BATCH_CALL_LIMIT"),
            (usd, "session_usd", "BLOCKED_SESSION_BUDGET"),
            (of_doc[2], "document_usd", "BLOCKED_DOCUMENT_BUDGET"),
        ):
            if used >= most[name]:
                return decision, None, None
        self.flying.update((row.call_id, row.fingerprint, row.doc, row.page, row.field))
        return "ALLOW", None, None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out = []
            for row in frame.sort_values("seq").itertuples():
                if row.kind == "request":
                    out.append((key[0], row.seq, row.call_id, *self._decide(row)))
                elif self.flying.exists() and self.flying.get()[0] == row.call_id:
                    if row.kind == "complete":
                        self._book(self.flying.get(), float(row.charged))
                    self.flying.clear()
            yield pd.DataFrame(out, columns=["session", "seq", "call_id", "decision", "reused_from", "avoided_usd"]).astype({"reused_from": "Int64", "avoided_usd": "float64"})

    def close(self) -> None:
        pass


def authorize_stream(events: DataFrame, limits: dict[str, float] = LIMITS, reuse: bool = True) -> DataFrame:
    """Decisions of a stream of events; within a batch a session's events are put in order."""
    rows = events.withColumn("charged", charge(F.col("billed_usd"), F.col("called"), limits))
    return rows.groupBy("session").transformWithStateInPandas(Authorizer(limits, reuse), DECIDED, "append", "none")


def _known(some: Column, limits: dict[str, float]) -> dict[str, Column]:
    """What counts for a request, of the calls that were completed before it."""
    c = F.col
    same = {
        "field": F.filter(some, lambda x: (x["doc"] == c("doc")) & (x["page"] == c("page")) & (x["field"] == c("field"))),
        "page": F.filter(some, lambda x: (x["doc"] == c("doc")) & (x["page"] == c("page"))),
        "document": F.filter(some, lambda x: x["doc"] == c("doc")),
    }
    usd = lambda of: F.aggregate(of, F.lit(0.0), lambda s, x: s + x["charged"])
    counts = {f"calls_{k}": F.size(of) for k, of in same.items()} | {"calls_batch": F.size(some), "session_usd": usd(some), "document_usd": usd(same["document"])}
    return counts | {"paid_field": F.size(F.filter(same["field"], lambda x: x["charged"] > 0))}


def authorize_table(events: DataFrame, limits: dict[str, float] = LIMITS, reuse: bool = True) -> DataFrame:
    """The same decisions over a whole table.

    A round finds each session's next request that all gates let pass, by an aggregate, until no session has one: as many rounds
    as calls are allowed in a session (the batch limit, and those that were released). Then every request is decided
    by its session's allowed calls. No task takes a session's events, and rounds are written tables.
    """
    c = F.col
    ends = events.filter("kind != 'request'").select("session", "call_id", c("seq").alias("done"), (c("kind") == "complete").alias("booked"), charge(c("billed_usd"), c("called"), limits).alias("charged"))
    asked = events.filter("kind = 'request'").select("session", "seq", "call_id", "fingerprint", "doc", "page", "field", "blocked")
    both = asked.join(ends, ["session", "call_id"], "left").filter("done is null or done > seq")
    # a call that ended only before it was asked for isn't ended
    first = both.groupBy("session", "call_id", "seq").agg(F.min_by(F.struct("done", "booked", "charged"), "done").alias("end"))
    requests = put(asked.join(first, ["session", "call_id", "seq"], "left").select(*asked.columns, "end.*"), "requests")
    call = F.struct("seq", "done", F.coalesce("booked", F.lit(False)).alias("booked"), "charged", "call_id", "fingerprint", "doc", "page", "field")
    kind = requests.select(call.alias("x")).schema["x"].dataType.simpleString()
    state = requests.filter("blocked is null").select("session").distinct().withColumns({"allowed": F.array().cast(f"array<{kind}>"), "more": F.lit(True)})
    while True:
        last = F.get("allowed", F.size("allowed") - 1)
        free = F.coalesce(last["seq"].isNull() | (c("seq") > last["done"]), F.lit(False))
        counts = F.filter("allowed", lambda x: x["booked"])
        new = ~F.exists(counts, lambda x: x["fingerprint"] == c("fingerprint"))
        passes = free & new & counted_gates(_known(counts, limits), limits).isNull()
        found = requests.filter("blocked is null").join(state.filter("more").select("session", "allowed"), "session").filter(passes).groupBy("session").agg(F.min_by(call, "seq").alias("next"))
        joined = state.join(found, "session", "left")
        grown = F.when(c("next").isNotNull(), F.concat("allowed", F.array("next"))).otherwise(c("allowed"))
        state = put(joined.select("session", grown.alias("allowed"), c("next").isNotNull().alias("more")), "allowed")
        if not state.filter("more").limit(1).count():
            break
    rows = requests.join(state.select("session", "allowed"), "session", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast(f"array<{kind}>")))
    rows = rows.withColumn("before", F.filter("allowed", lambda x: x["booked"] & (x["done"] < c("seq"))))
    own = F.exists("allowed", lambda x: x["seq"] == c("seq"))
    seen = F.get(F.filter("before", lambda x: x["fingerprint"] == c("fingerprint")), F.lit(0))
    flying = F.exists("allowed", lambda x: (x["seq"] < c("seq")) & (x["done"].isNull() | (x["done"] > c("seq"))))
    repeated = c("blocked").isNull() & seen.isNotNull()
    decision = (
        F.when(c("blocked").isNotNull(), c("blocked"))
        .when(seen.isNotNull(), "REUSED_CACHED_RESULT" if reuse else "BLOCKED_DUPLICATE_REQUEST")
        .when(own, "ALLOW")
        .when(flying, "BLOCKED_PARALLEL_CALL")
        .otherwise(counted_gates(_known(c("before"), limits), limits))
    )
    return rows.select("session", "seq", "call_id", decision.alias("decision"), F.when(repeated, seen["call_id"]).alias("reused_from"), F.when(repeated, seen["charged"]).alias("avoided_usd"))
