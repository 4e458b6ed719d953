"""The filter audit against a plain walk through every order, row by row."""

import random
import re
from itertools import permutations

import numpy as np

from fieldrail.llm import filter_audit as A

from .conftest import prose

NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows, k):
    i, text, _ = rows[k]
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    out = ""
    out += "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text or "")) > 3 * len(text or "") else ""
    out += "D" if re.search(r"[#$%&*|]", text or "") else ""
    out += "E" if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows) else ""
    return out


def plain(rows, good, toxic):
    found = {}
    failed = [fails(rows, k) for k in range(len(rows))]
    for part in {p or "" for _, _, p in rows}:
        mine = [k for k in range(len(rows)) if (rows[k][2] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(mine)
            for s, f in enumerate(order, 1):
                hit = {k for k in mine if f in failed[k]}
                out = hit & left
                left -= out
                share[f] += len(out)
                lost = [sum(rows[k][0] in ids for k in out) for ids in (good, toxic)]
                found[part, "".join(order), s] = [len(left), len(out), len(hit - out), sum(failed[k] == f for k in mine), *lost]
        for part_, order, s in [k for k in found if k[0] == part]:
            found[part_, order, s].append(share[order[s - 1]])
    return found


def test_audit_equals_a_plain_walk(spark):
    r = random.Random(3)
    base = [prose(r, n) for n in (20, 199, 200, 260, 300)] + ["a b " * 150, "Ab CD " + prose(r, 210), "x # y", "", None, "ÄÖÜ ß"]
    rows = [(i, r.choice(base), r.choice(["en", "de", "", None])) for i in range(90)]
    rows += [rows[5], rows[5], (None, base[2], "en"), (None, None, None), (200, base[3], "zz"), (200, base[4], "zz")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    good, toxic = ({row[0] for row in labels if row[0] is not None and row[k] == 1} for k in (1, 2))
    docs = spark.createDataFrame([(*x, "clash", 7) for x in rows], "doc_id long, text string, lang string, part string, n long").repartition(3)
    got = A.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain(rows, good, toxic)
    assert len(got) == len(want) == 600 * 4
    for x in got:
        assert [x[n] for n in NAMES] == want[x.part, x.filter_order, x.step]


def test_audit_of_nothing(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(nothing.selectExpr("*", "'en' as lang"), none).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    got = A.filter_audit(one, none).collect()
    assert len(got) == 600 and {x.part for x in got} == {""} and all(x.kept == (0 if "A" in x.filter_order[: x.step] else 1) for x in got)


def test_matrices_by_definition():
    found = A.incidence("AB")
    assert A.steps("AB") == [("AB", 0), ("AB", 1), ("BA", 0), ("BA", 1)]
    assert found["kept"].tolist() == [[1, 1, 1, 1], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]]
    assert found["removed"].tolist() == [[0, 0, 0, 0], [1, 0, 0, 1], [0, 1, 1, 0], [1, 0, 1, 0]]
    assert found["redundant"].tolist() == [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 1, 0, 1]]
    assert found["unique_fails"].tolist() == [[0, 0, 0, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 0, 0, 0]]
    assert all(m.shape == (32, 600) and np.issubdtype(m.dtype, np.integer) for m in A.incidence().values())
