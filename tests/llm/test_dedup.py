"""Near and substring duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldrail.llm.components import components
from fieldrail.llm.common import Scratch
from fieldrail.llm.minhash_dedup import bands_for, drop_near_duplicates, estimate, least_estimate, near_duplicates
from fieldrail.llm.substring_dedup import CELLS, remove_repeats, removal_report

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute_components(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(documents, corpus):
    for size, percent in ((3, 85), (5, 80)):
        got = near_duplicates(documents, size, percent).collect()
        assert len(got) == len(corpus)
        want = brute_components(corpus, size, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
        assert sum(r.component_id is None and r.kept for r in got) == 2  # null ids are linked with nothing


def test_drop_keeps_one_of_each_group_and_all_columns(documents, corpus):
    out = drop_near_duplicates(documents)
    want = brute_components(corpus, 5, 80)
    assert out.columns == documents.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([i for i, (_, c) in want.items() if i == c] + [None, None])


def test_outliers_link_with_members_that_are_not_the_pivot(spark):
    """0 - 1 and 0 - 2 are apart from 3, which only 2 reaches."""
    base = [f"w{i}" for i in range(100)]
    rows = [(0, base), (1, base[:99] + ["q"]), (2, base[:92] + [f"z{i}" for i in range(8)]), (3, base[:84] + [f"y{i}" for i in range(8)] + [f"z{i}" for i in range(8)])]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 80).items()}


def test_repeated_ids_and_empty_tables(spark, nothing):
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (2, "other words")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(twice, 3, 85).collect())
    assert got == [(1, 1), (1, 1), (2, 2), (2, 2)]
    assert near_duplicates(nothing).count() == 0 and removal_report(nothing).count() == 0 and remove_repeats(nothing).count() == 0


def test_report_and_drop_agree_on_ids_with_several_texts(spark):
    r = random.Random(12)
    a, b, c = prose(r, 40), prose(r, 40), prose(r, 40)
    rows = [(3, a), (7, a), (7, b), (9, b), (7, ""), (12, c), (12, ""), (20, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.n_shingles > 0, x.component_id, x.kept) for x in near_duplicates(docs).collect()}
    assert got == {(3, True, 3, True), (7, True, 3, False), (7, False, 3, False), (9, True, 3, False), (12, True, 12, True), (12, False, 12, True), (20, False, 20, True)}
    assert sorted(x.doc_id for x in drop_near_duplicates(docs).collect()) == [3, 12, 12, 20]


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9):
        assert (1 - threshold**4) ** bands_for(threshold) <= 1e-6
    assert bands_for(1.0) == 1
    for threshold in (0.0, 0.1):
        with pytest.raises(ValueError):
            bands_for(threshold)


def test_low_thresholds_equal_brute_force(spark):
    r = random.Random(31)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(24):
        words = list(base)
        for _ in range(k):
            words[r.randrange(60)] = f"v{r.random()}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(docs, 3, 50).collect()}
    assert got == brute_components(rows, 3, 50)


def test_estimates_are_near_the_similarity():
    r = np.random.default_rng(3)
    for s in (0.5, 0.8, 0.95):
        lanes = 1024
        same = r.random((50, lanes)) < s
        bits = [r.integers(0, 2, (50, lanes), dtype=np.uint8) for _ in range(4)]
        other = [np.where(same, bits[0], bits[2]), np.where(same, bits[1], bits[3])]
        pack = lambda two: np.concatenate([np.packbits(x, 1) for x in two], 1).view(np.uint64).view(np.int64)
        found = estimate(pack(bits[:2]), pack(other), lanes)
        assert abs(found.mean() - s) < 0.02 and (found >= least_estimate(s, lanes)).all()


def test_members_go_in_blocks_by_bytes(spark, monkeypatch, documents, corpus):
    monkeypatch.setattr("fieldrail.llm.minhash_dedup.BLOCK_BYTES", 2000)
    monkeypatch.setattr("fieldrail.llm.minhash_dedup.BLOCK", 3)
    got = near_duplicates(documents, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(corpus, 3, 85)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50)], "a long, b long")
    got = {r.v: r.label for r in components(edges, Scratch(spark), "chain").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 50, 50: 50}


def brute_removal(rows, size):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, w, gone))
    return out


def test_removal_equals_brute_force(documents, corpus):
    for size, cells in ((13, CELLS), (3, 1 << 12)):
        want = Counter((i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for i, w, g in brute_removal(corpus, size))
        assert Counter(tuple(r) for r in removal_report(documents, size, cells=cells).collect()) == want
        assert sum(k[2] for k in want)


def test_a_saturated_sketch_loses_nothing(documents, corpus):
    """With almost no cells all windows go through to the exact grouping."""
    want = Counter((i, sum(g)) for i, _, g in brute_removal(corpus, 13))
    assert Counter((r.doc_id, r.n_removed) for r in removal_report(documents, 13, cells=2).collect()) == want


def test_clean_texts_stay_byte_for_byte(documents, corpus):
    out = remove_repeats(documents, 13)
    assert out.columns == documents.columns and out.count() == len(corpus)
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    for i, w, gone in brute_removal(corpus, 13):
        if i is None:
            continue
        text = dict((a, b) for a, b in corpus if a is not None)[i]
        assert kept[i] == text if not any(gone) else WORD.findall(kept[i]) == [x for x, y in zip(w, gone) if not y]


def test_rows_of_one_id_do_not_remove_each_other(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = spark.createDataFrame([(5, text), (5, text + " more"), (9, "lead " + text)], "doc_id long, text string").repartition(1)
    assert sorted((r.doc_id, r.n_removed) for r in removal_report(rows, 13).collect()) == [(5, 0), (5, 0), (9, 20)]


def test_many_rows_without_an_id_pass_by(spark):
    r = random.Random(3)
    shared = prose(r, 40)
    rows = [(k, prose(r, 5) + " " + shared, "x") for k in range(4)] + [(None, shared, "y")] * 300 + [(None, None, "z")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    got = removal_report(docs, size=13).collect()
    assert len(got) == len(rows)
    loose = {(x.n_words, x.n_removed, x.kept_sha256) for x in got if x.doc_id is None}
    assert loose == {(40, 0, hashlib.sha256(" ".join(shared.split()).encode()).hexdigest()), (0, 0, hashlib.sha256(b"").hexdigest())}
    assert [x.n_removed for x in sorted((x for x in got if x.doc_id is not None), key=lambda x: x.doc_id)] == [0, 40, 40, 40]
    kept = remove_repeats(docs, size=13).collect()
    assert sum(x.text == shared and x.label == "y" for x in kept) == 300 and sum(x.label == "z" and x.text is None for x in kept) == 5
