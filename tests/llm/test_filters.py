"""Toxicity, decontamination and URL rules."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from fieldrail.llm import decontaminate as D
from fieldrail.llm import kernels as K
from fieldrail.llm import toxicity as X
from fieldrail.llm import url_filter as U

from .conftest import prose


def labelled(n=900, seed=2):
    """Every fourth text has toxic words, some of them misspelt by a suffix."""
    r = random.Random(seed)
    bad = ["zqlorm", "vexpit", "kwurg"]
    rows = []
    for i in range(n):
        words = prose(r, r.randint(20, 120)).split()
        if i % 4 == 0:
            for _ in range(max(1, len(words) // 15)):
                words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "s", "ix", "."])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity_learns_and_holds_out(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(5000, None, "en"), (5001, "", "de"), (None, "zqlorm", "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = X.toxicity_report(docs, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    empty = [r.score for r in got if r.doc_id in (5000, 5001)]
    assert empty[0] == empty[1]
    kept = {r.doc_id for r in X.reject_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if r.score < 0.5}


def test_unseen_misspellings_share_ngrams(spark):
    rows = labelled()
    model = X.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    clean = rows[1][1]
    texts = [clean, clean + " zqlormed zqlorming vexpits! vexpitting", clean + " orders others themes"]
    s = X.scores(*K.texts(pa.array(texts)), model.weight, model.bias)
    assert s[1] > 0.5 > s[2] and s[0] < 0.5


def test_gradients_equal_differences():
    """Against plain differences of the loss, one parameter at a time."""
    r = np.random.default_rng(4)
    table, soft, bias = r.normal(size=(7, 3)), r.normal(size=(3, 2)), r.normal(size=2)
    index, row, labels = r.integers(0, 7, 20), np.sort(r.integers(0, 4, 20)), np.array([0, 1, 1, 0])
    x = r.random(20)

    def loss():
        mean = np.zeros((4, 3))
        for i, t, v in zip(index, row, x):
            mean[t] += v * table[i]
        logit = mean @ soft + bias
        cost = [-(z[y] - np.log(np.exp(z).sum())) * (2.0 if y else 1.0) for z, y in zip(logit, labels)]
        return sum(cost) / 4

    found = X.gradients(table, soft, bias, index, x, row, labels, 2.0)
    for value, grad in zip((table, soft, bias), found):
        for at in np.ndindex(value.shape):
            kept, sides = value[at], []
            for step in (1e-6, -1e-6):
                value[at] = kept + step
                sides.append(loss())
            value[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-6 - grad[at]) < 1e-6


def test_features_of_few_texts_are_left_out():
    bag = lambda *b: (np.array(b, np.uint32).tobytes(), np.full(len(b), 2, np.uint16).tobytes())
    used, texts, places, counts, first = X.kept_features([bag(3, 9), bag(3), bag(3, 5), bag()])
    assert used.tolist() == [3] and texts.tolist() == [3] and places.tolist() == [0, 0, 0] and counts.tolist() == [2, 2, 2]
    assert first.tolist() == [0, 1, 2, 3, 3]


def plain_bag(text):
    """{bucket: times}, sum of squared times: words and n-grams one by one."""
    words = [w for w in re.split(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.encode()) if w]
    low = Counter(bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words)
    found, spread = Counter(), 0
    for w, n in low.items():
        h = int(K.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        keys = [h >> (64 - X.BITS)]
        ringed = b" " + w + b" "
        for g in X.GRAMS:
            factors = [(int(f) >> 32) | 1 for f in K.seeds(40 + g, g)]
            for i in range(len(ringed) - g + 1):
                h = sum((c + 1) * f for c, f in zip(ringed[i : i + g], factors)) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                h = ((h ^ (h >> 13)) * 0x297A2D39) & 0xFFFFFFFF
                keys.append(h >> (32 - X.BITS))
        for k in keys:
            found[k] += n
        spread += len(keys) * n * n
    return found, spread


def test_scores_equal_a_plain_softmax():
    r = random.Random(8)
    texts = [prose(r, n) for n in (1, 5, 40, 300)] + ["", "a", "Ab ab AB", "é éé ñandú", "x" * 40 + " y!z", "0 00 000 0000 00000"]
    weight, bias = np.random.default_rng(3).normal(size=1 << X.BITS).astype(np.float32), -0.7
    got = X.scores(*K.texts(pa.array(texts)), weight, bias)
    made = next(X._features(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], ["id", "label", "text"])])))
    for i, text in enumerate(texts):
        bag, spread = plain_bag(text)
        logit = sum(float(weight[k]) * n for k, n in bag.items()) / (5 * (1 + spread) ** 0.5)
        clean, toxic = np.exp([0.0, bias + logit])
        assert abs(got[i] - toxic / (clean + toxic)) < 1e-6
        held = dict(zip(np.frombuffer(made.column(2)[i].as_py(), np.uint32).tolist(), np.frombuffer(made.column(3)[i].as_py(), np.uint16).tolist()))
        assert held == dict(bag) and made.column(4)[i].as_py() == spread


def test_more_steps_never_make_the_fit_worse():
    """Where training ends doesn't decide whether clean texts are rejected: the loss falls from step to step."""
    rows = labelled(400)
    buf, offsets = K.texts(pa.array([t for _, t, _ in rows]))
    batch = pa.RecordBatch.from_arrays([pa.array([c[k] for c in rows]) for k in (0, 2, 1)], ["id", "label", "text"])
    made = next(X._features(iter([batch]))).to_pydict()
    labels, bags = np.array(made["label"]), list(zip(made["buckets"], made["counts"]))
    losses = []
    for steps in (2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 25, 32, 40, 60):
        model = X.fit(list(bags), labels, np.array(made["spread"]), steps=steps)
        p = np.clip(X.scores(buf, offsets, model.weight, model.bias), 1e-9, 1 - 1e-9)
        losses.append(float(np.where(labels == 1, -6 * np.log(p), -np.log(1 - p)).mean()))
    assert all(b <= a + 1e-3 for a, b in zip(losses, losses[1:])), losses
    assert losses[-1] < 0.2 * losses[0]


def test_rare_toxic_words_in_long_texts_are_found(spark):
    """One word in sixty is toxic, whatever the length; held-out rows count."""
    r, rows = random.Random(5), []
    bad = ["zqlorm", "vexpit", "kwurg", "blathu"]
    for i in range(700):
        words = prose(r, r.choice((30, 80, 250, 900))).split()
        if i % 6 == 0:
            for _ in range(max(1, len(words) // 60)):
                words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    got = X.toxicity_report(spark.createDataFrame([(*x[:2], 1, 2) for x in rows], "doc_id long, text string, held_out int, predicted int"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()
    held = [(rows[x.doc_id][2], x.predicted) for x in got if x.held_out]
    assert sum(y and p for y, p in held) >= 0.85 * sum(y for y, _ in held) and sum(p and not y for y, p in held) <= 1


def test_repeated_ids_and_long_texts_are_scored(spark):
    rows = labelled(200)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, rows[0][1]), (900, "word " * 200_000)], "doc_id long, text string")
    got = X.toxicity_report(docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(4, 0), (4, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == 202 and sum(r.doc_id == 1 for r in got) == 2
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 2


def test_held_out_labels_are_never_read(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    a = X.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = X.train(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_toxicity_without_labels(spark, nothing):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in X.toxicity_report(docs, none).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    many = spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string")
    assert all(r.score == 1.0 for r in X.toxicity_report(many, ones).collect())
    assert X.toxicity_report(nothing, none).count() == 0


def edit_distance_in(item, text):
    """The least word edit distance between item and a stretch of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def words(text):
    out = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or ""))
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in out.split()]


def leaky():
    r = random.Random(8)
    items = [(k, prose(r, r.randint(12, 40))) for k in range(25)] + [(90, "one two"), (91, ""), (92, None), (93, "single")]
    docs = []
    for k in range(120):
        w = prose(r, 60).split()
        if k % 2:
            item = items[k % 25][1].split()
            for _ in range(k % 9):  # from exact copies to too many edits
                p = r.randrange(len(item))
                kind = r.randrange(3)
                if kind == 0 and len(item) > 1:
                    del item[p]
                elif kind == 1:
                    item.insert(p, f"ins{k}")
                else:
                    item[p] = f"sub{k}"
            at = r.randrange(60)
            w[at:at] = [x.upper() if k % 5 == 0 else x for x in item]
        docs.append((k, " ".join(w)))
    return items, docs + [(200, "one, two!"), (201, None), (202, ""), (None, items[0][1]), (203, "one x two"), (204, "a SINGLE.")]


def test_leaks_equal_brute_force(spark):
    items, docs = leaky()
    want = {}
    for i, t in docs:
        for k, q in items:
            if i is not None and words(q):
                d = edit_distance_in(words(q), words(t))
                if d <= len(words(q)) // 5:
                    want[i, k] = d
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = D.leaked(table, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.edits for r in found.collect()}
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 0.02 * len(want)
    assert all(got[k] <= len(words(dict(items)[k[1]])) // 5 and got[k] >= want[k] for k in got)
    assert {k for k, d in want.items() if d == 0} <= set(got) and any(want[k] > 0 for k in got)
    kept = {r.doc_id for r in D.drop_leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_items_in_several_blocks(spark, monkeypatch, nothing):
    items, docs = leaky()
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in D.leaked(table, bench).select("doc_id", "item_id").collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 1500)
    parts = {tuple(r) for r in D.leaked(table, bench).select("doc_id", "item_id").collect()}
    assert len(whole ^ parts) <= 0.03 * len(whole)
    assert D.leaked(nothing, bench).count() == 0
    assert D.leaked(table, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_recall_at_the_edit_limit_and_chance_matches():
    r = random.Random(1)
    items = D.build(list(range(60)), [prose(r, n) for n in (*range(3, 60), 90, 200, 400)])
    assert len(items.effort) > 20 and max(items.effort.values()) < D.NO_KEYS
    for kind, k in items.effort.items():
        assert D.recall([w for w in items.words if D.length_class(np.array(len(w))) == kind], D.EFFORTS[k])[kind] >= D.TARGET - 0.03
    assert D.recall([], D.EFFORTS[0]) == {}
    other, _ = D.words_of(*K.texts(pa.array([prose(r, 5000)])))
    for w in items.words:
        if len(w) >= 20:
            assert D.chance([w], D.EFFORTS[items.effort[int(D.length_class(np.array(len(w))))]], other) <= 0.15


def test_long_items_are_found():
    r = random.Random(3)
    item = prose(r, 20_000)
    copy = item.split()
    for _ in range(300):
        copy[r.randrange(len(copy))] = f"s{r.random()}"
    copy[2000:2050] = ["cut"]
    copy[:300] = ["lost"] * 200
    texts = [prose(r, 3000) + " " + " ".join(copy) + " " + prose(r, 2000), prose(r, 25_000)]
    items = D.build([5], [item])
    found = D.leaks(*K.texts(pa.array(texts)), items)
    assert [(t, i) for t, i, _ in found] == [(0, 0)] and 0 < found[0][2] <= D.allowed(20_000)


def test_lengths_that_keys_cannot_reach_are_compared_without(monkeypatch):
    monkeypatch.setattr(D, "TARGET", 1.1)
    r = random.Random(7)
    text = prose(r, 30)
    items = D.build([1], [text])
    assert list(items.effort.values()) == [D.NO_KEYS]
    w = text.split()
    w[5:6] = []
    w[20] = "other"
    docs = [prose(r, 20) + " " + " ".join(w), prose(r, 60)]
    assert [(t, d) for t, _, d in D.leaks(*K.texts(pa.array(docs)), items)] == [(0, 2)]


def test_a_seed_of_the_promised_length_survives():
    r = np.random.default_rng(2)
    for n in range(1, 80):
        item = np.arange(1000, 1000 + n, dtype=K.U64)
        g = D.seed_length(n)
        for _ in range(20):
            copy = D._edited(item, D.allowed(n), r)
            grams = {tuple(copy[i : i + g]) for i in range(len(copy) - g + 1)}
            assert grams & {tuple(item[i : i + g]) for i in range(n - g + 1)}


RULED = [
    ("https://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://a.example.net/de/1", "a.example.net", "/de/1", "net/", "block"),
    ("http://Example.COM/de/x?q#f", "example.com", "/de/x", "example.com/de/", "block"),
    ("x://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("http://my.org/fr/y#/z", "my.org", "/fr/y", "org/fr/", "allow"),
]
FREE = [
    ("http://notexample.com/de/x", "notexample.com", "/de/x"),
    ("http://b.net?x=/en/", "b.net", ""),
    ("ftp://a://b/c", "a:", "//b/c"),
    ("no scheme", "", ""),
    (None, "", ""),
    ("", "", ""),
    ("http://", "", ""),
    ("http://ÄB.org/FR/", "Äb.org", "/FR/"),
    ("http://a.org\n/fr/", "a.org\n", "/fr/"),
]


def test_url_rules(spark, nothing):
    rows = [(k, u, "<p>thing word</p>", "z") for k, (u, *_) in enumerate(RULED + FREE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in U.judge(pages).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(RULED):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict)
    for k, (_, host, path) in enumerate(FREE, len(RULED)):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, None) and got[k].verdict in ("allow", "block")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert U.judge(none).count() == 0
    free = spark.createDataFrame([(1, "http://x.dev/", None)], "page_id long, url string, html string")
    assert [r.verdict for r in U.judge(free).collect()] == ["allow"]


def test_viterbi_equals_all_splits():
    counts = {"the": 50, "them": 10, "me": 20, "memo": 5, "mo": 8, "art": 9, "a": 30, "part": 12, "p": 1}
    s = U.Segmenter(counts)

    def cost(parts):
        return sum(s.cost.get(w, s.unknown + 2.3 * len(w)) for w in parts)

    def splits(name):
        return [[name]] if len(name) < 2 else [[name]] + [[name[:i], *rest] for i in range(1, len(name)) for rest in splits(name[i:])]

    for name in ("thememo", "apart", "themart", "xzthe", "p", ""):
        assert abs(cost(s.split(name)) - min(map(cost, splits(name)))) < 1e-9 if name else s.split(name) == []
        assert "".join(s.split(name)) == name


def test_bayes_follows_its_counts():
    model = U.Bayes({"h:good": (90, 1), "h:bad": (1, 90), "p:0": (50, 50)}, (100, 100))
    assert model.blocks(["h:bad", "p:0"])[1] and not model.blocks(["h:good", "p:0"])[1]
    assert not U.Bayes({}, (5, 0)).blocks(["h:bad"])[1] and U.Bayes({}, (0, 5)).blocks([])[1]


def test_url_models_are_whole(spark):
    """More words and tokens than any bound, each seen once, against the formulas over all of them."""
    letters = "bcdfghjklmnpqrst"
    rare = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters][:60_000]
    parts = [f"x{w}{k}y" for w in rare[:52_000] for k in "abcd"]
    urls = ["http://a.net/" + "/".join(parts[::2]), "http://example.net/en/" + "/".join(parts[1::2]), "http://example.net/en/" + parts[0]]
    names = [rare[0] + rare[59_999], rare[7] + "the" + rare[5], "the", "7the42"]
    urls += [f"http://{n}.dev/{p}" for n, p in zip(names, (parts[1], parts[0], parts[-1] + "/" + parts[2], "none/None"))]
    urls += [f"http://{names[0]}.org/fr/", None, urls[3]]
    pages = [(k, u, "<p>" + " ".join(rare) + " the the</p>" if k == 0 else "<p>The net</p>") for k, u in enumerate(urls)]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    words = dict.fromkeys(rare, 1) | {"the": 2 + len(urls) - 1, "net": len(urls) - 1}
    split = U.Segmenter(words)

    def tokens(host, path):
        labels = ["".join("0" if c.isdigit() else c for c in x) for x in host.split(".") if x]
        labels = [x.replace("00", "0") for x in labels]
        return ["h:" + w for x in labels for w in split.split(x)] + ["p:" + x for x in path.lower().split("/") if x]

    assert split.split(names[0]) == [rare[0], rare[59_999]]
    counts, seen = {}, [0, 0]
    for r in got.values():
        if r.rule is not None:
            bad = int(r.rule == "net/")
            seen[bad] += 1
            for t in tokens(r.host, r.path):
                counts.setdefault(t, [0, 0])[bad] += 1
    assert len(counts) > 200_000 and len(words) > 50_000 and len(got) == len(urls)
    model = U.Bayes(counts, tuple(seen))
    for r in got.values():
        odds, block = model.blocks(tokens(r.host, r.path))
        assert abs(r.block_odds - odds) < 1e-9
        assert r.verdict == ("block" if (block if r.rule is None else r.rule == "net/") else "allow")
