"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldrail.llm import importance as I

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + g]) for g in range(1, n + 1) for i in range(len(w) - g + 1)]


def plain(rows, target, percent, n, buckets, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in grams(text, n)) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + buckets) / ((s[k] + 1) * (big_t + buckets)))) for k in range(buckets)]
    out = []
    for i, text in rows:
        g = grams(text, n)
        weight = sum(gain[bucket(f)] for f in g) // len(g) if g else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(g), weight, score, None, len(words_of(text))])
    may = sorted((x for x in out if x[5] >= least and x[3] is not None), key=lambda x: (-x[3], x[0]))
    for k, x in enumerate(may[: len(may) * percent // 100], 1):
        x[4] = k
    return out


@pytest.mark.parametrize("n,size,buckets", [(2, 64, 97), (3, 200, 10_000), (1, 1 << 16, 500)])
def test_resampling_equals_plain_python(spark, n, size, buckets):
    r = random.Random(n)
    rows = [(i, prose(r, r.randint(0, 90)) + r.choice(["", " Ünï-cødé ÄB", "\x00x1\n2", " " + "long" * 30, " ---"])) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "?!"), (103, "One"), (104, "word " * 4000), (105, "Z" * 3000 + " y " + "é" * 500), (106, rows[3][1]), (None, rows[4][1])]
    target = [prose(r, 40), None, "Ünï-cødé long", "w" * 200 + " x"]
    docs = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, rank int, total double").repartition(5)
    got = I.resample(docs, spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string"), 40, n, buckets, 20, size=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert sorted(map(repr, (list(x) for x in got.collect()))) == sorted(map(repr, plain(rows, target, 40, n, buckets, 20)))


def test_repeated_rows_are_drawn_each(spark):
    r = random.Random(1)
    rows = [(5, prose(random.Random(8), 400))] * 6 + [(i, prose(r, 30)) for i in range(20, 40)] + [(5, "other text " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = I.resample(docs, docs.limit(3), 100, size=500).collect()
    want = plain(rows, [rows[0][1]] * 3, 100, 2, 10_000, 20)
    assert len(got) == 27 and sorted(x.rank for x in got) == list(range(1, 28))
    assert Counter((x.doc_id, x.n_features, x.weight, x.score) for x in got) == Counter(tuple(x[:4]) for x in want)


def test_empty_tables(spark, nothing):
    assert I.resample(nothing, nothing).count() == 0
    got = I.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), nothing, least_words=1, percent=100).collect()
    assert got[0].rank == 1 and got[0].n_features == 3


def test_chunks_own_every_start_once():
    r = random.Random(6)
    for text in ("", " .,", "one", prose(r, 300), "é" * 90 + " b " + "c" * 70, ". " * 50 + "x y"):
        for n in (1, 2, 4):
            held = list(I.split(text.encode(), n, 40))
            found = Counter()
            for chunk, own in held:
                w = words_of(chunk.decode())
                found.update(" ".join(w[i : i + g]) for g in range(1, n + 1) for i in range(min(own, len(w) - g + 1)))
            assert found == Counter(grams(text, n))
            assert sum(own for _, own in held) == len(words_of(text))


def test_checksums_of_joined_words():
    data = b"ab c " + b"q" * 100 + b" xyz0123456789"
    starts = np.array([0, 3, 5, 106])
    ends = np.array([2, 4, 105, len(data)])
    assert I.word_sums(np.frombuffer(data, np.uint8), starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
    for a, b in ((b"", b"x"), (b"abc", b" defg"), (b"zz", b"y" * 64)):
        assert int(I._moved(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
