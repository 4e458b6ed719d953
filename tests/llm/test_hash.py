"""Structured words whose polynomial hashes agree modulo 2^64 are told apart everywhere."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldrail.llm import kernels as K
from fieldrail.llm import sentencepiece_codec as S
from fieldrail.llm.common import Scratch
from fieldrail.llm.minhash_dedup import near_duplicates
from fieldrail.llm.queries import tokenizer_path
from fieldrail.llm.span_memo import SpanMemo
from fieldrail.llm.substring_dedup import removal_report
from fieldrail.llm.token_counts import count_tokens
from fieldrail.llm.token_files import read_report, write_ids

JSON, MODEL = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


def thue_morse(steps: int, a: str, b: str) -> tuple[str, str]:
    """The word of 2 ** steps letters and its complement."""
    x, y = a, b
    for _ in range(steps):
        x, y = x + y, y + x
    return x, y


@pytest.fixture(scope="module")
def pairs():
    out = []
    for steps in (7, 10, 11):
        x, y = thue_morse(steps, "a", "b")
        lead, tail = [" ".join(f"{w}{i}" for i in range(6)) for w in ("lead", "tail")]
        out += [f"{lead} {x} {tail}", f"{lead} {y} {tail}"]
    return out


@pytest.fixture(scope="module")
def table(spark, pairs):
    return spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string").repartition(1)


def test_hashes_differ_in_both_lanes():
    for steps in range(3, 13):
        x, y = thue_morse(steps, "a", "b")
        buf = np.frombuffer((x + y).encode(), np.uint8)
        for lane in (0, 1):
            h = K.span_hashes(buf, np.array([0, len(x)]), np.array([len(x), 2 * len(x)]), lane)
            assert h[0] != h[1]


def test_equal_spans_have_equal_hashes_wherever_they_stand():
    words = ["a", "ab\0", "ab", "abcdefgh", "abcdefghi", "x" * 256, "x" * 257, "é" * 200]
    text = " ".join(words + words[::-1]).encode()
    buf, off = K.texts(pa.array([text.decode()]))
    s, e, _ = K.word_spans(buf, off)
    h = K.span_hashes(buf, s, e)
    assert np.array_equal(h, h[::-1]) and len(np.unique(h)) == len(words)
    assert K.same_spans(buf, s, e, np.arange(len(s))[::-1])
    assert not K.same_spans(buf, s, e, np.roll(np.arange(len(s)), 1))


def test_a_memo_tells_colliding_spans_apart(monkeypatch):
    monkeypatch.setattr(K, "span_hashes", lambda buf, s, e, lane=0: np.zeros(len(s), K.U64))
    memo = SpanMemo(lambda texts: (texts[::-1], np.array([[len(t), ord(t[0])] for t in texts[::-1]], np.int32).reshape(-1), np.full(len(texts), 2)))
    buf, off = K.texts(pa.array(["aa", "b", "aa", "cc"]))
    ids, count = memo.spans(buf, off[:-1], off[1:])
    assert ids.tolist() == [2, 97, 1, 98, 2, 97, 2, 99] and count.tolist() == [2] * 4


def test_longs_are_hashed_as_spark_does(spark):
    values = [0, 1, -1, 42, 2**62, -(2**63)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "a long").select(F.xxhash64("a")).collect()]
    assert sorted(got) == sorted(K.spark_hashes(np.array(values)).tolist())


def test_ids_equal_the_libraries(table, pairs, spark):
    import zlib

    import sentencepiece
    from tokenizers import Tokenizer

    words, pieces = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in S.encode(table, MODEL, parity=True).collect()}
    assert all(got[i].parity and got[i].ids == pieces.encode(t) for i, t in enumerate(pairs))
    want = [words.encode(t, add_special_tokens=False).ids for t in pairs]
    assert {r.doc_id: r.n_tokens for r in count_tokens(table, JSON).collect()} == {i: len(x) for i, x in enumerate(want)}
    files = read_report(write_ids(table, JSON, Scratch(spark), end_id=1)).collect()
    assert {r.doc_id: r.ids_crc32 for r in files} == {i: zlib.crc32(np.array([*x, 1], "<u4").tobytes()) for i, x in enumerate(want)}


def test_duplicates_are_told_apart(table, pairs):
    assert all(r.n_removed == 0 for r in removal_report(table, 13).collect())
    assert all(r.doc_id == r.component_id for r in near_duplicates(table, 3, 85).collect())
