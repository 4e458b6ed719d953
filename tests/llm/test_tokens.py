"""Token operators against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fieldrail.llm import kernels as K
from fieldrail.llm import sentencepiece_codec as S
from fieldrail.llm.common import Scratch, pack, unpack
from fieldrail.llm.queries import tokenizer_path
from fieldrail.llm.text_tokens import TextTokens
from fieldrail.llm.token_counts import Counter, count_tokens
from fieldrail.llm.token_files import PlaneFile, export_files, read_report, write_file, write_ids

JSON, MODEL = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


def odd_texts(n=120):
    r = random.Random(3)
    letters = "aA éÉ.,'!<|>\n\t1 你\U0001f600́"
    fixed = ["", " ", "a<|endoftext|>b c <|startoftext|>", "don't I'LL we've 'S the,' x. ́y ≠", "İstanbul ΑΣ ß   x y", "ab" * 900 + " z", "é" * 1200, "word,, " * 400, "A" + "<|endoftext|>" * 60, "  lead and trail  "]
    marks = ".,!?;:$&%*#\"()[]{}-_/+=@~^`\\'<|>"
    fixed += ["".join(r.choice("ab") * r.randrange(3) + "".join(r.choice(marks) for _ in range(r.randrange(4))) + r.choice([" ", "", "\u0301"]) for _ in range(60)) for _ in range(60)]
    return fixed + ["".join(r.choice(letters) for _ in range(r.randrange(300))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("chunk, overlap", [(1 << 14, 1 << 9), (120, 16), (40, 8)])
def test_counts_equal_the_libraries(library, pieces, chunk, overlap):
    texts = odd_texts()
    buf, off = K.texts(pa.array(texts))
    for path, want in ((JSON, [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]), (MODEL, [len(x) for x in pieces.encode(texts)])):
        with open(path, "rb") as f:
            assert Counter(path, f.read()).count(buf, off, chunk, overlap).tolist() == want


def test_upper_case_is_left_to_the_library(library):
    """Special strings in other cases, and capitals that only compose with a mark once they are small."""
    marked = ["H\u0331", "J\u030c", "T\u0308", "T\u0308\u0301", "T\u0344", "W\u030a", "Y\u030a"]
    texts = ["<|ENDOFTEXT|>", "a<|EndOfText|>B C.", "<|STARTOFTEXT|>, x", "x <|endoftext|> THE <|ENDOFTEXT|>.", *marked, " ".join(marked), "JA" + "J\u030c" * 3 + "OK, AND SO.", "PLAIN Words, in A row!"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    with open(JSON, encoding="utf-8") as f:
        tokens = TextTokens(f.read())
    for group in ([t] for t in texts), [texts]:
        got = []
        for part in group:
            ids, first = tokens.encode(*K.texts(pa.array(part)))
            got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        assert got == want
    with open(JSON, "rb") as f:
        assert Counter(JSON, f.read()).count(*K.texts(pa.array(texts)), 1 << 14, 1 << 9).tolist() == [len(x) for x in want]


def test_chunks_by_the_librarys_offsets():
    """A tokenizer that keeps white space is brought in step at its own pre-tokens."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = [t for t in odd_texts(30) if len(t) < 1000]
    with open(path, "rb") as f:
        counter = Counter(path, f.read())
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert not counter.parts
    assert counter.count(*K.texts(pa.array(texts)), 150, 30).tolist() == want


def test_count_query(spark, documents, corpus, library, nothing):
    got = {r.doc_id: r for r in count_tokens(documents, JSON, limit=50).collect() if r.doc_id is not None}
    for i, t in corpus:
        if i is not None:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 50)
    assert count_tokens(nothing, JSON).count() == 0


def test_files_hold_the_ids_in_order(spark, documents, corpus, library, nothing, tmp_path):
    files = write_ids(documents, JSON, Scratch(spark), end_id=1, file_ids=500)
    got = sorted((r for r in read_report(files).collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    start = 2 + len(library.encode(corpus[0][1], add_special_tokens=False).ids)  # the null ids' rows stand first
    for row, (i, t) in zip(got, sorted(((i, t) for i, t in corpus if i is not None), key=lambda r: r[0]), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert files.count() > 3 and export_files(files, str(tmp_path)) == files.count()
    assert read_report(write_ids(nothing, JSON, Scratch(spark))).count() == 0


def test_any_stretch_of_a_file():
    r = np.random.default_rng(1)
    for top in (1, 2, 49407, 1 << 31):
        ids = r.integers(0, top, 140_000, dtype=np.uint32)
        data = PlaneFile(write_file(ids, np.array([7]), np.array([len(ids)])))
        for a, b in ((0, None), (65_530, 65_540), (131_071, 139_999), (5, 5)):
            assert np.array_equal(data.ids(a, b), ids[a:b])
    with pytest.raises(ValueError):
        PlaneFile(b"x" * 80)


def test_pack_round_trip():
    for dtype in (np.uint8, np.uint32, np.int64):
        for n in (0, 1, 1000):
            x = np.arange(n).astype(dtype)
            assert np.array_equal(unpack(pack(x), dtype), x)


def test_sentencepiece_parity_and_round_trip(pieces):
    with open(MODEL, "rb") as f:
        data = f.read()
    codec, texts = S.Codec(data, parity=True), odd_texts()
    ids, first, alike = codec.encode(*K.texts(pa.array(texts)))
    want = pieces.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want and alike.all()
    assert [e.ids for e in codec.whole.encode_batch([t for t in texts if t], add_special_tokens=False)] == [w for t, w in zip(texts, want) if t]
    out, edge = codec.decode(ids, first)
    assert [out[a:b].tobytes().decode() for a, b in zip(edge[:-1], edge[1:])] == texts
    assert [codec.whole.decode(w) for w in want[2:8]] == texts[2:8]


def tiny_model(kind, charsmap=b"", squeeze=0):
    """A small model file, written by hand."""
    import struct

    def field(n, body):
        return bytes([n << 3 | 2, len(body)]) + body if n < 16 else bytes([(n << 3 | 2) & 127 | 128, n >> 4, len(body)]) + body

    out = b""
    for piece, score, t in [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁", -3.0, 1), ("a", -2.5, 1), ("▁ab", -1.2, 1), ("ab", -4.0, 1)]:
        out += field(1, field(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([t]))
    out += field(2, bytes([3 << 3, kind])) + field(3, field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, squeeze]))
    return out


def test_unigram_models_are_rebuilt_too():
    import sentencepiece

    for squeeze in (0, 1):
        data = tiny_model(S.UNIGRAM, squeeze=squeeze)
        other = sentencepiece.SentencePieceProcessor(model_proto=data)
        codec, texts = S.Codec(data, parity=True), ["ab a b", "aab  ba", "", "a  "]
        ids, first, alike = codec.encode(*K.texts(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == other.encode(texts) and alike.all()
    with pytest.raises(ValueError):
        S.parse(tiny_model(4))


def test_sentencepiece_query(spark, documents, corpus, pieces, nothing):
    out = S.encode(documents, MODEL, parity=True)
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert all(r.parity and r.round_trip for r in got.values()) and out.count() == len(corpus)
    assert all(got[i].ids == pieces.encode(t or "") for i, t in corpus if i is not None)
    back = {r.doc_id: r.text for r in S.decode(out.select("doc_id", "ids"), MODEL).collect() if r.doc_id is not None}
    assert all(back[i] == (t or "") for i, t in corpus if i is not None)
    assert S.encode(nothing, MODEL).count() == 0


def test_chunks_near_the_overlap_end_or_are_refused():
    import signal

    path = tokenizer_path("word_bpe_49k.json")
    with open(path, "rb") as file:
        counter = Counter(path, file.read())
    signal.alarm(60)
    try:
        for text in ("é" * 40, "🙂" * 50, "aé🙂 " * 30, "word " * 40):
            buf, offsets = K.texts(pa.array([text]))
            want = counter.count(buf, offsets)
            for chunk, overlap in ((31, 4), (30, 4), (24, 4), (512, 600), (16384, 16384), (4, 4)):
                with pytest.raises(ValueError):
                    counter.count(buf, offsets, chunk, overlap)
            least = max(4, 2 * counter.longest) + 7
            for chunk in (least, least + 1, least + 9):
                assert counter.count(buf, offsets, chunk, 4).tolist() == want.tolist()
    finally:
        signal.alarm(0)
