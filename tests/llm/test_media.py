"""Matroska and WARC: round trips and bytes made by hand."""

import gzip
import hashlib
import random
import struct
import zlib

import pytest

from fieldrail.llm import matroska as M
from fieldrail.llm import warc as W


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 8192, 8193, 32768, 70001])
def test_payload_round_trip(n):
    text = random.Random(n).randbytes(n)
    payload = M._payload(text)
    assert len(payload) % 64 == 0 and len(payload) and payload.startswith(text) and not payload[n:].strip(b"\0")
    stored = M.mux(payload)
    media = M.demux(stored)
    assert M.samples(stored, media) == payload and M.mux(payload) == stored
    assert [t for _, t, *_ in media.packets] == list(range(len(payload) // 64)) and all(k for _, _, k, *_ in media.packets)
    assert all(stored[c : c + 4] == b"\x1f\x43\xb6\x75" for *_, c in media.cues) and len(media.cues) == len(media.clusters)
    assert media.tracks[1].bits == 8 and media.tracks[1].rate == M.SAMPLE_RATE


def file_of(*clusters: bytes, unknown=False) -> bytes:
    body = M._SETUP + b"".join(clusters)
    return M._HEAD + (bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + body if unknown else M._element(M.SEGMENT, body))


def cluster(time: int, *blocks: bytes, unknown=False) -> bytes:
    body = M._number(M.TIMESTAMP, time) + b"".join(blocks)
    return bytes.fromhex("1f43b675") + b"\xff" + body if unknown else M._element(M.CLUSTER, body)


def block(flags: int, rest: bytes, time: int = 0) -> bytes:
    return b"\x81" + struct.pack(">h", time) + bytes([flags]) + rest


def frames(data: bytes) -> list[bytes]:
    return [data[a:b] for _, _, _, a, b in M.demux(data).packets]


def test_all_lacings():
    a, b, c = b"x" * 300, b"y" * 255, b"z" * 7
    xiph = block(0x82, b"\x02" + b"\xff\x2d" + b"\xff\x00" + a + b + c)
    ebml = block(0x86, b"\x02" + b"\x41\x2c" + (8191 - 45).to_bytes(2, "big").replace(b"\x1f", b"\x5f", 1) + a + b + c)
    fixed = block(0x84, b"\x02" + b"aabbcc")
    plain = block(0x80, a)
    for body, want in ((xiph, [a, b, c]), (ebml, [a, b, c]), (fixed, [b"aa", b"bb", b"cc"]), (plain, [a])):
        assert frames(file_of(cluster(5, M._element(M.SIMPLE_BLOCK, body)))) == want
    with pytest.raises(ValueError):
        M.demux(file_of(cluster(0, M._element(M.SIMPLE_BLOCK, block(0x84, b"\x01abc")))))


def test_groups_times_and_unknown_sizes():
    simple = M._element(M.SIMPLE_BLOCK, block(0x00, b"one", -2))
    group = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block(0x00, b"two", 3)) + M._number(M.REFERENCE, 1))
    key = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block(0x00, b"six", 4)))
    data = file_of(cluster(10, simple, unknown=True), cluster(20, group, key, unknown=True), unknown=True)
    media = M.demux(data)
    assert [(t, k) for _, t, k, *_ in media.packets] == [(8, False), (23, False), (24, True)] and frames(data) == [b"one", b"two", b"six"]


def test_bad_bytes_raise():
    good = M.mux(bytes(64))
    for bad in (b"", b"RIFF" + bytes(60), good[:-3], good[:40], b"\0" * 20):
        with pytest.raises((ValueError, IndexError, struct.error)):
            M.demux(bad)
    with pytest.raises(ValueError):
        M.mux(b"")


def test_vints_of_every_size():
    for n in (0, 126, 127, 128, 16382, 16383, 2**21 - 2, 2**49):
        raw = M._vint(n)
        assert M._read_vint(raw, 0)[:2] == (n, len(raw))


def test_media_query(documents, corpus, nothing):
    got = {r.doc_id: r for r in M.media_report(M.media_files(documents)).collect() if r.doc_id is not None}
    for i, t in corpus:
        if i is None:
            continue
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[0].media_sha256 == got[200 if corpus[0][1] == dict(corpus).get(200) else 0].media_sha256 and got[401].feature == got[400].feature
    assert M.media_report(M.media_files(nothing)).count() == 0


def test_packet_table(spark):
    files = spark.createDataFrame([("a", bytearray(M.mux(bytes(640)))), ("b", bytearray(b"junk")), ("c", None)], "path string, content binary")
    rows = M.packet_table(files).collect()
    assert sum(r.path == "a" and r.codec == "A_PCM/INT/LIT" for r in rows) == 10 and {r.path for r in rows if r.error} == {"b", "c"}


PAGE = "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><p>One<br>two   three</p><a href=\"/l?a=1&amp;b\">link</a> <A HREF='q'>z</A><div>é</div></body></html>"


def by_patterns(page):
    """Text and links by regular expressions, which are slow on long pages of open tags."""
    import html
    import re

    links = []
    kinds = (r"<!--.*?-->", r"<(script|style|noscript|template)(?![\w-])[^>]*>.*?</\1\s*>", r"<a(?![\w-])[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^>]*>", r"<(?=[a-zA-Z/!?])(/?[a-zA-Z0-9]*)(?![\w-])[^>]*>", r"<(?=[a-zA-Z/!?])[^>]*>")

    def instead(m):
        if m[0].startswith("<!") or m[1]:
            return " "
        if m[2] is not None or m[3] is not None:
            links.append(html.unescape(m[2] or m[3] or ""))
        return "\n" if (m[4] or "").lower().lstrip("/") in W._BLOCKS else ""

    text = html.unescape(re.sub("|".join(kinds), instead, page, flags=re.S | re.I))
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\r\f\v]+", " ", text)).strip(), links


def test_scan_equals_the_patterns():
    import html

    r = random.Random(5)
    parts = ["<p>", "</p>", "<div class='x'>", "a b", " & ", "&lt;", "<script>x<y</script >", "<STYLE>p{}</style>", "<!-- c > -->", "<!DOCTYPE html>", "<a href=\"u?a=1&amp;b\">", "<A title=x HREF = 'v'>", "</a>", "<a name='n'>", "<br/>", "< ", " > ", "\n\n ", "\u3000", "<b>", "</b>", "<pre", "x>", "é", "<template>t</template>", "<script>", "<noscript>"]
    for _ in range(3000):
        page = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        text, links = by_patterns(page)
        assert (W.plain_text(page), list(map(html.unescape, W.scan(page)[1]))) == (text, links), page


def test_long_pages_of_open_tags_take_linear_time():
    import time

    for part in ("<script", "<script>", "<!--", "<p ", "<a href=\"", "<a href='x", "</script ", "\u3000", "< ", "<template><a "):
        page = part * (1_000_000 // len(part))
        begin = time.perf_counter()
        W.plain_text(page)
        assert time.perf_counter() - begin < 5, part


def test_derivatives_equal_plain_python(spark):
    """Each row's records, by the rules of the format alone; repeated rows and a long page too."""
    import base64

    rows = [(1, "http://a/", PAGE), (1, "http://a/", PAGE), (2, None, None), (3, "http://b/", "<p>" * 100_000 + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, bytes(r.record)) for r in W.derivatives(W.responses(pages)).collect())
    want = []
    for k, url, page in rows:
        body = (page or "").encode()
        text, links = by_patterns(page or "")
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        for kind in ("conversion", "metadata"):
            own = [x for x in got if x[:2] == (k, kind)][0][2]
            head, _, rest = own.partition(b"\r\n\r\n")
            block = rest[:-4]
            assert rest.endswith(b"\r\n\r\n") and f"Content-Length: {len(block)}".encode() in head and sha(block).encode() in head
            assert f"WARC-Target-URI: {url or ''}".encode() in head or not url
            assert f"WARC-Payload-Digest: {sha(body)}".encode() in head and b"WARC-Refers-To: " + W.record_id("response", url or "", str(k)).encode() in head
            assert block == text.encode() if kind == "conversion" else [x[9:] for x in block.decode().split("\r\n") if x.startswith("outlink: ")] == list(dict.fromkeys(links))
            want.append((k, kind, own))
    assert got == sorted(want)


def test_plain_text():
    assert W.plain_text(PAGE) == "T & x\nOne\ntwo three\nlink z\né"
    assert W.plain_text("") == "" and W.plain_text("a < b") == "a < b"


def test_derivatives_refer_to_their_source(spark):
    raw = W.response_record("http://x/ä", PAGE, "2026-01-02T03:04:05Z", "7")
    source, block_ = next(W.read_records(raw))
    made = W.derive(source, block_)
    assert [k for k, *_ in made] == ["metadata", "conversion"]
    for kind, own, record in made:
        headers, data = next(W.read_records(record))
        assert headers["WARC-Type"] == kind and headers["WARC-Record-ID"] == own and headers["WARC-Refers-To"] == source["WARC-Record-ID"]
        for name in ("WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest"):
            assert headers[name] == source[name]
        assert headers["WARC-Block-Digest"] == W.digest(data) and int(headers["Content-Length"]) == len(data)
    fields = next(W.read_records(made[0][2]))[1].decode()
    assert "outlink: /l?a=1&b\r\n" in fields and "outlink: q\r\n" in fields and "http-status: HTTP/1.1 200 OK" in fields
    assert next(W.read_records(made[1][2]))[1].decode() == W.plain_text(PAGE)
    assert W.derive({"WARC-Type": "request"}, b"") == []


def test_files_of_several_records(spark):
    one, two = (W.response_record(f"http://x/{k}", PAGE, "2026-01-01T00:00:00Z", str(k)) for k in (1, 2))
    info = W.write_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x>")], b"software: x\r\n")
    rows = [(1, bytearray(info + one + two)), (2, bytearray(gzip.compress(one) + gzip.compress(two))), (3, bytearray(one[:-30])), (4, None), (5, bytearray(b"no record"))]
    out = W.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    count = {k: sum(r.page_id == k and r.error is None for r in out) for k in range(1, 6)}
    assert count == {1: 4, 2: 4, 3: 0, 4: 0, 5: 0} and {r.page_id for r in out if r.error} == {3, 5}


def test_headers_cannot_be_injected():
    raw = W.response_record("http://x/\r\nWARC-Type: evil", "", "2026-01-01T00:00:00Z", "1")
    assert len(list(W.read_records(raw))) == 1 and next(W.read_records(raw))[0]["WARC-Type"] == "response"


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (2, "u", PAGE), (2, "u", PAGE)], "page_id long, url string, html string")
    out = W.derivatives(W.responses(pages)).collect()
    assert len(out) == 8 and not any(r.error for r in out)
    assert W.derivatives(W.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
