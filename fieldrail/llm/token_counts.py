"""Token counts of huge documents by overlapping chunks that are brought back in step.

Texts over ``chunk`` bytes are cut into overlapping chunks, and each chunk is encoded
with offsets.  Before tokens are merged a text is parted into stretches, and a matcher
that stands at a stretch's begin doesn't look back; so when two neighbouring chunks
begin a stretch at the same byte, all that follows is equal in both.  The first chunk
is right up to its end but for the last stretches, which the cut may have changed (they
are not used).  The chunks are spliced at such a common begin; where the overlap has
none, because one stretch fills it, the overlap is doubled until one is found or the
chunks have become one.

Works with files of the tokenizers library (.json) and sentencepiece models (.model).

Defined results: null and empty texts have no tokens; special strings inside texts
count as the library has them; repeated rows are counted each; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sentencepiece_codec import codec_of
from .text_tokens import text_tokens

CHUNK, OVERLAP = 1 << 14, 1 << 9
#: Stretches at a chunk's end that its cut may have changed.
TAIL = 2


class Counter:
    """Stretches and their token counts of batches of chunks."""

    def __init__(self, name: str, data: bytes) -> None:
        self.pieces = codec_of(data) if name.endswith(".model") else None
        self.tokens = None if self.pieces else text_tokens(data.decode())
        self.parts = self.tokens.joins if self.tokens else self.pieces.model.splits and self.pieces.model.dummy_prefix
        self.longest = max((len(t) for t in self.tokens.special), default=0) if self.tokens else 0

    def stretches(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, count, first) of the chunks buf[offsets[i] : offsets[i + 1]]."""
        if self.tokens and self.parts:
            s, _, first, _, count = self.tokens.spans(buf, offsets)
            return s, count, first
        if self.tokens:
            return self._by_offsets(buf, offsets)
        # runs of spaces with what follows; the dummy prefix makes one at each text's begin
        space = buf == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        full = offsets[:-1][np.diff(offsets) > 0]
        begin[full] = True
        starts = np.flatnonzero(begin)
        first = np.searchsorted(starts, offsets)
        # a prefix in the first stretch of a chunk that isn't its text's first is wrong; no splice uses that stretch
        return starts, self._pieces(buf, starts, np.r_[starts[1:], len(buf)], full), first

    def _pieces(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, full: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        size = ends - starts
        lead = np.isin(starts, full)
        flat = np.full(len(buf) + int(lead.sum()), 0x20, np.uint8)
        to = np.cumsum(size + lead) - size
        flat[K.ranges(to, size)] = buf[K.ranges(starts, size)]
        return self.pieces.memo.spans(flat, to - lead, to + size)[1]

    def _by_offsets(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of the library's own pre-tokens, by its offsets (in characters, turned into bytes)."""
        raw = buf.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
        starts, counts, first = [], [], [0]
        for base, text, e in zip(offsets, texts, self.tokens.tokenizer.encode_batch(texts, add_special_tokens=False)):
            at = np.r_[0, np.cumsum([len(c.encode()) for c in text])] if not text.isascii() else np.arange(len(text) + 1)
            words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
            begin = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)]) if len(words) else np.zeros(0, np.int64)
            starts.append(base + at[np.array([e.offsets[i][0] for i in begin], np.int64)] if len(begin) else begin)
            counts.append(np.diff(np.r_[begin, len(words)]))
            first.append(first[-1] + len(begin))
        return np.concatenate(starts) if starts else np.zeros(0, np.int64), np.concatenate(counts) if counts else np.zeros(0, np.int64), np.array(first)

    def _chunks(self, text: np.ndarray, begin: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
        """[a, b) of the chunks from begin on, cut between characters."""
        out, a = [], begin
        while True:
            b = min(a + chunk, len(text))
            while b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
            out.append((a, b))
            if b == len(text):
                return out
            a = b - overlap
            while text[a] & 0xC0 == 0x80:
                a -= 1

    def count(self, buf: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Tokens of each text. Overlaps are twice the longest look-ahead at least, and chunks longer than they by a character."""
        overlap = max(overlap, 2 * self.longest)
        if chunk < overlap + 7:
            raise ValueError(f"chunks of {chunk} bytes don't go on beyond overlaps of {overlap}")
        n = len(offsets) - 1
        cuts: list[tuple[int, int, int]] = []
        for i in range(n):
            size = int(offsets[i + 1] - offsets[i])
            if size <= chunk:
                cuts.append((i, int(offsets[i]), int(offsets[i + 1])))
            else:
                cuts += [(i, int(offsets[i]) + a, int(offsets[i]) + b) for a, b in self._chunks(buf[offsets[i] : offsets[i + 1]], 0, chunk, overlap)]
        text, a, b = (np.array(x, np.int64) for x in zip(*cuts)) if cuts else (np.zeros(0, np.int64),) * 3
        edge = np.r_[0, np.cumsum(b - a)]
        flat = buf[K.ranges(a, b - a)] if len(cuts) > n else buf
        s, c, first = self.stretches(flat, edge)
        before = np.r_[0, np.cumsum(c)]
        out = np.zeros(n, np.int64)
        single = np.bincount(text, minlength=n) == 1
        alone = np.flatnonzero(single[text])
        out[text[alone]] = before[first[alone + 1]] - before[first[alone]]
        for i in np.flatnonzero(~single):
            mine = np.flatnonzero(text == i)
            chain = [(s[first[k] : first[k + 1]] - edge[k] + a[k], c[first[k] : first[k + 1]], int(a[k]), int(b[k])) for k in mine]
            out[i] = self._splice(buf, chain, overlap, int(offsets[i]))
        return out

    def _splice(self, buf: np.ndarray, chain: list, overlap: int, zero: int) -> int:
        total = 0
        starts, counts, a, b = chain[0]
        begin = a  # where counting goes on
        for after in chain[1:]:
            width = overlap
            s2, c2, a2, b2 = after
            while True:
                common = np.intersect1d(starts[:-TAIL], s2)
                common = common[(common > begin) & (common > a2) & (common <= b - self.longest)]
                if len(common):
                    break
                if a2 <= a:  # the two have become one
                    common = None
                    break
                width *= 2
                a2 = max(b - width, a)
                while a2 > zero and buf[a2] & 0xC0 == 0x80:
                    a2 -= 1
                s2, c2, _ = self.stretches(buf[a2:b2], np.array([0, b2 - a2]))
                s2 = s2 + a2
            if common is None:
                starts, counts, b = s2, c2, b2
                continue
            at = common[-1]
            total += int(counts[(starts >= begin) & (starts < at)].sum())
            starts, counts, a, b, begin = s2, c2, a2, b2, at
        return total + int(counts[starts >= begin].sum())


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) a row."""
    with open(tokenizer_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    slim = docs.select(F.col(id_col), F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, shared.value)
        for batch in batches:
            buf, offsets = K.texts(batch.column(1))
            for lo, hi in K.groups(offsets, 2 << 20):
                off = offsets[lo : hi + 1] - offsets[lo]
                n = counter.count(buf[offsets[lo] : offsets[hi]], off, chunk, overlap)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
