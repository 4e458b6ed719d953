"""Removal of passages that repeat across documents, behind a count-min prefilter.

A window is ``size`` consecutive words of one document.  Every word covered by a
window whose word sequence also starts in a document with a smaller id goes.

1. Windows are dealt by ranges of their hash into chunks of some ``CHUNK`` windows, and each
   chunk has its own count-min sketch of two rows.  A task sends what its windows add to a
   chunk's sketch (sorted 24-bit prints, from which both cells follow) with the documents that
   hold them.  A window that the task has seen in two documents goes once, as a two;
   its documents learn at once that it repeats.
2. What the tasks sent is added up chunk by chunk.  Windows whose smaller count is 2 or more are
   told to their documents' buckets.  A sketch only overestimates: no repeated window is lost,
   and the false ones fall out next.
3. Each bucket of documents sends the windows that it was told of to an exact grouping (96 bits:
   64 of one word hash and 32 of another) for the smallest id; within a bucket a window
   goes once, with the bucket's smallest id.
4. Verdicts return to the buckets and the words are cut.

The sketch grows with the corpus, a few bytes a window in one shuffle, and nothing of it
reaches the driver; tasks hold one chunk or one bucket (``BUCKET`` bytes of text, or one
longer document) at a time.

Defined results: null text has no words; a null id is never compared and its row
stays as it is; rows of one id count as one document and don't remove each other's
words (and share a task); an empty table gives an empty one; further columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import fresh, pack, partitions, trimmed, trimmed_pair, unpack

#: Windows of a chunk, by the estimate that one has some WINDOW_BYTES of text.
CHUNK, WINDOW_BYTES = 1 << 18, 6
#: Cells of each of a chunk's two rows.
CELLS = 1 << 21
#: Bytes of the documents of a bucket.
BUCKET = 8 << 20
#: Windows that a task holds before it sends them on.
HELD = 1 << 19
_PRINT = K.U64((1 << 24) - 1)
_SENT = "chunk int, bucket int, id long, data binary"
_KEYED = "bucket int, id long, data binary"
_KINDS = (pa.int32(), pa.int64(), pa.binary())


def _places(h: np.ndarray, chunks: int) -> np.ndarray:
    """chunk << 24 | print of hashes, in the hashes' order."""
    return ((h >> K.U64(24)) * K.U64(chunks)) >> K.U64(16)


def _runs(flag: np.ndarray) -> np.ndarray:
    """[start, end) pairs of the true runs."""
    step = np.diff(np.r_[False, flag, False].astype(np.int8))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).astype(np.uint32).reshape(-1)


def _mark(text: np.ndarray) -> bytes:
    """Tells the texts of rows that share an id apart."""
    return np.array([len(text), zlib.crc32(text)], np.uint32).tobytes()


def _keyed(rows: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], ["bucket", "id", "data"])


def _numbers(values: np.ndarray) -> bytes:
    """Longs, less the least of them."""
    base = int(values.min())
    packed = pack((values - base).astype(np.uint64))
    return struct.pack("<qI", base, len(packed)) + packed


def _read_numbers(data: bytes, at: int) -> tuple[np.ndarray, int]:
    base, n = struct.unpack_from("<qI", data, at)
    end = at + 12 + n
    return unpack(data[at + 12 : end], np.uint64).astype(np.int64) + base, end


def _buckets(ids: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(K.spark_hashes(ids), buckets)


def _stretches(doc: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(document, its runs of windows) of windows in the order of documents and places."""
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, np.int64)
    for x, y in zip(edge[:-1], edge[1:]):
        step = np.flatnonzero(np.diff(at[x:y]) != 1)
        begin, end = at[x:y][np.r_[0, step + 1]], at[x:y][np.r_[step, y - x - 1]] + 1
        yield int(doc[x]), pack(np.stack([begin, end], 1).astype(np.uint32).reshape(-1))


def _ask(size: int, chunks: int, buckets: int):
    """What windows add to the sketch (chunk), and what is known to repeat at once (bucket, id)."""

    def sent(h: np.ndarray, doc: np.ndarray, at: np.ndarray, ids: np.ndarray, marks: list[bytes]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
        last = np.r_[new[1:], len(h)] - 1
        twice = doc[order[new]] != doc[order[last]]
        place, owner = _places(h[order[new]], chunks), ids[doc[order[new]]]
        told = np.sort(order[np.repeat(twice, last - new + 1)])
        rows: list[tuple] = []
        for d, runs in _stretches(doc[told], at[told]):
            to = int(_buckets(ids[d : d + 1], buckets)[0])
            rows.append((to % chunks, to, int(ids[d]), marks[d] + runs))
        chunk = place >> K.U64(24)
        edge = np.flatnonzero(np.r_[True, np.diff(chunk) != 0, True])
        for a, b in zip(edge[:-1], edge[1:]):
            own = np.where(twice[a:b], owner[a:b][0], owner[a:b])
            prints = pack(np.diff((place[a:b] & _PRINT).astype(np.uint32), prepend=np.uint32(0)))
            rows.append((int(chunk[a]), None, None, struct.pack("<II", b - a, len(prints)) + prints + np.packbits(twice[a:b]).tobytes() + _numbers(own)))
        kinds = (pa.int32(), *_KINDS)
        for lo in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 512]), kinds)], ["chunk", "bucket", "id", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, ats, ids, marks, held = [], [], [], [], [], 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, offsets = K.texts(batch.column(1))
            for lo, hi in K.groups(offsets):
                part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                s, e, first = K.word_spans(part, off)
                at, text = K.inside(first, size)
                hashes.append(K.gram_hashes(K.span_hashes(part, s, e), size)[at])
                docs.append((text + len(marks)).astype(np.int32))
                ats.append((at - first[text]).astype(np.int32))
                ids.append(own[lo:hi])
                marks += [_mark(part[a:b]) for a, b in zip(off[:-1], off[1:])]
                held += len(at)
                if held >= HELD:
                    yield from sent(*map(np.concatenate, (hashes, docs, ats, ids)), marks)
                    hashes, docs, ats, ids, marks, held = [], [], [], [], [], 0
        if held:
            yield from sent(*map(np.concatenate, (hashes, docs, ats, ids)), marks)

    return run


def _judge(cells: int, buckets: int):
    """Rows come sorted by chunk: its sketch is added up, and repeated windows return to their documents."""

    def told(chunk: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        prints, twice, ids = [], [], []
        for data in held:
            n, m = struct.unpack_from("<II", data)
            bits = 8 + m
            prints.append(np.cumsum(unpack(data[8:bits], np.uint32), dtype=np.uint32))
            twice.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), bits), count=n).astype(bool))
            ids.append(_read_numbers(data, bits + -(-n // 8))[0])
        prints, twice, ids = map(np.concatenate, (prints, twice, ids))
        mixed = K.mix(prints.astype(K.U64) + K.U64(chunk << 24))
        repeated = ~twice
        for r in range(2):
            cell = ((mixed >> K.U64(32 * r)) % K.U64(cells)).astype(np.int64)
            count = np.bincount(cell, minlength=cells) + np.bincount(cell[twice], minlength=cells)
            repeated &= count[cell] > 1
        prints, ids = prints[repeated], ids[repeated]
        if not len(ids):
            return
        to = _buckets(ids, buckets)
        order = np.argsort(to, kind="stable")
        prints, ids, to = prints[order], ids[order], to[order]
        edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
        yield _keyed([(int(to[a]), None, struct.pack("<I", chunk) + _numbers(ids[a:b]) + pack(prints[a:b])) for a, b in zip(edge[:-1], edge[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            known = batch.column(1).is_valid()
            if known.true_count:
                yield batch.filter(known).select(["bucket", "id", "data"])
            batch = batch.filter(pc.invert(known))
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if chunk != now:
                    yield from told(now, held)
                    now, held = chunk, []
                held.append(data)
        yield from told(now, held)

    return run


def _told(rows: pa.Table) -> tuple[dict[int, list[bytes]], np.ndarray]:
    """(runs of windows by id, mixed (id, chunk and print)) of what a bucket was told."""
    spans: dict[int, list[bytes]] = {}
    found = [np.zeros(0, K.U64)]
    for key, data in zip(rows.column("id").to_pylist(), rows.column("data").to_pylist()):
        if key is not None:
            spans.setdefault(key, []).append(data)
            continue
        (chunk,) = struct.unpack_from("<I", data)
        ids, at = _read_numbers(data, 4)
        found.append(K.mix(K.mix(ids.view(K.U64)) ^ (unpack(data[at:], np.uint32).astype(K.U64) + K.U64(chunk << 24))))
    return spans, np.sort(np.concatenate(found))


def _members(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table of mixed numbers."""
    bits = np.zeros(1 << 22, bool)
    bits[table >> K.U64(42)] = True
    out = bits[values >> K.U64(42)]
    near = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(table, values[near]), max(len(table) - 1, 0))
    out[near] = table[at] == values[near] if len(table) else False
    return out


def _candidates(size: int, chunks: int, buckets: int, names: list[str]):
    """Of one bucket's documents: windows that it was told of, each with its smallest id.

    Rows without an id go to a bucket of windows; those with one are stretches of windows
    that a smaller id of this bucket has.
    """
    bucket_col, id_col, text_col = names

    def windows(ids: np.ndarray, texts: pa.Array, spans: dict[int, list[bytes]], told: np.ndarray) -> tuple[list, list[bytes]]:
        found, marks = [], []
        buf, offsets = K.texts(texts)
        for lo, hi in K.groups(offsets):
            part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            marks += [_mark(part[a:b]) for a, b in zip(off[:-1], off[1:])]
            s, e, first = K.word_spans(part, off)
            at, text = K.inside(first, size)
            if not len(at):
                continue
            words = K.span_hashes(part, s, e)
            grams = K.gram_hashes(words, size)[at]
            own = ids[lo:hi]
            keep = _members(K.mix(K.mix(own.view(K.U64))[text] ^ _places(grams, chunks)), told)
            if spans:
                known = np.zeros(len(s) + 1, np.int32)
                for i, key in enumerate(own.tolist()):
                    for data in spans.get(key, ()):
                        if data[:8] == marks[lo + i]:
                            pairs = unpack(data[8:], np.uint32).astype(np.int64).reshape(-1, 2) + first[i]
                            known[pairs[:, 0]] += 1
                            known[pairs[:, 1]] -= 1
                keep |= (np.cumsum(known) > 0)[at]
            if keep.any():
                # the second hash of only the kept windows
                second = K.gram_hashes(K.span_hashes(part, s, e, 1), size, 1)[at[keep]]
                found.append((grams[keep], (second >> K.U64(32)).astype(np.uint32), (text[keep] + lo).astype(np.int64), (at[keep] - first[text[keep]]).astype(np.int64)))
        return found, marks

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        spans, told = _told(right)
        left = left.filter(left.column(id_col).is_valid())
        rows: list[tuple[int, int | None, bytes]] = []
        if left.num_rows and right.num_rows:
            ids = left.column(id_col).to_numpy().astype(np.int64)
            found, marks = windows(ids, left.column(text_col), spans, told)
            if found:
                h1, h2, doc, at = map(np.concatenate, zip(*found))
                order = np.lexsort((ids[doc], h2, h1))
                h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
                new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
                later = ids[doc] != ids[doc][new][np.cumsum(new) - 1]
                # known here already: a smaller id of this bucket has the window
                by = np.lexsort((at[later], doc[later]))
                home = left.column(bucket_col)[0].as_py()
                rows += [(home, int(ids[d]), marks[d] + runs) for d, runs in _stretches(doc[later][by], at[later][by])]
                one = h1[new], h2[new], ids[doc][new]
                bucket = (one[0] >> K.U64(20)) % K.U64(buckets)
                by = np.argsort(bucket, kind="stable")
                for x in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                    rows.append((int(bucket[x[0]]), None, struct.pack("<I", len(x)) + one[0][x].tobytes() + one[1][x].tobytes() + _numbers(one[2][x])))
        columns = zip(*rows) if rows else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], ["bucket", "id", "data"])

    return run


def _exact(buckets: int):
    """Rows come sorted by bucket. Windows whose smallest id lies in another bucket return to their document.

    Verdicts of many documents travel in one row, dealt by the documents' bucket.
    """

    def verdicts(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h1s, h2s, whos = [], [], []
        for data in held:
            (n,) = struct.unpack_from("<I", data)
            h1s.append(np.frombuffer(data, np.uint8, 8 * n, 4).view(np.uint64))
            h2s.append(np.frombuffer(data, np.uint8, 4 * n, 4 + 8 * n).view(np.uint32))
            whos.append(_read_numbers(data, 4 + 12 * n)[0])
        h1, h2, who = map(np.concatenate, (h1s, h2s, whos))
        order = np.lexsort((who, h2, h1))
        h1, h2, who = h1[order], h2[order], who[order]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        later = who != who[new][np.cumsum(new) - 1]
        who, h1 = who[later], h1[later]
        if not len(who):
            return
        to = _buckets(who, buckets)
        order = np.lexsort((who, to))
        who, h1, to = who[order], h1[order], to[order]
        edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
        yield _keyed([(int(to[a]), None, _numbers(who[a:b]) + h1[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            local = batch.column(1).is_valid()
            if local.true_count:
                yield batch.filter(local)
            batch = batch.filter(pc.invert(local))
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if bucket != now:
                    yield from verdicts(held)
                    now, held = bucket, []
                held.append(data)
        yield from verdicts(held)

    return run


def _verdicts(rows: pa.Table) -> tuple[dict[int, list[bytes]], dict[int, np.ndarray]]:
    """(stretches, hashes) of windows that a smaller id has, by id, of one bucket."""
    spans: dict[int, list[bytes]] = {}
    whos, hashes = [np.zeros(0, np.int64)], [np.zeros(0, K.U64)]
    for key, data in zip(rows.column("id").to_pylist(), rows.column("data").to_pylist()):
        if key is not None:
            spans.setdefault(key, []).append(data)
            continue
        who, at = _read_numbers(data, 0)
        whos.append(who)
        hashes.append(np.frombuffer(data[at:], K.U64))
    who, h = np.concatenate(whos), np.concatenate(hashes)
    order = np.argsort(who, kind="stable")
    who, h = who[order], h[order]
    edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1], True]) if len(who) else np.zeros(1, np.int64)
    return spans, {int(who[a]): h[a:b] for a, b in zip(edge[:-1], edge[1:])}


def covered_words(part: np.ndarray, off: np.ndarray, size: int, spans: list, hashes: list):
    """(starts, ends, first, removed) of the words of texts with their verdicts."""
    s, e, first = K.word_spans(part, off)
    removed = np.zeros(len(s) + 1, np.int32)
    for i, own in enumerate(spans):
        for data in own:
            if data[:8] != _mark(part[off[i] : off[i + 1]]):
                continue  # of another row with this id
            pairs = unpack(data[8:], np.uint32).astype(np.int64).reshape(-1, 2) + first[i]
            np.add.at(removed, pairs[:, 0], 1)
            np.add.at(removed, np.minimum(pairs[:, 1] + size - 1, first[i + 1]), -1)
    if any(own is not None for own in hashes):
        grams = K.gram_hashes(K.span_hashes(part, s, e), size)
        for i, own in enumerate(hashes):
            n = first[i + 1] - first[i] - size + 1
            if own is not None and n > 0:
                hit = first[i] + np.flatnonzero(np.isin(grams[first[i] : first[i] + n], own))
                np.add.at(removed, hit, 1)
                np.add.at(removed, hit + size, -1)
    return s, e, first, np.cumsum(removed[:-1]) > 0


def _cut(size: int, names: list[str], digest: bool):
    bucket_col, id_col, text_col = names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        marked, hashed = _verdicts(right)
        left = left.drop_columns([bucket_col]).combine_chunks()
        ids = left.column(id_col).to_pylist()
        column = left.column(text_col)
        buf, offsets = K.texts(column)
        words, gone, shas, texts = [], [], [], []
        for lo, hi in K.groups(offsets):
            part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            spans = [marked.get(i, ()) for i in ids[lo:hi]]
            hashes = [hashed.get(i) for i in ids[lo:hi]]
            s, e, first, removed = covered_words(part, off, size, spans, hashes)
            raw = part.tobytes()
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                n = int(removed[a:b].sum())
                words.append(int(b - a))
                gone.append(n)
                if digest:
                    own = raw[off[i] : off[i + 1]].split()
                    if n:
                        own = [own[k] for k in np.flatnonzero(~removed[a:b])]
                    shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
                elif n:
                    # what stands before a removed word goes with it; the rest stays byte for byte
                    stop = np.r_[off[i], e[a:b]]
                    keep = _runs(~removed[a:b]).reshape(-1, 2)
                    out = b"".join(raw[stop[x] : stop[y]] for x, y in keep)
                    tail = raw[stop[-1] : off[i + 1]] if len(keep) and keep[-1][1] == b - a else b""
                    texts.append((out + tail).strip(b" \t\n\r\x0b\x0c").decode())
                else:
                    texts.append(column[lo + i].as_py())
        if digest:
            return pa.Table.from_arrays([left.column(id_col), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])
        return left.set_column(left.column_names.index(text_col), text_col, pa.array(texts, pa.string()))

    return run


def _without_repeats(docs: DataFrame, size: int, id_col: str, text_col: str, cells: int, digest: bool, schema: T.StructType) -> DataFrame:
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    chunks = min(1 << 24, total // (WINDOW_BYTES * CHUNK) + 1)
    n = partitions(docs.sparkSession)
    buckets = max(n, total // BUCKET + 1)
    bucket_col = fresh(docs, "__bucket")
    names = [bucket_col, id_col, text_col]
    key = F.col(id_col).cast("long")
    rows = docs.filter(key.isNotNull()).withColumn(bucket_col, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    known = docs.filter(key.isNotNull()).select(key.alias("id"), F.col(text_col).alias("text"))
    sent = known.mapInArrow(trimmed(_ask(size, chunks, buckets)), _SENT).repartition(n, "chunk").sortWithinPartitions("chunk")
    told = sent.mapInArrow(trimmed(_judge(cells, buckets)), _KEYED)
    moved = rows.groupBy(bucket_col).cogroup(told.groupBy("bucket")).applyInArrow(trimmed_pair(_candidates(size, chunks, buckets, names)), _KEYED)
    found = moved.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_exact(buckets)), _KEYED)
    cut = rows.groupBy(bucket_col).cogroup(found.groupBy("bucket")).applyInArrow(trimmed_pair(_cut(size, names, digest)), schema)
    # rows without an id are never compared and stay where they are
    loose = docs.filter(key.isNull())
    return cut.unionByName(loose.mapInArrow(_loose(size, names), schema) if digest else loose.select(*schema.names))


def _loose(size: int, names: list[str]):
    """The report of rows that nothing is removed from."""
    report = _cut(size, names, True)
    none = pa.Table.from_arrays([pa.array([], k) for k in _KINDS], ["bucket", "id", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]).append_column(names[0], pa.nulls(batch.num_rows, pa.int32()))
                yield from report(rows, none).to_batches()

    return run


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """docs with their repeated passages cut from the text; all rows and columns stay."""
    schema = T.StructType([f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema])
    return _without_repeats(docs, size, id_col, text_col, cells, False, schema)


def removal_report(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) a row: what remove_repeats does, as digests."""
    slim = docs.select(F.col(id_col), F.col(text_col))
    kinds = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(*k) for k in kinds)])
    return _without_repeats(slim, size, id_col, text_col, cells, True, schema)
