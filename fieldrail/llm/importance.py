"""Importance resampling towards a target: hashed n-gram gains, Gumbel scores, exact ranks.

1. Texts of more than ``CHUNK`` bytes are split at word boundaries.  A chunk owns the words that
   start in it and carries the n - 1 words after them, so that each run of words is counted by the one
   chunk that owns its start.  Chunks are dealt anew and written; other texts stay where they are.
2. Tasks count features by bucket and send one row a bucket; so do the target's texts.
3. A bucket's gain is the log ratio of the two shares.  Gains (``buckets`` numbers) go to all tasks;
   feature counts and gains of chunks are summed by document.
4. Scores (mean gain and Gumbel noise from a hash of the id) are put in order by ranges; a row's rank is
   its place in its range after the rows of the ranges before.

Defined results: null and wordless texts have no features and weight 0; a null id is weighed but never
drawn and not counted among those to draw from (score and rank null); rows of one id have one noise, and each is drawn
by itself; an empty target or table works; a word isn't split, however long.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, partitions, trimmed

#: Bytes of a text that one chunk owns.
CHUNK = 1 << 16
#: ASCII that isn't a letter or digit parts words; capitals are lowered before.
PARTS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Words of more bytes than this get their checksums one by one.
LONG = 64


def _byte_table() -> np.ndarray:
    """CRC-32 of single bytes without its conditioning (polynomial EDB88320)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_BYTES = _byte_table()


def _zero_tables(most: int) -> np.ndarray:
    """(length, byte of the sum, value): what a checksum becomes when so many bytes follow it."""
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    for n in range(most):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ _BYTES[out[n] & 0xFF]
    return out


_AFTER = _zero_tables(LONG + 1)


def _moved(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums moved on by so many bytes: the sum of a + b is moved(sum of a, len(b)) ^ sum of b."""
    out = _AFTER[length, 0, sums & 0xFF]
    for k in (1, 2, 3):
        out ^= _AFTER[length, k, (sums >> np.uint32(8 * k)) & 0xFF]
    return out


def word_sums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live, done = np.flatnonzero(size <= LONG), 0
    live = live[size[live] > 0]
    while len(live):
        c = out[live]
        out[live] = _BYTES[(c ^ buf[starts[live] + done]) & 0xFF] ^ (c >> np.uint32(8))
        done += 1
        live = live[size[live] > done]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes())
    return out


def features(buf: np.ndarray, offsets: np.ndarray, own: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of the runs of 1 to n words that start in a text's first ``own`` words, and owned words a text."""
    low = K.LOWER[buf]
    s, e, first = K.word_spans(low, offsets, PARTS)
    owned = np.minimum(own, np.diff(first))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place = np.arange(len(s)) - first[text]
    begins = np.flatnonzero(place < owned[text])
    sums, size = word_sums(low, s, e), e - s
    short = np.minimum(size, LONG)
    after_space = _moved(np.full(len(s), zlib.crc32(b" "), np.uint32), short) ^ sums
    far = np.flatnonzero(size > LONG)
    for i in far.tolist():
        after_space[i] = zlib.crc32(b" " + low[s[i] : e[i]].tobytes())
    run, found = sums.copy(), [(sums[begins], text[begins])]
    for g in range(1, n):
        m = max(len(s) - g, 0)
        joined = _moved(run[:m], short[g : g + m] + 1) ^ after_space[g : g + m]
        for i in far[far >= g].tolist():
            joined[i - g] = zlib.crc32(b" " + low[s[i] : e[i]].tobytes(), int(run[i - g]))
        run = joined
        at = begins[begins < m]
        at = at[text[at] == text[at + g]]
        found.append((run[at], text[at]))
    return np.concatenate([x for x, _ in found]).astype(np.int64) % buckets, np.concatenate([t for _, t in found]), owned


def split(text: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(chunk, words that it owns) of a text; a chunk ends with n - 1 words of the next ones."""
    buf = np.frombuffer(text, np.uint8)
    s, e, _ = K.word_spans(K.LOWER[buf], np.array([0, len(buf)]), PARTS)
    if not len(s):
        yield b"", 0
        return
    cut = np.unique(np.searchsorted(s, np.arange(0, len(buf), size)))
    for a, b in zip(cut, np.r_[cut[1:], len(s)]):
        if b > a:
            yield text[s[a] : e[min(b + n - 1, len(s)) - 1]], int(b - a)


_CHUNKS = "id long, mark string, chunk int, own int, text string"


def _split(n: int, size: int):
    names = ["id", "mark", "chunk", "own", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = list(split(batch.column(2)[i].as_py().encode(), n, size))
                # some MB a batch: a chunk is a slice, only the text itself may be longer
                for lo in range(0, len(held), 64):
                    some = held[lo : lo + 64]
                    head = [pa.array([batch.column(k)[i].as_py()] * len(some), kind) for k, kind in ((0, pa.int64()), (1, pa.string()))]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([w for _, w in some], pa.int32()), pa.array([t.decode() for t, _ in some], pa.string())], names)

    return run


def chunked(texts: DataFrame, n: int, size: int, scratch: Scratch | None) -> DataFrame:
    """(id, mark, chunk, own, text) of (id, text): long texts in chunks with a mark, others whole (mark and own null)."""
    whole = texts.filter(F.col("text").isNull() | (F.octet_length("text") <= size))
    whole = whole.select("id", F.lit(None).cast("string").alias("mark"), F.lit(0).alias("chunk"), F.lit(None).cast("int").alias("own"), "text")
    long = texts.filter(F.octet_length("text") > size).select("id", F.sha2("text", 256).alias("mark"), "text")
    dealt = long.mapInArrow(trimmed(_split(n, size)), _CHUNKS).repartition(partitions(texts.sparkSession), "id", "mark", "chunk")
    return whole.unionByName(scratch.put("chunks", dealt) if scratch else dealt)


def _groups(batch: pa.RecordBatch, n: int, buckets: int) -> Iterator[tuple[int, int, tuple]]:
    buf, offsets = K.texts(batch.column("text"))
    own = batch.column("own").fill_null(2**31 - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in K.groups(offsets):
        yield lo, hi, features(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], own[lo:hi], n, buckets)


def bucket_counts(chunks: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features each bucket has; the driver takes one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, (bucket, _, _) in _groups(batch, n, buckets):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in chunks.select("own", "text").mapInArrow(trimmed(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    s, t, buckets = float(source.sum() + len(source)), float(target.sum() + len(target)), len(source)
    return np.array([math.floor(1000 * math.log((float(target[k]) + 1) * s / ((float(source[k]) + 1) * t))) for k in range(buckets)], np.int64)


def weighed(chunks: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """(id, n_words, n_features, weight) a row of the texts."""
    shared = chunks.sparkSession.sparkContext.broadcast(gain)
    names = ["id", "mark", "chunk", "n_words", "n_features", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, count, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, (bucket, text, owned) in _groups(batch, n, len(gain)):
                words[lo:hi] = owned
                count[lo:hi] = np.bincount(text, minlength=hi - lo)
                order = np.argsort(text, kind="stable")
                sums = np.r_[0, np.cumsum(gain[bucket[order]])]
                edge = np.searchsorted(text[order], np.arange(hi - lo + 1))
                total[lo:hi] = sums[edge[1:]] - sums[edge[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), batch.column("chunk"), *map(pa.array, (words, count, total))], names)

    parts = chunks.mapInArrow(trimmed(run), "id long, mark string, chunk int, n_words long, n_features long, total long")
    sums = ["n_words", "n_features", "total"]
    # rows of one id and one text have chunks alike: as many rows as first chunks
    rows = parts.filter("mark is not null").groupBy("id", "mark").agg(F.count_if(F.col("chunk") == 0).alias("rows"), *(F.sum(c).alias(c) for c in sums))
    rows = rows.select("id", *(F.expr(f"{c} div rows").alias(c) for c in sums), F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")
    every = parts.filter("mark is null").select("id", *sums).unionByName(rows)
    floored = F.expr("(total - pmod(total, n_features)) div n_features")
    return every.select("id", "n_words", "n_features", F.when(F.col("n_features") > 0, floored).otherwise(F.lit(0)).cast("long").alias("weight"))


def noise(key: F.Column, seed: int) -> F.Column:
    """floor(1000 Gumbel) from the first 32 bits of sha256("seed:key")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int, least_words: int, scratch: Scratch) -> DataFrame:
    """scored (id, n_words, score, ...) with rank: the place among the highest percent of those that may be drawn."""
    spark = scored.sparkSession
    held = scratch.put("scored", scored.withColumn("open", (F.col("n_words") >= least_words) & F.col("score").isNotNull()))
    # a written table's rows have fixed numbers, which put rows of one id and score in order
    order = [F.col("open").desc(), F.col("score").desc(), F.col("id").asc(), F.col("row").asc()]
    numbered = held.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = scratch.put("placed", numbered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    counts = sorted((r.part, r.n, r.open) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("open").alias("open")).collect())
    most, before, starts = sum(c[2] for c in counts) * percent // 100, 0, []
    for k, n, _ in counts:  # one number a range
        starts.append((k, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", part).join(offsets, "part", "left")
    return out.withColumn("rank", F.when(F.col("open") & (place <= most), place)).drop("open", "row", "at", "part", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, n: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """(id, n_features, weight, score, rank, n_words) a row of docs; rank is null for what isn't drawn."""
    scratch = Scratch(docs.sparkSession)
    chunks = chunked(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n, size, scratch)
    wanted = chunked(target.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text")), n, size, None)
    gain = gains(bucket_counts(chunks, n, buckets), bucket_counts(wanted, n, buckets))
    scored = weighed(chunks, gain, n).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    out = ranked(scored, percent, least_words, scratch)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")
