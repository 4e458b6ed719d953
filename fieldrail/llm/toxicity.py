"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A text is the bag of its words and of their byte 4- to 6-grams (word ends count as a
character), each hashed into one of ``1 << BITS`` buckets and counted as often as it stands there. The bag's
embeddings are averaged, rare features (of the sample) more than common ones, over the root of the squared counts, so that
a few words aren't lost in a long text. The average goes through a linear softmax; embeddings and softmax are
trained together by descent with momentum over the whole sample: what only a few texts have moves little. Misspellings that were
never seen share most of their n-grams with the words that were.  As the model is linear after the average, a bucket's
part in the score is one number, and scoring adds those numbers up.  A step after which the loss is higher is
taken back and the next ones are half as long, so the fit doesn't hang on the step at which it ends.

Training takes a bounded sample of the labelled rows: ``Bound`` at most so many of
each class, in the order of a hash of the id, within so many bytes of text.  Scoring
takes every whole text.

Defined results: A-Z are lower-cased; null and texts without words have an empty
bag, whose score is the softmax of the bias; a null label is no label; several labels
of an id count as the largest; with labels of one class, or none, the score is the
positives' share (0 without labels) for every row; a null id is scored and never
learned from; rows stay as many as they are, with repeated ids too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import fresh, give_back, least_hashes, trimmed

BITS = 20
#: Buckets that fewer labelled texts than this have are not learned from.
LEAST_TEXTS = 3
GRAMS = (4, 5, 6)
#: ASCII that isn't a letter or digit parts words.
PARTS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


@dataclass(frozen=True)
class Bound:
    """How much labelled text a model is fitted on."""

    toxic: int = 2048
    clean: int = 4096
    text_bytes: int = 10 << 20


@dataclass(frozen=True)
class Model:
    """weight: the difference of the two classes' logits, a bucket each; bias likewise."""

    weight: np.ndarray
    bias: float


def _bags(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, text, times) of features, kind by kind, the texts in order within a kind.

    A text's distinct words are taken apart once; their features count as often as they stand there.
    """
    low = K.LOWER[buf]
    s, e, first = K.word_spans(low, offsets, PARTS)
    word, text = K.span_hashes(low, s, e), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    _, once, times = np.unique(K.mix(word + text.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    order = np.argsort(once)
    once, times = once[order], times[order]
    s, e, word, text = s[once], e[once], word[once], text[once]
    yield (word >> K.U64(64 - BITS)).astype(np.uint32), text, times
    # the distinct words of the texts with a space around each
    size = e - s
    flat = np.full(int(size.sum()) + len(s) + 1, 0x20, np.uint8)
    to = np.cumsum(size + 1) - size
    flat[K.ranges(to, size)] = low[K.ranges(s, size)]
    own, often = np.r_[np.repeat(text, size + 1), 0], np.r_[np.repeat(times, size + 1), 0]
    gap = flat == 0x20
    c = flat.astype(np.uint32) + np.uint32(1)
    for g in GRAMS:
        m = len(flat) - g + 1
        if m <= 0:
            continue
        inner = gap[1 : m + 1].copy()
        for j in range(2, g - 1):
            inner |= gap[j : m + j]
        at = np.flatnonzero(~inner)
        factors = (K.seeds(40 + g, g) >> K.U64(32)).astype(np.uint32) | np.uint32(1)
        h = c[at] * factors[0]
        for j in range(1, g):
            h += c[at + j] * factors[j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x297A2D39)
        yield h >> np.uint32(32 - BITS), own[at], often[at]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = K.texts(batch.column(2))
        rows, spread = [], []
        for lo, hi in K.groups(offsets):
            kinds = list(_bags(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            bucket = np.concatenate([b for b, _, _ in kinds]).astype(np.int64)
            text, times = (np.concatenate([kind[k] for kind in kinds]) for k in (1, 2))
            key, inverse = np.unique(text * (1 << BITS) + bucket, return_inverse=True)
            count = np.minimum(np.bincount(inverse, times, len(key)), 65535).astype(np.uint16)
            edge = np.searchsorted(key >> BITS, np.arange(hi - lo + 1))
            for a, b in zip(edge[:-1], edge[1:]):
                rows.append(((key[a:b] & ((1 << BITS) - 1)).astype(np.uint32).tobytes(), count[a:b].tobytes()))
            spread.append(np.bincount(text, times.astype(np.float64) ** 2, hi - lo))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array(np.concatenate([np.zeros(0), *spread]))], ["id", "label", "buckets", "counts", "spread"])


def kept_features(bags: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(used buckets, how many texts have them, places in them, counts, first) of texts' (buckets, counts).

    Buckets that fewer than LEAST_TEXTS texts have are left out.
    The list is emptied on the way, so that features are held once.
    """
    texts = np.zeros(1 << BITS, np.uint16)
    for buckets, _ in bags:
        texts[np.frombuffer(buckets, np.uint32)] += 1
    used = np.flatnonzero(texts >= LEAST_TEXTS)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    sizes = np.array([int((place[np.frombuffer(buckets, np.uint32)] >= 0).sum()) for buckets, _ in bags], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    places, counts = np.empty(first[-1], np.int32), np.empty(first[-1], np.uint16)
    for i, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        own, n = (np.frombuffer(x, k) for x, k in zip(bags[i], (np.uint32, np.uint16)))
        bags[i] = (b"", b"")
        at = place[own]
        places[lo:hi], counts[lo:hi] = at[at >= 0], n[at >= 0]
    return used, texts[used], places, counts, first


def divisor(spread: np.ndarray) -> np.ndarray:
    """What a bag's sum is divided by; an empty bag stays at the bias."""
    return 5 * np.sqrt(1 + spread)


def fit(bags: list[tuple[bytes, bytes]], labels: np.ndarray, spread: np.ndarray, dim: int = 2, steps: int = 80, part: int = 128, rate: float = 30.0, decay: float = 1e-5, toxic_weight: float = 6.0) -> Model:
    """Joint training; each text has its (buckets, counts) and its sum of squared counts.

    Each step is as long as the loss allows: one that raises it is taken back.
    """
    weight = np.zeros(1 << BITS, np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(weight, np.inf if share else -np.inf)
    used, texts, buckets, counts, first = kept_features(bags)
    rare = np.log(len(labels) / texts).astype(np.float32)
    r = np.random.default_rng(11)
    table = np.float32(1e-3) * r.standard_normal((len(used), dim), np.float32)
    soft = r.normal(size=(dim, 2))
    soft = (soft / np.linalg.norm(soft[:, 1] - soft[:, 0])).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    values = (table, soft, bias)
    moved = [np.zeros_like(x) for x in values]
    below = divisor(spread).astype(np.float32)
    least, best, slopes, length = np.inf, values, moved, 1.0
    for _ in range(steps):
        loss, grads = 0.5 * decay * float((values[0].astype(np.float64) ** 2).sum()), [np.zeros_like(x) for x in moved]
        for lo in range(0, len(labels), part):  # the sample in parts: one gradient of all
            mine = np.arange(lo, min(lo + part, len(labels)))
            size = first[mine + 1] - first[mine]
            at = slice(first[mine[0]], first[mine[-1] + 1])
            index = buckets[at]
            x = counts[at] * rare[index] / np.repeat(below[mine], size)
            row = np.repeat(np.arange(len(mine)), size)
            own, found = loss_and_gradients(*values, index, x, row, labels[mine], toxic_weight)
            loss += len(mine) / len(labels) * own
            for total, grad in zip(grads, found):
                total += np.float32(len(mine) / len(labels)) * grad
        if loss <= least:
            least, best, slopes, length = loss, tuple(x.copy() for x in values), grads, min(1.2 * length, 64.0)
        else:  # too long a step: from the best place again, without what had moved
            moved, length = [np.zeros_like(x) for x in values], length / 2
        for k, (value, slope) in enumerate(zip(best, slopes)):
            moved[k] = np.float32(0.9) * moved[k] - np.float32((0.25 if k else rate) * length) * (slope + (0 if k else np.float32(decay) * value))
        values = tuple(x + step for x, step in zip(best, moved))
    table, soft, bias = best
    weight[used] = (table @ (soft[:, 1] - soft[:, 0])) * rare
    return Model(weight, float(bias[1] - bias[0]))


def gradients(table: np.ndarray, soft: np.ndarray, bias: np.ndarray, index: np.ndarray, x: np.ndarray, row: np.ndarray, labels: np.ndarray, toxic_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean weighted cross entropy; text row[i] has x[i] of the embedding table[index[i]]."""
    return loss_and_gradients(table, soft, bias, index, x, row, labels, toxic_weight)[1]


def loss_and_gradients(table: np.ndarray, soft: np.ndarray, bias: np.ndarray, index: np.ndarray, x: np.ndarray, row: np.ndarray, labels: np.ndarray, toxic_weight: float) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The mean weighted cross entropy and its gradients."""
    mean = np.stack([np.bincount(row, x * table[index, k], len(labels)) for k in range(table.shape[1])], 1).astype(table.dtype)
    logit = mean @ soft + bias
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    heavy = np.where(labels == 1, toxic_weight, 1.0)
    other = (logit[:, 1] - logit[:, 0]) * np.where(labels == 1, -1.0, 1.0)
    loss = float((np.logaddexp(0.0, other) * heavy).mean())
    p[np.arange(len(labels)), labels] -= 1
    p *= heavy[:, None] / len(labels)
    # the two classes' errors are opposite, so a bucket's gradient is one number along the softmax's difference
    own = np.bincount(index, x * p[row, 1], len(table)).astype(table.dtype)
    return loss, (own[:, None] * (soft[:, 1] - soft[:, 0]), mean.T @ p, p.sum(0))


def held_out(id_col: str) -> F.Column:
    """Every fifth id by crc32 of its text; never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: Bound = Bound()) -> Model:
    """A model of the labels of rows that aren't held out."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = [(i, y) for y, n in ((1, bound.toxic), (0, bound.clean)) for i in least_hashes(known.filter(F.col("label") == y), n)]
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = spark.createDataFrame(chosen, "id long, label int")
    sizes = slim.select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).join(F.broadcast(sample), "id").groupBy("id").agg(F.sum("n").alias("n")).collect()
    size, total, keep = {r.id: r.n for r in sizes}, 0, []
    rest = {y: iter([i for i, z in chosen if z == y and i in size]) for y in (1, 0)}
    for y in (1, 0, 0) * len(chosen):  # one toxic, two clean, while they last and fit
        i = next(rest[y], None)
        if i is not None and total + size[i] <= bound.text_bytes:
            total += size[i]
            keep.append((i, y))
    few = spark.createDataFrame(keep, "id long, label int")
    rows = slim.join(F.broadcast(few), "id").select("id", "label", "text").mapInArrow(trimmed(_features), "id long, label int, buckets binary, counts binary, spread double").collect()
    rows.sort(key=lambda r: (r.id, r.buckets, r.counts))
    labels, spread = np.array([r.label for r in rows], np.int64), np.array([r.spread for r in rows])
    bags = [(r.buckets, r.counts) for r in rows]
    del rows
    give_back()
    return fit(bags, labels, spread)


def scores(buf: np.ndarray, offsets: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """The probability of the toxic class of each text."""
    out = np.empty(len(offsets) - 1)
    for lo, hi in K.groups(offsets):
        total, spread = np.zeros(hi - lo), np.zeros(hi - lo)
        for bucket, text, times in _bags(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
            edge = np.searchsorted(text, np.arange(hi - lo + 1))
            run = np.r_[0.0, np.cumsum(weight[bucket] * times, dtype=np.float64)]
            square = np.r_[0, np.cumsum(times * times)]
            total += run[edge[1:]] - run[edge[:-1]]
            spread += square[edge[1:]] - square[edge[:-1]]
        with np.errstate(over="ignore"):
            out[lo:hi] = 1 / (1 + np.exp(-(bias + total / divisor(spread))))
    # equal texts have equal scores wherever they stand in a batch
    return np.round(out, 9)


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a column of scores; all rows and columns stay."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weight, model.bias))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(*K.texts(batch.column(at)), weight, bias))], [*batch.schema.names, name])

    return docs.mapInArrow(trimmed(run), schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that score the threshold or more."""
    name = fresh(docs, "__score")
    return score(docs, train(docs, labels, id_col, text_col), name, text_col).filter(F.col(name) < threshold).drop(name)


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) a row."""
    slim = docs.select(F.col(id_col), F.col(text_col))
    out = score(slim, train(docs, labels, id_col, text_col), "score", text_col)
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
