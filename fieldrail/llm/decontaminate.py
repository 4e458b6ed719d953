"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A document leaks an item if some stretch of its words is within ``n // 5`` word edits
(inserted, deleted, changed) of the item's n words; words are lower-cased runs of
letters and digits.

1. Lossless seeds: ``k`` edits leave a run of ``ceil((n - k) / (k + 1))`` item words
   untouched, so only item-sized windows around such a run are looked at.
2. CGK: a random walk reads a window's words (several walks its parts, if it is long); at each step it writes the word
   it stands on and moves on by a random bit of (step, word).  Windows at a small
   edit distance get embeddings at a small Hamming distance.
3. Bit sampling: the words at three sampled steps, near each other, make a key.  Steps come from the part of the
   embedding where a walk still stands on the window's words, and a key that meets the
   window's end is none, so that unrelated windows share keys by chance only.  recall()
   simulates edits at the limit for every item; keys and walks are added until each
   class of lengths reaches ``TARGET``.  A class that the most keys can't bring
   there is compared with all its seeds' windows instead.
4. Candidates are confirmed by the exact edit distance.

Items are collected in blocks of at most ``BLOCK_BYTES`` of text; more items make more
scans, not a larger broadcast.  Item texts without words leak nowhere; null texts have
no words; rows with a null id are never reported, and stay in drop_leaks(); repeated
rows are each looked at; empty tables give no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fresh, trimmed
from .toxicity import PARTS

BLOCK_BYTES = 4 << 20
SAMPLES, STEPS = 32, 3
#: Steps between the sampled ones of a key, at most.
NEAR = 12
#: (walks, keys of each) in the order in which they are tried.
EFFORTS = ((8, 4), (8, 8), (8, 16), (8, SAMPLES), (16, SAMPLES), (32, SAMPLES))
NO_KEYS = len(EFFORTS)
#: Simulated copies of each class of lengths, at least.
TRIALS = 256
#: but not more words of long items than this.
TRIAL_WORDS = 200_000
#: Words of embeddings that are held at once.
TILE = 1 << 22
TARGET = 0.98
#: Words of a window that a walk reads; in longer windows walks begin at eight places.
READ = 512
PAD = K.U64(0x5EED)


def allowed(n: int) -> int:
    """Word edits for an item of n words: similarity 0.8 or more."""
    return n // 5


def stride(n: int) -> int:
    """Steps between the windows that are tried around a seed."""
    return max(1, allowed(n) // 4)


def seed_length(n: int) -> int:
    k = allowed(n)
    return math.ceil((n - k) / (k + 1))


@dataclass
class Items:
    """One block of items, ready to look windows up."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: (sorted hash, offset, n)
    keys: np.ndarray  # sorted
    owner: np.ndarray  # the item of each key
    filled: np.ndarray  # bitmap of the keys
    effort: dict[int, int]  # the place in EFFORTS of each class of lengths; NO_KEYS: compared without keys


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = K.LOWER[buf]
    s, e, first = K.word_spans(low, offsets, PARTS)
    return K.span_hashes(low, s, e), first


def _reach(n: np.ndarray) -> np.ndarray:
    """Steps after which a walk over n words still stands on words: it moves on in every second one or so."""
    n = np.minimum(n, READ)
    return np.maximum(n, (2 * n - 3 * np.sqrt(2 * n)).astype(np.int64))


def lsh_keys(words: np.ndarray, start: np.ndarray, n: np.ndarray, stop: np.ndarray, effort: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether they are keys), a row a window words[start : min(start + n, stop)]."""
    walks, used = effort
    keys, ok = np.empty((len(start), walks, used), K.U64), np.empty((len(start), walks, used), bool)
    by = np.argsort(n, kind="stable")
    lo = 0
    while lo < len(by):
        # windows of like lengths, as many as fit; at least 16
        size = np.searchsorted(_reach(n[by[lo:]]) * np.arange(1, len(by) - lo + 1), TILE, "right")
        part = by[lo : lo + max(16, int(size))]
        keys[part], ok[part] = _tile(words, start[part], n[part], stop[part], effort)
        lo += len(part)
    return keys.reshape(len(start), -1), ok.reshape(len(start), -1)


def _tile(words: np.ndarray, start: np.ndarray, n: np.ndarray, stop: np.ndarray, effort: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    walks, used = effort
    padded = np.r_[words, PAD]
    reach = _reach(n)
    most = int(reach.max())
    end = np.minimum(n, stop - start)
    keys, ok = np.empty((len(start), walks, used), K.U64), np.empty((len(start), walks, used), bool)
    spice = K.seeds(62, STEPS) | K.U64(1)
    share = (K.seeds(60, EFFORTS[-1][0] * SAMPLES * STEPS) >> K.U64(11)).astype(np.float64) / (1 << 53)
    share = share.reshape(-1, 1, SAMPLES, STEPS)
    windows = np.arange(len(start))[:, None, None]
    # a key's steps are near each other, so that edits elsewhere don't matter to it
    gap = np.clip(reach // 4, 1, NEAR)
    scale = np.stack([np.maximum(1, reach - (STEPS - 1) * gap), *[gap] * (STEPS - 1)], 1)
    embedded = np.empty((most, len(start)), K.U64)
    for walk in range(walks):
        factors = K.mix(K.seeds(61, most) + K.U64(walk)) | K.U64(1)
        at, stands = np.maximum(n - READ, 0) * (walk % 8) // 8, np.zeros(len(start), np.int64)
        for step in range(most):
            on = at < end
            word = padded[np.where(on, start + at, len(words))]
            embedded[step] = word
            stands += on
            at += ((word * factors[step]) >> K.U64(63)).astype(np.int64)
        places = (share[walk, :, :used] * scale[:, None, :]).astype(np.int64).cumsum(2)
        places[:, :, 1:] += np.arange(1, STEPS)
        key = (embedded[places, windows] * spice).sum(2, dtype=K.U64)
        keys[:, walk] = K.mix(key + n.astype(K.U64)[:, None] * K.U64(0x9E37) + K.seeds(63, EFFORTS[-1][0] * SAMPLES).reshape(-1, SAMPLES)[walk, :used])
        ok[:, walk] = (places < stands[:, None, None]).all(2)
    return keys, ok


def _edited(words: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    out = list(words)
    for _ in range(k):
        i, kind = int(r.integers(len(out))), int(r.integers(3))
        if kind == 0 and len(out) > 1:
            del out[i]
        elif kind == 1:
            out.insert(i, r.integers(1 << 63, dtype=np.uint64))
        else:
            out[i] = r.integers(1 << 63, dtype=np.uint64)
    return np.array(out, K.U64)


def length_class(n: np.ndarray) -> np.ndarray:
    """Eight classes an octave."""
    return (8 * np.log2(n)).astype(np.int64)


def _trials(items: list[np.ndarray]) -> list[int]:
    """Each item at least once, and TRIALS of each class of lengths (fewer, but 16, of long ones)."""
    n = np.array([len(x) for x in items])
    kinds = length_class(n)
    out = []
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        out += np.resize(own, max(min(TRIALS, max(16, TRIAL_WORDS // int(n[own[0]]))), len(own))).tolist()
    return out


def recall(items: list[np.ndarray], effort: tuple[int, int]) -> dict[int, float]:
    """By class of lengths: the share of simulated copies at the edit limit that some key finds.

    A copy stands among foreign words, and the window that is tried is as far from its
    begin as the windows around a seed may leave it.
    """
    r, found = np.random.default_rng(5), {}
    kinds = length_class(np.array([len(x) for x in items])) if items else np.zeros(0, np.int64)
    trials = _trials(items) if items else []
    for lo in range(0, len(trials), 1024):
        own = [items[t] for t in trials[lo : lo + 1024]]
        n = np.array([len(x) for x in own])
        both = []
        for copied in (False, True):
            parts, start, at = [], [], 0
            for x in own:
                off = stride(len(x)) // 2
                y = _edited(x, allowed(len(x)), r) if copied else x
                around = r.integers(1 << 63, size=(2, len(x)), dtype=np.uint64) if copied else np.zeros((2, 0), K.U64)
                start.append(at + around.shape[1] + (int(r.integers(-off, off + 1)) if copied else 0))
                parts += [around[0], y, around[1]]
                at += len(y) + around.size
            both.append((np.concatenate(parts), np.array(start)))
        (a, i), (b, j) = both
        (own_keys, fine), (keys, good) = lsh_keys(a, i, n, i + n, effort), lsh_keys(b, j, n, np.full(len(n), len(b)), effort)
        hit = ((own_keys == keys) & fine & good).any(1)
        for t, h in zip(trials[lo : lo + 1024], hit.tolist()):
            found.setdefault(int(kinds[t]), []).append(h)
    return {k: sum(v) / len(v) for k, v in found.items()}


def chance(items: list[np.ndarray], effort: tuple[int, int], words: np.ndarray, trials: int = 64) -> float:
    """The share of windows at random places of words that share a key with an item of their length."""
    r = np.random.default_rng(6)
    own = [items[t % len(items)] for t in range(trials)]
    n = np.array([len(x) for x in own])
    begin = np.cumsum(n) - n
    start = r.integers(0, max(1, len(words) - int(n.max())), trials)
    (a, fine), (b, good) = lsh_keys(np.concatenate(own), begin, n, begin + n, effort), lsh_keys(words, start, n, np.full(trials, len(words)), effort)
    return float(((a == b) & fine & good).any(1).mean())


def build(ids: list[int], texts: list[str]) -> Items:
    buf, offsets = K.texts(pa.array(texts, pa.large_string()))
    hashed, first = words_of(buf, offsets)
    kept = [(i, hashed[a:b]) for i, a, b in zip(ids, first[:-1], first[1:]) if b > a]
    words = [w for _, w in kept]
    n = np.array([len(w) for w in words], np.int64)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in {seed_length(int(x)) for x in n}:
        rows = [(K.gram_hashes(w, g), len(w)) for w in words if seed_length(len(w)) == g]
        table = np.unique(np.concatenate([np.stack([h, np.arange(len(h), dtype=K.U64), np.full(len(h), m, K.U64)], 1) for h, m in rows]), axis=0)
        seeds[g] = (table[:, 0], table[:, 1].astype(np.int64), table[:, 2].astype(np.int64))
    effort = efforts(words)
    start, flat = np.cumsum(n) - n, np.concatenate(words) if words else np.zeros(0, K.U64)
    owner, keys = keys_of(flat, start, n, start + n, effort)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    filled = np.zeros(1 << 22, bool)
    filled[keys >> K.U64(42)] = True
    return Items(np.array([i for i, _ in kept], np.int64), words, seeds, keys, owner[order], filled, effort)


def efforts(words: list[np.ndarray]) -> dict[int, int]:
    """The first of EFFORTS that brings each class of lengths to TARGET."""
    out: dict[int, int] = {}
    for k, effort in enumerate(EFFORTS):
        left = [w for w in words if out.get(int(length_class(np.array(len(w)))), NO_KEYS) == NO_KEYS]
        for kind, share in recall(left, effort).items():
            out[kind] = k if share >= TARGET else NO_KEYS
    return out


def keys_of(words: np.ndarray, start: np.ndarray, n: np.ndarray, stop: np.ndarray, effort: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(window, key): the keys of each window; windows without sampled keys have that of their length."""
    level = np.array([effort.get(int(k), NO_KEYS) for k in length_class(np.unique(n))], np.int64) if len(n) else n
    level = level[np.unique(n, return_inverse=True)[1]]
    own = np.flatnonzero(level == NO_KEYS)
    found = [(own, K.mix(n[own].astype(K.U64) + K.U64(1 << 50)))]
    for k, each in enumerate(EFFORTS):
        own = np.flatnonzero(level == k)
        if len(own):
            keys, ok = lsh_keys(words, start[own], n[own], stop[own], each)
            found.append((own[np.nonzero(ok)[0]], keys[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def edits(item: np.ndarray, text: np.ndarray) -> int:
    """The smallest word edit distance between item and any stretch of text."""
    row, at = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def _spots(words: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(start, n, stop, text) of item-sized windows around untouched seeds."""
    found = []
    for g, (seed, offset, n) in items.seeds.items():
        at, text = K.inside(first, g)
        if not len(at):
            continue
        grams = K.gram_hashes(words, g)[at]
        bits = np.zeros(1 << 20, bool)
        bits[seed >> K.U64(44)] = True
        near = np.flatnonzero(bits[grams >> K.U64(44)])
        lo, hi = np.searchsorted(seed, grams[near]), np.searchsorted(seed, grams[near], "right")
        near, lo, count = near[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        row = K.ranges(lo, count)
        hit = np.repeat(near, count)
        # n words have n - g + 1 seeds and an edit spoils g of them at most: a text with fewer hits can't leak the item
        k = n[row] // 5
        _, kind, hits = np.unique(text[hit] * (1 << 32) + n[row], return_inverse=True, return_counts=True)
        enough = hits[kind] >= n[row] - g + 1 - k * g
        row, hit, k = row[enough], hit[enough], k[enough]
        step = np.maximum(1, k // 4)
        width = -(-2 * k // step) + 1
        start = np.repeat(at[hit] - offset[row] - k, width) + K.ranges(np.zeros(len(row), np.int64), width) * np.repeat(step, width)
        where, size = np.repeat(text[hit], width), np.repeat(n[row], width)
        ok = start + size > first[where]
        found.append(np.stack([np.maximum(start, first[where]), size, where], 1)[ok])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    spots = np.unique(np.concatenate(found), axis=0)
    return spots[:, 0], spots[:, 1], first[spots[:, 2] + 1], spots[:, 2]


def leaks(buf: np.ndarray, offsets: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(text, item, edits) of the texts that leak items."""
    out: list[tuple[int, int, int]] = []
    for lo, hi in K.groups(offsets, 4 << 20):
        words, first = words_of(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        start, n, stop, text = _spots(words, first, items)
        pairs = []
        for a in range(0, len(start), 8192):
            part = slice(a, a + 8192)
            w, key = keys_of(words, start[part], n[part], stop[part], items.effort)
            near = items.filled[key >> K.U64(42)]
            w, key = w[near], key[near]
            left, right = np.searchsorted(items.keys, key), np.searchsorted(items.keys, key, "right")
            count = right - left
            owner = items.owner[K.ranges(left, count)]
            pairs.append(np.stack([np.repeat(text[part][w], count), owner, np.repeat(start[part][w], count)], 1))
        if not pairs:
            continue
        table = np.unique(np.concatenate(pairs), axis=0)
        best: dict[tuple[int, int], int] = {}
        until = -1
        last = (-1, -1)
        for t, i, s in table.tolist():
            item, k = items.words[i], allowed(len(items.words[i]))
            if best.get((t, i)) == 0 or ((t, i) == last and s < until):
                continue  # within the stretch that was compared
            # windows that start within the next n words are compared at once
            a, b = max(first[t], s - k), min(first[t + 1], s + 2 * len(item) + k)
            last, until = (t, i), s + len(item)
            own = words[a:b]
            if np.isin(item, own).sum() < len(item) - k:
                continue
            d = edits(item, own)
            if d <= k:
                best[t, i] = min(d, best.get((t, i), d))
        out += [(t + lo, i, d) for (t, i), d in best.items()]
    return out


def leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, edits) of every document and item that leaks into it; edits is the least found."""
    spark = docs.sparkSession
    source = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    slim = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = None
    for block in range(blocks):
        rows = sorted((r.item, r.text) for r in source.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect())
        shared = spark.sparkContext.broadcast(build([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                hits = leaks(*K.texts(batch.column(1)), items) if len(items.ids) else []
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[t].as_py() for t, _, _ in hits], pa.int64()), pa.array([int(items.ids[i]) for _, i, _ in hits], pa.int64()), pa.array([d for *_, d in hits], pa.int32())], ["id", "item", "edits"])

        part = slim.mapInArrow(trimmed(run), "id long, item long, edits int")
        found = part if found is None else found.union(part)
    out = found.groupBy("id", "item").agg(F.min("edits").alias("edits"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that leak an item."""
    key = fresh(docs, "__leaks")
    bad = leaked(docs, benchmark, id_col, text_col).select(F.col(id_col).alias(key)).distinct()
    return docs.join(bad, F.col(id_col).cast("long") == F.col(key), "left_anti")
