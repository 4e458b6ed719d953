"""Near-duplicate groups by b-bit MinHash.

1. Each document becomes the set of its distinct word shingles, 64-bit hashed,
   and the minima of ``bands * 4`` hash functions.  A band's key hashes four full
   minima; of every minimum only the low two bits are kept, as two bit planes.
2. Documents with one set (a 128-bit digest) become one representative.
3. Representatives that share a band key are candidates.  Each band's group has a
   pivot, its smallest member; full sets are compared with the pivot's, which links
   most members and keeps each set's difference from the pivot's.
4. Members that aren't linked with their pivot are compared with the other members of
   all groups of that pivot, in pairs of blocks of ``BLOCK`` members and ``BLOCK_BYTES``.
   Every pair, with a pivot or not, is first estimated from the number of lanes in which the planes
   differ, corrected for the chance that two low bits agree by accident; what is unlike beyond
   six deviations is no link, and the rest is confirmed on the full sets, by way of their differences from the pivot's.  A task gives out only links that
   join components, never the pairs.
5. Components by label propagation, all as tables.

Bands are chosen so that a pair at the threshold is missed with a probability under
1e-6; no bucket, partner or candidate is capped.

Defined results: fewer words than ``size`` make the whole sequence one shingle; no
words, or null, make the empty set, which is linked with nothing; a null id is never
linked (component null, kept); rows of one id are one vertex; empty tables work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, fresh, partitions, trimmed
from .components import components

PER_BAND = 4
#: Members of a block, and bytes of their differences from the pivot, at most (or one member).
BLOCK, BLOCK_BYTES = 1024, 8 << 20
MISS = 1e-6
#: More bands than this aren't made: similarities under a third or so.
MOST_BANDS = 2048


def bands_for(threshold: float) -> int:
    """As many bands of four as miss a pair at the threshold with a probability under MISS."""
    bands = math.ceil(math.log(MISS) / math.log(1 - threshold**PER_BAND)) if 0 < threshold < 1 else 1
    if threshold <= 0 or bands > MOST_BANDS:
        raise ValueError(f"a similarity of {threshold} takes more than {MOST_BANDS} bands")
    return bands


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = K.LOWER[buf]
    s, e, first = K.word_spans(low, offsets)
    words = K.span_hashes(low, s, e)
    grams = K.gram_hashes(words, size)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(K.gram_hashes(words[a:b], int(b - a)) ^ K.U64(b - a))
        else:
            out.append(np.zeros(0, K.U64))
    return out


def _minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(texts, n) minima; every set has members."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    xor, odd = K.seeds(7, n), K.seeds(8, n) | K.U64(1)
    out = np.empty((len(sets), n), K.U64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((flat ^ xor[k]) * odd[k], starts)
    return out


_SIGNED = "id long, n_shingles long, d1 long, d2 long, planes array<long>, bands array<long>"


def _sign(size: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = bands * PER_BAND
        lane, words = np.arange(n), -(-n // 64)
        names = ["id", "n_shingles", "d1", "d2", "planes", "bands"]
        for batch in batches:
            buf, offsets = K.texts(batch.column(1))
            for lo, hi in K.groups(offsets, 1 << 19):
                sets = shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                count = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(count)
                digest = np.zeros((2, hi - lo), K.U64)
                planes = np.zeros((hi - lo, 2 * words), K.U64)
                keys = np.zeros((hi - lo, bands), np.int64)
                if len(full):
                    flat = np.concatenate(sets)
                    starts = (np.cumsum(count) - count)[full]
                    digest[0, full] = np.add.reduceat(flat, starts)
                    digest[1, full] = np.add.reduceat(K.mix(flat + K.U64(0x51)), starts)
                    low = _minima([sets[i] for i in full], n)
                    for plane in (0, 1):
                        bit = ((K.mix(low) >> K.U64(plane)) & K.U64(1)) << (lane % 64).astype(K.U64)
                        for word in range(words):
                            planes[full, words * plane + word] = np.bitwise_or.reduce(bit[:, 64 * word : 64 * (word + 1)], 1)
                    odd = K.seeds(9, PER_BAND) | K.U64(1)
                    key = (low.reshape(len(full), bands, PER_BAND) * odd).sum(2, dtype=K.U64)
                    keys[full] = K.mix(key + np.arange(bands, dtype=K.U64) * K.U64(0x9E3779B97F4A7C15)).view(np.int64)
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64))]
                for table in (planes.view(np.int64), keys):
                    arrays.append(pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32), table.reshape(-1)))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def estimate(planes: np.ndarray, other: np.ndarray, lanes: int) -> np.ndarray:
    """Similarity of signatures, a row each, by the number of lanes whose two bits differ.

    Low bits of different minima agree by chance in a quarter of the lanes, so lanes
    differ with probability (1 - s) * 3 / 4.
    """
    x = planes.view(K.U64) ^ other.view(K.U64)
    half = x.shape[1] // 2
    differ = _BITS[np.ascontiguousarray(x[:, :half] | x[:, half:]).view(np.uint16)].sum(1)
    return 1 - differ / lanes * 4 / 3


def least_estimate(threshold: float, lanes: int) -> float:
    """What a pair at the threshold is estimated at, less six deviations."""
    p = (1 - threshold) * 0.75
    return threshold - 8 * math.sqrt(p * (1 - p) / lanes) - 1e-9


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.texts(batch.column(1))
            for lo, hi in K.groups(offsets):
                sets = shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "planes", "grams"])

    return run


_STARS = "pivot long, rep long, planes array<long>, base int, missing binary, added binary, linked boolean"


def _star(percent: int, lanes: int):
    """How each member's set differs from its pivot's, and whether the two are linked."""
    least = least_estimate(percent / 100, lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, missing, added, linked = [], [], [], []
            both = [np.stack([np.array(x, np.int64) for x in batch.column(k).to_pylist()]) for k in (2, 3)] if len(batch) else None
            like = estimate(*both, lanes) >= least if both else []
            for close, p, x in zip(like, batch.column(4), batch.column(5)):
                p, x = np.frombuffer(p.as_py(), K.U64), np.frombuffer(x.as_py(), K.U64)
                at = np.minimum(np.searchsorted(p, x), max(len(p) - 1, 0))
                both = p[at] == x if len(p) else np.zeros(len(x), bool)
                lost = np.ones(len(p), bool)
                lost[at[both]] = False
                n = int(both.sum())
                base.append(len(p))
                missing.append(p[lost].tobytes())
                added.append(x[~both].tobytes())
                linked.append(bool(close) and 100 * n >= percent * (len(p) + len(x) - n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(base, pa.int32()), pa.array(missing, pa.binary()), pa.array(added, pa.binary()), pa.array(linked, pa.bool_())], ["pivot", "rep", "planes", "base", "missing", "added", "linked"])

    return run


_ADDED = K.U64(0xA5A5A5A5A5A5A5A5)


def _links_between(rows: list[dict], percent: int, lanes: int) -> list[tuple[int, int]]:
    """Links of the outliers (side 0) with the members (side 1) that join components.

    With I the pivot's set, |x & m| = |I| - |I - x| - |I - m| + (what both lack of I and
    what both add to it), so full sets are compared by their differences from the pivot.
    """
    outer = [r for r in rows if r["side"] == 0]
    member = [r for r in rows if r["side"] == 1]
    if not outer or not member:
        return []
    lack = [np.frombuffer(r["missing"], K.U64) for r in member]
    add = [np.frombuffer(r["added"], K.U64) for r in member]
    base = member[0]["base"]
    gone, more = np.array([len(x) for x in lack]), np.array([len(x) for x in add])
    size = base - gone + more
    keys = np.concatenate([y for x, a in zip(lack, add) for y in (x, a ^ _ADDED)])
    owner = np.repeat(np.arange(len(member)), gone + more)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    planes = np.array([r["planes"] for r in member], np.int64)
    least = least_estimate(percent / 100, lanes)
    ids = np.array([r["rep"] for r in member])
    hub = -1  # stands for the pivot; members have their positions
    root = {hub: hub}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    place = {int(i): k for k, i in enumerate(ids)}
    for k, r in enumerate(member):
        if r["linked"]:
            root[k] = hub
    out = []
    for n, r in enumerate(outer):
        me = place.get(r["rep"], len(member) + n)
        near = (estimate(planes, np.array(r["planes"], np.int64), lanes) >= least) & (ids != r["rep"])
        if not near.any():
            continue
        own_lack, own_add = np.frombuffer(r["missing"], K.U64), np.frombuffer(r["added"], K.U64)
        mine = np.concatenate([own_lack, own_add ^ _ADDED])
        lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
        shared = np.bincount(owner[K.ranges(lo, hi - lo)], minlength=len(member))
        both = base - len(own_lack) - gone + shared
        either = base - len(own_lack) + len(own_add) + size - both
        for k in np.flatnonzero(near & (100 * both >= percent * either)).tolist():
            a, b = find(me), find(k)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((min(r["rep"], int(ids[k])), max(r["rep"], int(ids[k]))))
    return out


def _apart(percent: int, lanes: int):
    """Rows come sorted by (pivot, i, j): one pair of blocks is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            found = _links_between(held, percent, lanes)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if (key := (row["pivot"], row["i"], row["j"])) != now:
                    yield from links()
                    now, held = key, []
                held.append(row)
        yield from links()

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) a row of docs; linked at 100 * |A ∩ B| >= percent * |A ∪ B|."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    bands = bands_for(percent / 100)
    lanes = bands * PER_BAND
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.put("signed", slim.mapInArrow(trimmed(_sign(size, bands)), _SIGNED))
    full = signed.filter("n_shingles > 0 and id is not null")
    classes = scratch.put("classes", full.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.min_by("planes", "id").alias("planes"), F.min_by("bands", "id").alias("bands")))
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    live = scratch.put("live", keyed.join(shared, "key"))
    stars = live.filter("rep != pivot").select("pivot", "rep").distinct()
    ids = live.select("rep").distinct().join(classes.select("rep", "planes"), "rep")
    chosen = slim.join(ids, slim.id == ids.rep).select("rep", "text", "planes")
    sets = scratch.put("sets", chosen.mapInArrow(trimmed(_sets(size)), "rep long, planes array<long>, grams binary"))
    both = stars.join(sets, "rep").join(sets.select(F.col("rep").alias("pivot"), F.col("planes").alias("base_planes"), F.col("grams").alias("base")), "pivot")
    star = scratch.put("stars", both.select("pivot", "rep", "planes", "base_planes", "base", "grams").mapInArrow(trimmed(_star(percent, lanes)), _STARS))
    # groups in which some member isn't linked with the pivot: those outliers against all members, in blocks
    size = (F.octet_length("missing") + F.octet_length("added")).cast("long")
    apart = ~F.col("linked")
    group = star.groupBy("pivot").agg(F.count("*").alias("n"), F.count_if(apart).alias("m"), F.sum(size).alias("nb"), F.sum(F.when(apart, size)).alias("mb")).filter("m > 0 and n > 1")

    def blocks(rows: str, held: str) -> F.Column:
        return F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(held) / BLOCK_BYTES)).cast("int")

    group = group.select("pivot", blocks("n", "nb").alias("nj"), blocks("m", "mb").alias("ni"))
    dealt = star.join(group, "pivot").withColumn("h", F.xxhash64("rep"))
    member = dealt.select("pivot", "rep", "planes", "base", "missing", "added", "linked", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod("h", "nj").cast("int").alias("j"))
    outer = dealt.filter("not linked").select("pivot", "rep", "planes", "base", "missing", "added", "linked", F.lit(0).alias("side"), F.pmod("h", "ni").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
    rows = member.union(outer).repartition(partitions(spark), "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    links = scratch.put("links", rows.mapInArrow(trimmed(_apart(percent, lanes)), "a long, b long"))
    # rows of one id with several texts join the classes of these texts
    text_class = F.struct("n_shingles", "d1", "d2")
    mixed = signed.filter("id is not null").groupBy("id").agg(F.min(text_class).alias("lo"), F.max(text_class).alias("hi")).filter(~F.col("lo").eqNullSafe(F.col("hi"))).select("id")
    tied = scratch.put("tied", full.join(mixed, "id", "left_semi").join(classes.select("d1", "d2", "n_shingles", "rep"), ["d1", "d2", "n_shingles"]).select("id", "rep").distinct())
    least = tied.groupBy("id").agg(F.min("rep").alias("low"))
    same = tied.join(least, "id").filter("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    label = components(star.filter("linked").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).union(links).union(same), scratch, "label")
    scratch.drop("live", "sets", "stars", "links", "label-edges")
    root = classes.select("d1", "d2", "n_shingles", "rep").join(label.withColumnRenamed("v", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("label", "rep").alias("root"))
    out = signed.select("id", "n_shingles", "d1", "d2").join(root, ["d1", "d2", "n_shingles"], "left")
    # a row without shingles goes with the other rows of its id
    own = least.join(label.withColumnRenamed("v", "low"), "low", "left").select("id", F.coalesce("label", "low").alias("own"))
    out = out.join(own, "id", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("root", "own", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that aren't the smallest id of their component."""
    gone = near_duplicates(docs, size, percent, id_col, text_col).filter(~F.col("kept"))
    key = fresh(docs, "__gone")
    gone = gone.select(F.col(id_col).alias(key)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")
