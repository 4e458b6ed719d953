"""Token ids of many short spans, each distinct one encoded once."""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from . import kernels as K

os.environ.setdefault("RAYON_NUM_THREADS", "2")  # threads of the tokenizers library in each Python worker

#: Distinct spans that are remembered at once; then those that came in one batch only are forgotten.
MOST = 1 << 19


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of lists of ids."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class SpanMemo:
    """Bounded memory; results don't depend on it.

    encode: (the texts in an order of its own, their ids one after the other, number of ids of each) of a list of texts.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], most: int = MOST) -> None:
        self.encode, self.most = encode, most
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int64)
        self.batches = np.zeros(1 << 14, np.uint8)

    def _forget(self) -> None:
        n = len(self.index)
        keep = self.batches[:n] > 1
        if keep.sum() > self.most // 2:
            keep[:] = False
        size = np.diff(self.first[: n + 1])
        ids = self.ids[K.ranges(self.first[:n][keep], size[keep])]
        self.index = {k: i for i, k in enumerate(k for k, stays in zip(self.index, keep.tolist()) if stays)}
        self.ids[: len(ids)] = ids
        self.first[: len(self.index) + 1] = np.r_[0, np.cumsum(size[keep])]
        self.batches[:] = 0

    def _learn(self, keys: list[bytes]) -> None:
        texts, ids, sizes = self.encode([k.decode() for k in keys])
        at, total = len(self.index), int(sizes.sum())
        end = int(self.first[at])
        while end + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(keys) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.batches = np.concatenate([self.batches, np.zeros_like(self.batches)])
        self.ids[end : end + total] = ids
        self.first[at + 1 : at + 1 + len(keys)] = end + np.cumsum(sizes)
        self.index.update(zip((t.encode() for t in texts), range(at, at + len(texts))))

    def spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans in order, number of ids of each span)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.index) > self.most:
            self._forget()
        _, at, back = np.unique(K.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        if K.same_spans(buf, starts, ends, at[back]):
            keys = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        else:  # two spans share a hash: they are told apart by their bytes
            place: dict[bytes, int] = {}
            every = (raw[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
            back = np.fromiter((place.setdefault(k, len(place)) for k in every), np.int64, len(starts))
            keys = list(place)
        own = np.fromiter((self.index.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(own < 0)
        if len(new):
            self._learn(list(dict.fromkeys(keys[i] for i in new.tolist())))
            own[new] = np.fromiter((self.index[keys[i]] for i in new.tolist()), np.int64, len(new))
        self.batches[own] = np.minimum(self.batches[own], 254) + 1
        row = own[back]
        count = self.first[row + 1] - self.first[row]
        return self.ids[K.ranges(self.first[row], count)], count
