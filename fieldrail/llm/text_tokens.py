"""Token ids of whole texts with a vocabulary file of the tokenizers library.

Some tokenizers drop white space before they match anything, so that a text's ids
are those of its words in order.  For them each distinct word is encoded once and
texts are put together from words (``joins``); for all others texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from . import kernels as K
from .span_memo import SpanMemo, flat

_LETTER = np.array([chr(c).isascii() and chr(c).isalpha() for c in range(256)])
_OTHER = (~_LETTER).astype(np.int32)
#: Marks that end words; a cut between a letter and a run of them at a word's end is a cut between pre-tokens.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,!?;:$&%*#\"()[]{}-_/+=@~^`\\")] = True
#: Words that go to the library in one text.
TOGETHER = 256


def drops_space(spec: dict) -> bool:
    """Whether the file's own rules keep only matches that have no white space in them."""
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    norm = spec.get("normalizer") or {}
    kinds = {x["type"] for x in norm.get("normalizers", [norm] if norm else [])}
    strips = any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
    pattern = first["pattern"].get("Regex", "")
    return kinds <= {"NFC", "Replace", "Lowercase"} and not strips and pattern.endswith(r"[^\s\p{L}\p{N}]+") and r"\s+" not in pattern.replace(r"[^\s", "")


#: Words that neither normalisation nor the matcher changes: one pre-token, as they stand.
_PLAIN = re.compile("[a-zßà-öø-ÿ]+")


@lru_cache(maxsize=2)
def text_tokens(spec: str) -> TextTokens:
    """One for each vocabulary in a Python worker: what it has learned stays for the next task."""
    return TextTokens(spec)


class TextTokens:
    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parsed = json.loads(spec)
        self.joins = drops_space(parsed)
        self.lowers = self.joins and "Lowercase" in json.dumps(parsed.get("normalizer"))
        self.special = [t["content"].encode() for t in parsed.get("added_tokens", [])]
        # a cut before marks must not part a special string
        self.cuts = not any(_TAIL[list(t)].any() for t in self.special)
        # nor may a word of letters be or hold one
        self.lowers = self.lowers and not any(_PLAIN.fullmatch(t.decode().lower()) for t in self.special)
        self.bare = None
        if self.lowers:
            lines = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
            step = {"type": "Sequence", "pretokenizers": [lines, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            self.bare = Tokenizer.from_str(json.dumps(parsed | {"normalizer": None, "pre_tokenizer": step, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}))
            self.bare.model._resize_cache(0)  # every word comes once
        self.memo = SpanMemo(self._words)

    def _words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Plain words skip the normaliser and the matcher, which would not change them, and go many at a time, a line each."""
        if self.bare is None:
            return words, *flat(self._ids(words))
        plain, rest = [], []
        for word in words:
            (plain if _PLAIN.fullmatch(word) else rest).append(word)
        lists, sizes = [], []
        for lo in range(0, len(plain), TOGETHER):
            own = plain[lo : lo + TOGETHER]
            found = self.bare.encode("\n".join(own), add_special_tokens=False)
            lists.append(found.ids)
            sizes.append(np.bincount(found.word_ids, minlength=len(own)))
        ids, _ = flat(lists)
        more, own = flat(self._ids(rest))
        return plain + rest, np.concatenate([ids, more]), np.concatenate([*sizes, own])

    @staticmethod
    def _run(tokenizer, texts: list[str]) -> list[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel; threads for short words cost more than they give
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return self._run(self.tokenizer, texts)

    @staticmethod
    def _lowered(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Spans of ASCII letters only in lower case, so that they are encoded once; in others the library's normaliser may see more than letters."""
        other = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_OTHER[buf], out=other[1:])
        mixed = np.flatnonzero(other[s] != other[e])
        out = K.LOWER[buf]
        at = K.ranges(s[mixed], e[mixed] - s[mixed])
        out[at] = buf[at]
        return out

    def spans(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first, ids, count): stretches whose ids follow each other, and their ids.

        Stretch i of text t has first[t] <= i < first[t + 1].  No stretch's ids
        depend on what stands outside of it.
        """
        if not self.joins:
            raw = buf.tobytes()
            lists = self._ids([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
            ids = np.array([i for x in lists for i in x], np.int32)
            return offsets[:-1], offsets[1:], np.arange(len(offsets)), ids, np.array([len(x) for x in lists], np.int64)
        s, e, first = K.word_spans(buf, offsets)
        if self.cuts and len(s):
            # words part before the marks that end them
            solid = np.maximum.accumulate(np.where(_TAIL[buf], -1, np.arange(len(buf))))
            cut = solid[e - 1] + 1
            cut = np.where((cut > s) & (cut < e) & _LETTER[buf[np.maximum(cut, 1) - 1]], cut, e)
            parts = 1 + (cut < e)
            at = np.cumsum(parts) - parts
            starts, ends = np.empty(int(parts.sum()), np.int64), np.empty(int(parts.sum()), np.int64)
            starts[at], ends[at] = s, cut
            two = np.flatnonzero(cut < e)
            starts[at[two] + 1], ends[at[two] + 1] = cut[two], e[two]
            first = np.r_[at, len(starts)][first]
            s, e = starts, ends
        if self.lowers and len(s):
            buf = self._lowered(buf, s, e)
        ids, count = self.memo.spans(buf, s, e)
        return s, e, first, ids, count

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text)."""
        _, _, first, ids, count = self.spans(buf, offsets)
        return ids, np.r_[0, np.cumsum(count)][first]
