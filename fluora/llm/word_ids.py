"""Token ids of texts by a tokenizer of the tokenizers library that drops white space.

As no token reaches over white space, a text falls into words at plain separators, and each new word is encoded once.
Words stay bytes in numpy: they are told apart by a hash, looked up in a sorted table, and compared with the word that the
table holds; what differs, and words of over ``LONG`` bytes, go through the tokenizer by themselves. The table is bounded.

New words of Latin letters are cut into the model's units here, by the tokenizer's own pattern after its own normalizer,
and only the units go to its model; all other words go through the tokenizer whole.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import pairwise

import numpy as np

#: Words, and units of words, that a task keeps from batch to batch (60 and 200 bytes each); what is full is emptied.
CACHE, UNITS = 2_000_000, 300_000
#: Texts are passed to the tasks in batches of so many.
BATCH = 512
#: Separators of words that the tokenizer drops (others are left to it).
GAPS = b" \n\t\r"
#: Longest word of the table, and the bytes of text whose words are looked up together.
LONG, WINDOW = 256, 1 << 20
#: Stands between the ids of words; no id has this value.
CUT = b"\xff\xff\xff\xff"
#: An odd number, whose powers weigh the bytes of a word, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of runs of the given sizes, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


class WordIds:
    """A tokenizer file, prepared for encoding whole texts without special tokens around them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        drops = split.get("behavior") == "Removed" and split.get("invert") and [r["type"] for r in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        if not drops or kinds != ["NFC", "Replace", "Lowercase"] or spec["post_processor"]:
            raise ValueError("the tokenizer isn't one that lower-cases, drops white space and cuts words by a pattern")
        if any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("the tokenizer has added tokens that reach over white space")
        # units of words that are joined by blanks, and the blanks
        self.units = regex.compile(split["pattern"]["Regex"] + "| ").findall
        marks = {re.escape(t["content"][:2]) for t in spec["added_tokens"]}
        self.odd = re.compile("|".join(["[^ -~¡-ɏ]", *sorted(marks)])).search
        # bytes as the model spells them: printable ones stand for themselves, the others for characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = iter(range(256, 512))
        self.spelt = {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}
        self.is_gap = np.isin(np.arange(256), list(GAPS))
        near = np.arange(WINDOW + LONG)
        self.power, self.inverse = (np.multiply.accumulate(np.where(near, np.uint64(b), np.uint64(1)), dtype=np.uint64) for b in (BASE, BACK))
        self.parts: dict[str, bytes] = {" ": CUT}
        self._empty()

    def _empty(self) -> None:
        """An empty table: words by number, as bytes and ids one after another, and the sorted hashes with the words' numbers."""
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _latin(self, words: list[str]) -> list[bytes]:
        """The ids of words of printable characters below U+0250. They are normalized together, as blanks between them stay."""
        if not words:
            return []
        if len(self.parts) > UNITS:
            self.parts = {" ": CUT}
        units = self.units(self.whole.normalizer.normalize_str(" ".join(words)))
        for u in set(units).difference(self.parts):
            spelt = u if u.isascii() else u.encode().decode("latin-1").translate(self.spelt)
            self.parts[u] = array("I", [t.id for t in self.whole.model.tokenize(spelt)]).tobytes()
        return b"".join(map(self.parts.__getitem__, units)).split(CUT)

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.whole.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Puts words that the table doesn't have into it; the hashes are sorted."""
        texts = [w.decode() for w in words]
        plain = [not self.odd(t) for t in texts]
        latin = iter(self._latin([t for t, p in zip(texts, plain, strict=True) if p]))
        ids = [next(latin) if p else self._whole(w) for w, p in zip(words, plain, strict=True)]
        at = np.searchsorted(self.hashes, hashes)
        self.numbers = np.insert(self.numbers, at, len(self.text_at) - 1 + np.arange(len(words)))
        self.hashes = np.insert(self.hashes, at, hashes)
        for whole, offsets, new in (("text", "text_at", words), ("ids", "ids_at", ids)):
            have, ends = getattr(self, whole), getattr(self, offsets)
            add = np.frombuffer(b"".join(new), have.dtype)
            setattr(self, whole, np.concatenate([have, add]))
            setattr(self, offsets, np.concatenate([ends, ends[-1] + np.cumsum([len(x) // have.itemsize for x in new])]))

    def _numbers(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers in the table of words of a window; -1 where the table has another word of the same hash."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)])
        hashes, some, which = np.unique((sums[first + sizes] - sums[first]) * self.inverse[first], return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a : a + n] for a, n in zip(first[some[new]].tolist(), sizes[some[new]].tolist(), strict=True)])
        found = self.numbers[np.searchsorted(self.hashes, hashes)][which]
        held = self.text_at[found]
        same = self.text_at[found + 1] - held == sizes
        both = np.flatnonzero(same)
        equal = data[_spread(first[both], sizes[both])] == self.text[_spread(held[both], sizes[both])]
        same[both] = np.logical_and.reduceat(equal, np.cumsum(sizes[both]) - sizes[both]) if len(both) else False
        return np.where(same, found, -1)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and the place where each text's begin (and the end of all).

        ``data`` has the bytes of the texts in UTF-8, ``bounds`` where each begins (and the end of all).
        """
        if len(self.hashes) > CACHE:
            self._empty()
        inside = ~self.is_gap[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        first = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        sizes = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 - first
        ids, counts = [], np.zeros(len(first), np.int64)
        long = sizes > LONG
        window = np.where(long, -1 - np.arange(len(first)), first // WINDOW)  # long words are windows of their own
        cuts = np.flatnonzero(np.diff(window, prepend=-(1 << 62))).tolist()
        for a, b in pairwise([*cuts, len(first)]):
            if long[a]:
                found = np.full(1, -1)
            else:
                base = first[a] // WINDOW * WINDOW
                found = self._numbers(data[base : base + WINDOW + LONG], first[a:b] - base, sizes[a:b])
            n = np.where(found >= 0, self.ids_at[found + 1] - self.ids_at[found], 0)
            own = [np.frombuffer(self._whole(data[first[i] : first[i] + sizes[i]].tobytes()), np.uint32) for i in a + np.flatnonzero(found < 0)]
            some = self.ids[_spread(self.ids_at[found], n)] if len(self.ids) else np.zeros(0, np.uint32)
            if own:  # rare
                some = np.insert(some, np.repeat(np.cumsum(n)[found < 0], [len(x) for x in own]), np.concatenate(own))
                n[found < 0] = [len(x) for x in own]
            ids.append(some)
            counts[a:b] = n
        ends = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), ends[np.searchsorted(first, bounds)]


_tokenizers: dict[str, WordIds] = {}


def tokenizer(path: str) -> WordIds:
    """One for each file and worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def tokenizer_path() -> str:
    """The public tokenizer with word ends of the tokenizer package, as a default for the parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
