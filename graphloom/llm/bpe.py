"""Token ids of a byte-level BPE, through the tokenizers library, a distinct piece of text at a time.

The library splits a text into pieces before it merges bytes, and never
merges across pieces. So the pieces of many texts are found with numpy, each
distinct one is encoded once by the library, and the ids are put together.
Texts with code points above U+024F, apostrophes or the mark of special
tokens go to the library whole, and so do all where the vocabulary's file names
another splitting rule than the one known here.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from .ragged import U64, mix, powers

# a worker has one core: the library's threads would only wait for each other
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LATIN_END = 0x250
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
_CLASS = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LATIN_END)], np.uint8)
_CLASS[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = SPACE
_VALUES = mix(np.arange(LATIN_END, dtype=np.uint64) + U64(0x51ED270B))
_BEYOND = re.compile(f"[{chr(LATIN_END)}-{chr(0x10FFFF)}]")


def beyond(text: str) -> bool:
    """Whether a code point lies outside the table of classes."""
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return _BEYOND.search(text) is not None


def splits_as_known(path: str) -> bool:
    """Whether a tokenizer's file has the splitting rule that is written out here: byte-level BPE, nothing normalised, special tokens in ``<|``."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    rule, model = held.get("pre_tokenizer") or {}, held.get("model") or {}
    plain = rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space") and rule.get("use_regex", True) and held.get("normalizer") is None
    return bool(plain and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and all(t["content"].startswith("<|") for t in held.get("added_tokens") or []))


class Rows:
    """Row numbers by 64-bit key, by open addressing: whole arrays are looked up and put in at once."""

    def __init__(self, most: int):
        self.bits = max(10, (2 * most - 1).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys (none is 0), -1 where there is none."""
        out, open_, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self.places(keys)
        while len(open_):
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.rows[at[hit]]
            more = ~hit & (held != 0)
            open_, at = open_[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """New and distinct keys with their rows."""
        at = self.places(keys)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.rows[at[mine]] = rows[mine]
            keys, rows, at = keys[~mine], rows[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)


class PieceEncoder:
    """Keeps the ids of up to ``most`` distinct pieces; when full, the half that was met most often stays."""

    def __init__(self, path: str, most: int = 600_000):
        self.tokenizer, self.most, self.known_rule = Tokenizer.from_file(path), most, splits_as_known(path)
        spelled = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(spelled.values()) + 1, np.int64)
        self.widths[list(spelled.values())] = [len(t) for t in spelled]  # one character a byte
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if len(self.widths) <= 1 << 16 else np.uint32), 0
        self.n, self.rows = 0, Rows(most)
        self.keys, self.begins, self.sizes, self.met = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def thin(self, wanted: int) -> None:
        n = self.n
        stay = np.sort(np.argsort(-self.met[:n], kind="stable")[: n // 2])
        sizes, keys = self.sizes[stay], self.keys[stay]
        self.flat = self.flat[np.repeat(self.begins[stay] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.n, self.used, self.keys, self.sizes, self.begins, self.met = len(stay), len(self.flat), keys, sizes, np.cumsum(sizes) - sizes, self.met[stay] // 2
        self.rows = Rows(max(self.most, self.n + wanted))  # a single text may hold more pieces than are kept
        self.rows.put(keys, np.arange(self.n, dtype=np.int32))

    def add(self, keys: np.ndarray, texts: list[str]) -> None:
        # pieces of a blank and letters are split the same way when they stand one after the other: so encoded, they cost half
        whole = np.fromiter((t[0] == " " and t[1:].isalpha() for t in texts), bool, len(texts))
        plain, others = np.flatnonzero(whole).tolist(), np.flatnonzero(~whole).tolist()
        runs = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for some in (runs[i : i + 100] for i in range(0, len(runs), 100)):
            found = self.tokenizer.encode_batch_fast(["".join([texts[i] for i in run]) for run in some], add_special_tokens=False)
            ids = np.concatenate([np.asarray(x.ids, np.uint32) for x in found])
            order = [i for run in some for i in run]
            upto = np.cumsum([len(texts[i].encode()) for i in order])
            self.keep(keys[order], ids, np.diff(np.searchsorted(np.cumsum(self.widths[ids]), upto, "left") + 1, prepend=0))
        for low in range(0, len(others), 20_000):
            part = others[low : low + 20_000]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.keep(keys[part], np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes)

    def keep(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        row, upto = self.n, self.n + len(keys)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 2, len(ids)), self.flat.dtype)])
        if upto > len(self.keys):
            more = max(len(self.keys) // 2, len(keys))
            self.keys, self.begins, self.sizes, self.met = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.keys, self.begins, self.sizes, self.met))
        self.flat[self.used : self.used + len(ids)] = ids
        self.keys[row:upto], self.begins[row:upto], self.sizes[row:upto] = keys, self.used + np.cumsum(sizes) - sizes, sizes
        self.rows.put(keys, np.arange(row, upto, dtype=np.int32))
        self.n, self.used = upto, self.used + len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        whole = [i for i, t in enumerate(texts) if not self.known_rule or "'" in t or "<|" in t or not t.isascii() and beyond(t)]
        direct = dict(zip(whole, (x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)))) if whole else {}
        ids, counts = self._pieces([("" if i in direct else t) for i, t in enumerate(texts)] if direct else texts)
        if not direct:
            return ids, counts
        edges, parts = np.concatenate([[0], np.cumsum(counts)]), []
        for i in range(len(texts)):
            parts.append(np.asarray(direct[i], np.uint32) if i in direct else ids[edges[i] : edges[i + 1]])
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a few texts: where pieces begin, their keys, and the pieces before each text's end."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n, edges = len(codes), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        kind = _CLASS[codes]
        first = np.zeros(n + 1, bool)
        first[edges] = True
        last, first = first[1:], first[:-1]
        before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
        before[:1], before[1:] = 0, kind[:-1]
        before[first] = 0
        after[-1:], after[:-1] = 0, kind[1:]
        after[last] = 0
        taken = np.zeros(n, bool)
        taken[1:] = codes[:-1] == 0x20
        taken &= ~first
        # a run of one kind begins a piece, with one blank before it; of several white spaces before a run, the last stands apart
        begins = np.flatnonzero(np.where(kind == SPACE, (before != SPACE) | (after != SPACE) & (after != 0), (kind != before) & ~taken))
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_VALUES[codes] * up[:n], out=sums[1:])
        at = sums[begins]
        return begins, mix((np.append(at[1:], sums[n:])[: len(at)] - at) * down[begins]) | U64(1), np.searchsorted(begins, edges[1:])

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, low, chars, before = [], 0, 0, 0
        while low < len(texts):  # a few at a time, so that the arrays stay in the cache
            high, size = low, 0
            while high < len(texts) and (high == low or size < 200_000):
                size += len(texts[high])
                high += 1
            begins, keys, upto = self._split(texts[low:high])
            parts.append((begins + chars, keys, upto + before))
            low, chars, before = high, chars + size, before + len(begins)
        if not chars:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        joined = "".join(texts)
        begins, keys, upto = (np.concatenate([p[i] for p in parts]) for i in range(3))
        which, distinct = pd.factorize(keys)
        if self.n + len(distinct) > self.most:
            self.thin(len(distinct))
        found = self.rows.get(distinct)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            at = np.full(len(distinct), -1, np.int64)
            at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            ends, at = np.append(begins, chars)[at[missing] + 1].tolist(), begins[at[missing]].tolist()
            self.add(distinct[missing], [joined[x:y] for x, y in zip(at, ends)])
            found[missing] = self.rows.get(distinct[missing])
        self.met[found] += 1
        rows = found[which]
        sizes = self.sizes[rows]
        total = int(sizes.sum())
        ids = self.flat[np.repeat(self.begins[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)].astype(np.uint32)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[upto], prepend=0)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str, most: int = 600_000) -> PieceEncoder:
    """One encoder a worker process, of the size that was asked for last."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path, most)
    _encoders[path].most = most
    return _encoders[path]
