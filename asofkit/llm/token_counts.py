"""Token counts by rank-synchronous merging over ragged numpy arrays.

The pre-tokens of a batch that were not seen before lie end to end in one array of symbol ids. In each step
every sequence finds its pair of lowest rank and joins all places of that pair at once; sequences without a
ranked pair leave the arrays. The symbols that survive are the tokens. Long pre-tokens have their places kept by
rank, so that a step looks only at the places of its pair and those beside them, and not at the whole array.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import arrays

REMEMBERED = 400_000
#: Pre-tokens of more bytes have their places kept by rank.
LONG = 256
_NONE = np.iinfo(np.int64).max
#: Lower-case letters that str.lower() gives by context, or not yet.
_LOWER = {ord("Σ"): "σ", 0xA7CB: "\u0264", 0xA7DC: "\u019b"}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class Counter(dict):
    """pre-token -> how many symbols its merges leave."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, parts = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or parts[0]["type"] != "Split" or not parts[0]["invert"] or parts[1]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file whose pattern keeps its matches is needed")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        self.compose, self.lower = "NFC" in steps, "Lowercase" in steps
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters])
        self.last = np.array([vocab[c + suffix] for c in letters])
        left, right = (np.array([vocab[m[i]] for m in model["merges"]], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.size = len(vocab) + len(special)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made, self.made_by_rank = key[order], order.astype(np.int64), made[order], made

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """How many special tokens a text holds, and the pre-tokens of the rest."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for part in parts:
            if self.compose:
                part = unicodedata.normalize("NFC", part)
            if self.lower:  # letter by letter: a final sigma is no special case
                part = part.translate(_LOWER).lower()
            out += self.pattern.findall(part)
        return len(parts) - 1, out

    def learn(self, pieces: list[str]) -> None:
        """Counts new pre-tokens together."""
        raw = [p.encode() for p in pieces]
        for some, count in (([k for k, r in enumerate(raw) if len(r) <= LONG], self._together), ([k for k, r in enumerate(raw) if len(r) > LONG], self._by_rank)):
            if some:
                sizes = np.array([len(raw[k]) for k in some])
                data, ends = np.frombuffer(b"".join(raw[k] for k in some), np.uint8), np.cumsum(sizes)
                symbols = self.inner[data]
                symbols[ends - 1] = self.last[data[ends - 1]]
                self.update(zip((pieces[k] for k in some), count(symbols, sizes).tolist(), strict=True))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def _by_rank(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence: the lowest rank there is, with all its places, comes from a heap; only their neighbours are ranked anew.

        Sequences do not touch, so one order of ranks serves all of them.
        """
        n, first = len(symbols), np.cumsum(sizes) - sizes
        following, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        following[first + sizes - 1], before[first] = n, n  # place n stands for nothing
        following[n] = before[n] = n
        symbols, alive = np.append(symbols, -1).astype(np.int32), np.ones(n, bool)
        rank = np.full(n + 1, _NONE)
        inner = np.flatnonzero(following[:n] < n)
        rank[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        places, heap = defaultdict(list), []

        def enter(at: np.ndarray) -> None:
            at = at[rank[at] < _NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for r, own in zip(rank[at[cuts]].tolist(), np.split(at, cuts[1:]), strict=True):
                if r not in places:
                    heapq.heappush(heap, r)
                places[r].append(own)

        if len(inner):
            enter(inner)
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            # in a run of one symbol the pairs overlap: every second one counts, from the left
            fresh = np.ones(len(at), bool)
            fresh[1:] = following[at[:-1]] != at[1:]
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            symbols[at], following[at] = self.made_by_rank[r], following[gone]
            before[following[at]] = at
            before[n] = n
            alive[gone], rank[gone] = False, _NONE
            beside = np.unique(np.concatenate([at, before[at]]))
            beside = beside[beside < n]
            rank[beside] = np.where(following[beside] < n, self._ranks(symbols[beside], symbols[following[beside]]), _NONE)
            enter(beside)
        return np.add.reduceat(alive.astype(np.int64), first)

    def _together(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence, all of which take their steps at once."""
        counts, own = sizes.copy(), np.arange(len(sizes))
        owner = np.repeat(own, sizes)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ranked = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(ranked, self.rank[at], _NONE)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(np.append(rank, _NONE), first)
            going = least < _NONE
            if not going.any():
                break
            length = np.diff(np.append(first, len(symbols)))
            joins = np.append(rank, _NONE) == np.repeat(np.where(going, least, -1), length)
            # in a run of one symbol the pairs overlap: every second one counts, from the left
            places = np.flatnonzero(joins)
            fresh = np.diff(places, prepend=-2) > 1
            run = np.cumsum(fresh) - 1
            places = places[(np.arange(len(places)) - np.flatnonzero(fresh)[run]) % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self.made[at[places]]
            stay = np.ones(len(symbols), bool)
            stay[places + 1] = False
            counts[owner[first]] = np.add.reduceat(stay.astype(np.int64), first)
            stay &= np.repeat(going, length)
            symbols, owner = symbols[stay], owner[stay]
        return counts

    def count(self, rows: list[str]) -> list[int]:
        split = [self.pieces(t) for t in rows]
        if len(self) > REMEMBERED:
            self.clear()
        new = list({p for _, own in split for p in own if p not in self})
        if new:
            self.learn(new)
        return [n + sum(map(self.__getitem__, own)) for n, own in split]


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str, limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text has no tokens. A special token's string inside a text is one token, as the library
    counts it. Repeated rows give repeated results.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for rows, _, at in arrays.slices(batches):
            n = np.array(own.count(rows.column("text").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrays.texts(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
