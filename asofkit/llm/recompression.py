"""Repeated word passages by recompression.

Rounds name runs and pairs of word symbols by their content, so the names are the same in every document and no
dictionary is shared. Whether two symbols are joined depends on their direct neighbours only: away from its ends
a repeated passage has the same symbols everywhere. A first Spark round finds the high-level symbol triples that occur more
than once; a second one compares the windows around them by what their symbols spell: the words before the inner symbols,
these symbols, and the words after them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays, repeats

WINDOW = 35
#: After a run round and two pair rounds a symbol spans 8 words at most, and symbols that touch words at least 8 from a passage's ends are the same in all its copies.
MARGIN = 8
_U = np.uint64


def name(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """The name of a pair: a hash of both names and the level."""
    return arrays.mix(arrays.mix(left + _U(level)) * _U(3) + right)


def run_round(symbol: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins each maximal run of exactly two equal symbols; longer runs have no fixed phase and stay."""
    n = len(symbol)
    equal = np.zeros(n + 1, bool)
    equal[1:n] = (symbol[1:] == symbol[:-1]) & (row[1:] == row[:-1])
    lead = equal[1:] & ~equal[:-1]
    lead[:-1] &= ~equal[2:]
    return _join(symbol, first, row, lead[:n], 1)


def pair_round(symbol: np.ndarray, first: np.ndarray, row: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins each left symbol with a right symbol after it; a hash parts all symbols into left and right."""
    is_right = (arrays.mix(symbol ^ _U(0xA5A5 * level)) & _U(1)).astype(bool)
    lead = np.zeros(len(symbol), bool)
    lead[:-1] = ~is_right[:-1] & is_right[1:] & (row[1:] == row[:-1])
    return _join(symbol, first, row, lead, level)


def _join(symbol: np.ndarray, first: np.ndarray, row: np.ndarray, lead: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(lead)
    symbol = symbol.copy()
    symbol[at] = name(symbol[at], symbol[at + 1], level)
    stay = np.ones(len(symbol), bool)
    stay[at + 1] = False
    return symbol[stay], first[stay], row[stay]


def parse(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High-level symbols: name, first word, document."""
    own = run_round(word, np.arange(len(word)), row)
    own = pair_round(*own, 2)
    return pair_round(*own, 3)


def anchors(word: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triple, first window, windows): the least triple of inner symbols of every window, runs of windows with the same one together."""
    n = len(word) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, _U), none, none
    symbol, first, own = parse(word, row)
    if len(symbol) < 3:
        return np.zeros(0, _U), none, none
    triple = name(name(symbol[:-2], symbol[1:-1], 7), symbol[2:], 8)
    window = np.flatnonzero(row[:n] == row[width - 1 :])
    of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
    low, count = of_word[window + MARGIN], of_word[window + width - 1 - MARGIN] - of_word[window + MARGIN] - 1
    # the least of triple[low:low + count], the leftmost of equals, by two overlapping powers of two
    power = np.log2(np.maximum(count, 1)).astype(np.int64)
    chosen, table = np.zeros(len(window), np.int64), np.arange(len(triple))
    for k in range(int(power.max(initial=0)) + 1):
        use = np.flatnonzero(power == k)
        left, right = table[low[use]], table[low[use] + count[use] - (1 << k)]
        chosen[use] = np.where(triple[right] < triple[left], right, left)
        left, right = table[: -(1 << k)], table[1 << k :]
        table = np.where(triple[right] < triple[left], right, left)
    change = np.ones(len(window), bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (np.diff(window) != 1)
    at = np.flatnonzero(change)
    return triple[chosen[at]], window[at], np.diff(np.append(at, len(window)))


def _spelled(names: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Names of the runs names[start:start + count], by two overlapping powers of two each."""
    power = np.log2(count).astype(np.int64)
    out, table = np.zeros(len(start), _U), names
    for k in range(int(power.max(initial=0)) + 1):
        use = np.flatnonzero(power == k)
        out[use] = arrays.pair(arrays.pair(table[start[use]], table[start[use] + count[use] - (1 << k)]), count[use].astype(_U))
        table = arrays.pair(table[: -(1 << k)], table[1 << k :])
    return out


def prints(word: np.ndarray, row: np.ndarray, window: np.ndarray, width: int) -> np.ndarray:
    """Names of the windows that start at `window`, from the symbols: words up to the inner symbols, these, words after them.

    Inner symbols are the same in all copies of a window, and so is where they begin and end.
    """
    symbol, first, _ = parse(word, row)
    of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
    first = np.append(first, len(word))
    low, high = of_word[window + MARGIN], of_word[window + width - 1 - MARGIN] + 1
    before, after = first[low] - window, window + width - first[high]
    return arrays.pair(arrays.pair(_spelled(word, window, before), _spelled(symbol, low, high - low)), _spelled(word, first[high], after))


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words, their hashes, and each document's first word."""
    start, end, row = arrays.words(data, at, arrays.NOT_SPACE)
    return start, end, row, arrays.word_names(data, start, end), np.searchsorted(row, np.arange(len(at)))


def remove_repeats(df: DataFrame, id_col: str, text_col: str, width: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space); keep_text adds them as `kept`.

    A word goes if a window of `width` words that covers it occurs anywhere else too, in the same document or
    another. Null, empty and short texts keep all words. Rows that repeat an id count as documents of their own.
    """
    if width < 2 * MARGIN + 19:
        raise ValueError(f"windows of at least {2 * MARGIN + 19} words are needed")
    docs, _ = repeats.numbered(df, id_col, text_col)
    n = repeats.buckets(docs)
    dealt = docs.repartition(arrays.partitions(df.sparkSession), "key")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            for rows, data, at in arrays.slices(batches):
                _, _, row, word, first = _words(data, at)
                triple, window, count = anchors(word, row, width)
                doc = row[window] if len(window) else window
                yield from repeats.entries([triple], rows.column("key").to_numpy()[doc], [(window - first[doc]).astype(np.uint32), count.astype(np.uint16)], n)

        yield from repeats.rows_of(sent())

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            for rows, data, at in arrays.slices(batches):
                start, end, row, word, first = _words(data, at)
                if len(word) < width:
                    continue
                starts = []
                for d, parts in enumerate(rows.column("hits").to_pylist()):
                    low, count = repeats.values_of(parts, "u4", "u2")
                    starts.append(arrays.spans(low.astype(np.int64) + first[d], count.astype(np.int64)))
                window = np.concatenate(starts) if starts else np.zeros(0, np.int64)
                if len(window):
                    # besides the symbols, names of another hash of the words: 128 bits decide
                    other = arrays.windows(arrays.word_names(data, start, end, 1), width)
                    doc = row[window]
                    yield from repeats.entries([prints(word, row, window, width), other[window]], rows.column("key").to_numpy()[doc], [(window - first[doc]).astype(np.uint32)], n)

        yield from repeats.rows_of(sent())

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in arrays.slices(batches):
            start, end, row, word, first = _words(data, at)
            change = np.zeros(len(word) + 1, np.int64)
            for d, parts in enumerate(rows.column("hits").to_pylist()):
                if parts:
                    low = repeats.values_of(parts, "u4")[0].astype(np.int64) + first[d]
                    np.add.at(change, low, 1)
                    np.add.at(change, low + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.flatnonzero(~gone)
            size = end[kept] - start[kept] + 1
            out = np.append(data, np.uint8(32))[arrays.spans(start[kept], size)]
            stop = np.cumsum(size)
            out[stop - 1] = 32
            edge = np.searchsorted(row[kept], np.arange(len(at)))
            edge = np.concatenate([[0], stop])[edge]
            kept_text = [out[a : max(a, b - 1)].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            before = np.concatenate([[0], np.cumsum(gone)])
            cols = [rows.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(before[first]), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept_text])]
            if keep_text:
                cols.append(pa.array([k.decode() for k in kept_text]))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(cols)])

    shared = repeats.by_key(repeats.repeated(dealt.mapInArrow(find, repeats.ENTRY), ("u8",), ("u4", "u2")), "hits")
    # left joins: an inner one would filter below the exchange, and the texts would move twice
    windows = dealt.join(shared.hint("shuffle_hash"), "key", "left").mapInArrow(verify, repeats.ENTRY)
    found = repeats.by_key(repeats.repeated(windows, ("u8", "u8"), ("u4",)), "hits")
    return dealt.join(found.hint("shuffle_hash"), "key", "left").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
