"""Repeated substrings by merging the Burrows-Wheeler transforms of shards.

A 50-byte string is looked at where its least k-gram stands: all its copies have that k-gram at the same offset, so
they meet in one bucket as aligned contexts. Shards of a bucket hold the transform of their contexts, column
by column. Merging refines an interleave of the shards: in each step the symbols that the transforms put before the
suffixes sort the interleave stably, and the common prefixes of neighbours follow from those of the step before. No suffix is
compared or sorted again. Neighbours with a common prefix of 50 bytes form the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, repeats

LENGTH, GRAM = 50, 24
#: Contexts of one shard.
SHARD = 2048
#: Places of contexts that are judged at once.
OCCURRENCES = 1 << 16
#: No UTF-8 text has this byte: it stands beyond the ends of a document.
PAD = 0xFF
_U = np.uint64


@dataclass
class Shard:
    """The transform of aligned strings: symbols[c] stand before the sorted suffixes from column c + 1; order[c] are those from column c."""

    symbols: np.ndarray
    order: np.ndarray


def transform(strings: np.ndarray) -> Shard:
    """The column-wise transform of a shard's own strings, from the last column to the first."""
    n, width = strings.shape
    order, symbols, orders = np.arange(n), np.empty((width, n), np.uint8), np.empty((width, n), np.int32)
    for c in range(width - 1, -1, -1):
        symbols[c] = strings[order, c]
        order = order[np.argsort(symbols[c], kind="stable")]
        orders[c] = order
    return Shard(symbols, orders)


def merge(shards: list[Shard], columns: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the first `columns` columns, last to first: all strings in order of their suffixes there, and the common prefix with the one before."""
    sizes = [s.symbols.shape[1] for s in shards]
    width, total = shards[0].symbols.shape[0], sum(sizes)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols = np.concatenate([s.symbols for s in shards], axis=1)
    orders = np.concatenate([s.order + o for s, o in zip(shards, offset, strict=True)], axis=1)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    source, common = np.arange(total), np.zeros(total, np.int16)
    for c in range(width - 1, -1, -1):
        before = symbols[c][source]
        step = np.argsort(before, kind="stable")
        # neighbours with the same symbol share it and what all between them shared in the step before
        fresh = np.zeros(total, np.int16)
        joins = np.flatnonzero(before[step][1:] == before[step][:-1]) + 1
        if len(joins):
            fresh[joins] = 1 + _least(common, step[joins - 1] + 1, step[joins] + 1)
        common, shard = fresh, shard[step]
        source = np.empty(total, np.int64)
        source[np.argsort(shard, kind="stable")] = np.arange(total)
        if c < columns:
            yield c, orders[c][source], common


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair, by two overlapping powers of two."""
    span = high - low
    power = np.log2(span).astype(np.int64)
    out, table = np.empty(len(low), values.dtype), values
    for k in range(int(power.max()) + 1):
        use = np.flatnonzero(power == k)
        if len(use):
            out[use] = np.minimum(table[low[use]], table[high[use] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _line_names(lines: np.ndarray) -> np.ndarray:
    """Names of equally long rows of bytes."""
    n, width = lines.shape
    at = np.arange(n) * width
    data, out = np.ascontiguousarray(lines).ravel(), np.zeros(n, _U)
    for low in range(0, width, arrays.LONG_WORD):
        high = min(width, low + arrays.LONG_WORD)
        out = arrays.pair(out, arrays.word_names(data, at + low, at + high))
    return out


def distinct(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, own): one index for each distinct row of bytes, and the number of every row's own. Rows of one name are compared byte by byte."""
    _, first, own = np.unique(_line_names(lines), return_index=True, return_inverse=True)
    if not (lines == lines[first[own]]).all():  # two rows share a name: tell them apart by their bytes
        _, first, own = np.unique(np.ascontiguousarray(lines).view(f"V{lines.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, own


def first_owners(contexts: np.ndarray, owner: np.ndarray, length: int, gram: int, shard: int = SHARD) -> np.ndarray:
    """(contexts, length - gram + 1): the least owner of any context with the same `length` bytes from each column."""
    starts = length - gram + 1
    out = np.repeat(owner[:, None], starts, axis=1)
    order, first, size = repeats.in_groups([_line_names(contexts[:, starts - 1 : starts - 1 + gram])])
    many = order[np.repeat(size > 1, size)]
    if not len(many):
        return out
    strings, own = contexts[many], owner[many]
    shards = [transform(strings[k : k + shard]) for k in range(0, len(many), shard)]
    for c, ids, common in merge(shards, starts):
        begins = np.flatnonzero(common < length)
        least = np.minimum.reduceat(own[ids], begins)
        out[many[ids], c] = np.repeat(least, np.diff(np.append(begins, len(ids))))
    return out


def least_grams(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least k-gram of every `length`-byte window within a document, and their hashes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    hashes = arrays.byte_windows(data, gram)
    least = arrays.sliding_argmin(hashes, length - gram + 1)[:n]
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    place = least[row[:n] == row[length - 1 :]]
    place = place[np.diff(place, prepend=-1) != 0]
    return place, hashes[place]


def remove_repeats(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; keep_text adds the remaining bytes as `kept`.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Null,
    empty and short texts keep all. Rows that repeat an id do not remove each other's bytes; null ids come last.
    """
    if not 0 <= length - gram < 32:
        raise ValueError("gram must be at most length, and length - gram below 32")
    docs, shift = repeats.numbered(df, id_col, text_col)
    n, starts, width = repeats.buckets(docs), length - gram + 1, 2 * length - gram
    reach = length - gram
    order = lambda c: F.shiftright(c, shift)
    # whole copies of an earlier text lose all their bytes; the transforms look at the first of them alone
    copies = docs.where(F.octet_length("text") > 0).select("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("digest"))
    copies = repeats.with_least(copies, "digest", "key").where(order("key") > order("least")).select("key", F.col("least").alias("lead"))
    dealt = docs.repartition(arrays.partitions(df.sparkSession), "key")
    marked = dealt.join(copies.hint("shuffle_hash"), "key", "left")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            for rows, data, at in arrays.slices(batches):
                place, hashes = least_grams(data, at, length, gram)
                doc = np.searchsorted(at, place, "right") - 1
                yield from repeats.entries([hashes], rows.column("key").to_numpy()[doc], [(place - at[doc]).astype(np.uint32)], n)

        yield from repeats.rows_of(sent())

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct contexts of a run of documents, and where they stand."""

        def sent() -> Iterator[tuple]:
            for rows, data, at in arrays.slices(batches):
                found = [repeats.values_of(parts, "u4")[0].astype(np.int64) for parts in rows.column("hits").to_pylist()]
                doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
                if not len(doc):
                    continue
                place = np.concatenate(found) + at[doc]
                grid = (place - reach).astype(np.int32)[:, None] + np.arange(width, dtype=np.int32)
                outside = (grid < at[doc][:, None]) | (grid >= at[doc + 1][:, None])
                contexts = data[np.clip(grid, 0, len(data) - 1)]
                contexts[outside] = PAD
                first, own = distinct(contexts)
                bucket = repeats.bucket_of(arrays.byte_windows(data, gram)[place], n)
                key = rows.column("key").to_numpy()[doc]
                order = np.lexsort((own, bucket))
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    at_ = order[low:high]
                    ids, which = np.unique(own[at_], return_inverse=True)
                    packed = [arrays.pack(contexts[first[ids]]), arrays.pack(which.astype(np.uint32), key[at_], (place - at[doc])[at_].astype(np.uint32))]
                    yield int(bucket[at_[0]]), None, len(packed[0]).to_bytes(4, "little") + b"".join(packed)

        yield from repeats.rows_of(sent(), 512)

    def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By document: places of contexts, and a bit for each start whose string an earlier document has."""

        def found() -> Iterator[tuple]:
            for own in repeats.own_buckets(batches):
                contexts, which, key, place, base = [], [], [], [], 0
                for _, packed in own:
                    cut = 4 + int.from_bytes(packed[:4], "little")
                    contexts.append(arrays.unpack(packed[4:cut], f"u1:{width}")[0])
                    parts = arrays.unpack(packed[cut:], "u4", "i8", "u4")
                    which.append(parts[0].astype(np.int64) + base)
                    key.append(parts[1])
                    place.append(parts[2])
                    base += len(contexts[-1])
                contexts, which, key, place = (np.concatenate(x) for x in (contexts, which, key, place))
                first, merged = distinct(contexts)
                which, contexts = merged[which], contexts[first]
                owner = np.full(len(contexts), np.iinfo(np.int64).max)
                np.minimum.at(owner, which, key)
                least = first_owners(contexts, owner, length, gram)
                # strings that reach beyond the document are none
                padded = np.concatenate([np.zeros((len(contexts), 1), np.int16), np.cumsum(contexts == PAD, axis=1, dtype=np.int16)], axis=1)
                within = padded[:, length : length + starts] == padded[:, :starts]
                for low in range(0, len(which), OCCURRENCES):  # a frequent context stands in many places
                    own_, key_, place_ = (x[low : low + OCCURRENCES] for x in (which, key, place))
                    earlier = ((least[own_] >> shift) < (key_ >> shift)[:, None]) & within[own_]
                    mask = (earlier << np.arange(starts)).sum(1).astype(np.uint32)
                    hit = np.flatnonzero(mask)
                    for k, packed in arrays.per_doc(key_[hit], [place_[hit], mask[hit]]):
                        yield None, k, packed

        yield from repeats.rows_of(found())

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in arrays.slices(batches):
            change = np.zeros(len(data) + length + 1, np.int32)
            for d, (parts, lead) in enumerate(zip(rows.column("hits").to_pylist(), rows.column("lead").to_pylist(), strict=True)):
                if lead is not None and at[d + 1] - at[d] >= length:
                    change[at[d]] += 1
                    change[at[d + 1]] -= 1
                elif parts:
                    place, mask = repeats.values_of(parts, "u4", "u4")
                    which, bit = np.nonzero(mask[:, None] >> np.arange(starts, dtype=np.uint32) & np.uint32(1))
                    low = at[d] + place[which].astype(np.int64) - reach + bit
                    np.add.at(change, low, 1)
                    np.add.at(change, low + length, -1)
            gone = np.cumsum(change)[: len(data)] > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[at[:-1][at[:-1] < len(data)]] = gone[at[:-1][at[:-1] < len(data)]]
            counts = [np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in (gone, begins)]
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            cols = [rows.column("doc_id"), pa.array(np.diff(at), pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            if keep_text:
                cols.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)])

    originals = marked.where("lead IS NULL").select("key", "doc_id", "text")
    shared = repeats.by_key(repeats.repeated(originals.mapInArrow(find, repeats.ENTRY), ("u8",), ("u4",)), "hits")
    # a left join: an inner one would filter below the exchange, and the texts would move twice
    contexts = originals.join(shared.hint("shuffle_hash"), "key", "left").mapInArrow(gather, repeats.ENTRY)
    found = repeats.by_key(arrays.by_bucket(contexts).mapInArrow(repeated, repeats.ENTRY).select("key", "packed"), "hits")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return marked.join(found.hint("shuffle_hash"), "key", "left").mapInArrow(remove, schema)
