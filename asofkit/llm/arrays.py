"""Numpy helpers that the operators use inside Spark tasks: texts as one byte array, hashes, packed rows.

Spark partitions and shuffles; these functions only work on the rows of one Arrow batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are held as numpy arrays at once; one longer text is a slice of its own.
SLICE_BYTES = (2 << 20) - 4096
#: Rows in an Arrow batch: long texts must not pile up by the ten thousand in a Python worker.
BATCH_ROWS = 512
#: Bytes of text whose keys fall into one bucket on average; a task holds one bucket at a time.
BUCKET_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def bounded_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_ROWS rows in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(doc_id, text), null as the empty text; carry adds the whole row as `row`."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.struct("*").alias("row")] if carry else []))


def schema(ddl: str, docs: DataFrame) -> T.StructType:
    """The schema of a map over texts(): with `row` if that is carried."""
    out = T.StructType.fromDDL(ddl)
    return out.add("row", docs.schema["row"].dataType) if "row" in docs.columns else out


def result(rows: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Columns of a map over texts(), with the carried rows."""
    if "row" in rows.schema.names:
        columns = columns | {"row": rows.column("row")}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets into them, without a copy."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows of up to `limit` bytes: (rows, bytes, offsets)."""
    for batch in batches:
        data, at = bytes_of(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high
    pa.default_memory_pool().release_unused()  # the worker stays; its memory need not


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of two names in order; for a given left one, different right ones never share it."""
    return mix(mix(left) * _U(3) + right)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number (a view); zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


#: Words of more bytes are named by a digest of their own.
LONG_WORD = 64


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit names of byte strings: 8 bytes after the other pass through mix(), so up to 8 bytes never clash at equal length."""
    size, eight = end - start, eights(data)
    out = mix(size.astype(_U) * _U(_BASE) + _U(salt))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left = start[live], size[live]
    while len(live):
        # all 64 bits of eight bytes; at the end of a word only the low ones
        part = eight[at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(8) * (_U(8) - np.minimum(left, 8).astype(_U))))
        out[live] = pair(out[live], part)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def _equal(one: np.ndarray, at: np.ndarray, other: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from one[at] and from other[place] are the same, by string; sizes are positive."""
    if not len(size):
        return np.zeros(0, bool)
    return np.logical_and.reduceat(one[spans(at, size)] == other[spans(place, size)], np.cumsum(size) - size)


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, own): one word for each distinct one, and every word's number among these. Words of one name are compared by their bytes."""
    _, first, own = np.unique(word_names(data, start, end), return_index=True, return_inverse=True)
    size, lead = end - start, first[own]
    if len(own) and not ((size == size[lead]).all() and _equal(data, start, data, start[lead], size).all()):
        seen: dict[bytes, int] = {}
        own = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(start, end, strict=True)], np.int64)
        first = np.unique(own, return_index=True)[1]
    return first, own


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each of some distinct words, which of other distinct words it is, or -1; equal names are checked by their bytes."""
    out = np.full(len(start), -1, np.int64)
    if not len(start) or not len(begin):
        return out
    names, theirs = word_names(data, start, end), word_names(other, begin, stop)
    order = np.argsort(theirs, kind="stable")
    at = order[np.minimum(np.searchsorted(theirs[order], names), len(order) - 1)]
    met = np.flatnonzero((theirs[at] == names) & (end - start == (stop - begin)[at]))
    same = met[_equal(data, start[met], other, begin[at[met]], (end - start)[met])]
    out[same] = at[same]
    return out


def windows(symbols: np.ndarray, width: int, have: int = 1) -> np.ndarray:
    """Names of all windows of `width` symbols, by doubling; symbols[i] names `have` of them already."""
    out = symbols
    while have < width:
        step = min(have, width - have)
        out = pair(out[: max(0, len(out) - step)], out[step:])
        have += step
    return out


def byte_windows(data: np.ndarray, width: int) -> np.ndarray:
    """Names of all windows of `width` bytes, 8 at least."""
    return windows(eights(data)[: max(0, len(data) - 7)].copy(), width, 8)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of values[i:i + width] stands for every i, the leftmost of equals, by doubling."""
    out, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = out[: max(0, len(out) - step)], out[step:]
        out = np.where(values[right] < values[left], right, left)
        have += step
    return out


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes whose class `inside[byte]` is true, cut at row bounds: start, end and row of each."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_in = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[at[:-1]] = True
    begins = is_in.copy()
    begins[1:] &= ~is_in[:-1] | cut[1:n]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1]."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts) + np.repeat(starts, counts)


_squeeze = zstandard.ZstdCompressor(level=1)


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of equal length as one compressed value, each by byte planes."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.nbytes // max(1, len(c))).T.tobytes() for c in columns]
    return _squeeze.compress(b"".join(planes))


def unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    """What pack() was given, by numpy dtypes; "u1:76" is a matrix of 76 bytes a row."""
    raw = np.frombuffer(zstandard.decompress(value), np.uint8)
    widths = [int(k.partition(":")[2] or 1) * np.dtype(k.partition(":")[0]).itemsize for k in kinds]
    n, out, low = len(raw) // sum(widths), [], 0
    for kind, width in zip(kinds, widths, strict=True):
        name, _, many = kind.partition(":")
        plane = np.ascontiguousarray(raw[low : low + n * width].reshape(width, n).T)
        out.append(plane.view(name).reshape((n, int(many)) if many else n))
        low += n * width
    return out


def deal(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows of it) for each bucket that has rows."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[low]), pack(*[c[low:high] for c in columns])


def by_bucket(df: DataFrame) -> DataFrame:
    """Rows of one `bucket` next to each other in one partition."""
    return df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def runs_of_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The packed values of one bucket after the other."""
    now, held = None, []
    for batch in batches:
        for bucket, value in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(value)
    if held:
        yield now, held


def joined(values: list[bytes], *kinds: str) -> list[np.ndarray]:
    parts = [unpack(v, *kinds) for v in values]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def per_doc(doc: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(doc_id, packed columns) for each document of an unordered array of them."""
    order = np.argsort(doc, kind="stable")
    doc, columns = doc[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(doc[low]), b"".join(np.ascontiguousarray(c[low:high]).tobytes() for c in columns)


def record(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
NOT_SPACE = ~SPACE
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
