"""What the exact repeat finders share: numbered documents, and which keys occur more than once anywhere.

Keys travel as packed arrays, dealt to buckets by their hash. A run of documents sends each of its keys once, and
decides by itself about keys that it holds twice, so a key that fills a third of the corpus is thinned before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays, storage

ENTRY = "bucket int, key long, packed binary"


def numbered(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> tuple[DataFrame, int]:
    """(key, doc_id, text) and a shift: key >> shift orders rows by id, and every row has a key of its own.

    Ids are integers. Rows that repeat an id are told apart by the low `shift` bits; a null id counts as larger than all others.
    """
    docs = arrays.texts(df, id_col, text_col, carry)
    rest = ["doc_id", "text", *(["row"] if carry else [])]
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col}: integer ids are needed")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    most, last, nulls = docs.groupBy("doc_id").count().agg(F.max("count"), F.max("doc_id"), F.max(F.col("doc_id").isNull())).first()
    if (most or 1) == 1 and not nulls:
        return docs.select(F.col("doc_id").alias("key"), *rest), 0
    shift = max(1, int(most - 1).bit_length())
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    return docs.select((F.shiftleft(F.coalesce("doc_id", F.lit((last or 0) + 1)), shift) + number).alias("key"), *rest), shift


def with_least(df: DataFrame, key: str, value: str) -> DataFrame:
    """The rows with the least `value` of their key as `least` (null where there is none).

    The least values of keys with several rows are a table of their own. Spark broadcasts it up to its threshold; beyond that it is a sort-merge join
    of two plain shuffles, whose frequent keys adaptive execution splits. One without this table could not be split.
    """
    least = df.groupBy(key).agg(F.min(value).alias("least"), F.count("*").alias("n")).where("n > 1").select(key, "least")
    return df.join(storage.written(least, "least"), key, "left").withColumn("least", F.coalesce("least", value))


def buckets(docs: DataFrame) -> int:
    """So many that each has the keys of some BUCKET_BYTES of text, whatever the number of shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(arrays.partitions(docs.sparkSession), -(-total // arrays.BUCKET_BYTES))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def same(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before it, in a sorted order."""
    out = np.zeros(len(order), bool)
    if len(order):
        out[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    return out


def in_groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, where groups of equal keys begin in it, and their sizes."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    first = np.flatnonzero(~same(keys, order))
    return order, first, np.diff(np.append(first, len(order)))


def rows_of(parts: Iterable[tuple[int | None, int | None, bytes]], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of (bucket, key, packed)."""
    held: list[tuple] = []
    for part in parts:
        held.append(part)
        if len(held) >= size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["bucket", "key", "packed"])


def entries(keys: list[np.ndarray], owner: np.ndarray, values: list[np.ndarray], n: int) -> Iterator[tuple[int, int | None, bytes]]:
    """What one run of documents sends: packed (keys, owner, values, twice) by bucket, and the hits that it decides itself by owner."""
    if not len(owner):
        return
    order, first, size = in_groups(keys)
    twice = np.repeat(size > 1, size)
    if twice.any():
        at = order[twice]
        spread = bucket_of(arrays.mix(owner[at].astype(np.uint64)), n)
        for (key, packed), bucket in zip(arrays.per_doc(owner[at], [v[at] for v in values]), _first_of(owner[at], spread), strict=True):
            yield int(bucket), key, packed
    lead = order[first]
    for bucket, packed in arrays.deal(bucket_of(keys[0][lead], n), [*(k[lead] for k in keys), owner[lead], *(v[lead] for v in values), (size > 1).astype(np.uint8)]):
        yield bucket, None, packed


def _first_of(owner: np.ndarray, spread: np.ndarray) -> np.ndarray:
    _, at = np.unique(owner, return_index=True)
    return spread[at]


def repeated(sent: DataFrame, key_kinds: tuple[str, ...], value_kinds: tuple[str, ...]) -> DataFrame:
    """(key, packed): by document, the values of all entries whose keys occur at least twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for own in own_buckets(batches):
                values = []
                for key, packed in own:
                    if key is None:
                        values.append(packed)
                    else:
                        yield None, key, packed
                if values:
                    cols = arrays.joined(values, *key_kinds, "i8", *value_kinds, "u1")
                    order, _, size = in_groups(cols[: len(key_kinds)])
                    hit = order[np.repeat(size > 1, size)]
                    hit = hit[cols[-1][hit] == 0]
                    for key, packed in arrays.per_doc(cols[len(key_kinds)][hit], [c[hit] for c in cols[len(key_kinds) + 1 : -1]]):
                        yield None, key, packed

        yield from rows_of(found())

    return arrays.by_bucket(sent).mapInArrow(run, ENTRY).select("key", "packed")


def own_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The (key, packed) rows of one bucket after the other."""
    now, held = None, []
    for batch in batches:
        for bucket, key, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "packed")), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append((key, packed))
    if held:
        yield held


def by_key(hits: DataFrame, name: str) -> DataFrame:
    """One row per document: key and the list of its packed values."""
    return hits.groupBy("key").agg(F.collect_list("packed").alias(name))


def values_of(parts: list[bytes] | None, *kinds: str) -> list[np.ndarray]:
    """What per_doc() packed for one document, from all its parts."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    cols: list[list[np.ndarray]] = [[] for _ in kinds]
    for raw in parts or ():
        n, low = len(raw) // width, 0
        for col, kind in zip(cols, kinds, strict=True):
            col.append(np.frombuffer(raw, kind, n, low))
            low += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(cols, kinds, strict=True)]
