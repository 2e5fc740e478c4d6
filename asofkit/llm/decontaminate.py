"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table: each run of documents has its words, and for each word the list of its positions. The
benchmark's windows are a Spark table of distinct phrases. A phrase is looked up from its rarest term in a run: that term's positions,
moved by its offset, are intersected with those of the next rarest terms until the phrase is exact. Proximity search uses the same lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, storage

WINDOW = 13
#: Bytes of phrases that are searched for at once: up to so many are broadcast, more are dealt to blocks of this size.
BLOCK_BYTES = 8 << 20
#: Bytes of text in a run of documents.
RUN = 1 << 20
#: Bytes of words: digits, letters, and all bytes of letters beyond ASCII.
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words with a space after each."""
    size = end - start + 1
    out = np.append(data, np.uint8(32))[arrays.spans(start, size)]
    out[np.cumsum(size) - 1] = 32
    return out.tobytes()


@dataclass
class Phrases:
    """Distinct phrases: their terms as one text, each phrase as a row of term numbers (-1 beyond its end), and the items that have it."""

    data: np.ndarray  # the terms, lower-cased
    start: np.ndarray
    end: np.ndarray
    table: np.ndarray
    length: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, phrases: list[bytes], items: list[list[str]], window: int) -> Phrases:
        data = np.frombuffer(b" ".join(phrases), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in phrases])])
        start, end, row = arrays.words(data, np.minimum(at, len(data)), WORD)
        first, own = arrays.distinct_words(data, start, end)
        number = np.searchsorted(row, np.arange(len(phrases) + 1))
        table = np.full((len(phrases), window), -1, np.int64)
        table[row, np.arange(len(row)) - number[row]] = own
        return cls(data, start[first], end[first], table, np.diff(number), items)


class Postings:
    """The positional lists of one run of documents, as they are stored: terms, how often each occurs, positions by term as steps from one to the next."""

    @staticmethod
    def stored(data: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes, np.ndarray]:
        """(terms, counts, positions, first word of each document) of a run."""
        data = arrays.LOWER[data]
        start, end, row = arrays.words(data, at, WORD)
        first, own = arrays.distinct_words(data, start, end)
        order = np.argsort(own, kind="stable")
        steps = np.diff(order.astype(np.uint32), prepend=np.uint32(0))  # small within a frequent term's list; modulo 2**32 between lists
        return _joined(data, start[first], end[first]), arrays.pack(np.bincount(own, minlength=len(first)).astype(np.uint32)), arrays.pack(steps), np.searchsorted(row, np.arange(len(at)))

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, first: np.ndarray):
        self.first = first
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.data = np.frombuffer(terms, np.uint8)
        self.begin, self.end, _ = arrays.words(self.data, np.array([0, len(self.data)]), WORD)
        self.size = arrays.unpack(counts, "u4")[0].astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.lists = np.repeat(np.arange(len(self.size)), self.size) << 40 | np.cumsum(arrays.unpack(positions, "u4")[0], dtype=np.uint32).astype(np.int64)

    def local(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrases all of whose terms stand in this run, and these as rows of the run's term numbers."""
        own = arrays.same_words(p.data, p.start, p.end, self.data, self.begin, self.end)
        table = np.where(p.table >= 0, own[np.maximum(p.table, 0)], -2) if len(own) else p.table
        which = np.flatnonzero((table != -1).all(axis=1))
        return which, table[which]

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether a term's list holds a position."""
        key = term << 40 | position
        at = np.minimum(np.searchsorted(self.lists, key), len(self.lists) - 1)
        return (self.lists[at] == key) & (position >= 0)

    def find(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its first word) of every exact occurrence within one document."""
        which, table = self.local(p)
        if not len(which):
            return which, which
        sizes = np.where(table >= 0, self.size[np.maximum(table, 0)], np.iinfo(np.int64).max)
        rarest = np.argsort(sizes, axis=1, kind="stable")
        anchor = rarest[:, 0]
        term = table[np.arange(len(anchor)), anchor]
        n = self.size[term]
        window = np.repeat(np.arange(len(n)), n)
        position = (self.lists[arrays.spans(self.start[term], n)] & (1 << 40) - 1) - anchor[window]
        for k in range(1, table.shape[1]):
            if not len(window):
                break
            offset = rarest[window, k]
            wanted = table[window, offset]
            ok = (wanted < 0) | self.has(np.maximum(wanted, 0), position + offset)
            window, position = window[ok], position[ok]
        last = position + p.length[which[window]] - 1
        ok = (position >= 0) & (last < len(self.row))
        window, position, last = window[ok], position[ok], last[ok]
        ok = self.row[position] == self.row[last]
        return which[window[ok]], position[ok]

    def near(self, p: Phrases, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first position) where all of a phrase's terms stand, in order, within its length + slack words of one document."""
        which, table = self.local(p)
        if not len(which):
            return which, which
        n = self.size[table[:, 0]]
        window = np.repeat(np.arange(len(n)), n)
        first = self.lists[arrays.spans(self.start[table[:, 0]], n)] & (1 << 40) - 1
        now, ok = first.copy(), np.ones(len(first), bool)
        for k in range(1, table.shape[1]):
            wanted = table[window, k]
            at = np.minimum(np.searchsorted(self.lists, np.maximum(wanted, 0) << 40 | now + 1), len(self.lists) - 1)
            following = self.lists[at]
            ok &= (wanted < 0) | (following >> 40 == wanted) & ((following & (1 << 40) - 1) > now)
            now = np.where(wanted < 0, now, following & (1 << 40) - 1)
        ok &= (now - first < p.length[which[window]] + slack) & (self.row[first] == self.row[np.minimum(now, len(self.row) - 1)])
        return which[window[ok]], first[ok]


def store_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index, a row per run of documents: run, ids, digests (SHA-256 of each text), first, terms, counts, positions."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = arrays.texts(df, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in arrays.slices(batches, limit=RUN):
            terms, counts, positions, first = Postings.stored(data, at)
            whole = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            yield pa.RecordBatch.from_arrays([whole(rows.column("doc_id")), whole(rows.column("digest")), pa.array([arrays.pack(first.astype(np.uint32))], pa.binary()), *(pa.array([v], pa.binary()) for v in (terms, counts, positions))], names=["ids", "digests", "first", "terms", "counts", "positions"])

    found = docs.mapInArrow(post, f"ids array<{kind}>, digests array<binary>, first binary, terms binary, counts binary, positions binary")
    return storage.written(found.withColumn("run", F.monotonically_increasing_id()), "postings")


def phrases(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, items): distinct runs of `window` words, or all words of an item that has fewer, and the items with each, as strings.

    Items without words have none. An item without an id still has its phrases, but no name among `items`.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in arrays.slices(batches, limit=RUN):
            data = arrays.LOWER[data]
            start, end, row = arrays.words(data, at, WORD)
            if not len(start):
                continue
            number = np.searchsorted(row, np.arange(len(at)))
            lead = np.flatnonzero((np.arange(len(row)) + window <= number[row + 1]) | (np.arange(len(row)) == number[row]))
            for low in range(0, len(lead), 4096):
                own = lead[low : low + 4096]
                text = [_joined(data, start[k:z], end[k:z])[:-1] for k, z in zip(own.tolist(), np.minimum(own + window, number[row[own] + 1]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), part.column("item").take(pa.array(row[own]))], names=["phrase", "item"])

    return rows.mapInArrow(cut, "phrase binary, item string").groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


_FOUND = "array<struct<start:long,words:long,items:array<string>>>"
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("items", pa.list_(pa.string()))]))


def _search(row: dict, ids: pa.Array, digests: pa.Array, p: Phrases, slack: int | None, every: bool) -> pa.RecordBatch:
    """A row per document of a run: what was found in it; every: documents without a match too."""
    index = Postings(row["terms"], row["counts"], row["positions"], arrays.unpack(row["first"], "u4")[0].astype(np.int64))
    window, position = index.find(p) if slack is None else index.near(p, slack)
    doc = index.row[position]
    order = np.lexsort((window, position, doc))
    window, position, doc = window[order], position[order], doc[order]
    edge = np.searchsorted(doc, np.arange(len(ids) + 1))
    keep = np.arange(len(ids)) if every else np.flatnonzero(np.diff(edge))
    found = [[{"start": q - index.first[d], "words": p.length[w], "items": p.items[w]} for w, q in zip(window[edge[d] : edge[d + 1]].tolist(), position[edge[d] : edge[d + 1]].tolist(), strict=True)] for d in keep.tolist()]
    at = pa.array(keep)
    return pa.RecordBatch.from_arrays([pa.array([row["run"]] * len(keep), pa.int64()), pa.array(keep, pa.int32()), ids.take(at), digests.take(at), pa.array(np.diff(index.first)[keep]), pa.array(found, _FOUND_TYPE)], names=["run", "number", "doc_id", "digest", "n_words", "found"])


def search(index: DataFrame, wanted: DataFrame, slack: int | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per indexed document: run, number in it, doc_id, digest, n_words, found array<struct<start, words, items>> in order of start.

    wanted: what phrases() gave. slack: proximity matches within so many further words instead of exact ones. Phrases of up to
    `block_bytes` in all are broadcast; more are dealt to blocks, and every part of the index meets every block by an equi-join's shuffle.
    """
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"run long, number int, doc_id {kind}, digest binary, n_words long, found {_FOUND}"
    wanted = storage.written(wanted, "phrases")
    size = F.octet_length("phrase") + F.coalesce(F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i) + 8), F.lit(0)) + 16
    blocks = max(1, -(-(wanted.agg(F.sum(size)).first()[0] or 0) // block_bytes))
    stored = ["run", "ids", "digests", "first", "terms", "counts", "positions"]
    if blocks == 1:
        rows = wanted.select("phrase", "items").collect()
        shared = spark.sparkContext.broadcast(Phrases.of([bytes(r[0]) for r in rows], [list(r[1]) for r in rows], window))

        def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in ("run", "first", "terms", "counts", "positions")}
                    yield _search(row, batch.column("ids")[k].values, batch.column("digests")[k].values, shared.value, slack, True)

        return index.select(*stored).mapInArrow(local, schema)

    parts = max(1, min(arrays.partitions(spark), index.count()))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select(F.pmod(F.xxhash64("run"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"), *stored, F.lit(None).cast("binary").alias("phrase"), F.lit(None).cast("array<string>").alias("items"))
    right = wanted.select(every(parts).alias("part"), F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int").alias("block"), "phrase", "items")
    both = left.unionByName(right, allowMissingColumns=True)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, items, p = None, [], [], None
        for batch in batches:
            names = list(zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True))
            for k, name in enumerate(names):
                if name != now:
                    now, held, items, p = name, [], [], None
                if batch.column("phrase")[k].is_valid:
                    held.append(batch.column("phrase")[k].as_py())
                    items.append(batch.column("items")[k].as_py())
                    continue
                p = p or Phrases.of(held, items, window)
                row = {c: batch.column(c)[k].as_py() for c in ("run", "first", "terms", "counts", "positions")}
                yield _search(row, batch.column("ids")[k].values, batch.column("digests")[k].values, p, slack, name[1] == 0)

    # phrases come before the runs of their part and block
    met = both.repartition(arrays.partitions(spark), "part", "block").sortWithinPartitions("part", "block", F.col("phrase").isNull())
    found = met.mapInArrow(dealt, schema).groupBy("run", "number").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return found.select("run", "number", "doc_id", "digest", "n_words", "found")


def phrase_matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slack: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words): every occurrence of a benchmark window; with `slack`, every proximity match instead.

    Ids may have any type that a string can be cast to. Null, empty and wordless texts match nothing.
    """
    found = search(store_index(df, id_col, text_col), phrases(benchmark, item_col, item_text), slack, block_bytes=block_bytes)
    each = found.select("doc_id", F.explode("found").alias("f")).select("doc_id", F.col("f.start").alias("start_word"), F.col("f.words").alias("n_words"), F.explode("f.items").alias("item"))
    return each.select("doc_id", F.col("item").cast(benchmark.schema[item_col].dataType).alias("item_id"), "start_word", "n_words")


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, digest, n_words, n_hit (words inside any occurrence of a window), items (ids as sorted strings), contaminated.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null, empty and wordless texts have no hits, and an empty
    benchmark hits nothing. Repeated rows give repeated results. Runs jobs: the index and the benchmark's phrases are written first.
    """
    found = search(store_index(df, id_col, text_col), phrases(benchmark, item_col, item_text), block_bytes=block_bytes)
    kind = df.schema[id_col].dataType.simpleString()
    return found.select("doc_id", "digest", "n_words", "found").mapInArrow(_verdict, f"doc_id {kind}, digest binary, n_words long, n_hit long, items array<string>, contaminated boolean")


def _verdict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column("found")
        start, words = (found.flatten().field(c).to_numpy() for c in ("start", "words"))
        doc = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
        n_words = batch.column("n_words").to_numpy()
        base = np.concatenate([[0], np.cumsum(n_words + 1)])
        change = np.zeros(base[-1] + 1, np.int64)
        np.add.at(change, base[doc] + start, 1)
        np.add.at(change, base[doc] + start + words, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        hit = inside[base[1:]] - inside[base[:-1]]
        items = [sorted({i for f in own for i in f["items"]}) for own in found.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array((hit > 0) & (20 * hit >= n_words))], names=["doc_id", "digest", "n_words", "n_hit", "items", "contaminated"])


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows of df that are not contaminated. Rows are told by id and text, since equal ones get equal verdicts."""
    found = contamination(df, benchmark, id_col, text_col, **names).where("contaminated").select("doc_id", "digest").distinct()
    out = storage.written(found, "contaminated").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    own = F.unhex(F.sha2(F.coalesce(df[text_col].cast("string"), F.lit("")), 256))
    return df.join(out, df[id_col].eqNullSafe(F.col("_id")) & (own == F.col("_digest")), "left_anti")
