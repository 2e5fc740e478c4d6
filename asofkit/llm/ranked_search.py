"""Ranked lexical search: a trie of the documents' query terms, searched depth-first under bounds, an item at a time."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays, ordering, storage

#: Entries (document, term) in one trie; a task holds one at a time.
TRIE_ENTRIES = 1 << 20
#: Ranges of no more documents than this are scored, not split.
LEAF = 64
#: Bytes of the distinct terms of the items that are searched in one pass over the documents.
BLOCK_BYTES = 4 << 20

#: Words of bytes in which A-Z are lower-cased; all bytes of other letters than ASCII are over 0x7F.
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(_LOWER))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows that share an id, or have none, are one item."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in arrays.slices(batches):
            own = [sorted(set(terms(t))) for t in rows.column("text").cast(pa.binary()).to_pylist()]
            number = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(number), pa.array([t for x in own for t in x], pa.binary())], names=["item_id", "term"])

    return storage.written(arrays.texts(items, id_col, text_col).mapInArrow(run, f"item_id {kind}, term binary").distinct(), "items")


def restricted(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): the length of each document and its terms of the vocabulary by number, a written table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in arrays.slices(batches):
            n, sizes, numbers, counts = [], [0], [], []
            for text in rows.column("text").cast(pa.binary()).to_pylist():
                words = terms(text)
                own = Counter(map(vocabulary.get, words))
                own.pop(None, None)
                n.append(len(words))
                sizes.append(sizes[-1] + len(own))
                numbers += own.keys()
                counts += own.values()
            at = pa.array(np.array(sizes, np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.array(x, np.int32))) for x in (numbers, counts)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(np.array(n, np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return storage.written(arrays.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>"), "vectors")


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a score before its weight; it grows with tf and falls with m, rounded down or not."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Trie:
    """Documents sorted by their terms, most frequent first: a node is a range of documents with a common path.

    Nodes stand in preorder; small neighbours below one node share a leaf. For each term a node that holds it has the
    largest tf below it, and every node has the least m; together they bound what any document below can score.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, at: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, leaf: int = LEAF):
        sizes = np.diff(at)
        inside = np.lexsort((ranks, np.repeat(np.arange(len(ids)), sizes)))  # each document's terms by frequency
        ranks, tfs = ranks[inside], tfs[inside]
        path = ranks.astype(">u4").tobytes()
        paths = [path[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), np.int64)
        sizes = sizes[order]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        offset = np.arange(self.at[-1]) - np.repeat(self.at[:-1], sizes)
        entries = np.repeat(at[:-1][order], sizes) + offset
        self.ids, self.m, self.ranks, self.tfs = ids[order], m[order], ranks[entries], tfs[entries].astype(np.int64)
        document = np.repeat(np.arange(len(ids)), sizes)
        self.parts = part(self.tfs, self.m[document])
        # how many terms each document's path shares with the one before
        before = self.at[:-1][document - 1] + offset
        same = (document > 0) & (offset < sizes[document - 1]) & (self.ranks[np.minimum(before, len(self.ranks) - 1)] == self.ranks)
        shared = np.minimum.reduceat(np.where(same, np.repeat(sizes, sizes), offset), self.at[:-1])
        self.low, self.high, self.kids = [], [], []
        self._split(shared, leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.least_m = np.array([self.m[a:b].min() for a, b in zip(self.low, self.high, strict=True)])
        by_term = np.lexsort((document, self.ranks))
        self.term_ranks, self.term_docs, self.term_tfs = self.ranks[by_term], document[by_term], self.tfs[by_term]
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _split(self, shared: np.ndarray, leaf: int) -> None:
        stack = [(0, len(self.ids), -1)]
        while stack:
            low, high, parent = stack.pop()
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            if high - low <= leaf:
                continue
            inner = shared[low + 1 : high]
            cuts = [low, *(low + 1 + np.flatnonzero(inner == inner.min())).tolist(), high]
            start, ranges = low, []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - start > leaf:
                    if a > start:
                        ranges.append((start, a, node))
                    start = a
                if b - a > leaf:
                    ranges.append((a, b, node))
                    start = b
            if start < high:
                ranges.append((start, high, node))
            stack += ranges[::-1]

    def bound(self, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that hold a term, and the largest share of a score that it can have below each."""
        if rank not in self.bounds:
            a, b = np.searchsorted(self.term_ranks, [rank, rank + 1])
            docs = self.term_docs[a:b]
            low, high = np.searchsorted(docs, self.low), np.searchsorted(docs, self.high)
            nodes = np.flatnonzero(low < high)
            if len(nodes):
                padded = np.append(self.term_tfs[a:b], 0)
                most = np.maximum.reduceat(padded, np.stack([low[nodes], high[nodes]], 1).ravel())[::2]
                self.bounds[rank] = nodes, part(most, self.least_m[nodes])
            else:
                self.bounds[rank] = nodes, nodes
        return self.bounds[rank]

    def search(self, ranks: Sequence[int], weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], most: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """Merges the documents with the highest scores into best = (scores, ids); also how many documents were scored.

        weights: by rank, 0 outside the item. Subtrees are entered best bound first, and only if they can reach the last place.
        """
        bound = np.zeros(len(self.low), np.int64)
        for r in ranks:
            nodes, parts = self.bound(r)
            bound[nodes] += weights[r] * parts
        scored, stack = 0, [0]
        scores, ids = best
        while stack:
            node = stack.pop()
            least = scores[-1] if len(scores) == most else 1
            if bound[node] < least:
                continue
            if self.kids[node]:
                kids = np.array(self.kids[node])
                kids = kids[bound[kids] >= least]
                stack += kids[np.argsort(bound[kids], kind="stable")].tolist()
                continue
            low, high = self.low[node], self.high[node]
            a, b = self.at[low], self.at[high]
            own = np.add.reduceat(weights[self.ranks[a:b]] * self.parts[a:b], self.at[low:high] - a)
            scored += high - low
            fit = np.flatnonzero(own >= least)
            if len(fit):
                scores, ids = np.concatenate([scores, own[fit]]), np.concatenate([ids, self.ids[low + fit]])
                order = np.lexsort((ids, -scores))[:most]
                scores, ids = scores[order], ids[order]
        return (scores, ids), scored


#: Stands for a null id, so that it comes after all others.
_NO_ID = (1 << 63) - 1


def _best_of_tasks(vectors: DataFrame, items: list[np.ndarray], order: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int, most: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each item, by its number, in each task. order: rank by term number; weights: by rank."""
    numbers = [order[own] for own in items]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        held, entries, own = [], 0, np.zeros(len(weights), np.int64)

        def search() -> None:
            ids, m, sizes, ranks, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            trie = Trie(ids, m, np.concatenate([[0], np.cumsum(sizes)]), ranks, tfs)
            for k, wanted in enumerate(numbers):
                own[wanted] = weights[wanted]
                best[k], _ = trie.search(wanted.tolist(), own, best[k], most)
                own[wanted] = 0

        for rows in batches:
            sizes = rows.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            some = sizes > 0
            m = 50 + (50 * rows.column("n").to_numpy(zero_copy_only=False) * n_docs) // max(n_words, 1)
            ids = rows.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            ranks, tfs = order[rows.column("terms").flatten().to_numpy(zero_copy_only=False)], rows.column("tfs").flatten().to_numpy(zero_copy_only=False)
            held.append((ids[some], m[some], sizes[some], ranks, tfs))
            entries += len(ranks)
            if entries >= TRIE_ENTRIES:
                search()
                held, entries = [], 0
        if entries:
            search()
        scores, ids = (np.concatenate(x) for x in zip(*best, strict=True))
        number = np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the documents with the highest scores above 0, equal scores by id.

    Scores are those of the contract, in 64-bit integers. Document ids are integers below 2**63 - 1; a null id comes after all
    others. A null or empty text has no terms and is never found; an item without terms finds nothing; rows that share an item
    id are one item; rows that repeat a document id are ranked each. No rows on either side give no rows.
    Items go in blocks of BLOCK_BYTES of distinct terms (one larger item is a block); each block reads the documents once.
    """
    spark = docs.sparkSession
    if docs.schema[doc_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id}: integer ids are needed")
    kind = items.schema[item_id].dataType.simpleString()
    asked = item_terms(items, item_id, item_text)
    per_item = asked.groupBy("item_id").agg(F.sum(F.length("term") + 8).alias("bytes"))
    dealt = storage.written(ordering.running(per_item, [F.col("item_id")], "bytes").select(F.col("item_id").alias("__item"), F.floor(F.col("before") / BLOCK_BYTES).cast("int").alias("block")), "item-blocks")
    last, found = dealt.agg(F.max("block")).first()[0], None
    for block in range(0 if last is None else last + 1):
        own = asked.join(dealt.where(F.col("block") == block), F.col("item_id").eqNullSafe(F.col("__item")), "left_semi").collect()
        vocabulary = {t: k for k, t in enumerate(sorted({bytes(r["term"]) for r in own}))}
        by_item: dict[object, list[int]] = {}
        for r in own:
            by_item.setdefault(r["item_id"], []).append(vocabulary[bytes(r["term"])])
        if not vocabulary:
            continue
        vectors = restricted(docs, doc_id, text, vocabulary)
        n_docs, n_words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for number, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
            df[number] = n
        frequent = np.lexsort((np.arange(len(df)), -df))
        order = np.empty(len(df), np.int64)
        order[frequent] = np.arange(len(df))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df[frequent]], np.int64)
        best = _best_of_tasks(vectors, [np.array(sorted(x)) for x in by_item.values()], order, weights, n_docs, n_words, most)
        named = spark.createDataFrame(list(enumerate(by_item)), f"item int, item_id {kind}")
        best = best.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")  # a row per item of the block
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")
