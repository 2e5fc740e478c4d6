"""N-gram Jaccard join with T-occurrence search.

Documents that can reach the threshold share the content of a part of their shingle sets (a pigeonhole over more
parts than may differ), so equal parts bring them into one block, that of the least document with the part. In a block each document searches inverted
lists: a heap merges the short lists and skips what cannot occur often enough, the rest is probed in the long lists (DivideSkip), and documents
with the required overlap are links. Documents that are connected already are not searched for again.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, components, repeats, storage

SHINGLE, PERCENT = 4, 85
#: Parts that must be equal, besides one, in per cent of the elements that may differ: more of them leave weak parts out.
SPARE = 40
#: Documents and bytes of text of a block; larger groups are split.
BLOCK_DOCS, BLOCK_BYTES = 4000, 12 << 20
#: Bytes of text whose sets are built at once.
SLICE = (1 << 20) - 4096
#: DivideSkip's constant: with the required overlap T and the longest list of m documents, T / (LONG * ln m + 1) lists count as long.
LONG = 0.002
#: A group of so many documents in one run sends its leader alone.
HOT = 32
#: Binary probes into long lists that are made at once.
PROBES = 1 << 18
_U = np.uint64


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and the n + 1 offsets of the documents."""
    data = arrays.LOWER[data]
    start, end, row = arrays.words(data, at, arrays.NOT_SPACE)
    if not len(start):
        return np.zeros(0, _U), np.zeros(len(at), np.int64)
    word = arrays.word_names(data, start, end)
    first = np.searchsorted(row, np.arange(len(at)))
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    place = np.flatnonzero(row[: max(0, len(word) - size + 1)] == row[size - 1 :])
    hashes = [arrays.windows(word, size)[place]]
    few = n[short].astype(_U)  # a short text is one shingle, whose name holds the number of its words
    for k in range(int(n[short].max(initial=0))):
        few = np.where(k < n[short], arrays.pair(few, word[np.minimum(first[short] + k, len(word) - 1)]), few)
    hashes = np.concatenate([*hashes, few])
    doc = np.concatenate([row[place], short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(at)))


def size_classes(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Least sizes of the classes: linked documents are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def may_differ(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Most elements that two linked sets of up to `size` elements have apart."""
    return 2 * (100 - percent) * size // (100 + percent)


def signatures(hashes: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document): linked documents have at least one in common.

    A set is cut into `apart + spare` parts for its own class and for the next, so at least `spare` parts are equal
    in both. Empty parts count only in sets that have `spare` of them, since else an equal part has content. Of a set's parts with
    content the weakest, by number of elements, then by hash, need not be sent, one fewer than must be equal: equal parts stand
    alike in this order, so the first of the equal ones is sent by both.
    """
    sizes = np.diff(at)
    own = np.flatnonzero(sizes)
    if not len(own):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    least = size_classes(int(sizes.max()) * 2, percent)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    spread, value = arrays.mix(hashes ^ _U(0x5851F42D4C957F2D)) >> _U(33), arrays.mix(hashes + _U(77))
    out, owners = [], []
    for step in (0, 1):
        level = np.searchsorted(least, sizes, "right") - 1 + step
        apart = may_differ(least[np.minimum(level + 1, len(least) - 1)] - 1, percent)
        spare = np.where(apart == 0, 1, 1 + np.maximum(1, -(-SPARE * apart // 100)))
        parts = np.where(sizes > 0, apart + spare, 0)
        base = np.cumsum(parts) - parts
        place = base[doc] + (spread % parts[doc].astype(_U)).astype(np.int64)
        total, count = np.zeros(int(parts.sum()), _U), np.bincount(place, minlength=int(parts.sum()))
        np.add.at(total, place, value)
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(total)) - base[owner]
        empties = np.add.reduceat((count == 0).astype(np.int64), base[own])
        many = np.zeros(len(sizes), bool)
        many[own] = empties >= spare[own]
        salt = arrays.mix(level[owner].astype(_U) << _U(32) | number.astype(_U))
        mark = arrays.mix(total + salt)
        weak = np.lexsort((mark, count, count == 0, owner))  # by set: parts with content, the weakest first, then empty ones
        rank = np.empty(len(weak), np.int64)
        rank[weak] = np.arange(len(weak)) - base[owner]
        drop = np.zeros(len(sizes), np.int64)
        drop[own] = np.maximum(0, spare[own] - empties - 1)
        use = ((count > 0) & (rank >= drop[owner])) | many[owner]
        out.append(mark[use])
        owners.append(owner[use])
    return np.concatenate(out), np.concatenate(owners)


#: So many entries of short lists are merged by a heap; more are dense runs, which numpy's stable sort merges run by run.
HEAP = 2048
#: A list with one in so many documents of the block is a bitmap, which is probed without a search.
DENSE = 16


def merge_runs(entries: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """What merge_skip() gives, from the lists end to end."""
    entries = np.sort(entries, kind="stable")
    edge = np.flatnonzero(np.diff(entries, prepend=-1, append=-1))
    count = np.diff(edge)
    return entries[edge[:-1]][count >= needed], count[count >= needed]


def merge_skip(lists: list[list[int]], needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that stand in at least `needed` of the sorted lists, and in how many: a heap holds the next document of every list.

    Where the least one stands in too few, the lists skip to the first document that `needed` heads can still reach.
    """
    heap = [(own[0], k) for k, own in enumerate(lists)]
    heapq.heapify(heap)
    at, found, counts = [0] * len(lists), [], []
    while len(heap) >= needed:
        doc, taken = heap[0][0], []
        while heap and heap[0][0] == doc:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= needed:
            found.append(doc)
            counts.append(len(taken))
            goal = doc + 1
        else:
            while len(taken) < needed - 1:
                taken.append(heapq.heappop(heap)[1])
            goal = heap[0][0]
        for k in taken:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))
    return np.array(found, np.int64), np.array(counts, np.int64)


class Lists:
    """Inverted lists over the sets of a block: for each element the documents that have it, in order."""

    def __init__(self, element: np.ndarray, at: np.ndarray, docs: np.ndarray):
        """docs: those that can be found; element and at hold all."""
        sizes = np.diff(at)
        own = arrays.spans(at[docs], sizes[docs])
        order = np.argsort(element[own], kind="stable")
        self.docs = np.repeat(docs, sizes[docs])[order]
        self.edges = np.searchsorted(element[own][order], np.arange(int(element.max(initial=-1)) + 2))
        self.keys = element[own][order] * len(sizes) + self.docs  # for probes: by element, then by document
        self.element, self.at, self.sizes = element, at, sizes
        length = np.diff(self.edges)
        many = np.flatnonzero(length * DENSE > max(len(docs), 8 * DENSE))
        self.row = np.full(len(length), -1, np.int64)
        self.row[many] = np.arange(len(many))
        self.bits = np.zeros((len(many), len(sizes)), np.uint8)  # DENSE bytes an entry at most
        self.bits[np.repeat(np.arange(len(many)), length[many]), self.docs[arrays.spans(self.edges[many], length[many])]] = 1

    def search(self, query: int, percent: int) -> np.ndarray:
        """Documents in the lists that are linked with a document."""
        own = self.element[self.at[query] : self.at[query + 1]]
        size = len(own)
        low, high = self.edges[own], self.edges[own + 1]
        length = high - low
        least = -(-percent * size // 100)  # a linked set has at least so many elements
        needed = -(-percent * (size + least) // (100 + percent))
        if np.count_nonzero(length) < needed:
            return own[:0]
        n_long = min(needed - 1, int(needed / (LONG * np.log(length.max()) + 1)))
        order = np.argsort(length, kind="stable")
        short, long_ = order[: size - n_long], order[size - n_long :]
        if int(length[short].sum()) <= HEAP:
            found, count = merge_skip([self.docs[a:b].tolist() for a, b in zip(low[short].tolist(), high[short].tolist(), strict=True) if a < b], needed - n_long)
        else:
            found, count = merge_runs(self.docs[arrays.spans(low[short], length[short])], needed - n_long)
        rows = self.row[own[long_]]
        dense, long_ = rows[rows >= 0], long_[rows < 0]
        while len(long_) and len(found):  # the shortest of the long lists first; who cannot reach the overlap any more leaves
            some = long_[: max(1, PROBES // len(found))]
            wanted = own[some][:, None] * len(self.sizes) + found
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            count = count + (self.keys[place] == wanted).sum(0)
            long_ = long_[len(some) :]
            keep = count >= needed - len(long_) - len(dense)
            found, count = found[keep], count[keep]
        if len(dense) and len(found):
            count = count + (self.bits[dense].sum(0, dtype=np.int64)[found] if 4 * len(found) > len(self.sizes) else self.bits[np.ix_(dense, found)].sum(0, dtype=np.int64))
        return found[100 * count >= percent * (size + self.sizes[found] - count)]


def links(hashes: np.ndarray, at: np.ndarray, percent: int = PERCENT, known: np.ndarray | None = None, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect all linked documents of a block: each is a true link, and none is left out that would connect more.

    known: documents with equal labels are connected already. queries: only these are searched for, each against
    all others.
    """
    n, sizes, same = len(at) - 1, np.diff(at), {}
    of = np.array([same.setdefault(hashes[a:b].tobytes(), k) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))], np.int64)  # the first document with an equal set
    edges = [(d, k) for k, d in enumerate(of.tolist()) if d != k and sizes[k]]
    leads = np.flatnonzero((of == np.arange(n)) & (sizes > 0))
    if len(leads) < 2:
        return edges
    element = np.unique(hashes, return_inverse=True)[1]
    if queries is not None:
        lists, asked = Lists(element, at, leads), of[queries]
        return edges + [(int(q), int(d)) for q in np.unique(asked) if sizes[q] for d in lists.search(int(q), percent) if d != q and known[d] != known[q]]
    free = np.zeros(n, bool)
    free[leads] = True
    lists, held = Lists(element, at, leads), len(leads)
    for seed in leads:
        if not free[seed]:
            continue
        queue, free[seed] = [int(seed)], False
        while queue:
            left = int(np.count_nonzero(free))
            if not left:
                return edges
            if left * 2 <= held:  # connected documents leave the lists
                lists, held = Lists(element, at, np.flatnonzero(free)), left
            q = queue.pop()
            found = lists.search(q, percent)
            found = found[free[found]]
            free[found] = False
            edges += [(q, int(d)) for d in found]
            queue += found.tolist()
    return edges


def _packed(docs: DataFrame) -> DataFrame:
    """The rows with each `text` (binary) compressed by itself, null as null: these are what travels, texts to several blocks at times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for rows in batches:
            packed = pa.array([None if t is None else pack(t) for t in rows.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if c == "text" else rows.column(c) for c in rows.schema.names], names=rows.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _packed() with their texts, in batches of about SLICE bytes of text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for rows in batches:
        low, held, size = 0, [], 0
        for k, text in enumerate(rows.column("text").to_pylist(), 1):
            held.append(None if text is None else unpack(text))
            size += len(held[-1] or b"")
            if size >= SLICE or k == rows.num_rows:
                columns = [pa.array(held, pa.binary()) if c == "text" else rows.column(c).slice(low, k - low) for c in rows.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)
                low, held, size = k, [], 0


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """The sets of one block after the other; rows come sorted by `block`."""
    now, held = None, []
    for rows, data, at in arrays.slices(_unpacked(batches), limit=SLICE):
        hashes, edge = shingles(data, at, size)
        names = rows.column("block").to_pylist()
        cols = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in rows.schema.names if c not in ("block", "text")}
        low = 0
        for high in range(1, len(names) + 1):
            if high == len(names) or names[high] != names[low]:
                if names[low] != now and held:
                    yield _joined(held)
                    held = []
                now = names[low]
                held.append(({c: v[low:high] for c, v in cols.items()}, hashes[edge[low] : edge[high]], np.diff(edge[low : high + 1])))
                low = high
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[dict, np.ndarray, np.ndarray]:
    cols = {c: np.concatenate([h[0][c] for h in held]) for c in held[0][0]}
    sizes = np.concatenate([h[2] for h in held])
    return cols, np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(sizes)])


_EDGES = "a long, b long"


def _edge_batch(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in pairs:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, between): documents that share a signature, with the least of their group; members of groups that are large within a run of documents with that run's least.

    A run's least that is the least of such a group everywhere stands between with itself, so that its members stay with it.
    """
    n, few = repeats.buckets(docs), arrays.partitions(docs.sparkSession)

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for rows, data, at in arrays.slices(batches, limit=SLICE):
                hashes, edge = shingles(data, at, size)
                mark, doc = signatures(hashes, edge, percent)
                if not len(mark):
                    continue
                key = rows.column("key").to_numpy()[doc]
                order = np.lexsort((key, mark))
                mark, key = mark[order], key[order]
                first = np.flatnonzero(np.diff(mark, prepend=mark[0] ^ _U(1)) != 0)
                count = np.diff(np.append(first, len(mark)))
                lead, big = np.repeat(key[first], count), np.repeat(count >= HOT, count)
                own = np.unique(np.stack([key, lead], 1)[big & (key != lead)], axis=0)
                for low in range(0, len(own), 2048):
                    part = own[low : low + 2048]
                    yield int(part[0, 0] % n), 1, part.astype("<i8").tobytes()
                send = ~big | (key == lead)
                for bucket, packed in arrays.deal(repeats.bucket_of(mark[send], n), [mark[send], key[send], big[send].astype(np.uint8)]):
                    yield bucket, None, packed

        yield from repeats.rows_of(parts())

    def dealt(held: list[np.ndarray]) -> Iterator[tuple]:
        own = np.unique(np.concatenate(held), axis=0)
        for bucket, packed in arrays.deal(repeats.bucket_of(arrays.mix(own[:, 0].astype(_U)), few), [own[:, 0], own[:, 1], own[:, 2].astype(np.uint8)]):
            yield bucket, None, packed

    def led(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Who leads whom, by document: 0 within a run of documents, 1 between the leaders of runs."""

        def found() -> Iterator[tuple]:
            held = []
            for own in repeats.own_buckets(batches):
                local = [np.frombuffer(packed, "<i8").reshape(-1, 2) for key, packed in own if key is not None]
                held += [np.concatenate([x, np.zeros((len(x), 1), np.int64)], 1) for x in local]
                values = [packed for key, packed in own if key is None]
                if values:
                    mark, key, big = arrays.joined(values, "u8", "i8", "u1")
                    order = np.lexsort((key, mark))
                    mark, key, big = mark[order], key[order], big[order]
                    first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
                    lead = np.repeat(key[first], np.diff(np.append(first, len(mark))))
                    other = (key != lead) | (big == 1)
                    held.append(np.stack([key[other], lead[other], np.ones(int(other.sum()), np.int64)], 1))
                if sum(map(len, held)) > 500_000:
                    yield from dealt(held)
                    held = []
            if held:
                yield from dealt(held)

        yield from repeats.rows_of(found())

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in repeats.own_buckets(batches):
            rows = np.unique(np.stack([c.astype(np.int64) for c in arrays.joined([packed for _, packed in own], "i8", "i8", "u1")], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2] == 1)], names=["a", "b", "between"])

    found = arrays.by_bucket(docs.mapInArrow(sent, repeats.ENTRY)).mapInArrow(led, repeats.ENTRY)
    return arrays.by_bucket(found).mapInArrow(distinct, "a long, b long, between boolean")


def blocks(led: DataFrame) -> DataFrame:
    """(key, block): documents that share a signature have a block in common, that of the group's least document.

    What a run's leader leads follows it into the blocks of the leaders between runs, its own among them where it is one.
    """
    within, between = led.where("NOT between").select("a", "b"), led.where("between").select(F.col("a").alias("b"), F.col("b").alias("block"))
    moved = within.join(between, "b").select(F.col("a").alias("key"), "block")
    rows = moved.unionByName(between.where("b <> block").select(F.col("b").alias("key"), "block")).distinct()
    return rows.unionByName(rows.select("block").distinct().select(F.col("block").alias("key"), "block"))


def similar(df: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, percent: int = PERCENT, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: key, doc_id, n_shingles, component (the least key that links reach; keys are ids unless ids repeat), component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct `size`-word shingles. Null, empty
    and wordless texts have no shingles and no links. Rows that repeat an id count as documents of their own.
    """
    docs, shift = repeats.numbered(df, id_col, text_col)
    own = linked(docs, size, percent, block_docs, block_bytes)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in arrays.slices(batches, limit=SLICE):
            yield arrays.result(rows, {"key": rows.column("key"), "doc_id": rows.column("doc_id"), "n_shingles": pa.array(np.diff(shingles(data, at, size)[1]), pa.int64())})

    counted = docs.mapInArrow(count, "key long, doc_id long, n_shingles long").join(own, "key", "left")
    component = F.coalesce("component", "key")
    return counted.select("key", "doc_id", "n_shingles", component.alias("component"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.shiftright(component, shift)).alias("component_id"))


def representatives(df: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, percent: int = PERCENT, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of df, but of each group that similar() would connect only the one with the smallest id.

    Rows without links stay, those with null, empty and wordless texts among them. Of rows that repeat an id the first by text counts as smaller;
    a null id counts as larger than all others. Columns may have any names.
    """
    whole, _ = repeats.numbered(df, id_col, text_col, carry=True)
    own = linked(whole.select("key", "doc_id", "text"), size, percent, block_docs, block_bytes)
    # rows travel once, with their texts compressed; the keys that go are joined by sorting at every size, since their table grows with the copies
    body = F.col("row").getField(text_col).cast("string").cast("binary")
    rows = _packed(whole.select("key", body.alias("text"), F.col("row").dropFields(text_col).alias("row")))
    kept = rows.join(own.where("key <> component").select("key").hint("merge"), "key", "left_anti").mapInArrow(_unpacked, rows.schema)
    return kept.select(*(F.col("text").cast("string").cast(f.dataType).alias(f.name) if f.name == text_col else F.col("row").getField(f.name).alias(f.name) for f in df.schema))


def linked(docs: DataFrame, size: int, percent: int, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, component) of every document of (key, doc_id, text) that has a link; component is the least key that links reach."""
    led = storage.written(candidates(docs, size, percent), "led")
    block = storage.written(blocks(led), "blocks")
    storage.dropped(led)
    n = arrays.partitions(docs.sparkSession)
    # texts travel to their blocks without a table on the way; what blocks hold is told from sizes alone
    members = _packed(docs.select("key", F.col("text").cast("binary").alias("text"))).repartition(n, "key").join(block.hint("shuffle_hash"), "key").select("key", "block", "text")
    sizes = block.join(docs.select("key", F.octet_length("text").alias("bytes")), "key")
    heavy = storage.written(sizes.groupBy("block").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("key").alias("pivot")).where((F.col("n") > block_docs) | (F.col("bytes") > block_bytes)), "heavy")
    split = heavy.limit(1).count() > 0
    light = members.join(heavy.select("block"), "block", "left_anti") if split else members

    def connect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for cols, hashes, at in _blocks(batches, size):
                pairs = np.array(links(hashes, at, percent), np.int64).reshape(-1, 2)
                yield cols["key"][pairs[:, 0]], cols["key"][pairs[:, 1]]

        yield from _edge_batch(found())

    def by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "block").sortWithinPartitions("block")

    edges = by_block(light.select("key", F.col("block").cast("string").alias("block"), "text")).mapInArrow(connect, _EDGES)
    if split:
        edges = edges.unionByName(_heavy_edges(members, heavy, connect, by_block, size, percent, block_docs, block_bytes))
    own = components.components(edges).select(F.col("a").alias("key"), "component")
    for table in (block, heavy):
        storage.dropped(table)
    return own


def _heavy_edges(members: DataFrame, heavy: DataFrame, connect, by_block, size: int, percent: int, block_docs: int, block_bytes: int) -> DataFrame:
    """Edges within groups that are too large for one block.

    Sub-blocks with a common pivot are connected first. Then every document outside its group's largest component is
    searched for against all of the group, sub-block by sub-block, so no link between two components is missed.
    """
    spark = members.sparkSession
    heavy = heavy.withColumn("parts", F.greatest(F.ceil(F.col("n") / (block_docs / 2)), F.ceil(F.col("bytes") / (block_bytes / 2))).cast("int"))
    own = members.join(heavy, "block").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    pivots = own.where("key = pivot").select("key", "block", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = own.where("key <> pivot").select("key", "block", "text", "part").unionByName(pivots)
    rows = storage.written(rows.select("key", "block", "part", "text"), "parts")
    name = F.concat_ws("/", F.col("block").cast("string"), F.col("part").cast("string"))
    first = storage.written(by_block(rows.select("key", name.alias("block"), "text")).mapInArrow(connect, _EDGES), "part-edges")
    label = components.components(first).select(F.col("a").alias("key"), "component")
    labelled = own.select("key", "block", "part").join(label, "key", "left").withColumn("label", F.coalesce("component", "key")).select("key", "block", "part", "label")
    labelled = storage.written(labelled, "labels")
    largest = labelled.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    outside = labelled.join(largest, "block").where("label <> main").select("key", "block", "label")
    if outside.limit(1).count() == 0:
        return first
    few = outside.groupBy("block").agg(F.count("*").alias("m")).withColumn("chunks", F.ceil(F.col("m") / (block_docs / 2)).cast("int"))
    asked = outside.join(few, "block").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    texts = members.select("key", "block", "text")
    parts = heavy.select("block", "parts")
    asks = asked.join(parts, "block").join(texts, ["key", "block"]).select("key", "block", "label", "text", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asked"))
    others = labelled.join(few.select("block", "chunks"), "block").join(texts, ["key", "block"]).select("key", "block", "label", "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "part", F.lit(False).alias("asked"))
    pairs = asks.unionByName(others).select("key", "label", "asked", F.concat_ws("/", *(F.col(c).cast("string") for c in ("block", "part", "chunk"))).alias("block"), "text")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for cols, hashes, at in _blocks(batches, size):
                own = np.array(links(hashes, at, percent, cols["label"], np.flatnonzero(cols["asked"])), np.int64).reshape(-1, 2)
                yield cols["key"][own[:, 0]], cols["key"][own[:, 1]]

        yield from _edge_batch(found())

    return first.unionByName(by_block(pairs).mapInArrow(search, _EDGES))
