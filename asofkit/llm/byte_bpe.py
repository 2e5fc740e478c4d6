"""Byte-level BPE encoding and decoding of whole texts.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Two neighbours' pre-token
bounds agree from the first place where both have one, so each chunk is used from there to where the next one takes over,
and is merged by rank where it lies; the ids of a text's chunks are then joined. A text with neighbours that never agree is
pre-tokenised again from the last sure bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

CHUNK, OVERLAP = 16_384, 512
#: A pre-token can depend on so many characters after its start or end ('re, and the look-ahead after white space).
LOOK = 3
#: Pieces whose ids a Python worker remembers, and characters of texts whose results it remembers.
REMEMBERED, REMEMBERED_TEXT = 400_000, 8 << 20


class Codec(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers, remembered up to REMEMBERED pieces."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = np.array(self.merge(piece.encode()), "<u4").tobytes()
        self[piece] = out
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Joins the pair of lowest rank, the leftmost of equals, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop or not alive[j]:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(queue, (r, h, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ends(self, text: str) -> np.ndarray:
        """Where the pre-tokens of a text end; the pattern covers every character."""
        return np.cumsum(np.fromiter(map(len, self.pattern.findall(text)), np.int64))


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def stitch(chunks: list[tuple[int, str, np.ndarray]], tokens: Codec) -> Iterator[str]:
    """The pre-tokens of a text from its chunks (start, text, ends within it), in order of start."""
    start, text, ends = chunks[0][0], chunks[0][1], chunks[0][2]
    low = 0
    for at, following, its_ends in chunks[1:]:
        ends = ends[ends > low]
        own = ends[(ends >= at - start) & (ends <= len(text) - LOOK)] + start
        theirs = np.concatenate([[0], its_ends]) + at
        common = own[np.isin(own, theirs)]
        if len(common):
            stop = int(common[0]) - start
            for e in ends[ends <= stop].tolist():
                yield text[low:e]
                low = e
            start, text, ends, low = at, following, its_ends, int(common[0]) - at
        else:  # no agreement within the overlap: on from the last sure bound over both texts
            sure = ends[ends <= len(text) - LOOK]
            for e in sure.tolist():
                yield text[low:e]
                low = e
            text = text[low : at - start] + following if at - start >= low else following[low - (at - start) :]
            start, low = start + low, 0
            ends = tokens.ends(text)
    for e in ends[ends > low].tolist():
        yield text[low:e]
        low = e


_OUT = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def _columns(ids: bytes, tokens: Codec) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tokens.decode(ids)).hexdigest()


def _result(name: str, names: pa.Array, rows: list[tuple[int, str, str]], ids: list[bytes] | None) -> pa.RecordBatch:
    cols = [names, *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))]
    if ids is not None:
        cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(cols, names=[name, *_OUT[: len(cols) - 1]])


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, keep_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256; keep_ids adds ids.

    A null text counts as empty and has no ids. Repeated rows give repeated results. `path` names a rank file
    that every executor can read.
    """
    docs = arrays.texts(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    found = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known, held = codec(path, pattern), {}, 0
        for rows, _, _ in arrays.slices(batches):
            out = []
            for text in rows.column("text").to_pylist():
                if text not in known:  # copies are encoded once
                    held += len(text)
                    if held > REMEMBERED_TEXT:
                        known, held = {}, len(text)
                    ids = tokens.encode(tokens.pattern.findall(text))
                    known[text] = (_columns(ids, tokens), ids if keep_ids else b"")
                out.append(known[text])
            yield _result("doc_id", rows.column("doc_id"), [o[0] for o in out], [o[1] for o in out] if keep_ids else None)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for k, key in enumerate(batch.column("key").to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                text = batch.column("text")[k].as_py()
                starts = list(range(0, len(text), chunk))
                for low in range(0, len(starts), 64):
                    own = starts[low : low + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.binary()), pa.array(own, pa.int64()), pa.array([text[s : s + chunk + overlap] for s in own])], names=["key", "start", "text"])

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks that several tasks have cut from copies of one text count once."""
        seen = set()
        for batch in batches:
            keep = []
            for k, name in enumerate(zip(batch.column("key").to_pylist(), batch.column("start").to_pylist(), strict=True)):
                if name not in seen:
                    seen.add(name)
                    keep.append(k)
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where pre-tokens end in what a chunk shares with the one before and with the one after."""
        tokens = codec(path, pattern)
        for batch in once(batches):
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                ends = tokens.ends(text)
                heads.append(np.concatenate([[0], ends[ends <= overlap]]).astype("<i4").tobytes())
                tails.append((ends[(ends >= chunk) & (ends <= len(text) - LOOK)] - chunk).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], names=["key", "start", "heads", "tails"])

    def agreed(table: pa.Table) -> pa.Table:
        """From where to where each chunk of a text counts; sure: all neighbours agree somewhere."""
        table = table.sort_by("start")
        heads, tails = ([np.frombuffer(v, "<i4") for v in table.column(c).to_pylist()] for c in ("heads", "tails"))
        common = [np.intersect1d(a, b) for a, b in zip(tails[:-1], heads[1:], strict=True)]
        meet = [int(c[0]) if len(c) else -1 for c in common]
        return pa.table({"key": table.column("key"), "start": table.column("start"), "low": pa.array([0, *meet], pa.int64()), "high": pa.array([*(m + chunk for m in meet), 1 << 40], pa.int64()), "sure": pa.array([-1 not in meet] * table.num_rows)})

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of a chunk's own stretch; a chunk of a text that is not sure keeps its text."""
        tokens = codec(path, pattern)
        for batch in once(batches):
            ids, rest = [], []
            for text, low, high, sure in zip(*(batch.column(c).to_pylist() for c in ("text", "low", "high", "sure")), strict=True):
                rest.append(None if sure else text)
                if not sure:
                    ids.append(b"")
                    continue
                ends = tokens.ends(text)
                ends = np.concatenate([[low], ends[(ends > low) & (ends <= high)]]).tolist()
                ids.append(tokens.encode([text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "start")), pa.array(ids, pa.binary()), pa.array(rest, pa.string())], names=["key", "start", "ids", "text"])

    def finished(table: pa.Table) -> pa.Table:
        tokens = codec(path, pattern)
        table = table.sort_by("start")
        texts = table.column("text").to_pylist()
        if texts[0] is None:
            ids = b"".join(table.column("ids").to_pylist())
        else:
            ids = tokens.encode(stitch([(s, t, tokens.ends(t)) for s, t in zip(table.column("start").to_pylist(), texts, strict=True)], tokens))
        return pa.Table.from_batches([_result("key", table.column("key").combine_chunks().slice(0, 1), [_columns(ids, tokens)], [ids] if keep_ids else None)])

    if not 0 < overlap <= chunk:
        raise ValueError("an overlap must be as long as a chunk at most")
    long_text = F.length("text") > chunk + overlap
    keyed = docs.where(long_text).withColumn("key", F.unhex(F.sha2("text", 256)))  # copies of a text are one text
    pieces = keyed.select("key", "text").mapInArrow(cut, "key binary, start long, text string").repartition(arrays.partitions(df.sparkSession), "key", "start")
    cuts = pieces.mapInArrow(bounds, "key binary, start long, heads binary, tails binary").groupBy("key").applyInArrow(agreed, "key binary, start long, low long, high long, sure boolean")
    ids = pieces.join(cuts.hint("shuffle_hash"), ["key", "start"], "left").mapInArrow(merged, "key binary, start long, ids binary, text string")
    encoded = keyed.select("key", "doc_id").join(ids.groupBy("key").applyInArrow(finished, f"key binary, {found}"), "key").drop("key")
    return docs.where(~long_text).mapInArrow(whole, f"doc_id {kind}, {found}").unionByName(encoded)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """Per row: id and `bytes`, the raw bytes of the ids joined. A null list gives empty bytes; an unknown id fails the job."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path, "")
        for batch in batches:
            out = [b"".join(tokens.tokens[i] for i in ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    arrays.bounded_batches(df.sparkSession)
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, bytes binary")
