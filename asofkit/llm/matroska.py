"""Matroska as a media column: bytes are stored as 8-bit PCM frames, and files are parsed into packet tables.

The parser reads any Matroska file: variable-length element ids and sizes, clusters of known or unknown
size, SimpleBlock and BlockGroup, the three lacings, and cues. It never decodes the frames; a packet
is a byte range of the file, so a reader can fetch one frame without the rest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Element ids of the format, fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, ENTRY, NUMBER, KIND, CODEC, DURATION, AUDIO = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86, 0x23E383, 0xE1
RATE, CHANNELS, DEPTH = 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
POINT, POINT_TIME, POSITIONS, POINT_TRACK, POINT_CLUSTER, POINT_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}

FRAME = 192
#: 192 samples of 8 bits at 8 kHz are 24 ms.
FRAME_MS, RATE_HZ = 24, 8000
LACING = ("none", "xiph", "fixed", "ebml")
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 64


def vint(value: int, width: int = 0) -> bytes:
    """A size in the fewest bytes, or in `width` bytes."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(sizes: list[int], kind: int) -> bytes:
    """The lace head of a block: frame count less one, then all sizes but the last."""
    if kind == 0:
        return b""
    head = bytes([len(sizes) - 1])
    if kind == 1:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == 3:
        out = head + vint(sizes[0])
        for before, now in zip(sizes[:-2], sizes[1:-1], strict=True):
            step = now - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1))
            out += vint(step + (1 << 7 * width - 1) - 1, width)
        return out
    return head


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """A file of one PCM track whose frames are `payload`; the lacings take turns."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, np.array([RATE_HZ], ">f4").tobytes()) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DURATION, FRAME_MS * 1_000_000) + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    step = frame * FRAMES_PER_BLOCK
    for k, low in enumerate(range(0, len(payload), step * BLOCKS_PER_CLUSTER)):
        start = low // frame * FRAME_MS
        blocks = [number(TIME, start)]
        for j, a in enumerate(range(low, min(len(payload), low + step * BLOCKS_PER_CLUSTER), step)):
            body = payload[a : a + step]
            sizes = [min(frame, len(body) - i) for i in range(0, len(body), frame)]
            kind = 0 if len(sizes) == 1 else (k + j) % 3 + 1
            if kind == 2 and len(set(sizes)) > 1:
                kind = 3
            blocks.append(element(SIMPLE, b"\x81" + (a // frame * FRAME_MS - start).to_bytes(2, "big") + bytes([0x80 | kind << 1]) + lace(sizes, kind) + body))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(POINT, number(POINT_TIME, start) + element(POSITIONS, number(POINT_TRACK, 1) + number(POINT_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def _size(data: bytes, at: int) -> tuple[int, int]:
    """A size and the place after it; -1 if it is unknown."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("not a size")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, start of the body, its end) of the elements in data[at:end]; a body of unknown size ends at the next top element."""
    while at < end:
        width = 9 - data[at].bit_length()
        if width > 4:
            raise ValueError("not an element")
        ident = int.from_bytes(data[at : at + width], "big")
        size, body = _size(data, at + width)
        if size < 0:
            stop = end
            if ident == CLUSTER:
                stop = next((place for child, place, _, _ in children(data, body, end) if child in _TOP), end)
        else:
            stop = body + size
            if stop > end:
                raise ValueError("an element ends beyond its parent")
        yield ident, at, body, stop
        at = stop


def _int(data: bytes, low: int, high: int) -> int:
    return int.from_bytes(data[low:high], "big")


def frames(data: bytes, low: int, high: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the frames (start, size) of a block body."""
    track, at = _size(data, low)
    when = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags, at = data[at + 2], at + 3
    kind = flags >> 1 & 3
    if kind == 0:
        return track, when, flags, [(at, high - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        size, rest = divmod(high - at, n)
        if rest:
            raise ValueError("frames of unlike size in fixed lacing")
        return track, when, flags, [(at + i * size, size) for i in range(n)]
    sizes = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        elif i == 0:
            size, at = _size(data, at)
        else:
            width = 9 - data[at].bit_length()
            step, at = _size(data, at)
            size = sizes[-1] + (step if step >= 0 else (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(high - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, when, flags, out


def _packets(data: bytes, place: int, low: int, high: int, scale: int, tracks: dict) -> Iterator[tuple]:
    """The packets of one cluster, in order: (track, ns, start, size, key, lacing, cluster)."""
    base = 0
    for i, _, x, y in children(data, low, high):
        key = None
        if i == TIME:
            base = _int(data, x, y)
        elif i == GROUP:
            inner = {j: (p, q) for j, _, p, q in children(data, x, y)}
            if BLOCK in inner:
                key, (x, y) = REFERENCE not in inner, inner[BLOCK]
        elif i == SIMPLE:
            key = bool(data[x + _size(data, x)[1] - x + 2] & 0x80)
        if key is not None:
            track, when, flags, own = frames(data, x, y)
            ns, each = (base + when) * scale, tracks.get(track, (0, "", 0))[2]
            for n, (start, size) in enumerate(own):
                yield track, ns + n * each, start, size, key, flags >> 1 & 3, place


def seek(data: bytes, found: dict, ns: int, track: int) -> tuple | None:
    """The last packet of a track at or before a time, by the cues alone: the cluster of the last cue before it is read, and nothing else.

    found: the tracks, cues and scale that parse() gave. None without a cue, or if the cue leads to no cluster.
    """
    places = [c for c in found["cues"] if c[0] <= ns and c[1] == track]
    if not places:
        return None
    ident, place, low, high = next(children(data, max(places)[2], len(data)), (0, 0, 0, 0))
    out = None
    for p in _packets(data, place, low, high, found["scale"], found["tracks"]) if ident == CLUSTER else ():
        if p[0] == track:
            if p[1] > ns:
                break
            out = p
            if p[1] == ns:
                break
    return out


def parse(data: bytes) -> dict:
    """Tracks {number: (kind, codec, ns a frame)}, packets (track, ns, start, size, key, lacing, cluster), cues (ns, track, cluster), scale."""
    scale, tracks, packets, cues, clusters = 1_000_000, {}, [], [], 0
    for ident, _, low, high in children(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        for child, place, a, b in children(data, low, high):
            if child == INFO:
                scale = next((_int(data, x, y) for i, _, x, y in children(data, a, b) if i == SCALE), scale)
            elif child == TRACKS:
                for i, _, x, y in children(data, a, b):
                    if i == ENTRY:
                        own = {j: data[p:q] for j, _, p, q in children(data, x, y)}
                        tracks[int.from_bytes(own.get(NUMBER, b"\0"), "big")] = (int.from_bytes(own.get(KIND, b"\0"), "big"), own.get(CODEC, b"").decode(), int.from_bytes(own.get(DURATION, b"\0"), "big"))
            elif child == CLUSTER:
                clusters += 1
                packets += _packets(data, place, a, b, scale, tracks)
            elif child == CUES:
                for i, _, x, y in children(data, a, b):
                    if i == POINT:
                        ns = 0
                        for j, _, p, q in children(data, x, y):
                            if j == POINT_TIME:
                                ns = _int(data, p, q) * scale
                            elif j == POSITIONS:
                                own = {m: _int(data, r, s) for m, _, r, s in children(data, p, q)}
                                cues.append((ns, own.get(POINT_TRACK, 0), low + own.get(POINT_CLUSTER, 0)))
    return {"tracks": tracks, "packets": packets, "cues": cues, "clusters": clusters, "scale": scale}


def store_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded by spaces to whole frames, as a Matroska file.

    A null or empty text gives one frame of spaces. Repeated rows give repeated files.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in arrays.slices(batches):
            sizes, files = np.diff(at), []
            for low, high in zip(at[:-1], at[1:], strict=True):
                body = data[low:high].tobytes()
                files.append(mux(body.ljust(max(1, -(-len(body) // FRAME)) * FRAME)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrays.texts(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


PACKET = "struct<track:int,timestamp_ns:long,offset:long,size:long,keyframe:boolean,lacing:string,cluster_offset:long>"


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row per frame of each file: id, track, timestamp_ns, offset, size, keyframe, lacing, cluster_offset.

    A null, empty or broken file gives no rows; broken ones are told apart by media_report().
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
        for batch in batches:
            for low in range(batch.num_rows):
                try:
                    found = parse(batch.column("media")[low].as_py() or b"")["packets"]
                except (ValueError, IndexError):
                    continue
                if found:
                    cols = [list(c) for c in zip(*found, strict=True)]
                    cols[5] = [LACING[k] for k in cols[5]]
                    ids = pa.array([batch.column("id")[low].as_py()] * len(found), batch.schema.field("id").type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "track", "timestamp_ns", "offset", "size", "keyframe", "lacing", "cluster_offset"])

    arrays.bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, track int, timestamp_ns long, offset long, size long, keyframe boolean, lacing string, cluster_offset long")
    return out.withColumnRenamed("id", id_col)


def media_report(df: DataFrame, id_col: str, media_col: str, *keep: str) -> DataFrame:
    """Per file, from the byte ranges that the packets name: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    `feature` lists frames, blocks' lacings, clusters, cues that lead to a packet of their time, the last timestamp and sums over the samples.
    A null, empty or broken file has payload_bytes 0 and a feature that begins with "broken".
    """

    def report(data: bytes) -> tuple:
        try:
            found = parse(data)
        except (ValueError, IndexError) as e:
            found = {"packets": [], "cues": [], "clusters": 0, "broken": str(e)}
        body = b"".join(data[p[2] : p[2] + p[3]] for p in found["packets"])
        samples = np.frombuffer(body, np.uint8)
        laced = np.bincount([p[5] for p in found["packets"]], minlength=4)[:4] if found["packets"] else np.zeros(4, int)
        led = sum((p := seek(data, found, c[0], c[1])) is not None and p[1] == c[0] for c in found["cues"])
        crossings = int(np.count_nonzero(np.diff((samples >= 128).view(np.int8))))
        feature = ("broken;" if "broken" in found or not found["packets"] else "") + (
            f"frames={len(found['packets'])};laced={','.join(map(str, laced))};clusters={found['clusters']};cues={led};"
            f"last_ns={found['packets'][-1][1] if found['packets'] else 0};sum={int(samples.sum(dtype=np.int64))};energy={int((samples.astype(np.int32) ** 2).sum(dtype=np.int64))};crossings={crossings}"
        )
        return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [report(m.as_py() or b"") for m in batch.column("media")]
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep) + 1)), *cols], names=[*batch.schema.names[:-1], "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    arrays.bounded_batches(df.sparkSession)
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return df.select(id_col, *keep, F.col(media_col).alias("media")).mapInArrow(run, kept + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
