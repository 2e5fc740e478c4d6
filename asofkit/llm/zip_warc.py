"""WARC archives packaged in ZIP files: a writer, and a reader that finds stored members by the directories.

The reader needs only a function read(offset, length): it takes the end record (with its ZIP64 form), the central
directory, the local headers and the stored index, then reads each WARC record by its byte range. Nothing is extracted.
Archives in files are read in two steps: their indexes give a table of byte ranges, and Spark deals these to tasks.
Archives of other writers are read too: any record kind, foreign ids as they stand, and a row with an error for what is broken.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, repeats

Read = Callable[[int, int], bytes]
ARCHIVE_BYTES = 2 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_MOST = 0xFFFFFFFF


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; zip64 writes the wide forms even where they are not needed."""
    out, directory = bytearray(), bytearray()
    for name, body in members:
        raw, crc, at = name.encode(), zlib.crc32(body), len(out)
        wide = zip64 or len(body) >= _MOST or at >= _MOST
        size = _MOST if wide else len(body)
        extra = struct.pack("<HHQQ", 1, 16, len(body), len(body)) if wide else b""
        out += struct.pack("<4s5H3I2H", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + body
        extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), at) if wide else b""
        directory += struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _MOST if wide else at) + raw + extra
    at, n = len(out), len(members)
    out += directory
    if zip64 or at >= _MOST or n >= 0xFFFF:
        end = len(out)
        out += struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(directory), at) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        out += struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, _MOST, _MOST, 0)
    else:
        out += struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, len(directory), at, 0)
    return bytes(out)


def members(read: Read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, offset of the data, its length), from the central directory."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    place = tail.rfind(b"PK\5\6")
    while place >= 0 and place + 22 + int.from_bytes(tail[place + 20 : place + 22], "little") != len(tail):
        place = tail.rfind(b"PK\5\6", 0, place)  # the signature can stand inside the comment
    if place < 0:
        raise ValueError("no end record")
    n, length, at = struct.unpack_from("<HII", tail, place + 10)
    if _MOST in (length, at) or n == 0xFFFF:
        locator = read(tail_at + place - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        wide = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        n, length, at = struct.unpack_from("<3Q", wide, 32)
    if at + length > size:
        raise ValueError("a directory beyond the end")
    directory, p, found = read(at, length), 0, {}
    for _ in range(n):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("a broken central directory")
        method, packed, plain, n_name, n_extra, n_comment, local = struct.unpack_from("<H8xIIHHH8xI", directory, p + 10)
        name = directory[p + 46 : p + 46 + n_name].decode()
        e, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while e + 4 <= stop:
            kind, width = struct.unpack_from("<HH", directory, e)
            if kind == 1:  # holds, in this order, those of the three that did not fit
                values = iter(struct.unpack_from(f"<{width // 8}Q", directory, e + 4))
                plain = next(values) if plain == _MOST else plain
                packed = next(values) if packed == _MOST else packed
                local = next(values) if local == _MOST else local
            e += 4 + width
        head = read(local, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no local header")
        found[name] = (method, local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        p = stop + n_comment
    return found


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(id_: object) -> str:
    """An id with its type, as JSON; what JSON lacks (dates, decimals) as a string."""
    return f"<urn:page:{quote(json.dumps(id_, default=str), safe='')}>"


def _id_of(urn: str | None) -> str | None:
    """The id of an urn as a string that Spark can cast back, None for null; the ids of other writers stay as they are."""
    if urn is None or not urn.startswith("<urn:page:"):
        return urn
    try:
        found = json.loads(unquote(urn.removeprefix("<urn:page:").removesuffix(">")))
    except ValueError:
        return urn
    return found if found is None or isinstance(found, str) else json.dumps(found)


def warc_record(page_id: object, url: str, payload: bytes, refers_to: object | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _headers(lines: str) -> dict[str, str]:
    """Header lines by name in lower case; lines without a colon are left out."""
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines.splitlines()[1:]) if colon}


def read_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers (names in lower case), HTTP headers and payload of one record, a gzip member or plain.

    What does not hold an HTTP message has no HTTP headers, and its whole block is the payload.
    """
    data = raw if raw.startswith(b"WARC/") else gzip.decompress(raw)
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head.decode())
    block = rest[: int(warc["content-length"])]
    if len(block) < int(warc["content-length"]):
        raise ValueError("a record that is cut off")
    if not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http.decode("latin-1")), payload


def build_archives(df: DataFrame, id_col: str, url_col: str, body_col: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """(name, content): ZIP archives of WARC records with a stored index. Null urls and bodies count as empty.

    Of rows with equal payloads of `least` bytes or more the smallest id is the response, the others revisit it; rows that repeat its
    id are responses too. A null id counts as larger than all others; payloads that only null ids have are responses.
    """
    arrays.bounded_batches(df.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pages = df.select(F.col(id_col).alias("id"), text(url_col).alias("url"), text(body_col).alias("text")).withColumn("digest", F.unhex(F.sha1(F.col("text").cast("binary"))))
    pages = repeats.with_least(pages, "digest", "id")
    revisits = (F.col("id").isNull() | (F.col("id") > F.col("least"))) & (F.octet_length("text") >= least)
    pages = pages.select("id", "url", "text", F.when(revisits, F.col("least")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in arrays.slices(batches, limit=archive_bytes):
            warc, index = bytearray(), []
            for k, (page, url, first) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("id", "url", "refers_to")), strict=True)):
                record = warc_record(page, url, data[at[k] : at[k + 1]].tobytes(), first)
                index.append(json.dumps({"offset": len(warc), "length": len(record), "filename": WARC}))
                warc += record
            body = zip_stored([(WARC, bytes(warc)), (INDEX, "\n".join(index).encode()), ("datapackage.json", b'{"profile":"data-package"}')], zip64)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(body).hexdigest() + ".wacz"]), pa.array([body], pa.binary())], names=["name", "content"])

    return pages.mapInArrow(run, "name string, content binary")


_RECORD = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, error string"
_NAMES = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error"]
_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 5]
#: What broken archives and records raise; a store that fails raises other errors, and these end the task.
_BROKEN = (ValueError, KeyError, TypeError, struct.error, zlib.error, EOFError, gzip.BadGzipFile)


def ranges(read: Read, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of every indexed record of an archive."""
    found = members(read, size)
    for name, (method, at, length) in found.items():
        if not name.startswith("indexes/"):
            continue
        if method:
            raise ValueError("an index must be a stored member")
        for line in read(at, length).decode().splitlines():
            entry = json.loads(line[line.index("{") :])
            name = entry["filename"]
            method, base, held = found[name if name in found else f"archive/{name}"]  # an index may name archives without their folder
            at, n = int(entry["offset"]), int(entry["length"])
            if method:
                raise ValueError("an archive must be a stored member")
            if at < 0 or n < 0 or at + n > held:
                raise ValueError("a record beyond the end of its archive")
            yield base + at, n


def _failed(e: Exception) -> tuple:
    return (*[None] * 6, f"{type(e).__name__}: {e}")


def _row(raw: bytes) -> tuple:
    try:
        warc, http, payload = read_record(raw)
        kind = warc["warc-type"]
        # a revisit holds headers alone: length and digest are those that it states
        size = len(payload) if kind != "revisit" else int(http["content-length"]) if "content-length" in http else None
        digest = digest_of(payload) if kind != "revisit" else warc.get("warc-payload-digest", "").removeprefix("sha1:") or None
        return _id_of(warc["warc-record-id"]), size, digest, kind, _id_of(warc.get("warc-refers-to")), warc.get("warc-target-uri"), None
    except _BROKEN as e:
        return _failed(e)


def _ranges(read: Read, size: int) -> tuple[list[tuple[int, int]], list[tuple]]:
    """The ranges of an archive, and the rows that tell why there are none."""
    try:
        return list(ranges(read, size)), []
    except _BROKEN as e:
        return [], [_failed(e)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _typed(records: DataFrame, id_kind: str) -> DataFrame:
    return records.select(*(F.col(c).try_cast(id_kind).alias(c) if c in ("id", "refers_to") else F.col(c) for c in _NAMES))


def read_archives(df: DataFrame, content_col: str = "content", id_kind: str = "bigint") -> DataFrame:
    """A row per indexed record: id, payload_bytes, payload_digest (base32 SHA-1 of what was read; a revisit's as stored), record_type, refers_to, url, error.

    Foreign ids stay as they stand under the id_kind "string"; id and refers_to are null where they cannot be cast to id_kind. Records of other kinds
    and writers have rows like any other; a payload is what follows the HTTP headers as stored, or the whole block where it holds no HTTP message.
    An archive whose directories or index are broken, a null one too, is one row with its error and nulls; a broken record is such a row beside the others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                view = memoryview(value.as_buffer() if value.is_valid else b"")
                read = lambda at, n, view=view: bytes(view[max(at, 0) : at + n])
                found, rows = _ranges(read, len(view))
                rows += [_row(read(at, n)) for at, n in found]
                if rows:
                    yield _batch(rows)

    arrays.bounded_batches(df.sparkSession)
    return _typed(df.select(content_col).mapInArrow(run, _RECORD), id_kind)


def _opened(path: str) -> pa.NativeFile:
    store, own = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(own)


def read_files(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """read_archives() over the ZIP files at a path, without reading them whole.

    The first step reads end records, directories and indexes; the second deals the records' byte ranges to tasks, and each
    reads its own. Stores that pyarrow cannot open are read whole through Spark instead, with the same rows. Broken files have rows of their own,
    but files of no bytes have none, since Spark does not list them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wz][ai][cp]*").load(path)
    arrays.bounded_batches(spark)
    try:
        pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return read_archives(files, "content", id_kind)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with _opened(own) as f:
                    found, failed = _ranges(lambda at, n, f=f: f.read_at(n, max(at, 0)), size)
                found = [(at, n, None) for at, n in found] + [(0, 0, row[-1]) for row in failed]
                for low in range(0, len(found), 4096):
                    at, n, error = zip(*found[low : low + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(at)), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(error, pa.string())], names=["path", "at", "size", "error"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, f, rows = None, None, []
            for own, at, size, error in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size", "error")), strict=True):
                if error:
                    rows.append((*[None] * 6, error))
                    continue
                if own != now:
                    if f:
                        f.close()
                    now, f = own, _opened(own)
                rows.append(_row(f.read_at(size, at)))
            if f:
                f.close()
            if rows:
                yield _batch(rows)

    # runs of neighbouring records stay together, so a task opens few files
    wanted = files.select("path", "length").mapInArrow(index, "path string, at long, size long, error string")
    wanted = wanted.repartition(arrays.partitions(spark), "path", F.floor(F.col("at") / (8 << 20))).sortWithinPartitions("path", "at")
    return _typed(wanted.mapInArrow(read, _RECORD), id_kind)
