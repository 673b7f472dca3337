"""WARC archives in Zstandard form (operator 9): writer, reader and validation.

An archive starts with a skippable frame that holds the dictionary and goes on with one Zstandard frame per record.
Archives are bounded binary values, so that they pass through any table or file system that Spark reaches; `archives`
makes them, `read` takes them back from a table of (content) or from spark.read.format("binaryFile").
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the dictionary's skippable frame, a Zstandard frame, a Zstandard dictionary.
DICT_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICT_MAGIC = b"\x37\xa4\x30\xec"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    """A header value must not hold line ends."""
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value or "")


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None, payload_digest: str | None = None) -> bytes:
    """One response record, or a revisit record (its block keeps the HTTP head only) if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_line(record_id)}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(uri)}",
        f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_line(refers_to)}>", "WARC-Truncated: length"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes], level: int = 3, dict_bytes: int = 16_384, samples: int = 256) -> bytes:
    """An archive of the records. The dictionary is trained on at most `samples` records; too few give an archive without one."""
    trained = b""
    step = max(1, len(records) // samples)
    if len(records) >= 16:
        try:
            trained = zstandard.train_dictionary(dict_bytes, [r[:65_536] for r in records[::step]]).as_bytes()
        except zstandard.ZstdError:
            trained = b""
    own = zstandard.ZstdCompressionDict(trained) if trained else None
    press = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True, write_checksum=True)
    lead = struct.pack("<II", DICT_FRAME, len(trained)) + trained if trained else b""
    return lead + b"".join(map(press.compress, records))


def unpack(archive: bytes) -> Iterator[bytes]:
    """The bytes of each record's frame, decoded one at a time. Raises ValueError where the archive is broken."""
    at, own = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICT_FRAME:
        size = struct.unpack_from("<I", archive, 4)[0]
        if 8 + size > len(archive):
            raise ValueError("dictionary frame is cut short")
        raw, at = archive[8 : 8 + size], 8 + size
        try:
            if raw[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            if raw[:4] != DICT_MAGIC:
                raise ValueError("the leading frame holds no dictionary")
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT)
            own.precompute_compress(level=1)  # fails for a broken one
        except zstandard.ZstdError as e:
            raise ValueError(f"dictionary: {e}") from e
    open_frames = zstandard.ZstdDecompressor(dict_data=own)
    view = memoryview(archive)
    while at < len(archive):
        if len(archive) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", archive, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            continue
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one, parts, fed = open_frames.decompressobj(), [], at
        try:
            while not one.eof:
                if fed >= len(archive):
                    raise ValueError(f"frame at byte {at} is cut short")
                parts.append(one.decompress(view[fed : fed + 65_536]))
                fed = min(fed + 65_536, len(archive))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame at byte {at}: {e}") from e
        at = fed - len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """The fields of one record; `error` names the first header, length or digest that doesn't hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    out = {"record_id": bare("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload_bytes": None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload": None, "error": None}
    if not gap or not lines[0].startswith("WARC/1."):
        return out | {"error": "no WARC header"}
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        return out | {"error": f"no {missing[0]}"}
    length = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        return out | {"error": "content-length does not fit"}
    block = rest[:length]
    if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        return out | {"error": "block digest does not fit"}
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next((x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    out["payload_bytes"] = int(told) if told.isdigit() else len(payload)
    if out["record_type"] == "revisit":
        return out if out["refers_to"] else out | {"error": "a revisit refers to nothing"}
    out["payload"] = payload
    if len(payload) != out["payload_bytes"]:
        return out | {"error": "payload length does not fit"}
    if out["payload_digest"] != digest(payload):
        return out | {"error": "payload digest does not fit"}
    return out


def plan_revisits(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, uri, payload, sha1, refers_to): equal payloads of at least min_bytes refer to their smallest id.

    A null payload is empty. Null ids come last; a repeated id whose payload repeats refers to nothing but itself.
    Per digest only (sha1, smallest id) is shuffled, pre-aggregated, never the payloads of a group together.
    """
    p = pages.select(F.col(page_id).alias("id"), F.col(url).alias("uri"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    first = p.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"))
    joined = p.join(first, "sha1", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select("id", "uri", "payload", "sha1", F.when(again, F.col("first")).alias("refers_to"))


def archives(planned: DataFrame, archive_bytes: int = 8_000_000) -> DataFrame:
    """(archive string, content binary): archives of about archive_bytes of records each, one or more per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            content = pack(held)
            return pa.RecordBatch.from_pydict({"archive": [hashlib.sha1(content).hexdigest() + ".warc.zst"], "content": [content]}, pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            for i, uri, payload, sha1, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = lambda x: f"urn:page:{'' if x is None else x}"
                held.append(record(name(i), uri, payload, name(to) if to is not None else None, base64.b32encode(bytes.fromhex(sha1)).decode()))
                size += len(payload) + 500
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return planned.select("id", "uri", "payload", "sha1", "refers_to").mapInArrow(run, "archive string, content binary")


def read(contents: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """A row per record of each archive. A broken archive ends with one row that has only `error`; the other archives go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
        blank = dict.fromkeys(kinds.names)
        for batch in batches:
            for archive in batch.column(0):
                rows, size, frames = [], 0, unpack(archive.as_py() or b"")
                while True:
                    try:
                        rows.append(parse(next(frames)))
                    except StopIteration:
                        break
                    except ValueError as e:
                        rows.append(blank | {"error": str(e)})
                        break
                    size += len(rows[-1]["payload"] or b"")
                    if not payloads:
                        rows[-1]["payload"] = None
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return contents.select(content).mapInArrow(run, _RECORD)


def save_files(contents: DataFrame, folder: str) -> None:
    """Write each archive as a file of its own, by the executors, into a folder that all of them reach: a mounted path or a
    store of pyarrow's file systems. Names come from the contents, so a repeated task writes the same file."""
    where = folder if "://" in folder else "file://" + os.path.abspath(folder)

    def run(rows):
        store, path = fs.FileSystem.from_uri(where)
        store.create_dir(path, recursive=True)
        for r in rows:
            part = f"{path}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(r.content)
            store.move(part, f"{path}/{r.archive}")

    contents.foreachPartition(run)
