from __future__ import annotations

import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from galena.llm import queries, warc
from tests.oracle import compare


def test_query_equals_sql(spark, small):
    rows, unlike = compare(queries.op9_warc(spark, small), queries.ORACLES["op9_warc"], small)
    assert rows and not unlike


def test_archive_layout():
    records = [warc.record(f"urn:page:{i}", "http://x/", b"payload %d " % (i % 7) * 50) for i in range(200)]
    data = warc.pack(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICT_FRAME and data[8:12] == warc.DICT_MAGIC and data[8 + size : 12 + size] == warc.FRAME_MAGIC
    assert list(warc.unpack(data)) == records
    assert list(warc.unpack(warc.pack(records[:3]))) == records[:3]
    assert list(warc.unpack(b"")) == []
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = struct.pack("<II", warc.DICT_FRAME, len(packed)) + packed + data[8 + size :]
    assert list(warc.unpack(again)) == records


def test_broken_archives_and_records():
    good = warc.record("urn:page:1", "http://x/", b"hello")
    data = warc.pack([good, good])
    with pytest.raises(ValueError, match="cut short"):
        list(warc.unpack(data[:-3]))
    with pytest.raises(ValueError, match="no frame"):
        list(warc.unpack(data + b"junk"))
    assert warc.parse(good)["error"] is None and warc.parse(good)["payload"] == b"hello"
    assert "length" in warc.parse(good[:-1])["error"]
    assert "digest" in warc.parse(good.replace(b"hello", b"jello"))["error"]
    assert warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")["error"] == "no WARC header"
    assert warc.parse(good.replace(b"WARC-Date", b"WARC-Data"))["error"] == "no warc-date"


def test_broken_dictionaries_become_rows(spark):
    import struct

    frame = lambda raw: struct.pack("<II", warc.DICT_FRAME, len(raw)) + raw
    good = warc.pack([warc.record("urn:page:1", "http://x/", b"hello")])
    broken = [frame(warc.FRAME_MAGIC + b"no frame at all"), frame(b"nothing"), frame(warc.DICT_MAGIC + b"cut"), struct.pack("<II", warc.DICT_FRAME, 99)]
    d = spark.createDataFrame([(bytearray(x + good),) for x in broken] + [(bytearray(good),), (bytearray(b""),), (None,)], "content binary")
    rows = warc.read(d).collect()
    assert sum(r.error is not None for r in rows) == len(broken) and sum(r.record_type == "response" for r in rows) == 1


def test_awkward_pages(spark):
    rows = [(3, "http://a/\r\nX: y", "same é"), (1, None, "same é"), (2, "u", None), (4, "u", ""), (None, "u", "same é"), (5, "u", "\r\n\r\nWARC/1.1\r\n" * 9), (6, "u", "z" * 200_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "payload": F.lit("x"), "id": F.lit(9)})
    got = {r.record_id: r for r in warc.read(warc.archives(warc.plan_revisits(d), 50_000)).collect()}
    assert len(got) == len(rows) and all(r.error is None for r in got.values())
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    for i, url, html in rows:
        r, b = got[f"urn:page:{'' if i is None else i}"], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(b), sha(b))
        first = min((x for x, _, h in rows if (h or "") == (html or "") and x is not None), default=None)
        assert r.record_type == ("response" if i == first else "revisit") and (r.refers_to or "") == ("" if i == first else f"urn:page:{first}")
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == b
    assert got["urn:page:3"].target_uri == "http://a/%0D%0AX: y"
    assert {r.record_type for r in warc.read(warc.archives(warc.plan_revisits(d, min_bytes=10**6))).collect()} == {"response"}
    assert warc.read(warc.archives(warc.plan_revisits(d.limit(0)))).count() == 0


def test_files_and_binary_source(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 5}</p>" * 40) for i in range(300)], "page_id long, url string, html string")
    warc.save_files(warc.archives(warc.plan_revisits(pages), 4000), str(tmp_path))
    assert list(tmp_path.glob("*.warc.zst"))
    (tmp_path / "broken.warc.zst").write_bytes(b"no archive")
    back = warc.read(spark.read.format("binaryFile").load(str(tmp_path / "*.zst")))
    kinds = {r[0]: r[1] for r in back.groupBy("record_type").count().collect()}
    assert kinds == {"response": 5, "revisit": 295, None: 1}
