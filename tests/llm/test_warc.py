import hashlib

import pytest

from clearpath.llm.warc import ORACLE, Package, describe, op5_warc, package, read_packages, record, write_packages

from .oracle import same


def test_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        same(op5_warc(spark, f"/root/testdata/{sf}"), ORACLE, f"/root/testdata/{sf}")


def test_edges(spark):
    long = "<p>é\r\n\r\n</p>" * 50
    rows = [(5, "u", long, 1), (3, None, long, 2), (9, "http://x/\r\nWARC-Type: fake", long, 3), (1, "a b", "short", 4), (2, "a", "short", 5), (4, "n", None, 6), (3, "x", long, 7), (None, "x", long, 8), (6, "x", "", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2)
    packages = write_packages(df, package_bytes=700)
    got = sorted((tuple(r) for r in read_packages(packages).collect()), key=str)
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        again = html == long and page != 3
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    assert read_packages(write_packages(df.limit(0))).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_ranges_only(zip64):
    payloads = [bytes([65 + i]) * 3000 for i in range(20)]
    data = package([(record(i, "u", p, hashlib.sha256(p).hexdigest(), None), {"page_id": i}) for i, p in enumerate(payloads)], zip64)
    asked = []

    def read(at, n):
        asked.append((at, n))
        return data[at : at + n]

    p = Package(read, len(data))
    assert [describe(*p.record(x))[:2] for x in p.index()][7] == (7, 3000)
    line = p.index()[3]
    asked.clear()
    headers, block = p.record(line)
    assert asked == [(line["at"], line["length"])] and block.endswith(payloads[3])


def zip64_directory(data: bytes) -> bytes:
    """The same package with its sizes and places only in ZIP64 records."""
    import struct

    at = data.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<HII", data, at + 10)
    directory, out, x = data[start : start + length], b"", 0
    for _ in range(count):
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, x + 20)
        header = struct.unpack_from("<I", directory, x + 42)[0]
        extra = struct.pack("<HHQQQ", 1, 24, full, packed, header)
        fixed = bytearray(directory[x : x + 46])
        struct.pack_into("<IIHHH", fixed, 20, 0xFFFFFFFF, 0xFFFFFFFF, n_name, len(extra), 0)
        struct.pack_into("<I", fixed, 42, 0xFFFFFFFF)
        out += bytes(fixed) + directory[x + 46 : x + 46 + n_name] + extra
        x += 46 + n_name + n_extra + n_comment
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(out), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(out), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    return data[:start] + out + end64 + locator + end


def test_zip64_central_directory():
    p = b"x" * 500
    data = zip64_directory(package([(record(1, "u", p, hashlib.sha256(p).hexdigest(), None), {"page_id": 1})]))
    got = Package(lambda at, n: data[at : at + n], len(data))
    assert [describe(*got.record(x)) for x in got.index()] == [(1, 500, hashlib.sha256(p).hexdigest(), "response", None)]


def test_range_reader_on_files(spark, tmp_path):
    """Index lines with key and time, a gzip index, names relative to the archive's folder; a very long payload."""
    import gzip
    import io
    import json
    import zipfile

    from clearpath.llm.warc import Ranges

    payloads = [b"short", b"<p>" + b"z" * 300, b"y" * 5_000_000]
    members = [gzip.compress(record(i, "http://Example.org/a?b=1", p, hashlib.sha256(p).hexdigest(), None)) for i, p in enumerate(payloads)]
    lines, at = [], 0
    for m in members:
        lines.append("org,example)/a?b=1 20240101000000 " + json.dumps({"offset": str(at), "length": str(len(m)), "filename": "data.warc.gz"}))
        at += len(m)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc.gz", b"".join(members))
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines[:1]).encode()) + gzip.compress(("\n" + "\n".join(lines[1:])).encode()))
        z.writestr("pages/pages.jsonl", "{}", zipfile.ZIP_DEFLATED)
    path = tmp_path / "own.wacz"
    path.write_bytes(out.getvalue())
    got = sorted(tuple(r) for r in read_packages(spark.createDataFrame([(str(path), 1)], "path string, size int")).collect())
    assert got == [(i, len(p), hashlib.sha256(p).hexdigest(), "response", None) for i, p in enumerate(payloads)]
    source = Ranges(str(path), ahead=100)
    assert source.read(10, 50) == out.getvalue()[10:60] and len(source.held) == 100
