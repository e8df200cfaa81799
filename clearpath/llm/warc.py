"""WARC records in ZIP packages: written by tasks, read by byte ranges.

A package is a file that holds ``archive/data.warc.gz`` (each record a gzip member of its
own) and ``indexes/index.cdxj`` (a line a record: key, time and a JSON object with offset
and length in the archive member), both stored without compression, and a
``datapackage.json``. The reader finds the end record, follows the ZIP64 locator where
there is one, parses the central directory, and takes from a stored archive member only
the bytes of the record asked for. Index lines with or without key and time are read,
also from a compressed member or an index that is a gzip file, a piece at a time.

Packages lie in the shared folder, of about ``PACKAGE_BYTES`` of payload each; tasks
write them under names of their own attempt, and Spark commits the table of their paths,
so what a lost executor left half-written is never read. ``read_packages`` takes any
table of paths (local, hdfs, s3 and whatever else ``pyarrow.fs`` opens): each package's
index becomes rows, these are dealt by package and ``STRETCH`` of the archive, so that a
package of any size is read by many tasks, and each task seeks to its records, reading
``AHEAD`` bytes at a time. No task holds more of a package than that and a record.

Scale: one shuffle by digest marks repeated payloads. Digests are salted, so the most
common page is dealt over ``SALTS`` keys, and payloads under 100 bytes meet nothing; the
side that has only digests met more than once has one row a digest and salt.

Null html is an empty payload. Equal payloads under 100 bytes are never revisits. Rows
that repeat the smallest page_id of a payload are all responses; a null page_id never
is the smallest, and is a revisit if the payload has another id. Null url: no target
header. Very long payloads are one record each. Empty table: no packages, empty result.
Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_root, table

REVISIT_FROM, PACKAGE_BYTES, SALTS = 100, 16_000_000, 16
#: Bytes that a reader fetches at a time, and of an archive that one task reads at once.
AHEAD, STRETCH = 1 << 20, 64 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE, STAMP = "2024-01-01T00:00:00Z", "20240101000000"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: a response)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    rows = rows.withColumn("_digest", F.when(F.octet_length("html") >= REVISIT_FROM, F.col("digest"))).withColumn("_salt", (F.abs(F.xxhash64("page_id", "url") % 1_000_003) % SALTS).cast("int"))
    first = rows.filter("_digest is not null").groupBy("_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.join(first, ["_digest", "_salt"], "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def surt(url: str | None) -> str:
    """The key of an index line: the host's labels from the last to the first, and the path."""
    if not url:
        return "-"
    x = urlsplit("".join(url.split()))
    return ",".join(reversed(x.netloc.lower().split("."))) + ")" + (x.path or "/") + (f"?{x.query}" if x.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def package(records: list[tuple[bytes, dict]], zip64: bool = False) -> bytes:
    """Records and what their index lines say, as one package."""
    at, members, lines = 0, [], []
    for data, about in records:
        member = gzip.compress(data, 6, mtime=0)
        about = dict(about)
        key = surt(about.pop("url", None))
        lines.append(f"{key} {STAMP} " + json.dumps(about | {"offset": at, "length": len(member), "filename": ARCHIVE}))
        members.append(member)
        at += len(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in ((ARCHIVE, b"".join(members)), (INDEX, "\n".join(lines).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "records": len(lines)}).encode())):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


class Package:
    """A ZIP package behind ``read(offset, size)``; nothing is extracted."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557)  # end record with the longest comment
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        locator = tail_at + at - 20
        if locator >= 0 and (x := read(locator, 20))[:4] == b"PK\x06\x07":
            end64 = read(struct.unpack_from("<Q", x, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        directory = read(start, length)
        self.members: dict[str, tuple[int, int, int]] = {}  # method, size, local header
        at = 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", directory, at + 10)[0]
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n_name].decode()
            extra, x = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while x + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # ZIP64: of these three, those that the entry leaves open
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                x += 4 + n
            self.members[name] = (method, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        method, _, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        n_name, n_extra = struct.unpack_from("<HH", self.read(header, 30), 26)
        return header + 30 + n_name + n_extra

    def _pieces(self, name: str):
        """The bytes of an index member, uncompressed, a piece at a time."""
        method, size, header = self.members[name]
        n_name, n_extra = struct.unpack_from("<HH", self.read(header, 30), 26)
        at, ways = header + 30 + n_name + n_extra, []
        if method == 8:
            ways.append(zlib.decompressobj(-15))
        elif method != 0:
            raise ValueError(f"{name} is neither stored nor deflated")
        if name.endswith(".gz"):
            ways.append(zlib.decompressobj(31))
        for start in range(at, at + size, AHEAD):
            data = self.read(start, min(AHEAD, at + size - start))
            for i, way in enumerate(ways):
                out = way.decompress(data)
                while way.eof and way.unused_data:  # a gzip file may have several members
                    rest = way.unused_data
                    way = ways[i] = zlib.decompressobj(31)
                    out += way.decompress(rest)
                data = out
            yield data

    def lines(self):
        """Lines of all indexes, one after the other, with the archive's place as ``at``."""
        starts = {n: self.start(n) for n in self.members if n.endswith((".warc.gz", ".warc"))}
        for name in self.members:
            if not name.startswith("indexes/") or not name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
                continue
            rest = b""
            for piece in self._pieces(name):
                *whole, rest = (rest + piece).split(b"\n")
                yield from (self._line(x, starts) for x in whole if b"{" in x)
            if b"{" in rest:
                yield self._line(rest, starts)

    def _line(self, line: bytes, starts: dict[str, int]) -> dict:
        x = json.loads(line[line.index(b"{") :])  # a key and a time may stand before it
        offset, length = int(x["offset"]), int(x["length"])
        member = x["filename"] if x["filename"] in starts else next(n for n in starts if n.endswith("/" + x["filename"]))
        return x | {"filename": member, "offset": offset, "length": length, "at": starts[member] + offset}

    def index(self) -> list[dict]:
        return list(self.lines())

    def record(self, line: dict) -> tuple[dict[str, str], bytes]:
        data = self.read(line["at"], line["length"])
        return parse_record(zlib.decompress(data, 31) if line["filename"].endswith(".gz") else data)


class Ranges:
    """Byte ranges of a file on any file system that ``pyarrow.fs`` opens."""

    def __init__(self, path: str, ahead: int = AHEAD):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.size, self.ahead, self.at, self.held = self.file.size(), ahead, 0, b""

    def read(self, at: int, size: int) -> bytes:
        if not (self.at <= at and at + size <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(min(max(size, self.ahead), self.size - at), at)
        return self.held[at - self.at : at - self.at + size]


def write_packages(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """One record a page, in packages below the shared folder: their paths."""
    folder = f"{scratch_root(pages.sparkSession)}/packages-{uuid.uuid4().hex}"

    def run(batches):
        held, size, made = [], 0, 0
        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)

        def flush():
            nonlocal held, size, made
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:06d}.wacz"
            system.create_dir(base)
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(package(held))
            held, size, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                held.append((record(page_id, url, payload, digest, refers_to), {"url": url, "page_id": page_id, "type": "response" if refers_to is None else "revisit", "digest": f"sha256:{digest}"}))
                size += len(payload) + 512
                if size >= package_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialize(marked(pages).mapInArrow(run, "path string"), "packages")


def describe(headers: dict[str, str], block: bytes) -> tuple:
    """A record's row: digest and length from the payload itself, or for revisits from
    the headers that stand for it."""
    number = lambda x: int(headers[x].strip("<>").rsplit(":", 1)[1]) if x in headers else None
    http, _, payload = block.partition(b"\r\n\r\n")
    told = headers["warc-payload-digest"].removeprefix("sha256:")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if headers["warc-type"] == "response":
        length, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != told:
            raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
    return number("warc-record-id"), length, told, headers["warc-type"], number("warc-refers-to")


def index_rows(packages: DataFrame) -> DataFrame:
    """A row for each line of the indexes of all packages: path, at, length, zipped."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source = Ranges(path)
                lines = Package(source.read, source.size).lines()
                while some := list(islice(lines, 10_000)):
                    columns = [[path] * len(some), [x["at"] for x in some], [x["length"] for x in some], [x["filename"].endswith(".gz") for x in some]]
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "at", "length", "zipped"])

    return packages.select("path").mapInArrow(run, "path string, at long, length long, zipped boolean")


def read_packages(packages: DataFrame) -> DataFrame:
    """A row for each record of all packages (``path``), each read by its byte range."""

    def run(batches):
        path, source = None, None
        for batch in batches:
            for a in range(0, len(batch), 1000):
                rows = []
                for own, at, length, zipped in zip(*(c.to_pylist() for c in batch.slice(a, 1000).columns), strict=True):
                    if own != path:
                        path, source = own, Ranges(own)
                    data = source.read(at, length)
                    rows.append(describe(*parse_record(zlib.decompress(data, 31) if zipped else data)))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = index_rows(packages).withColumn("stretch", F.floor(F.col("at") / STRETCH)).repartition("path", "stretch").sortWithinPartitions("path", "at")
    return dealt.select("path", "at", "length", "zipped").mapInArrow(run, RECORD_SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(write_packages(table(spark, sf_dir, "pages")))


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS b, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN b >= {REVISIT_FROM} THEN min(page_id) OVER (PARTITION BY d) END AS m FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest,
  CASE WHEN m IS DISTINCT FROM page_id AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to
FROM q
"""
