"""Web archives: WARC records in ZIP packages, written by tasks and read back by range.

A package is a ZIP file with two members, both stored (not compressed by ZIP):
``archive/data.warc.gz``, where every record is a gzip member of its own, and
``indexes/index.cdxj``, a line for each record with its offset and length.
The reader asks for a package's last bytes, parses the end record and, where
there is one, the ZIP64 end record, then the central directory and the members'
local headers; the index then tells which ranges to read. Nothing is extracted
and no package is read as a whole.

Files are reached through pyarrow's file systems by URI, so a package can be on
any store they know.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm.common import join_hot, materialize, prepare, scratch

#: Signatures and sizes of the ZIP format's records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Member:
    name: str
    method: int
    size: int
    offset: int  # of its data


class ZipWriter:
    """Stored members, one after the other; sizes and offsets beyond 32 bits go to ZIP64 fields.

    Sizes aren't known ahead, so local headers refer to a data descriptor of
    64-bit sizes. ``zip64`` forces ZIP64 fields and end records.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.done = out, 0, zip64, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.name, self.start, self.size, self.crc = raw, self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, 0x21, 0, MAX32, MAX32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Add to the member; returns the data's offset within it."""
        at = self.size
        self._write(data)
        self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)
        return at

    def end(self) -> None:
        self._write(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, self.size, self.size))
        self.done.append((self.name, self.start, self.size, self.crc))

    def close(self) -> None:
        start = self.at
        for name, at, size, crc in self.done:
            big = [x for x in (size, size, at) if self.zip64 or x >= MAX32]
            extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
            short = [MAX32 if self.zip64 or x >= MAX32 else x for x in (size, size, at)]
            self._write(
                CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, 0x21, crc, short[0], short[1], len(name), len(extra), 0, 0, 0, 0, short[2])
                + name + extra
            )
        size, n = self.at - start, len(self.done)
        if self.zip64 or start >= MAX32 or size >= MAX32 or n >= MAX16:
            at = self.at
            self._write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._write(LOCATOR64 + struct.pack("<IQI", 0, at, 1))
            n, size, start = MAX16, MAX32, MAX32
        self._write(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


def directory(read, size: int) -> dict[str, Member]:
    """The members of a ZIP file by its central directory. ``read(offset, length)`` returns a range of bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end record of a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if MAX16 == n or MAX32 in (length, start):
        if end < 20 or tail[end - 20 : end - 16] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        head = read(at, 56)
        if head[:4] != END64:
            raise ValueError("no ZIP64 end record")
        n, length, start = struct.unpack_from("<QQQ", head, 32)
    listing, at, found = read(start, length), 0, {}
    for _ in range(n):
        if listing[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", listing, at + 10)[0]
        packed, whole = struct.unpack_from("<II", listing, at + 20)
        name_n, extra_n, note_n = struct.unpack_from("<HHH", listing, at + 28)
        offset = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46 : at + 46 + name_n].decode()
        extra = listing[at + 46 + name_n : at + 46 + name_n + extra_n]
        wide, e = b"", 0
        while e + 4 <= len(extra):
            tag, k = struct.unpack_from("<HH", extra, e)
            if tag == 1:
                wide = extra[e + 4 : e + 4 + k]
            e += 4 + k
        values = []
        for v in (whole, packed, offset):  # the order in the ZIP64 field
            if v == MAX32:
                v, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            values.append(v)
        local = read(values[2], 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        name_l, extra_l = struct.unpack_from("<HH", local, 26)
        found[name] = Member(name, method, values[1], values[2] + 30 + name_l + extra_l)
        at += 46 + name_n + extra_n + note_n
    return found


def open_range(uri: str):
    """A reader of byte ranges of a file, and the file's size."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    file = store.open_input_file(path)

    def read(offset: int, length: int) -> bytes:
        file.seek(offset)
        data = file.read(length)
        if len(data) != length:
            raise ValueError(f"{uri} ends before byte {offset + length}")
        return data

    return file, read, file.size()


def stored(members: dict[str, Member], name: str) -> Member:
    if name not in members:
        raise ValueError(f"no member {name}")
    if members[name].method:
        raise ValueError(f"{name} is compressed by ZIP; only stored members can be read by range")
    return members[name]


def _urn(page_id) -> str:
    return "urn:page:" if page_id is None else f"urn:page:{page_id}"


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A WARC record in gzip. A revisit keeps the payload's HTTP head, with its length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_urn(page_id)}>", "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_urn(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head = "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]).encode()
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head + body + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http_length: int
    payload: bytes


def parse(data: bytes) -> Record:
    """A WARC record from its gzip member."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.partition(":")[2]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    return Record(headers, length, payload)


def deduplicated(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """The pages (page_id, url, html) with payload_bytes, payload_digest and refers_to.

    Of equal payloads of at least ``min_bytes`` that with the largest page_id
    is stored and the others refer to it. Only the digests of repeated payloads
    are joined; a payload that holds a large share of the rows goes by a
    broadcast, see join_hot.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.withColumns({"payload_bytes": F.octet_length(html).cast("long"), "payload_digest": F.sha1(html.cast("binary"))})
    narrow = materialize(rows.select("payload_digest", "payload_bytes", "page_id"), "digests")
    met = narrow.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(
        F.max("page_id").alias("last"), F.count("*").alias("met")
    )
    found = join_hot(rows, met.filter("met > 1"), ["payload_digest"], "met", narrow.count(), "left")
    repeats = (F.col("last") != F.col("page_id")) & (F.col("payload_bytes") >= min_bytes)
    return found.withColumn("refers_to", F.when(repeats, F.col("last"))).drop("last", "met")


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = 256 << 20, min_bytes: int = 1000, zip64: bool = False) -> DataFrame:
    """Write a WARC record for every page to ZIP packages under a shared folder; returns path and bytes of each.

    Each task writes packages of its own, of about ``archive_bytes`` at most,
    under names that no other attempt uses; the returned table, which is
    written once and read back, lists those of the attempts that succeeded.

    Null html is an empty payload, a null url an empty one. Rows of null ids are
    written, refer to nothing and are referred to by nothing. Rows that repeat
    the largest id of a payload are all responses. No pages, no packages. Other
    columns are ignored.
    """
    prepare(pages.sparkSession)
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    rows = deduplicated(own, min_bytes).select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest", "refers_to"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, done, lines = None, [], []

        def close() -> None:
            nonlocal out
            out.end()
            out.begin(INDEX)
            out.write("".join(lines).encode())
            out.end()
            out.close()
            out.out.close()
            done.append((name, out.at))
            lines.clear()
            out = None

        for b in batches:
            cols = [b.column(c).cast(pa.binary()).to_pylist() if c == "html" else b.column(c).to_pylist() for c in b.schema.names]
            for page, url, html, size, digest, refers in zip(*cols, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = ZipWriter(store.open_output_stream(posixpath.join(base, name)), zip64)
                    out.begin(DATA)
                data = record(page, url, html or b"", size, digest, refers)
                at = out.write(data)
                lines.append(json.dumps({"page": page, "offset": at, "length": len(data)}) + "\n")
                if out.at >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{root.rstrip('/')}/{n}" for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], ["path", "bytes"]
        )

    return materialize(rows.mapInArrow(run, "path string, bytes long"), "packages")


#: Records, or bytes of records, that one unit of reading covers at most.
UNIT_RECORDS, UNIT_BYTES = 2000, 8 << 20


def ranges(packages: DataFrame) -> DataFrame:
    """Units of neighbouring records: path, start, the lengths of the records that follow it, by the packages' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                file, read, size = open_range(path)
                with file:
                    members = directory(read, size)
                    data, index = stored(members, DATA), stored(members, INDEX)
                    text = read(index.offset, index.size)
                paths, starts, lengths = [], [], []
                for line in text.splitlines():
                    x = json.loads(line)
                    at = data.offset + x["offset"]
                    if not lengths or len(lengths[-1]) >= UNIT_RECORDS or sum_now >= UNIT_BYTES or at != stop:
                        paths.append(path)
                        starts.append(at)
                        lengths.append([])
                        sum_now = 0
                    lengths[-1].append(x["length"])
                    sum_now += x["length"]
                    stop = at + x["length"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], ["path", "start", "lengths"]
                )

    return packages.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


def read(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of ZIP packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if wanted, payload.

    A response's length and digest come from the payload read, and must be those
    that its headers state; a revisit's from its headers. Packages' indexes are
    read first; the units they name are dealt to all tasks anew.
    """
    spark = packages.sparkSession
    prepare(spark)
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if with_payload:
        schema, types = f"{schema}, payload binary", [*types, pa.binary()]

    def number(urn: str) -> int | None:
        digits = urn.strip("<>").removeprefix("urn:page:")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for unit in b.to_pylist():
                file, fetch, _ = open_range(unit["path"])
                with file:
                    data = fetch(unit["start"], sum(unit["lengths"]))
                rows, at = [], 0
                for length in unit["lengths"]:
                    x = parse(data[at : at + length])
                    at += length
                    kind, digest = x.headers["warc-type"], x.headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(x.payload), hashlib.sha1(x.payload).hexdigest()) != (x.http_length, digest):  # noqa: S324
                        raise ValueError(f"the payload of {x.headers['warc-record-id']} is damaged")
                    refers = x.headers.get("warc-refers-to")
                    row = [number(x.headers["warc-record-id"]), x.headers["warc-target-uri"], x.http_length, digest, kind, number(refers) if refers else None]
                    rows.append([*row, x.payload] if with_payload else row)
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return ranges(packages).repartition(n).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages' records to packages in the shared folder and read them back."""
    return read(write(pages, scratch(spark, "packages")))
