"""WARC archives as a Spark data source, written and read by Python tasks.

Format ``warc``, option ``path`` (a folder in any store pyarrow opens).  Files are gzip, one member for each record,
and each member says its compressed size in the ``sl`` extra field of ISO 28500, so a reader can pass over it.

Reading plans one partition for some files, whole files and up to ``splitBytes`` together.  Of each record only the
headers are unpacked first.  Equality, ``IN``, null and prefix filters on header columns (also the record type) are
answered from these; the rest of an unwanted record is never unpacked.  With ``payload`` set to ``false`` payloads are
unpacked for their HTTP header, but not handed on.  With ``verify`` set to ``true`` size and digest of a record that has its
payload are those of the bytes read, not those its headers state.  Files without the extra field are read too, member after member.

Writing takes rows ``(record_type, record_id, target_uri, refers_to, payload_digest, payload)``.  A task writes files of
up to ``fileBytes`` under a hidden name, which readers pass over; the driver's commit gives those of the tasks that count their
names, an abort deletes them.  A killed attempt may leave a hidden file behind.  A revisit has no payload; its HTTP header still says how long that was.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith,
    WriterCommitMessage)

from telemill.llm.shared import prepare

FILE_BYTES = 256 << 20
SPLIT_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, "
          "payload_digest string, content_type string, payload_bytes long, payload binary, file string, offset long")
#: Columns that a record's headers alone can answer, by header name.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
           "content_type": "content-type"}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# -- records ------------------------------------------------------------------


def member(content: bytes, level: int = 6) -> bytes:
    """One gzip member that states its own size."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(content) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(content) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _one_line(value: str | None) -> str | None:
    return None if value is None else " ".join(value.split("\n")).replace("\r", " ")


def page_record(row) -> bytes:
    """A response with its payload, or a revisit of an earlier response."""
    payload = bytes(row["payload"] or b"")
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    revisit = row["record_type"] == "revisit"
    return record([
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(row["target_uri"])), ("WARC-Payload-Digest", row["payload_digest"]),
        ("WARC-Refers-To", row["refers_to"] if revisit else None),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload)


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class Members:
    """Walks the records of one file: headers first, the rest of a record on demand."""

    CHUNK = 64 << 10

    def __init__(self, source):
        self.source, self.offset = source, 0

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], object]]:
        while True:
            self.source.seek(self.offset)
            start = self.source.read(24)
            if not start:
                return
            if start[:2] != b"\x1f\x8b":
                raise ValueError("not a gzip member")
            size = 0
            if start[3] & 4 and start[12:14] == b"sl" and struct.unpack_from("<H", start, 14)[0] == 8:
                size = struct.unpack_from("<I", start, 16)[0]
            unpack = zlib.decompressobj(31)
            self.source.seek(self.offset)
            text, read = b"", 0
            while b"\r\n\r\n" not in text and not unpack.eof:
                more = unpack.unconsumed_tail
                if not more:
                    more = self.source.read(self.CHUNK)
                    read += len(more)
                    if not more:
                        raise ValueError("a record is cut short")
                text += unpack.decompress(more, 4096)
            head, _, begun = text.partition(b"\r\n\r\n")
            at = self.offset
            end: list[int] = [at + size] if size else []

            def rest() -> bytes:
                nonlocal read
                out, kept = [begun], unpack.unconsumed_tail
                while not unpack.eof:
                    more = kept or self.source.read(self.CHUNK)
                    if not kept:
                        read += len(more)
                    kept = b""
                    if not more:
                        raise ValueError("a record is cut short")
                    out.append(unpack.decompress(more))
                end[:] = [at + read - len(unpack.unused_data)]
                return b"".join(out)

            done: list[bytes] = []

            def body() -> bytes:
                if not done:
                    done.append(rest())
                return done[0]

            yield at, parse_headers(head), body
            if not end:
                body()
            self.offset = end[0]


# -- data source --------------------------------------------------------------


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), overwrite)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "=", In: "in", IsNull: "null", IsNotNull: "some", StringStartsWith: "prefix"}
        for f in filters:
            kind = next((k for c, k in kinds.items() if type(f) is c), None)
            if kind and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((HEADERS[f.attribute[0]], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        groups: list[list[str]] = []
        room = 0
        for info in sorted(found, key=lambda i: i.path):
            if not info.base_name.endswith(".warc.gz") or info.base_name.startswith((".", "_")):
                continue
            if not groups or room < info.size:
                groups.append([])
                room = self.split
            groups[-1].append(info.path)
            room -= info.size
        return [Files(g) for g in groups] or [Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            own = headers.get(name)
            ok = (own is None if kind == "null" else own is not None and (
                kind == "some" or kind == "=" and own == value or kind == "in" and own in value
                or kind == "prefix" and own.startswith(value)))
            if not ok:
                return False
        return True

    def read(self, partition: Files):
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as source:
                for offset, headers, body in Members(source):
                    if not self._wanted(headers):
                        continue
                    size = payload = None
                    digest = headers.get("warc-payload-digest")
                    if headers.get("content-type", "").startswith("application/http"):
                        # The HTTP header begins the block; for a revisit it is all there is.
                        block = body()[:int(headers["content-length"])]
                        http, _, entity = block.partition(b"\r\n\r\n")
                        size = int(parse_headers(http).get("content-length", len(entity)))
                        if self.verify and headers.get("warc-type") != "revisit":
                            size, digest = len(entity), "sha1:" + base64.b32encode(hashlib.sha1(entity).digest()).decode()
                        payload = entity if self.payload and headers.get("warc-type") != "revisit" else None
                    elif self.payload:
                        payload = body()[:int(headers["content-length"])]
                        size = len(payload)
                    yield (headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"),
                           headers.get("warc-date"), headers.get("warc-refers-to"), digest,
                           headers.get("content-type"), size, payload, path, offset)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("filebytes", options.get("fileBytes", FILE_BYTES)))

    def write(self, iterator) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files: list[str] = []
        sink, held = None, 0
        for row in iterator:
            if sink is None or held >= self.limit:
                if sink is not None:
                    sink.close()
                files.append(f"{root}/.{uuid.uuid4().hex}.warc.gz")
                sink = store.open_output_stream(files[-1], compression=None)
                first = member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                       ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                                      b"format: WARC File Format 1.1\r\n"))
                sink.write(first)
                held = len(first)
            data = member(page_record(row))
            sink.write(data)
            held += len(data)
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        old = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".warc.gz")
               and not i.base_name.startswith(".")] if self.overwrite else []
        for message in messages:
            for path in message.files if message else []:
                folder, _, name = path.rpartition("/")
                store.move(path, f"{folder}/{name[1:]}")
        for path in old:
            store.delete_file(path)

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        for message in messages:
            for path in message.files if message else []:
                try:
                    store.delete_file(path)
                except FileNotFoundError:
                    pass


# -- pages --------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_id_of(record_id: str) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records of ``pages(page_id, url, html)``; of equal payloads of ``least`` bytes or more, one has the payload.

    That is the one with the smallest ``page_id``.  Null html is the empty payload; null ids come last, and a group
    without ids has responses only.  Repeated rows of the smallest id are all responses.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"),
                         payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    # Digests and ids alone are grouped; payloads cross the network once, to meet their group's smallest id.
    first = given.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"))
    joined = given.join(first, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), _record_id(F.col("page_id")).alias("record_id"),
        "target_uri", F.when(again, _record_id(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32(F.col("sha"))).alias("payload_digest"), "payload")


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string: four letters for every five digits."""
    letters = base64.b32encode(bytes(int(f"{i:05b}" * 8, 2) >> s & 255 for i in range(32) for s in (32, 24, 16, 8, 0)))[::8].decode()
    parts = []
    for i in range(8):
        value = F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    register(pages.sparkSession)
    page_records(pages, least).write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option(
        "verify", str(verify).lower()).load()
