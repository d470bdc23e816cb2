"""Web archives in ZIP packages: written in parallel, then read by ranges without extraction.

A package holds stored members: archive/data.warc.gz with one gzip member per record, and indexes/index.cdxj with a
line per record (id, member, offset, length). The reader parses the end record, the central directory and their ZIP64
forms, finds where each stored member's bytes begin, and reads single records from there.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import new_folder, stored, whole

#: Bytes of compressed records after which a package is closed and the next one begun.
PACKAGE_BYTES = 128 << 20


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def warc_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit carries headers alone; its payload's digest and length are those of the full payload."""
    body = b"" if kind == "revisit" else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '%20', url or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


class PackageWriter:
    """Streams records into one package; the file gets its name only when whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _opened(uri)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, record: bytes, page_id: int | None) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"id": page_id, "filename": "data.warc.gz", "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "".join(x + "\n" for x in self.index))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
        self.zip.close()
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


def zip_directory(source) -> dict[str, tuple[int, int, int]]:
    """Name -> (method, where the member's bytes begin, stored size), from the central directory of a seekable file.

    Sizes and offsets of 0xFFFFFFFF are taken from the ZIP64 extra field, and a ZIP64 end record is followed where the
    end record's own fields are full. A damaged directory raises ValueError.
    """

    def at(offset: int, n: int) -> bytes:
        source.seek(offset)
        got = source.read(n)
        if len(got) != n:
            raise ValueError("the archive is cut off")
        return got

    size = source.size()
    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or len(tail) - end < 22:
        raise ValueError("no end of central directory")
    _, _, _, count, length, start, _ = struct.unpack("<HHHHIIH", tail[end + 4 : end + 22])
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        locator = at(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = at(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, found, p = at(start, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, stored_size, plain_size = *struct.unpack("<H", directory[p + 10 : p + 12]), *struct.unpack("<II", directory[p + 20 : p + 28])
        name_n, extra_n, comment_n = struct.unpack("<HHH", directory[p + 28 : p + 34])
        header = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name, extra = directory[p + 46 : p + 46 + name_n].decode(), directory[p + 46 + name_n : p + 46 + name_n + extra_n]
        q = 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:  # holds, in this order, those of the fields that are full
                wide = list(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                plain_size = wide.pop(0) if plain_size == 0xFFFFFFFF else plain_size
                stored_size = wide.pop(0) if stored_size == 0xFFFFFFFF else stored_size
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            q += 4 + n
        local = at(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a broken member header")
        found[name] = method, header + 30 + sum(struct.unpack("<HH", local[26:30])), stored_size
        p += 46 + name_n + extra_n + comment_n
    return found


def parse_record(raw: bytes) -> dict:
    """Headers and body of one record; ValueError where it isn't one."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not gap or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    return headers | {"body": rest[:n]}


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to, which is null for what is written in full.

    Of equal payloads of at least `least_bytes`, the one with the largest page_id is written, the others refer to it.
    Only digests and ids are grouped, with partial aggregation; the join back may be split where a digest is hot.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole(F.col("html")).alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    kept = (
        pages.where(F.octet_length("payload") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    return pages.join(kept, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("kept_id")), F.col("kept_id")).alias("refers_to")
    )


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Writes with_revisits() rows into packages under `folder` (any file system that pyarrow opens); one row per package: path, n_records.

    A task that is run again writes files of its own; only those that the result names count.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        writer, done = None, []

        def closed() -> None:
            writer.close()
            done.append((uri, len(writer.index)))

        for part in parts:
            for page_id, url, payload, digest, refers in zip(part["page_id"].astype("Int64"), part["url"], part["payload"], part["payload_digest"], part["refers_to"].astype("Int64")):
                if writer is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.wacz"
                    writer = PackageWriter(uri)
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                writer.add(warc_record("response" if refers is None else "revisit", page_id, url, payload.encode(), digest, refers), page_id)
                if writer.at >= PACKAGE_BYTES:
                    closed()
                    writer = None
        if writer is not None:
            closed()
        yield pd.DataFrame(done, columns=["path", "n_records"])

    return records.mapInPandas(write, "path string, n_records long")


def list_records(packages: DataFrame) -> DataFrame:
    """path, offset, length of every record, from the packages' directories and indexes; ranges are in the package file."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for uri in part["path"]:
                system, path = _opened(uri)
                with system.open_input_file(path) as source:
                    members = zip_directory(source)
                    rows = []
                    for name, (method, begin, size) in members.items():
                        if not name.startswith("indexes/"):
                            continue
                        if method:
                            raise ValueError(f"{uri}: {name} isn't stored")
                        source.seek(begin)
                        for line in source.read(size).decode().splitlines():
                            entry = json.loads(line)
                            kind, base, stored_size = members["archive/" + entry["filename"]]
                            if kind or entry["offset"] + entry["length"] > stored_size:
                                raise ValueError(f"{uri}: a record lies outside its stored member")
                            rows.append((uri, base + entry["offset"], entry["length"]))
                    yield pd.DataFrame(rows, columns=["path", "offset", "length"])

    return packages.select("path").mapInPandas(read, "path string, offset long, length long")


def read_records(ranges: DataFrame) -> DataFrame:
    """Each range read and parsed: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    A response whose body doesn't have the digest that its header names raises ValueError.
    """
    schema = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def ids(value: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(m[1]) if m else None

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = uri = None
        for part in parts:
            rows = []
            for path, offset, length in zip(part["path"], part["offset"], part["length"]):
                if path != uri:
                    if source is not None:
                        source.close()
                    system, inner = _opened(path)
                    source, uri = system.open_input_file(inner), path
                source.seek(offset)
                r = parse_record(gzip.decompress(source.read(length)))
                kind, digest = r["warc-type"], r["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(r["body"]).hexdigest() != digest:
                    raise ValueError(f"{path} at {offset}: the payload doesn't have its digest")
                n = len(r["body"]) if kind == "response" else int(r["warc-payload-length"])
                rows.append((ids(r["warc-record-id"]), r["warc-target-uri"], r["body"].decode() if kind == "response" else None, n, digest, kind, ids(r.get("warc-refers-to"))))
            frame = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
        if source is not None:
            source.close()

    return ranges.mapInPandas(read, schema)


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Writes all pages (page_id, url, html) as packages in the shared folder and reads every record back.

    A null html is the empty payload; a null page_id is kept as null; rows that repeat the kept page_id are written in
    full each; an empty table gives no rows; other columns are ignored. The ranges are dealt out anew before they are
    read, so one large package is read by many tasks.
    """
    spark = pages.sparkSession
    packages = stored(write_packages(with_revisits(pages, least_bytes), new_folder(spark, "packages")), "package-list")
    ranges = stored(list_records(packages), "record-ranges")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_records(ranges.repartition(tasks).sortWithinPartitions("path", "offset"))
