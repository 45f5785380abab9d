"""WARC archives as seekable Zstandard bundles.

A bundle is one file: WARC records grouped into frames that decompress on their own, then a skippable frame with the seek table
of the public seekable format (sizes of every frame, and a footer with their number). An index maps each record identifier to
bundle, frame and the record's place inside the frame. Bundles and index are one Parquet table in the shared folder, so that
they can be in any store that Spark reads; ``export_bundles`` writes them as plain files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, few, give_back

#: Fixed values of the seekable format: skippable frame, footer, bytes a frame in the table without checksums.
SKIPPABLE, FOOTER, ENTRY = 0x184D2A5E, 0x8F92EAB1, 8

_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
_BUNDLES = "bundle_id string, archive binary, index array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"


def record(kind: str, record_id: str, url: str, digest: str, payload: bytes, size: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; revisits have a head but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Head fields, HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    name = lambda k: fields[k].removeprefix("<urn:page:").removesuffix(">") if k in fields else None
    return {"record_id": name("WARC-Record-ID"), "kind": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": name("WARC-Refers-To"), "payload": payload, "size": size, "url": fields["WARC-Target-URI"]}


class BundleWriter:
    """Collects records into frames; holds one raw frame and the compressed ones of one bundle."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.zstd, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.reset()

    def reset(self) -> None:
        self.frames, self.table, self.index, self.raw, self.size = [], [], [], bytearray(), 0

    def add(self, record_id: str, raw: bytes) -> None:
        if self.raw and len(self.raw) + len(raw) > self.frame_bytes:
            self.close_frame()
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": len(self.raw), "length": len(raw)})
        self.raw += raw

    def close_frame(self) -> None:
        if self.raw:
            packed = self.zstd.compress(bytes(self.raw))
            self.table.append((len(packed), len(self.raw)))
            self.frames.append(packed)
            self.size += len(packed)
            self.raw = bytearray()

    def finish(self) -> tuple[bytes, list[dict]]:
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.table)
        foot = struct.pack("<IBI", len(self.table), 0, FOOTER)
        out = b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table) + len(foot)), table, foot]), self.index
        self.reset()
        return out


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(place, packed size, raw size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    entry = ENTRY + (4 if flags & 0x80 else 0)
    at = len(archive) - 9 - n * entry
    out, place = [], 0
    for i in range(n):
        packed, raw = struct.unpack_from("<II", archive, at + i * entry)
        out.append((place, packed, raw))
        place += packed
    return out


def read_frame(archive: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    place, packed, raw = frame
    return zstandard.ZstdDecompressor().decompress(archive[place : place + packed], max_output_size=max(raw, 1))


def fetch(archive: bytes, frame: int, offset: int, length: int) -> dict:
    """One record by its place in the index: only its frame is decompressed."""
    return parse(read_frame(archive, seek_table(archive)[frame])[offset : offset + length])


def export_bundles(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(bundle_id, file): every bundle of the table at ``path`` as a plain ``.warc.zst`` file in ``folder``.

    Executors write through pyarrow's file systems, so ``folder`` is a URI or path that all of them reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names = [f"{root}/{b}.warc.zst" for b in batch.column("bundle_id").to_pylist()]
            for name, archive in zip(names, batch.column("archive")):
                with store.open_output_stream(name, compression=None) as f:
                    f.write(archive.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column("bundle_id"), pa.array(names)], names=["bundle_id", "file"])

    return spark.read.parquet(path).select("bundle_id", "archive").mapInArrow(run, "bundle_id string, file string")


def _packer(frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w, n, task = BundleWriter(frame_bytes, level), 0, TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            nonlocal n
            archive, index = w.finish()
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:05d}"]), pa.array([archive], pa.binary()), pa.array([index], _INDEX)], names=["bundle_id", "archive", "index"])

        for b in batches:
            for i in range(b.num_rows):
                key, url, html, digest, first = (b.column(c)[i].as_py() for c in ("page_id", "url", "html", "digest", "first"))
                body = (html or "").encode("utf-8", "surrogatepass")
                name = "" if key is None else str(key)
                again = first is not None and first != key
                w.add(name, record("revisit" if again else "response", name, url or "", digest, body, len(body), str(first) if again else None))
                if w.size + len(w.raw) >= bundle_bytes:
                    yield out()
        if w.index:
            yield out()
        give_back()

    return run


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive"), batch.column("index")):
                data, places, last, raw, rows = archive.as_py(), index.as_py(), -1, b"", []
                table = seek_table(data)
                for p in places:
                    if p["frame"] != last:
                        last, raw = p["frame"], read_frame(data, table[p["frame"]])
                    r = parse(raw[p["offset"] : p["offset"] + p["length"]])
                    if r["kind"] == "response" and (hashlib.sha256(r["payload"]).hexdigest() != r["digest"] or len(r["payload"]) != r["size"]):
                        raise ValueError(f"record {r['record_id']} doesn't hold what its digest says")
                    key = lambda x: int(x) if x else None
                    rows.append((key(r["record_id"]), r["size"], r["digest"], r["kind"], key(r["refers_to"]), r["url"], r["payload"] if payloads and r["kind"] == "response" else None))
                    if len(rows) == 2000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)
        give_back()

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return run


def write_bundles(pages: DataFrame, path: str, least: int = 100, frame_bytes: int = 262_144, bundle_bytes: int = 8_388_608, level: int = 3, most_repeated: int = 500_000) -> None:
    """Write a record for each row of ``pages(page_id, url, html, ...)`` to bundles at ``path``.

    Payload: html in UTF-8, null as empty. Of equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and
    the others revisit it; smaller payloads are all responses. Rows that repeat page_id and payload of a response are responses too, so are
    payloads whose rows have no page_id. A null url is written as empty. Equality is that of SHA-256 digests. Only digests and ids are grouped, with
    combining before the shuffle. The digests that repeat are broadcast up to ``most_repeated``, so that no payload moves; beyond, payloads are joined
    with them by a shuffle that may be split where many pages are alike. A payload is a string column's value, of less than 2 GiB.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    scratch = Scratch(pages.sparkSession, "digests")
    rows = rows.join(few(scratch.keep(groups, "repeated"), most_repeated), F.col("digest") == F.col("d"), "left").drop("d")
    rows.mapInArrow(_packer(frame_bytes, bundle_bytes, level), _BUNDLES).write.parquet(path)
    scratch.clear()


def read_bundles(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null in revisits, or unless asked for) of every record; digests of responses are verified."""
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return spark.read.parquet(path).select("archive", "index").mapInArrow(_reader(payloads), kinds)


def fetch_records(spark: SparkSession, path: str, record_ids: DataFrame) -> DataFrame:
    """page_id, record_type, payload of the asked ``record_ids(page_id)``: an index lookup, then one frame each."""
    index = spark.read.parquet(path).select("bundle_id", F.explode("index").alias("i")).select("bundle_id", "i.*")
    hits = index.join(record_ids.select(F.col("page_id").cast("string").alias("k")).distinct(), F.col("record_id") == F.col("k"))
    hits = hits.groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("index")).withColumnRenamed("bundle_id", "b")
    some = spark.read.parquet(path).select("bundle_id", "archive").join(hits, F.col("bundle_id") == F.col("b")).select("archive", F.array_sort("index").alias("index"))
    return some.mapInArrow(_reader(True), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary").select("page_id", "record_type", "payload")
