"""WARC archives: writing, normalising and reading back.

Writing makes monolithic archives: one gzip stream over all records of a file. The normaliser inflates
such a stream once from start to end, rewrites each record as a gzip member of its own, and writes a
sidecar index with the offset and length of each member, so that any record can be read alone.

Files live below the folder that driver and executors share. Each is written under a name of its own
attempt and then renamed, and names come from partition numbers: an attempt that is run again makes the
same file. Manifests (path and number of records of each file) are tables in that folder; of them only
counts reach the driver. Whoever reads a file compares its records with the manifest's number.

Of payloads that occur more than once and have at least `min_revisit` bytes, the record with the largest
id is the response and the others are revisits that refer to it.

Defined cases: a null payload is an empty one; a null url is written as urn:page:<id>; a record with a
null id is a response only if no record with an id has its payload, and with equal largest ids all of
them are responses; payloads of any length are kept whole (one is held in memory at a time, files are
streamed); an empty table makes no archives and an empty result; only id, url and payload are read; an
archive that ends anywhere but after a whole gzip member and a whole record, or that has more or fewer
records than its manifest says, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evograph.llm.common import arrow_schema, remove, shared_dir, table

#: Bytes of records after which a new archive begins.
ARCHIVE_BYTES = 64 << 20
#: Tasks of a step over archives, at most (more archives: several a task).
MAX_TASKS = 20_000
#: Payloads shorter than this are never revisits.
MIN_REVISIT = 1000
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_LEVEL, _READ = 4, 1 << 20


@dataclass
class Record:
    """A WARC record: named fields and a block."""

    fields: dict[str, str]
    block: bytes = field(repr=False, default=b"")

    def dump(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.fields.items())
        return f"WARC/1.1\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def records(stream: Iterator[bytes]) -> Iterator[Record]:
    """Records of an inflated stream; holds one record and one piece of the stream."""
    held, pieces = bytearray(), iter(stream)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's head")
                return
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields.pop("Content-Length"))
        while len(held) < end + 4 + size + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]
        yield Record(fields, block)


def inflate(source: io.RawIOBase) -> Iterator[bytes]:
    """A gzip file's bytes, member after member, in pieces of bounded size; an error if the last member isn't whole."""
    z, begun = zlib.decompressobj(31), False
    while data := source.read(_READ):
        while data:
            begun = True
            if out := z.decompress(data, _READ):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
    while begun and not z.eof and (out := z.decompress(z.unconsumed_tail, _READ)):
        yield out
    if begun and not z.eof:
        raise ValueError("the gzip stream is cut short")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Target:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.own), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(record_id: str) -> int | None:
    name = record_id.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record_of(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> Record:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _id(page_id),
        "WARC-Date": _DATE,
        "WARC-Target-URI": " ".join((url or "").split()) or f"urn:page:{page_id}",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _id(refers_to)}
    return Record(fields, _HTTP + (b"" if revisit else payload))


_MANIFEST = "path string, n bigint"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes monolithic archives below `folder` and gives their manifest: path and number of records (with warcinfo)."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    size, digest = F.octet_length("payload"), F.sha1("payload")
    # Only payloads that occur again: narrow, pre-aggregated, and of known size, so that it is broadcast if small.
    again = src.where(size >= min_revisit).groupBy(digest.alias("digest")).agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep")
    rows = src.join(table(again), (digest == F.col("digest")) & (size >= min_revisit), "left")
    rows = rows.select("page_id", "url", "payload", "keep", (F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, out, z, held = TaskContext.get().partitionId(), {}, None, None, 0

        def close() -> None:
            out.write(z.flush())
            out.close()

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, keep, revisit = (c[i].as_py() for c in batch.columns)
                if out is not None and held >= ARCHIVE_BYTES:
                    close()
                    out = None
                if out is None:
                    path = f"{folder}/whole/part-{part:06d}-{len(made):04d}.warc.gz"
                    out, z, held, made[path] = _Target(path), zlib.compressobj(_LEVEL, wbits=31), 0, 1
                    out.write(z.compress(Record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{part}:{len(made)}>", "WARC-Date": _DATE, "Content-Type": "application/warc-fields"}, b"software: evograph\r\n").dump()))
                data = record_of(page_id, url, payload, revisit, keep if revisit else None).dump()
                out.write(z.compress(data))
                held += len(data)
                made[path] += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.int64())], names=["path", "n"])

    return table(rows.mapInArrow(run, _MANIFEST))


def normalise_file(source: str, target: str) -> int:
    """Rewrites one archive record by record, with its index beside it; the number of records."""
    fs, path = _open(source)
    out, index, n = _Target(target), _Target(f"{target}.idx"), 0
    with fs.open_input_stream(path, compression=None) as raw:
        for r in records(inflate(raw)):
            z = zlib.compressobj(_LEVEL, wbits=31)
            member = z.compress(r.dump()) + z.flush()
            index.write((json.dumps({"offset": out.size, "length": len(member), "type": r.fields["WARC-Type"], "id": r.fields["WARC-Record-ID"]}) + "\n").encode())
            out.write(member)
            n += 1
    index.close()
    out.close()
    return n


def _per_file(manifest: DataFrame, run, schema: str) -> DataFrame:
    """A task for each file, or for several if there are very many."""
    tasks = min(max(1, 4 * manifest.count()), MAX_TASKS)
    return manifest.repartition(tasks, "path").mapInArrow(run, schema)


def _whole(path: str, found: int, said: int) -> None:
    if found != said:
        raise ValueError(f"{path} has {found} records, its manifest says {said}")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalises monolithic archives into `folder`/records, file by file, and gives the manifest of the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = f"{folder}/records/{path.rpartition('/')[2]}"
                _whole(path, normalise_file(path, target), n)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], names=["path", "n"])

    return table(_per_file(manifest, run, _MANIFEST))


def _member(data: bytes) -> Record:
    """The one record of a gzip member."""
    found = list(records(inflate(io.BytesIO(data))))
    _whole("a member", len(found), 1)
    return found[0]


def read_record(path: str, offset: int, length: int) -> Record:
    """One record of a normalised archive, by its index entry."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        f.seek(offset)
        return _member(f.read(length))


_ROW = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint, length bigint"


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of normalised archives (warcinfo left out), read through their indexes and verified.

    With payloads, also `payload`: the bytes of a response, null for a revisit.
    """
    schema = _ROW + (", payload binary" if payloads else "")
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, n in (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            fs, name = _open(path)
            with fs.open_input_stream(f"{name}.idx", compression=None) as f:
                entries = [json.loads(x) for x in f.read().splitlines()]
            _whole(path, len(entries), n)
            rows: list[dict] = []
            held = 0
            with fs.open_input_stream(name, compression=None) as f:
                for e in entries:
                    r = _member(f.read(e["length"]))
                    if e["type"] == "warcinfo":
                        continue
                    body = r.block.partition(b"\r\n\r\n")[2]
                    digest = base64.b32decode(r.fields["WARC-Payload-Digest"].partition(":")[2]).hex()
                    if e["type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{path} at {e['offset']}: the payload's digest is wrong")
                    rows.append({
                        "page_id": _number(r.fields["WARC-Record-ID"]), "url": r.fields["WARC-Target-URI"], "payload_bytes": int(r.fields["X-Payload-Length"]), "payload_digest": digest, "record_type": e["type"],
                        "refers_to": _number(r.fields["WARC-Refers-To"]) if "WARC-Refers-To" in r.fields else None, "archive": path, "offset": e["offset"], "length": e["length"],
                    } | ({"payload": body if e["type"] == "response" else None} if payloads else {}))
                    held += len(body) if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=target)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return _per_file(manifest, run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives, normalises them, drops the monolithic ones, and reads the records back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = normalise(write(pages, folder, id_col, url_col, payload_col), folder)
    if archives.count():
        remove(spark, f"{folder}/whole")
    return read(archives)
