"""WARC archives (a gzip member per record) written beside an index, and read back by
coalesced byte ranges.

Writing yields the index first of all: one row per record with its file, offset,
length, URL and payload digest. Reading takes any selection of index rows, sorts
them by file and offset, merges neighbouring ranges and fetches each merged range
once. Of records with equal payloads of ``REVISIT_BYTES`` or more, that with the
smallest page id holds the payload; the others are revisit records that name it.

A null html is an empty payload, a null url an empty target. Null ids sort first.
Repeated page ids, even with one url and payload, stay separate records; exactly one of
those with the smallest id holds a shared payload. Extra columns are ignored; an empty
table gives none. ``pages`` must be a written table: it is read twice, and its rows are
known by their place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import storage
from folio.llm.shared import materialize, scratch_path, spread_over

REVISIT_BYTES = 100
#: Bytes after which a task begins another archive.
FILE_BYTES = 64 << 20
#: Ranges closer than this are read as one.
GAP_BYTES = 64 << 10
#: A merged range ends at this size, so a task's memory has a bound.
RANGE_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "page_id long, path string, offset long, length long, url string, payload_digest string"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    value = name[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


#: Compression of a record; archives are text, so the fastest level takes most of the gain.
GZIP_LEVEL = 1


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record. A URL's line ends are percent-encoded, as headers are lines."""
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    body = b"" if refers_to else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """The fields of one record; the payload of a response is held against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": _number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": fields["WARC-Type"],
        "refers_to": _number(fields["WARC-Refers-To"]) if revisit else None,
        "payload_bytes": int(fields["WARC-Payload-Length"]),
        "payload_digest": digest,
        "payload": None if revisit else body,
    }


def _with_holder(pages: DataFrame) -> DataFrame:
    """Add digest and the id of the record that holds the payload.

    Only ids and digests are shuffled to find the holders; of a payload that recurs,
    rows meet by partial aggregation and the join back can be split when skewed.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # rows of one id and url are told apart by their place in the table
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    first = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")).alias("holder")).where("times > 1")
    return rows.join(first.select("digest", "holder"), "digest", "left")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages to archives in ``folder``; returns the written index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        pending: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            with storage.new_file(folder, ".warc.gz") as (uri, stream):
                for x in pending:
                    stream.write(x)
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            page, offset, length, url, digest = (pa.array(x, t) for x, t in zip(cols, kinds, strict=True))
            out = pa.RecordBatch.from_arrays([page, pa.array([uri] * len(rows)), offset, length, url, digest], ["page_id", "path", "offset", "length", "url", "payload_digest"])
            rows.clear()
            pending.clear()
            return out

        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("page_id", "url", "html", "digest", "refers", "holder_id"))
            for page_id, url, html, digest, refers, holder in zip(*columns, strict=True):
                data = packed(record(page_id, url, html.encode(), digest, _name(holder) if refers else None))
                rows.append((page_id, size, len(data), url, digest))
                pending.append(data)
                size += len(data)
                if size >= FILE_BYTES:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    held = _with_holder(pages)
    refers = F.col("holder").isNotNull() & (F.col("row") != F.col("holder.row"))
    ready = held.select("page_id", "url", "html", "digest", refers.alias("refers"), F.col("holder.page_id").alias("holder_id"))
    return materialize(ready.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def merge_ranges(offsets: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Slices of sorted records that one read fetches."""
    out, a = [], 0
    for k in range(1, len(offsets) + 1):
        if k == len(offsets) or offsets[k] - (offsets[k - 1] + lengths[k - 1]) > GAP_BYTES or offsets[k] + lengths[k] - offsets[a] > RANGE_BYTES:
            out.append((a, k))
            a = k
    return out


def read_warc(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, by sorted and merged range reads.

    Tasks take ranges of (path, offset), so a file is read by few tasks, in order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            paths = np.array(batch.column("path").to_pylist(), object)
            offsets, lengths = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("offset", "length"))
            edges = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                with storage.random_access(paths[a]) as stream:
                    for x, y in merge_ranges(offsets[a:b], lengths[a:b]):
                        begin = int(offsets[a + x])
                        data = stream.read_at(int(offsets[a + y - 1] + lengths[a + y - 1]) - begin, begin)
                        found = [parse(data[o - begin : o - begin + n]) for o, n in zip(offsets[a + x : a + y].tolist(), lengths[a + x : a + y].tolist(), strict=True)]
                        for r in found if not payloads else ():
                            r["payload"] = None
                        yield pa.RecordBatch.from_pylist(found, schema)

    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = spread_over(int(total // RANGE_BYTES) + 1, selected.sparkSession.sparkContext.defaultParallelism)
    ordered = selected.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(read, RECORD_SCHEMA)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages and read all records back, without the payloads' bytes."""
    return read_warc(write_warc(pages, scratch_path(pages.sparkSession, "warc")), payloads=False)
