"""Web archives: write records with an index, read selected records back by byte range.

Writing makes one gzip member per record, so any record can be read on its own, and one index row
per record: file, offset, length, URL and digest.  Reading sorts the wanted index rows by place and
merges neighbouring ranges into one read.  Archives live under a URI that every executor reaches.

A payload that occurs again is written as ``revisit`` of its first occurrence.  Which rows those are is
decided on digests alone: a narrow table of (id, URL, digest) is joined with the first ids, where digests
that very many rows share are joined by broadcast.  Revisits are written from that table and have no
payload.  The payloads of all rows then meet the revisits on (id, digest), which copies do not share, and
only responses are compressed.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk
from basinflow.operators.modes import HOT_ROWS, join_unique
from basinflow.sources.shared import arrow_folder, discard, fresh_path, materialise, scan_bytes


@dataclass(frozen=True)
class WarcParams:
    """Payloads of ``least`` bytes or more are written once; ranges at most ``gap`` bytes apart are
    read together, up to ``read_bytes`` at a time; ``level`` is gzip's.  A digest of ``hot_rows`` rows or
    more is joined by broadcast."""

    least: int = 100
    gap: int = 64 << 10
    read_bytes: int = 8 << 20
    level: int = 6
    hot_rows: int = HOT_ROWS


INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
DATE = "1970-01-01T00:00:00Z"


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None = None) -> bytes:
    """One record; a revisit keeps the HTTP header, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.translate({10: "%0A", 13: "%0D"}))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record: headers by lower-case name, HTTP header length and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload": payload, "size": size}


def _page_of(urn: str | None) -> int | None:
    name = (urn or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, p: WarcParams) -> Iterator[pa.RecordBatch]:
    """One archive per task attempt: a repeated task writes another file, and only the index rows of
    the attempt that Spark commits point to a file."""
    out, path, at = None, "", 0
    for batch in (part for whole in batches for part in tk.slices(whole, "payload")):
        if out is None:
            store, root = arrow_folder(folder)
            path = f"{root}/{uuid.uuid4().hex}.warc.gz"
            out = store.open_output_stream(path, compression=None)
        page, url, size, digest, refers, payload = (c.to_pylist() for c in batch.columns)
        kinds, places, lengths = [], [], []
        for i, u, n, d, r, body in zip(page, url, size, digest, refers, payload, strict=True):
            kinds.append("response" if r is None else "revisit")
            data = _gzip(record(kinds[-1], i, u, body or b"", n, d, r), p.level)
            out.write(data)
            places.append(at)
            lengths.append(len(data))
            at += len(data)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in (0, 1, 2, 3)), pa.array(kinds), batch.column(4), pa.array([path.rsplit("/", 1)[1]] * len(kinds)), pa.array(places), pa.array(lengths)],
            names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"],
        )
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", p: WarcParams = WarcParams()) -> DataFrame:
    """Write one record per row under ``folder`` (a URI) and return the index, itself written there.

    Among rows with equal payloads of ``least`` bytes or more the smallest id is the response and
    the others revisit it (a row without id revisits a row with one where there is one); smaller
    payloads and a null payload (empty) are always responses.  Repeated rows with one id are records
    each.  A null URL leaves its header out; other columns are ignored; an empty table gives an empty
    index.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    known = materialise(rows.where(F.col("payload_bytes") >= p.least).drop("payload"), "digests")
    firsts = known.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    copies = join_unique(known, firsts, "payload_digest", p.hot_rows).where(~F.col("page_id").eqNullSafe(F.col("first")))
    copies = materialise(copies.select("page_id", "url", "payload_bytes", "payload_digest", F.col("first").alias("refers_to")), "revisits")
    told = copies.select(F.col("page_id").alias("copy"), F.col("payload_digest").alias("digest")).distinct()
    responses = rows.join(told, F.col("page_id").eqNullSafe(F.col("copy")) & (F.col("payload_digest") == F.col("digest")), "left_anti")
    responses = responses.select("page_id", "url", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"), "payload")
    every = responses.unionByName(copies.withColumn("payload", F.lit(None).cast("binary")))
    store, root = arrow_folder(folder)
    store.create_dir(root, recursive=True)
    index = materialise(every.mapInArrow(lambda b: _write_batches(b, folder, p), INDEX), "warc-index")
    for step in (known, copies):
        discard(step)
    return index


def _read_batches(batches: Iterator[pa.RecordBatch], folder: str, p: WarcParams) -> Iterator[pa.RecordBatch]:
    store, root = arrow_folder(folder)
    opened: tuple[str, object] | None = None
    for batch in batches:
        file, offset, length = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("file", "offset", "length"))
        at = 0
        while at < len(file):
            stop, end = at + 1, offset[at] + length[at]
            while stop < len(file) and file[stop] == file[at] and 0 <= offset[stop] - end <= p.gap and offset[stop] + length[stop] - offset[at] <= p.read_bytes:
                end = offset[stop] + length[stop]
                stop += 1
            if opened is None or opened[0] != file[at]:
                if opened is not None:
                    opened[1].close()
                opened = file[at], store.open_input_file(f"{root}/{file[at]}")
            data = opened[1].read_at(end - offset[at], offset[at])
            found = [parse(zlib.decompress(data[offset[k] - offset[at] :][: length[k]], 31)) for k in range(at, stop)]
            sizes, digests = [], []
            for x in found:
                whole = x["fields"]["WARC-Type"] == "response"
                sizes.append(len(x["payload"]) if whole else x["size"])
                digests.append(hashlib.sha256(x["payload"]).hexdigest() if whole else x["fields"]["WARC-Payload-Digest"].removeprefix("sha256:"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_page_of(x["fields"]["WARC-Record-ID"]) for x in found], type=pa.int64()),
                    pa.array([x["fields"].get("WARC-Target-URI") for x in found], type=pa.string()),
                    pa.array([x["payload"] if x["fields"]["WARC-Type"] == "response" else None for x in found], type=pa.binary()),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(digests),
                    pa.array([x["fields"]["WARC-Type"] for x in found]),
                    pa.array([_page_of(x["fields"].get("WARC-Refers-To")) for x in found], type=pa.int64()),
                ],
                names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )
            at = stop
    if opened is not None:
        opened[1].close()


def read_archives(index: DataFrame, folder: str, p: WarcParams = WarcParams()) -> DataFrame:
    """Read the records that ``index`` lists (any selection of the rows of :func:`write_archives`).

    Returns ``page_id, url, payload`` (null for a revisit), ``payload_bytes, payload_digest`` (of the
    full payload; of a response both are taken from the bytes read), ``record_type, refers_to``.  A
    task reads as many bytes as a scan's (``spark.sql.files.maxPartitionBytes``).  An empty index gives
    an empty result; other columns are ignored.
    """
    spark = index.sparkSession
    count, size = index.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(-(-size // scan_bytes(spark)), min(count, 2 * spark.sparkContext.defaultParallelism), 1)
    places = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(lambda b: _read_batches(b, folder, p), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives in the session's shared folder."""
    return fresh_path(pages.sparkSession, "warc")
