"""WARC archives by index: write records and their places, then read chosen byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalgrid.llm.common import broadcast_if_small, file_system, lean, stored
from signalgrid.session import remove_at_exit, work_folder

LEAST_REVISIT = 1_000
ARCHIVE_BYTES = 64_000_000
RANGE_BYTES = 8_000_000
GAP_BYTES = 64_000
DATE = "1970-01-01T00:00:00Z"

INDEX = ("page_id long, url string, payload_digest string, payload_bytes long, record_type string, "
         "refers_to long, file string, offset long, length long")
_KINDS = {"page_id": pa.int64(), "url": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(),
          "record_type": pa.string(), "refers_to": pa.int64(), "file": pa.string(), "offset": pa.int64(),
          "length": pa.int64()}
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str,
                 refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member; a revisit holds the response's head alone."""
    label = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
            f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {label}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~' + chr(39))}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> dict:
    """A record's headers and payload; digest and size of a response are those of its bytes."""
    raw = zlib.decompress(member, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    number = {k: re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To")}
    page, refers = (int(m[1]) if m else None for m in number.values())
    if fields["WARC-Type"] == "revisit":
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return {"page_id": page, "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": refers,
            "payload": None if fields["WARC-Type"] == "revisit" else payload}


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html) and return the stored index of their places.

    Of records with equal payloads (UTF-8 of html; null is empty) of at least ``least`` bytes, that with
    the largest page_id is a response and the others revisit it; rows that share that id are all
    responses. A row with a null page_id revisits like others and is never referred to.
    Other columns are ignored; no pages give no archives. Each task writes archives of
    its own in the shared folder; those of a task that failed are in no index.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).select(
        "*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    copies = stored(rows.where(F.col("size") >= least).groupBy("digest", "size").agg(
        F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    known = rows.join(broadcast_if_small(copies), ["digest", "size"], "left").withColumn(
        "refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("target")), F.col("target"))).select(
        "page_id", "url", "html", "digest", "refers_to")
    folder = work_folder(spark, "warc")
    remove_at_exit(spark, folder)

    @lean
    def task(batches):
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        stream, file, at = None, None, 0
        try:
            for batch in batches:
                made = []
                for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    payload, kind = html.encode(), "response" if refers is None else "revisit"
                    data = record_bytes(page, url, payload, digest, kind, refers)
                    if stream is not None and at + len(data) > archive_bytes:
                        stream.close()
                        stream = None
                    if stream is None:
                        file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        stream = store.open_output_stream(f"{path}/{file}", compression=None)
                    stream.write(data)
                    made.append((page, url, digest, len(payload), kind, refers, file, at, len(data)))
                    at += len(data)
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*made), _KINDS.values())], names=list(_KINDS))
        finally:
            if stream is not None:
                stream.close()

    index = stored(known.mapInArrow(task, INDEX), "index")
    return index.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def _ranges(entries: list[tuple[str, int, int]], most: int, gap: int) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted entries (file, offset, length) in groups that one read each serves."""
    group: list[tuple[str, int, int]] = []
    for file, offset, length in entries:
        if group and (file != group[0][0] or offset - (group[-1][1] + group[-1][2]) > gap
                      or offset + length - group[0][1] > most):
            yield group
            group = []
        group.append((file, offset, length))
    if group:
        yield group


def read_records(chosen: DataFrame, range_bytes: int = RANGE_BYTES, gap: int = GAP_BYTES,
                 payloads: bool = True) -> DataFrame:
    """Records at the places of an index's rows (file, offset, length), in any selection.

    Places are sorted, and neighbours become one read of at most ``range_bytes``, or of one
    record if that is longer; unwanted bytes between two of them are read too if they are few.
    Payloads of revisits are null. ``payloads`` false leaves that column empty.
    """
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")

    @lean
    def task(batches):
        for batch in batches:
            entries = list(zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))))
            for group in _ranges(entries, range_bytes, gap):
                store, path = file_system(group[0][0])
                begin = group[0][1]
                with store.open_input_file(path) as source:
                    data = source.read_at(group[-1][1] + group[-1][2] - begin, begin)
                found = [parse_record(data[o - begin:o - begin + n]) for _, o, n in group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] if payloads or c != "payload" else None for r in found], k)
                     for c, k in zip(names, kinds)], names=list(names))

    places = chosen.select("file", "offset", "length", F.floor(F.col("offset") / range_bytes).alias("part"))
    return (places.repartition("file", "part").sortWithinPartitions("file", "offset").drop("part")
            .mapInArrow(task, RECORD))
