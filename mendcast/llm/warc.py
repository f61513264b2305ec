"""WARC archives: written as one gzip stream, normalised to a member per record with a sidecar index, and read back.

A file that was compressed as a whole can only be read from its start. The normaliser inflates such a stream once, in
pieces, and rewrites every record as a gzip member of its own; next to the archive it writes a sidecar with offset and length
of each member, so a reader fetches any record by itself: reading back starts from the sidecars alone. Memory holds one piece of the
stream and one record.

Of records with equal payloads the one with the largest id is the response, the others are revisits that carry headers only.
Defined results: ids may be of any ordered type; a null payload is empty; rows that repeat the largest id of their payload are all responses; null ids sort
below all others; an empty table writes no archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mendcast.layout import materialise, new_table_path
from mendcast.llm.common import shared_files, text_or_empty

CRLF = b"\r\n"
ARCHIVE_BYTES = 1 << 28
PIECE = 1 << 20
READ_BYTES = 1 << 24
RESULT = "_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(key: str | None) -> str:
    return "<urn:page>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def record_key(name: str | None) -> str | None:
    """The id in a record's name; a missing name and a missing id are both None."""
    return unquote(name[len("<urn:page:"): -1]) if name and name != "<urn:page>" else None


def record_bytes(key: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the full length and drops the payload."""
    revisit = refers_to is not None
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    uri = "".join(c for c in url or "" if c >= " ")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(key)}",
        f"WARC-Target-URI: {uri}", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Refers-To: {record_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8") + CRLF + CRLF + block + CRLF + CRLF


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, url_col: str, least_bytes: int) -> DataFrame:
    """(``_id``, ``_url``, ``_payload``, ``_refers``): ids of the response that a revisit points to."""
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), text_or_empty(payload_col).alias("_payload")
    ).withColumn("_sha", F.sha1("_payload"))
    shared = (
        rows.where(F.octet_length("_payload") >= least_bytes).groupBy("_sha")
        .agg(F.max("_id").alias("_largest"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    )
    other = F.col("_largest").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_largest"))
    refers = F.when(other, F.col("_largest")).cast("string")
    return rows.join(shared, "_sha", "left").select(F.col("_id").cast("string"), "_url", "_payload", refers.alias("_refers"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """One gzip stream per archive; returns the stored list of archives that finished tasks wrote."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = shared_files(folder)
        out, pack, size = None, None, 0
        for batch in batches:
            for key, url, payload, refers in zip(batch["_id"], batch["_url"], batch["_payload"], batch["_refers"]):
                if out is None:
                    name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out, pack = files.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, wbits=31)
                data = record_bytes(key, url, payload.encode("utf-8"), refers)
                out.write(pack.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(pack.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"file": [name]})
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pd.DataFrame({"file": [name]})

    files, root = shared_files(folder)
    files.create_dir(root, recursive=True)
    return materialise(rows.mapInPandas(write, "file string"))


def inflated(stream) -> Iterator[bytes]:
    """Pieces of a gzip stream of one or several members."""
    unpack, data = zlib.decompressobj(wbits=31), b""
    while data or (data := stream.read(PIECE)):
        piece = unpack.decompress(data, PIECE)
        if piece:
            yield piece
        data = unpack.unconsumed_tail
        if unpack.eof:
            data, unpack = unpack.unused_data, zlib.decompressobj(wbits=31)


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, cut by their own lengths."""
    held = bytearray()
    ended = False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            piece = next(pieces, None)
            ended = piece is None
            held.extend(piece or b"")
        return len(held) >= n

    while fill(1):
        seen = 0
        while (cut := held.find(CRLF + CRLF, max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("an archive ends inside a record's header")
        length = cut + 4 + int(headers(bytes(held[:cut]))["content-length"]) + 4
        if not fill(length):
            raise ValueError("an archive ends inside a record")
        yield bytes(held[:length])
        del held[:length]


def normalise_archives(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites archives with a gzip member per record and a sidecar; returns the stored list of new files."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = shared_files(source)
        _, out_root = shared_files(target)
        for batch in batches:
            for name in batch["file"]:
                new = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex}.warc.gz"
                rows, offset = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as f, \
                        files.open_output_stream(f"{out_root}/{new}", compression=None) as out:
                    for record in records(inflated(f)):
                        pack = zlib.compressobj(6, wbits=31)
                        member = pack.compress(record) + pack.flush()
                        out.write(member)
                        rows.append((offset, len(member)))
                        offset += len(member)
                with files.open_output_stream(f"{out_root}/{new}.idx", compression=None) as side:
                    side.write("".join(json.dumps({"offset": o, "length": n}) + "\n" for o, n in rows).encode())
                yield pd.DataFrame({"file": [new]})

    files, root = shared_files(target)
    files.create_dir(root, recursive=True)
    # a number is given because the list of names is far too small for Spark to see the work behind it
    spread = archives.repartition(max(1, archives.count()))
    return materialise(spread.mapInPandas(rewrite, "file string"))


def read_sidecars(archives: DataFrame, folder: str) -> DataFrame:
    """Stored: ``file, offset, length`` of every record, from the sidecars next to the archives."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = shared_files(folder)
        for batch in batches:
            for name in batch["file"]:
                with files.open_input_stream(f"{root}/{name}.idx", compression=None) as side:
                    entries = [json.loads(line) for line in side.read().decode().splitlines()]
                yield pd.DataFrame({"file": [name] * len(entries), "offset": [e["offset"] for e in entries], "length": [e["length"] for e in entries]})

    return materialise(archives.mapInPandas(read, "file string, offset long, length long"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Every record by its index entry: id, full payload size and digest, type and the response that it refers to; ids as text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = shared_files(folder)
        columns = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            rows = []
            for name, part in batch.groupby("file", sort=False):
                with files.open_input_file(f"{root}/{name}") as f:
                    for offset, length in zip(part["offset"], part["length"]):
                        record = zlib.decompress(f.read_at(int(length), int(offset)), wbits=31)
                        cut = record.index(CRLF + CRLF)
                        head = headers(record[:cut])
                        block = record[cut + 4: cut + 4 + int(head["content-length"])]
                        body = block.index(CRLF + CRLF)
                        digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(headers(block[:body])["content-length"])
                        payload = block[body + 4:]
                        if head["warc-type"] == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
                            raise ValueError(f"payload of {head['warc-record-id']} differs from its header")
                        rows.append((record_key(head["warc-record-id"]), size, digest, head["warc-type"], record_key(head.get("warc-refers-to"))))
            yield pd.DataFrame(rows, columns=columns)

    parts = 1 + (index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES
    spread = index.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInPandas(read, RESULT)


def archive_round_trip(
    pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url"
) -> DataFrame:
    """Writes all pages, normalises the archives, and reads every record back through their sidecars."""
    folder = new_table_path(pages.sparkSession)
    rows = with_revisits(pages, id_col, payload_col, url_col, least_bytes)
    archives = write_archives(rows, f"{folder}/stream")
    normal = normalise_archives(archives, f"{folder}/stream", f"{folder}/members")
    found = read_records(read_sidecars(normal, f"{folder}/members"), f"{folder}/members")
    kind = dict(pages.dtypes)[id_col]
    return found.select(
        F.col("_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
