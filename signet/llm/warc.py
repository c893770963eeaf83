"""WARC archives: writing with revisits and segments, and reading back with segment reassembly.

Writing. Payload digests decide what is stored: of equal payloads the smallest page id is the response, the
others are revisit records that name it. Responses carry HTTP chunked transfer framing; blocks longer than
a segment go on in `continuation` records. Each record is a gzip member of its own. Tasks write files of their
own name into the shared folder and return them as rows; only files of rows that Spark committed are read, so
a task that was lost or ran twice leaves nothing in the result.

Reading. A record that is whole is decoded where it is read. Segments are grouped by the identifier of their
origin record, ordered by segment number, checked for gaps and against the total length that the last one
states, joined, and then the chunked framing is decoded and the payload's length and digest verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Table, table_path

SEGMENT, CHUNK = 32768, 8192
#: Bytes of an archive file after which the next one is begun.
ROLL = 64 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("5d3f8a52-0d0e-4c3a-9a55-7a1d1f5b6c01")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over. ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line has no end")
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter than it says")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def records(page_id, url: str, payload: bytes, first_page, first_url: str | None, name: str, segment: int = SEGMENT, single: bool = False):
    """The records of one page, in order. single: one row alone is its payload's response, so that revisits can name its
    record by page and digest (WARC-Refers-To); else they name its page and address only."""
    if single and first_page is None:
        name = f"{page_id}:{digest(payload)}"
    rid = record_id(name)
    own = [("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        own.append(("X-Page-Id", str(page_id)))
    if first_page is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *own, ("WARC-Profile", PROFILE), *([("WARC-Refers-To", record_id(f"{first_page}:{digest(payload)}"))] if single else []), ("WARC-Refers-To-Target-URI", first_url or ""), ("X-Refers-To-Page", str(first_page)), ("Content-Type", "application/http; msgtype=response")], HTTP.split(b"Transfer-")[0] + b"\r\n")
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *own, ("Content-Type", "application/http; msgtype=response")], block)
        return
    cuts = range(0, len(block), segment)
    for k, a in enumerate(cuts, 1):
        part = block[a : a + segment]
        if k == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *own, ("WARC-Segment-Number", "1"), ("Content-Type", "application/http; msgtype=response")], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(cuts) else []
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, f'{name}/{k}')}>"), ("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(k)), *last], part)


def _open(root: str):
    """File system and folder of a root as Spark names it; Hadoop's names of object stores are Arrow's without the letter."""
    from pyarrow import fs

    scheme, mark, rest = root.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + mark + rest)


def _writer(root: str, segment: int):
    def write(batches):
        files, base = _open(root)
        stream, temporary, final, n, size, done = None, "", "", 0, 0, []
        task = uuid.uuid4().hex

        def close():
            stream.close()
            files.move(temporary, final)
            done.append((final, n))

        index = 0
        for batch in W.pieces(batches, "html"):
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "first_page", "first_url", "single")]
            for page_id, url, html, first_page, first_url, single in zip(*columns, strict=True):
                if stream is None:
                    files.create_dir(base, recursive=True)
                    final = f"{base}/{task}-{len(done)}.warc.gz"
                    temporary, n, size = f"{final}.open", 0, 0
                    stream = files.open_output_stream(temporary, compression=None)
                for raw in records(page_id, url or "", (html or "").encode(), first_page, first_url, f"{task}:{index}", segment, bool(single)):
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    packed = z.compress(raw) + z.flush()
                    stream.write(packed)
                    n, size = n + 1, size + len(packed)
                index += 1
                if size >= ROLL:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return write


def write_warc(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT) -> tuple[DataFrame, str]:
    """Writes one page a row (payload: html in UTF-8, null: empty) and returns (path, records) of the files, and their root.

    Rows that repeat the smallest page id of a payload are all responses; a null id is a response only if its
    payload has no other id. A null url is written empty.
    """
    spark = pages.sparkSession
    root = root or table_path(spark, "warc")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("key", F.sha1(F.col("html").cast("binary")))
    # who answers for a digest that more than one row has; only pages and digests are exchanged for it, and the pages'
    # contents go by page and digest, so that a payload of many pages is no key of its own
    pages_of = base.groupBy("page_id", "key").agg(F.min("url").alias("url"), F.count("*").alias("rows"))
    known = pages_of.groupBy("key").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "rows"))).alias("f"), F.sum("rows").alias("n")).filter("n > 1")
    told = pages_of.select("page_id", "key").join(known.filter("f is not null"), "key")
    told = told.select(F.col("page_id").alias("of"), F.col("key").alias("of_key"), F.col("f.page_id").alias("p"), F.col("f.url").alias("u"), (F.col("f.rows") == 1).alias("one"))
    joined = base.join(told, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    again = F.col("p").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("p"))
    single = F.coalesce("one", F.col("page_id").isNotNull() & F.col("p").isNull())
    out = joined.select("page_id", "url", "html", F.when(again, F.col("p")).alias("first_page"), F.when(again, F.col("u")).alias("first_url"), single.alias("single"))
    return Table(out.mapInArrow(_writer(root, segment), "path string, records long"), "manifest").df, root


def parse(stream):
    """(fields, block) of each record of a gzip stream: members are inflated as they come."""
    z, held, left = zlib.decompressobj(31), bytearray(), b""
    end = False
    while True:
        at = held.find(b"\r\n\r\n")
        if at >= 0:
            lines = bytes(held[:at]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(fields["content-length"])
            if len(held) >= at + 4 + size + 4:
                yield fields, bytes(held[at + 4 : at + 4 + size])
                del held[: at + 4 + size + 4]
                continue
        if end:
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        data = left or stream.read(1 << 18)
        left = b""
        if not data:
            end = True
            continue
        if z.eof:
            z = zlib.decompressobj(31)
        held += z.decompress(data)
        left = z.unused_data


FOUND = "page_id long, record_type string, refers_to long, url string, want_bytes long, want_digest string, origin string, segment long, total long, block binary, payload_bytes long, payload_digest string, payload binary, error string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = [(a, _KINDS[b]) for a, b in (c.split() for c in FOUND.split(", "))]


def _number(fields: dict, key: str):
    return int(fields[key]) if key in fields else None


def decode(row: dict, block: bytes, payloads: bool) -> None:
    """Fills in what the payload of a whole block is, or why it can't be told."""
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        row["payload_bytes"], row["payload_digest"] = len(payload), digest(payload)
        if payloads:
            row["payload"] = payload
        if (row["payload_bytes"], row["payload_digest"]) != (row["want_bytes"], row["want_digest"]):
            row["error"] = "length or digest differs from the record's"
    except ValueError as e:
        row["error"] = str(e)


def _reader(root: str, payloads: bool):
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], kind) for k, kind in _FIELDS], [k for k, _ in _FIELDS])

    def read(batches):
        files, _ = _open(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for f, block in parse(stream):
                        kind = f["warc-type"]
                        row = {"record_type": kind, "page_id": _number(f, "x-page-id"), "url": f.get("warc-target-uri"), "refers_to": _number(f, "x-refers-to-page"), "want_bytes": _number(f, "x-payload-length"), "want_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "segment": _number(f, "warc-segment-number"), "total": _number(f, "warc-segment-total-length")}
                        if row["segment"] is not None:
                            row |= {"origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "block": block}
                            held += len(block)
                        elif kind == "revisit":
                            row |= {"payload_bytes": row["want_bytes"], "payload_digest": row["want_digest"]}
                        elif kind == "response":
                            decode(row, block, payloads)
                            held += len(block) if payloads else 0
                        else:
                            continue
                        rows.append(row)
                        if held > 4 << 20 or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def _assembler(payloads: bool):
    def join(batches):
        for batch in batches:
            rows = []
            for parts in batch.column(0).to_pylist():
                head = parts[0]
                row = {k: head[k] for k in ("page_id", "record_type", "refers_to", "url", "want_bytes", "want_digest", "origin")}
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                    row["error"] = "segments are missing or repeated"
                elif parts[-1]["total"] != len(block):
                    row["error"] = "segments do not make up the total length"
                else:
                    decode(row, block, payloads)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], kind) for k, kind in _FIELDS], [k for k, _ in _FIELDS])

    return join


def read_warc(spark: SparkSession, files: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """(page_id, record_type, refers_to, url, payload_bytes, payload_digest, payload, error) of the records in files(path).

    Revisits give the length and digest that they state and no payload. Where segments are missing, repeated or of
    another length than stated, or framing, length or digest do not hold, error says so and the rest is what is known.
    """
    found = Table(files.select("path").repartition(F.col("path")).mapInArrow(_reader(root, payloads), FOUND), "records").df
    # one group is one page's segments, as long as its payload
    parts = found.filter("segment is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "total", "block", "page_id", "record_type", "refers_to", "url", "want_bytes", "want_digest", "origin"))).alias("parts")).select("parts")
    whole = found.filter("segment is null").union(parts.mapInArrow(_assembler(payloads), FOUND))
    return whole.select("page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload", "error")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    files, root = write_warc(pages)
    return read_warc(spark, files, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op4_sql() -> str:
    """Independent SQL: base 32 by five-bit groups of the hexadecimal digest."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex,
  min(page_id) over (partition by sha1(html)) as first from p),
b as (select *, list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k:
    '{alphabet}'[((('0x' || hex[g * 5 + 1 : g * 5 + 5])::bigint >> (15 - 5 * k)) & 31) + 1]), 'string_agg', '')), 'string_agg', '') as payload_digest from d)
select page_id, payload_bytes, payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, null::varchar as error from b
"""
