"""WARC archives: a writer with revisit records and a reader that salvages what follows damage.

Archives are real files in the shared folder, one gzip member a record. The reader checks every record (compression
check sum, header, lengths, payload digest); after a failed check it searches for the next valid member or version
line, and what lies between two good records is reported as a quarantined byte gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.shared import shared_folder, split_join, stage

VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
HEAD = 1 << 16  # longest header of a record
LINE = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"(?i)\r\nContent-Length: *(\d{1,15})(?=\r\n|\Z)")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"  # fixed value of the format
RECORD = "path string, offset long, length long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str, size: int, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"urn:page:{'' if page_id is None else page_id}"
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "")))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str | None = None, smallest: int = 0, roll_bytes: int = 1 << 28, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns the list of files (path, bytes, records), itself stored.

    Of pages with equal payloads of at least ``smallest`` bytes, the one with the largest id becomes a response, the
    others revisit it; repeated rows of that id are all responses. Null html is an empty payload, null ids rank lowest
    and null urls are left out. A lost task writes new files under new names; only listed files count.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("hash", F.sha1("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long"))
    heads = stage(rows.groupBy("hash", "size").agg(F.max("page_id").alias("head"), F.sum(F.col("size") + HEAD // 256).alias("volume")))
    rows = split_join(rows, heads, ["hash", "size"], "volume", F.xxhash64("page_id", "url"))
    revisit = (F.col("size") >= smallest) & ~F.col("page_id").eqNullSafe(F.col("head"))
    rows = rows.select("page_id", "url", "hash", "size", "head", revisit.alias("revisit"), F.when(~revisit, F.col("payload")).alias("payload"))
    target = folder or shared_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(target)
        store.create_dir(base, recursive=True)
        out, path, size, n, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{target}/{path}", size, n))
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is None or size >= roll_bytes:
                    close()
                    path, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)  # members are compressed already
                digest = base64.b32encode(bytes.fromhex(r["hash"])).decode()
                data = packed(record(r["page_id"], r["url"], r["payload"] or b"", r["head"], r["revisit"], digest, r["size"], date))
                out.write(data)
                size, n = size + len(data), n + 1
        close()
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "bytes": pa.array([x[1] for x in done], pa.int64()), "records": pa.array([x[2] for x in done], pa.int64())})

    return stage(rows.mapInArrow(write, "path string, bytes long, records long"))


def parse(data: bytes) -> dict | None:
    """The record that ``data`` holds from its version line on, with its length; None if any check fails."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or end < 0:
        return None
    head = {}
    for line in data[:end].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isdigit() or len(data) < (stop := end + 4 + int(size)) + 4 or data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[end + 4 : stop]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get("warc-type")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and digest and digest != digest_of(payload):
        return None
    full = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", head.get(name, ""))) else None
    url = head.get("warc-target-uri")
    return {
        "length": stop + 4, "record_type": kind, "page_id": number("warc-record-id"), "url": None if url is None else unquote(url),
        "payload_bytes": len(payload) if kind == "response" else int(full[1]) if full else None,
        "payload_digest": digest or digest_of(payload), "refers_to": number("warc-refers-to"), "payload": payload,
    }


def salvage(source, begin: int, end: int, size: int, step: int = 1 << 22) -> Iterator[dict]:
    """Good records that start in ``begin`` to ``end`` of an open file of ``size`` bytes, whatever lies between them."""
    data, base, at = b"", begin, 0  # what is held of the file begins at its byte ``base``

    def more() -> bool:
        nonlocal data
        have = base + len(data)
        if have >= size:
            return False
        got = source.read_at(min(max(step, len(data) - at), size - have), have)
        data += got
        return bool(got)

    while base + at < end:
        if at >= step:  # only what lies behind the last good record is held
            data, base, at = data[at:], base + at, 0
        found = NEXT.search(data, at)
        if found is None:
            at = max(at, len(data) - len(VERSION))
            if base + len(data) >= end + len(VERSION) or not more():
                return
            continue
        at = found.start()
        if base + at >= end:
            return
        got = None
        if data.startswith(MEMBER, at):
            z, fed, text = zlib.decompressobj(31), at, []
            try:
                while not z.eof and (fed < len(data) or more()):
                    text.append(z.decompress(data[fed : fed + (1 << 16)]))
                    fed = min(len(data), fed + (1 << 16))
                text = b"".join(text)
                if z.eof and (got := parse(text)) is not None:
                    got = got | {"length": fed - len(z.unused_data) - at} if got["length"] == len(text) else None
            except zlib.error:
                got = None
        else:
            while (stop := data.find(b"\r\n\r\n", at, at + HEAD)) < 0 and len(data) < at + HEAD and more():
                pass
            size_line = LENGTH.search(data, at, stop) if stop >= 0 and LINE.match(data, at) else None
            if size_line:
                whole = stop + 4 + int(size_line[1]) + 4
                while len(data) < whole and more():
                    pass
                got = parse(data[at:whole])
        if got is None:
            at += 1
            continue
        yield got | {"offset": base + at}
        at += got["length"]


def read_archives(files: DataFrame, split_bytes: int = 1 << 25, payloads: bool = False) -> tuple[DataFrame, DataFrame]:
    """The records of ``files`` (path, bytes), and the quarantined gaps (path, offset, length) between them.

    Compressed files are read in splits, each from the first valid member in it; plain ones, whose payloads may hold
    version lines, from their start. An empty list gives no rows.
    """
    gz = F.col("path").endswith(".gz")
    step = F.when(gz, F.lit(split_bytes)).otherwise(F.greatest("bytes", F.lit(1)))
    splits = files.where("bytes > 0").select("path", "bytes", step.alias("step"))
    splits = splits.select("path", "bytes", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.col("step"))).alias("begin"))
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        form = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        for batch in batches:
            for s in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(s["path"])
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for r in salvage(source, s["begin"], min(s["begin"] + s["step"], s["bytes"]), s["bytes"]):
                        rows.append({k: (r | {"path": s["path"]})[k] for k in names})
                        held += len(r["payload"]) if payloads else 0
                        if len(rows) >= 10_000 or held >= 1 << 25:
                            yield pa.RecordBatch.from_pylist(rows, form)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, form)

    parts = files.sparkSession.conf.get("spark.sql.shuffle.partitions")
    found = splits.repartition(int(parts), "path", "begin").mapInArrow(read, schema)
    past = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("offset") + F.col("length")
    spans = found.select("path", "offset", "length").withColumn("from", F.coalesce(F.max(stop).over(past), F.lit(0).cast("long")))
    inner = spans.where("offset > `from`").select("path", F.col("from").alias("offset"), (F.col("offset") - F.col("from")).alias("length"))
    ends = found.groupBy("path").agg(F.max(stop).alias("to"))
    last = files.join(ends, "path", "left").withColumn("to", F.coalesce("to", F.lit(0).cast("long"))).where("bytes > `to`")
    return found, inner.unionByName(last.select("path", F.col("to").alias("offset"), (F.col("bytes") - F.col("to")).alias("length")))
