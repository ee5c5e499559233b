"""WARC archives: written with an index of byte ranges, read back by coalesced ranges.

Digests and record types are decided first, on narrow rows: of equal payloads the one with the smallest id is the response and
the others revisit it. Each task then writes archives of its own under fresh names and returns an index row for each
record: archive, offset, length, URL, digest. Only rows of tasks that were committed enter the index, so archives
that a lost or repeated task left are never read. Reading sorts the selected index rows by archive and offset, joins
neighbouring ranges into one read, parses the records and checks the digest of each payload.

Defined cases: a null payload is an empty one; a null URL is written as the record's id; a row without an id is a response
only where no row with an id has its payload; rows that repeat the smallest id are responses each; record ids of rows that repeat
a page id, or have none, get a fragment of their own; a payload of any length stands whole in the memory of the task
that writes or reads it; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, sifted, staged, table, whole_text, work_path

#: Records with payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Bytes after which a task begins another archive; that one task reads; of one read; between ranges joined in one read.
ARCHIVE, SPAN, READ, GAP = 1 << 29, 32 << 20, 8 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, type string, refers_to long, path string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(hexadecimal: str) -> str:
    import base64

    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _uri(folder: str) -> str:
    """The folder as pyarrow names it: Spark's s3a is its s3."""
    return "s3" + folder[3:] if folder[:6] in ("s3a://", "s3n://") else folder


def _urn(page_id: int | None, copy: int | None = None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}{'' if copy is None else f'#{copy}'}>"


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2].partition("#")[0]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, copy: int | None = None, date: str = DATE) -> bytes:
    """One record; a revisit keeps the response's header, not its payload. copy tells rows of one page id apart."""
    from urllib.parse import quote

    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    target = _urn(page_id, copy).strip("<>") if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, copy)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record starts here: {first[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [line.split(b": ")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: ")]
    return fields | {"payload": payload, "payload_bytes": int(sizes[0])}


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, sha1, type, refers_to, copy) per row of pages (page_id, url, html).

    Payloads that stand once pass the sieve's complement: they meet no join, so no shuffle carries them.
    """
    payload = F.encode(whole_text("html"), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    narrow = staged(rows.select("page_id", "sha1"), "digests")
    firsts = narrow.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    firsts = staged(firsts.select("sha1", "first"), "firsts")
    repeats = staged(narrow.groupBy("page_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR page_id IS NULL").select(F.col("page_id").alias("again")), "repeats")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("n") >= least_bytes)
    several, single = sifted(rows, "sha1", firsts.select("sha1"))
    found = several.join(firsts, "sha1", "left").select("page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("first")).alias("refers_to"))
    found = found.unionByName(single.select("page_id", "url", "payload", "sha1", F.lit("response").alias("type"), F.lit(None).cast("long").alias("refers_to")))
    if repeats.isEmpty():
        return found.withColumn("copy", F.lit(None).cast("long"))
    some, own = sifted(found, "page_id", repeats)
    some = some.join(repeats.withColumn("met", F.lit(True)), F.col("page_id").eqNullSafe(F.col("again")), "left")
    some = some.withColumn("copy", F.when(F.col("met"), F.monotonically_increasing_id())).drop("again", "met")
    return some.unionByName(own.withColumn("copy", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the pages into archives in folder, a path that all executors share; returns the index, which stands in the shared folder."""

    def write(batches: Iterator) -> Iterator:
        import uuid

        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(folder))
        store.create_dir(root, recursive=True)
        out = None
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is None or out.tell() >= ARCHIVE:
                        if out is not None:
                            out.close()
                        path = f"{root}/{uuid.uuid4().hex}.warc"
                        out = store.open_output_stream(path)
                    digest, at = base32_sha1(row["sha1"]), out.tell()
                    out.write(record(row["page_id"], row["url"], row["payload"], digest, row["type"], row["refers_to"], row["copy"]))
                    index.append((row["page_id"], row["url"], digest, row["type"], row["refers_to"], path, at, out.tell() - at))
                if index:
                    from pyarrow import RecordBatch

                    frame = pd.DataFrame(index, columns=[f.split()[0] for f in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
                    yield RecordBatch.from_pandas(frame, schema=_arrow(INDEX), preserve_index=False)
        finally:
            if out is not None:
                out.close()

    return staged(plan_records(pages, least_bytes).mapInArrow(write, INDEX), "index")


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that the rows of index select; raises if a payload doesn't have its digest."""

    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(_uri(folder))
        for batch in batches:
            rows, start = batch.to_pylist(), 0
            while start < len(rows):
                first, end = rows[start], start + 1
                upto = first["offset"] + first["length"]
                while end < len(rows) and rows[end]["path"] == first["path"] and 0 <= rows[end]["offset"] - upto <= GAP and rows[end]["offset"] + rows[end]["length"] - first["offset"] <= READ:
                    upto, end = rows[end]["offset"] + rows[end]["length"], end + 1
                with store.open_input_file(first["path"]) as file:
                    data = file.read_at(upto - first["offset"], first["offset"])
                out = []
                for row in rows[start:end]:
                    at = row["offset"] - first["offset"]
                    r = parse(data[at : at + row["length"]])
                    digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                    if r["WARC-Type"] == "response" and (len(r["payload"]) != r["payload_bytes"] or base32_sha1(hashlib.sha1(r["payload"]).hexdigest()) != digest):
                        raise ValueError(f"{row['path']} at {row['offset']}: the payload doesn't have its digest")
                    refers = r.get("WARC-Refers-To")
                    out.append({"page_id": _page(r["WARC-Record-ID"]), "url": row["url"], "payload_bytes": r["payload_bytes"], "payload_digest": digest, "record_type": r["WARC-Type"], "refers_to": _page(refers) if refers else None, "payload": r["payload"] if with_payload else None})
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(RECORD))
                start = end

    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // SPAN), spark.sparkContext.defaultParallelism)
    # ranges dealt to so many tasks by number: adaptive execution would join them by the bytes of the index, not of the archives
    dealt = index.select("path", "offset", "length", "url").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    found = dealt.mapInArrow(read, RECORD)
    return found if with_payload else found.drop("payload")


def remove_archives(spark, folder: str) -> None:
    """Remove the archives of a folder, once what was read of them is written elsewhere."""
    removed(spark, folder)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "archives")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).drop("url")


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((('0x' || substr(sha1(p.html), CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""
