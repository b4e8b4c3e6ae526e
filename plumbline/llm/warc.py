"""WARC archives written index first, and read back by coalesced byte ranges.

Of records with equal payloads of ``least`` bytes or more, the one with the
largest id is a response and the others are revisits of it; smaller ones are
all responses. Rows that share both the largest id and the payload are all
responses. Null and empty payloads are responses without bytes; very long ones
are records of their own reads. A null id is no largest one. Repeated rows are
written each; ids may have any type that has an order; other columns, of any
name, are not carried; an empty table gives an empty index.

Which rows are revisits is found without their payloads, so one payload that
very many rows share is no heavy key; payloads meet these rows by id and digest.

Records are gzip members, so that any of them can be read alone. While they
are written, the index gets a row for each: file, offset, length, URL, digest,
id. Reading starts from rows of the index: they are sorted by file and offset,
neighbouring ranges are joined into one read, and records are cut from it. A
file's name is unique to the attempt that wrote it and counts only once the
index has it, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm import scratch

LEAST = 1000  # bytes from which equal payloads are written once
FILE_BYTES = 256 << 20  # of payload; a task starts another file beyond it
SPAN, GAP = 16 << 20, 64 << 10  # bytes of one read at most (or one record), and of a gap that is read over
INDEX = "file string, offset long, length long, url string, digest string, id {0}, record_type string, refers_to {0}"
DATE = "1970-01-01T00:00:00Z"  # the same input gives the same archive


def planned(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, url, payload, size, digest, refers_to): responses with their payload,
    revisits without it and with refers_to."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.length("payload")})
    large = rows.where(F.col("size") >= least).select("id", "url", "size", "digest")
    first = large.groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper")
    revisits = scratch.staged(large.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("keeper"))), "revisits")
    again = revisits.select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    responses = rows.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_anti")
    kind = rows.schema["id"].dataType
    none = responses.select("id", "url", "payload", "size", "digest", F.lit(None).cast(kind).alias("refers_to"))
    return none.unionByName(revisits.select("id", "url", F.lit(None).cast("binary").alias("payload"), "size", "digest", F.col("keeper").alias("refers_to")))


def urn(page) -> str:
    return "<urn:plumbline:no-page>" if page is None else f"<urn:plumbline:page:{quote(str(page), safe='')}>"


def page_of(name: str | None) -> str | None:
    return unquote(name[len("<urn:plumbline:page:") : -1]) if name and ":page:" in name else None


def record(kind: str, url: str, page, digest: str, refers_to, payload: bytes | None, size: int) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head[2:2] = [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """One record's fields, payload (empty for revisits) and payload length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length"))
    return {"id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"][5:], "refers_to": page_of(fields.get("WARC-Refers-To")), "payload": payload, "payload_bytes": size}


def clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " ")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes the archives and returns their index."""
    folder, kind_of = scratch.new_path(pages.sparkSession, "warc"), pages.schema[id_col].dataType

    def save(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at, held = None, "", 0, 0
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if out is None or held >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    fs.create_dir(base, recursive=True)
                    name, at, held = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                kind = "response" if row["refers_to"] is None else "revisit"
                url = clean(row["url"])
                data = gzip.compress(record(kind, url, row["id"], row["digest"], row["refers_to"], row["payload"], row["size"]), 1, mtime=0)
                out.write(data)
                index.append((name, at, len(data), url, row["digest"], row["id"], kind, row["refers_to"]))
                at, held = at + len(data), held + len(row["payload"] or b"")
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), to_arrow_type(kind_of), pa.string(), to_arrow_type(kind_of)))], [f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return scratch.staged(planned(pages, id_col, url_col, payload_col, least).mapInArrow(save, INDEX.format(kind_of.simpleString())), "warc-index")


def spans_of(rows: list[dict]) -> list[list[dict]]:
    """Rows sorted by file and offset, cut into those that one read serves."""
    out: list[list[dict]] = []
    for r in rows:
        last = out[-1] if out else None
        if last and last[0]["file"] == r["file"] and r["offset"] - (last[-1]["offset"] + last[-1]["length"]) <= GAP and r["offset"] + r["length"] - last[0]["offset"] <= SPAN:
            last.append(r)
        else:
            out.append([r])
    return out


def read(selected: DataFrame) -> DataFrame:
    """(id, url, record_type, refers_to, digest, payload, payload_bytes) of the
    selected rows of an index; digests of responses are checked."""
    spark = selected.sparkSession
    root = scratch.shared_dir(spark)
    kinds = {"id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "digest": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64()}

    def load(batches):
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for span in spans_of(batch.to_pylist()):
                first = span[0]["offset"]
                with fs.open_input_file(span[0]["file"]) as file:
                    data = file.read_at(span[-1]["offset"] + span[-1]["length"] - first, first)
                rows, held = [], 0
                for r in span:
                    got = parse(zlib.decompress(data[r["offset"] - first : r["offset"] - first + r["length"]], 31))
                    if got["record_type"] == "response" and (hashlib.sha1(got["payload"]).hexdigest() != got["digest"] or len(got["payload"]) != got["payload_bytes"]):
                        raise ValueError(f"damaged record at {r['offset']} of {r['file']}")
                    rows.append(got)
                    held += len(got["payload"])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    ranges = selected.select("file", "offset", "length").repartition(scratch.buckets_for(spark, 0), "file", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("file", "offset")
    kind = selected.schema["id"].dataType
    rows = ranges.mapInArrow(load, "id string, url string, record_type string, refers_to string, digest string, payload binary, payload_bytes long")
    return rows.withColumns({"id": F.col("id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
