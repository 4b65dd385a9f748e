"""WARC archives: written by Spark's text writer, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, shared_dir, stored

MAGIC = b"WARC/1.1\r\n"
#: Equal payloads from this size on are written once.
REVISIT_BYTES = 100
#: Archives roll over after so many records; payloads from SMALL bytes on get archives of their own; bytes of payloads that an archive may reach, but for one larger payload; repeated digests that are broadcast at most (some 100 bytes each).
ROLL, SMALL, ARCHIVE, REPEATED = 2_000, 64 << 10, 128 << 20, 500_000


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", roll: int = ROLL) -> None:
    """One record per row, gzipped archives of `roll` records and about ARCHIVE bytes at most under path, large payloads apart.

    Of equal payloads of REVISIT_BYTES or more the smallest id is a response, the rest are revisits of it without a
    payload. Rows that repeat an id repeat its record; null ids are written as empty and never referred to unless all
    ids of a payload are null; null urls and payloads count as empty."""
    p = only(pages, page_id=id, url=url, html=html)
    p = p.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html").cast("long")})
    # Digests alone travel. Those that repeat are counted and, up to REPEATED, broadcast, so that no payload moves.
    per = stored(p.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"), F.max("size").alias("size")), "digests")
    again = (F.col("n") > 1) & (F.col("size") >= REVISIT_BYTES)
    most, repeated = per.agg(F.max("size"), F.count_if(again)).first()
    first = per.where(again).select("digest", "first_id")
    p = p.join(F.broadcast(first) if repeated <= REPEATED else first, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size")),
        F.when(again, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.when(again, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"), body, F.lit("\r\n"),
    )
    # The writer's line end is the last of the two that close a record.
    out = lambda some, roll: some.write.option("maxRecordsPerFile", roll).option("lineSep", "\r\n").option("compression", "gzip")
    out(p.where(F.col("size") < SMALL).select(record.alias("value")), max(1, min(roll, ARCHIVE // SMALL))).text(f"{path}/small")
    if (most or 0) >= SMALL:
        out(p.where(F.col("size") >= SMALL).select(record.alias("value")), max(1, min(roll, ARCHIVE // most))).text(f"{path}/large")


_MAGIC, _END = re.compile(rb"WARC/1\.[01]\r\n"), re.compile(rb"\r\n\r\n")
_LENGTH = re.compile(rb"\n[Cc]ontent-[Ll]ength:[ \t]*([0-9]{1,18})[ \t]*(?=\r\n)")


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset, payload's offset and successor's offset of whatever looks like a record."""
    at = np.array([m.start() for m in _MAGIC.finditer(data)], np.int64)
    if not len(at):
        return at, at, at
    # A header runs to the first empty line behind its magic; magics without one between them share it.
    end = np.array([m.end() for m in _END.finditer(data)], np.int64)
    says = [(m.start(), int(m[1])) for m in _LENGTH.finditer(data)]
    place, length = np.array([x for x, _ in says], np.int64), np.array([n for _, n in says], np.int64)
    e, k = np.searchsorted(end, at + 4), np.searchsorted(place, at)
    ok = (e < len(end)) & (k < len(place))
    at, e, k = at[ok], e[ok], k[ok]
    ok = place[k] < end[e]
    at, body = at[ok], end[e[ok]]
    return at, body, body + length[k[ok]] + 4


def chain(at: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain of successors from the file's start reaches, by pointer jumping."""
    n = len(at)
    nxt = np.searchsorted(at, after)
    nxt = np.where((nxt < n) & (at[np.minimum(nxt, n - 1)] == after), nxt, n) if n else nxt
    nxt = np.append(nxt, n)
    seen = np.zeros(n + 1, bool)
    if n and at[0] == 0:
        seen[0] = True
        for _ in range(max(1, n.bit_length())):
            seen[nxt[np.flatnonzero(seen)]] = True
            nxt = nxt[nxt]
    return seen[:n]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id string, record_type, refers_to string, payload_digest, payload_bytes, uri, payload binary) of all
    records under path. A record counts if the chain from its archive's start reaches it: text within a payload that
    looks like one is passed over. An archive that breaks off yields the records before the break. A response whose
    payload has another digest than it says fails the read."""

    def run(batches):
        import gzip
        import hashlib

        for b in batches:
            for held in b.column(0):
                data = held.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                at, body, after = candidates(data)
                rows = []
                for k in np.flatnonzero(chain(at, after, len(data))):
                    if after[k] > len(data):
                        continue
                    head = dict(x.split(b": ", 1) for x in data[at[k] : body[k] - 4].split(b"\r\n")[1:])
                    payload = data[body[k] : after[k] - 4]
                    said = head[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
                    kind = head[b"WARC-Type"].decode()
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
                        raise ValueError(f"record at {at[k]}: its payload's digest is not {said}")
                    ids = [head[x][10:-1].decode() or None if x in head else None for x in (b"WARC-Record-ID", b"WARC-Refers-To")]
                    rows.append((ids[0], kind, ids[1], said, int(head[b"WARC-Payload-Length"]), head[b"WARC-Target-URI"].decode(), payload))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    schema = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("uri", pa.string()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,gz}").load(path)
    return files.select("content").mapInArrow(run, "page_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, uri string, payload binary")


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """pages written as archives in the shared folder and read back: the rows of read(), ids as pages has them.

    Null payloads and urls are empty ones, null ids stay null; rows that repeat an id stay rows of their own, and of equal
    payloads all rows of the smallest id are responses. An empty table gives an empty result. A payload is held whole
    by the task that reads it, with the rest of its archive."""
    path = f"{shared_dir(pages.sparkSession)}/gleaner/warc-{uuid.uuid4().hex}"
    write(pages, path, id, url, html)
    kind = pages.schema[id].dataType
    got = read(pages.sparkSession, path)
    return got.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
