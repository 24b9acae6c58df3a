"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames. A bundle is a run of frames, then a skippable
frame with the bundle's record index, then the seek table (a skippable frame whose footer
ends the file). The record index maps each record identifier to its frame and the offset
in the frame; it is written while the records are bundled, and all reading goes through
it. A table of all bundles' indexes is stored beside them (``_index``), so that a record
is found without opening other bundles and read by the bytes of its frame alone.

Bundles are written by Spark's own text sink, one row a file, so they reach any file
system that Spark reaches: a row is the bundle without its last five bytes, which are the
same in all bundles and serve as the sink's line separator.

Of pages with one payload of ``least_revisit`` bytes or more, those with the smallest id
are responses and the others revisit it. A null id stands after all others and is written
without a page id; pages without an id whose payload no page with an id holds are all
responses. One row is one record, also where an id is repeated, with one payload or with
several. A record's identifier is drawn from page id, url, payload and its place among the
rows that have these in common, so each record has one of its own.

Other defined cases: null html is an empty payload; a null url leaves the target out; line
breaks and control characters in a url are percent-encoded; an empty table makes an
archive without bundles; a payload longer than a frame or a bundle gets one of its own;
further columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import urllib.parse
import uuid
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch, placed_among_equals

SKIPPABLE = 0x184D2A5E
#: Seek table descriptor (no checksums) and the format's closing number: the end of every bundle.
ENDING = b"\x00" + struct.pack("<I", 0x8F92EAB1)
#: Fixed, so that reruns give the same bytes.
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Layout:
    frame_bytes: int = 256 << 10
    bundle_bytes: int = 8 << 20
    level: int = 3
    #: payloads at least so long may be replaced by a revisit
    least_revisit: int = 100


def record_urn(page_id: int | None, url: str | None, digest: str, place: int = 0) -> str:
    """The identifier of a record. Rows that have page id, url and payload in common are
    told apart by their places among each other."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([page_id, url, digest, place]))}>"


def encode_record(urn: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """``refers_to`` and ``refers_url`` are those of the response that a revisit repeats."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to, refers_url, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """(headers, HTTP head, payload, end) of the record at an offset in a frame."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at offset {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    cut = data.index(b"\r\n\r\n", start, stop) + 4
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at offset {at} isn't closed")
    return headers, data[start:cut], data[cut:stop], stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<I", len(sizes)) + ENDING
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the footer's seek table. The
    last one is the record index, which decompresses to nothing."""
    if bundle[-5:] != ENDING:
        raise ValueError("no seek table")
    (n,) = struct.unpack("<I", bundle[-9:-5])
    table = bundle[-9 - 8 * n : -9]
    found, start = [], 0
    for packed, plain in struct.iter_unpack("<II", table):
        found.append((start, packed, plain))
        start += packed
    return found


#: Of an index entry: the identifier's 16 bytes, whether there is a page id, the page id, frame, offset.
ENTRY = struct.Struct("<16s?qII")


def entries_of(bundle: bytes, frames: list[tuple[int, int, int]]) -> list[tuple[str, int | None, int, int]]:
    """(identifier, page_id, frame, offset) of each record, from the bundle's index."""
    start, packed, _ = frames[-1]
    body = zstandard.ZstdDecompressor().decompress(bundle[start + 8 : start + packed])
    return [(f"<urn:uuid:{uuid.UUID(bytes=urn)}>", page if has else None, frame, at) for urn, has, page, frame, at in ENTRY.iter_unpack(body)]


class Bundler:
    def __init__(self, layout: Layout):
        self.layout = layout
        self.packer = zstandard.ZstdCompressor(level=layout.level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[bytes] = []
        self.open: list[bytes] = []
        self.waiting = self.packed = 0

    def add(self, page_id: int | None, urn: str, record: bytes) -> bytes | None:
        """A full bundle, whenever one is complete."""
        out = None
        if self.waiting and self.waiting + len(record) > self.layout.frame_bytes:
            self._frame()
            if self.packed >= self.layout.bundle_bytes:
                out = self.close()
        self.entries.append(ENTRY.pack(uuid.UUID(urn[10:-1]).bytes, page_id is not None, page_id or 0, len(self.frames), self.waiting))
        self.open.append(record)
        self.waiting += len(record)
        return out

    def _frame(self) -> None:
        plain = b"".join(self.open)
        packed = self.packer.compress(plain)
        self.frames.append(packed)
        self.sizes.append((len(packed), len(plain)))
        self.packed += len(packed)
        self.open, self.waiting = [], 0

    def close(self) -> bytes | None:
        if self.open:
            self._frame()
        if not self.frames:
            return None
        index = self.packer.compress(b"".join(self.entries))
        index = struct.pack("<II", SKIPPABLE, len(index)) + index
        out = b"".join(self.frames) + index + seek_table([*self.sizes, (len(index), 0)])
        self.frames, self.sizes, self.entries, self.packed = [], [], [], 0
        return out


def revisits(pages: DataFrame, layout: Layout) -> DataFrame:
    """(page_id, digest, refers_to, refers_url), once each, of the pages whose payload a
    page with a smaller id holds; of that page's rows with the payload, the one meant has
    the smallest url, nulls last."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    light = pages.where(F.octet_length(payload) >= layout.least_revisit).select("page_id", "url", F.sha2(payload, 256).alias("digest"))
    light = light.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    order = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = light.groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("n")).where("n > 1 AND first IS NOT NULL")
    first = first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    return light.select("digest", "page_id").join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to", "refers_url")


def write_archive(pages: DataFrame, path: str, layout: Layout = Layout()) -> None:
    """Writes pages (page_id, url, html) as bundles and their index below ``path``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "revisits")
    later = scratch.save(revisits(pages, layout), "later").withColumnRenamed("page_id", "_page").withColumnRenamed("digest", "_digest")
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("digest"))
    rows = placed_among_equals(scratch, rows, ["page_id", "url", "digest"], "place", "repeats")
    # a page and payload stand in ``later`` once at most, so every row stays one row
    rows = rows.join(later, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "place", "refers_to", "refers_url")

    def bundles(batches):
        made = Bundler(layout)
        for batch in batches:
            for page, url, html, digest, place, refers, refers_url in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "place", "refers_to", "refers_url")), strict=True):
                payload = b"" if html is None else html.encode()
                page = None if pd.isna(page) else int(page)
                urn = record_urn(page, url, digest, int(place))
                record = encode_record(urn, page, url, payload, digest, None if pd.isna(refers) else int(refers), refers_url)
                if full := made.add(page, urn, record):
                    yield pd.DataFrame({"bundle": [full[: -len(ENDING)]]})
        if rest := made.close():
            yield pd.DataFrame({"bundle": [rest[: -len(ENDING)]]})

    # page ids as text: a column of whole numbers with nulls would reach pandas as floats
    made = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(bundles, "bundle binary")
    made.select(F.col("bundle").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", ENDING.decode("latin-1")).text(path)
    scratch.drop("later", "repeats")
    _index_of(spark, path).write.parquet(f"{path}/_index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")


INDEX = "record_id string, page_id long, bundle string, frame int, start long, packed long, plain long, offset long"


def _index_of(spark: SparkSession, path: str) -> DataFrame:
    """The record indexes of all bundles; no record is decompressed."""

    def rows(batches):
        for batch in batches:
            for name, bundle in zip(batch["path"], batch["content"], strict=True):
                frames = frames_of(bundle)
                out = [(urn, page, name, k, *frames[k], at) for urn, page, k, at in entries_of(bundle, frames)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64"})

    return _files(spark, path).mapInPandas(rows, INDEX)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, bundle, frame, start, packed, plain, offset): where each record
    starts, and the bytes of its frame in the bundle."""
    return spark.read.schema(INDEX).parquet(f"{path}/_index")


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _parsed(data: bytes, at: int, payloads: bool) -> tuple:
    headers, http, payload, _ = decode_record(data, at)
    again = headers["WARC-Type"] == "revisit"
    stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if not again and hashlib.sha256(payload).hexdigest() != stated:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    return page and int(page), headers.get("WARC-Target-URI"), payload if payloads and not again else None, size, stated, headers["WARC-Type"], refers and int(refers)


def _table(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records, each found by its bundle's index; the digest of every payload read is
    computed anew and compared."""

    def rows(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle in batch["content"]:
                frames = frames_of(bundle)
                held, out, data = -1, [], b""
                for _, _, k, at in entries_of(bundle, frames):
                    if k != held:
                        if out:
                            yield _table(out)
                        start, packed, plain = frames[k]
                        held, out, data = k, [], unpacker.decompress(bundle[start : start + packed], max_output_size=plain)
                    out.append(_parsed(data, at, payloads))
                if out:
                    yield _table(out)

    return _files(spark, path).mapInPandas(rows, RECORD)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records of index rows ``wanted``, in the columns of ``read_archive``.

    Of a bundle only the frames that hold wanted records are read, by byte range, where
    the executors can open the file themselves; else Spark reads the bundles that hold
    wanted records, and only these frames are decompressed."""
    frames = wanted.groupBy("bundle", "frame", "start", "packed", "plain").agg(F.collect_list("offset").alias("offsets"))
    try:
        pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        ranged = True
    except (ValueError, OSError):
        ranged = False

    def by_range(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, some in batch.groupby("bundle"):
                files, place = pyarrow.fs.FileSystem.from_uri("file://" + name.removeprefix("file:").removeprefix("//") if name.startswith("file:") else name)
                with files.open_input_file(place) as file:
                    for r in some.itertuples():
                        data = unpacker.decompress(file.read_at(r.packed, r.start), max_output_size=r.plain)
                        yield _table([_parsed(data, at, True) for at in r.offsets])

    def by_bundle(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, places in zip(batch["content"], batch["places"], strict=True):
                for r in places:
                    data = unpacker.decompress(bundle[r["start"] : r["start"] + r["packed"]], max_output_size=r["plain"])
                    yield _table([_parsed(data, at, True) for at in r["offsets"]])

    if ranged:
        return frames.mapInPandas(by_range, RECORD)
    places = frames.groupBy(F.col("bundle").alias("path")).agg(F.collect_list(F.struct("start", "packed", "plain", "offsets")).alias("places"))
    return _files(spark, path).join(places, "path").mapInPandas(by_bundle, RECORD)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("archive"))
    back = read_archive(spark, scratch.path("archive"), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""
