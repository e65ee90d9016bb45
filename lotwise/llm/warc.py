"""WARC archives in Zstandard frames: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, plain or compressed itself; then each record is one Zstandard frame
made with that dictionary.  The reader loads the dictionary, decodes frame by
frame, and validates each record: version line, required headers, block length
against Content-Length, the closing empty lines, payload length and digest.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the
largest id becomes a response, the others become revisit records that refer to it
and hold the HTTP header only.  Equal payloads are found by SHA-256 and length.

Archives are written by the tasks to the shared folder under a temporary name
and then renamed.  Names follow from the partition and rows are sorted in it, so a
task that runs again replaces its files by equal ones.  An archive is closed at
``ARCHIVE_BYTES``.

Defined results: a null html is an empty payload; rows that repeat the largest id
of a group are responses all; null ids are the smallest (a group of null ids only
has responses only); a null url has no target header; an empty table writes no
archive and reads as an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import hash_sample, slices, small_batches, stage_dir, stored, table, text_of

DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
MIN_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
DICT_BYTES = 64 << 10
#: The dictionary is trained on a bounded sample: so many pages, so many letters of each.
DICT_PAGES, DICT_CHARS = 200, 8192
DATE = "1970-01-01T00:00:00Z"
ID_URN = "urn:lotwise:page:"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


# --- one record ---------------------------------------------------------------

def _urn(page_id: str | None) -> str:
    return f"<{ID_URN}{quote(page_id, safe='') if page_id is not None else '~'}>"


def _page_id(urn: str) -> str | None:
    name = urn[len(ID_URN) + 1:-1]
    return None if name == "~" else unquote(name)


def http_header(payload_bytes: int) -> bytes:
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {payload_bytes}\r\n\r\n").encode()


def record_bytes(page_id: str | None, url: str | None, payload: bytes | None, payload_bytes: int, sha1_hex: str,
                 refers_to: str | None, revisit: bool) -> bytes:
    """A response record, or a revisit record (payload None)."""
    block = http_header(payload_bytes) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: quote(m.group()), url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a validated record; ValueError says what is wrong."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of the header")
    lines = data[:end].decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"version line {lines[0][:40]!r}")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header line {line[:40]!r}")
        head[name.strip()] = value.strip()
    if missing := [h for h in REQUIRED if h not in head]:
        raise ValueError(f"without {', '.join(missing)}")
    kind, length = head["WARC-Type"], int(head["Content-Length"])
    block = data[end + 4:end + 4 + length]
    if len(block) != length or data[end + 4 + length:] != b"\r\n\r\n":
        raise ValueError(f"a block of another length than {length}")
    http, blank, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length: *([0-9]+)\r?$", http)
    if not blank or not stated:
        raise ValueError("no HTTP header with a length")
    algorithm, _, digest = head["WARC-Payload-Digest"].partition(":")
    sha1 = base64.b32decode(digest).hex()
    size = int(stated[1])
    if kind == "response":
        if len(payload) != size or algorithm != "sha1" or hashlib.sha1(payload).hexdigest() != sha1:
            raise ValueError("a payload of another length or digest")
    elif kind != "revisit" or "WARC-Refers-To" not in head or payload:
        raise ValueError(f"a {kind} record that is not understood")
    return {"page_id": _page_id(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": sha1, "record_type": kind,
            "refers_to": _page_id(head["WARC-Refers-To"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


# --- one archive --------------------------------------------------------------

def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; for too few samples their last bytes as they are."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"WARC/1.1\r\n"


def dictionary_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(data)
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed


def _loaded(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame."""
    if len(content) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack_from("<II", content)
    if magic != DICT_MAGIC or len(content) < 8 + size:
        raise ValueError("no whole dictionary frame at the start")
    data = content[8:8 + size]
    if data[:4] == ZSTD_MAGIC:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    reader = zstandard.ZstdDecompressor(dict_data=_loaded(data))
    view, at = memoryview(content), 8 + size
    while at < len(content):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("a frame ends early")
            some = view[at:at + (64 << 10)]
            out.append(frame.decompress(some))
            at += len(some)
        at -= len(frame.unused_data)
        yield b"".join(out)


# --- tables -------------------------------------------------------------------

def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, sha1,
    refers_to, revisit.  Only digests are grouped; a hot group is combined where
    it is read, and the join is split by AQE."""
    payload = F.encode(text_of(F.col(html_col)), "utf-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload")})
    key = F.when(F.col("payload_bytes") >= min_revisit, F.sha2("payload", 256))
    groups = (
        rows.select("page_id", key.alias("_key"), "payload_bytes").where("_key is not null")
        .groupBy("_key", "payload_bytes").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").select(F.col("_key").alias("_k"), "_first")
    )
    rows = rows.withColumn("_key", key)
    revisit = F.col("_k").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(groups, F.col("_key") == F.col("_k"), "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url",
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "sha1",
        F.when(revisit, F.col("_first").cast("string")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives under ``folder`` (any store that pyarrow's
    filesystems reach); returns the manifest: archive, records, bytes."""
    from pyarrow import fs

    some = hash_sample(pages.select(id_col, html_col), F.col(id_col), DICT_PAGES)
    sample = sorted(some.select(F.substring(text_of(F.col(html_col)), 1, DICT_CHARS).alias("_t")).collect())
    trained = dictionary([record_bytes("0", None, r._t.encode(), len(r._t), "0" * 40, None, False) for r in sample])
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        out_store, out_root = fs.FileSystem.from_uri(folder)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(trained))
        start = dictionary_frame(trained)
        frames, held, made = [], 0, []

        def close() -> None:
            nonlocal frames, held
            name = f"part-{part:08d}-{len(made):04d}.warc.zst"
            with out_store.open_output_stream(f"{out_root}/.{name}.{attempt}") as f:
                f.write(start + b"".join(frames))
            out_store.move(f"{out_root}/.{name}.{attempt}", f"{out_root}/{name}")
            made.append((name, len(frames), len(start) + held))
            frames, held = [], 0

        for batch in batches:
            for rows in slices(batch, 2):
                for row in zip(*rows):
                    frames.append(packer.compress(record_bytes(*row)))
                    held += len(frames[-1])
                    if held >= ARCHIVE_BYTES:
                        close()
        if frames:
            close()
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int64()))],
                names=["archive", "records", "bytes"])

    rows = with_revisits(pages, id_col, url_col, html_col).sortWithinPartitions("page_id", "sha1", "url")
    small_batches(pages.sparkSession)
    manifest = rows.mapInArrow(run, "archive string, records bigint, bytes bigint")
    return stored(manifest, "warc-manifest")


RECORD = ("page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to string, problem string")


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives in ``folder``; ``problem`` says what is
    wrong with a record (or the rest of an archive) that fails validation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = RECORD + (", payload binary" if payloads else "")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def records(content: bytes) -> Iterator[dict]:
        try:
            for data in read_archive(content):
                try:
                    yield parse_record(data)
                except (ValueError, KeyError) as e:
                    yield {"problem": str(e)}
        except (ValueError, zstandard.ZstdError) as e:
            yield {"problem": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column in batch.column(0):
                rows, held = [], 0
                for r in records(column.as_py()):
                    if payloads:
                        held += len(r.get("payload") or b"")
                    else:
                        r.pop("payload", None)
                    rows.append(r)
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder)
    return files.select("content").mapInArrow(run, schema)


def op8_warc_zstd(spark, sf_dir):
    folder = stage_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select(
        F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"), "problem")


#: The rows that the written and reread archives must give.
OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
         max(page_id) OVER (PARTITION BY h) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to,
       CAST(NULL AS VARCHAR) AS problem
FROM d
"""
