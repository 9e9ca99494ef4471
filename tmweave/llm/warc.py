"""Zstandard WARC archives: writer and reader."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tmweave.llm.common import located, table
from tmweave.session import scratch_path

# Fixed values of the format.
DICT_MAGIC = bytes.fromhex("5D2A4D18")           # leading skippable frame with the dictionary
ZSTD_MAGIC = bytes.fromhex("28B52FFD")
# An empty skippable frame: all its bytes are ASCII, so Spark's text writer can put it
# after every frame as its line separator and the file stays a valid archive.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
SKIPPABLE = tuple(bytes([0x50 + i]) + b"*M\x18" for i in range(16))
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MIN_REVISIT = 100            # bytes; smaller payloads are always stored
DICT_SAMPLE = 256            # rows sampled for the dictionary (it changes sizes, not results)
DICT_SAMPLE_BYTES = 8192     # of each of them
DICT_BYTES = 32768

RECORD = ("archive string, uri string, record_type string, record_id string, refers_to_id string, "
          "payload_bytes bigint, payload_digest string, error string")


def record_bytes(uri: str, kind: str, payload: bytes, digest: str, refers_to: str | None,
                 length: int) -> bytes:
    """One WARC/1.1 record.  A revisit has no block; the length of the payload that it stands
    for goes into an extension field beside the digest."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{uri}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>",
                 f"X-Payload-Length: {length}"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary from sample payloads; raw sample content if they are too few to
    train on; empty without samples."""
    import zstandard
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def write_warc(pages: DataFrame, path: str, uri: str, payload: str,
               min_revisit: int = MIN_REVISIT) -> None:
    """Write one record per row to ``path``, one archive per partition.

    ``uri``: string column that names the record; ``payload``: string or binary column, null is
    empty.  Of rows with equal payloads of at least ``min_revisit`` bytes, exactly one is a
    response: that with the least ``page_no`` (nulls last), of those that repeat it the first by
    uri, file and place.  The others are revisits that refer to its uri.  Other columns are
    ignored; an empty table writes no record.

    Digests are grouped first (a partial minimum per task, 50 bytes a row) and joined back by
    digest; the payloads move once.  Groups are many rows to one, so a hot digest is split by
    the adaptive skew join.
    """
    import zstandard

    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    pages, at = located(pages, "warc-pages")
    rows = pages.select(F.struct(*at).alias("key"), F.col("page_no"), F.col(uri).alias("uri"), body.alias("body"),
                        F.octet_length(body).cast("long").alias("size"))
    large = rows.where(F.col("size") >= min_revisit).select(
        F.sha2("body", 256).alias("d"), "page_no", "uri", "key")
    first = (large.groupBy("d").agg(F.min(F.struct(F.col("page_no").isNull(), "page_no", "uri", "key"))
                                    .alias("f"), F.count("*").alias("c"))
             .where("c > 1").select("d", F.col("f.uri").alias("first"), F.col("f.key").alias("first_key")))
    sample = [bytes(r[0]) for r in rows.where("size > 0").select(
        F.substring("body", 1, DICT_SAMPLE_BYTES)).limit(DICT_SAMPLE).collect()]
    dictionary = train_dictionary(sample)

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if dictionary:
            zd = zstandard.ZstdCompressionDict(dictionary)
            stored = zstandard.ZstdCompressor(level=9).compress(dictionary)
            yield pd.DataFrame({"frame": [DICT_MAGIC + len(stored).to_bytes(4, "little") + stored]})
        else:
            zd = None
        z = zstandard.ZstdCompressor(level=3, dict_data=zd, write_checksum=True)
        for b in batches:
            out = []
            for name, data, digest, first_uri, own in zip(b["uri"], b["body"], b["digest"], b["first"],
                                                          b["own"]):
                kind = "response" if own else "revisit"
                out.append(z.compress(record_bytes(name, kind, bytes(data), digest, first_uri,
                                                   len(data))))
            yield pd.DataFrame({"frame": out})

    (rows.withColumn("digest", F.sha2("body", 256))
     .join(first, F.col("digest") == F.col("d"), "left")
     .select("uri", "body", "digest", "first", F.coalesce(F.col("key") == F.col("first_key"), F.lit(True))
             .alias("own"))
     .mapInPandas(archive, "frame binary")
     # The text writer copies the bytes of a string unchanged.
     .select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).text(path))


def _frame(data: bytes, at: int, zd) -> tuple[bytes | None, int, str | None]:
    """Content, end and error of the Zstandard frame at ``at``."""
    import zstandard
    out, one, pos = [], zstandard.ZstdDecompressor(dict_data=zd).decompressobj(), at
    try:
        while not one.eof and pos < len(data):
            out.append(one.decompress(data[pos:pos + 16384]))
            pos += 16384
    except zstandard.ZstdError as e:
        return None, at, f"damaged frame: {e}"
    if not one.eof:
        return None, at, "truncated frame"
    return b"".join(out), min(pos, len(data)) - len(one.unused_data), None


def _next_record(data: bytes, at: int, zd) -> int:
    """Start of the first frame from ``at`` on that holds a WARC record, or the end."""
    at = data.find(ZSTD_MAGIC, at)
    while at >= 0:
        raw, _, error = _frame(data, at, zd)
        if error is None and parse_record(raw)["error"] != "not a WARC record":
            return at
        at = data.find(ZSTD_MAGIC, at + 1)
    return len(data)


def frames(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """Content of every Zstandard frame of an archive (the dictionary is loaded from the
    leading skippable frame, other skippable frames are passed over).  Damage gives one error,
    then reading goes on at the next frame that holds a record."""
    import zstandard
    at, zd = 0, None
    while at < len(data):
        magic, error = data[at:at + 4], None
        if magic in SKIPPABLE:
            size = int.from_bytes(data[at + 4:at + 8], "little")
            if at + 8 + size > len(data):
                error = "truncated skippable frame"
            else:
                if at == 0 and magic == DICT_MAGIC and size:
                    stored, bad = data[8:8 + size], None
                    if stored[:4] == ZSTD_MAGIC:
                        stored, _, bad = _frame(stored, 0, None)
                    if bad is None:
                        zd = zstandard.ZstdCompressionDict(stored)
                    else:
                        yield None, f"damaged dictionary: {bad}"
                at += 8 + size
                continue
        elif magic != ZSTD_MAGIC:
            error = "not a Zstandard frame"
        else:
            raw, end, error = _frame(data, at, zd)
        if error is not None:
            yield None, error
            at = _next_record(data, at + 1, zd)
            continue
        at = end
        yield raw, None


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ``error`` says what is wrong with its headers, length or digest."""
    out = {"uri": None, "record_type": None, "record_id": None, "refers_to_id": None,
           "payload_bytes": None, "payload_digest": None, "error": None, "payload": None}
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "not a WARC record"}
    field = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return out | {"error": f"bad header line: {line[:80]}"}
        field[name.strip().lower()] = value.strip()
    missing = [n for n in REQUIRED if not field.get(n.lower())]
    if missing:
        return out | {"error": "missing header: " + ", ".join(missing)}
    out |= {"uri": field.get("warc-target-uri"), "record_type": field["warc-type"],
            "record_id": field["warc-record-id"].strip("<>"),
            "refers_to_id": field.get("warc-refers-to", "").strip("<>") or None}
    length = field["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"error": f"Content-Length {length} does not fit {len(rest)} bytes"}
    block = rest[:-4]
    declared = field.get("warc-payload-digest", "").removeprefix("sha256:")
    if out["record_type"] == "revisit":
        full = field.get("x-payload-length", "")
        if not declared or not out["refers_to_id"]:
            return out | {"error": "revisit without digest or reference"}
        return out | {"payload_digest": declared,
                      "payload_bytes": int(full) if full.isdigit() else None}
    digest = hashlib.sha256(block).hexdigest()
    out |= {"payload_digest": digest, "payload_bytes": len(block), "payload": block}
    if declared and field["warc-payload-digest"].startswith("sha256:") and declared != digest:
        return out | {"error": "payload digest does not match"}
    return out


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of all archives under ``path``: ``archive``, ``uri``, ``record_type``,
    ``record_id``, ``refers_to_id``, ``payload_bytes``, ``payload_digest``, ``error``, and with
    ``payload`` the block (null for revisits).

    Every file of the path and the folders below it is an archive, whatever its name (names
    that begin with "_" or "." are skipped).  Files are read by Spark (any store) one archive
    at a time; a record that fails a check keeps its row with ``error`` set, and a damaged
    stretch gives one such row before the next record that can be read.  An archive must fit a task's memory (the writer makes one per input split); no archives
    give an empty result.
    """
    schema = RECORD + (", payload binary" if payload else "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows, size = [], 0
                for raw, error in frames(bytes(data)):
                    one = parse_record(raw) if error is None else parse_record(b"") | {"error": error}
                    rows.append(one | {"archive": name})
                    size += len(raw or b"") if payload else 300
                    if size > 8 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "content").mapInPandas(read, schema))


def _page(uri: Column) -> Column:
    return F.regexp_extract(uri, r"urn:page:(-?\d+)$", 1).try_cast("bigint")


def op1_warc_archives(spark, sf_dir):
    """Write the pages as archives below the shared folder, then read them back."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("page_no"), "html",
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
        .alias("uri"))
    path = scratch_path(spark, "llm-warc") + "/archives"
    write_warc(pages, path, "uri", "html")
    return read_warc(spark, path).select(
        _page(F.col("uri")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _page(F.col("refers_to_id")).alias("refers_to"), "error")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
       CAST(NULL AS VARCHAR) AS error
FROM f
"""
