"""Operator 1: WARC archives, written by Spark and read by verified chains of records.

A reader that looks for the magic finds records, but also magic inside payloads. So every candidate
names its successor by its own length, and only candidates that can be reached from a file's start are
records. Tasks follow chains inside their split; across splits, pointer jumping doubles the distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, table, written

MAGIC = b"WARC/1."
#: Splits whose entry points are broadcast (some 100 bytes each); with more, the rows are shuffled instead.
SPLITS = 500_000
#: Digests of repeated payloads (some 100 bytes each) that are broadcast; with more, pages are shuffled by digest.
DIGESTS = 200_000
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each five hex digits give four base32 digits."""
    h = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "none") -> None:
    """One record per row of page_id, url and html, in plain archives, which are read in several splits each, or gzip ones.

    Of payloads of at least ``least_bytes`` that are equal, the smallest page_id's is a response and the
    others are revisits without a payload. A null html is an empty payload, a null url an empty target;
    rows that share that page_id are all responses; a null page_id is smallest of none but null ones. An empty table
    gives archives without records; columns of other names are ignored.
    """
    t = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    t = t.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    # Only payloads that occur more than once need a lookup. Written, so that where they are too many to broadcast, both
    # sides of the join are plain shuffles and a digest of very many pages can be split.
    first = t.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    first = written(first, "firsts")
    t = t.join(F.broadcast(first) if first.count() <= DIGESTS else first, "digest", "left")
    t = t.withColumn("first", F.coalesce("first", "page_id"))
    revisit = F.coalesce((F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit(_HEAD), F.col("n").cast("string"), F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block,
    )
    t.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, in the order of each split: no record is held twice, none whole file at once."""
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("data"),
    )


def _header(piece: bytes) -> tuple[int, int, bytes] | None:
    """Length of the header after the magic, length of the block, the header; None if it isn't one."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or piece[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    found = re.search(rb"\r\ncontent-length: *(\d+) *(?:\r\n|$)", piece[:end], re.I)
    return (end + 4, int(found[1]), piece[:end]) if found else None


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split its bytes, and for each candidate where its chain leaves the split (places from the split's first piece)."""

    def leave(key, at, starts):
        exits: dict[int, int | None] = {}
        for start, nxt in reversed(starts):
            # A successor inside the split must be a candidate itself; else the chain is broken.
            exits[start] = nxt if nxt >= at - len(MAGIC) else exits.get(nxt)
        rows = [(*key, None, None, at)] + [(*key, s, e, None) for s, e in exits.items() if e is not None]
        cols = list(zip(*rows, strict=True))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "block", "start", "exit", "bytes"]
        )

    key, at, starts = None, 0, []
    for batch in batches:
        for file, block, data in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["data"].to_pylist(), strict=True):
            if key != (file, block):
                if key is not None:
                    yield leave(key, at, starts)
                key, at, starts = (file, block), 0, []
            if (at or block) and (head := _header(data)):
                starts.append((at - len(MAGIC), at + head[0] + head[1] + 4))
            at += len(data) + len(MAGIC)
    if key is not None:
        yield leave(key, at, starts)


def _entries(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """For each split with a record its first record's place; and whether any file has several splits."""
    rows = written(_pieces(spark, path).mapInArrow(_chains, "file string, block long, start long, exit long, bytes long"), "chains")
    before = F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    base = rows.where("bytes IS NOT NULL").select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))
    nodes = rows.where("start IS NOT NULL").join(base, ["file", "block"]).select(
        "file", "block", "base", (F.col("base") + F.col("start")).alias("at"), (F.col("base") + F.col("exit")).alias("to")
    )
    most = rows.where("bytes IS NOT NULL").groupBy("file").count().agg(F.max("count")).first()[0] or 0
    if most > 1:
        nodes = written(nodes, "nodes")
        reached, jump, hops = nodes.where("at = 0").select("file", "at"), nodes.select("file", "at", "to"), 1
        while hops < most:
            reached = written(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "reached")
            far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
            jump = written(jump.join(far, ["file", "to"]).select("file", "at", F.col("further").alias("to")), "jump")
            hops *= 2
        nodes = nodes.join(reached, ["file", "at"], "left_semi")
    else:
        nodes = nodes.where("at = 0")
    firsts = nodes.groupBy("file", "block").agg(F.min(F.col("at") - F.col("base")).alias("entry"))
    return base.join(firsts, ["file", "block"], "left"), most > 1


_NAMES = ("type", "record_id", "target_uri", "refers_to", "payload_digest", "http_length")
_SCHEMA = "file string, offset long, missing long, " + ", ".join(f"{n} string" for n in _NAMES) + ", payload binary"


def _fields(header: bytes, block: bytes) -> tuple:
    lines = dict(x.split(b":", 1) for x in header.split(b"\r\n")[1:] if b":" in x)
    named = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, v in lines.items()}
    http = None
    if named.get(b"content-type", "").startswith("application/http") and (end := block.find(b"\r\n\r\n")) >= 0:
        if found := re.search(rb"\r\ncontent-length: *(\d+)", block[:end], re.I):
            http = found[1].decode()
        block = block[end + 4 :]
    wanted = (b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-refers-to", b"warc-payload-digest")
    return (*map(named.get, wanted), http, block)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow each split's chain from its entry. Pieces before it belong to a record of an earlier split (no type)."""
    key, at, want, held = None, 0, None, None
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary()]

    def done(missing=0):
        start, need, parts, (size, length, header) = held
        raw = MAGIC.join(parts)[size : size + length]
        if missing:  # raw pieces are kept to be joined with those of later splits
            return (key[0], base + start, need, None, None, None, None, None, None, MAGIC.join(parts))
        return (key[0], base + start, 0, *_fields(header, raw))

    for batch in batches:
        out, rows = [], [batch[c].to_pylist() for c in ("file", "block", "base", "entry", "data")]
        for file, block, first, entry, data in zip(*rows, strict=True):
            if key != (file, block):
                if held:
                    out.append(done(missing=held[1] > sum(map(len, held[2])) + len(MAGIC) * (len(held[2]) - 1)))
                key, at, want, held, base = (file, block), 0, entry, None, first
            start = at - len(MAGIC)
            if want is not None and start == want and (at or block):
                if held:
                    out.append(done())
                head = _header(data)
                held = (start, head[0] + head[1], [data], head) if head else None
                want = at + head[0] + head[1] + 4 if head else None
            elif held:
                held[2].append(data)
            elif at or block:
                out.append((file, first + start, -1, None, None, None, None, None, None, data))
            at += len(data) + len(MAGIC)
        cols = list(zip(*out, strict=True)) if out else [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "offset", "missing", *_NAMES, "payload"])
    if held:
        row = done(missing=held[1] > sum(map(len, held[2])) + len(MAGIC) * (len(held[2]) - 1))
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=["file", "offset", "missing", *_NAMES, "payload"])


def _rejoined(key, rows):
    """A record that reaches into later splits, from its pieces. (A piece is without the magic before it.)"""
    rows = rows.sort_by("offset")
    raw = MAGIC.join(rows["payload"].to_pylist())
    head = _header(raw)
    values = (rows["file"][0].as_py(), rows["offset"][0].as_py(), 0, *_fields(head[2], raw[head[0] : head[0] + head[1]]))
    return pa.table({n: pa.array([v], rows.schema.field(n).type) for n, v in zip(("file", "offset", "missing", *_NAMES, "payload"), values, strict=True)})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: file, offset (in the uncompressed file), header fields, payload.

    Records follow each other from the file's start; what no chain reaches (junk, magic inside payloads, a
    file that doesn't start with a record) gives none. Gzip files are single splits; plain ones are split.
    An HTTP header is taken off the payload. A record cut short by the file's end has what is there. Records of one
    file may be equal; no files or empty ones give no rows. A record is held whole by the task that emits it.
    """
    entries, several = _entries(spark, path)
    pieces = _pieces(spark, path)
    entries = written(entries, "entries")
    if entries.count() <= SPLITS:
        pieces = pieces.join(F.broadcast(entries), ["file", "block"])
    else:
        pieces = pieces.join(entries, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "seq")
    rows = pieces.select("file", "block", "base", "entry", "data").mapInArrow(_records, _SCHEMA)
    if several:
        # Records that reach into a later split: few, as each split ends in one at most. Their pieces are dealt by the record
        # they belong to, which is found without the payloads.
        cut = written(rows.where("missing != 0"), "cut")
        before = W.partitionBy("file").orderBy("offset")
        owner = F.max(F.when(F.col("missing") > 0, F.col("offset"))).over(before)
        end = F.max(F.when(F.col("missing") > 0, F.col("offset") + len(MAGIC) + F.col("missing"))).over(before)
        own = cut.select("file", "offset", owner.alias("owner"), end.alias("end")).where("owner IS NOT NULL AND offset < end").drop("end")
        whole = cut.join(own, ["file", "offset"]).groupBy("file", "owner").applyInArrow(lambda key, t: _rejoined(key, t.drop_columns(["owner"])), _SCHEMA)
        rows = rows.where("missing = 0").unionByName(whole)
    return rows.where("missing = 0").drop("missing")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all ``pages`` hold, a row a page (see ``write_warc`` and ``read_warc``)."""
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    r = read_warc(spark, path)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    revisit = F.col("type") == "revisit"
    return r.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha1:", "")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> (15 - 5 * j)) & 31 AS INTEGER), 1), '' ORDER BY i, j)
     FROM (SELECT i, CAST(('0x' || substr(sha1(html), 1 + 5 * i, 5)) AS BIGINT) AS v FROM range(8) AS a(i)) AS x, range(4) AS b(j)) AS payload_digest
  FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
