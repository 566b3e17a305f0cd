"""WARC archives with a two-level capture index.

Archive: WARC 1.1 records, each its own gzip member, concatenated in blocks of at most ``block_bytes`` (one record may
exceed it); a block is a row (archive, block, data) of a Parquet table, so it can be written and range-read by any
task. Records with equal payloads of at least ``min_bytes``: the one with the smallest page_id is a response, the
others revisit it without body.

Index: one line for each capture, "key timestamp {json}", its key the URL with reversed host; lines are sorted over all
captures and cut into blocks of ``lines`` lines, each compressed (level one); the first key of every block forms the
sparse directory (level two), a table with one entry for each block. Blocks lie in parts of the key order; the first
keys of parts, one entry for 64 blocks and at most 2^16 in all, are what tasks and driver hold. A lookup goes by binary
search from the parts to the directory of one part to a block, decompresses it, binary-searches its lines, and reads
the records' ranges. The query finds every page that way by its URL, in batches of one part's keys.

Equal payloads may be a third of all pages: the least page_id of each is found by a map-side aggregate and joined back
under salted keys. Page contents are shuffled once at most.

Defined results: null html: empty payload; null url: key "-". A null page_id never is the one revisited unless all
are null. Rows that repeat a page_id and payload: the one with the least url (null as empty) is the response; of rows
equal in all three exactly one is, the others revisit its page_id. Empty table: empty result. Extra columns are not
read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh_path, stash, table

SALTS = 32
DATE = "2024-01-01T00:00:00Z"
_ARCHIVE = "archive int, block int, data binary, lines array<string>"


def surt(url: str | None) -> str:
    """A URL's sort key: reversed host, port, then path and query, lower case; "-" without url."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return _quoted(url.strip().lower())
    host = host.removeprefix("www.")
    port = f":{port}" if port and port not in (80, 443) else ""
    path = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return _quoted((",".join(reversed(host.split("."))) + port + ")" + path).lower())


def _quoted(key: str) -> str:
    """No space or line break ends a key or a line."""
    return key.replace(" ", "%20").replace("\n", "%0a").replace("\r", "%0d")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the headers of its payload, not the payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    else:
        body += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (after the HTTP headers) of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, sha, kind, refers_to): which pages are responses, and what the others revisit."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))})
    small = p.filter(F.octet_length("html") >= min_bytes).select("sha", F.struct(F.col("page_id").isNull().alias("z"), "page_id", F.coalesce("url", F.lit("")).alias("url")).alias("x"))
    every = small.groupBy("sha", "x").agg(F.count(F.lit(1)).alias("k"))
    first = every.groupBy("sha").agg(F.min(F.struct("x", "k")).alias("m"), F.sum("k").alias("n")).filter("n > 1")
    first = stash(first.select("sha", F.col("m.x").alias("x"), F.col("m.k").alias("k")), "warc-first")
    salted = first.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    out = p.join(salted, ["sha", "salt"], "left")
    least = F.col("page_id").eqNullSafe(F.col("x.page_id")) & (F.coalesce("url", F.lit("")) == F.col("x.url"))
    revisit = F.col("x").isNotNull() & ~(least & (F.col("k") == 1))
    out = out.withColumns({"kind": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("x.page_id"))})
    tied = first.filter("k > 1")
    if tied.isEmpty():
        return out.drop("x", "k", "salt")
    # Rows equal in all columns are one row and a count: the first stays a response, the others are dealt by salt.
    rest = out.filter(F.col("x").isNull() | (F.col("k") == 1) | ~least).drop("x", "k", "salt")
    ties = p.join(F.broadcast(tied) if tied.count() <= 10_000 else tied, "sha").filter(least)
    ties = ties.groupBy("sha", "page_id").agg(F.min("url").alias("url"), F.first("html").alias("html"), F.first("k").alias("k"))
    ties = ties.withColumn("salt", F.explode(F.expr(f"sequence(0L, least(k, {SALTS}L) - 1)"))).repartition("sha", "salt")
    ties = ties.withColumn("i", F.explode(F.expr(f"sequence(salt, k - 1, {SALTS}L)")))
    again = F.col("i") > 0
    ties = ties.withColumns({"kind": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("page_id"))})
    return rest.unionByName(ties.select(*rest.columns))


def _write(block_bytes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = block = size = 0
        data: list[bytes] = []
        lines: list[str] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([archive], pa.int32()), pa.array([block], pa.int32()), pa.array([b"".join(data)], pa.binary()), pa.array([lines], pa.list_(pa.string()))],
                names=["archive", "block", "data", "lines"],
            )

        for b in it:
            for r in b.to_pylist():
                archive = r["archive"]
                payload = r["html"].encode("utf-8", "surrogatepass")
                x = record(r["kind"], r["page_id"], r["url"], payload, digest(payload), r["refers_to"])
                if data and size + len(x) > block_bytes:
                    yield out()
                    block, size, data, lines = block + 1, 0, [], []
                where = {"archive": archive, "block": block, "offset": size, "length": len(x)}
                lines.append(f"{surt(r['url'])} {DATE[:10].replace('-', '')} {json.dumps(where)}")
                data.append(x)
                size += len(x)
        if data:
            yield out()

    return run


def write(pages: DataFrame, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """Write the archive of ``with_originals`` to ``path``; returns its index lines."""
    spark = pages.sparkSession
    batches(spark)
    out = pages.select(F.spark_partition_id().alias("archive"), "page_id", "url", "html", "kind", "refers_to").mapInArrow(_write(block_bytes), _ARCHIVE)
    out.write.option("compression", "uncompressed").parquet(path)
    return spark.read.schema(_ARCHIVE).parquet(path).select(F.explode("lines").alias("line"))


_INDEX = "part int, block int, first string, data binary"


def _index(lines: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        part = block = 0

        def out(some: list[str]) -> pa.RecordBatch:
            raw = zlib.compress("\n".join(some).encode("utf-8", "surrogatepass"), 6)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([some[0]], pa.string()), pa.array([raw], pa.binary())],
                names=["part", "block", "first", "data"],
            )

        for b in it:
            for p, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = p
                held.append(line)
                if len(held) == lines:
                    yield out(held)
                    held, block = [], block + 1
        if held:
            yield out(held)

    return run


PARTS = 1 << 16


def index(lines: DataFrame, path: str, block_lines: int = 1000) -> None:
    """Sort index lines over all captures and write them in compressed blocks."""
    parts = max(lines.count() // (64 * block_lines), min(lines.sparkSession.sparkContext.defaultParallelism, 8), 1)
    ordered = lines.repartitionByRange(min(parts, PARTS), "line").sortWithinPartitions("line")
    ordered.select(F.spark_partition_id().alias("part"), "line").mapInArrow(_index(block_lines), _INDEX).write.parquet(path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """The sparse directory, (first, part, block): the first line of every block."""
    return spark.read.schema(_INDEX).parquet(path).select("first", "part", "block")


def part_firsts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """First line and number of every part, in order: at most ``PARTS``."""
    return [tuple(r) for r in directory(spark, path).groupBy("part").agg(F.min("first").alias("first")).select("first", "part").orderBy("first").collect()]


def matches(firsts: list[str], key: str) -> range:
    """Places of the sorted blocks, given by their first lines, that can hold a line starting with ``key``."""
    lo = max(0, bisect.bisect_left(firsts, key) - 1)
    hi = lo
    while hi < len(firsts) and (firsts[hi] < key or firsts[hi].startswith(key)):
        hi += 1
    return range(lo, hi)


def _parts(tops: list[tuple[str, int]]):
    """Keys of URLs and the parts that can hold them."""
    firsts = [x[0] for x in tops]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(tops[i][1], key) for key in {surt(u) + " " for u in b.column(0).to_pylist()} for i in matches(firsts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["part", "key"])

    return run


_RANGE = "archive int, block int, offset int, length int"


def _find(keys: pa.Table, blocks: pa.Table) -> pa.Table:
    """Ranges of the captures of ``keys`` in one part: its directory, a block, its lines, each by binary search."""
    blocks = blocks.sort_by("block")
    firsts, data = blocks.column("first").to_pylist(), blocks.column("data")
    at, lines = -1, []
    found = []
    for key in sorted(set(keys.column("key").to_pylist())):
        for i in matches(firsts, key):
            if i != at:
                at, lines = i, zlib.decompress(data[i].as_py()).decode("utf-8", "surrogatepass").split("\n")
            j = bisect.bisect_left(lines, key)
            while j < len(lines) and lines[j].startswith(key):
                found.append(json.loads(lines[j].split(" ", 2)[2]))
                j += 1
    return pa.table({n: pa.array([x[n] for x in found], pa.int32()) for n in ("archive", "block", "offset", "length")})


def locate(urls: DataFrame, index_path: str) -> DataFrame:
    """(archive, block, offset, length) of every capture of the URLs in the first column, each once."""
    spark = urls.sparkSession
    batches(spark)
    keys = urls.distinct().mapInArrow(_parts(part_firsts(spark, index_path)), "part int, key string").distinct()
    blocks = spark.read.schema(_INDEX).parquet(index_path).select("part", "block", "first", "data")
    return keys.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(_find, _RANGE)


def lookup(spark: SparkSession, archive: str, index_path: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Captures of one URL: parts, directory, block, range."""
    firsts = part_firsts(spark, index_path)
    parts = [firsts[i][1] for i in matches([x[0] for x in firsts], surt(url) + " ")]
    blocks = spark.read.schema(_INDEX).parquet(index_path).filter(F.col("part").isin(parts))
    keys = spark.createDataFrame([(p, surt(url) + " ") for p in parts], "part int, key string")
    ranges = keys.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(_find, _RANGE).collect()
    out = []
    for w in sorted(map(tuple, ranges)):
        row = spark.read.schema(_ARCHIVE).parquet(archive).filter((F.col("archive") == w[0]) & (F.col("block") == w[1]))
        out.append(parse(row.select(F.substring("data", w[2] + 1, w[3]).alias("m")).first()["m"]))
    return out


_DIGEST = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(data: pa.Table, ranges: pa.Table) -> pa.Table:
    """The records of one archive block at the ranges."""
    rows = []
    if len(ranges):
        raw = memoryview(data.column("data")[0].as_py())
        for at, n in sorted(zip(ranges.column("offset").to_pylist(), ranges.column("length").to_pylist(), strict=True)):
            f, payload = parse(raw[at : at + n])
            sha = f["WARC-Payload-Digest"].removeprefix("sha1:")
            kind = f["WARC-Type"]
            size = int(f["X-Payload-Length"])
            if kind == "response" and (len(payload) != size or digest(payload) != sha):
                raise ValueError("a record does not hold its payload")
            rows.append((_page(f["WARC-Record-ID"]), size, sha, kind, _page(f["WARC-Refers-To"]) if kind == "revisit" else None))
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.table({x.split()[0]: pa.array(c, t) for x, c, t in zip(_DIGEST.split(", "), cols, types, strict=True)})


def read_back(archive: str, ranges: DataFrame) -> DataFrame:
    """The captures at ``ranges``; both sides are dealt by archive block, so a task holds one block at a time."""
    data = ranges.sparkSession.read.schema(_ARCHIVE).parquet(archive).select("archive", "block", "data")
    return data.groupBy("archive", "block").cogroup(ranges.groupBy("archive", "block")).applyInArrow(_read, _DIGEST)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, index_path = fresh_path(spark, "warc"), fresh_path(spark, "warc-index")
    pages = table(spark, sf_dir, "pages")
    index(write(with_originals(pages), archive), index_path)
    return read_back(archive, locate(pages.select(F.col("url").cast("string")), index_path))


_HEX = "lpad(bin(('0x' || substr(h, {k}, 5))::BIGINT), 20, '0')"
ORACLE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, concat({bits}) AS bits FROM p),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, coalesce(url, '')) AS n,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0b' || substr(bits, (i * 5 + 1)::INT, 5))::INT + 1)::INT]), 'string_agg', '') AS payload_digest
  FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n = 1 THEN NULL ELSE first END AS refers_to
FROM d
""".format(bits=", ".join(_HEX.format(k=k) for k in range(1, 41, 5)))
