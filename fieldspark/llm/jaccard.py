"""N-gram Jaccard join by grouped prefixes.

Two documents link when 100 * |A and B| >= 75 * |A or B| over their sets of 5-word shingles.

1. One pass over the texts gives each document's set size and signature, and counts every shingle of the corpus:
   tasks send sorted, delta-coded bucket numbers of shingle hashes, split by range, and each range is counted alone.
2. Shingles are ordered by (frequency level, hash): first those of one document, by a bitmap, then those of several,
   then the most frequent by level. Any order gives the same links; this one keeps what documents share by chance or
   by common passages out of prefixes. Bitmap and frequent shingles have a fixed bound and are sent to all tasks.
3. A document's prefix is its first n - ceil(0.75 n) + 1 shingles. Documents with the same size and the same prefix
   are one group (exact copies always are); sets inside a group differ by signature and are its members.
4. Groups that share a prefix shingle and pass the size and position filters are candidates. They are first tried
   against a few central groups of each shingle, in rounds; what has been joined is then compared across joined parts
   only, so a cluster of thousands is not expanded into all its pairs.
5. Members are verified on whole sets; components of the links give each document its component.

Defined results: null, empty or blank text: no shingles, component is the own doc_id. Fewer than five words: the whole
sequence is one shingle. Repeated doc_ids: every row gets a result row. A null doc_id has a result row and never is
the smallest id. Extra columns are not read. Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, boxed, stash, table
from .components import components
from .shingles import shingle_set, signature

_U = np.uint64
#: Similarity as a fraction: NUM / DEN.
NUM, DEN = 75, 100


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def _pack(sorted_buckets: np.ndarray) -> bytes:
    """Sorted numbers as zlib over byte planes of their differences."""
    d = np.diff(sorted_buckets, prepend=_U(0)).astype("<u8")
    planes = d.view(np.uint8).reshape(-1, 8).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8"), dtype=_U)


_SCAN = "kind int, doc_id long, n long, s1 long, s2 long, part int, blob binary"


def _scan(bits: int, range_bits: int, flush: int = 2_000_000):
    """Rows of kind 0: a document's size and signature; of kind 1: bucket numbers of a hash range."""

    def ranges(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.sort(np.concatenate(parts) >> _U(64 - bits))
        cuts = np.searchsorted(every, np.arange(1, 1 << range_bits, dtype=_U) << _U(bits - range_bits))
        got = [(i, _pack(x)) for i, x in enumerate(np.split(every, cuts)) if len(x)]
        yield _batch([1] * len(got), [None] * len(got), [None] * len(got), [None] * len(got), [None] * len(got), [i for i, _ in got], [b for _, b in got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            n, s1, s2 = [], [], []
            for t in texts:
                x = shingle_set(t.as_py())
                n.append(len(x))
                a, c = signature(x)
                s1.append(a)
                s2.append(c)
                held.append(x)
                n_held += len(x)
                if n_held >= flush:
                    yield from ranges(held)
                    held, n_held = [], 0
            k = len(n)
            yield _batch([0] * k, ids.to_pylist(), n, s1, s2, [None] * k, [None] * k)
        if n_held:
            yield from ranges(held)

    return run


def _batch(kind, doc_id, n, s1, s2, part, blob) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), *[pa.array(x, pa.int64()) for x in (doc_id, n, s1, s2)], pa.array(part, pa.int32()), pa.array(blob, pa.binary())],
        names=["kind", "doc_id", "n", "s1", "s2", "part", "blob"],
    )


_COUNTED = "bucket long, level int, part int, shared binary"


def _count_range(least: int, bits: int, range_bits: int, map_bits: int):
    """One hash range: buckets that occur ``least`` times or more with the level log2(count), and the range's piece of
    the bitmap in which a bit stands for 2^(bits - map_bits) neighbouring buckets and is set if any occurs twice."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        every = np.sort(np.concatenate([_unpack(b.as_py()) for b in t.column("blob")]))
        at = np.flatnonzero(np.diff(every, prepend=every[:1] - _U(1)))
        count = np.diff(at, append=len(every))
        keep = count >= least
        level = np.floor(np.log2(count[keep])).astype(np.int32)
        seen = np.zeros(1 << (map_bits - range_bits), np.uint8)
        first = _U(part) << _U(bits - range_bits)
        seen[((every[at[count > 1]] - first) >> _U(bits - map_bits)).astype(np.int64)] = 1
        n = int(keep.sum())
        return pa.table(
            {
                "bucket": pa.array([*every[at[keep]].astype(np.int64).tolist(), None], pa.int64()),
                "level": pa.array([*level.tolist(), None], pa.int32()),
                "part": pa.array([None] * n + [part], pa.int32()),
                "shared": pa.array([None] * n + [np.packbits(seen).tobytes()], pa.binary()),
            }
        )

    return run


class _Order:
    """Positions of a set's shingles in the order (level, hash), and which of them may occur in another set.

    Both parts are bounded: ``limit`` frequent buckets, all from the lowest level at which that many hold them, and
    2^map_bits bits. What they leave out costs time, not links.
    """

    def __init__(self, blobs: DataFrame, bits: int, range_bits: int, map_bits: int, limit: int, least: int = 8):
        counted = stash(blobs.groupBy("part").applyInArrow(_count_range(least, bits, range_bits, map_bits), _COUNTED), "shingle-counts")
        total, lowest = 0, 1 << 30
        for level, n in sorted(counted.filter("level IS NOT NULL").groupBy("level").count().collect(), reverse=True):
            total += n
            if total > limit:
                break
            lowest = level
        got = counted.filter(F.col("level") >= lowest).select("bucket", "level").toArrow().sort_by("bucket")
        self.buckets, self.levels = got.column("bucket").to_numpy().astype(_U), got.column("level").to_numpy()
        self.shift, self.map_shift = _U(64 - bits), _U(64 - map_bits)
        self.map = np.zeros(1 << (map_bits - 3), np.uint8)
        width = 1 << (map_bits - range_bits - 3)
        for part, piece in counted.filter("shared IS NOT NULL").select("part", "shared").collect():
            self.map[part * width : (part + 1) * width] = np.frombuffer(piece, np.uint8)

    def prefix(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The prefix in order, the positions in it of shingles that may occur in another document, and how common the set is.

        Shingles of one document come first, so the prefix of a text without near copies mostly has no other.
        """
        p = prefix_length(len(hashes))
        k = hashes >> self.map_shift
        level = (self.map[(k >> _U(3)).astype(np.int64)] >> (_U(7) - (k & _U(7))).astype(np.uint8) & 1).astype(np.int32)
        if len(self.buckets) and level.any():
            b = hashes >> self.shift
            at = np.minimum(np.searchsorted(self.buckets, b), len(self.buckets) - 1)
            level += np.where(self.buckets[at] == b, self.levels[at], 0)
        first = np.argsort(level, kind="stable")[:p]
        return hashes[first], np.flatnonzero(level[first]), float(level.mean()) if len(level) else 0.0


_PREFIX = "th long, n long, s1 long, s2 long, p1 long, p2 long, deg double, hs array<long>, ats array<int>"


def _prefixes(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for b in batches:
            rows = []
            for t, th in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x = shingle_set(t.as_py())
                if len(x):
                    p, at, deg = o.prefix(x)
                    rows.append((th, len(x), *signature(x), *signature(p), deg, p[at].astype(np.int64), at.astype(np.int32)))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.float64()), pa.array(cols[7], pa.list_(pa.int64())), pa.array(cols[8], pa.list_(pa.int32()))],
                names=["th", "n", "s1", "s2", "p1", "p2", "deg", "hs", "ats"],
            )

    return run


_SETS = "s1 long, s2 long, hashes binary"


def _wanted_sets(bloom, bits: int):
    """Sets of texts whose hash the filter may hold; false positives go in the join that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = bloom.value
        for b in batches:
            s1, s2, sets = [], [], []
            for t, th in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                k = th & ((1 << bits) - 1)
                if f[k >> 3] >> (k & 7) & 1:
                    x = shingle_set(t.as_py())
                    a, c = signature(x)
                    s1.append(a)
                    s2.append(c)
                    sets.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sets, pa.binary())], names=["s1", "s2", "hashes"]
            )

    return run


def _bloom(spark: SparkSession, hashes: DataFrame, bits: int):
    """A bitmap of 2^bits bits over ``th``, built by Spark's bitmap aggregates: bounded, whatever the number of rows."""
    slot = F.col("th").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # numbered from 1
    pieces = hashes.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m"))
    out = bytearray((1 << bits) // 8)
    for b, m in pieces.collect():
        start = (b - 1) * 4096
        out[start : start + 4096] = m[: len(out) - start]
    return spark.sparkContext.broadcast(bytes(out))


def _fit_bits(n: int, low: int, high: int) -> int:
    return int(min(high, max(low, int(n).bit_length())))


def _links(t: pa.Table) -> pa.Table:
    """Pairs that reach the similarity, on whole sets."""
    ok = []
    for a, b in zip(t.column("ha"), t.column("hb"), strict=True):
        x, y = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
        both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) + len(y) < 200 else int(np.isin(x, y, assume_unique=True).sum())
        ok.append(DEN * both >= NUM * (len(x) + len(y) - both))
    return t.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _links(pa.Table.from_batches([b])).to_batches()


def _star_pairs(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): sets tried against up to two of the most common sets, of different parts, for each of their shingles.

    entries (h, m, n, deg). For each shingle and size class (powers of 4/3) there are two such sets at most, so a shingle's
    list is as long as there are size classes, and a set meets one list for each of its shingles.
    """
    cls = F.floor(F.log("n") / math.log(DEN / NUM))
    e = entries.join(roots.withColumnRenamed("node", "m"), "m", "left").select("h", "m", "n", "deg", F.coalesce("root", "m").alias("c"), cls.alias("cls"))
    open_ = e.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    e = e.join(open_, "h", "left_semi")
    one, by = F.struct("m", "n", "c"), F.struct("deg", "m")
    best = e.groupBy("h", "cls").agg(F.max_by(one, by).alias("a"))
    other = e.join(best, ["h", "cls"]).filter("c <> a.c").groupBy("h", "cls").agg(F.max_by(one, by).alias("b"))
    lists = best.join(other, ["h", "cls"], "left").groupBy("h").agg(F.collect_list(F.struct("cls", "a", "b")).alias("x"))
    near = f"filter(flatten(transform(filter(x, r -> abs(r.cls - cls) <= 1), r -> array(r.a, r.b))), r -> r IS NOT NULL AND r.c <> c AND {DEN} * least(n, r.n) >= {NUM} * greatest(n, r.n))"
    tried = e.join(lists, "h").select("m", F.explode(F.expr(f"transform({near}, r -> r.m)")).alias("v"))
    return tried.select(F.greatest("m", "v").alias("u"), F.least("m", "v").alias("v")).distinct()


class _Verifier:
    """Verifies pairs of groups: expands them to members and compares whole sets."""

    def __init__(self, members: DataFrame, sets: DataFrame):
        self.members, self.sets = members, sets

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """pairs (u, v) of member ids m; returns those that link."""
        s = self.sets
        a = pairs.join(s.select(F.col("m").alias("u"), F.col("hashes").alias("ha")), "u")
        b = a.join(s.select(F.col("m").alias("v"), F.col("hashes").alias("hb")), "v").select("u", "v", "ha", "hb")
        return b.mapInArrow(_verify_batches, "u long, v long")


def similar_documents(
    docs: DataFrame, count_bits: int = 36, heavy_limit: int = 1 << 19, range_tokens: int = 2_000_000, star_rounds: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, component_id) for every row of ``docs``; (s1, s2) names the row's shingle set."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tokens = size[1] // 5 + size[0]
    range_bits = _fit_bits(tokens // range_tokens, 4, 16)
    map_bits = _fit_bits(tokens, 20, 27)
    batches(spark)
    scan = stash(docs.mapInArrow(_scan(count_bits, range_bits), _SCAN), "shingle-scan")
    rows = scan.filter("kind = 0").select("doc_id", "n", "s1", "s2")
    blobs = scan.filter("kind = 1").select("part", "blob")
    order = spark.sparkContext.broadcast(_Order(blobs, count_bits, range_bits, map_bits, heavy_limit))

    # Groups: same size, same prefix. Members: the different sets in a group.
    texts = docs.select("text", F.xxhash64("text").alias("th"))
    prefixes = texts.mapInArrow(_prefixes(order), _PREFIX)
    prefixes = prefixes.withColumns({"g": F.xxhash64("n", "p1", "p2"), "m": F.xxhash64("n", "s1", "s2")})
    sets_of = prefixes.groupBy("g", "m").agg(*[F.first(c).alias(c) for c in ("n", "s1", "s2", "th", "deg", "hs", "ats")])
    groups = stash(sets_of, "prefix-groups")
    members = groups.select("g", "m", "n", "th")
    one = groups.groupBy("g").agg(*[F.min_by(c, "m").alias(c) for c in ("n", "hs", "ats")], F.min("m").alias("lead"), F.max("deg").alias("deg"), F.count(F.lit(1)).alias("k"))
    one = stash(one, "groups")
    lead = one.select("g", "n", "lead", "deg", "k")
    entry = one.select("g", "n", F.explode(F.arrays_zip("hs", "ats")).alias("e")).select("g", "n", F.col("e.hs").alias("h"), F.col("e.ats").alias("at"))
    entry = stash(entry, "prefix-entries")
    several = entry.groupBy("h").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("h")
    shared = stash(entry.join(several, "h", "left_semi"), "shared-prefixes")

    # Only sets of groups that share a shingle, or of groups with several members, are ever verified.
    alive = shared.select("g").distinct().unionByName(lead.filter("k > 1").select("g")).distinct()
    live = stash(members.join(alive, "g", "left_semi"), "live-members")
    bits = _fit_bits(16 * live.count(), 18, 27)
    bloom = _bloom(spark, live.select("th"), bits)
    got = texts.mapInArrow(_wanted_sets(bloom, bits), _SETS).withColumn("m", F.xxhash64(F.expr("cast(length(hashes) div 8 as bigint)"), "s1", "s2"))
    sets = stash(got.groupBy("m").agg(F.first("hashes").alias("hashes")).join(live.select("m"), "m", "left_semi"), "live-sets")
    verify = _Verifier(live, sets)

    # Members against their group's lead; then groups against the most common sets of each shingle and size class in
    # other parts, again and again: the text that others were made from has most shingles in common with others.
    within = live.join(lead.filter("k > 1").select("g", "lead"), "g").select(F.col("m").alias("u"), F.col("lead").alias("v"))
    first = stash(verify(within.filter("u <> v")), "links-within")
    stars = stash(shared.select("h", "g").join(lead.select("g", "n", "deg", F.col("lead").alias("m")), "g").drop("g"), "stars")
    roots = stash(components(first), "roots")
    for _ in range(star_rounds):
        found = stash(verify(_star_pairs(stars, roots)), "links-star")
        if found.isEmpty():
            break
        first = stash(first.unionByName(found), "links-first")
        roots = stash(components(first), "roots")

    # What is still apart: pairs of members in different parts that share a prefix shingle, or a group.
    root = F.coalesce("root", "m").alias("c")
    placed = live.join(roots.withColumnRenamed("node", "m"), "m", "left").select("g", "m", "n", root)
    entries = stash(shared.select("h", "g", "at").join(placed, "g"), "entries")
    per_part = entries.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    mixed = entries.join(per_part, "h", "left_semi")
    x, y = mixed.alias("x"), mixed.alias("y")
    # Overlap that is needed, NUM / (NUM + DEN) * (nx + ny), against what is left from the first shared shingle on.
    apart = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.m") < F.col("y.m")) & (F.col("x.c") != F.col("y.c"))).filter(
        f"{DEN} * least(x.n, y.n) >= {NUM} * greatest(x.n, y.n)"
    )
    apart = apart.filter(f"{NUM + DEN} * least(x.n - x.at, y.n - y.at) >= {NUM} * (x.n + y.n)")
    apart = apart.select(F.col("x.m").alias("u"), F.col("y.m").alias("v"))
    inside = placed.join(lead.filter("k > 1").select("g"), "g", "left_semi")
    i, j = inside.alias("x"), inside.alias("y")
    apart_inside = i.join(j, (F.col("x.g") == F.col("y.g")) & (F.col("x.m") < F.col("y.m")) & (F.col("x.c") != F.col("y.c"))).select(
        F.col("x.m").alias("u"), F.col("y.m").alias("v")
    )
    second = verify(apart.unionByName(apart_inside).distinct())
    links = first.unionByName(second)
    final = stash(components(links), "roots")

    # Smallest doc_id of each set, then of each component.
    rows = rows.withColumn("m", F.xxhash64("n", "s1", "s2"))
    by_set = stash(rows.filter("n > 0").groupBy("m").agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("rows")), "set-ids")
    linked = by_set.join(final.withColumnRenamed("node", "m"), "m", "left").withColumn("c", F.coalesce("root", "m"))
    least = linked.groupBy("c").agg(F.min("lo").alias("component_id"), F.sum("rows").alias("k")).filter("k > 1")
    ids = linked.select("m", "c").join(least, "c").select("m", "component_id")
    out = rows.join(ids, "m", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays (nulls last), of equal rows one.

    Rows are told apart by a hash of doc_id and text, so repeated and null ids are judged row by row. Of rows equal in
    both, the one whose other columns are least as JSON stays, whatever the layout.
    """
    columns = docs.columns
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(columns) if c not in ("doc_id", "text")]))
    keyed = boxed(docs).select("row", F.col("row.doc_id").alias("id"), F.col("row.text").alias("text"), F.xxhash64("row.doc_id", "row.text").alias("rid"))
    found = similar_documents(keyed.select("rid", "text"), id_col="rid").select(F.col("doc_id").alias("rid"), F.col("component_id").alias("c")).distinct()
    named = found.join(keyed.select("rid", "id").distinct(), "rid")
    best = named.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "rid")).alias("x"))
    kept = keyed.withColumn("rest", rest).join(best.select(F.col("x.rid").alias("rid")), "rid", "left_semi")
    return kept.groupBy("rid").agg(F.min_by("row", "rest").alias("row")).select("row.*")
