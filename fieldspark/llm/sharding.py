"""Uniform shuffle into shards by an exact hypergeometric communication matrix (law: rows).

Rows lie in 2^d partitions by the leading bits of a seeded hash of their key. How many rows go from each partition to
each shard is drawn exactly, from the multivariate hypergeometric law with fixed margins (partition sizes, shard
sizes): a binary tree over partitions splits the counts, each split a chain of hypergeometric draws by inversion of
the exact distribution. Then rows are permuted inside their partition, dealt to shards by the drawn counts, and
permuted again inside their shard. Shard sizes differ by one row at most.

No task holds a partition, shard or group whole: slots in a shard are ranked in sub-buckets first. Everything is
DataFrame and SQL functions. The result depends on keys, the seed and the number of rows only, not on the layout.

Defined results: null text: size 1 (nothing plus 1), crc 0. Rows that are equal in all key columns are
interchangeable. Empty table: empty result. Extra columns pass through ``shard_rows``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import stash, table, with_running_total
from .quality import let

MAX_BITS = 16


def _hypergeometric(pool: str, good: str, n: str, u: str) -> str:
    """SQL: a draw from Hypergeometric(pool, good, n) by inversion at ``u`` over mean +- (12 sd + 40), clipped to its support."""
    lo0, hi0 = f"greatest(0L, {n} - ({pool} - {good}))", f"least({n}, {good})"
    mean = f"(CAST({n} AS DOUBLE) * {good} / {pool})"
    var = f"({mean} * (1D - CAST({good} AS DOUBLE) / {pool}) * ({pool} - {n}) / greatest({pool} - 1L, 1L))"
    reach = f"(12D * sqrt(greatest(0D, {var})) + 40D)"
    lo = f"greatest({lo0}, CAST(floor({mean} - {reach}) AS BIGINT))"
    hi = f"least({hi0}, CAST(ceil({mean} + {reach}) AS BIGINT))"
    ratio = f"((CAST({good} - k AS DOUBLE) * ({n} - k)) / ((k + 1D) * ({pool} - {good} - {n} + k + 1D)))"
    mass = f"aggregate(sequence(lo, hi), named_struct('p', 1D, 's', 0D), (b, k) -> named_struct('p', b.p * {ratio}, 's', b.s + b.p), b -> b.s)"
    pick = (
        f"aggregate(sequence(lo, hi), named_struct('p', 1D, 's', 0D, 'k', lo), (b, k) -> named_struct('p', b.p * {ratio}, 's', b.s + b.p, "
        f"'k', CASE WHEN b.s < mass * {u} THEN k ELSE b.k END), b -> b.k)"
    )
    drawn = let(lo, "lo", let(hi, "hi", let(mass, "mass", pick)))
    return f"CASE WHEN {lo0} = {hi0} THEN {lo0} ELSE {drawn} END"


def communication_matrix(counts: DataFrame, bits: int, sizes: list[int], seed: int) -> DataFrame:
    """(part, dealt): for each of 2^bits partitions with rows, how many rows each shard gets from it.

    counts: (part, n). One row holds all partition sizes at the root (2^16 numbers at most); each level splits it.
    """
    full = counts.sparkSession.range(1 << bits).select(F.col("id").alias("part")).join(counts, "part", "left")
    root = full.agg(F.sort_array(F.collect_list(F.struct("part", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    tree = root.select(
        F.lit(0).cast("long").alias("part"), F.transform("x", lambda e: e["n"]).alias("counts"), F.array(*[F.lit(x).cast("long") for x in sizes]).alias("room")
    )
    for level in range(bits - 1, -1, -1):
        half = 1 << level
        u = f"(CAST(shiftrightunsigned(xxhash64({seed}L, {level}L, part, s), 11) AS DOUBLE) / 9007199254740992D)"
        k = _hypergeometric("a.pool", "room[s]", "a.need", u)
        step = let(k, "x", "named_struct('need', a.need - x, 'pool', a.pool - room[s], 'out', concat(a.out, array(x)))")
        start = (
            f"named_struct('need', aggregate(slice(counts, 1, {half}), 0L, (a, x) -> a + x), 'pool', aggregate(room, 0L, (a, x) -> a + x), "
            "'out', CAST(array() AS ARRAY<BIGINT>))"
        )
        safe = step.replace("/ a.pool", "/ greatest(a.pool, 1L)")
        left = f"aggregate(sequence(0, {len(sizes) - 1}), {start}, (a, s) -> {safe}, a -> a.out)"
        tree = tree.withColumn("_left", F.expr(left))
        sides = F.array(
            F.struct((F.col("part") * 2).alias("part"), F.slice("counts", 1, half).alias("counts"), F.col("_left").alias("room")),
            F.struct(
                (F.col("part") * 2 + 1).alias("part"),
                F.slice("counts", half + 1, half).alias("counts"),
                F.zip_with("room", "_left", lambda a, b: a - b).alias("room"),
            ),
        )
        tree = tree.select(F.explode(sides).alias("s")).select("s.*")
        if level % 4 == 0 and level:
            tree = tree.repartition("part")
    return tree.select("part", F.col("room").alias("dealt")).filter(F.aggregate("dealt", F.lit(0).cast("long"), lambda a, x: a + x) > 0)


def _lead(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def shard_rows(df: DataFrame, keys: list[str], n_shards: int = 8, seed: int = 7, partition_rows: int = 2048) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; ``df`` should be a written table, as it is read several times."""
    n = df.count()
    bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(1, n) / partition_rows))))
    sub_bits = min(40, max(0, math.ceil(math.log2(max(1, n) / n_shards / partition_rows)))) + 1
    sizes = [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    cols = [F.col(k) for k in keys]
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), *cols))
    rows = rows.withColumn("_part", _lead(F.col("_h"), bits))
    matrix = stash(communication_matrix(rows.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n")), bits, sizes, seed), "shard-matrix")
    ends = "transform(sequence(0, size(dealt) - 1), i -> aggregate(slice(dealt, 1, i + 1), 0L, (a, x) -> a + x))"
    matrix = matrix.select(F.col("part").alias("_part"), F.expr(ends).alias("_ends"))
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 1), *cols), "_h")
    rows = rows.withColumn("_r", F.row_number().over(local) - 1).join(matrix, "_part")
    rows = rows.withColumn("shard", F.expr("size(filter(_ends, e -> e <= _r))")).drop("_ends")
    rows = rows.withColumn("_h2", F.xxhash64(F.lit(seed + 2), *cols)).withColumn("_sub", _lead(F.col("_h2"), sub_bits))
    # Rank inside (shard, sub-bucket); unsigned order of the hash is the order of its leading bits, then the rest.
    rows = with_running_total(rows, ["shard"], "_sub", [F.col("_h2"), F.col("_part"), F.col("_r")], F.lit(1), "slot")
    return rows.drop("_h", "_h2", "_sub", "_r", "_part")


def digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def op10_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stash(digest(table(spark, sf_dir, "documents")), "shard-rows")
    out = shard_rows(rows, ["doc_id", "size", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
