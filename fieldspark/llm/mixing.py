"""Mixing sources to target weights by a low-discrepancy source schedule.

Targets: weights go to sources in code-point order (null last); the wanted total is shared by weight, a target stops
at ``max_repeat`` times its source's size, and the excess is shared again by weight until none is above (water filling,
solved in closed form over the table of sources). Schedule: slot j has the golden-ratio point frac(j / phi) in 31-bit
fixed point, mapped through the cumulative targets to a source; slots are ranked inside each source. Each source's
documents, shuffled by hash and laid end to end again and again, are cut into blocks of equal length, and a source's
k-th slot takes its k-th block. So the slots decide how many words a source gives: its slots times the block, at most
``max_repeat`` times its size. The points spread evenly, so this is within a few blocks of the target; blocks are
short enough for 256 of them to fit in the smallest target, unless that would take over 2^18 slots. A source so small
that no point falls on it gives its rounded target in a slot after all others.

The table of sources is the only one held whole in a task. Documents and slots are ranked in two levels (inside
buckets, then over bucket totals), so a source with a third of all rows is spread over tasks. Only ids and sizes are
shuffled, never texts.

Defined results: null text or no words: size 0, taken 0. Null source: a source of its own, last. Null or repeated
``doc_id``: every row is a document of its own. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, stash, table, with_running_total, word_count

POINT_BITS = 31
#: round(2^31 / golden ratio), made odd.
GOLDEN = 1327217885
BINS = 1024
SALTS = 64


@dataclass(frozen=True)
class Mix:
    """sources: one row each with target, wanted and most words; pieces: (slot, source, row key, word range), null slot where a row is not taken."""

    sources: DataFrame
    pieces: DataFrame


def order_key(doc_id: Column, text: Column) -> Column:
    """The seeded shuffle's key: the same on every engine that has md5."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2
) -> DataFrame:
    """(src, source, source_size, n_docs, weight, target, take) for a table with ``src``, ``source`` and ``size``."""
    s = sized.groupBy("src", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumns(
        {
            "wanted": F.sum("source_size").over(everything).cast("double") * share,
            "cap_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_from": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    s = s.withColumn("capped", F.col("cap") * F.col("weight_from") < (F.col("wanted") - F.col("cap_before")) * F.col("weight"))
    s = s.withColumns(
        {
            "capped_sum": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything),
            "free_weight": F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything),
        }
    )
    shared = F.col("weight") * (F.col("wanted") - F.col("capped_sum")) / F.when(F.col("free_weight") > 0, F.col("free_weight"))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(shared))
    s = s.withColumns({"want": F.floor(F.col("target") + 0.5).cast("long"), "most": F.col("cap").cast("long")})
    return s.select("src", "source", "source_size", "n_docs", "weight", "target", "want", "most")


def block_length(total: int, least: int, longest: int = 1024) -> int:
    """Words in a block: 256 blocks in the smallest target, at most 2^18 blocks in all, never over ``longest``."""
    return max(1, min(longest, max(least // 256, total >> 18)))


def slot_schedule(sources: DataFrame, n_slots: int, chunk: int = 4096) -> DataFrame:
    """(slot, src, rank): slot j's golden-ratio point mapped through cumulative takes; rank counts a source's slots from 0."""
    spark = sources.sparkSession
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    scale = float(1 << POINT_BITS)
    total = F.sum("want").over(Window.partitionBy(F.lit(0))).cast("double")
    upto = F.sum("want").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    s = sources.filter("want > 0").withColumns(
        {"hi": F.floor(upto / total * scale).cast("long"), "lo": F.floor((upto - F.col("want")) / total * scale).cast("long")}
    )
    width = (1 << POINT_BITS) // BINS
    s = s.filter("hi > lo").select(
        "src", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("bin")
    )
    slots = spark.range(1, n_slots + 1).select(F.col("id").alias("slot"))
    point = F.pmod(F.pmod(F.col("slot"), F.lit(1 << POINT_BITS)) * F.lit(GOLDEN), F.lit(1 << POINT_BITS))
    slots = slots.withColumn("point", point).withColumn("bin", F.expr(f"point div {width}"))
    hit = slots.join(s, "bin").filter("lo <= point AND point < hi").select("slot", "src", F.expr(f"slot div {chunk}").alias("chunk"))
    return with_running_total(hit, ["src"], "chunk", [F.col("slot")], F.lit(1), "rank").select("slot", "src", "rank")


def mix(sized: DataFrame, longest_block: int = 1024, bucket_rows: int = 2048, **targets) -> Mix:
    """``sized`` has doc_id, source, size and key (its shuffle order); it should be a written table, as it is read several times."""
    sized = sized.withColumn("src", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    sources = stash(source_targets(sized, **targets), "mix-sources")
    total, least = sources.filter("want > 0").agg(F.coalesce(F.sum("want"), F.lit(0)), F.coalesce(F.min("want"), F.lit(0))).first()
    block = block_length(int(total), int(least), longest_block)
    n_slots = max(1, -(-int(total) // block))
    slots = stash(slot_schedule(sources, n_slots), "mix-slots")
    per = slots.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    plan = sources.join(per, "src", "left").withColumns(
        {
            "take": F.expr(f"CASE WHEN n > 0 THEN least(n * {block}, most) ELSE least(want, most) END"),
            "block": F.expr(f"CASE WHEN n > 0 THEN {block}L ELSE greatest(want, 1L) END"),
            "buckets": F.expr(f"1 + n_docs div {bucket_rows}"),
        }
    )
    # The largest source may hold a third of all rows: the join with the table of sources is salted.
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = sized.withColumn("salt", F.pmod(F.conv(F.substring("key", 9, 4), 16, 10).cast("int"), F.lit(SALTS)))
    rows = salted.join(plan.drop("source"), ["src", "salt"]).drop("salt").withColumn(
        "bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) * F.col("buckets"))
    )
    order = [F.col("key"), F.col("size")]
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("src", "bucket").orderBy(*order)))
    rows = with_running_total(rows, ["src"], "bucket", [F.col("rn")], F.col("size"), "at")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("cast((take - 1) div greatest(source_size, 1L) as int)")))))
    rows = rows.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("at")).withColumn("b", F.least(F.col("a") + F.col("size"), "take"))
    blocks = F.when(F.col("b") > F.col("a"), F.sequence(F.expr("a div block"), F.expr("(b - 1) div block")))
    rows = rows.withColumn("rank", F.explode_outer(blocks))
    start = F.greatest("a", F.expr("rank * block"))
    stop = F.least("b", F.expr("(rank + 1) * block"))
    rows = rows.withColumns({"from_word": start - F.col("a"), "n_taken": F.when(F.col("rank").isNotNull(), stop - start).otherwise(0)})
    rows = rows.join(slots, ["src", "rank"], "left")
    # A source so small that no point fell on it plays after all others.
    slot = F.when(F.col("rank").isNotNull(), F.coalesce("slot", F.lit(n_slots + 1)))
    pieces = rows.withColumn("slot", slot).select(
        "slot", "src", "source", "rank", "doc_id", "key", "bucket", "rn", "epoch", "from_word", "n_taken", "size", "source_size", "target"
    )
    return Mix(sources, pieces)


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("key"))


def takes(mixed: Mix) -> DataFrame:
    """One row for each input row: the words that the mix takes of it, in how many pieces, and the first one's slot."""
    keys = ["src", "bucket", "rn", "doc_id", "key", "size", "source_size", "target"]
    return mixed.pieces.groupBy(*keys).agg(F.sum("n_taken").alias("taken"), F.count("slot").alias("n_pieces"), F.min("slot").alias("first_slot"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stash(sized_documents(table(spark, sf_dir, "documents")), "mix-sized")
    return takes(mix(sized)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; a last partial copy holds its first words, single-spaced.

    Rows of a partition follow the order of their first slots; the next stage deals them anew. A document of which
    nothing is taken is absent. ``n_chars`` follows the text. Rows are told apart by all their columns: those that are
    equal in id and text only keep their own source and other columns.
    """
    columns = docs.columns
    field = lambda c: F.col(f"row.`{c}`")
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[field(c).alias(f"c{i}") for i, c in enumerate(columns) if c not in ("doc_id", "text")]))
    keyed = boxed(docs).withColumn("key", F.md5(F.concat(order_key(field("doc_id"), field("text")), rest)))
    sized = stash(keyed.select(field("doc_id").alias("doc_id"), field("source").alias("source"), word_count(field("text")).alias("size"), "key"), "mix-sized")
    # Rows that are equal in all columns share one text row; how many of them take how much is counted, not listed.
    counts = takes(mix(sized)).filter("taken > 0").groupBy("key", "size", "taken").agg(F.count(F.lit(1)).alias("n"), F.min("first_slot").alias("slot"))
    counts = counts.withColumns({"whole": F.expr("taken div size"), "part": F.expr("taken % size")})
    wholes = counts.select("key", (F.col("whole") * F.col("n")).alias("copies"), F.lit(0).cast("long").alias("part"), "slot")
    parts = counts.filter("part > 0").select("key", F.col("n").alias("copies"), "part", "slot")
    plan = wholes.unionByName(parts).groupBy("key", "part").agg(F.sum("copies").alias("copies"), F.min("slot").alias("slot")).filter("copies > 0")
    one = keyed.groupBy("key").agg(F.first("row").alias("row"))
    out = one.join(plan, "key").sortWithinPartitions("slot", "key", "part").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    cut = F.expr(r"array_join(slice(split(btrim(row.text, ' \t\n\u000B\u000C\r'), '[\\x20\\x09-\\x0D]+'), 1, cast(part as int)), ' ')")
    partial = F.col("part") > 0
    changed = {"text": F.when(partial, cut).otherwise(field("text"))}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(partial, F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(field("n_chars"))
    return out.select(*[changed.get(c, field(c)).alias(c) for c in columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, 'null'), ':', md5(coalesce(text, '')))) AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size::DOUBLE AS cap FROM s0),
s2 AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS wanted,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM s1),
s3 AS (SELECT *, cap * weight_from < (wanted - cap_before) * weight AS capped FROM s2),
s4 AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0.0::DOUBLE END) OVER () AS capped_sum,
         sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE weight END) OVER () AS free_weight FROM s3),
s5 AS (
  SELECT source, source_size, cap::BIGINT AS most, CASE WHEN capped THEN cap ELSE weight * (wanted - capped_sum) / free_weight END AS target FROM s4),
s6 AS (SELECT *, floor(target + 0.5)::BIGINT AS want FROM s5),
t AS (SELECT sum(want)::BIGINT AS total, greatest(1, least(1024, greatest(min(want) // 256, sum(want)::BIGINT // 262144)))::BIGINT AS block FROM s6 WHERE want > 0),
s7 AS (
  SELECT *, sum(want) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM s6 WHERE want > 0),
s8 AS (
  SELECT *, floor(upto::DOUBLE / total::DOUBLE * 2147483648.0::DOUBLE)::BIGINT AS hi, floor((upto - want)::DOUBLE / total::DOUBLE * 2147483648.0::DOUBLE)::BIGINT AS lo FROM s7, t),
j AS (SELECT unnest(generate_series(1, (total + block - 1) // block)) AS slot FROM t),
k AS (
  SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, ((slot % 2147483648) * 1327217885) % 2147483648 AS point FROM j) AS p JOIN s8 ON lo <= point AND point < hi),
n AS (SELECT source, count(*) AS n FROM k GROUP BY source),
s AS (
  SELECT s6.*, n, CASE WHEN n > 0 THEN least(n * block, most) ELSE least(want, most) END AS take, CASE WHEN n > 0 THEN block ELSE greatest(want, 1) END AS block,
         (total + block - 1) // block + 1 AS last_slot
  FROM s6 LEFT JOIN n ON s6.source IS NOT DISTINCT FROM n.source LEFT JOIN t ON true),
p AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.take, s.block, s.last_slot,
         (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
u AS (
  SELECT *, (CASE WHEN source_size = 0 THEN 0 ELSE (take // source_size) * size + greatest(0, least(size, take % source_size - pos)) END)::BIGINT AS taken
  FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN coalesce(slot, last_slot) END::BIGINT AS first_slot
FROM u LEFT JOIN k ON u.source IS NOT DISTINCT FROM k.source AND u.pos // u.block = k.rank AND u.taken > 0
"""
