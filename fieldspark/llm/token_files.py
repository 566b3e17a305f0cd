"""Token ids in binary shards with a minimal perfect hash index from document keys to offsets.

Documents are range-partitioned by (doc_id, text hash), sorted, encoded whole, and written in that order. A shard is a
row of a Parquet table: its raw ids (unsigned 16-bit little-endian where the vocabulary allows, else 32-bit), the
documents' keys and end offsets in order, and the serialised index: key -> number -> first document with that key, with
a fingerprint for each key. Shards have at most ``shard_tokens`` ids unless one document has more, so a task holds one
shard at a time. A table of shards gives each one's place in the order and its start among all ids.

Keyed access is one directory step (key range of the shard), one hash, one fingerprint, one slice.

Defined results: null or empty text: the end id alone. Null doc_ids come last and
have no key: a shard's documents beyond its keys are theirs. Rows that repeat
a doc_id follow each other, ordered by the text's hash; the index leads to the first. Empty table: empty result. Extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, fresh_path, stash, table
from .encoder import encoder, tokenizer_path
from .mphf import PerfectHash

END_ID = 2
_SHARD = "part int, seq int, low long, high long, n_docs long, n_tokens long, width int, payload binary, keys binary, ends binary, mph binary, slots binary"


def _shard(part: int, seq: int, keys: list[int | None], ids: list[bytes]) -> tuple:
    # Nulls are last, so the others are a prefix.
    k = np.array([x for x in keys if x is not None], "<i8")
    ends = np.cumsum([len(x) // 4 for x in ids], dtype="<i8")
    payload = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(payload) or payload.max() < 1 << 16 else 4
    distinct, first = np.unique(k, return_index=True)
    mph = PerfectHash.build(distinct.view(np.uint64))
    slots = np.empty(len(distinct), "<u4")
    slots[mph.lookup(distinct.view(np.uint64))] = first
    low, high = (int(k.min()), int(k.max())) if len(k) else (None, None)
    return (part, seq, low, high, len(keys), len(payload), width, payload.astype(f"<u{width}").tobytes(), k.tobytes(), ends.tobytes(), mph.dump(), slots.tobytes())


def _write(path: str, end_id: int, shard_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        part = seq = held = 0
        keys: list[int | None] = []
        ids: list[bytes] = []

        def out() -> pa.RecordBatch:
            cols = zip(_shard(part, seq, keys, ids))
            types = [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _SHARD.split(", ")])

        for b in it:
            for p, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                part = p
                x = e.ids(text.as_py()) + end
                if keys and held + len(x) // 4 > shard_tokens:
                    yield out()
                    seq, held, keys, ids = seq + 1, 0, [], []
                keys.append(key)
                ids.append(x)
                held += len(x) // 4
        if keys:
            yield out()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = 1 << 20, part_chars: int = 24_000_000) -> DataFrame:
    """Write the shards of ``docs`` to ``path`` and return the directory of shards with their starts."""
    spark = docs.sparkSession
    batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    chars = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(1, -(-int(chars) // part_chars), spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    ranged = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_write(tokenizer, end_id, shard_tokens), _SHARD).write.option("compression", "zstd").parquet(path)
    return directory(spark, path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, low, high, n_docs, n_tokens, start): one row for each shard. Shards of a part are summed first."""
    s = spark.read.schema(_SHARD).parquet(path).select("part", "seq", "low", "high", "n_docs", "n_tokens")
    parts = s.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return s.join(parts, "part").withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner")


class Shard:
    """A shard as read back."""

    def __init__(self, width: int, payload: bytes, keys: bytes, ends: bytes, mph: bytes, slots: bytes):
        self.payload = np.frombuffer(payload, f"<u{width}")
        self.keys, self.ends, self.slots = np.frombuffer(keys, "<i8"), np.frombuffer(ends, "<i8"), np.frombuffer(slots, "<u4")
        self.mph = PerfectHash.load(mph)

    def at(self, i: int) -> np.ndarray:
        return self.payload[self.ends[i - 1] if i else 0 : self.ends[i]].astype("<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document with each key; -1 where the fingerprint denies it."""
        n = self.mph.lookup(keys.astype("<i8").view(np.uint64))
        return np.where(n >= 0, self.slots[np.maximum(n, 0)].astype(np.int64), -1)


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for r in b.to_pylist():
            s = Shard(*(r[c] for c in ("width", "payload", "keys", "ends", "mph", "slots")))
            first = s.find(s.keys)
            if (s.keys[first] != s.keys).any():
                raise ValueError("the index does not lead to its keys")
            # A document's number: the first with its key, from the index, and its place among those that repeat the key.
            n = first + np.arange(len(first)) - np.searchsorted(first, first)
            n_null = len(s.ends) - len(n)
            n = np.concatenate([n, np.arange(len(n), len(s.ends))])
            sizes = np.diff(s.ends, prepend=0)[n]
            starts = r["start"] + s.ends[n] - sizes
            crc = [zlib.crc32(s.at(int(i)).tobytes()) for i in n]
            ids = pa.array(s.keys.tolist() + [None] * n_null, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, path: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files through the index."""
    batches(spark)
    data = spark.read.schema(_SHARD).parquet(path).select("part", "seq", "width", "payload", "keys", "ends", "mph", "slots")
    starts = shards.select("part", "seq", "start")
    return data.join(F.broadcast(starts) if _few(starts) else starts, ["part", "seq"]).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _few(starts: DataFrame, most: int = 200_000) -> bool:
    """Whether the directory is small enough (16 bytes a shard) to be sent to all tasks; else Spark joins as it sees fit."""
    return starts.count() <= most


def lookup(spark: SparkSession, path: str, keys: list[int]) -> dict[int, list[int]]:
    """Ids of documents by key: reads only the shards whose key range holds one."""
    hit = F.lit(False)
    for k in keys:
        hit = hit | ((F.col("low") <= k) & (F.col("high") >= k))
    found: dict[int, list[int]] = {}
    for r in spark.read.schema(_SHARD).parquet(path).filter(hit).orderBy("part", "seq").toLocalIterator():
        s = Shard(*(r[c] for c in ("width", "payload", "keys", "ends", "mph", "slots")))
        for k, n in zip(keys, s.find(np.array(keys, "<i8")).tolist(), strict=True):
            if n >= 0 and s.keys[n] == k and k not in found:
                found[k] = s.at(n).tolist()
    return found


def encode_documents(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-shards")
    shards = stash(write(docs, path, tokenizer or tokenizer_path()), "token-directory")
    return read_back(spark, path, shards)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents' ids in files, and their digest read back."""
    return encode_documents(docs.select("doc_id", "text"))
