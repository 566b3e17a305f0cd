"""Token counts that follow edits: a segment tree of pre-token regions for each document.

A leaf is a stretch of text that begins at a word and ends before the next one; it holds its number of characters and
of tokens, inner nodes hold sums. An edit (start, end, replacement) is found by descending the tree, the region from
the leaf before it to the leaf after it (the boundary context, as a word may grow into its neighbours) is encoded
again, its sums go to the region's first leaf, the others become empty, and sums are updated on the paths to the root.

``count_documents`` adds the count and the tree (its leaves, serialised); ``apply_edits`` takes these with the
document's edits, in order, each in coordinates of the text that the edits before it have left. One pass each, no
shuffle; a tree is part of its document's row.

Defined results: null or empty text: 0 tokens and a tree of one empty leaf. Edits beyond the text's end are clipped to
it; null edits: none. Repeated rows are counted one by one. Extra columns are kept by both operators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches, table
from .encoder import Encoder, encoder, tokenizer_path

_STARTS = re.compile(r"(?<![^ \t-\r])[^ \t-\r]")


class TokenTree:
    """Sums of characters and tokens over the leaves of a text, in a complete binary tree."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        n = max(1, len(chars))
        self.n, self.size = n, 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(chars), 1] = tokens
        width = self.size
        while width > 1:
            half = width // 2
            self.sums[half:width] = self.sums[width : 2 * width].reshape(half, 2, 2).sum(axis=1)
            width = half
        self.encoded = 0

    @classmethod
    def of(cls, text: str, e: Encoder) -> TokenTree:
        starts = [m.start() for m in _STARTS.finditer(text)] if not text.isascii() else _ascii_starts(text)
        cuts = np.array([0, *starts[1:], len(text)] if len(starts) else [0, len(text)], np.int64)
        if "<|" in text:
            tokens = [len(e.ids(text[a:b])) // 4 for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        else:
            tokens = [len(e[w]) // 4 for w in text.encode("utf-8", "surrogatepass").lower().split()] or [0]
        return cls(np.diff(cuts), np.array(tokens, np.int64))

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it begins."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if at >= begin + self.sums[i, 0]:
                begin += int(self.sums[i, 0])
                i += 1
        return i - self.size, begin

    def _put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        change = np.array([chars, tokens], np.int64) - self.sums[i]
        if change.any():
            while i:
                self.sums[i] += change
                i //= 2

    def edit(self, text: str, start: int, end: int, new: str, e: Encoder) -> str:
        """The text after the edit; sums follow."""
        start = min(max(0, start), len(text))
        end = min(max(start, end), len(text))
        first, begin = self.leaf(max(0, start - 1)) if text else (0, 0)
        last, at = self.leaf(min(end, len(text) - 1)) if text else (0, 0)
        stop = at + int(self.sums[self.size + last, 0])
        region = text[begin:start] + new + text[end:stop]
        self.encoded += len(region)
        self._put(first, len(region), len(e.ids(region)) // 4)
        for i in range(first + 1, last + 1):
            self._put(i, 0, 0)
        return text[:begin] + region + text[stop:]

    def dump(self) -> bytes:
        return np.ascontiguousarray(self.sums[self.size : self.size + self.n]).astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> TokenTree:
        x = np.frombuffer(raw, "<u4").reshape(-1, 2)
        return cls(x[:, 0], x[:, 1])


def _ascii_starts(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode(), np.uint8)
    word = ~((c == 32) | ((c >= 9) & (c <= 13)))
    word_before = np.concatenate([[False], word[:-1]])
    return np.flatnonzero(word & ~word_before)


def _count(path: str, text: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in it:
            counts, trees = [], []
            for t in b.column(text):
                x = TokenTree.of(t.as_py() or "", e)
                counts.append(x.total)
                trees.append(x.dump())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(trees, pa.binary())], names=[*b.schema.names, "n_tokens", "tree"])

    return run


def count_documents(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``tree``; columns of these names are replaced."""
    batches(docs.sparkSession)
    docs = docs.drop("n_tokens", "tree")
    schema = StructType(docs.schema.fields.copy()).add("n_tokens", "long").add("tree", "binary")
    return docs.mapInArrow(_count(tokenizer or tokenizer_path(), text), schema)


def _apply(path: str, text: str, edits: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in it:
            texts, counts, trees, encoded = [], [], [], []
            for t, raw, some in zip(b.column(text), b.column("tree"), b.column(edits).to_pylist(), strict=True):
                t, x = t.as_py() or "", TokenTree.load(raw.as_py())
                for one in some or ():
                    t = x.edit(t, one["start"], one["end"], one["replacement"] or "", e)
                texts.append(t)
                counts.append(x.total)
                trees.append(x.dump())
                encoded.append(x.encoded)
            new = {text: pa.array(texts, pa.string()), "n_tokens": pa.array(counts, pa.int64()), "tree": pa.array(trees, pa.binary())}
            kept = [new.get(n, b.column(i)) for i, n in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(encoded, pa.int64())], names=[*b.schema.names, "n_chars_encoded"])

    return run


def apply_edits(counted: DataFrame, edits: str = "edits", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``counted`` (of ``count_documents``, with a column of edits) after its edits, and how many characters were encoded again."""
    batches(counted.sparkSession)
    counted = counted.drop("n_chars_encoded")
    return counted.mapInArrow(_apply(tokenizer or tokenizer_path(), text, edits), StructType(counted.schema.fields.copy()).add("n_chars_encoded", "long"))


def stated_edits() -> Column:
    """The query's edits for every document: a replacement at a quarter, an insertion at a half, a deletion at three quarters."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    one = lambda a, b, new: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(new).alias("replacement"))
    return F.array(
        one(F.floor(n / 4), F.floor(n / 4) + 5, "edit"),
        one(F.floor(n / 2), F.floor(n / 2), " some new words "),
        one(F.floor(n * 3 / 4), F.floor(n * 3 / 4) + 3, ""),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", stated_edits().alias("edits"))
    counted = count_documents(docs).withColumn("n_tokens_before", F.col("n_tokens"))
    out = apply_edits(counted)
    return out.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"), F.length("text").cast("long").alias("n_chars_after"), "n_chars_encoded")
