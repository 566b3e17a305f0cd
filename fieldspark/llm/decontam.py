"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters occurs in a document with at most k edits only if some diagonal band holds at least
m - q + 1 - k q of its character q-grams. k is 10 % of m, rounded down, at every length; q is the largest up to 8 that
leaves the bound at three q-grams, so short items are searched with shorter q-grams. Documents and items are normalised (lower case, white space runs to one
space). One pass over the texts hashes every q-gram of a document, looks it up among the items' q-grams, counts hits
by item in overlapping diagonal bands of width 2 w with step w = k + 1 of that item, and keeps bands that reach the
item's bound. What stays is verified by banded semi-global alignment over exactly that region; the edit budget decides.
Alignment keeps two rows; the start of a match comes from a second pass that carries starts along. Items that
repeat a q-gram more than ``REPEATS`` times are counted one by one, their hits once for each stretch of w places of the
text, in every band that the stretch touches: more bands stay than need to, none is lost, and a repetitive text costs
1 / w of its pairs of places. Hits of all other items are counted in rounds of bounded size, each over some items.

Items are a stated query set: they go to tasks in blocks of at most ``block_chars`` characters, one pass for each
block, so what is sent has a fixed bound however many items there are. No shuffle, and no state between documents.

Defined results: null or empty texts and items never match. Items shorter than q + 3 characters (11) after normalising are
matched exactly as whole strings. A document matching an item several times gives one row, the best region (fewest
edits, then first). Repeated rows each give their rows; a null id stays null. Extra columns are not read. ``start`` and
``end`` are code points of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, boxed, table

_U = np.uint64
_BASE = _U(0x100000001B3)
_SPREAD = _U(0x9E3779B97F4A7C15)
Q, ERROR_RATE = 8, 0.10
#: Hits that are expanded at once, and that are counted in one round.
PART, ROUND = 1 << 21, 1 << 24


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def offsets(text: str) -> np.ndarray:
    """For each character of ``normalise(text)`` the place in ``text`` that it comes from."""
    at, out = [], []
    for i, ch in enumerate(text):
        for c in ch.lower():
            if c.isspace():
                if out and out[-1] != " ":
                    out.append(" ")
                    at.append(i)
            else:
                out.append(c)
                at.append(i)
    return np.array(at[:-1] if out and out[-1] == " " else at, np.int64)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, _U)
    h = np.zeros(n, _U)
    for j in range(q):
        h *= _BASE
        h += c[j : j + n]
    h *= _SPREAD
    return h


def gram_length(m: int, q: int, rate: float) -> int:
    """The largest length up to ``q`` with which the lemma asks an item of m characters for three q-grams at least."""
    return max(1, min(q, (m - 2) // (int(rate * m) + 1)))


def budget(m: int, q: int, rate: float) -> tuple[int, int]:
    """(k, least): edits allowed for an item of m characters, and the q-grams that must then be left of it."""
    k = int(rate * m)
    return k, max(1, m - q + 1 - k * q)


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then the same for the others."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


@dataclass(frozen=True)
class Items:
    """Items of a block that are searched with the same q, and the index of their q-grams."""

    ids: list
    texts: list[np.ndarray]
    k: np.ndarray
    least: np.ndarray
    width: np.ndarray
    q: int
    map: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    repetitive: dict[int, tuple[np.ndarray, np.ndarray]]
    reach: int

    MAP_BITS = 22
    REPEATS = 8

    @classmethod
    def classes(cls, rows: list[tuple], q: int, rate: float) -> list[Items]:
        """The items that are not matched exactly, by their q."""
        by: dict[int, list[tuple]] = {}
        for item_id, text in rows:
            m = len(normalise(text))
            if m >= q + 3:
                by.setdefault(gram_length(m, q, rate), []).append((item_id, text))
        return [cls.build(by[g], g, rate) for g in sorted(by)]

    @classmethod
    def build(cls, rows: list[tuple], q: int, rate: float) -> Items:
        ids, texts, k, least, hs, items, pos = [], [], [], [], [], [], []
        for item_id, text in rows:
            c = codes(normalise(text))
            h = qgram_hashes(c, q)
            if not len(h):
                continue
            a, b = budget(len(c), q, rate)
            hs.append(h)
            items.append(np.full(len(h), len(ids), np.int64))
            pos.append(np.arange(len(h), dtype=np.int64))
            ids.append(item_id)
            texts.append(c)
            k.append(a)
            least.append(b)
        h = np.concatenate(hs) if hs else np.empty(0, _U)
        order = np.argsort(h, kind="stable")
        keys, starts = np.unique(h[order], return_index=True)
        bits = np.zeros(1 << cls.MAP_BITS, bool)
        bits[(keys >> _U(64 - cls.MAP_BITS)).astype(np.int64)] = True
        cat = lambda x: (np.concatenate(x) if x else np.empty(0, np.int64))[order]
        item, pos = cat(items), cat(pos)
        gram = np.repeat(np.arange(len(keys)), np.diff(np.append(starts, len(h))))
        often, n = np.unique(gram * max(1, len(ids)) + item, return_counts=True)
        often = np.unique(often[n > cls.REPEATS] % max(1, len(ids)))
        repetitive = {int(x): (gram[item == x], pos[item == x]) for x in often}
        plain = ~np.isin(item, often)
        starts = np.concatenate([[0], np.cumsum(plain)])[np.append(starts, len(h))]
        k = np.array(k, np.int64)
        reach = max(map(len, texts), default=0) + int(max(k, default=0)) + 2
        return cls(ids, texts, k, np.array(least, np.int64), k + 1, q, bits, keys, starts, item[plain], pos[plain], repetitive, reach)

    def regions(self, c: np.ndarray) -> set[tuple[int, int]]:
        """(item, first diagonal of band) of bands that reach their item's bound, over concatenated documents."""
        h = qgram_hashes(c, self.q)
        at = np.flatnonzero(self.map[(h >> _U(64 - self.MAP_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return set()
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[i] == h[at]
        at, i = at[hit], i[hit]
        found: set[tuple[int, int]] = set()
        n = self.starts[i + 1] - self.starts[i]
        total = int(n.sum())
        rounds = 1 + total // ROUND
        cuts = np.searchsorted(np.cumsum(n), np.arange(PART, total, PART))
        for r in range(rounds if total else 0):
            hits = []
            for part in np.split(np.arange(len(at)), cuts):
                where = _runs(self.starts[i[part]], n[part])
                where_at = np.repeat(at[part], n[part])
                if rounds > 1:
                    mine = self.item[where] % rounds == r
                    where, where_at = where[mine], where_at[mine]
                item, pos = self.item[where], self.pos[where]
                key = item << 40 | (where_at - pos + self.reach) // self.width[item]
                hits += [(key, pos), (key - 1, pos)]
            found |= self._counted(hits)
        for item, (grams, places) in self.repetitive.items():
            w = int(self.width[item])
            some = np.isin(i, grams)
            pair = np.unique(i[some] << 32 | at[some] // w)
            gram, cell = pair >> 32, pair & ((1 << 32) - 1)
            first = np.searchsorted(grams, gram)
            n = np.searchsorted(grams, gram, "right") - first
            pos = places[_runs(first, n)]
            least = np.repeat(cell * w, n) - pos + self.reach
            # A stretch of one step touches two steps of diagonals, so three bands.
            low, high = item << 40 | least // w, item << 40 | (least + w - 1) // w
            found |= self._counted([(low, pos), (low - 1, pos), (high, pos)])
        return found

    def _counted(self, hits: list[tuple[np.ndarray, np.ndarray]]) -> set[tuple[int, int]]:
        """Bands, keyed by item and number, that hold enough distinct places of their item."""
        key, pos = (np.concatenate(x) for x in zip(*hits, strict=True))
        every, inv, total = np.unique(key, return_inverse=True, return_counts=True)
        some = (total >= self.least[every >> 40])[inv]
        # The lemma counts q-grams of the item, so a q-gram that the text repeats counts once.
        keys, inv = np.unique(key[some], return_inverse=True)
        if not len(keys):
            return set()
        total = np.bincount(np.unique(inv << 32 | pos[some]) >> 32, minlength=len(keys))
        good = keys[total >= self.least[keys >> 40]].tolist()
        return {(k >> 40, (k & ((1 << 40) - 1)) * int(self.width[k >> 40]) - self.reach) for k in good}

    def align(self, item: int, c: np.ndarray, diag: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item's best alignment with ``c`` on the band's diagonals, or None over the budget."""
        best = self._align(item, c, diag, False)
        return best and self._align(item, c, diag, True)

    def _align(self, item: int, c: np.ndarray, diag: int, starts: bool) -> tuple[int, int, int] | None:
        t, k = self.texts[item], int(self.k[item])
        m, lo, wide = len(t), diag - k, 2 * int(self.width[item]) + 2 * k + 1
        big = 1 << 40
        cols = np.arange(wide)
        a, b = max(0, lo), min(len(c), lo + m + wide + 1)
        if a >= b:
            return None
        whole = lo >= 0 and lo + m + wide <= len(c)
        padded = np.full(m + wide + 2, 0xFFFFFFFF, np.uint32)
        padded[a - lo : b - lo] = c[a:b]
        outside = lambda r: (r + lo + cols < 0) | (r + lo + cols > len(c))
        d = np.zeros(wide, np.int64)
        if not whole:
            d[outside(0)] = big
        start = cols.copy()
        up = np.full(wide, big, np.int64)
        for r in range(1, m + 1):
            up[:-1] = d[1:]
            e = np.minimum(d + (padded[r - 1 : r - 1 + wide] != t[r - 1]), up + 1)
            if starts:
                # Of equally good ways a match or change comes first, then a missing character, then an added one.
                start = np.where(d + (padded[r - 1 : r - 1 + wide] != t[r - 1]) == e, start, np.append(start[1:], 0))
            if not whole:
                e[outside(r)] = big
            d = np.minimum.accumulate(e - cols) + cols
            if starts:
                start = start[np.maximum.accumulate(np.where(e == d, cols, 0))]
            if d.min() > k:  # no cell of the band can come back under the budget
                return None
        best = int(d.min())
        if best > k:
            return None
        end = int(np.flatnonzero(d == best)[0])
        return best, lo + int(start[end]), lo + m + end


_OUT = "doc_id long, item_id long, start long, end long, edits int"


def _search(items, limit: int = 1 << 21):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: list[Items] = items.value
        gap = np.array([0x110001, 0x110002, 0x110003], np.uint32)
        for b in it:
            out: list[tuple] = []
            held: list[tuple] = []
            size = 0

            def flush() -> None:
                if not held:
                    return
                joined = np.concatenate([y for _, _, c in held for y in (c, gap)])
                begins = np.cumsum([0, *[len(c) + len(gap) for _, _, c in held]])
                best: dict[tuple[int, int, int], tuple] = {}
                for n, x in enumerate(classes):
                    for item, diag in x.regions(joined):
                        # A band may begin before its document; it belongs to those that its middle stretch overlaps.
                        first = np.searchsorted(begins, max(0, diag), "right") - 1
                        last = np.searchsorted(begins, diag + 2 * int(x.width[item]), "right") - 1
                        for d in range(max(0, first), min(last, len(held) - 1) + 1):
                            got = x.align(item, held[d][2], diag - int(begins[d]))
                            if got and ((d, n, item) not in best or got < best[d, n, item]):
                                best[d, n, item] = got
                for (d, n, item), (edits, s, e) in sorted(best.items()):
                    doc_id, text, _ = held[d]
                    at = offsets(text)
                    out.append((doc_id, classes[n].ids[item], int(at[s]), int(at[e - 1]) + 1 if e > s else int(at[s]), edits))
                held.clear()

            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                c = codes(normalise(text))
                if len(c):
                    if size + len(c) > limit:
                        flush()
                        size = 0
                    held.append((doc_id, text, c))
                    size += len(c)
            flush()
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = ERROR_RATE, block_chars: int = 1 << 23) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the best region of every item in every document that holds it."""
    spark = docs.sparkSession
    batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("length(text) > 0")
    chars = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(chars) // block_chars))
    found = None
    for i in range(n_blocks):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i).collect()
        long = Items.classes([tuple(r) for r in rows], q, rate)
        part = docs.mapInArrow(_search(spark.sparkContext.broadcast(long)), _OUT)
        short = [(r["item_id"], t) for r in rows if 0 < len(t := normalise(r["text"])) < q + 3]
        if short:
            part = part.unionByName(_exact(docs, short))
        found = part if found is None else found.unionByName(part)
    return found


def _exact(docs: DataFrame, items: list[tuple]) -> DataFrame:
    """Items too short for the filter: whole-string search."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                norm = normalise(text)
                for item_id, t in items:
                    s = norm.find(t)
                    if s >= 0:
                        at = offsets(text)
                        out.append((doc_id, item_id, int(at[s]), int(at[s + len(t) - 1]) + 1, 0))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

    return docs.mapInArrow(run, _OUT)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; rows without doc_id are judged by their text's hash."""
    keyed = boxed(docs).withColumn("key", F.xxhash64("row.doc_id", "row.text"))
    bad = contaminated(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark"))
    return keyed.join(bad.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")
