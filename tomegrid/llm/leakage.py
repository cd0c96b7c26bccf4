"""Evaluation passages inside a corpus: pigeonhole pieces, then Myers' bit-parallel distance over words.

A passage is a window of ``window`` consecutive words of an item, found with at most ``errors`` word edits. Any
such window covers, whole, at least ``errors + 1`` of the item's aligned pieces of ``(window + 1) // (errors + 2)``
words, and one of them must stand in the document exactly. Pieces are
looked up by hash in one pass over the documents; only around a hit is the distance of each window to the document
computed, with words as symbols; it decides every row, an exact passage being one at distance 0.

A set of items whose pieces fit ``max_pieces`` is sent to every task and the corpus is read once. A larger one is joined: a filter
of fixed size tells, in one pass over the corpus, which documents may hold a piece; their pieces' hashes meet the items' in a
join, and only the documents and items that met are compared. The corpus is read once in either way, whatever the number of items.

Defined results: null and empty texts match nothing, nor do items without an id; items shorter than the window match nothing; several hits of an
item in one document are one row with the least distance; equal items and repeated documents each give their rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomegrid.session import cut

WINDOW, ERRORS = 12, 1
#: Pieces of items sent to every task at most, and the size of the filter of a larger set, as a power of two of its bits.
MAX_PIECES, FILTER_BITS = 200_000, 27
#: Runs of letters or digits: \w without the underscore is Unicode categories L and N (and numeric letters).
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and that stretch's last index + 1."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for at, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & mask
        ph, mh = (mv | ~(xh | pv)) & mask, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Pieces:
    """The pieces of a set of items, by their words."""

    def __init__(self, items: list[tuple[int, str]], window: int, errors: int):
        self.window, self.errors = window, errors
        self.size = (window + 1) // (errors + 2)
        self.items = {i: w for i, t in items if len(w := words(t)) >= window}
        self.table: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.items.items():
            for at in range(0, len(w) - self.size + 1, self.size):
                self.table[tuple(w[at : at + self.size])].append((i, at))
        self.first = {k[0] for k in self.table}

    def _near(self, item: list[str], w: list[str], d: int) -> list[int]:
        """Running count of the item's words that the document has within ``errors`` of the diagonal d.

        An alignment with so few edits leaves all but ``errors`` words of a window there, on the diagonal of its whole piece.
        """
        e, n, total, out = self.errors, len(w), 0, [0]
        for p, x in enumerate(item):
            a = p + d - e
            total += x in w[max(0, a) : max(0, min(n, a + 2 * e + 1))]
            out.append(total)
        return out

    def search(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item -> (least distance, longest exact run) of one document."""
        w = words(text)
        hits: dict[int, set[int]] = defaultdict(set)
        n, first, table = self.size, self.first, self.table
        for at, x in enumerate(w[: len(w) - n + 1]):
            if x in first and (found := table.get(tuple(w[at : at + n]))):
                for i, p in found:
                    hits[i].add(at - p)  # the diagonal: document position less item position
        out = {}
        for i, diagonals in hits.items():
            item, e = self.items[i], self.errors
            best, run = self.window, 0
            for d in diagonals:
                k = 0
                for p in range(max(0, -d), min(len(item), len(w) - d)):
                    k = k + 1 if item[p] == w[p + d] else 0
                    run = max(run, k)
            for d in diagonals:
                near = self._near(item, w, d)
                for p in range(len(item) - self.window + 1):
                    if near[p + self.window] - near[p] >= self.window - e:
                        stretch = w[max(0, p + d - e) : p + d + self.window + e]
                        best = min(best, myers(item[p : p + self.window], stretch)[0])
                    if not best:
                        break
                if not best:
                    break
            if best <= e:
                out[i] = (best, run)
        return out


def piece_hash(piece: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(piece)) - (1 << 63)


def _rows(found: list[tuple], ids: pa.Array, id_col: str) -> pa.RecordBatch:
    """Result rows of (place among the ids, item, distance, run)."""
    at, *rest = zip(*found) if found else ((), (), (), ())
    made = [pa.array(x, k) for x, k in zip(rest, (pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *made], names=[id_col, "item_id", "distance", "exact_run"])


def leaked_items(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, errors: int = ERRORS, max_pieces: int = MAX_PIECES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document and item it gives away: id, item_id, distance (word edits), exact_run (words)."""
    size = (window + 1) // (errors + 2)
    asked = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    kind = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}"
    # at most a piece for every ``size`` words, so characters bound the pieces before any is made
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    search = _search_joined if chars > 2 * size * max_pieces else _search_sent
    return search(texts, asked, kind, window=window, errors=errors, id_col=id_col, text_col=text_col)


def _search_sent(texts: DataFrame, asked: DataFrame, kind: str, *, window: int, errors: int, id_col: str, text_col: str) -> DataFrame:
    """Every task has all items."""
    known = texts.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in asked.collect()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(known.value, window, errors)
        for b in batches:
            yield _rows([(at, i, *r) for at, t in enumerate(b.column(1).to_pylist()) for i, r in pieces.search(t).items()], b.column(0), id_col)

    return texts.mapInArrow(find, f"{kind}, item_id BIGINT, distance INT, exact_run INT")


def _search_joined(texts: DataFrame, asked: DataFrame, kind: str, *, window: int, errors: int, id_col: str, text_col: str, bits: int = FILTER_BITS) -> DataFrame:
    """Items of any number meet the documents by their pieces' hashes."""
    size, block, spark = (window + 1) // (errors + 2), 1 << 17, texts.sparkSession

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, piece_hash(w[at : at + size])) for i, t in zip(*(c.to_pylist() for c in b.columns)) if len(w := words(t)) >= window for at in range(0, len(w) - size + 1, size)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["item_id", "piece"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            own[_slot(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        packed = np.packbits(own)
        for k in range(0, len(packed), block):
            if packed[k : k + block].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // block], pa.int32()), "marks": pa.array([packed[k : k + block].tobytes()], pa.binary())})

    def unite(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(block, dtype=np.uint8)
        for b in batches:
            for x in b["marks"]:
                own[: len(x)] |= np.frombuffer(x, dtype=np.uint8)
        yield pd.DataFrame({"block": [key[0]], "marks": [own.tobytes()]})

    pieces = cut(asked.mapInArrow(cut_items, "item_id BIGINT, piece BIGINT").distinct(), "pieces")
    told = np.zeros((1 << bits) // 8, dtype=np.uint8)  # of fixed size
    marks = pieces.select("piece").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(mark, "block INT, marks BINARY").groupBy("block").applyInPandas(unite, "block INT, marks BINARY")
    for r in marks.collect():
        own = np.frombuffer(r.marks, dtype=np.uint8)[: len(told) - r.block * block]
        told[r.block * block : r.block * block + len(own)] = own
    shared = spark.sparkContext.broadcast(told)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told_ = shared.value
        for b in batches:
            kept, held = [], []
            for at, t in enumerate(b.column(1).to_pylist()):
                w = words(t)
                if len(w) < size:
                    continue
                h = np.unique(np.array([piece_hash(w[k : k + size]) for k in range(len(w) - size + 1)], dtype=np.int64))
                s = _slot(h, bits)
                h = h[(told_[s >> 3] >> (7 - (s & 7))) & 1 > 0]
                if len(h):
                    kept.append(at)
                    held.append(h.tolist())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept, pa.int64())) for c in b.columns), pa.array(held, pa.list_(pa.int64()))], names=[id_col, text_col, "pieces"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for at, (t, i, x) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                found += [(at, k, *r) for k, r in Pieces([(i, x)], window, errors).search(t).items()]
            yield _rows(found, b.column(0), id_col)

    # written, so that a document's number stays its own
    held = cut(texts.mapInArrow(hits, f"{kind}, `{text_col}` STRING, pieces ARRAY<BIGINT>").withColumn("place", F.monotonically_increasing_id()), "piece-hits")
    met = held.select("place", F.explode("pieces").alias("piece")).join(pieces, "piece").select("place", "item_id").distinct()
    both = met.join(asked.withColumnRenamed("text", "item_text"), "item_id").join(held.drop("pieces"), "place").select(id_col, text_col, "item_id", "item_text")
    return both.mapInArrow(compare, f"{kind}, item_id BIGINT, distance INT, exact_run INT")


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    """A hash's bit in the filter."""
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
