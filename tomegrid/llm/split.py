"""Splitting oversized items at natural boundaries.

An item over ``max_chars`` code points is cut into pieces of at most ``max_chars``; every piece but the first
repeats the last ``overlap`` characters before its cut, so a piece brings at most ``max_chars - overlap`` new ones.
The row's boundary is the first of block, line, sentence, word, none whose units all fit. Dynamic programming
over boundary positions picks the cuts: it minimises, over all pieces, the penalty of the cut's kind plus the
squared deviation from an even size. Finer boundaries are offered only inside units too long at the coarser kind,
so a natural boundary is never given up for balance.

Defined results: null and short content yields no piece; white space stays in the pieces, so the new parts,
joined, are the content; runs without white space are cut between code points; text of any length is handled
in memory linear in its length. Null ids and clauses are kept as null; repeated rows are split each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 1000, 100
KINDS = ("block", "line", "sentence", "word", "none")
#: Penalty of a cut, by kind.
PENALTY = (0.0, 0.3, 0.8, 2.0, 5.0)
_BLANK = re.compile(r"(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+")
_LINE = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"(?<=[.!?;…])\s+")
_SPACE = re.compile(r"\s+")
_SEPARATORS = (_BLANK, _LINE, _SENTENCE, _SPACE)


def _units(text: str, start: int, end: int, separator: re.Pattern) -> list[tuple[int, int]]:
    """Spans between separators, without the white space around them; empty ones are dropped."""
    spans, at = [], start
    for m in [*separator.finditer(text, start, end), None]:
        stop = m.start() if m else end
        a, b = at, stop
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            spans.append((a, b))
        at = m.end() if m else end
    return spans


def boundaries(text: str, new: int) -> tuple[str, dict[int, int]]:
    """The row's boundary kind, and every cut position offered with its kind's number."""
    cuts: dict[int, int] = {}
    level, todo = 0, [(0, len(text))]
    while True:
        units = [u for span in todo for u in _units(text, *span, _SEPARATORS[level])]
        for a, b in units:
            for p in (a, b):
                if 0 < p < len(text):
                    cuts.setdefault(p, level)
        todo = [u for u in units if u[1] - u[0] > new]
        if not todo:
            break
        level += 1
        if level == 4:
            for a, b in todo:  # no natural boundary: even cuts through the run
                n = -(-(b - a) // new) * 4
                for i in range(1, n):
                    cuts.setdefault(a + (b - a) * i // n, 4)
            break
    edges = sorted([0, len(text), *cuts])
    for a, b in zip(edges, edges[1:]):  # only white space can be this long between two cuts
        for p in range(a + new, b, new):
            cuts.setdefault(p, level)
    return KINDS[level], cuts


def plan(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> tuple[str, list[int]]:
    """Boundary kind and the cut positions of one oversized text, by dynamic programming."""
    new = max_chars - overlap
    kind, cuts = boundaries(text, new)
    pos = np.array([0, *sorted(cuts), len(text)])
    penalty = np.array([0.0, *(PENALTY[cuts[p]] for p in sorted(cuts)), 0.0])
    even = len(text) / -(-len(text) // new)
    best, back = np.full(len(pos), np.inf), np.zeros(len(pos), dtype=np.int64)
    best[0] = 0.0
    first = np.searchsorted(pos, pos - new)
    for i in range(1, len(pos)):
        j = slice(first[i], i)
        cost = best[j] + ((pos[i] - pos[j] - even) / new) ** 2
        k = int(np.argmin(cost))
        best[i], back[i] = cost[k] + penalty[i], first[i] + k
    out, i = [], len(pos) - 1
    while i:
        out.append(int(pos[i]))
        i = int(back[i])
    return kind, out[::-1]


def split_oversized(chunks: DataFrame, *, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every oversized row: row_id, id, clause, boundary, piece, start, new_chars, content."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the limit")
    long = chunks.where(F.length("content") > max_chars).select("row_id", "id", F.col("metadata.Clause").alias("clause"), "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, kinds, piece, start, new, text = [], [], [], [], [], []
            for i, t in enumerate(b.column("content").to_pylist()):
                kind, ends = plan(t, max_chars, overlap)
                at = 0
                for n, end in enumerate(ends):
                    row.append(i)
                    kinds.append(kind)
                    piece.append(n)
                    start.append(at)
                    new.append(end - at)
                    text.append(t[max(0, at - overlap) : end])
                    at = end
            own = pa.array(row, pa.int64())
            kept = [b.column(c).take(own) for c in ("row_id", "id", "clause")]
            made = [pa.array(kinds, pa.string()), *(pa.array(x, pa.int32()) for x in (piece, start, new)), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(kept + made, names=["row_id", "id", "clause", "boundary", "piece", "start", "new_chars", "content"])

    return long.mapInArrow(cut, "row_id BIGINT, id STRING, clause STRING, boundary STRING, piece INT, start INT, new_chars INT, content STRING")
