"""Encoding a corpus with a public byte-level BPE vocabulary: a bounded-lookahead streaming transducer.

The encoding of every prefix of a run of bytes is known by its last token: the one token ending there whose pair with
the last token of the prefix before it is stable under the merge list. So prefixes form a tree, each hanging on the prefix
its last token starts at. A later token can only start where what has been read since is the beginning of some token of
the merge list; the longest such beginning is the lookahead at that byte (never more than the longest token less one byte),
kept as the bytes come. A prefix from which no token can start any more and on which none hangs is dropped; once the
tree's root carries a single branch, that branch's token is final and is emitted. Every byte adds one prefix and every
prefix is dropped once, so work is in proportion to the bytes and memory is that of the undecided prefixes.

Every run, short or long, goes through the transducer. Runs come from the vocabulary's split pattern, read block by block:
a match is final once it ends before the last three characters seen and another match follows it. The tokens of runs of up
to ``KEPT_BYTES`` are remembered, once per distinct run and task.

Defined results: null and empty text give an empty list; strings that look like special tokens are plain text;
lone surrogates can't occur in Spark strings. Duplicate ids give one row each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Split pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Size of a vocabulary file that may be sent to every worker.
MAX_VOCABULARY = 64 << 20
#: Distinct runs kept per task, and the longest one kept; the table is emptied when it is full, so memory is bounded.
CACHE, KEPT_BYTES = 400_000, 256
BLOCK_CHARS, BLOCK_BYTES = 1 << 16, 1 << 14


class Transducer:
    """Byte-level BPE over a stream of text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = {r: t for t, r in ranks.items()}
        #: Proper beginnings of tokens: what can still become a longer token.
        self.begun = {t[:i] for t in ranks for i in range(1, len(t))}
        #: The longest lookahead the merge list can ask for.
        self.lookahead = max(map(len, self.begun), default=0)
        self.peak = 0
        self._pair: dict[tuple[bytes, bytes], bool] = {}
        self._runs: dict[str, list[int]] = {}

    @classmethod
    def load(cls, data: bytes) -> "Transducer":
        """From the bytes of a rank file: a token in base 64 and its rank on each line."""
        return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t})

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        """The merge list applied to two tokens' bytes: the pair of lowest rank first, until none is left."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether the pair of tokens is stable: their bytes together are merged into just the two (b alone where a is empty)."""
        ok = self._pair.get((a, b))
        if ok is None:
            if len(self._pair) >= CACHE:
                self._pair.clear()
            both = a + b
            ok = self._pair[a, b] = self._merged([both[i : i + 1] for i in range(len(both))]) == ([a, b] if a else [b])
        return ok

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one run that arrives in blocks, each as soon as it is final."""
        ranks, begun, pairs, follows = self.ranks, self.begun, self._pair, self.follows
        last: dict[int, bytes] = {0: b""}  # end of a prefix in the tree -> its last token
        hung: dict[int, int] = {0: 0}  # how many prefixes hang on it
        where: dict[int, int] = {0: 0}  # the sum of their ends: the one, where there is one
        root = n = depth = oldest = 0  # root: the last final end; depth: lookahead; oldest: the first end a token can still start at
        held, base = b"", 0  # held: bytes from base on
        for block in blocks:
            held = held[root - base :] + block if n - base > BLOCK_BYTES else held + block
            base = root if n - base > BLOCK_BYTES else base
            for n in range(n + 1, base + len(held) + 1):
                end = n - base
                for size in range(min(depth + 1, end), 0, -1):
                    token = held[end - size : end]
                    if token in ranks:
                        start = n - size
                        before = last.get(start)
                        if before is not None:
                            ok = pairs.get((before, token))
                            if ok if ok is not None else follows(before, token):
                                break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
                last[n], hung[n], where[n] = token, 0, 0
                hung[start] += 1
                where[start] += n
                depth += 1
                while depth and held[end - depth : end] not in begun:
                    depth -= 1
                while oldest < n - depth:  # no token can start at this end any more
                    at = oldest
                    oldest += 1
                    while at != root and at < oldest and at in hung and not hung[at]:
                        up = at - len(last[at])
                        del last[at], hung[at], where[at]
                        hung[up] -= 1
                        where[up] -= at
                        at = up
                while root < oldest and hung[root] == 1:
                    up, root = root, where[root]
                    del hung[up], where[up], last[up]
                    yield ranks[last[root]]
            if len(last) > self.peak:
                self.peak = len(last)
        tail, at = [], n
        while at > root:
            tail.append(ranks[last[at]])
            at -= len(last[at])
        yield from reversed(tail)

    def run(self, text: str) -> list[int]:
        """Tokens of one match of the pattern."""
        data = text.encode()
        got = list(self.stream(data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)))
        if len(data) <= KEPT_BYTES:
            if len(self._runs) >= CACHE:
                self._runs.clear()
            self._runs[text] = got
        return got

    def runs(self, blocks: Iterable[str]) -> Iterator[list[str]]:
        """Matches of the pattern over a text that arrives in blocks, in lists, each match as soon as it is final."""
        held = None
        for block in blocks:
            if held is None:
                held = block
                continue
            final, at = [], 0  # more text follows: matches that the next characters could change are kept back
            for m in self.split.finditer(held):
                if m.end() > len(held) - 3:
                    break
                final.append(m.group())
                at = m.end()
            if final:  # the last one may still grow by what follows it
                at -= len(final.pop())
            yield final
            held = held[at:] + block
        if held is not None:
            yield self.split.findall(held)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        kept, run = self._runs, self.run
        for found in self.runs(text[i : i + BLOCK_CHARS] for i in range(0, len(text), BLOCK_CHARS)):
            for r in found:
                out += kept.get(r) or run(r)
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids: an incremental state machine holds the bytes of an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if s := machine.decode(self.tokens[i]):
                yield s
        if s := machine.decode(b"", True):
            yield s


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """Of a vocabulary file on this machine."""
    return Transducer.load(vocabulary_bytes(path))


def vocabulary_bytes(path: str) -> bytes:
    """A vocabulary file of checked size."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary of more than {MAX_VOCABULARY} bytes")
    return data


@lru_cache(maxsize=2)
def _built(data: bytes) -> Transducer:
    """One per worker process and vocabulary."""
    return Transducer.load(data)


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every document; no shuffle, one Arrow pass. The vocabulary file is read by the driver and sent along."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _built(shared.value)
        for b in batches:
            lists = [t.encode(x) for x in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=offsets[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"{id_col} {kind}, ids ARRAY<INT>")
