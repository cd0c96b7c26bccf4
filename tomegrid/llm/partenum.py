"""Near-duplicate records by signatures of rare-first ordered word shingles (in place of PartEnum, see README note 2).

The features of a set (hashes of ``shingle`` consecutive words) are ordered by how often they occur in the whole corpus,
rarest first; how often is told by counts of hashed parts of the feature domain. Two kinds of signatures are made:

- a single feature, if its part is rare (at most ``frequent`` occurrences besides the mean) and it stands in the set's prefix, the
  ``n - ceil(threshold * n) + L`` first ones: similar sets share L features there (pigeonhole);
- a pair of frequent features that follow each other with at most ``gap`` frequent ones between, within the prefix of the frequent ones. If
  similar sets share fewer than L rare features, what they share is frequent; all but (differences) / (gap + 1) of the
  shared features then follow each other that closely in both sets, and L of these pairs lie in the prefix. Rare features
  that are not shared count as differences, so a set rich in rare features needs few pairs or none.

So a set has at most (gap + 1) signatures a feature at any size of the corpus, and a single one meets few sets by its choice. Pairs
of sets that share fewer than L signatures are dropped, as are sizes outside each other's band and pairs whose odd sketches (128
bits: a lower bound of the symmetric difference) rule the threshold out: no pair is lost. What is left is verified exactly.

Texts with equal words form one class before signatures are made: the class id is a hash of the words, equal signatures of
a class are merged within the task, and so a text that a third of all rows share costs one signature set per batch.
What goes to the driver and is broadcast is the table of part counts, one byte (a logarithm) for each part, and a bitmap of
2**``bitmap_bits`` bits. There is a part for every PART_LOAD features, but never more than 2**MAX_DOMAIN_BITS (64 MB).

Defined results: rows without an id or content and bodies with fewer than ``min_words`` different words or no shingle are in no pair; in
the groups every row is there once, such a row as its own group (a row without an id groups by its text, if that takes part); repeated rows
are members of one class; empty tables give no rows; pairs at exactly the threshold are included; texts of any length are whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tomegrid.session import cut

SHINGLE, THRESHOLD, MIN_WORDS = 5, 0.8, 20
#: A part of the domain for so many features, within these bounds (powers of two).
PART_LOAD, MIN_DOMAIN_BITS, MAX_DOMAIN_BITS = 8, 14, 26
#: Occurrences above the mean up to which a part is rare, frequent features between the two of a pair at most, and the size of the class bitmap.
FREQUENT, GAP, BITMAP_BITS = 250, 1, 24
#: Counts are kept as logarithms in so many steps an octave.
STEPS = 10
_BLOCK = 1 << 14
#: Bytes kept of a feature's hash.
FEATURE_BYTES = 5
SKETCH_BITS = 128
#: Bytes of a pair's signature; two pairs that share one only make a candidate more.
PAIR_BYTES = 6
_WORD = re.compile(r"[^\W_]+")
_FIELD = re.compile(r"\.(?:\s+|$)")


class _Words(dict):
    """word -> 64-bit hash; emptied when it is full."""

    def __missing__(self, w: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(features: np.ndarray) -> np.ndarray:
    """Features as rows of FEATURE_BYTES bytes."""
    return features.view(np.uint8).reshape(-1, 8)[:, :FEATURE_BYTES]


def unpack(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, FEATURE_BYTES)
    out = np.zeros((len(rows), 8), dtype=np.uint8)
    out[:, :FEATURE_BYTES] = rows
    return out.reshape(-1).view(np.uint64)


class Shingler:
    """Shingle sets of texts given as word lists, as flat arrays."""

    def __init__(self, shingle: int):
        self.k, self.words = shingle, _Words()

    def sets(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(document of each feature, feature), features distinct and sorted within a document."""
        get, ids = self.words, []
        for w in texts:
            ids += [get[x] for x in w]
        flat, size = np.array(ids, dtype=np.uint64), np.array([len(w) for w in texts])
        n = max(0, len(flat) - self.k + 1)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(self.k):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + n])
        doc = np.repeat(np.arange(len(size)), size)
        inside = doc[:n] == doc[self.k - 1 :]
        h, d = h[inside] >> np.uint64(64 - 8 * FEATURE_BYTES), doc[:n][inside]
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return d[new], h[new]


def _fields(head: str) -> list[str]:
    """Word strings of the header's fields, sorted."""
    return sorted(f for x in _FIELD.split(head) if (f := " ".join(_WORD.findall(x))))


def records(chunks: DataFrame, *, shingle: int, min_words: int, every: bool = False) -> DataFrame:
    """(row_id, class, copy, features) of every row that takes part, written once to the shared folder.

    class is a digest of the words of the body, copy of the header's fields, features the packed shingle set; it is
    given at a class's first row of a batch only. With ``every``, rows that take no part are there too, without a class,
    and rows without an id take part.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(shingle)
        for b in batches:
            ids, classes, copies, where, texts, seen = [], [], [], [], [], set()
            for row, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                head, _, text = (content or "").lower().partition("\n")
                w = _WORD.findall(text)
                if len(w) < shingle or len(set(w)) < min_words:
                    if every:
                        ids.append(row)
                        classes.append(None)
                        copies.append(None)
                    continue
                c = xxhash.xxh64_intdigest(" ".join(w)) - (1 << 63)
                if c not in seen:
                    seen.add(c)
                    where.append(len(ids))
                    texts.append(w)
                ids.append(row)
                classes.append(c)
                copies.append(xxhash.xxh64_intdigest("\x1f".join(_fields(head))) - (1 << 63))
            if ids:
                d, h = own.sets(texts) if texts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
                edge = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(texts)))]) * FEATURE_BYTES
                packed = pack(h).tobytes()
                features: list[bytes | None] = [None] * len(ids)
                for i, at in enumerate(where):
                    features[at] = packed[edge[i] : edge[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(copies, pa.int64()), pa.array(features, pa.binary())], names=["row_id", "class", "copy", "features"]
                )

    own = chunks if every else chunks.where(F.col("content").isNotNull() & F.col("row_id").isNotNull())
    got = own.select("row_id", "content").mapInArrow(read, "row_id BIGINT, class BIGINT, copy BIGINT, features BINARY")
    return cut(got, "records")


def _sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, size, document of each feature, feature) of a batch of (class, features)."""
    packed = b.column(1).to_pylist()
    size = np.array([len(x) // FEATURE_BYTES for x in packed], dtype=np.int64)
    return b.column(0).to_numpy(zero_copy_only=False), size, np.repeat(np.arange(len(size)), size), unpack(b"".join(packed))


def bits_for(sets: DataFrame) -> int:
    """Parts of the domain, as a power of two, from the number of features."""
    total = sets.agg(F.sum(F.octet_length("features"))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(1, total / FEATURE_BYTES / PART_LOAD))), MIN_DOMAIN_BITS, MAX_DOMAIN_BITS))


def level(count: np.ndarray | float) -> np.ndarray:
    """A count as a logarithm in one byte: 0, 1, 2 and 3 are themselves apart, then STEPS an octave, rounded up."""
    return np.ceil(STEPS * np.log2(1 + np.asarray(count, dtype=np.float64)) - 1e-9).clip(0, 255).astype(np.uint8)


def part_counts(sets: DataFrame, *, bits: int) -> tuple[np.ndarray, int]:
    """(level of the occurrences of each part of the domain over the whole corpus, number of features).

    The tables are summed in as many tasks as the cluster has cores, so what is shuffled is a table a core, not one an input split.
    """
    shift = np.uint64(8 * FEATURE_BYTES - bits)
    cores = sets.sparkSession.sparkContext.defaultParallelism

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.uint32)
        for b in batches:
            np.add.at(total, (_sets(b)[3] >> shift).astype(np.int64), np.uint32(1))
        for k in range(0, 1 << bits, _BLOCK):
            own = total[k : k + _BLOCK]
            if own.any():
                small = own.astype(np.uint8 if own.max() < 256 else np.uint16 if own.max() < 65536 else np.uint32)
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // _BLOCK], pa.int32()), "width": pa.array([small.itemsize], pa.int32()), "counts": pa.array([small.tobytes()], pa.binary())})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_BLOCK, dtype=np.int64)
        for b in batches:
            for width, x in zip(b["width"], b["counts"]):
                own = np.frombuffer(x, dtype=f"u{width}")
                total[: len(own)] += own
        yield pd.DataFrame({"block": [key[0]], "levels": [level(total).tobytes()], "features": [int(total.sum())]})

    summed = sets.coalesce(cores).mapInArrow(count, "block INT, width INT, counts BINARY").groupBy("block").applyInPandas(add, "block INT, levels BINARY, features BIGINT")
    out, features = np.zeros(1 << bits, dtype=np.uint8), 0
    for r in summed.collect():  # at most 2**MAX_DOMAIN_BITS bytes in all
        own = np.frombuffer(r.levels, dtype=np.uint8)[: len(out) - r.block * _BLOCK]
        out[r.block * _BLOCK : r.block * _BLOCK + len(own)] = own
        features += r.features
    return out, features


def asked_of(size, threshold: float):
    """How many signatures two similar sets share at least, by the smaller size; works on arrays."""
    return np.minimum(1 + size // 32, np.ceil(threshold * size - 1e-9).astype(np.int64))


def prefixes(size: np.ndarray, rare: np.ndarray, *, threshold: float, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of so many features, so many of them rare: (prefix of all features for single ones, prefix of the frequent features
    for pairs, whether the set is so small that its frequent features go single too)."""
    r, ask = (1 - threshold) / threshold, asked_of(size, threshold)
    single = np.minimum(size, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + ask)
    # fewer than ``ask`` shared features are rare: at most this many frequent ones of the set are not shared
    often = size - rare
    apart = (r * (often + ask - 1) - rare + ask - 1) / (1 + r)
    pairs = np.where(apart < 0, 0, np.minimum(often, np.floor(np.maximum(apart, 0) * (gap + 2) / (gap + 1) + 1e-9).astype(np.int64) + 1 + ask))
    # the argument asks for threshold * size * (1 - r / (gap + 1)) >= 2 * ask + 2 shared features; smaller sets meet partners of their band only
    n = np.arange(1, 4096)
    short = threshold * n * (1 - r / (gap + 1)) < 2 * asked_of(n, threshold) + 2
    bound = (n[short].max() if short.any() else 0) / threshold + 1
    return single, pairs, size <= bound if not short.all() else np.ones(len(size), dtype=bool)


def signatures(sets: DataFrame, levels: np.ndarray, features: int, *, threshold: float, bits: int, frequent: int, gap: int = GAP) -> DataFrame:
    """(sig, class, n, s1, s2): the signatures of every class, with its size and odd sketch."""
    shared = sets.sparkSession.sparkContext.broadcast(levels)
    rare_up_to = int(level(frequent + 2 * features / (1 << bits)))

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, size, d, h = _sets(batch)
            if len(h):
                s, o, sketch = enumerate_signatures(size, d, h, shared.value, rare_up_to, threshold=threshold, bits=bits, gap=gap)
                yield pa.RecordBatch.from_pydict({"sig": s.view(np.int64), "class": owner[o], "n": size[o].astype(np.int32)} | {f"s{i}": x[o].view(np.int64) for i, x in enumerate(sketch, 1)})

    return sets.mapInArrow(enumerate_, "sig BIGINT, class BIGINT, n INT, s1 BIGINT, s2 BIGINT")


def enumerate_signatures(
    size: np.ndarray, d: np.ndarray, h: np.ndarray, levels: np.ndarray, rare_up_to: int, *, threshold: float, bits: int, gap: int
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(signature, its set, odd sketches of the sets) of sets given flat: set of each feature, feature."""
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    mixed = _mix(h)
    word, one = mixed % np.uint64(SKETCH_BITS // 64), np.uint64(1) << ((mixed >> np.uint64(32)) & np.uint64(63))
    sketch = [np.bitwise_xor.reduceat(np.where(word == i, one, np.uint64(0)), start) for i in range(SKETCH_BITS // 64)]
    w = levels[(h >> np.uint64(8 * FEATURE_BYTES - bits)).astype(np.int64)]
    order = np.lexsort((h, w, d))
    h, w = h[order], w[order]
    is_rare = w <= rare_up_to
    rare = np.add.reduceat(is_rare.astype(np.int64), start)
    single, pairs, small = prefixes(size, rare, threshold=threshold, gap=gap)
    rank = np.arange(len(h)) - start[d]
    # small sets have single signatures of all their prefix besides the pairs
    alone = (rank < single[d]) & (is_rare | small[d]) & (w > level(1))  # a part met once has no partner
    sig, of = [h[alone]], [d[alone]]
    often = rank - rare[d]  # place among the frequent ones
    for step in range(1, gap + 2):
        i = np.flatnonzero((d[:-step] == d[step:]) & (often[:-step] >= 0) & (often[step:] < pairs[d[step:]])) if len(h) > step else np.zeros(0, dtype=np.int64)
        a, b = np.minimum(h[i], h[i + step]), np.maximum(h[i], h[i + step])
        sig.append(_mix(a * np.uint64(3) + _mix(b)) >> np.uint64(64 - 8 * PAIR_BYTES))
        of.append(d[i])
    return np.concatenate(sig), np.concatenate(of), sketch


def candidate_pairs(sigs: DataFrame, threshold: float) -> DataFrame:
    """Class pairs that share as many signatures as similar sets must, and that size and sketch leave possible."""
    rows = sigs.repartition("sig").dropDuplicates(["sig", "class"])
    a, b = rows.alias("a"), rows.alias("b")
    least = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(2, SKETCH_BITS // 64 + 1)), F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))))
    n = F.col("a.n") + F.col("b.n")
    small = F.least("a.n", "b.n")
    possible = (
        (F.col("a.class") < F.col("b.class"))
        & (least <= n * F.lit((1 - threshold) / (1 + threshold)) + 1e-6)
        & (small >= F.greatest("a.n", "b.n") * F.lit(threshold) - 1e-6)
    )
    met = a.join(b.hint("merge"), (F.col("a.sig") == F.col("b.sig")) & possible).select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b"), small.alias("n"))
    counted = met.groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("met"), F.min("n").alias("n"))
    asked = F.least(F.lit(1) + F.floor(F.col("n") / 32), F.ceil(F.col("n") * F.lit(threshold) - 1e-9))
    return counted.where(F.col("met") >= asked).select("class_a", "class_b")


def _bitmap(classes: DataFrame, bits: int) -> np.ndarray:
    """Packed bitmap of class ids, of fixed size; it only saves shuffling, as the join after it is exact."""
    block = _BLOCK // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            own[(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(own)
        at = [k for k in range(0, len(packed), block) if packed[k : k + block].any()]
        if at:
            yield pa.RecordBatch.from_pydict({"block": pa.array([k // block for k in at], pa.int32()), "marks": pa.array([packed[k : k + block].tobytes() for k in at], pa.binary())})

    def join(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(block, dtype=np.uint8)
        for b in batches:
            for x in b["marks"]:
                own |= np.frombuffer(x, dtype=np.uint8)
        yield pd.DataFrame({"block": [key[0]], "marks": [own.tobytes()]})

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in classes.mapInArrow(mark, "block INT, marks BINARY").groupBy("block").applyInPandas(join, "block INT, marks BINARY").collect():
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(r.marks, dtype=np.uint8)
    return out


def similar_classes(rows: DataFrame, *, threshold: float, domain_bits: int | None = None, frequent: int = FREQUENT, gap: int = GAP, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """(class_a, class_b, shared, total) of ``records``: every pair of different texts at or above the threshold."""
    sets = rows.where(F.col("features").isNotNull()).select("class", "features")
    bits = bits_for(sets) if domain_bits is None else domain_bits
    levels, features = part_counts(sets, bits=bits)
    sigs = signatures(sets, levels, features, threshold=threshold, bits=bits, frequent=frequent, gap=gap)
    pairs = cut(candidate_pairs(sigs, threshold), "candidates")
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class"))
    wanted = rows.sparkSession.sparkContext.broadcast(_bitmap(ends, bitmap_bits))

    @pandas_udf("boolean")
    def asked(c: pd.Series) -> pd.Series:
        slot = (c.to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(64 - bitmap_bits)).astype(np.int64)
        return pd.Series(((wanted.value[slot >> 3] >> (7 - (slot & 7))) & 1).astype(bool))

    @pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(unpack(x), unpack(y), assume_unique=True)) for x, y in zip(a, b)], dtype="int32")

    own = sets.where(asked("class")).groupBy("class").agg(F.first("features").alias("features"))
    a = own.select(F.col("class").alias("class_a"), F.col("features").alias("fa"))
    b = own.select(F.col("class").alias("class_b"), F.col("features").alias("fb"))
    both = pairs.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", common("fa", "fb").alias("shared"), ((F.octet_length("fa") + F.octet_length("fb")) / FEATURE_BYTES).cast("int").alias("sum"))
    return both.select("class_a", "class_b", "shared", (F.col("sum") - F.col("shared")).alias("total")).where(F.col("shared") >= F.col("total") * F.lit(threshold) - 1e-9)


def similar_rows(chunks: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, **tuning: int) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: all pairs of similar rows that are not copies.

    Pairs of different texts come from the class pairs; rows of one text pair up across their copy groups only,
    so a hot group of copies is never joined with itself.
    """
    got = records(chunks, shingle=shingle, min_words=min_words)
    linked = similar_classes(got, threshold=threshold, **tuning)
    rows = got.select("row_id", "class", "copy")
    a = rows.select(F.col("row_id").alias("x"), F.col("class").alias("class_a"))
    b = rows.select(F.col("row_id").alias("y"), F.col("class").alias("class_b"))
    across = linked.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("x", "y")
    groups = rows.select("class", "copy").distinct()
    mixed = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(groups, "class").select("class", "copy")
    g, h = mixed.alias("g"), mixed.alias("h")
    crossed = g.join(h, (F.col("g.class") == F.col("h.class")) & (F.col("g.copy") < F.col("h.copy"))).select(F.col("g.class").alias("class"), F.col("g.copy").alias("ca"), F.col("h.copy").alias("cb"))
    within = (
        crossed.join(rows.select("class", F.col("copy").alias("ca"), F.col("row_id").alias("x")), ["class", "ca"])
        .join(rows.select("class", F.col("copy").alias("cb"), F.col("row_id").alias("y")), ["class", "cb"])
        .select("x", "y")
    )
    return across.unionByName(within).select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def near_duplicate_groups(chunks: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, rounds: int = 50, **tuning: int) -> DataFrame:
    """(row_id, group_id, links), one row a row of the table: connected groups of similar texts, copies collapsed.

    group_id is the least class id of the group; a row that takes no part (null content, few words) is a group of its
    own, named by its row_id, with 0 links. Label propagation with pointer jumping over the class links; each round is written to the shared folder, and it
    stops when no label changes, so nothing but a count reaches the driver.
    """
    rows = records(chunks, shingle=shingle, min_words=min_words, every=True)
    links = similar_classes(rows, threshold=threshold, **tuning).select("class_a", "class_b")
    edges = cut(links.unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"))), "links")
    label = edges.groupBy("class_a").agg(F.min("class_b").alias("m"), F.count(F.lit(1)).alias("links")).select(F.col("class_a").alias("class"), F.least("class_a", "m").alias("label"), "links")
    label = cut(label, "labels")
    for _ in range(rounds):
        near = edges.join(label.select(F.col("class").alias("class_b"), "label"), "class_b").groupBy(F.col("class_a").alias("class")).agg(F.min("label").alias("near"))
        step = label.join(near, "class").select("class", F.least("label", "near").alias("label"), "links", F.col("label").alias("old"))
        up = step.select(F.col("class").alias("label"), F.col("label").alias("up"))
        jump = cut(step.join(up, "label", "left").select("class", F.least("label", F.coalesce("up", "label")).alias("label"), "links", "old"), "labels")
        label = jump.drop("old")
        if jump.where(F.col("label") != F.col("old")).limit(1).count() == 0:
            break
    else:
        raise RuntimeError("labels still change; raise rounds")
    took = rows.where(F.col("class").isNotNull()).join(label, "class", "left").select("row_id", F.coalesce("label", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    alone = rows.where(F.col("class").isNull()).select("row_id", F.col("row_id").alias("group_id"), F.lit(0).cast("bigint").alias("links"))
    return took.unionByName(alone)
