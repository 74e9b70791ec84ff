"""SimHash near-dedup by anchor points of a covering code.

A fingerprint has one bit per bit of the shingles' hashes: 1 where over half of them have it set. Two link when at
most ``threshold`` bits differ. Equal fingerprints are one, whatever number of rows has them.

* Anchors. The perfect binary Golay code covers all words of 23 bits: exactly one codeword, the home, lies within three
  bits of a word. Anchors are the codewords of the first ``blocks`` times 23 bits; the other bits are free, so that the
  covering radius counts them whole. With one block there are 4096 anchors, with two 2 ** 24.
* Replication. If x and y differ in t bits and c is the home of x, then y lies within the covering radius plus t of c.
  So each fingerprint goes to every anchor within the radius plus the threshold: the codewords at up to 3 + threshold
  bits (71 of 4096 for a threshold of 3). They are found by the syndrome of the word: every anchor in reach is
  the word without an error pattern of that syndrome. With two blocks the threshold is shared out between them.
* Comparison. Per anchor, the fingerprints that are at home there are compared with all that came: a pair that links meets
  in the home of either. An anchor's fingerprints that are many are cut into blocks, and pairs of blocks are compared, so
  that no task holds more than two blocks. Only a spanning set of an anchor's links leaves it.

Nothing is approximate: no link is lost for any number of blocks. One block serves up to ``ONE_BLOCK`` fingerprints; two give
smaller groups for more copies.

Defined results: null or empty text, or text without words, has no shingles and the fingerprint zero, which links like
any other; with fewer words than a shingle has, the whole sequence is the only shingle. Rows with a null doc_id take
part; a component's id is its smallest doc_id, null where none has one. Repeated rows have the same fingerprint. Extra
columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

SHINGLE, THRESHOLD, SEED = 3, 3, 42
ONE_BLOCK, GROUP, CELLS = 1 << 23, 1 << 18, 1 << 22
#: Length, parity bits, covering radius and generator polynomial of the binary Golay code.
BITS, PARITY, RADIUS, GENERATOR = 23, 11, 3, 0xC75


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text, as an unsigned number of 64 bits."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, seed=SEED)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed=SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())), "<u8", n)
    counts = np.zeros(64, "int64")
    for at in range(0, n, 1 << 16):  # a long text takes little more memory than its hashes
        counts += np.unpackbits(hashes[at:at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long) for each row."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view("<i8"))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


class Golay:
    """Codewords near a word of 23 bits, by syndrome. Patterns of one syndrome are sorted by weight; ``reach[s, t]`` of
    them have at most RADIUS + t bits."""

    def __init__(self, threshold: int):
        unit = []
        for i in range(BITS):
            rest = 1 << i
            for bit in range(i, PARITY - 1, -1):
                if rest >> bit & 1:
                    rest ^= GENERATOR << (bit - PARITY)
            unit.append(rest)
        self.tables = [self._spread(unit[at:at + 8]) for at in (0, 8, 16)]
        single = np.array([1 << i for i in range(BITS)])
        patterns, weights = [np.zeros(1, "int64")], [np.zeros(1, "int64")]
        for w in range(1, RADIUS + threshold + 1):
            chosen = np.array(list(combinations(range(BITS), w)))
            patterns.append(np.bitwise_or.reduce(single[chosen], axis=1))
            weights.append(np.full(len(chosen), w))
        patterns, weights = np.concatenate(patterns), np.concatenate(weights)
        syndromes = self.syndrome(patterns)
        order = np.lexsort((patterns, weights, syndromes))
        self.patterns = patterns[order]
        self.excess = np.maximum(weights[order] - RADIUS, 0)
        self.start = np.searchsorted(syndromes[order], np.arange((1 << PARITY) + 1))
        self.reach = np.stack([np.bincount(syndromes[weights <= RADIUS + t], minlength=1 << PARITY) for t in range(threshold + 1)], axis=1)

    @staticmethod
    def _spread(units: list[int]) -> np.ndarray:
        """XOR of the chosen units for each choice as a byte."""
        table = np.zeros(256, "int64")
        for i, u in enumerate(units):
            table[np.arange(256) >> i & 1 == 1] ^= u
        return table

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.tables[0][words & 255] ^ self.tables[1][words >> 8 & 255] ^ self.tables[2][words >> 16]


def anchors(fps: np.ndarray, code: Golay, blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of each fingerprint and each anchor within the covering radius plus the threshold."""
    row = np.arange(len(fps))
    anchor, used = np.zeros(len(fps), "int64"), np.zeros(len(fps), "int64")
    for b in range(blocks):
        word = (fps[row] >> np.uint64(b * BITS)).astype("int64") & ((1 << BITS) - 1)
        syndrome = code.syndrome(word)
        many = code.reach[syndrome, threshold - used]
        entry = np.repeat(np.arange(len(row)), many)
        at = np.repeat(code.start[syndrome], many) + np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
        row, used = row[entry], used[entry] + code.excess[at]
        anchor = (anchor[entry] << (BITS - PARITY)) | ((word[entry] ^ code.patterns[at]) >> PARITY)
    return row, anchor, used == 0


def replicate(classes: DataFrame, blocks: int, threshold: int) -> DataFrame:
    """(anchor, homes, others): the fingerprints at each anchor, packed; ``homes`` are in their home there."""
    def run(batches):
        code = Golay(threshold)
        for batch in batches:
            fps = batch.column(0).to_numpy().view("<u8")
            for part in np.array_split(fps, max(1, len(fps) // 5000)):
                row, anchor, home = anchors(part, code, blocks, threshold)
                order = np.lexsort((~home, anchor))
                row, anchor, home = row[order], anchor[order], home[order]
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, int)
                last = np.append(first[1:], len(anchor))
                at_home = np.add.reduceat(home.astype("int64"), first) if len(first) else first
                here = part[row]
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor[first]),
                    pa.array([here[a:a + k].tobytes() for a, k in zip(first, at_home)], pa.binary()),
                    pa.array([here[a + k:b].tobytes() for a, b, k in zip(first, last, at_home)], pa.binary())],
                    ["anchor", "homes", "others"])

    return classes.select("fp").mapInArrow(run, "anchor long, homes binary, others binary")


class Forest:
    """Sets of numbers 0..n-1 merged by pairs; the name of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (self.parent != (up := self.parent[self.parent])).any():
                self.parent = up


def spanning_links(homes: np.ndarray, all_: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that span the links between ``homes`` and ``all_``."""
    names = np.unique(np.concatenate([homes, all_]))
    one, two = np.searchsorted(names, homes), np.searchsorted(names, all_)
    forest, step = Forest(len(names)), max(1, CELLS // max(1, len(all_)))
    for at in range(0, len(homes), step):
        near = np.bitwise_count(homes[at:at + step, None] ^ all_[None, :]) <= threshold
        i, j = np.nonzero(near)
        forest.merge(one[at:at + step][i], two[j])
    moved = np.flatnonzero(forest.parent != np.arange(len(names)))
    return names[moved], names[forest.parent[moved]]


def links(classes: DataFrame, blocks: int, threshold: int = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(a, b): pairs of fingerprints that span all links between the different fingerprints ``fp`` of ``classes``."""
    packed = stored(replicate(classes, blocks, threshold))
    sizes = packed.groupBy("anchor").agg(F.sum((F.length("homes") + F.length("others")) / 8).alias("_n"))
    many = sizes.where(F.col("_n") > group).select("anchor", F.ceil(F.col("_n") / group).cast("int").alias("_k"))
    dealt = packed.join(many, "anchor", "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn(
        "_own", F.pmod(F.xxhash64("homes", "others"), F.col("_k")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_k") - 1)
    nothing = F.lit(None).cast("binary")
    # With one block, homes and others stay together; else homes go to all blocks of others, and others to all of homes.
    alone = dealt.where("_k = 1").select("anchor", F.lit(0).alias("_i"), F.lit(0).alias("_j"), "homes", F.concat("homes", "others").alias("members"))
    split = dealt.where("_k > 1")
    grid = split.where(F.length("homes") > 0).select("anchor", F.col("_own").alias("_i"), F.explode(every).alias("_j"), "homes", nothing.alias("members")).union(
        split.select("anchor", F.explode(every).alias("_i"), F.col("_own").alias("_j"), nothing, F.concat("homes", "others")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        homes, members = (np.frombuffer(b"".join(x for x in rows[c] if x is not None), "<u8") for c in ("homes", "members"))
        a, b = spanning_links(homes, members, threshold)
        return pd.DataFrame({"a": a.view("<i8"), "b": b.view("<i8")})

    return alone.union(grid).groupBy("anchor", "_i", "_j").applyInPandas(run, "a long, b long")


def join(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, blocks: int | None = None, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reached by
    links. ``blocks``: None for the number that suits how many fingerprints there are."""
    rows = stored(fingerprints(docs, shingle))
    # The fingerprint comes with any of its rows; a NULL doc_id is no minimum.
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    if blocks is None:
        blocks = 1 if classes.count() <= ONE_BLOCK else 2
    roots = components(links(classes, blocks, threshold, group).distinct())
    named = stored(roots.join(classes, roots["node"] == classes["fp"]).select("fp", "root", "least"))
    least = named.groupBy("root").agg(F.min("least").alias("_least"))
    answer = classes.join(named.join(least, "root").select("fp", "_least"), "fp", "left").select(
        "fp", F.coalesce("_least", "least").alias("component_id"))
    return rows.join(answer, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
