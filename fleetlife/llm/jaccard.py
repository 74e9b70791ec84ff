"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set is its distinct word shingles as 64-bit hashes; equal sets are one class, joined once. Two classes
link when ``of * intersection >= at_least * union``. Let t be the share at_least / of.

* Probe sets. Of n shingles, linked sets miss at most n - ceil(t n). The n - ceil(t n) + k smallest hashes of either
  therefore hold k common ones at least. Only these are shuffled. A shingle that no other class has in its probe set
  can't be common; a class with fewer than k others has no link.
* Index. Of what is left, ordered by how few classes have it, a prefix must meet the partner's prefix. Its shingles
  are the posting lists, in order of set size. Neighbours in a list whose sizes may link are joined to clusters: no
  list makes pairs of all its members.
* Blocks. The classes of a cluster lie in blocks by size; block pairs whose size ranges can't link are skipped. In a
  block pair the overlaps with one set, the leader, are computed, and all others are derived from them: with D(x) the
  differences of x from leader L, |a & b| = |L| - |L \\ a| - |L \\ b| + |D(a) & D(b)|, so that shingles that a and b
  share with the leader are never looked at again.

Every link between different sets is found; links are counted and joined to components without emitting them.

Defined results: null or empty text, or text without words, has an empty set, no links and itself as component; with
fewer words than a shingle has, the whole sequence is the only shingle. Rows with a null doc_id take part and count;
a component's id is its smallest doc_id. Repeated rows are copies of each other. Extra columns are ignored. A text is known
by its doc_id (null or not) and two hashes of the text, so texts that share an id are told apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, partitions, stored
from .components import components

SIZE, AT_LEAST, OF = 4, 85, 100
SPARE = 0.15
BLOCK, COLUMNS, CACHE_WORDS = 256, 8192, 300_000
TEXT = ["h1", "h2"]
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the two hashes that name the text."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit hash, in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, "<u8")
    if len(found) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], "<u8")
    h = np.fromiter(map(words.__getitem__, found), "<u8", len(found))
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = out * _MIX[0] + h[k:n + k]
    return np.unique(_mixed(out))


def class_of(found: np.ndarray) -> int:
    """The class of a set as a signed long."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found)))))


class Sizes:
    """Lengths that follow from a set's size, in whole numbers."""

    def __init__(self, at_least: int, of: int):
        self.at_least, self.of = at_least, of

    def same(self, n):
        """Elements that a set of n must share with a partner, at least."""
        return -(-self.at_least * n // self.of)

    def spare(self, n):
        return np.maximum(1, (SPARE * n).astype("int64")) if isinstance(n, np.ndarray) else max(1, int(SPARE * n))

    def probe(self, n):
        """Size of the probe set."""
        return n - self.same(n) + self.spare(n)

    def common(self, n):
        """Common elements in the probe sets, at least, with any partner."""
        return self.spare(self.same(n))


def _chunks(buckets: np.ndarray, n_buckets: int, **columns: np.ndarray):
    """Rows (bucket, packed columns) of parallel arrays."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    for b in range(n_buckets):
        if edges[b] < edges[b + 1]:
            at = order[edges[b]:edges[b + 1]]
            yield b, {k: v[at].tobytes() for k, v in columns.items()}


def _joined(group: pd.DataFrame, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(group[name]), kind)


def sets(docs: DataFrame, size: int, sizes: Sizes, buckets: int) -> DataFrame:
    """Two kinds of rows from one reading. Documents: doc_id, n, class. Probe sets, packed by range of the hash:
    bucket, and parallel arrays of hashes, classes and set sizes, each class once per batch."""
    def run(batches):
        words = Words()
        for batch in batches:
            rows, probes, owner, counts = [], [], [], []
            seen: set[int] = set()
            for doc, text, h1, h2 in zip(batch["doc_id"], batch["text"], batch["h1"], batch["h2"]):
                found = shingle_set(text, size, words)
                n = len(found)
                own = class_of(found) if n else None
                rows.append({"doc_id": doc, "n": n, "class": own, "h1": h1, "h2": h2})
                if n and own not in seen:
                    seen.add(own)
                    probes.append(found[:sizes.probe(n)])
                    owner.append(own)
                    counts.append(n)
            yield rows
            if probes:
                h = np.concatenate(probes)
                each = np.repeat(np.arange(len(probes), dtype="<u4"), [len(p) for p in probes])
                where = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                table = {"classes": np.array(owner, "<i8").tobytes(), "sizes": np.array(counts, "<u4").tobytes()}
                made = [{"bucket": int(b), **table, **c} for b, c in _chunks(where, buckets, hashes=h, owners=each)]
                for m in made:  # only the classes that the chunk has
                    used, own = np.unique(np.frombuffer(m["owners"], "<u4"), return_inverse=True)
                    m["owners"] = own.astype("<u4").tobytes()
                    m["classes"] = np.array(owner, "<i8")[used].tobytes()
                    m["sizes"] = np.array(counts, "<u4")[used].tobytes()
                yield made

    schema = ("doc_id string, n long, class long, h1 long, h2 long, bucket int, hashes binary, owners binary, classes binary, sizes binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def whole(batches):
        for rows in run(batches):
            yield pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k in names})

    return _keyed(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(whole, schema)


def _unpack(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, size) of all entries of a bucket's chunks, one per (hash, class)."""
    h, c, n = [], [], []
    for hashes, owners, classes, counts in zip(group["hashes"], group["owners"], group["classes"], group["sizes"]):
        own = np.frombuffer(owners, "<u4")
        h.append(np.frombuffer(hashes, "<u8"))
        c.append(np.frombuffer(classes, "<i8")[own])
        n.append(np.frombuffer(counts, "<u4")[own])
    h, c, n = np.concatenate(h), np.concatenate(c), np.concatenate(n)
    order = np.lexsort((c, h))
    h, c, n = h[order], c[order], n[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return h[fresh], c[fresh], n[fresh]


def _run_lengths(sorted_keys: np.ndarray) -> np.ndarray:
    """For each entry, how many entries have its key."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    lengths = np.diff(np.concatenate([first, [len(sorted_keys)]]))
    return np.repeat(lengths, lengths)


def shared_probes(chunks: DataFrame, buckets: int) -> DataFrame:
    """Probe entries whose shingle two classes or more have, packed by class: hashes, classes, sizes, uses."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        h, c, n = _unpack(group)
        uses = _run_lengths(h)
        keep = uses > 1
        h, c, n, uses = h[keep], c[keep], n[keep], uses[keep].astype("<u4")
        where = (c.view("<u8") >> np.uint64(33)) % np.uint64(buckets)
        rows = [{"bucket": int(b), **x} for b, x in _chunks(where, buckets, hashes=h, classes=c, sizes=n, uses=uses)]
        return pd.DataFrame(rows, columns=["bucket", "hashes", "classes", "sizes", "uses"])

    return chunks.groupBy("bucket").applyInPandas(run, "bucket int, hashes binary, classes binary, sizes binary, uses binary")


def prefixes(shared: DataFrame, sizes: Sizes, buckets: int) -> DataFrame:
    """The index entries of each class, packed by hash: hashes, classes, sizes."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        h, c = _joined(group, "hashes", "<u8"), _joined(group, "classes", "<i8")
        n, uses = _joined(group, "sizes", "<u4").astype("int64"), _joined(group, "uses", "<u4")
        order = np.lexsort((h, uses, c))
        h, c, n = h[order], c[order], n[order]
        shared_ = _run_lengths(c)
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, int)
        place = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate([first, [len(c)]]))) if len(c) else first
        length = sizes.probe(n)
        wanted = length - sizes.common(n) + 1  # prefix of the probe set, with its unshared shingles first
        keep = (shared_ >= sizes.common(n)) & (place < wanted - (length - shared_))
        h, c, n = h[keep], c[keep], n[keep].astype("<u4")
        where = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        rows = [{"bucket": int(b), **x} for b, x in _chunks(where, buckets, hashes=h, classes=c, sizes=n)]
        return pd.DataFrame(rows, columns=["bucket", "hashes", "classes", "sizes"])

    return shared.groupBy("bucket").applyInPandas(run, "bucket int, hashes binary, classes binary, sizes binary")


def candidates(index: DataFrame, sizes: Sizes) -> DataFrame:
    """Edges (a, b) between neighbours of a posting list, in order of set size, that may link."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        h, c, n = (_joined(group, k, t) for k, t in (("hashes", "<u8"), ("classes", "<i8"), ("sizes", "<u4")))
        order = np.lexsort((c, n, h))
        h, c, n = h[order], c[order], n[order].astype("int64")
        meet = (h[1:] == h[:-1]) & (n[:-1] * sizes.of >= sizes.at_least * n[1:])
        a, b = c[:-1][meet], c[1:][meet]
        edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pd.DataFrame(edges, columns=["a", "b"])

    return index.groupBy("bucket").applyInPandas(run, "a long, b long")


def overlaps(found: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, derived from the first set's by what differs from it."""
    leader, m = found[0], len(found)
    minus, owner, element = np.zeros(m, "int64"), [], []
    for i, s in enumerate(found):
        differs = np.setxor1d(s, leader, assume_unique=True)
        minus[i] = (len(leader) + len(differs) - len(s)) // 2
        owner.append(np.full(len(differs), i))
        element.append(differs)
    element, owner = np.concatenate(element), np.concatenate(owner)
    both = len(leader) - minus[:, None] - minus[None, :]
    names, at, uses = np.unique(element, return_inverse=True, return_counts=True)
    twice = uses > 1
    np.add.at(both, (np.arange(m), np.arange(m)), np.bincount(owner[~twice[at]], minlength=m))
    place = np.cumsum(twice) - 1
    owner, at = owner[twice[at]], place[at[twice[at]]]
    for start in range(0, int(twice.sum()), COLUMNS):
        part = (at >= start) & (at < start + COLUMNS)
        d = np.zeros((m, COLUMNS), "float32")
        d[owner[part], at[part] - start] = 1
        both += np.rint(d @ d.T).astype("int64")
    return both


def _links(own: pd.DataFrame, other: pd.DataFrame | None, sizes: Sizes) -> tuple[list, list]:
    """Counts (class, documents linked) and edges of the links inside a block, or between two blocks."""
    counts, edges = [], []
    table = own.assign(side=0) if other is None else pd.concat([own.assign(side=0), other.assign(side=1)])
    for _, part in table.groupby("cluster", sort=False):
        if len(part) < 2 or other is not None and part["side"].nunique() < 2:
            continue
        found = [np.frombuffer(s, "<u8") for s in part["shingles"]]
        n = np.array([len(s) for s in found])
        both = overlaps(found)
        linked = sizes.of * both >= sizes.at_least * (n[:, None] + n[None, :] - both)
        side = part["side"].to_numpy()
        linked &= side[:, None] != side[None, :] if other is not None else ~np.eye(len(n), dtype=bool)
        weight = linked @ part["copies"].to_numpy("int64")
        names = part["class"].to_numpy("int64")
        counts += [(int(names[i]), int(weight[i])) for i in np.flatnonzero(weight)]
        label = np.arange(len(n))  # only a spanning set of the links leaves the block
        near = linked | np.eye(len(n), dtype=bool)
        while True:
            new = np.where(near, label[None, :], len(n)).min(axis=1)
            if (new == label).all():
                break
            label = new
        edges += [(int(names[i]), int(names[label[i]])) for i in range(len(n)) if label[i] != i]
    return counts, edges


def link_blocks(members: DataFrame, sizes: Sizes) -> DataFrame:
    """(class, linked, root): link counts, and edges of a spanning set of links, from members (class, cluster, n,
    copies, shingles)."""
    placed = numbered(members.select("cluster", "n", "class", "copies", "shingles"), ["cluster", "n", "class"], "_i")
    placed = stored(placed.withColumn("block", F.floor(F.col("_i") / BLOCK)).drop("_i"))
    spans = placed.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one = spans.select("cluster", F.col("block").alias("p"), F.col("high").alias("p_high"))
    two = spans.select("cluster", F.col("block").alias("q"), F.col("low").alias("q_low"))
    far = (one.join(two, "cluster").where((F.col("p") < F.col("q"))
           & (F.col("p_high") * sizes.of >= F.col("q_low") * sizes.at_least)).select("p", "q").distinct())
    pairs = far.union(placed.select(F.col("block").alias("p"), F.col("block").alias("q")).distinct())
    wanted = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    body = F.collect_list(F.struct("class", "cluster", "copies", "shingles")).alias("rows")
    packed = stored(placed.groupBy("block").agg(body))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tables = [pd.DataFrame(list(rows)) for _, rows in sorted(zip(group["block"], group["rows"]), key=lambda x: x[0])]
        counts, edges = _links(tables[0], tables[1] if len(tables) > 1 else None, sizes)
        return pd.DataFrame([(c, n, None) for c, n in counts] + [(a, 0, b) for a, b in edges],
                            columns=["class", "linked", "root"], dtype=object)

    return wanted.join(packed, "block").groupBy("p", "q").applyInPandas(run, "class long, linked long, root long")


def join(docs: DataFrame, size: int = SIZE, at_least: int = AT_LEAST, of: int = OF) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class (equal sets; null for empty ones), n_links
(other documents that link, copies included), the hashes h1 and h2 of the text, and is_first (the row has the smallest
doc_id, null last, then hashes, of its component)."""
    sizes, buckets = Sizes(at_least, of), partitions(docs)
    kind = docs.schema["doc_id"].dataType
    read = stored(sets(docs, size, sizes, buckets))
    rows = read.where("bucket IS NULL").select(F.col("doc_id").cast(kind).alias("doc_id"), "n", "class", *TEXT)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *TEXT)
    classes = stored(rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min(place).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")))
    index = prefixes(shared_probes(read.where("bucket IS NOT NULL"), buckets), sizes, buckets)
    clusters = components(candidates(index, sizes)).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    wanted = clusters.join(classes, "class")

    def build(batches):
        words = Words()
        for batch in batches:
            rows_ = [(c, g, n, k, s.tobytes()) for text, c, g, n, k in zip(
                batch["text"], batch["class"], batch["cluster"], batch["n"], batch["copies"])
                if len(s := shingle_set(text, size, words)) and class_of(s) == c]
            yield pd.DataFrame(rows_, columns=["class", "cluster", "n", "copies", "shingles"])

    texts = _keyed(docs)
    same = [wanted["rep.doc_id"].eqNullSafe(texts["doc_id"]), *(wanted[f"rep.{h}"] == texts[h] for h in TEXT)]
    sources = wanted.join(texts, same).select("text", "class", "cluster", "n", "copies")
    members = sources.mapInPandas(build, "class long, cluster long, n long, copies long, shingles binary")
    found = stored(link_blocks(members.dropDuplicates(["class"]), sizes))
    links = found.groupBy("class").agg(F.sum("linked").alias("_linked"))
    roots = components(found.where("root IS NOT NULL").select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = roots.join(classes.select(F.col("class").alias("node"), "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("_least"))
    answer = (classes.join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
              .join(least, "root", "left")
              .select("class", "copies", F.coalesce("_least", "rep").alias("_first"), F.coalesce("_linked", F.lit(0)).alias("_linked")))
    return rows.join(answer, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_first.doc_id", "doc_id").alias("component_id"), "class",
        (F.coalesce("_linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        *TEXT, F.coalesce(F.col("_first") == place, F.lit(True)).alias("is_first"))


def clean(docs: DataFrame, size: int, at_least: int, of: int) -> DataFrame:
    """One row of each component stays, that of the smallest doc_id; the columns of ``docs``. Rows go by doc_id and text:
    another text of the same id stays, and copies with a null id go. Texts without words all stay."""
    found = join(docs, size, at_least, of)
    keyed = docs.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit("second"), "text")})

    def matched(left: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        side = rows.select(F.col("doc_id").alias("_r_id"), *(F.col(h).alias(f"_r_{h}") for h in TEXT))
        on = [left["doc_id"].eqNullSafe(side["_r_id"]), *(left[f"_{h}"] == side[f"_r_{h}"] for h in TEXT)]
        return left.join(side, on, how)

    gone = found.where("NOT is_first").select("doc_id", *TEXT).distinct()
    # Rows repeated as they are: only these meet in an aggregation.
    again = (found.where("is_first AND class IS NOT NULL").groupBy("doc_id", *TEXT).agg(F.count("*").alias("n"))
             .where("n > 1"))
    kept = matched(keyed, gone, "left_anti")
    alone = matched(kept, again, "left_anti").select(*docs.columns)
    shared = matched(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return alone.unionByName(shared)
