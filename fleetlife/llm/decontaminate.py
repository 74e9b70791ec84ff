"""Benchmark decontamination with BM25 and block-max WAND.

Index: every benchmark item's words with their BM25 impact, divided by the item's score for itself and held as
whole millionths, so that a passage with all words of an item scores about 1 and sums are exact. Postings are in
blocks with their largest impact. Query: passages are windows of twice the longest item's words, each starting
that many words after the one before, so that every item-length stretch lies whole in some passage. Block-max
WAND returns every item whose score reaches the threshold. For each, the question (all sentences but the last)
and the answer (the last; both are the whole item if it has one sentence) must each have ``OVERLAP`` of their
``GRAM``-word shingles in the passage.

A passage is skipped without a query only where no item can reach the threshold. Each item's commonest words are
set aside as long as they hold at most ``ASIDE`` of its score; what the passage has of the item's other words, each
counted once per half passage, must make up the rest.

The index is broadcast in parts of at most ``ITEMS_PER_INDEX`` items; a larger benchmark takes more passes.

Words are lower-cased and cut at white space and ASCII punctuation. Defined results: null or empty text,
and items without a word, match nothing; equal items are separate items; a part shorter than a shingle is one
shingle; repeated rows are judged each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

THRESHOLD, OVERLAP, GRAM, BLOCK, ASIDE = 0.6, 0.8, 5, 16, 0.3
K1, B = 1.2, 0.75
ITEMS_PER_INDEX = 20_000
UNIT = 1_000_000
_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_LAST = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def _parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item."""
    found = [w for s in _LAST.split(text) if (w := words(s))]
    if len(found) < 2:
        return words(text), words(text)
    return [w for s in found[:-1] for w in s], found[-1]


def shingles(found: list[bytes], size: int = GRAM) -> set[tuple[bytes, ...]]:
    if len(found) < size:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(size))))


class Index:
    """Inverted index of some items. ``postings``: word -> (items, impacts, block ends, block maxima, maximum)."""

    def __init__(self, items: pd.DataFrame, idf: dict[bytes, float], mean_words: float, threshold: float):
        self.least = round(threshold * UNIT)
        self.ids, self.parts, self.longest, self.needs, own = [], [], 1, [], []
        lists: dict[bytes, list[tuple[int, int]]] = {}
        for item, text in zip(items["item_id"], items["text"]):
            found = words(text)
            if not found:
                continue
            place = len(self.ids)
            self.ids.append(item)
            self.parts.append(tuple(map(shingles, _parts(text))))
            self.longest = max(self.longest, len(found))
            count = {w: found.count(w) for w in dict.fromkeys(found)}
            raw = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(found) / mean_words)) for w, n in count.items()}
            whole = sum(raw.values())
            impact = {w: round(UNIT * v / whole) for w, v in raw.items()}
            own.append(impact)
            for w in impact:
                lists.setdefault(w, []).append((place, impact[w]))
        self.postings = {}
        for w, posts in lists.items():
            at, value = [p for p, _ in posts], [v for _, v in posts]
            ends = at[BLOCK - 1::BLOCK] + ([at[-1]] if len(at) % BLOCK else [])
            tops = [max(value[i:i + BLOCK]) for i in range(0, len(value), BLOCK)]
            self.postings[w] = (at, value, ends, tops, max(value))
        self.marked: dict[bytes, list[tuple[int, int]]] = {}
        for place, impact in enumerate(own):
            aside = 0
            for w in sorted(impact, key=lambda w: (-len(lists[w]), w)):
                if aside + impact[w] <= ASIDE * UNIT:
                    aside += impact[w]
                else:
                    self.marked.setdefault(w, []).append((place, impact[w]))
            self.needs.append(self.least - aside)
        self.marks = frozenset(self.marked)

    def passages(self, found: list[bytes]) -> list[int]:
        """First words of the passages in which some item may reach the threshold."""
        step, out, before, alone, needs = self.longest, [], {}, False, self.needs
        for start in range(0, len(found), step):
            now: dict[int, int] = {}
            for w in self.marks.intersection(found[start:start + step]):
                for place, impact in self.marked[w]:
                    now[place] = now.get(place, 0) + impact
            if alone or any(v + before.get(p, 0) >= needs[p] for p, v in now.items()):
                out.append(max(0, start - step))
            before, alone = now, any(v >= needs[p] for p, v in now.items())
        return out

    def search(self, query: set[bytes]) -> list[tuple[int, int]]:
        """(item place, score) of all items at the threshold or above: block-max WAND."""
        cursors = [[*self.postings[w], 0] for w in query if w in self.postings]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[5]])
            bound, pivot = 0, None
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= self.least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0][cursors[pivot][5]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][5]] == item:
                pivot += 1
            lead = cursors[:pivot + 1]
            blocks = [bisect_left(c[2], item) for c in lead]
            if sum(c[3][b] if b < len(c[3]) else 0 for c, b in zip(lead, blocks)) < self.least:
                # No item before the nearest block end, or the next list, can reach it.
                step = min([c[2][b] + 1 for c, b in zip(lead, blocks) if b < len(c[2])]
                           + [c[0][c[5]] for c in cursors[pivot + 1:pivot + 2]])
                item = max(step, item + 1)
            elif lead[0][0][lead[0][5]] == item:
                score = sum(c[1][c[5]] for c in lead)
                if score >= self.least:
                    out.append((item, score))
                item += 1
            for c in lead:
                c[5] = bisect_left(c[0], item, c[5])
            cursors = [c for c in cursors if c[5] < len(c[0])]
        return out

    def leaks(self, text: str | None) -> dict[int, tuple[int, float, float, int]]:
        """Verified items of a text: place -> (score, question overlap, answer overlap, first word)."""
        found = words(text)
        best: dict[int, tuple[int, float, float, int]] = {}
        step = self.longest
        for start in self.passages(found):
            passage = found[start:start + 2 * step]
            near = None
            for place, score in self.search(set(passage)):
                if near is None:
                    near = shingles(passage)
                q, a = (self._share(part, near, passage) for part in self.parts[place])
                if min(q, a) >= OVERLAP and (place not in best or (score, -start) > (best[place][0], -best[place][3])):
                    best[place] = (score, q, a, start)
        return best

    @staticmethod
    def _share(part: set, near: set, passage: list[bytes]) -> float:
        short = next(iter(part))
        if len(short) < GRAM:  # a part of a few words: they must stand together
            return float(any(tuple(passage[i:i + len(short)]) == short for i in range(len(passage) - len(short) + 1)))
        return len(part & near) / len(part)


def _statistics(items: DataFrame) -> tuple[int, float]:
    @F.pandas_udf("long")
    def length(text: pd.Series) -> pd.Series:
        return text.map(lambda t: len(words(t)))

    row = items.select(length(F.col("text")).alias("n")).where("n > 0").agg(F.count("*"), F.avg("n")).first()
    return row[0], row[1] or 1.0


def _document_frequency(items: DataFrame) -> DataFrame:
    @F.pandas_udf("array<binary>")
    def own(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted(set(words(t))))

    return items.select(F.explode(own(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of every verified pair."""
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    schema = "doc_id string, item_id string, score long, question_overlap double, answer_overlap double, first_word long"
    items = items.select(F.col("item_id").cast("string"), "text")
    n, mean_words = _statistics(items)
    count = items.count()
    shards = max(1, -(-count // ITEMS_PER_INDEX))
    frequency = _document_frequency(items)
    texts = docs.select(F.col("doc_id").cast("string"), "text")
    sides = []
    for shard in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        table = own.toPandas().sort_values(["item_id", "text"])  # about ITEMS_PER_INDEX rows
        vocabulary = _document_frequency(own).select("word")
        df = frequency.join(vocabulary, "word", "left_semi").toPandas()
        idf = {bytes(w): float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for w, d in zip(df["word"], df["df"])}
        index = docs.sparkSession.sparkContext.broadcast(Index(table, idf, mean_words, threshold))

        def run(batches, index=index):
            for batch in batches:
                rows = [(doc, index.value.ids[k], *v) for doc, text in zip(batch["doc_id"], batch["text"])
                        for k, v in sorted(index.value.leaks(text).items())]
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
                yield plain(pd.DataFrame(rows, columns=names), "doc_id", "item_id")

        sides.append(texts.mapInPandas(run, schema))
    out = reduce(DataFrame.unionByName, sides)
    return out.withColumns({"doc_id": F.col("doc_id").cast(kind), "item_id": F.col("item_id").cast(item_kind),
                            "score": F.col("score") / UNIT})


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a verified pair; the columns of ``docs``. Judged row by row, not joined back."""
    keyed = docs.withColumn("_d_row", F.struct("doc_id", F.xxhash64("text").alias("h")))
    found = leaks(keyed.select(F.to_json("_d_row").alias("doc_id"), "text"), items, threshold).select("doc_id").distinct()
    return keyed.join(found.withColumnRenamed("doc_id", "_d_leak"), F.to_json("_d_row") == F.col("_d_leak"), "left_anti").select(*docs.columns)
