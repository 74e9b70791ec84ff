"""Periodic runs of words by grammar-compressed run detection.

A run is a stretch of consecutive words with smallest period q and at least max(``min_length``, ``times`` * q) words that no
neighbouring word extends with period q. Texts are whole rows; several are handled together, with words numbered.

* Stretches. Every word of a run comes ``times`` times in it, so a word that comes less often in its text is in no run and
  cuts the text. The same holds inside what is left, and cutting goes on until nothing changes. Ordinary prose ends here.
* Grammar (Re-Pair). The most frequent pair of adjacent symbols becomes a rule, again and again: a pass takes the pairs with
  at least half the count of the most frequent one, in order of count, wherever they don't overlap. When no pair
  comes twice, neighbours are paired until a stretch is one symbol. Each rule keeps the word positions it derives.
* Runs of a rule. For X -> A B, the runs inside X that cross the boundary of A and B are found once, at one place of X:
  a run of period q has equal words q apart at the boundary or one period before it, and what it covers follows from the
  longest common extensions of the two places, cut at the ends of X. The extensions come from the names of the
  substrings of 1, 2, 4, ... words and are exact.
* Translation. A run of X stands at every position that X derives. The whole run in the text is the run of the
  lowest rule that contains it; any that a neighbouring word extends is a part of it and goes. Of equal stretches the smallest
  period stays.

Defined results: null or empty text has no words, no runs and the digest of the empty string; repeated rows give their result
each; a null doc_id is kept; other columns are not carried. A text is in one task as it is in one row; memory is a small
multiple of its words (names of one level per doubling of the longest stretch).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_LENGTH, TIMES = 6, 4
BATCH_WORDS, CELLS = 200_000, 1 << 20
RESULT = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, "int64")


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def stretches(words: np.ndarray, texts: np.ndarray, min_length: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that may lie in runs, and the stretch that each is in. ``words`` are numbers, ``texts`` the text of each."""
    at, part = np.arange(len(words)), texts
    while len(at):
        before = len(at), len(_starts(part))
        _, name, count = np.unique(part * (words.max() + 1) + words[at], return_inverse=True, return_counts=True)
        often = count[name] >= times
        at, part = at[often], part[often]
        if len(at):
            cut = np.ones(len(at), bool)
            cut[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
            fresh = np.cumsum(cut) - 1
            long = np.bincount(fresh)[fresh] >= min_length
            at, part = at[long], fresh[long]
        if (len(at), len(_starts(part))) == before:
            break
    return at, np.unique(part, return_inverse=True)[1]


class Extensions:
    """Longest common extensions of two places of a sequence, from names of its substrings of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n = len(symbols)
        self.names = [np.unique(symbols, return_inverse=True)[1].astype("int32")]
        size = 1
        while 2 * size <= longest:
            last = self.names[-1]
            pair = last[:-size].astype("int64") * (self.n + 1) + last[size:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype("int32"))
            size *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on (i < j)."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.names) - 1, -1, -1):
            names, size = self.names[level], 1 << level
            for _ in range(2 if level == len(self.names) - 1 else 1):
                ok = np.flatnonzero(j + size <= self.n)
                ok = ok[names[i[ok]] == names[j[ok]]]
                i[ok] += size
                j[ok] += size
        return i - start

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to and with i equal those up to j (i < j)."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.names) - 1, -1, -1):
            names, size = self.names[level], 1 << level
            for _ in range(2 if level == len(self.names) - 1 else 1):
                ok = np.flatnonzero(i - size >= -1)
                ok = ok[names[i[ok] - size + 1] == names[j[ok] - size + 1]]
                i[ok] -= size
                j[ok] -= size
        return start - i


def grammar(symbols: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules and where they stand: (rule, position, length of A, length of X) for every place that a rule derives. No rule
    crosses from one part to the next."""
    text = np.unique(symbols, return_inverse=True)[1].astype("int64")
    place, part = np.arange(len(text)), parts
    size = np.ones(len(text), "int64")
    free, made, out = int(text.max(initial=0)) + 1, 0, []
    while True:
        inside = part[1:] == part[:-1]
        if not inside.any():
            break
        pair = np.where(inside, text[:-1] * free + text[1:], -1)
        found, name, count = np.unique(pair, return_inverse=True, return_counts=True)
        count[found == -1] = 0
        most = count.max()
        if most >= 2:  # the frequent pairs, most frequent first; of pairs that overlap the better one
            rank = np.empty(len(count), "int64")
            rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
            rank = np.where(count >= max(2, (most + 1) // 2), rank, len(count))[name]
            run = _starts(rank)
            # Equal pairs in a row alternate, so that neighbours differ: each least one among its neighbours is taken.
            key = 2 * rank + _ranges(np.diff(np.append(run, len(rank)))) % 2
            around = np.concatenate([[2 * len(count) + 2], key, [2 * len(count) + 2]])
            chosen = np.flatnonzero((key < around[:-2]) & (key < around[2:]) & (rank < len(count)))
        else:  # all pairs differ: neighbours
            begin = _starts(part)
            chosen = np.flatnonzero((_ranges(np.diff(np.append(begin, len(part)))) % 2 == 0)[:-1] & inside)
        rule = np.unique(name[chosen], return_inverse=True)[1]
        whole = size[chosen] + size[chosen + 1]
        out.append((made + rule, place[chosen], size[chosen], whole))
        text[chosen], size[chosen] = free + rule, whole
        keep = np.ones(len(text), bool)
        keep[chosen + 1] = False
        text, size, place, part = text[keep], size[keep], place[keep], part[keep]
        made += int(rule.max()) + 1
        free += int(rule.max()) + 1
    if not out:
        return tuple(np.empty(0, "int64") for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def crossing(symbols: np.ndarray, place: np.ndarray, half: np.ndarray, whole: np.ndarray, reach: Extensions, min_length: int,
             times: int) -> np.ndarray:
    """Rows (number of the rule in the arguments, start, end, period) of the runs inside a rule's place that cross its
    boundary; start and end count from the place."""
    most = whole // times  # periods 1..most
    out = []
    edges = np.searchsorted(np.cumsum(most), np.arange(CELLS, int(most.sum()) + CELLS, CELLS), side="left") + 1
    for a, b in zip(np.concatenate([[0], edges[:-1]]), np.minimum(edges, len(most))):
        if a >= b:
            continue
        rule = np.repeat(np.arange(a, b), most[a:b])
        q = _ranges(most[a:b]) + 1
        for back in (0, 1):  # equal words q apart from the last word of A on, or one period before it
            i = place[rule] + half[rule] - 1 - back * q
            ok = (i >= place[rule]) & (i + q < place[rule] + whole[rule])
            ok[ok] = symbols[i[ok]] == symbols[i[ok] + q[ok]]
            r, p, i = rule[ok], q[ok], i[ok]
            low = np.maximum(i + 1 - reach.left(i, i + p), place[r])
            high = np.minimum(i + reach.right(i, i + p), place[r] + whole[r] - p) + p
            mid = place[r] + half[r]
            good = (high - low >= np.maximum(min_length, times * p)) & (low < mid) & (high > mid)
            out.append(np.stack([r, low - place[r], high - place[r], p], axis=1)[good])
    rows = np.concatenate(out) if out else np.empty((0, 4), "int64")
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):  # of equal stretches the smallest period
        rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])]
    return rows


def runs(words: np.ndarray, texts: np.ndarray, min_length: int = MIN_LENGTH, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs, by position in ``words``. No run leaves its text."""
    nothing = np.empty((0, 3), "int64")
    if not len(words):
        return nothing
    at, part = stretches(words, texts, min_length, times)
    if not len(at):
        return nothing
    # Between two stretches stands a symbol of its own, so that no extension leaves a stretch.
    moved = np.arange(len(at)) + part
    symbols = np.empty(len(at) + int(part[-1]) + 1, "int64")
    symbols[moved] = words[at]
    ends = np.append(moved[_starts(part)][1:] - 1, len(symbols) - 1)
    symbols[ends] = words.max() + 1 + np.arange(len(ends))
    rule, place, half, whole = grammar(words[at], part)
    if not len(rule):
        return nothing
    place = moved[place]
    order = np.argsort(rule, kind="stable")
    first = _starts(rule[order])
    each = order[first]
    reach = Extensions(symbols, int(np.bincount(part).max()))
    local = crossing(symbols, place[each], half[each], whole[each], reach, min_length, times)
    many = np.diff(np.append(first, len(order)))[local[:, 0]]
    row = np.repeat(np.arange(len(local)), many)
    base = place[order[np.repeat(first[local[:, 0]], many) + _ranges(many)]]
    low, high, q = base + local[row, 1], base + local[row, 2], local[row, 3]
    more = (low > 0) & (symbols[low - 1] == symbols[low - 1 + q])
    more |= (high < len(symbols)) & (symbols[np.minimum(high, len(symbols) - 1)] == symbols[high - q])
    found = np.unique(np.stack([low, high, q], axis=1)[~more], axis=0)
    if len(found):
        found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]
    origin = np.full(len(symbols), -1)
    origin[moved] = at
    return np.stack([origin[found[:, 0]], origin[found[:, 1] - 1] + 1, found[:, 2]], axis=1)


def _best(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; of equal ones the first."""
    best = found[0]
    for run in found[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def describe(words: list[bytes], found: np.ndarray) -> tuple:
    """The columns of ``RESULT`` for one text and its runs (start, end, period)."""
    order = found[np.lexsort((found[:, 2], found[:, 0]))]
    listed = [(int(s), int(e - s), int(q)) for s, e, q in order]
    named = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest()
    if listed:
        edge = np.zeros(len(words) + 1, "int64")
        np.add.at(edge, order[:, 0] + order[:, 2], 1)
        np.add.at(edge, order[:, 1], -1)
        words = [w for w, cover in zip(words, np.cumsum(edge)[:-1].tolist()) if not cover]
    s, n, q = _best(listed) if listed else (None, None, None)
    return (len(listed), s, n, q, 1000 * n // q if listed else None, named, hashlib.sha256(b" ".join(words)).hexdigest())


def _texts(words: list[list[bytes]], min_length: int, times: int) -> list[tuple]:
    """``RESULT`` of each text."""
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for text in words for w in text), "int64", sum(map(len, words)))
    ends = np.cumsum([len(t) for t in words])
    texts = np.repeat(np.arange(len(words)), [len(t) for t in words])
    found = runs(flat, texts, min_length, times)
    cuts = np.searchsorted(found[:, 0], np.concatenate([[0], ends])) if len(found) else np.zeros(len(words) + 1, "int64")
    return [(len(t), *describe(t, found[cuts[k]:cuts[k + 1]] - np.array([ends[k] - len(t), ends[k] - len(t), 0])))
            for k, t in enumerate(words)]


def detect(docs: DataFrame, min_length: int = MIN_LENGTH, times: int = TIMES) -> DataFrame:
    """doc_id and the columns of ``RESULT`` for each row: numbers of words and runs, the run with the greatest exact length /
    period (ties: smallest start, then period), and digests of the list of runs and of the text without repetitions."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]

    def made(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        columns = zip(*_texts(texts, min_length, times))
        return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *names])

    def run(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc)
                texts.append((text.as_py() or "").encode().split())
                size += len(texts[-1])
                if size >= BATCH_WORDS:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {RESULT}")
