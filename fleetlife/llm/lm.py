"""Language-model scores from a hierarchical Pitman-Yor model.

Restaurants: one for each context, whose parent is one root restaurant shared by all; the root's base is uniform
over the training vocabulary and one unknown word. The context of a token is the word before it, whichever word that
is; the text start has a restaurant too. Customers are training tokens; tables of the context restaurants are the
customers of the root.

Gibbs sampling: a sweep seats every customer anew, one dish (word) of a restaurant at a time, with the Chinese
restaurant's probabilities given the others: an occupied table in proportion to its customers less the discount, a
new one in proportion to the strength, the tables of the restaurant and the parent's probability of the word. What
restaurants share is summed after each sweep and used in the next. Beyond ``EXACT`` customers at a dish, customers are
seated in groups of a sixteenth of those there, with the probability at the start of the group. Each sweep can be
repeated from these sums alone, so no state is kept. Scores average the predictive probabilities of the sweeps after
the first ``BURN_IN``.

The ``CONTEXTS`` most frequent words are a fast path and not a part of the model: counts among them are a table of fixed
size, and their tables and the root's customers of them are sums that every task gets. All other words live in buckets by
hash. Words of a bucket are seated there after any context; frequent words after a rare one in the bucket of that context.
A rare context has dishes in many buckets. They get the number of its dishes once, from the bucket of the context, and a sweep
seats them given one table for each other dish (frequent contexts: given the tables of the sweep before). After the last
sweep its bucket gets the tables of each sample, so that every predictive distribution adds up to one.

Tokens are words with A-Z lower-cased, then one end token. A word is known by a 64-bit hash.

Reading makes packed rows of the different pairs of word and context of a batch of documents, by bucket. Training pairs are
counted first; all pairs are asked for after the sweeps, and the answers met with the batch's tokens. The texts are read
for each of the three, and must give the same batches; else the answers don't fit and the query fails.

Defined results: null or empty text is one end token; a null doc_id is a training document; repeated rows count and are
scored each for itself; without training tokens all words are unknown. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, stored

CONTEXTS, BURN_IN, SAMPLES, SEED = 512, 2, 4, 7
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 2.0, 0.6, 2.0
EXACT, MIN_BUCKETS, TOKENS_PER_BUCKET, DOCS_PER_ROW, PAIRS_AT_ONCE = 256, 64, 4_000_000, 5_000, 1 << 16
END = b"\n"  # no word is a line break


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split() + [END]


def coded(texts) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The tokens of all texts as places among the different ones, the number of tokens of each text, and the different ones."""
    text = pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    full = pc.greater(pc.binary_length(split.values), 0)  # gaps at the ends of a text leave empty words
    edge = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()]
    found = split.values.filter(full).dictionary_encode()
    n = np.diff(edge) + 1
    code = np.full(n.sum(), len(found.dictionary), "<i4")
    word = np.ones(len(code), bool)
    word[np.cumsum(n) - 1] = False
    code[word] = found.indices.to_numpy()
    del text, split, full
    pa.default_memory_pool().release_unused()
    return code, n, [*found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False), END]


def in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on sorted, and the places that they had; equal ones stay in their order. Number and place are sorted as one
    number where 63 bits hold both, which is faster than to sort places."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits > 63:
        place = np.argsort(key, kind="stable")
        return key[place], place
    key = key.astype("int64", copy=False) << bits
    key |= np.arange(len(key))
    key.sort()
    place = (key & ((1 << bits) - 1)).astype("<i4" if bits < 32 else "int64")
    key >>= bits
    return key, place


def different(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in order, and the place of each number among them."""
    key, place = in_order(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.empty(len(key), place.dtype)
    at[place] = np.cumsum(new, dtype=place.dtype) - 1
    return key[new], at


def hashed(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8")


def planes(a: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then their second bytes, and so on: those of small numbers are then mostly long runs of 0."""
    return np.ascontiguousarray(a).reshape(-1, 1).view("u1").T.ravel()


def numbers(raw: np.ndarray, kind: str) -> np.ndarray:
    """What ``planes`` was given."""
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed(a: np.ndarray) -> bytes:
    """Small numbers, compressed; their length in bytes comes first."""
    raw = planes(a).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(raw[:4], "little") if raw else 0
    return numbers(np.frombuffer(pa.decompress(raw[4:], size, "zstd"), "u1"), kind) if size else np.empty(0, kind)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def most_frequent(docs: DataFrame, number: int) -> tuple[list, int]:
    """(word, count) of the ``number`` words met most often in the training texts, and the number of training tokens. A batch
    counts its own most frequent words only: the choice decides what is kept where, not what is learned."""
    def run(batches):
        for batch in batches:
            code, _, words = coded(batch["text"])
            count = np.bincount(code, minlength=len(words))
            most = np.argsort(-count, kind="stable")[:8 * number]
            yield pd.DataFrame({"word": hashed(words[i] for i in most).view("int64"), "count": count[most], "tokens": 0})
            yield pd.DataFrame({"word": [0], "count": [0], "tokens": [len(code)]})

    train = docs.where(~held_out(F.col("doc_id"))).select("text")
    met = train.mapInPandas(run, "word long, count long, tokens long").groupBy("word").agg(
        F.sum("count").alias("count"), F.sum("tokens").alias("tokens"))
    top = met.orderBy(F.desc("tokens"), F.desc("count"), "word").limit(number + 1).collect()  # number + 1 rows
    tokens_ = sum(r["tokens"] for r in top)
    return sorted(((r["word"], r["count"]) for r in top if r["count"]), key=lambda r: -r[1])[:number], tokens_


class Frequent:
    """The most frequent words: a context id for any word, by hash."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.n = len(words)
        self.contexts = self.n + 2  # these, all other words, the text start

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(h), "<i4")
        at = np.minimum(np.searchsorted(self.words, h), self.n - 1).astype("<i4")
        at[self.words[at] != h] = self.n
        return at


READ = ("kind int, batch string, bucket int, words binary, lengths binary, contexts binary, others binary, hot_words binary, "
        "hot_contexts binary, hot_counts binary, codes binary, code_counts binary, doc_ids array<string>, held binary, "
        "n_tokens binary, n_words int, docs binary")
CHUNK = ["batch", "words", "lengths", "contexts", "others", "hot_words", "hot_contexts", "hot_counts", "codes", "code_counts"]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype("int64")


def _pairs(code: np.ndarray, n: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and contexts of the different pairs in documents of n tokens each, and the pair of each token."""
    context = np.concatenate([[start], code[:-1]])
    context[np.cumsum(n) - n] = start
    pair, at = different(code * (start + 1) + context)
    return pair // (start + 1), pair % (start + 1), at


def read(docs: DataFrame, frequent: Frequent, buckets: int, kind: int = 1) -> DataFrame:
    """Packed rows of a batch of documents. Kind 1: by bucket, its rarer words, with the contexts and training count of
    each pair, and the frequent words after them; counts of pairs of frequent words in one of the rows. Kind 0: one row with
    the documents' tokens: a frequent word's id, or the place among the batch's rarer words after these."""
    names = [c.split()[0] for c in READ.split(", ")]
    many = frequent.n

    def made(part: pd.DataFrame, batch: str):
        found, n, names = coded(part["text"])
        h = hashed(names)
        del names
        ids = frequent.ids(h).astype("int64")
        words, place = np.unique(h[ids == many], return_inverse=True)
        ids[ids == many] += place
        code = ids[found]
        del found
        held = part["held"].to_numpy(bool)
        if kind == 0:
            yield {"kind": 0, "batch": batch, "doc_ids": list(part["doc_id"]), "held": held.tobytes(), "n_words": len(words),
                   "n_tokens": packed(n.astype("<u4")), "docs": packed(code.astype("<u4"))}
            return
        start = many + len(words)
        word, context, at = _pairs(code, n, start)
        count = np.bincount(at, np.repeat(~held, n), len(word)).astype("<u4")
        own = word >= many
        after = ~own & (context >= many) & (context < start)
        both = ~own & ~after & (count > 0)
        fixed = np.where(context < many, context, np.where(context == start, many + 1, many)).astype("<u2")
        codes = word[both] * frequent.contexts + fixed[both]
        swapped = np.flatnonzero(after)[in_order(context[after] * many + word[after])[1]]
        per_word = np.bincount(word[own] - many, minlength=len(words)).astype("<u4")
        per_context = np.bincount(context[after] - many, minlength=len(words)).astype("<u4")
        edge = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1))
        first = np.concatenate([[0], np.cumsum(per_word, dtype="int64")])[edge]
        second = np.concatenate([[0], np.cumsum(per_context, dtype="int64")])[edge]
        own = np.flatnonzero(own)
        keeper = zlib.crc32(batch.encode()) % min(buckets, MIN_BUCKETS)
        for b in range(buckets):
            s, mine, theirs = slice(edge[b], edge[b + 1]), own[first[b]:first[b + 1]], swapped[second[b]:second[b + 1]]
            if s.start == s.stop and b != keeper:
                continue
            ids = fixed[mine]
            yield {"kind": 1, "batch": batch, "bucket": b, "words": words[s].tobytes(), "lengths": packed(per_word[s]),
                   "contexts": packed(np.concatenate([planes(ids), planes(count[mine])])), "others": words[context[mine][ids == many] - many].tobytes(),
                   "hot_words": packed(word[theirs].astype("<u2")), "hot_contexts": packed(per_context[s]),
                   "hot_counts": packed(count[theirs])} | (
                {"codes": packed(codes.astype("<u4")), "code_counts": packed(count[both])} if b == keeper else {})

    def run(batches):
        k = 0
        for batch in batches:
            for at in range(0, len(batch), DOCS_PER_ROW):
                rows = list(made(batch.iloc[at:at + DOCS_PER_ROW], f"{TaskContext.get().partitionId()}-{k}"))
                k += 1
                yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    return texts.mapInPandas(run, READ)


def _array(row, name: str, kind: str) -> np.ndarray:
    """A packed column; empty where there is none."""
    return np.frombuffer(row.get(name) or b"", kind)


class Counted:
    """The pairs of a bucket's chunks in three groups: words after frequent contexts, the start or a shared context; after rare
    contexts told apart; and frequent words after the bucket's words. Of each group the pairs as asked for (``at``: their places
    among the different ones) and the training count of each different one, in the order of the bucket's words."""

    def __init__(self, chunks, contexts: int):
        words = [_array(c, "words", "<u8") for c in chunks]
        self.words, place = np.unique(np.concatenate(words), return_inverse=True)
        self.places = np.split(place, np.cumsum([len(w) for w in words])[:-1])
        fixed, far, near = [], [], []
        self.told = []
        for c, p in zip(chunks, self.places):
            raw = unpacked(c["contexts"], "u1")
            ids, count = numbers(raw[:len(raw) // 3], "<u2"), numbers(raw[len(raw) // 3:], "<u4")
            word = np.repeat(p, unpacked(c.get("lengths"), "<u4"))
            told = (ids == contexts - 2) & (c.get("others") is not None)
            self.told.append(told)
            fixed.append((word[~told] * contexts + ids[~told], count[~told]))
            far.append((word[told], _array(c, "others", "<u8"), count[told]))
            near.append((np.repeat(p, unpacked(c.get("hot_contexts"), "<u4")) * contexts + unpacked(c.get("hot_words"), "<u2"),
                         unpacked(c.get("hot_counts"), "<u4")))
        self.key, self.fixed_at, self.fixed = self._summed(*map(np.concatenate, zip(*fixed)))
        word, other, count = map(np.concatenate, zip(*far))
        order = np.argsort(other)
        order = order[in_order(word[order])[1]]
        w, o = word[order], other[order]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])])[:len(w)]
        self.far_at = np.empty(len(w), "int64")
        self.far_at[order] = np.cumsum(new) - 1
        self.far_word, self.far_context = w[new], o[new]
        self.far = np.bincount(self.far_at, count, len(self.far_word)).astype("int64")
        self.near_key, self.near_at, self.near = self._summed(*map(np.concatenate, zip(*near)))
        self.code, _, self.code_count = self._summed(np.concatenate([unpacked(c.get("codes"), "<u4") for c in chunks]),
                                                     np.concatenate([unpacked(c.get("code_counts"), "<u4") for c in chunks]))
        self.customers = (np.bincount(self.key // contexts, self.fixed, len(self.words))
                          + np.bincount(self.far_word, self.far, len(self.words))).astype("int64")

    @staticmethod
    def _summed(key: np.ndarray, count: np.ndarray):
        names, at = different(key)
        return names, at, np.bincount(at, count, len(names)).astype("int64")


def waiting(customers: np.ndarray) -> np.ndarray:
    """The places of dishes with more than one customer, those with most first: the first one has a table of its own."""
    many = np.flatnonzero(customers > 1)
    most = int(customers[many].max(initial=1))
    # 16 bits are sorted by radix
    return many[np.argsort((most - customers[many]).astype("<u2" if most < 1 << 16 else "<i8"), kind="stable")]


def seated(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator, order: np.ndarray | None = None) -> np.ndarray:
    """Tables after seating the customers of each dish; ``fresh`` is the weight of a new table and ``order`` what ``waiting``
    gives, if known."""
    order = waiting(customers) if order is None else order
    c, w = customers[order], fresh[order]
    t = np.ones(len(c))
    below, drawn, taken = -c, np.empty(len(c)), np.empty(len(c))
    k = 1
    while len(c) and c[0] > k:
        step = 1 if k < EXACT else k // 16
        n = int(np.searchsorted(below, -k))  # dishes with more than k customers
        p = np.add(w[:n], k, out=drawn[:n])
        p -= np.multiply(t[:n], discount, out=taken[:n])
        np.divide(w[:n], p, out=p)
        t[:n] += (rng.random(out=taken[:n]) < p) if step == 1 else rng.binomial(np.minimum(step, c[:n] - k), p)
        k += step
    out = np.ones(len(customers))
    out[order] = t
    return out


def parts(state: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Tables per fixed context, the root's customers and tables of each frequent word, its customers and tables in all."""
    n = contexts - 2
    return state[:contexts], state[contexts:contexts + n], state[contexts + n:contexts + 2 * n], state[-2], state[-1]


def parent(root, root_t, state: np.ndarray, vocabulary: int):
    """The root's probability of words with so many customers and tables there."""
    return (root - ROOT_DISCOUNT * root_t + (ROOT_STRENGTH + ROOT_DISCOUNT * state[-1]) / (vocabulary + 1)) / (ROOT_STRENGTH + state[-2])


class Sampler:
    """Seating of one bucket's words."""

    def __init__(self, row, contexts: int, vocabulary: int):
        self.bucket, self.n_words, self.contexts, self.vocabulary = int(row["bucket"]), int(row["n_words"]), contexts, vocabulary
        key = _array(row, "keys", "<i8")
        self.word, self.context, self.count = key // contexts, key % contexts, _array(row, "counts", "<u4").astype("int64")
        self.single = np.zeros(self.n_words) + (_array(row, "single", "<u4") if row.get("single") else 0)
        self.far_word, self.far_count = _array(row, "far_word", "<u4"), _array(row, "far_count", "<u4").astype("int64")
        self.near_word, self.near_count = _array(row, "near_word", "<u2"), _array(row, "near_count", "<u4").astype("int64")
        self.far_dishes, self.near_dishes = _array(row, "far_dishes", "<u4"), _array(row, "near_dishes", "<u4")
        self.hot_single = np.zeros(contexts - 2) + (_array(row, "hot_single", "<u4") if row.get("hot_single") else 0)
        self.t, self.far_t, self.near_t = np.ones(len(key)), np.ones(len(self.far_word)), np.ones(len(self.near_word))
        self.root_t = np.ones(self.n_words)
        self.many = np.flatnonzero(self.count > 1)
        self.many_word, self.many_context = self.word[self.many], self.context[self.many]
        self.seats = np.concatenate([self.count[self.many], self.far_count, self.near_count])
        self.order = waiting(self.seats)
        self._to_root()

    def _to_root(self) -> None:
        self.root = (np.bincount(self.word, self.t, self.n_words) + self.single
                     + np.bincount(self.far_word, self.far_t, self.n_words))

    def shared(self) -> np.ndarray:
        hot = self.hot_single + np.bincount(self.near_word, self.near_t, self.contexts - 2)
        return np.concatenate([np.bincount(self.context, self.t, self.contexts), hot, np.zeros(self.contexts - 2),
                               [self.root.sum(), self.root_t.sum()]])

    def sweep(self, number: int, state: np.ndarray) -> None:
        rng = np.random.default_rng([SEED, self.bucket, number])
        tables, hot, hot_t, _, total = parts(state, self.contexts)
        p = parent(self.root, self.root_t, state, self.vocabulary)
        fresh = np.concatenate([(STRENGTH + DISCOUNT * tables[self.many_context]) * p[self.many_word],
                                (STRENGTH + DISCOUNT * self.far_dishes) * p[self.far_word],
                                (STRENGTH + DISCOUNT * self.near_dishes) * parent(hot, hot_t, state, self.vocabulary)[self.near_word]])
        t = seated(self.seats, fresh, DISCOUNT, rng, self.order)
        first, second = len(self.many), len(self.many) + len(self.far_word)
        self.t[self.many], self.far_t, self.near_t = t[:first], t[first:second], t[second:]
        self._to_root()
        new = np.full(self.n_words, (ROOT_STRENGTH + ROOT_DISCOUNT * total) / (self.vocabulary + 1))
        self.root_t = seated(self.root.astype("int64"), new, ROOT_DISCOUNT, rng)


class Table:
    """Seating of the frequent words after frequent ones and the start, and of the frequent words at the root."""

    def __init__(self, count: np.ndarray, vocabulary: int):
        self.count, self.vocabulary = count, vocabulary  # words x contexts
        self.t = (count > 0).astype(float)
        self.sum = np.zeros(count.shape)  # of the samples
        self.number = -1

    def complete(self, state: np.ndarray) -> np.ndarray:
        """The state with this table's share."""
        contexts, n, rng = self.count.shape[1], len(self.count), np.random.default_rng([SEED, 1 << 40, self.number + 1])
        state = state.copy()
        state[:contexts] += self.t.sum(axis=0)
        state[contexts:contexts + n] += self.t.sum(axis=1)
        root = state[contexts:contexts + n].astype("int64")
        if self.number < 0:
            root_t = np.ones(n)
        else:
            root_t = seated(root, np.full(n, (ROOT_STRENGTH + ROOT_DISCOUNT * self.total) / (self.vocabulary + 1)), ROOT_DISCOUNT, rng)
        state[contexts + n:contexts + 2 * n] = root_t
        state[-2:] += [root.sum(), root_t.sum()]
        self.total = state[-1]
        return state

    def sweep(self, number: int, state: np.ndarray) -> None:
        tables, hot, hot_t, _, _ = parts(state, self.count.shape[1])
        fresh = parent(hot, hot_t, state, self.vocabulary)[:, None] * (STRENGTH + DISCOUNT * tables)
        many = self.count > 1
        self.t[many] = seated(self.count[many], fresh[many], DISCOUNT, np.random.default_rng([SEED, 1 << 41, number]))
        self.number = number
        if number >= BURN_IN:
            self.sum += self.t


TYPES = ("bucket int, n_words long, known binary, keys binary, counts binary, customers binary, single binary, far_word binary, "
         "far_context binary, far_count binary, near_context binary, near_word binary, near_count binary, hot_single binary, "
         "codes binary, code_counts binary, far_dishes binary, near_dishes binary")
SEATS = ["bucket", "n_words", "keys", "counts", "single", "far_word", "far_count", "near_word", "near_count", "hot_single",
         "far_dishes", "near_dishes"]


def types(buckets: DataFrame, contexts: int) -> DataFrame:
    """Per bucket: its training words and the counts of their pairs. Pairs with rare contexts that came once are always one
    table, so that their number is enough."""
    names = [c.split()[0] for c in TYPES.split(", ")]

    def row(bucket: int, chunks) -> list:
        c = Counted(chunks, contexts)
        known = c.customers > 0
        place = np.cumsum(known) - 1
        fixed, far, near = c.fixed > 0, c.far > 1, c.near > 1
        single = np.bincount(place[c.far_word[c.far == 1]], minlength=int(known.sum()))
        hot_single = np.bincount(c.near_key[c.near == 1] % contexts, minlength=contexts - 2)
        u4 = lambda v: v.astype("<u4").tobytes()
        return [bucket, int(known.sum()), c.words[known].tobytes(),
                (place[c.key[fixed] // contexts] * contexts + c.key[fixed] % contexts).astype("<i8").tobytes(), u4(c.fixed[fixed]),
                u4(c.customers[known]), u4(single), u4(place[c.far_word[far]]), c.far_context[far].tobytes(), u4(c.far[far]),
                u4(place[c.near_key[near] // contexts]), (c.near_key[near] % contexts).astype("<u2").tobytes(), u4(c.near[near]),
                u4(hot_single), u4(c.code), u4(c.code_count), None, None]

    def run(batches):
        for batch in batches:
            for bucket, chunks in zip(batch["bucket"], batch["chunks"]):
                yield pd.DataFrame([row(bucket, list(chunks))], columns=names)

    return buckets.mapInPandas(run, TYPES)


SENT = "home int, bucket int, contexts binary, saved binary"


def _sent(bucket: int, context: np.ndarray, saved: np.ndarray, buckets: int):
    """To the bucket of each rare context: the customers that pairs seated beside others, summed, for each sample."""
    names, at = np.unique(context, return_inverse=True)
    sums = np.stack([np.bincount(at, v, len(names)) for v in saved]).astype("<u4")
    edge = np.searchsorted(bucket_of(names, buckets), np.arange(buckets + 1))
    return pd.DataFrame([(h, bucket, names[i:j].tobytes(), sums[:, i:j].tobytes()) for h, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if i < j],
                        columns=["home", "bucket", "contexts", "saved"])


def with_dishes(found: DataFrame, buckets: int) -> DataFrame:
    """The rows of ``types`` with the number of dishes of each pair's rare context."""
    def ask(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                yield _sent(row["bucket"], _array(row, "far_context", "<u8"), _array(row, "far_count", "<u4")[None] - 1.0, buckets)

    def answer(key, home: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in home.to_dict("records"):
            known, at = _array(row, "known", "<u8"), _array(row, "near_context", "<u4")
            dishes = _array(row, "customers", "<u4") - np.bincount(at, _array(row, "near_count", "<u4") - 1.0, len(known))
            places = [np.searchsorted(known, np.frombuffer(c, "<u8")) for c in asked["contexts"]]
            for place, saved in zip(places, asked["saved"]):
                dishes[place] -= np.frombuffer(saved, "<u4")
            dishes = dishes.astype("<u4")
            out = [(b, row["bucket"], dishes[p].tobytes()) for b, p in zip(asked["bucket"], places)] + [(row["bucket"], -1, dishes[at].tobytes())]
        return pd.DataFrame(out, columns=["bucket", "home", "dishes"])

    def put(key, row: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("home")
        near, *far = [np.frombuffer(d, "<u4") for d in told["dishes"]]
        _, at = np.unique(np.frombuffer(row["far_context"].iloc[0], "<u8"), return_inverse=True)
        dishes = np.concatenate([*far, np.empty(0, "<u4")])[at]
        return row.astype({"far_dishes": object, "near_dishes": object}).assign(far_dishes=[dishes.tobytes()], near_dishes=[near.tobytes()])

    asked = found.select("bucket", "far_context", "far_count").mapInPandas(ask, SENT)
    homes = found.select("bucket", "known", "customers", "near_context", "near_count")
    told = homes.groupBy("bucket").cogroup(asked.groupBy("home")).applyInPandas(answer, "bucket int, home int, dishes binary")
    return found.drop("codes", "code_counts").groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(
        put, ", ".join(c for c in TYPES.split(", ") if not c.startswith("code")))


def _sampler(row, contexts: int, vocabulary: int, history: list[np.ndarray], visit=None) -> Sampler:
    """The sampler after the sweeps that ``history`` allows; ``visit`` sees it after each with the shared state."""
    made = Sampler(row, contexts, vocabulary)
    for number, state in enumerate(history):
        if visit and number:
            visit(made, number, state)
        if not visit or number + 1 < len(history):
            made.sweep(number, state)
    return made


def sweeps(found: DataFrame, contexts: int, vocabulary: int, number: int, table: Table | None = None) -> list[np.ndarray]:
    """The shared state before the first sweep and after each: contexts + 2 numbers and two for each frequent word, summed by
    Spark."""
    table = table or Table(np.zeros((contexts - 2, contexts), "int64"), vocabulary)
    history: list[np.ndarray] = []
    for k in range(number + 1):
        def run(batches, history=tuple(history)):
            for batch in batches:
                for row in batch.to_dict("records"):
                    state = _sampler(row, contexts, vocabulary, list(history)).shared()
                    yield pd.DataFrame({"place": np.arange(len(state)), "value": state})

        if history:
            table.sweep(k - 1, history[-1])
        sums = found.select(*SEATS).mapInPandas(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        state = np.zeros(contexts + 2 * (contexts - 2) + 2)
        for r in sums:
            state[r["place"]] = r["value"]
        history.append(table.complete(state))
    return history


def predictive(count, t, parents: np.ndarray, tables: np.ndarray, customers) -> np.ndarray:
    """Probabilities of pairs, averaged over samples: ``t`` are a pair's mean tables, ``parents`` the root's probabilities of
    its word and ``tables`` the tables of its context per sample, ``customers`` those of the context."""
    back = sum(p * (STRENGTH + DISCOUNT * c) for p, c in zip(parents, tables)) / len(parents)
    return (count - DISCOUNT * t + back) / (STRENGTH + customers)


class Model:
    """What the samples give for one bucket; ``context_customers`` are those of the fixed contexts."""

    def __init__(self, row, contexts: int, vocabulary: int, history: list[np.ndarray], context_customers: np.ndarray):
        self.key, self.contexts, self.customers = _array(row, "keys", "<i8"), contexts, context_customers
        self.count = _array(row, "counts", "<u4").astype("int64")
        self.samples = history[BURN_IN + 1:]
        self.vocabulary = vocabulary
        self.t, self.far, self.near, self.root, self.root_t = 0.0, [], [], [], []

        def visit(made: Sampler, number: int, state: np.ndarray) -> None:
            if number > BURN_IN:
                self.t = self.t + made.t
                for seen, new in ((self.far, made.far_t), (self.near, made.near_t), (self.root, made.root), (self.root_t, made.root_t)):
                    seen.append(new.copy())

        _sampler(row, contexts, vocabulary, history, visit)

    def probability(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of words by place (the number of words for unknown ones) after fixed contexts."""
        count, t = np.zeros(len(word)), np.zeros(len(word))
        if len(self.key):
            key = word * self.contexts + context
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            here = self.key[at] == key
            count, t = np.where(here, self.count[at], 0), np.where(here, self.t[at] / len(self.samples), 0.0)
        parents = np.stack([parent(np.append(r, 0), np.append(rt, 0), s, self.vocabulary)[word]
                            for r, rt, s in zip(self.root, self.root_t, self.samples)])
        return predictive(count, t, parents, np.stack([s[context] for s in self.samples]), self.customers[context])


ANSWER = "batch string, bucket int, words binary, own binary, near binary"


def answers(asked: DataFrame, found: DataFrame, contexts: int, vocabulary: int, history: list[np.ndarray], buckets: int) -> DataFrame:
    """For each chunk asked for: per word its count and its customers and tables at the root and its own tables in each sample;
    per pair its count and its tables summed over the samples."""
    def send(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                model = Model(row, contexts, vocabulary, history, None)
                yield _sent(row["bucket"], _array(row, "far_context", "<u8"), _array(row, "far_count", "<u4") - np.stack(model.far), buckets)

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                yield from answered(row)

    def answered(row):
        chunks = list(row["chunks"])
        c = Counted(chunks, contexts)
        known = c.customers > 0
        facts = np.zeros((1 + 3 * SAMPLES, len(c.words)), "<u4")
        fixed, far, near = np.zeros(len(c.fixed), "<u4"), SAMPLES * (c.far == 1), SAMPLES * (c.near == 1)
        if row["known"] is not None:
            if not np.array_equal(c.words[known], _array(row, "known", "<u8")):
                raise ValueError("the documents changed between two readings")
            model = Model(row, contexts, vocabulary, history, None)
            fixed[c.fixed > 0] = model.t
            far[c.far > 1], near[c.near > 1] = sum(model.far), sum(model.near)
            facts[0, known] = c.customers[known]
            at, count = _array(row, "near_context", "<u4"), _array(row, "near_count", "<u4")
            tables = np.stack([c.customers[known] - np.bincount(at, count - t, int(known.sum())) for t in model.near])
            for sent in row["sent"] if row["sent"] is not None else []:
                place = np.searchsorted(c.words[known], np.frombuffer(sent["contexts"], "<u8"))
                tables[:, place] -= np.frombuffer(sent["saved"], "<u4").reshape(SAMPLES, -1)
            facts[1:, known] = np.concatenate([np.stack(model.root), np.stack(model.root_t), tables])
        i = j = k = 0
        for chunk, place, told in zip(chunks, c.places, c.told):
            own = np.empty((2, len(told)), "<u4")
            n = int(told.sum())
            a, b = c.fixed_at[i:i + len(told) - n], c.far_at[j:j + n]
            own[:, ~told], own[:, told] = [c.fixed[a], fixed[a]], [c.far[b], far[b]]
            m = int(unpacked(chunk["hot_contexts"], "<u4").sum())
            d = c.near_at[k:k + m]
            i, j, k = i + len(told) - n, j + n, k + m
            yield pd.DataFrame([(chunk["batch"], row["bucket"], packed(facts[:, place]), packed(own),
                                 packed(np.stack([c.near[d], near[d]]).astype("<u4")))], columns=["batch", "bucket", "words", "own", "near"])

    sent = found.select(*SEATS, "far_context").mapInPandas(send, SENT).groupBy("home").agg(
        F.collect_list(F.struct("contexts", "saved")).alias("sent")).withColumnRenamed("home", "bucket")
    models = found.select(*SEATS, "known", "near_context").join(sent, "bucket", "left")
    return asked.join(models, "bucket", "left").mapInPandas(run, ANSWER)


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.collect_list(F.struct(*CHUNK)).alias("chunks"))


def score(docs: DataFrame, n_contexts: int = CONTEXTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    top, met = most_frequent(docs, n_contexts)
    frequent = Frequent(np.array([w for w, _ in top], "int64").view("<u8"), np.array([c for _, c in top], "int64"))
    many, contexts = frequent.n, frequent.contexts
    buckets = max(MIN_BUCKETS, partitions(docs), met // TOKENS_PER_BUCKET)
    counted = stored(types(grouped(read(docs.where(~held_out(F.col("doc_id"))), frequent, buckets)), contexts))

    def sums(batches):
        """Places: pairs of frequent words, frequent words after rare ones, contexts of rare words, rare words."""
        for batch in batches:
            for row in batch.to_dict("records"):
                key, n = _array(row, "keys", "<i8"), _array(row, "counts", "<u4")
                last = many * contexts
                near = np.bincount(_array(row, "near_word", "<u2"), _array(row, "near_count", "<u4"), many) + _array(row, "hot_single", "<u4")
                yield pd.DataFrame({"place": _array(row, "codes", "<u4").astype("int64"), "value": _array(row, "code_counts", "<u4").astype("int64")})
                rest = np.concatenate([near, np.bincount(key % contexts, n, contexts), [row["n_words"], _array(row, "customers", "<u4").sum()]])
                yield pd.DataFrame({"place": last + np.arange(len(rest)), "value": rest.astype("int64")})

    total = np.zeros(many * contexts + many + contexts + 2, "int64")
    added = counted.select("bucket", "n_words", "keys", "counts", "near_word", "near_count", "hot_single", "customers", "codes", "code_counts")
    for r in added.mapInPandas(sums, "place long, value long").groupBy("place").agg(F.sum("value").alias("v")).collect():
        total[r["place"]] = r["v"]
    hot_count, rest = total[:many * contexts].reshape(many, contexts), total[many * contexts:]
    word_count = hot_count.sum(axis=1) + rest[:many]
    in_context = hot_count.sum(axis=0) + rest[many:many + contexts]
    train_tokens, vocabulary = int(word_count.sum() + rest[-1]), int(rest[-2]) + many
    floor = float(train_tokens + vocabulary + 1)
    found = stored(with_dishes(counted, buckets))
    discard(counted)
    table = Table(hot_count, vocabulary)
    history = sweeps(found, contexts, vocabulary, BURN_IN + SAMPLES, table)
    samples = history[BURN_IN + 1:]
    hot_parents = np.stack([parent(*parts(s, contexts)[1:3], s, vocabulary) for s in samples])
    fixed_tables = np.stack([s[:contexts] for s in samples])
    hot = predictive(hot_count, table.sum / SAMPLES, hot_parents[:, :, None], fixed_tables[:, None, :], in_context)

    def finish(key, head: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("bucket")
        joined = lambda c, rows: np.concatenate([unpacked(v, "<u4").reshape(rows, -1) for v in told[c]] or [np.empty((rows, 0), "<u4")], axis=1)
        outs = []
        for r in head.to_dict("records"):
            n, code = unpacked(r["n_tokens"], "<u4").astype("int64"), unpacked(r["docs"], "<u4").astype("int64")
            start = many + int(r["n_words"])
            facts, own, near = joined("words", 1 + 3 * SAMPLES), joined("own", 2), joined("near", 2)
            word, context, at = _pairs(code, n, start)
            mine = word >= many
            after = ~mine & (context >= many) & (context < start)
            if (facts.shape[1], own.shape[1], near.shape[1]) != (r["n_words"], mine.sum(), after.sum()):
                raise ValueError("the documents changed between two readings")
            facts = facts.astype(float)
            parents = np.stack([parent(a, b, s, vocabulary) for a, b, s in zip(facts[1:1 + SAMPLES], facts[1 + SAMPLES:1 + 2 * SAMPLES], samples)])
            parents = np.concatenate([hot_parents, parents], axis=1)
            known = np.concatenate([word_count, facts[0]])
            tables = np.concatenate([fixed_tables[:, :many], facts[1 + 2 * SAMPLES:], fixed_tables[:, -1:]], axis=1)
            customers = np.concatenate([in_context[:many], facts[0], in_context[-1:]])
            value = np.empty(len(word))
            swapped = np.flatnonzero(after)[in_order(context[after] * many + word[after])[1]]
            for places, (count, t) in ((np.flatnonzero(mine), own), (swapped, near)):
                for i in range(0, len(places), PAIRS_AT_ONCE):
                    part, which = slice(i, i + PAIRS_AT_ONCE), places[i:i + PAIRS_AT_ONCE]
                    w, c = word[which], context[which]
                    value[which] = predictive(count[part], t[part] / SAMPLES, parents[:, w], tables[:, c], customers[c])
            both = ~mine & ~after
            value[both] = hot[word[both], np.where(context[both] == start, many + 1, context[both])]
            doc = np.repeat(np.arange(len(n)), n)
            outs.append(pd.DataFrame({
                "doc_id": pd.Series(list(r["doc_ids"]), dtype=object), "held_out": np.frombuffer(r["held"], bool), "n_tokens": n,
                "n_known": np.bincount(doc, known[code] > 0, len(n)).astype("int64"),
                "base_score": np.bincount(doc, np.log10((known + 1) / floor)[code], len(n)),
                "score": np.bincount(doc, np.log10(value)[at], len(n))}))
        return pd.concat(outs) if outs else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    told = answers(grouped(read(docs, frequent, buckets)), found, contexts, vocabulary, history, buckets)
    heads = read(docs, frequent, buckets, kind=0).select("batch", "doc_ids", "held", "n_tokens", "n_words", "docs")
    done = heads.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(
        finish, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("doc_id").cast(kind), "held_out", "n_tokens", "n_known",
                       F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Per part (held_out true or false): tokens and perplexity of the model and of the base."""
    mean = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), mean("score").alias("perplexity"),
                                          mean("base_score").alias("base_perplexity"))
