"""Vector best-fit packing of token sequences.

Documents are tokenized and closed with an end id; only documents longer than a sequence are cut.
Pieces are spread over buckets by hash and each bucket is packed by itself, largest piece first. A bin
has three residual capacities: tokens, documents and attention cost (the sum of squared lengths). Of
the bins that can take a piece under every constraint, the one with the smallest weighted norm of the
residual that would be left (``norm``), or the largest weighted dot product of piece and residual
(``dot``), takes it. Buckets have about ``BUCKET_ROWS`` documents at any input size: one part-filled bin
per bucket is the price of packing them apart.

Defined results: null or empty text is one end id; repeated rows are packed each for itself; a document
with a null id is packed like any other; no rows give no rows. Other columns are not carried.

Tokens per whitespace-separated word are kept in a bounded cache, as the pre-tokenizer never joins
across whitespace; a word that is not in the cache goes to the tokenizer.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, stored

MAX_TOKENS, END_ID = 2048, 0
BUCKET_ROWS, CACHE_WORDS, STEP = 8_000, 600_000, 100
WEIGHTS = (1.0, 0.3, 0.3)  # of tokens, documents and attention in the residual
PIECES = "piece int, start long, length long, ids_crc32 long"


_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įıĳ-ɏ]*)([!-/:-@\\[-`{-~]*)")
# Byte-level vocabularies show a byte as a printable character: itself, or else the next one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Words on which both ways must agree; with a tokenizer where they do not, all words take the whole way.
PROBES = ["the", "The", "heation,", "élève.", "ÜBER!!", "|", "señor?!", "Straße;", "ANOTHER", "ñ", "x--", "çà"]


class WordCache(dict):
    """Word (UTF-8) -> its token ids as little-endian bytes. ``bytes.split`` cuts at ASCII white space."""

    def __init__(self, vocabulary: str | None, words: int = CACHE_WORDS):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        self.limit = words

        self.direct = True
        self.direct = all(self._pieces(w) == self._encode(w) for w in PROBES)

    def _encode(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _pieces(self, word: str) -> list[int]:
        """Ids of a word. Latin letters and the marks after them are known to be one piece each, so these go to
        the tokenizer's merges without its rules for finding pieces; all other words take the whole way."""
        plain = _PLAIN.fullmatch(word) if self.direct else None
        if plain is None:
            return self._encode(word)
        out = []
        for piece in plain.groups():
            if piece:
                piece = piece.lower()
                if not piece.isascii():
                    piece = piece.encode().decode("latin-1").translate(_SHOWN)
                out += [t.id for t in self.tokenizer.model.tokenize(piece)]
        return out

    def __missing__(self, word: bytes) -> bytes:
        found = self._pieces(word.decode())
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = np.array(found, "<u4").tobytes()
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.encode().split())), "<u4")


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, vocabulary: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document. With ids also the piece's number, the same
    whenever its task runs again, and its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        # With ids, batches take memory of their own, and the cache is smaller.
        cache, end = WordCache(vocabulary, CACHE_WORDS // 4 if with_ids else CACHE_WORDS), np.array([end_id], "<u4")
        number = TaskContext.get().partitionId() << 40
        # A few documents at a time, so that a task holds the ids of these only.
        for batch in (b.iloc[i:i + STEP] for b in batches for i in range(0, len(b), STEP)):
            rows, ids = [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found = np.concatenate([cache.ids(text or ""), end])
                for k, at in enumerate(range(0, len(found), max_tokens)):
                    part = found[at:at + max_tokens]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids.append(part.astype("int32"))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            if with_ids:
                out = out.assign(number=np.arange(number, number + len(out)), ids=pd.Series(ids, dtype=object))
                number += len(out)
            yield plain(out, "doc_id")

    texts = docs.select(F.col("doc_id").cast("string"), "text")
    done = texts.mapInPandas(run, f"doc_id string, {PIECES}" + (", number long, ids array<int>" if with_ids else ""))
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def best_fit(need: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each item, in the order given. ``need`` has a row (tokens, documents,
    attention) per item. Bins without room for the smallest item leave the search."""
    n, dims = need.shape
    left = np.empty((dims, n))  # residual of each live bin, one row per constraint
    names, used = np.empty(n, "int64"), np.zeros(n, "int64")
    bins, offsets = np.empty(n, "int64"), np.empty(n, "int64")
    scale = weights / capacity.astype(float) ** 2
    active = np.flatnonzero(scale)
    least = need.min(axis=0) if n else capacity
    live = made = 0
    for i in range(n):
        item = need[i]
        fits = np.flatnonzero(left[0, :live] >= item[0])
        for d in range(1, dims):
            fits = fits[left[d, fits] >= item[d]]
        if len(fits):
            if score == "norm":
                value = sum(scale[d] * (left[d, fits] - item[d]) ** 2 for d in active)
            else:
                value = -sum(scale[d] * item[d] * left[d, fits] for d in active)
            at = fits[value.argmin()]
        else:
            at, live = live, live + 1
            left[:, at], names[at] = capacity, made
            made += 1
        left[:, at] -= item
        name = names[at]
        bins[i], offsets[i] = name, used[name]
        used[name] += int(item[0])
        if (left[:, at] < least).any():  # full: the last live bin takes its place
            live -= 1
            left[:, at], names[at] = left[:, live], names[live]
    return bins, offsets


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_documents: int | None = None,
         max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS,
         score: str = "norm", end_id: int = END_ID, vocabulary: str | None = None,
         bucket_rows: int = BUCKET_ROWS, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; with ids also their ids, which are written once and joined to their
    places, so that no bucket holds them. Limits of None do not bind: a sequence of t tokens has at
    most t documents and an attention cost of at most t * t."""
    capacity = np.array([max_tokens, max_documents or max_tokens, max_attention or max_tokens ** 2], float)
    if capacity[2] < max_tokens ** 2:
        max_tokens = min(max_tokens, int(capacity[2] ** 0.5))  # a piece alone must fit
    buckets = max(1, -(-docs.count() // bucket_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ", number long" if with_ids else ""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        size = group["length"].to_numpy("int64")
        need = np.stack([size, np.ones_like(size), size * size], axis=1).astype(float)
        whole = int((size == capacity[0]).sum()) if capacity[1] >= 1 else 0
        bins, offsets = best_fit(need[whole:], capacity, np.asarray(weights, float), score)
        bins = np.concatenate([np.arange(whole), bins + whole])
        base = int(group["_bucket"].iloc[0]) << 40
        return plain(group.drop(columns="_bucket").assign(
            sequence_id=bins + base, offset=np.concatenate([np.zeros(whole, "int64"), offsets])), "doc_id")

    cut = pieces(docs, max_tokens, end_id, vocabulary, with_ids)
    cut = stored(cut) if with_ids else cut
    spread = cut.drop("ids").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(buckets)))
    spread = spread.withColumn("doc_id", F.col("doc_id").cast("string"))
    done = spread.groupBy("_bucket").applyInPandas(
        run, f"doc_id string, {PIECES}{extra}, sequence_id long, offset long")
    if with_ids:
        done = done.join(cut.select("number", "ids"), "number").drop("number")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_documents, ids) from pieces packed with ``with_ids``; a sequence is
    bounded by its limits."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.count("*").alias("n_documents"), parts.alias("_p")
    ).select("sequence_id", "n_tokens", "n_documents", F.flatten(F.col("_p.ids")).alias("ids"))
