"""Substring dedup over sentence spans.

A sentence ends after ``.``, ``!`` or ``?`` before white space, or at a line break. From every sentence, and to the
end of every sentence, runs the shortest span of consecutive sentences that is long enough: at least ``SPAN`` of them
with ``MIN_WORDS`` words together, or fewer when they have ``LONG_WORDS`` words already. Every sentence of a longer
repeated run is in one of these spans that lies in the run, so that such a run goes as a whole. Equal spans are found by a global join on their hash (64 bits of the
white-space-normalised, A-Z lower-cased sentences). The first place of a span, by (doc_id, text hash,
sentence), stays; sentences covered by any later place are removed.

Defined results: null or empty text has no sentences; a null doc_id comes last in the order; rows equal in
doc_id and text count as one document; a text with fewer words than a span needs has no spans. Extra columns
are carried by ``remove`` and ignored elsewhere.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, stored

SPAN, MIN_WORDS, LONG_WORDS = 2, 20, 40
_CUT = re.compile(rb"(?<=[.!?])(?=[\x20\x09-\x0d])|(?<=\n)")


def sentences(text: str | None) -> list[bytes]:
    """The pieces of a text; joined they are the text again. White space leads the next sentence."""
    return [s for s in _CUT.split((text or "").encode()) if s]


def _runs(counts: np.ndarray, span: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end (exclusive) of the shortest spans from each sentence and to the end of each sentence."""
    n = len(counts)
    total = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(n)
    usual = np.maximum(at + span, np.searchsorted(total, total[:-1] + min_words))
    end = np.minimum(usual, np.searchsorted(total, total[:-1] + long_words))
    to = at + 1
    usual = np.minimum(to - span, np.searchsorted(total, total[1:] - min_words, "right") - 1)
    first = np.maximum(usual, np.searchsorted(total, total[1:] - long_words, "right") - 1)
    new = (first >= 0) & (end[first] != to)  # not the shortest from its first sentence too
    return np.concatenate([at[end <= n], first[new]]), np.concatenate([end[end <= n], to[new]])


def spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(key, doc_id, text_hash, first, last): every span of every text, by sentence number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = {"key": [], "doc_id": [], "text_hash": [], "first": [], "last": []}
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = [s.lower().split() for s in sentences(text)]
                place = np.flatnonzero([len(w) > 0 for w in words])  # a piece without a word is no sentence
                if not len(place):
                    continue
                own = [digest(b" ".join(words[i])) for i in place]
                low, end = _runs(np.fromiter((len(words[i]) for i in place), "int64", len(place)), span, min_words, long_words)
                packed = np.array(own, "<u8").tobytes()
                out["key"].append(np.fromiter((digest(packed[8 * i:8 * j]) for i, j in zip(low, end)), "<u8", len(low)).view("int64"))
                out["first"].append(place[low])
                out["last"].append(place[end - 1])
                out["doc_id"] += [doc] * len(low)
                out["text_hash"].append(np.full(len(low), np.uint64(digest(text.encode()))).view("int64"))
            flat = {k: v if k == "doc_id" else (np.concatenate(v) if v else np.array([], "int64")) for k, v in out.items()}
            yield plain(pd.DataFrame(flat), "doc_id")

    done = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        run, "key long, doc_id string, text_hash long, first int, last int")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """Documents with text to remove: doc_id, text_hash, spans (merged runs of sentences to remove), n_removed
    sentences, and the doc_ids where the spans come first. Spans are reduced to one row per key before the
    join, so that a passage in a third of all documents is one small row on that side."""
    found = stored(spans(docs, span, min_words, long_words))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "first")
    # Written, so that the join below deals both sides anew and can split the places of a frequent span.
    firsts = stored(found.groupBy("key").agg(F.min(order).alias("at"), F.max(order).alias("top"))
                    .where("at != top").select("key", "at"))
    later = found.join(firsts, "key").where(
        ~(F.col("at.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("at.text_hash") == F.col("text_hash"))
          & (F.col("at.first") == F.col("first"))))
    per_doc = later.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("s"),
        F.sort_array(F.collect_set("at.doc_id")).alias("first_doc_ids"))
    merged = F.aggregate(
        "s", F.array().cast("array<struct<first:int,last:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1)["last"], F.lit(-2)) + 1 >= x["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.get(done, F.size(done) - 1)["first"].alias("first"),
                F.greatest(F.get(done, F.size(done) - 1)["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(x))))
    return per_doc.select("doc_id", "text_hash", merged.alias("spans"), "first_doc_ids").withColumn(
        "n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1))


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with the sentences of ``found`` taken out of their text; the columns of ``docs``."""
    @F.pandas_udf("string")
    def cut(text: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(text, gone):
            parts = sentences(t)
            for s in spans_:
                parts[s["first"]:s["last"] + 1] = [b""] * (s["last"] + 1 - s["first"])
            out.append(b"".join(parts).decode())
        return pd.Series(out)

    @F.pandas_udf("long")
    def key(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([xxhash.xxh3_64_intdigest((t or "").encode()) for t in text], "<u8").view("int64"))

    side = found.select(F.col("doc_id").alias("_f_id"), F.col("text_hash").alias("_f_hash"), F.col("spans").alias("_f_spans"))
    keyed = docs.withColumn("_f_key", key(F.col("text")))
    joined = keyed.join(side, keyed["doc_id"].eqNullSafe(side["_f_id"]) & (keyed["_f_key"] == side["_f_hash"]), "left")
    new = F.when(F.col("_f_spans").isNull(), F.col("text")).otherwise(
        cut(F.coalesce("text", F.lit("")), F.coalesce("_f_spans", F.array().cast("array<struct<first:int,last:int>>"))))
    return joined.withColumn("text", new).select(*docs.columns)
