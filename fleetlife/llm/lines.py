"""Line dedup by a suffix array over sequences of line ids, in DataFrame operations only.

Lines with a word are the symbols of a document; lines that occur once in the corpus can be in no repeated run
and end the sequences. Prefix doubling ranks all suffixes: the rank of a suffix by its first 2k lines is the
place of the pair (rank of its first k lines, rank of the k lines after them) among all such pairs, found by a
range sort of the distinct pairs. Equal ranks are an interval of the suffix array in which the longest common
prefix is at least the length.

A repeated run must have ``min_words`` words. For each suffix that fixes a least number of lines, at most
``min_words``, so doubling stops at the power of two below that; two overlapping ranks name any length in between.
Suffixes with one name form the interval of the suffix array whose common prefix reaches that length. Its first
member by (doc_id, text hash, line) stays; the lines of all others are later copies. Shortest windows from each line
would leave the end of a repeated run where the lines after the last whole window have fewer words, so the shortest
windows that end at each line are compared too. Each line of a repeated run of ``min_words`` words is in a window of one
of the two kinds that lies in the run (take lines off either end while the words suffice), so that overlapping copies
are the maximal repeated runs.

Defined results: null or empty text has no lines; a null doc_id comes last in the order; rows equal in doc_id and
text count as one document; lines without a word are never removed and do not break a run. Extra columns are
carried by ``remove`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored, words_of

MIN_WORDS = 10
DOC = ["doc_id", "text_hash"]
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, place, line_no, n_words, h1, h2): one row per line with a word. ``place`` counts those
    lines, ``line_no`` all lines of the text, both from 0. (h1, h2) is a 128-bit id of the line."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))),
                     lambda x: x["line"].rlike(HAS_WORD))
    rows = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines).alias("place", "_l"))
    line = F.col("_l.line")
    return rows.select(*DOC, "place", "_l.line_no", F.size(words_of(line)).alias("n_words"),
                       F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"))


def _in_doc() -> Window:
    return Window.partitionBy(*DOC).orderBy("place")


def _ahead(column: str, by: int) -> Column:
    """The value ``by`` lines later (earlier, if negative), null where one of the lines between is not there."""
    w = _in_doc()
    return F.when(F.lead("place", by).over(w) == F.col("place") + by, F.lead(column, by).over(w)) if by else F.col(column)


def _ranked(rows: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Add ``name``: the place of (first, second) among the distinct pairs. The rows of a frequent pair meet one
    row of the pairs, so that the join splits them."""
    rows = rows.withColumn(second, F.coalesce(second, F.lit(-1)))
    pairs = numbered(rows.select(first, second).distinct(), [first, second], name)
    return stored(rows.join(pairs, [first, second]))


def suffix_ranks(docs: DataFrame, longest: int) -> DataFrame:
    """Lines that occur twice or more, with rank_0, rank_1, ...: the order of the suffixes by their first 1, 2, 4,
    ... lines, as long as that is at most ``longest``."""
    lines = line_ids(docs)
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("_n")).where("_n > 1").select("h1", "h2")
    rows = lines.join(repeated, ["h1", "h2"]).dropDuplicates([*DOC, "place"])
    rows = _ranked(rows, "h1", "h2", "rank_0").drop("h1", "h2")
    level = 0
    while 2 ** (level + 1) <= longest:
        rows = rows.withColumn("_next", _ahead(f"rank_{level}", 2 ** level))
        rows = _ranked(rows, f"rank_{level}", "_next", f"rank_{level + 1}").drop("_next")
        level += 1
    return rows


def _window(n_lines: Column, min_words: int, to_end: bool) -> Column:
    """The window of ``n_lines`` lines from a line, or to its end there, as a struct: its place relative to the line,
    its length and the two overlapping ranks that name it."""
    first, second = F.lit(None).cast("long"), F.lit(None).cast("long")
    for n in range(min_words, 0, -1):
        level, back = n.bit_length() - 1, n - 1 if to_end else 0
        first = F.when(n_lines == n, _ahead(f"rank_{level}", -back)).otherwise(first)
        second = F.when(n_lines == n, _ahead(f"rank_{level}", n - 2 ** level - back)).otherwise(second)
    return F.struct((1 - n_lines if to_end else F.lit(0)).alias("shift"), n_lines.alias("length"), first.alias("a"), second.alias("b"))


def copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines that are later copies: (doc_id, text_hash, place, line_no, run_start)."""
    rows = suffix_ranks(docs, min_words)
    w = _in_doc()
    words = lambda low, high: F.sum("n_words").over(w.rowsBetween(low, high))
    there = lambda by: F.lead("place", by).over(w) == F.col("place") + by if by else F.lit(True)
    sizes = range(1, min_words + 1)
    from_here = F.coalesce(*[F.when((words(0, n - 1) >= min_words) & there(n - 1), n) for n in sizes])
    to_end = F.coalesce(*[F.when((words(1 - n, 0) >= min_words) & there(1 - n), n) for n in sizes])
    # One that falls short without its last line is the shortest from its first line too.
    new = F.coalesce(*[F.when(to_end == n, words(1 - n, -1) >= min_words) for n in sizes if n > 1], F.lit(False))
    named = rows.withColumns({"_from": from_here, "_to": F.when(new, to_end)})
    windows = F.array(_window(F.col("_from"), min_words, False), _window(F.col("_to"), min_words, True))
    named = named.withColumn("_windows", windows).select(*DOC, "place", "line_no", F.posexplode("_windows").alias("_kind", "_w"))
    named = named.where("_kind = 0 OR _w.length IS NOT NULL").select(
        *DOC, "place", "line_no", "_kind", (F.col("place") + F.col("_w.shift")).alias("_start"),
        F.col("_w.length").alias("_length"), F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"))
    named = stored(named)
    key = ["_length", "_a", "_b"]
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), *DOC, F.col("_start").alias("place"))
    # Written, so that the join below deals both sides anew and can split the rows of a frequent run.
    intervals = stored(named.where("_length IS NOT NULL").groupBy(*key).agg(
        F.min(order).alias("_first"), F.max(order).alias("_last")).where("_first != _last").select(*key, "_first"))
    later = F.col("_first").isNotNull() & (F.col("_first") != order)
    marked = named.join(intervals, key, "left").withColumns({
        "_end": F.when(later, F.col("_start") + F.col("_length") - 1), "_start": F.when(later, F.col("_start"))})
    near = min_words - 1
    covered = marked.withColumns({
        "_reach": F.max("_end").over(w.rangeBetween(-near, 0)),
        "_since": F.min("_start").over(w.rangeBetween(0, near))}).where("_kind = 0 AND (_reach >= place OR _since <= place)")
    fresh = F.coalesce(F.lag("place").over(w) + 1 != F.col("place"), F.lit(True))
    return covered.select(*DOC, "place", "line_no", fresh.alias("run_start"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with lines to remove: doc_id, text_hash, n_removed, n_runs (runs of removed lines) and the line numbers."""
    return copies(docs, min_words).groupBy(*DOC).agg(
        F.count("*").alias("n_removed"), F.sum(F.col("run_start").cast("long")).alias("n_runs"),
        F.sort_array(F.collect_list("line_no")).alias("lines"))


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without the lines of ``found``; one that has no word left, but had one, goes. The columns of
    ``docs``."""
    side = found.select(F.col("doc_id").alias("_f_id"), F.col("text_hash").alias("_f_hash"), F.col("lines").alias("_f_lines"))
    joined = docs.join(side, docs["doc_id"].eqNullSafe(side["_f_id"]) & (F.xxhash64(docs["text"]) == side["_f_hash"]), "left")
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_f_lines"))
    new = F.when(F.col("_f_lines").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    out = joined.withColumn("text", new)
    return out.where(F.col("_f_lines").isNull() | F.col("text").rlike(HAS_WORD)).select(*docs.columns)
