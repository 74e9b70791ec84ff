"""Line-first quality rules, in SQL functions only: no shuffle, one pass, any text length.

Each line with a word is judged by three rules; lines that fail are removed, and a document is
rejected when too large a part of its words went with them, or when the base rule fails:

* punctuation: a short line without a closing mark, or one where punctuation is a large share of
  the characters in words;
* navigation: separators between few words, as in menus and tables of links;
* boilerplate: a short line with a notice that sites repeat.

Defined results: null or empty text has no words and fails the base rule. Lines without a word are
never judged and stay. Equal rows get equal answers, row by row. An input column named ``quality``
is replaced; all other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, words_of

# Marks that close a line, separators of menus, phrases of notices.
CLOSING = ".!?…:;\"'”’»)]"
SEPARATORS = "[|»›•·¦]"
PUNCTUATION = "[!-/:-@\\[-`{-~…“”‘’«»]"
NOTICES = ("all rights reserved|copyright|licensed under|released under the|cookie|privacy policy|terms of use|"
           "terms of service|javascript|click here|sign in|sign up|log in|subscribe|newsletter|read more|"
           "share this|back to top|powered by|lorem ipsum|skip to content")

BASE_WORDS, BASE_REPEAT_PERCENT, REPEAT_SPAN = 20, 30, 8
SHORT_LINE, NOTICE_LINE, PUNCTUATION_PERCENT, LOST_PERCENT = 6, 30, 20, 50


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, marks, ""))


def _fails(line: Column, body: Column, n: Column, short: int, notice: int, punctuation: int) -> Column:
    """``line_fails`` with the line's text without gaps and its number of words at hand."""
    bars = _count(body, SEPARATORS)
    closed = F.lit(CLOSING).contains(F.substring(body, -1, 1))
    unpunctuated = ~closed & (n < short)
    shouting = F.lit(100) * _count(body, PUNCTUATION) > F.lit(punctuation) * F.length(body)
    navigation = (bars >= 2) & (bars * 4 >= n)
    boilerplate = (n <= notice) & F.lower(line).rlike(NOTICES)
    return (n > 0) & (unpunctuated | navigation | shouting | boilerplate)


def line_fails(line: Column, short: int = SHORT_LINE, notice: int = NOTICE_LINE,
               punctuation: int = PUNCTUATION_PERCENT) -> Column:
    """Whether a line with a word fails a rule. A line without a word never fails."""
    return _fails(line, F.regexp_replace(line, GAP, ""), F.size(words_of(line)), short, notice, punctuation)


def repeated_words(words: Column, hashes: Column, order: Column, span: int = REPEAT_SPAN) -> Column:
    """Number of words inside windows that occur twice or more. ``order`` is the sorted array of
    (hash, position); a window repeats when a neighbour in it has the same hash."""
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter(order, lambda x, i: same(F.get(order, i - 1), x) | same(F.get(order, i + 1), x))
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def assess(docs: DataFrame, text: str = "text", short: int = SHORT_LINE, notice: int = NOTICE_LINE,
           punctuation: int = PUNCTUATION_PERCENT, lost_percent: int = LOST_PERCENT) -> DataFrame:
    """The rows of ``docs`` with a struct ``quality``: the base counts, base_failed, kept, the cleaned
    text and what was removed. Steps are projections; helper columns start with ``_q_``."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*[c for c in docs.columns if c != "quality"], body.alias("_q_text"))
    # Lines are cut into words once; a line's text without gaps, its number of words and the text's words follow from these.
    df = df.withColumn("_q_cut", F.transform(F.split("_q_text", "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("words"))))
    df = df.withColumns({
        "_q_words": F.flatten("_q_cut.words"),
        "_q_lines": F.transform("_q_cut", lambda x: F.struct(
            x["line"].alias("line"), F.concat_ws("", x["words"]).alias("body"), F.size(x["words"]).alias("n"))),
    })
    df = df.withColumns({
        "_q_n": F.size("_q_words"),
        "_q_full": F.filter("_q_lines", lambda x: x["n"] > 0)["line"],
        "_q_left": F.filter("_q_lines", lambda x: ~_fails(x["line"], x["body"], x["n"], short, notice, punctuation)),
        "_q_hash": F.when(F.size("_q_words") >= REPEAT_SPAN, F.transform(
            F.sequence(F.lit(1), F.size("_q_words") - (REPEAT_SPAN - 1)),
            lambda i: F.xxhash64(F.slice("_q_words", i, REPEAT_SPAN)))),
    })
    df = df.withColumns({
        "_q_clean": F.concat_ws("\n", "_q_left.line"),
        "_q_order": F.when(F.size(F.array_distinct("_q_hash")) < F.size("_q_hash"), F.sort_array(
            F.transform("_q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))),
    })
    df = df.withColumns({
        "_q_at": repeated_words(F.col("_q_words"), F.col("_q_hash"), F.col("_q_order")),
        "_q_rest": F.aggregate("_q_left.n", F.lit(0), lambda a, n: a + n),
    })
    covered = F.aggregate(
        F.transform("_q_at", lambda p, i: F.least(F.lit(REPEAT_SPAN), F.coalesce(
            p - F.get("_q_at", i - 1), F.lit(REPEAT_SPAN)))),
        F.lit(0), lambda a, b: a + b)
    # A filter on the verdict must not be moved below this row number, or every step would be inlined into it.
    df = df.withColumns({"_q_repeat": F.coalesce(covered, F.lit(0)), "_q_stop": F.monotonically_increasing_id()})
    failed = (F.col("_q_n") < BASE_WORDS) | (
        F.col("_q_repeat").cast("long") * 100 > F.col("_q_n").cast("long") * BASE_REPEAT_PERCENT)
    lost = F.col("_q_n") - F.col("_q_rest")
    enough = lost.cast("long") * 100 <= F.col("_q_n").cast("long") * lost_percent
    quality = F.struct(
        F.col("_q_n").cast("long").alias("n_words"),
        F.aggregate("_q_lines.body", F.lit(0).cast("long"), lambda a, b: a + F.length(b)).alias("word_chars"),
        _count(F.col("_q_text"), "[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_q_full") - F.size(F.array_distinct("_q_full"))).cast("long").alias("n_dup_lines"),
        F.col("_q_repeat").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & enough & (F.col("_q_stop") >= 0)).alias("kept"),
        (F.size("_q_lines") - F.size("_q_left")).cast("long").alias("n_removed_lines"),
        lost.cast("long").alias("n_removed_words"),
        F.col("_q_clean").alias("clean_text"),
    )
    return df.select(*[c for c in docs.columns if c != "quality"], quality.alias("quality"))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their cleaned text; the columns of ``docs``."""
    judged = assess(docs, text).where("quality.kept")
    return judged.withColumn(text, F.col("quality.clean_text")).select(*docs.columns)
