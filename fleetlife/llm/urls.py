"""URL filters: fixed host/path rules, and association rules mined by Spark's FP-growth.

Mining: a labelled URL is a basket of tokens plus its verdict. Tokens that are in the very same labelled URLs stand for
each other: the longest (then the first by name) is mined for all of them, and tokens in every basket are left out, so
that nested host names do not multiply the item sets. Rules of any length with the wanted verdict on the right side are
kept when they pass the limits of support, confidence and significance and no shorter rule with the same or higher
confidence says the same. Support is a number of rows, the same at every size. Significance: the lower bound
of Wilson's interval of the confidence, ``SIGMAS`` wide, is above the share of bad URLs among all labelled ones.
Matching: every rule has one posting, under its rarest token; a URL meets a rule through that token and then must hold
all others. URLs are matched once each, however many rows carry them.

Defined results: a null URL, or one without ``://``, has empty host, path and tokens, and no rule
fits it. Of fixed rules the longest wins; of mined rules the most confident, then the best supported,
then the first by name. Without labelled rows there are no mined rules and the verdict is ``allow``.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import fold, stored

MIN_ROWS, MIN_CONFIDENCE, SIGMAS = 8, 0.6, 4.0
BLOCK = "verdict=block"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return fold(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, every suffix of the host, path parts by place, file ending, query keys."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("host="), F.array_join(
        F.slice(labels, i + 1, F.size(labels)), ".")))
    names = F.transform(labels, lambda x: F.concat(F.lit("label="), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""),
                        lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.lower(x)))
    ending = F.regexp_extract(path, "(\\.[A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "\\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("key="), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, "^(.*?)://", 1))))
    end = F.when(ending != "", F.array(F.concat(F.lit("ending="), F.lower(ending)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(scheme, suffixes, names, parts, end, keys))
                  ).otherwise(F.array().cast("array<string>"))


def _lower_bound(share: Column, n: Column, sigmas: float) -> Column:
    """The lower end of Wilson's interval of a share of n rows."""
    z = sigmas * sigmas
    return (share + z / (2 * n) - sigmas * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def _merged(baskets: DataFrame, n: int) -> DataFrame:
    """The baskets (id, tokens, bad) with one token for all that are in the same baskets. Sets of baskets are compared by
    their sizes and two sums of 64-bit hashes."""
    rows = baskets.select("id", "bad", F.explode_outer("tokens").alias("token"))
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    sets = rows.groupBy("token").agg(F.count("*").alias("n"), total("id").alias("a"), total(F.lit(1), "id").alias("b"))
    mined = sets.where(F.col("token").isNotNull() & (F.col("n") < n)).groupBy("n", "a", "b").agg(
        F.min_by("token", F.struct(-F.length("token"), "token")).alias("token")).select("token", F.lit(True).alias("_mined"))
    # Baskets without a token left stay: they count.
    return rows.join(mined, "token", "left").groupBy("id", "bad").agg(
        F.collect_list(F.when(F.col("_mined"), F.col("token"))).alias("tokens"))


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", min_rows: int = MIN_ROWS,
         min_confidence: float = MIN_CONFIDENCE, sigmas: float = SIGMAS) -> DataFrame:
    """Rules (rule, tokens, confidence, support) for blocking, from rows with a URL and a flag (null
    flag: not labelled). A rule needs ``min_rows`` bad URLs. The mining is distributed; the rules are written
    before they are pruned."""
    baskets = labelled.where(F.col(bad).isNotNull()).select(tokens_of(F.col(url)).alias("tokens"), F.col(bad).alias("bad"))
    baskets = stored(baskets.where(F.size("tokens") > 0).withColumn("id", F.monotonically_increasing_id()))
    n, share = baskets.agg(F.count("*"), F.avg(F.col("bad").cast("int"))).first()
    verdict = F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    items = stored(_merged(baskets, n).select(F.concat("tokens", verdict).alias("items")))
    # A little less than the share of min_rows, which rounding could put above it.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_rows - 0.5) / max(1, n)), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK)).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rows = F.round(F.col("support") * n / F.col("confidence"))  # labelled URLs with these tokens
    rules = rules.where(_lower_bound(F.col("confidence"), rows, sigmas) > F.lit(share or 0.0))
    rules = stored(rules.select(F.array_join("tokens", " & ").alias("rule"), "tokens", "confidence", "support"))
    # A longer rule says nothing new when a rule on a part of its tokens is as confident.
    wide = rules.select("rule", "confidence", "tokens", F.explode("tokens").alias("key"))
    short = _postings(rules).select("key", F.col("confidence").alias("o_confidence"), F.col("tokens").alias("o_tokens"))
    said = wide.join(short, "key").where(
        (F.size("o_tokens") < F.size("tokens")) & (F.col("o_confidence") >= F.col("confidence"))
        & (F.size(F.array_except("o_tokens", "tokens")) == 0)).select("rule").distinct()
    return rules.join(said, "rule", "left_anti")


def _postings(rules: DataFrame) -> DataFrame:
    """The rules, each with its rarest token as ``key``."""
    uses = rules.select(F.explode("tokens").alias("key")).groupBy("key").agg(F.count("*").alias("uses"))
    return (rules.select("rule", "tokens", "confidence", "support", F.explode("tokens").alias("key"))
            .join(uses, "key")
            .groupBy("rule", "tokens", "confidence", "support")
            .agg(F.min_by("key", F.struct("uses", "key")).alias("key")))


def match(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Best mined rule per distinct URL: (url, matched_rule, confidence). URLs without one are left out."""
    distinct = urls.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    bag = distinct.withColumn("_bag", tokens_of(F.col("url")))
    met = (bag.select("url", "_bag", F.explode("_bag").alias("key")).join(small_side(_postings(rules)), "key")
           .where(F.size(F.array_except("tokens", "_bag")) == 0))
    best = met.groupBy("url").agg(F.min(F.struct(
        (-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "rule")).alias("b"))
    return best.select("url", F.col("b.rule").alias("matched_rule"), (-F.col("b.c")).alias("confidence"))


def fixed_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Longest of the given rules (host, path, verdict) that fits, per distinct URL: (url, rule, verdict).
    The index is the rule's host; a URL looks up each suffix of its own host at a dot."""
    distinct = urls.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    labels = F.split(host_of(F.col("url")), "\\.")
    suffixes = F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    parts = distinct.select("url", path_of(F.col("url")).alias("_path"), F.explode(F.array_distinct(suffixes)).alias("_host"))
    index = rules.select(F.col("host").alias("_host"), F.col("path").alias("_start"), F.col("verdict").alias("verdict"))
    met = parts.join(small_side(index), "_host").where(F.startswith("_path", "_start"))
    name = F.concat("_host", "_start")
    best = met.groupBy("url").agg(F.max(F.struct(F.length(name).alias("n"), name.alias("rule"), "verdict")).alias("b"))
    return best.select("url", "b.rule", "b.verdict")


def judge(pages: DataFrame, given: DataFrame, mined: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``pages`` with host, path, rule, verdict, matched_rule and confidence. Columns of
    those names in ``pages`` are replaced."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "matched_rule", "confidence")]
    by_rule = fixed_rules(pages, given, url).withColumnsRenamed({"url": "_url", "verdict": "_given"})
    by_mined = match(pages, mined, url).withColumnRenamed("url", "_mined_url")
    facts = by_rule.join(by_mined, F.col("_url") == F.col("_mined_url"), "full").select(
        F.coalesce("_url", "_mined_url").alias("_fact_url"), "rule", "_given", "matched_rule", "confidence")
    out = pages.select(*own).join(facts, F.col(url) == F.col("_fact_url"), "left")
    return out.select(
        *own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), "rule",
        F.coalesce("_given", F.when(F.col("matched_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "matched_rule", "confidence")
