"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A rule is a canonical URL, host and path.  It fits a URL whose host is the
rule's or below it and whose path starts with the rule's; the longest rule
wins.  A URL asks for every pair of a host suffix (cut at dots) and a path start
(of a length that some rule has).  The filter has 64-bit blocks; a key sets
three bits of one block, so one look decides; filter and path lengths are
constants of the plan.  Pairs that pass are joined
exactly with the rules, once per distinct (host, path); URLs without any such
pair take the method's own verdict, allow, and never shuffle.

All work is DataFrame functions.  The filter has a fixed number of blocks
(4096: 32 KB), whatever the list's length; beyond about 20,000 rules give more
blocks, or more pairs than need be go to the join.

Cases: null URL or one without ``://``: empty host and path, no rule; empty
rule table: all allowed; repeated pages keep their rows; input columns named
like an output column give way; a rule listed twice with both verdicts blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.texts import free_name, lower_ascii, others

BLOCKS = 4096
# The rules of the contract (verdict, host, path).
CONTRACT_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def url_host(url) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mask(h: Column) -> Column:
    bit = lambda shift: F.expr("1L") if shift is None else F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int"))
    return bit(46).bitwiseOR(bit(52)).bitwiseOR(bit(58))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h.bitwiseAND((1 << 40) - 1), F.lit(blocks)).cast("int")


def filter_words(rules: DataFrame, blocks: int = BLOCKS) -> np.ndarray:
    """The filter: ``blocks`` words, whatever the number of rules."""
    h = F.xxhash64("key")
    words = np.zeros(blocks, np.int64)
    for row in rules.groupBy(_block(h, blocks).alias("block")).agg(F.bit_or(_mask(h)).alias("word")).collect():
        words[row["block"]] = row["word"]
    return words


def canonical_rules(rules: DataFrame) -> DataFrame:
    """verdict, host, path -> key, rule, size, verdict; one row per rule, block before allow."""
    host, path = lower_ascii("host"), F.coalesce("path", F.lit(""))
    return (rules.where("host is not null and verdict is not null")
            .select(F.concat_ws("\n", host, path).alias("key"), F.concat(host, path).alias("rule"),
                    F.char_length(path).alias("path_size"), "verdict")
            .groupBy("key", "rule", "path_size").agg(F.max("verdict").alias("verdict"))
            .withColumn("size", F.char_length("rule")))


def url_keys(host, path, sizes: Column) -> Column:
    """Every pair of host suffix and path start that a rule could have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(sizes, lambda n: n <= F.char_length(path)),
                         lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat_ws("\n", s, p))))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``urls``."""
    listed = canonical_rules(rules)
    words = F.lit(filter_words(listed, blocks))
    sizes = F.lit(np.array(sorted(r[0] for r in listed.select("path_size").distinct().collect()), np.int32))
    out = ["host", "path", "rule", "verdict"]
    name = free_name(urls, "possible_keys")

    def passes(key):
        h = F.xxhash64(key)
        return F.element_at(words, _block(h, blocks) + 1).bitwiseAND(_mask(h)) == _mask(h)

    split = urls.select(*others(urls, *out), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    keyed = split.withColumn(name, F.filter(url_keys(F.col("host"), F.col("path"), sizes), passes))
    asked = keyed.where(F.size(name) > 0)
    pairs = asked.select("host", "path", name).dropDuplicates(["host", "path"])
    best = (pairs.select("host", "path", F.explode(name).alias("key")).join(listed, "key")
            .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("size", "rule")).alias("best")))
    judged = asked.join(best, ["host", "path"], "left").select(
        *others(urls, *out), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    rest = keyed.where(F.size(name) == 0).select(
        *others(urls, *out), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return judged.unionByName(rest)
