"""Ranked full-text search over exchanges.

Terms are lower-cased runs of letters and digits, counted over both message
columns together.  The rank is the published BM25 formula with k1 = 1.2 and
b = 0.75, negated: smaller is better.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.plans.ranking import top_n
from netloom.session import write_table


K1, B = 1.2, 0.75
MIN_IDF = 1e-6
TERM = r"[\p{L}\p{N}]+"


def tokens(*columns) -> Column:
    text = F.lower(F.concat_ws(" ", *columns))
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(MIN_IDF))


def _weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _term(text: str) -> tuple[str, bool]:
    prefix = text.endswith("*")
    word = text.rstrip("*").lower()
    if not word or re.search(r"[\W_]", word):
        raise ValueError(f"not a search term: {text!r}")
    return word, prefix


def search_exchanges(exchanges: DataFrame, all_of=(), any_of=(), none_of=(),
                     limit: int = 20) -> DataFrame:
    """Best matches of one query; a trailing star makes a term a prefix.

    One pass over the text: term counts are row-local, the corpus figures are
    one small aggregate, and the hits end in a bounded top-k, so no posting is
    shuffled.  For many queries use :func:`token_index` and
    :func:`search_many`.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    wanted = [_term(t) for t in (*all_of, *any_of)]
    banned = [_term(t) for t in none_of]
    if not wanted:
        raise ValueError("a query needs at least one positive term")

    def count(word: str, prefix: bool) -> Column:
        return F.size(F.filter("_tokens", (lambda t: t.startswith(word)) if prefix
                               else (lambda t: t == word)))

    counted = exchanges.withColumn("_tokens", tokens("user_message", "assistant_message")).select(
        *exchanges.columns, F.size("_tokens").alias("_len"),
        *[count(*t).alias(f"_tf{i}") for i, t in enumerate(wanted)],
        *[(count(*t) > 0).alias(f"_no{i}") for i, t in enumerate(banned)])
    stats = counted.agg(F.struct(
        F.count("*").alias("n"), F.avg("_len").alias("average"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]
    ).alias("s")).scalar()
    hit = F.lit(True)
    for i in range(len(all_of)):
        hit = hit & (F.col(f"_tf{i}") > 0)
    if any_of:
        some = F.lit(False)
        for i in range(len(all_of), len(wanted)):
            some = some | (F.col(f"_tf{i}") > 0)
        hit = hit & some
    for i in range(len(banned)):
        hit = hit & ~F.col(f"_no{i}")
    rows = counted.where(hit).withColumn("_s", stats)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        score = score - _idf(F.col("_s.n"), F.col(f"_s.df{i}")) * _weight(
            F.col(f"_tf{i}"), F.col("_len"), F.col("_s.average"))
    return rows.select(*exchanges.columns, score.alias("score")).orderBy("score", "id").limit(limit)


def token_index(exchanges: DataFrame) -> DataFrame:
    """Postings ``term, id, tf, length``.

    Counting happens inside the row, so a term is shuffled only when the index
    is written by term.
    """
    base = exchanges.select("id", F.array_sort(
        tokens("user_message", "assistant_message")).alias("_t"))
    # In a sorted list a term's count is the distance between run starts.
    starts = base.select("id", F.size("_t").alias("length"), "_t", F.filter(
        F.transform("_t", lambda t, i: F.when((i == 0) | (t != F.get(F.col("_t"), i - 1)), i)),
        lambda i: i.isNotNull()).alias("_s"))
    runs = starts.select("id", "length", F.zip_with(
        "_s", F.concat(F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))),
                       F.array("length")),
        lambda a, b: F.struct(F.get(F.col("_t"), a).alias("term"), (b - a).alias("tf"))).alias("_r"))
    return runs.select("id", "length", F.explode_outer("_r").alias("_p")).where(
        "_p is not null").select("_p.term", "id", "_p.tf", "length")


def _ranked(postings: DataFrame, queries: DataFrame, frequencies: DataFrame, stats: Column, limit: int) -> DataFrame:
    """Best matches by postings of the asked terms, how many exchanges have each, and the corpus figures."""
    wanted = queries.select("query_id", F.lower("term").alias("term"))
    needed = wanted.groupBy("query_id").agg(F.count("*").alias("_needed"))
    scored = postings.join(frequencies, "term").withColumn("_s", stats).withColumn(
        "_part", -_idf(F.col("_s.n"), F.col("df")) * _weight(F.col("tf"), F.col("length"), F.col("_s.average")))
    totals = scored.join(wanted, "term").groupBy("query_id", "id").agg(
        F.sum("_part").alias("score"), F.count("*").alias("_got")).join(needed, "query_id").where("_got = _needed")
    return top_n(totals.select("query_id", "id", "score"), ["query_id"], [F.col("score"), F.col("id")], limit)


def search_many(exchanges: DataFrame, index: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Best matches of many queries (every term must occur).

    ``queries`` has ``query_id, term`` with distinct terms.  Postings are cut to
    the asked terms by a join.
    """
    stats = exchanges.agg(F.struct(
        F.count("*").alias("n"),
        F.avg(F.size(tokens("user_message", "assistant_message"))).alias("average")).alias("s")).scalar()
    cut = index.join(queries.select(F.lower("term").alias("term")).distinct(), "term", "left_semi")
    return _ranked(cut, queries, cut.groupBy("term").agg(F.count("*").alias("df")), stats, limit)


# --- the index as a table --------------------------------------------------

SHELVES = 64


def _shelf(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHELVES)).cast("int")


def _part(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """All additions of one kind; none yet is an empty table."""
    try:
        return spark.read.schema(f"{schema}, addition long").option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, addition long")


def add_to_index(path: str, exchanges: DataFrame, addition: int) -> None:
    """Stores the postings of new exchanges, and how many of them have each term.

    Postings are laid out by a hash of the term (``shelf``), so that a query
    reads the shelves of its terms only.  An addition has a number and folders of
    its own, which a retry overwrites; exchanges that an earlier addition holds
    are left out.
    """
    spark = exchanges.sparkSession
    known = _part(spark, path, "exchanges", "id long, length int").where(F.col("addition") != addition).select("id")
    fresh = write_table(token_index(exchanges.join(known, "id", "left_anti")).withColumn("shelf", _shelf("term")))
    counted = exchanges.join(known, "id", "left_anti").select("id", F.size(tokens("user_message", "assistant_message")).alias("length"))
    for kind, rows in (("postings", fresh), ("terms", fresh.groupBy("shelf", "term").agg(F.count("*").alias("df")))):
        rows.repartition("shelf").sortWithinPartitions("shelf", "term").write.mode("overwrite").partitionBy("shelf").parquet(
            f"{path}/{kind}/addition={addition}")
    counted.write.mode("overwrite").parquet(f"{path}/exchanges/addition={addition}")


def search_stored(spark: SparkSession, path: str, queries: DataFrame, limit: int = 20) -> DataFrame:
    """:func:`search_many` from a stored index: reads the postings on the shelves of the asked terms."""
    asked = queries.select(F.lower("term").alias("term")).distinct()
    shelves = [r[0] for r in asked.select(_shelf("term")).distinct().collect()]  # at most SHELVES numbers

    def on_shelves(kind: str, schema: str) -> DataFrame:
        return _part(spark, path, kind, f"{schema}, shelf int").where(F.col("shelf").isin(shelves)).join(asked, "term", "left_semi")

    stats = _part(spark, path, "exchanges", "id long, length int").agg(F.struct(
        F.count("*").alias("n"), F.avg("length").alias("average")).alias("s")).scalar()
    postings = on_shelves("postings", "term string, id long, tf int, length int").select("term", "id", "tf", "length")
    frequencies = on_shelves("terms", "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return _ranked(postings, queries, frequencies, stats, limit)
