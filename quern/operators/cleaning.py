"""Cleaning of crawled pages: thin pages, lines repeated across pages, consecutive duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import count_tokens, stripped
from quern.session import materialise

#: Share and least number of pages from which a line is boilerplate, its greatest length, the least
#: collection, and what must be left of a page.
RATIO, LEAST_PAGES, LONGEST, LEAST_COLLECTION = 0.30, 6, 90, 4
LEAST_LEFT, LEAST_SHARE = 200, 0.15
#: A line to drop is hot from this part of all occurrences of such lines on.
HOT_PARTS = 10_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")


def thin_pages(pages: DataFrame, text: str = "text", min_tokens: int = 0) -> DataFrame:
    """Pages without text, or with fewer than ``min_tokens`` tokens where that is set."""
    bare = stripped(F.coalesce(F.col(text), F.lit("")))
    thin = F.length(bare) == 0
    return pages.where(thin | (count_tokens(F.col(text)) < min_tokens) if min_tokens > 0 else thin)


def boilerplate_lines(pages: DataFrame, key: str, text: str, ratio: float = RATIO) -> DataFrame:
    """Lines, in lower case, on at least ``max(6, ratio of the pages)`` pages: ``line, n_pages``.

    Lines longer than 90 characters never count, and collections of fewer than four pages have none. Pages are
    counted by distinct key: pre-aggregated for each task, so that a line on every page is no hot key.
    """
    known = pages.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    total = known.agg(F.countDistinct(key).alias("total"))
    lines = known.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), lambda x: F.lower(stripped(x))))).alias("line"))
    counted = lines.where((F.col("line") != "") & (F.length("line") <= LONGEST)).distinct().groupBy("line").agg(F.count("*").alias("n_pages"))
    least = F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("total") * F.lit(ratio).cast("double")))
    # ``total`` is one row.
    return counted.crossJoin(F.broadcast(total)).where((F.col("total") >= LEAST_COLLECTION) & (F.col("n_pages") >= least)).select("line", "n_pages")


def without_boilerplate(pages: DataFrame, key: str, text: str, ratio: float = RATIO) -> DataFrame:
    """``key, clean, kept_original``: each page without the collection's boilerplate and consecutive duplicates.

    A page of which less than 200 characters or 15 % would be left keeps its text. Keys are taken as unique; a
    null text is left out. Lines to drop that make up much of all lines – so there are at most ``HOT_PARTS`` of them – are
    looked up by broadcast, the others by a join on the line; blank lines, the most frequent of all, take no part in either.
    """
    known = pages.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    lines = known.select("_key", F.length("_text").alias("size"), F.posexplode(_lines(F.col("_text"))).alias("pos", "line")).withColumn("norm", F.lower(stripped("line")))
    drop = materialise(boilerplate_lines(pages, key, text, ratio), "site-lines")
    # Each counts for its pages at least, so no more than so many can reach this bound.
    least_hot = max(1, (drop.agg(F.sum("n_pages")).first()[0] or 0) // HOT_PARTS)
    hot = F.broadcast(drop.where(F.col("n_pages") >= least_hot).select(F.col("line").alias("norm")))
    seldom = drop.where(F.col("n_pages") < least_hot).select(F.col("line").alias("norm"))
    blank = lines.where("norm = ''")
    kept = blank.unionByName(lines.where("norm <> ''").join(hot, "norm", "left_anti").join(seldom, "norm", "left_anti"))
    order = Window.partitionBy("_key").orderBy("pos")
    kept = kept.withColumn("before", F.lag("norm").over(order)).where((F.col("norm") == "") | F.col("before").isNull() | (F.col("norm") != F.col("before")))
    joined = kept.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("clean"))
    both = known.join(joined, "_key", "left").withColumn("clean", stripped(F.coalesce("clean", F.lit(""))))
    gutted = F.length("clean") < F.greatest(F.lit(LEAST_LEFT), F.floor(F.length("_text") * F.lit(LEAST_SHARE).cast("double")))
    return both.select(F.col("_key").alias(key), F.when(gutted, F.col("_text")).otherwise(F.col("clean")).alias("clean"), gutted.alias("kept_original"))


def consecutive_duplicates(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, line`` of each non-blank line equal to the line before it but for case and surrounding space."""
    lines = pages.select(F.col(key), F.posexplode(_lines(F.col(text))).alias("pos", "line")).withColumn("norm", F.lower(stripped("line")))
    order = Window.partitionBy(key).orderBy("pos")
    return lines.withColumn("before", F.lag("norm").over(order)).where((F.col("norm") != "") & (F.col("norm") == F.col("before"))).select(key, "pos", "line")
