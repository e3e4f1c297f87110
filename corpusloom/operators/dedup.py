"""Exact duplicates by a key: first or last wins, capped, counted, flagged.

Where only an id decides, the winner is an aggregate (combined before the shuffle, so a key that many copies share
costs a row a task), joined back; ranks are for caps and for orders of several columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """Adds ``kept``: the row holds its key's smallest ``order``.  Rows with a null key are all kept."""
    keyed = df.withColumn("__key", key)
    firsts = keyed.groupBy("__key").agg(F.min(order).alias("__first"))
    kept = F.coalesce(F.col(order) == F.col("__first"), F.lit(True))
    return keyed.join(firsts, "__key", "left").withColumn("kept", kept).drop("__key", "__first")


def ranked(df: DataFrame, keys: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def capped(df: DataFrame, key: Column, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of a key; Spark keeps that many a task before the key's rows meet."""
    return ranked(df, [key], order).where(F.col("rank") <= most)


def upsert(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return ranked(df, [F.col(key)], [c.desc() for c in order]).where(F.col("rank") == 1).drop("rank")


def counters(df: DataFrame, key: Column) -> DataFrame:
    """rows, unique keys, and rows beyond the first of each key."""
    n = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def word_bucket(df: DataFrame, words: Column, top: int = 32, of_first: int = 2000) -> DataFrame:
    """doc_id, bucket: SHA-1 (8 hex digits) of the commonest words, ties by the word.

    Counted within each row by sorting its words, so nothing is exploded or shuffled.
    """
    ws = F.array_sort(F.slice(words, 1, of_first))
    df = df.select("doc_id", ws.alias("ws"))
    # a run of equal words begins where a word differs from the one before; its length is the way to the next beginning
    starts = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: (i == 0) | (F.get("ws", i) != F.get("ws", i - 1)))
    df = df.select("doc_id", "ws", F.when(F.size("ws") > 0, starts).otherwise(F.array().cast("array<int>")).alias("at"))
    counted = F.transform("at", lambda i, k: F.struct((i - F.coalesce(F.get("at", k + 1), F.size("ws"))).alias("n"), F.get("ws", i).alias("w")))
    best = F.transform(F.slice(F.array_sort(counted), 1, top), lambda s: s["w"])
    return df.select("doc_id", F.substring(F.sha1(F.array_join(best, " ")), 1, 8).alias("bucket"))
