"""Joins: spans, containment with an anchor, leaks, holdouts, bands, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import textfn as X

#: Rows of a span table that may be broadcast.
SPAN_ROWS = 100_000


def span_lookup(df: DataFrame, point: str, spans: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Adds the name of the span [lo, hi] that holds ``point``, else 'unknown'; of several the greatest name.

    A span table of a checked size is broadcast; a larger one is cut into cells of ``width`` and joined by cell.  Only
    where spans may overlap are a row's matches brought together, by a number that the row gets.
    """
    inside = F.col(point).between(F.col("lo"), F.col("hi"))
    few = spans.limit(SPAN_ROWS + 1).count() <= SPAN_ROWS
    if few:
        before = F.max("hi").over(Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
        apart = not spans.withColumn("__before", before).where(F.col("lo") <= F.col("__before")).take(1)
        if apart:
            return df.join(F.broadcast(spans), inside, "left").select(*df.columns, F.coalesce("name", F.lit("unknown")).alias("name"))
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    if few:
        joined = rows.join(F.broadcast(spans), inside, "left")
    else:
        cells = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
        joined = rows.withColumn("__cell", F.floor(F.col(point) / width)).join(cells, ["__cell"], "left")
    found = joined.groupBy("__row", *df.columns).agg(F.max(F.when(inside, F.col("name"))).alias("name"))
    return found.select(*df.columns, F.coalesce("name", F.lit("unknown")).alias("name"))


def normalised(c: Column) -> Column:
    """Lower case, everything but letters and digits to single spaces, a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(X.text_or_empty(c)), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))


def containment(docs: DataFrame, items: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, item_id) where a document holds an item's words in a row, found through anchors.

    An item's anchor is its longest interior word (the rarest kind to stand in a document by chance); documents meet
    items by equality of that word, and only these pairs are compared in full.  Items are taken of ``least``
    characters or more.  The same pairs as a nested loop gives, without comparing each document to each item.
    """
    d = docs.select("doc_id", normalised(F.col("text")).alias("d"))
    i = items.select("item_id", normalised(F.col("text")).alias("i")).where(F.length(F.trim("i")) >= least)
    longest = F.array_max(F.transform(F.split(F.trim("i"), " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    i = i.withColumn("anchor", longest)
    known = i.select("anchor").distinct()
    if known.limit(SPAN_ROWS + 1).count() <= SPAN_ROWS:
        # few anchors: texts are cut down before they travel
        words = d.select("doc_id", "d", F.explode(F.array_distinct(F.split(F.trim("d"), " "))).alias("anchor"))
        return words.join(F.broadcast(known), "anchor", "left_semi").join(i, "anchor").where(F.contains("d", F.col("i"))).select("doc_id", "item_id")
    # only ids travel with the words; a text is met again by the pairs of its id
    words = d.select("doc_id", F.explode(F.array_distinct(F.split(F.trim("d"), " "))).alias("anchor"))
    pairs = words.join(i.select("item_id", "anchor"), "anchor").select("doc_id", "item_id").distinct()
    return pairs.join(d, "doc_id").join(i.select("item_id", "i"), "item_id").where(F.contains("d", F.col("i"))).select("doc_id", "item_id")


def containment_loop(docs: DataFrame, items: DataFrame, least: int = 20) -> DataFrame:
    """The same by a nested loop over a small item table: the form to hold the anchors against."""
    d = docs.select("doc_id", normalised(F.col("text")).alias("d"))
    i = items.select("item_id", normalised(F.col("text")).alias("i")).where(F.length(F.trim("i")) >= least)
    return d.join(F.broadcast(i), F.contains("d", F.col("i"))).select("doc_id", "item_id")


def first_hits(pairs: DataFrame, n: int = 3) -> DataFrame:
    """At most n documents of an item."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def leaks(docs: DataFrame, items: DataFrame, key) -> DataFrame:
    """Pairs whose normalised texts are equal, by hash."""
    d = docs.select("doc_id", key(F.col("text")).alias("k"))
    return d.join(items.select("item_id", key(F.col("text")).alias("k")), "k").select("doc_id", "item_id")


def without(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(held.select(*keys).distinct(), keys, "left_anti")


def band(df: DataFrame, scores: DataFrame, key: str, score: str, low: float, high: float) -> DataFrame:
    return df.join(scores.where(F.col(score).between(low, high)).select(key, score), key)


def replies(turns: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, answer: an assistant turn with the user turn it follows; empty turns don't count.

    A prompt that is followed by another prompt is overwritten, one that was answered isn't answered again.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = turns.where(F.col("role").isin("user", "assistant") & (F.trim(X.text_or_empty(F.col("text"))) != ""))
    said = said.select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("before"), F.lag("text").over(w).alias("prompt"))
    return said.where((F.col("role") == "assistant") & (F.col("before") == "user")).select("conv_id", "turn", "prompt", F.col("text").alias("answer"))


def parents(turns: DataFrame) -> DataFrame:
    """Each turn with the one before it, by an equi-join on (conversation, turn)."""
    child, parent = turns.alias("c"), turns.alias("p")
    on = (F.col("c.conv_id") == F.col("p.conv_id")) & (F.col("c.turn") == F.col("p.turn") + 1)
    both = child.join(parent, on)
    return both.select(F.col("c.conv_id").alias("conv_id"), F.col("c.turn").alias("turn"), F.col("p.role").alias("parent_role"), F.col("c.role").alias("role"))
