"""Budgets, quotas, interleaving, sampling and shuffles over a stated total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import textfn as X


def row_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a row as a line."""
    return (F.octet_length(X.text_or_empty(F.col(text))) + 1).cast("long")


#: Ids that one task of a running sum goes through.
WIDTH = 1_000_000


def running(df: DataFrame, group: list[str], order: list[str], size: Column, width: int = WIDTH) -> DataFrame:
    """Adds size, rn and cum: the place and the running size within a group.

    By a single whole-number column the sums run in two levels, over ranges of ``width`` of it and within a range, so a
    large group is many tasks' work and only a row a range meets in one.
    """
    df = df.withColumn("size", size)
    if len(order) > 1 or dict(df.dtypes)[order[0]] not in ("int", "bigint"):
        w = Window.partitionBy(*group).orderBy(*order)
        rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("rn", F.row_number().over(w)).withColumn("cum", F.sum("size").over(rows))
    df = df.withColumn("__range", F.floor(F.col(order[0]) / width))
    sums = df.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__s"))
    before = Window.partitionBy(*group).orderBy(F.col("__range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    so_far = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("__n", "__s")]
    keys = [*group, "__range"]
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *so_far)
    same = None
    for i, k in enumerate(keys):
        one = df[k].eqNullSafe(F.col(f"__k{i}"))
        same = one if same is None else same & one
    w = Window.partitionBy(*keys).orderBy(F.col(order[0]))
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.join(sums, same).drop(*[f"__k{i}" for i in range(len(keys))])
    df = df.withColumn("rn", (F.col("__n_before") + F.row_number().over(w)).cast("int")).withColumn("cum", F.col("__s_before") + F.sum("size").over(rows))
    return df.drop("__range", "__n_before", "__s_before")


def budget_prefix(df: DataFrame, group: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Whole rows while they fit; a group's first row is always kept."""
    return running(df, group, order, size).where((F.col("cum") <= budget) | (F.col("rn") == 1))


def target_stop(df: DataFrame, group: list[str], order: list[str], size: Column, target: int) -> DataFrame:
    """Rows until the target is met, with the row that crosses it."""
    return running(df, group, order, size).where(F.col("cum") - F.col("size") < target)


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)


def hash_sample(df: DataFrame, group: list[str], n: int, seed: str, key: Column) -> DataFrame:
    """n rows of each group by hash order: a reservoir's law, without its state, the same on each run."""
    return first_n(df, group, [X.shuffle_key(seed, key), key], n)


def bernoulli(df: DataFrame, rate_permille: int, seed: str, key: Column) -> DataFrame:
    return df.where(X.bucket(F.concat_ws("|", F.lit(seed), key), 1000) < rate_permille)


def interleave(df: DataFrame, group: str, order: list[str], chunk: int) -> DataFrame:
    """Adds turn: rounds of ``chunk`` rows of each group; ordering by (turn, group, rn) gives the mix."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rn", rn).withColumn("turn", F.floor((F.col("rn") - 1) / chunk).cast("int"))


def skip_then_take(df: DataFrame, group: list[str], order: list[str], skip: int, size: Column, target: int) -> DataFrame:
    """A slice that shares no row with the first ``skip`` ones, until the target is met."""
    rest = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rn") > skip).drop("__rn")
    return target_stop(rest, group, order, size, target)


def tail_reserve(df: DataFrame, group: list[str], order: list[str], size: Column, share: float) -> DataFrame:
    """Adds split: a group's last rows, beyond (1 - share) of its bytes, are the holdout."""
    df = running(df, group, order, size)
    total = F.sum("size").over(Window.partitionBy(*group))
    return df.withColumn("split", F.when(F.col("cum") > total * (1 - share), "holdout").otherwise("train"))


def round_robin_budget(df: DataFrame, group: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """One row of each group in turn until the budget is full: places by group first, then one running sum.

    The sum runs in two levels, over turns and within a turn, so rows of all groups never meet in one task.
    """
    df = df.withColumn("size", size).withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    turns = df.groupBy("turn").agg(F.sum("size").alias("in_turn"))
    before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("turn", F.coalesce(F.sum("in_turn").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("turn").orderBy(group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.join(turns, "turn").withColumn("cum", F.col("before") + F.sum("size").over(within))
    return df.where(F.col("cum") <= budget).drop("before")


def offsets(df: DataFrame, order: str, size: str, width: int) -> DataFrame:
    """Adds start: the sum of ``size`` over all rows before, in two levels over ranges of ``width`` ids."""
    df = df.withColumn("__range", F.floor(F.col(order) / width))
    sums = df.groupBy("__range").agg(F.sum(size).alias("__in"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__range", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("__before") + F.coalesce(F.sum(size).over(within), F.lit(0))).cast("long")
    return df.join(sums, "__range").withColumn("start", start).drop("__range", "__before")
