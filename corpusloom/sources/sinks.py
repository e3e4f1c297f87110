"""Sinks: documents with their rejects and manifest, routed splits, and output that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import rules


def manifest(judged: DataFrame, text: str = "text", reason: str = "reason") -> DataFrame:
    """One row: documents in and written, bytes written, and a map of drop counts."""
    kept = F.col(reason).isNull()
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1
    by = judged.groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(kept, size).otherwise(F.lit(0))).alias("b"))
    drops = F.map_from_entries(F.array_sort(F.collect_list(F.when(~kept, F.struct(F.col(reason), F.col("n"))))))
    return by.agg(
        F.sum("n").alias("docs_in"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("docs_written"), F.sum("b").alias("bytes_written"), drops.alias("dropped")
    )


def write_gate(judged: DataFrame, path: str, samples: int = 5, reason: str = "reason") -> None:
    """Writes kept documents as JSON lines, the first rejects of each reason, and the manifest; Spark commits each whole."""
    judged.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").json(f"{path}/kept")
    rules.reject_samples(judged, samples, reason).write.mode("overwrite").json(f"{path}/rejects")
    manifest(judged, reason=reason).write.mode("overwrite").json(f"{path}/manifest")


def write_lines(docs: DataFrame, path: str, text: str = "text") -> None:
    """One document a line."""
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\s+", " "))
    docs.select(flat.alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def write_both(docs: DataFrame, path: str, text: str = "text") -> None:
    """The rows as JSON lines and their texts as lines; each is committed whole, so a failed run leaves neither half written."""
    docs.write.mode("overwrite").json(f"{path}/records")
    write_lines(docs, f"{path}/text", text)


def write_tokens(docs: DataFrame, path: str, encode, text: str = "text", key: str = "doc_id") -> bool:
    """Token ids of each text by key as Parquet (ids, start); skipped, and False, if the output is complete already.

    ``encode`` makes an array of ids from a text column.
    """
    from corpusloom.operators import ordering

    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return False
    rows = docs.select(key, encode(F.col(text)).alias("ids")).withColumn("n", F.size("ids").cast("long"))
    ordering.offsets(rows, key, "n", 1_000_000).write.mode("overwrite").parquet(path)
    return True


def append_reviews(batch: DataFrame, path: str) -> None:
    """Appends reviewed rows to the log that ``unreviewed`` reads; the sink of a stream's foreachBatch."""
    batch.write.mode("append").json(path)


def unreviewed(docs: DataFrame, path: str, schema: str, key: str = "doc_id") -> DataFrame:
    """What the log holds no review of."""
    return docs.join(docs.sparkSession.read.schema(schema).json(path).select(key).distinct(), key, "left_anti")


def write_routes(df: DataFrame, path: str, route: str) -> None:
    """All routes in one pass, a folder each."""
    df.write.mode("overwrite").partitionBy(route).parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't in the output yet, and says how many; safe to run again after a failure."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    new = df if done is None else df.join(done, key, "left_anti")
    before = 0 if done is None else done.count()
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before
