"""Readers that give documents (doc_id, source, text ...) from the text layouts of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAT = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def _name() -> Column:
    """The file's name without its suffix."""
    return F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.[A-Za-z0-9.]+)?$", 1)


def spread_out(df: DataFrame) -> DataFrame:
    """A scan of fewer tasks than there are cores, dealt to as many as there are: for work that costs far more than a shuffle.

    A corpus of many files or row groups has tasks enough and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if tasks < cores else df


def numbered(df: DataFrame) -> DataFrame:
    """Adds doc_id: a hash of source and text, so it is the same whatever way the files are split."""
    return df.select(F.xxhash64("source", "text").alias("doc_id"), "source", *[c for c in df.columns if c != "source"])


def line_docs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One document a line; bytes that aren't UTF-8 are replaced."""
    df = spark.read.text(path).select(_name().alias("source"), F.col("value").alias("text"))
    return numbered(df.where(F.trim("text") != ""))


def expanded(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files that paths and globs name, each glob's in order, each file once; a pattern without a file is an error."""
    out: dict[str, None] = {}
    for pattern in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        names = sorted(f.getPath().toString() for f in found or [])
        if not names:
            raise FileNotFoundError(pattern)
        out.update(dict.fromkeys(names))
    return list(out)


def code_lines(spark: SparkSession, path: str, separator: str = "<file_sep>") -> DataFrame:
    """source, at, line: code parted by blank lines with its lines kept, and a separator line before each document.

    ``at`` orders the lines of a file: the document's id, then the line's place in it.
    """
    df = blank_separated(spark, path, keep_lines=True)
    rows = df.select("source", "doc_id", F.posexplode(F.concat(F.array(F.lit(separator)), F.split("text", "\n"))).alias("i", "line"))
    return rows.select("source", F.struct("doc_id", "i").alias("at"), "line")


def blank_separated(spark: SparkSession, path: str, keep_lines: bool = False) -> DataFrame:
    """Documents parted by blank lines; their lines joined by a space, or kept."""
    df = spark.read.text(path, lineSep="\n\n").select(_name().alias("source"), F.col("value").alias("v"))
    rows = F.filter(F.transform(F.split("v", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.trim(F.col("v"), F.lit("\n")) if keep_lines else F.array_join(rows, " ")
    return numbered(df.select("source", text.alias("text")).where(F.trim("text") != ""))


def wrapped(spark: SparkSession, path: str, opening: str = "<|code|>", closing: str = "<|endcode|>") -> DataFrame:
    """Documents between markers, with a language after the opening one; the last may lack its closing marker.

    The reader parts the files at the opening marker, so files stay splittable.
    """
    df = spark.read.text(path, lineSep=opening).select(_name().alias("source"), F.col("value").alias("v"))
    body = F.substring_index("v", closing, 1)
    lang = F.regexp_extract(body, "^[ ]*\\[?([A-Za-z0-9+#]*)\\]?[ ]*\\n", 1)
    text = F.regexp_replace(body, "^[ ]*\\[?[A-Za-z0-9+#]*\\]?[ ]*\\n|\\n+$", "")
    return numbered(df.select("source", lang.alias("lang"), text.alias("text")).where(F.trim("text") != ""))


def repo_marked(spark: SparkSession, path: str, marker: str = "<reponame>") -> DataFrame:
    df = spark.read.text(path, lineSep=marker).select(_name().alias("source"), F.col("value").alias("v"))
    repo, text = F.trim(F.substring_index("v", "\n", 1)), F.trim(F.substr("v", F.instr("v", "\n") + F.lit(1)), F.lit("\n"))
    return numbered(df.select("source", repo.alias("repo"), text.alias("text")).where((F.instr("v", "\n") > 0) & (F.col("text") != "")))


def json_docs(spark: SparkSession, path: str, schema: str, corrupt: str = "bad_json") -> DataFrame:
    """JSON lines (gzip too) by a stated schema; a broken line is a row with its text in ``corrupt``."""
    whole = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(corrupt, T.StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)


def parquet_texts(spark: SparkSession, path: str, column: str = "text", most_bytes: int | None = None) -> DataFrame:
    """A Parquet corpus of which only the text column is read; with ``most_bytes``, rows by id until their bytes reach it."""
    docs = numbered(spark.read.parquet(path).select(_name().alias("source"), F.col(column).alias("text")).where(F.col(column).isNotNull()))
    if most_bytes is None:
        return docs
    from corpusloom.operators import ordering

    whole = ordering.row_bytes()
    # ids are hashes: equal parts of their range hold equal shares of the bytes, so sums by part find where to cut
    part = F.shiftright("doc_id", 48)
    sums = docs.groupBy(part.alias("__p")).agg(F.sum(whole).alias("b"))
    before = F.sum("b").over(Window.orderBy("__p")) - F.col("b")
    parts = sums.withColumn("before", before).where(F.col("before") < most_bytes).select("__p", "before")
    inside = docs.withColumn("__p", part).join(F.broadcast(parts), "__p")
    run = F.sum(whole).over(Window.partitionBy("__p").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    cut = inside.withColumn("__b", F.col("before") + F.coalesce(run, F.lit(0))).where(F.col("__b") < most_bytes)
    return cut.select(*docs.columns)


def category_docs(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("code",)) -> DataFrame:
    """Code records (JSON lines: text, lang, category) of the wanted categories; without a category a record stays."""
    df = json_docs(spark, path, "text string, lang string, category string").where("bad_json IS NULL AND text IS NOT NULL")
    return numbered(df.where(F.col("category").isNull() | F.lower("category").isin(*wanted)).select(_name().alias("source"), "lang", "category", "text"))


def archived_xml(spark: SparkSession, path: str, least: int = 200) -> DataFrame:
    """One document a member of zip and tar archives of XML: its text without tags; shorter ones are dropped.

    An archive is one row of a task, its members are read one after the other.
    """
    import io
    import re
    import tarfile
    import zipfile

    import pandas as pd

    def members(name: str, data: bytes):
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in sorted(z.namelist()):
                    if m.lower().endswith(".xml"):
                        yield m, z.read(m)
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile() and m.name.lower().endswith(".xml"):
                        yield m.name, t.extractfile(m).read()

    def texts(batches):
        for files in batches:
            for name, data in zip(files["path"], files["content"]):
                for member, xml in members(name, data):
                    text = " ".join(re.sub(r"<[^>]+>", " ", xml.decode("utf-8", "replace")).split())
                    if len(text) >= least:
                        yield pd.DataFrame({"source": [name.rsplit("/", 1)[-1]], "member": [member], "text": [text]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return numbered(files.mapInPandas(texts, "source string, member string, text string"))


def speeches(spark: SparkSession, path: str, row_tag: str = "rede", least: int = 50) -> DataFrame:
    """Speeches of parliamentary XML: speaker, group and the paragraphs joined; shorter ones are dropped."""
    kind = "_id string, redner struct<vorname: string, nachname: string, fraktion: string>, p array<string>"
    df = xml_rows(spark, path, row_tag, kind)
    text = F.array_join(F.filter(F.transform("p", lambda x: F.trim(x)), lambda x: x != ""), "\n")
    rows = df.select(F.col("_id").alias("source"), F.concat_ws(" ", "redner.vorname", "redner.nachname").alias("speaker"), F.coalesce("redner.fraktion", F.lit("")).alias("group"), text.alias("text"))
    return numbered(rows.where(F.length("text") >= least))


def rendered(records: DataFrame, fields: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Adds the text of a record: a line ``name: value`` for each field that has one."""
    lines = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{name}: "), F.trim(F.col(c).cast("string")))) for c, name in fields]
    return records.withColumn(text, F.concat_ws("\n", *lines))


#: Prompt rows by schema: (column, longest text); the last is the id.
PROMPT_FIELDS = {
    "plenary": (("wp", None), ("sitzung", None), ("redner", None), ("fraktion", None), ("text", 6000), ("source_url", None)),
    "caselaw": (("courtType", None), ("documentType", None), ("decisionDate", None), ("ecli", None), ("body", 8000), ("documentNumber", None)),
    "politician": (("nachname", None), ("vorname", None), ("partei_kurz", None), ("geburtsdatum", None), ("geburtsort", None), ("beruf", None), ("vita_kurz", None), ("id", None)),
}


def prompt_rows(records: DataFrame, schema: str) -> DataFrame:
    """A record's fields for a prompt by its schema, "?" for those that are missing, long texts cut; politicians as one JSON text."""
    if schema not in PROMPT_FIELDS:
        raise ValueError(f"unknown schema: {schema}")
    *fields, (key, _) = PROMPT_FIELDS[schema]
    have = set(records.columns)
    value = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    raw = value(key).alias("raw_id")
    if schema == "politician":
        return records.select(raw, F.to_json(F.struct(*[value(c).alias(c) for c, _ in fields])).alias("record"))
    return records.select(raw, *[(F.substring(F.coalesce(value(c), F.lit("")), 1, n) if n else F.coalesce(value(c), F.lit("?"))).alias(c) for c, n in fields])


def preference_rows(records: DataFrame, kind: str) -> DataFrame:
    """source, kind, user, preferred, rejected, category of preference and chat records (dialogues, trees, flagged turns)."""
    from corpusloom.functions import structure

    none = F.lit("")
    if kind == "dialogue":
        df = records.withColumn("__p", structure.preference(F.coalesce("chosen", none), F.coalesce("rejected", none)))
        user, preferred, rejected, category = F.col("__p.prompt"), F.col("__p.preferred"), F.col("__p.rejected"), F.lit("helpful_or_harmless")
    elif kind == "tree":
        df, said = records, F.coalesce("text", none)
        user, preferred = F.when(F.col("role") == "prompter", said).otherwise(none), F.when(F.col("role") == "assistant", said).otherwise(none)
        rejected, category = none, F.coalesce("role", F.lit("unknown"))
    elif kind == "question":
        df = records
        user, preferred, rejected, category = F.coalesce("question", none), F.coalesce("answer", none), none, F.lit("qa")
    else:
        raise ValueError(f"unknown kind: {kind}")
    return df.select(F.lit(kind).alias("source"), user.alias("user"), preferred.alias("preferred"), rejected.alias("rejected"), category.alias("category"))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("rowTag", row_tag).xml(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The reader that the path's suffix asks for; text files are told apart by their first two thousand characters."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        return parquet_texts(spark, path)
    if low.endswith((".jsonl", ".json", ".jsonl.gz")):
        return numbered(json_docs(spark, path, "text string").select(_name().alias("source"), F.coalesce("text", "bad_json").alias("text")))
    head = spark.read.text(path, wholetext=False).limit(20).agg(F.array_join(F.collect_list("value"), "\n")).first()[0] or ""
    if "<|code|>" in head[:2000]:
        return wrapped(spark, path)
    if "<reponame>" in head[:2000]:
        return repo_marked(spark, path)
    return line_docs(spark, path)


def messages(record: DataFrame) -> DataFrame:
    """Adds messages from whichever of three layouts a record has: messages, prompt and response, instruction and output."""
    have = set(record.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    pair = lambda a, b: F.when(
        a.isNotNull() & b.isNotNull(),
        F.array(F.struct(F.lit("user").alias("role"), a.alias("content")), F.struct(F.lit("assistant").alias("role"), b.alias("content"))),
    )
    asked = F.concat_ws("\n\n", text("instruction"), F.nullif(text("input"), F.lit("")))
    layouts = [pair(text("prompt"), text("response")), pair(F.when(text("instruction").isNotNull(), asked), text("output"))]
    given = F.col("messages").cast(CHAT) if "messages" in have else F.lit(None).cast(CHAT)
    return record.withColumn("messages", F.coalesce(F.when(F.size(given) > 0, given), *layouts))


def inventory(spark: SparkSession, path: str, samples: int = 2) -> DataFrame:
    """path, bytes, lines, first keys (of JSON lines) and sample lines of the files below a path; contents are read once, as lines."""
    at = F.col("_metadata.file_path").alias("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(at, F.col("length").alias("bytes"))
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(at, "value", F.col("_metadata.file_block_start").alias("block"))
    # samples are the least by place and text: kept bounded in every partial aggregate
    few = F.slice(F.array_sort(F.collect_list(F.struct("block", F.substring("value", 1, 200).alias("line")))), 1, samples)
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("block", "value"))).where(F.col("r") <= samples)
    heads = ranked.groupBy("path").agg(few.alias("s"))
    keys = F.json_object_keys(F.try_element_at("s", F.lit(1))["line"])
    found = files.join(counts, "path", "left").join(heads, "path", "left")
    return found.select("path", "bytes", F.coalesce("lines", F.lit(0)).alias("lines"), keys.alias("keys"), F.transform("s", lambda x: x["line"]).alias("samples"))
