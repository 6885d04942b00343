"""Sources and sinks: JSON and JSON-lines scans, optional editions, first-seen globs, partitioned, upserting and split sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.tables import first_seen, upsert

RECORD = (
    "id string, kind string, collection string, collection_key string, surah int, surah_name string, ayah int, number string, "
    "arabic_number string, book int, section string, ref string, text string, sanad string, matn string, match_text string, "
    "match_source string, surfaces map<string,string>, translations map<string,string>, grade string, grade_raw string, "
    "grade_basis string, grade_note string, severity string, severity_ar string, action string, scope string, "
    "graders array<struct<grader:string,grade:string,grade_ar:string,grader_ar:string>>, edition string, split_rule string"
)
EDITION = "metadata struct<sections:map<string,string>>, hadiths array<struct<hadithnumber:string,arabicnumber:string,text:string,reference:struct<book:int>,grades:array<struct<name:string,grade:string>>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def json_lines(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path)


def edition(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a whole-file JSON edition, with the section name looked up; empty if the file is absent or unreadable."""
    if not exists(spark, path):
        return spark.createDataFrame([], "hadithnumber string, arabicnumber string, text string, book int, section string, grades array<struct<name:string,grade:string>>")
    whole = spark.read.schema(EDITION).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    rows = whole.select("metadata", F.explode("hadiths").alias("h"))
    return rows.select("h.hadithnumber", "h.arabicnumber", "h.text", F.col("h.reference.book").alias("book"), F.try_element_at("metadata.sections", F.col("h.reference.book").cast("string")).alias("section"), "h.grades")


def first_seen_files(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """Rows of several files, one for each key: of the first path, then file, that has it."""
    parts = [spark.read.schema(schema).json(p).withColumns({"_turn": F.lit(i), "_file": F.input_file_name(), "_at": F.monotonically_increasing_id()}) for i, p in enumerate(paths)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return first_seen(every, key, [F.col("_turn"), F.col("_file"), F.col("_at")]).drop("_turn", "_file", "_at")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_surfaces(records: DataFrame, path: str) -> None:
    """(id, surfaces map) as one long table, a folder for each language; only the languages at hand are replaced."""
    rows = records.select("id", F.explode("surfaces").alias("lang", "text")).where(F.trim("text") != "")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(path)


def missing_partitions(wanted: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows of `wanted` (lang, ...) whose language has no folder under `path` yet: what a resumed build still has to do."""
    if not exists(spark, path):
        return wanted
    return wanted.join(spark.read.parquet(path).select("lang").distinct(), "lang", "left_anti")


def upsert_into(changes: DataFrame, old: str, new: str, keys: list[str]) -> DataFrame:
    """A new version of the table at `old`, written to `new`; the old one stays as it is until readers have moved."""
    upsert(changes.sparkSession.read.parquet(old), changes, keys).write.mode("overwrite").parquet(new)
    return changes.sparkSession.read.parquet(new)


def split_with_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of each part file under `path`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_in_parts(df: DataFrame, path: str, rows: int) -> DataFrame:
    """JSON lines in files of at most `rows` rows; their manifest (file, bytes, sha256)."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)
    return split_with_manifest(df.sparkSession, path).where(F.col("file").startswith("part-"))


def changed_parts(manifest: DataFrame, path: str) -> DataFrame:
    """Files of the manifest that are gone or different under `path`; empty if all is as it was."""
    now = split_with_manifest(manifest.sparkSession, path).select("file", F.col("sha256").alias("_now"))
    return manifest.join(now, "file", "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).select("file")


def cached_answers(spark: SparkSession, path: str, version: str) -> DataFrame:
    """query, answer of the cache's rows of this version; of several, the last written. Other versions are as good as gone."""
    if not exists(spark, path):
        return spark.createDataFrame([], "query string, answer string")
    rows = spark.read.schema("version string, query string, answer string, at double").parquet(path).where(F.col("version") == version)
    return first_seen(rows, "query", [F.col("at").desc()]).select("query", "answer")


def keep_answers(answers: DataFrame, path: str, version: str) -> None:
    """Appends (query, answer) to the cache."""
    answers.select(F.lit(version).alias("version"), "query", "answer", F.unix_micros(F.current_timestamp()).cast("double").alias("at")).write.mode("append").parquet(path)


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A report table as Markdown. Reports are aggregates of a few rows; one of more than `rows` rows says how many it leaves out."""
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    shown = df.take(rows + 1)
    more = [] if len(shown) <= rows else ["", f"{df.count() - rows} more rows are not shown."]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in shown[:rows]] + more) + "\n"


def split_bytes(spark: SparkSession, path: str, to: str, most: int = 90_000_000) -> DataFrame:
    """A file cut into parts of at most `most` bytes under `to`; their manifest (file, bytes, sha256). The parts' names sort in order.

    The file is streamed through the driver once, as it is one file on one disk: a step of shipping, not of the engine.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = source.getFileSystem(conf)
    size = fs.getFileStatus(source).getLen()
    for number, start in enumerate(range(0, max(size, 1), most)):
        read, write = fs.open(source), fs.create(jvm.org.apache.hadoop.fs.Path(folder, f"part-{number:05d}"))
        jvm.org.apache.commons.io.IOUtils.copyLarge(read, write, start, min(most, size - start))
        read.close()
        write.close()
    return split_with_manifest(spark, to).where(F.col("file").startswith("part-"))


def rejoined(spark: SparkSession, manifest: DataFrame, folder: str, to: str) -> str:
    """The parts of a manifest put together again, after a check of their digests; raises if one is gone or different."""
    bad = changed_parts(manifest, folder).take(5)
    if bad:
        raise ValueError(f"parts that are not as they were: {[r[0] for r in bad]}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(to)
    fs = place.getFileSystem(conf)
    write = fs.create(place)
    for r in manifest.select("file", "bytes").orderBy("file").collect():  # one row a part
        read = fs.open(jvm.org.apache.hadoop.fs.Path(folder, r["file"]))
        jvm.org.apache.commons.io.IOUtils.copyLarge(read, write, 0, r["bytes"])
        read.close()
    write.close()
    return to
