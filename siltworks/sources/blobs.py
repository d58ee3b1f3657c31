"""The carrier of all byte operators: ``blobs(stream_id, raw BINARY)``, from a table's text, from files or from gzip files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.labels import format_by_extension, sniff


def from_text(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Blobs of a text column's UTF-8 bytes. A null text is an empty blob."""
    return rows.select(F.col(id_column).alias("stream_id"), F.coalesce(F.encode(text_column, "UTF-8"), F.lit(b"")).alias("raw"))


def from_files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(stream_id, raw, length, modified): one blob a file. A filter on length or modified is pushed to the listing; contents are read last."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    files = reader.load(path)
    return files.select(F.col("path").alias("stream_id"), F.col("content").alias("raw"), "length", F.col("modificationTime").alias("modified"))


def table_blobs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Blobs of one of the driver's tables, spread over the session's partitions where the file is one."""
    columns = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "benchmark": ("item_id", "text")}
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns[name])
    return spread(from_text(rows, *columns[name]))


def spread(blobs: DataFrame) -> DataFrame:
    """A blob can't be split: with fewer input splits than tasks, they are dealt out again by id."""
    tasks = blobs.sparkSession.sparkContext.defaultParallelism
    return blobs.repartition(tasks, "stream_id") if len(blobs.inputFiles()) < tasks else blobs


def routed(files: DataFrame) -> DataFrame:
    """``files`` with what a command line decides before decoding: the format by name, the kind by its first bytes, and whether it is refused."""
    name = F.element_at(F.split("stream_id", "/"), -1)
    return files.withColumns({"format": format_by_extension(name), "sniffed": sniff(F.col("raw"))}).withColumn("refused", F.col("sniffed") == "raw")


def read_json_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Benchmark result documents below a folder; a file that doesn't parse is a row with ``_corrupt_record``."""
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE")
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace events from JSON lines or a lenient Chrome array: brackets and commas around a line don't matter; bad lines have ``bad``."""
    schema = "name string, ph string, pid long, tid long, ts double, args map<string,string>"
    line = F.regexp_replace("value", r"^[\s\[,]+|[\s\],]+$", "")
    lines = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    got = lines.select("line", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("e"))
    return got.select("e.*", (F.col("e").isNull() | F.col("e.ph").isNull()).alias("bad"))


def read_pins(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A pinned table: tab-separated with a header and ``#`` comments, of a fixed schema."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("header", "true").option("mode", "FAILFAST").csv(path)


def complete_set(declared: DataFrame, present: DataFrame, key: str | list[str]) -> DataFrame:
    """``declared`` if each of its members is ``present``; reading it fails and names one that isn't."""
    missing = declared.join(present, key, "left_anti").select(F.concat_ws(",", *([key] if isinstance(key, str) else key)).alias("m"))
    gone = missing.agg(F.min("m").alias("m"))
    check: Column = F.assert_true(F.col("m").isNull(), F.concat(F.lit("missing member: "), F.col("m")))
    return declared.join(F.broadcast(gone.select(check.alias("checked"))), F.lit(True)).where("checked is null").drop("checked")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines, one file a task; an existing folder is an error."""
    rows.write.mode("errorifexists").json(path)


def write_pins(rows: DataFrame, path: str) -> None:
    """Tab-separated files with a header each, as ``read_pins`` reads them; an existing folder is an error."""
    rows.write.mode("errorifexists").option("sep", "\t").option("header", "true").csv(path)
