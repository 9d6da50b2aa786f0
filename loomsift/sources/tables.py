"""Readers of seeds, pages, source folders and JSON-lines datasets."""

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomsift.functions import urls
from loomsift.functions.dialect import strip, without_broken_bytes
from loomsift.functions.session import table_of
from loomsift.operators.code import select_code
from loomsift.sources import files as folders

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"
ROW_SCHEMA = "text STRING, url STRING"


def seeds_from_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Canonical URLs of the lines that start with ``http``."""
    line = strip(F.col(value))
    return lines.select(line.alias("url")).filter(F.col("url").startswith("http")).select(urls.canonical(F.col("url")).alias("url"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return seeds_from_lines(spark.read.text(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table ``(page_id, url, html)``; binary html is decoded, invalid bytes dropped."""
    pages = spark.read.parquet(path)
    if dict(pages.dtypes)["html"] == "binary":
        pages = pages.withColumn("html", without_broken_bytes(F.col("html").cast("string")))
    return pages.select("page_id", "url", "html")


def scan_code(spark: SparkSession, root: str, max_size: int | None = None) -> DataFrame:
    """``(path, rel_path, length, content)`` of the source files below ``root``.

    Files above ``max_size``, or above what Spark's binary reader takes, are listed without content and never opened. Tasks list the
    folders and read the files, however many there are; only what Arrow cannot list is left to Spark's reader, which lists it in the driver.
    """
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    most = most if max_size is None else min(most, max_size)
    if folders.read_by_tasks(spark, root):
        chosen = select_code(folders.list_files(spark, root, deep=True).withColumn("rel_path", F.col("rel")), "rel_path").select("rel", "length")
        read = folders.contents(chosen.filter(F.col("length") <= most), root)
        listed = read.unionAll(chosen.filter(F.col("length") > most).withColumn("content", F.lit(None).cast("binary")))
        return listed.select(F.concat(F.lit(folders.shown(root)), "rel").alias("path"), F.col("rel").alias("rel_path"), "length", "content")
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.substr("path", F.instr("path", base) + len(base))

    def listed(files: DataFrame, content: Column) -> DataFrame:
        return select_code(files.select("path", inside.alias("rel_path"), "length", content.alias("content")), "rel_path")

    read = listed(files.filter(F.col("length") <= most), F.col("content"))
    return read.unionAll(listed(files.filter(F.col("length") > most), F.lit(None).cast("binary")))


def parse_jsonl(lines: DataFrame, value: str = "value") -> DataFrame:
    """``text`` and ``url`` of JSON lines, and the whole line as ``entry``; lines that are no JSON object are dropped."""
    parsed = lines.withColumn(
        "_row", F.from_json(value, "text STRING, url STRING, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    )
    good = F.col("_row").isNotNull() & F.col("_row._bad").isNull()
    return parsed.filter(good & (strip(F.col(value)) != "")).select(
        *[c for c in lines.columns if c != value], "_row.text", "_row.url", F.col(value).alias("entry")
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)``: lines with their 1-based number in the file.

    The files of a folder, or of those that the last names of a path with ``*`` or ``?`` choose, are listed and read by tasks, however many
    there are, and their lines are stored once. Files that are larger than a task should read, and paths that Arrow cannot list, are read in splits.
    """
    root, chosen = path, []
    while re.search(r"[*?]", root):
        root, _, name = root.rstrip("/").rpartition("/")
        chosen.insert(0, name)
    if not root or re.search(r"[\[\]{}\\]", path) or not folders.read_by_tasks(spark, root):
        return _lines_of_splits(spark, path)
    found = folders.list_files(spark, root, tuple(chosen))
    whole = (F.col("length") <= folders.TASK_BYTES) & ~reduce(Column.__or__, [F.endswith("rel", F.lit(c)) for c in folders.OTHER_CODECS])
    lines = table_of(folders.lines(found.filter(whole), root), "lines")
    rest = [re.sub(r"([*?\[\]{}\\])", r"\\\1", folders.shown(root) + r["rel"]) for r in found.filter(~whole).collect()]  # no more rows than splits, beside odd codecs
    return lines.unionAll(_lines_of_splits(spark, rest)) if rest else lines


def _lines_of_splits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Numbered lines of what Spark's reader takes.

    The lines are read and stored once, with their place in the split they came from. How far the place is from the line number is one
    value per split, which comes back as a constant and is looked up by the split; no line is moved for it.
    """
    read = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    lines = table_of(read, "lines")
    task = F.shiftright("_at", 33)
    splits = lines.groupBy(task.alias("task"), "file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    told = splits.select("task", "first", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")).collect()  # a row per split
    by_task: list[list[dict]] = [[] for _ in range(max([r["task"] for r in told], default=-1) + 1)]
    for row in sorted(told, key=lambda r: r["first"]):
        by_task[row["task"]].append({"first": row["first"], "shift": row["shift"]})
    known = F.from_json(F.lit(json.dumps(by_task)), "array<array<struct<first:bigint,shift:bigint>>>")
    own = F.filter(F.get(known, task.cast("int")), lambda s: s["first"] <= F.col("_at"))
    return lines.select("file", (F.col("_at") + F.try_element_at(own, F.lit(-1))["shift"]).alias("line_no"), "value")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
