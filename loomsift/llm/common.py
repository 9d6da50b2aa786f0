"""Helpers that the operators of this subpackage share."""

import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomsift.functions.session import fresh_folder

TOKENIZERS = "/opt/tokenizers"


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)`` alone, null texts empty: extra columns, whatever their names, stay outside."""
    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def pieces_of(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into parts of about ``size`` bytes of text, never less than a row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        widths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        first = held = 0
        for row, width in enumerate(widths):
            held += width
            if held >= size:
                yield batch.slice(first, row + 1 - first)
                first, held = row + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


@contextmanager
def without_cycle_search() -> Iterator[None]:
    """Python's search for unreachable cycles is off inside: it walks over all remembered values again and again and finds none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memo(dict):
    """Values by word, made for many words at once; those not used for long are forgotten.

    There are two generations of up to half of ``limit`` words. What is kept changes the speed only, never a value.
    """

    def __init__(self, make: Callable[[list[str]], list], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def learn(self, words: Iterable[str]) -> None:
        """Have a value ready for each of ``words``."""
        if len(self) > self.limit // 2:
            self.old = dict(self)
            self.clear()
        missing = set(words).difference(self)
        known = missing.intersection(self.old)
        self.update({w: self.old[w] for w in known})
        new = list(missing.difference(known))
        self.update(zip(new, self.make(new)))


#: Rows that go to Python at once. The default of 10,000 is meant for narrow rows; texts are not.
BATCH_ROWS = 1000


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``, with batches of at most ``BATCH_ROWS`` rows from now on in the session."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that it is computed once."""
    folder = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_files(spark: SparkSession, purpose: str) -> str:
    """URI of a new folder below the shared one for files in an own format."""
    folder = fresh_folder(spark, purpose)
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Also accepts the ``file:/…`` form that Spark gives."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Published:
    """A file that appears under its name only when it is complete; a repeated task replaces it by the same bytes."""

    def __init__(self, folder: str, name: str):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.part = f"{base}/{name}", f"{base}/_{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> int:
        """Returns where ``data`` begins."""
        at, self.size = self.size, self.size + len(data)
        self.out.write(data)
        return at

    def commit(self) -> str:
        self.out.close()
        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:  # from an earlier attempt; some stores don't replace on moving
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)
        return self.path


def with_rows(docs: DataFrame, carry: bool = False) -> tuple[DataFrame, bool]:
    """``(row, doc_id, text)``, with ``carry`` also the struct ``rest`` of all columns but the text, with a number of its own for every row, in ascending order of id; and whether it is new.

    Unique ids without nulls are the numbers themselves. Otherwise rows are numbered in the order of id, nulls last, and text,
    from a range sort that is written once, so that the numbers stay when a task is repeated.
    """
    plain, more = id_text(docs), []
    if carry:
        others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
        plain, more = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*others).alias("rest")), ["rest"]
    counts = plain.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if counts[0] == counts[1] == counts[2]:
        return plain.select(F.col("doc_id").alias("row"), "doc_id", "text", *more), False
    order = [F.col("doc_id").asc_nulls_last(), F.col("text"), F.col("_at")]
    dealt = plain.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.select("doc_id", "text", *more, F.monotonically_increasing_id().alias("at")), "rows")
    part = F.shiftright("at", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    sizes = sizes.select("part", before.alias("before"))
    numbered = placed.withColumn("part", part).join(F.broadcast(sizes), "part")
    row = F.col("at") - F.shiftleft(F.col("part"), 33) + F.col("before")
    return numbered.select(row.alias("row"), "doc_id", "text", *more), True


def kept_columns(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` from rows of ``with_rows(docs, carry=True)``, the text as it is there or another one."""
    text = F.col("text") if text is None else text
    return rows.select(*[text.alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])
