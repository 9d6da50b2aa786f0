"""Folders of any number of files, listed and read by tasks: neither names nor contents pass through the driver.

Spark's file sources list a folder in the driver and plan a few small files per task, so that their memory and time follow the number of files.
Here a folder is a row, and so is a file; tasks hold what they read in batches.
"""

import io
import os
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions.session import table_of

#: Files and bytes that a task reads; larger files are better read in splits.
TASK_FILES, TASK_BYTES = 4000, 32 << 20
#: Rows and bytes of a batch.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
#: Endings of compressed files that tasks read, and of those that are left to Spark's reader.
CODECS = {".gz": "gzip", ".bz2": "bz2"}
OTHER_CODECS = (".deflate", ".lz4", ".snappy", ".zst", ".zstd")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a local path; also of the ``file:/…`` form that Spark gives."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), os.path.normpath(uri)) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def read_by_tasks(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` is a folder that tasks can list: on a file system that Arrow knows, by a name that is no pattern."""
    if re.search(r"[*?\[\]{}\\]", root):
        return False
    if root.startswith("/") and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").startswith("file:"):
        return False
    try:
        system, base = file_system(root)
        return system.get_file_info(base).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def shown(root: str) -> str:
    """A folder as paths of Spark's binary reader have it, with the last slash."""
    if root.startswith(("/", "file:")):
        root = "file:" + file_system(root)[1]
    return root.rstrip("/") + "/"


def _metadata_path(path: str) -> str:
    """A path as ``_metadata.file_path`` has it."""
    return re.sub(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]', lambda m: f"%{ord(m[0]):02X}", path)


def _visible(name: str) -> bool:
    """Names that Spark's readers see."""
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_metadata", "_common_metadata"))


def _children(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder with the lengths of files, None for folders; names of a local folder are not held."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, None if info.type == fs.FileType.Directory else info.size
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                yield entry.name, None if entry.is_dir() else entry.stat().st_size
            except FileNotFoundError:  # a link to nothing
                continue


def _listing(root: str, folder_too: Callable[[str], bool], file_too: Callable[[str], bool]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        found: list[tuple[str, int | None]] = []

        def batch() -> pa.RecordBatch:
            names, lengths = [n for n, _ in found], [n for _, n in found]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.int64())], names=["rel", "length"])

        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            for name, length in _children(system, f"{base}/{folder}" if folder else base):
                if (folder_too if length is None else file_too)(name):
                    found.append((f"{folder}/{name}" if folder else name, length))
                    if len(found) >= BATCH_ROWS:
                        yield batch()
        if found:
            yield batch()

    return run


def list_files(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), deep: bool = False) -> DataFrame:
    """``(rel, length)`` of the files in a folder that are not empty, by their paths below it; hidden ones, as Spark has them, are left out.

    ``patterns`` choose, one after the other, the folders to go down from ``root`` and at last files or folders, by ``*`` and ``?``. In a chosen folder
    only its files and folders ``key=value`` count, with ``deep`` all folders. A folder is listed by one task; a job per level of folders.
    """
    parts, level, depth = [], spark.createDataFrame([("",)], "rel string"), 0
    while True:
        if depth < len(patterns):
            fits = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in patterns[depth]), re.S).fullmatch
            last = depth == len(patterns) - 1
            run = _listing(root, lambda n, fits=fits: bool(fits(n)), lambda n, fits=fits, last=last: last and bool(fits(n)) and _visible(n))
        else:
            run = _listing(root, lambda n: _visible(n) and (deep or "=" in n[1:-1]), _visible)
        found = table_of(level.mapInArrow(run, "rel string, length bigint"), "listing")
        parts.append(found.filter("length > 0"))
        folders = found.filter("length IS NULL").select("rel")
        if not (n := folders.count()):
            return reduce(DataFrame.unionAll, parts)
        level, depth = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "rel"), depth + 1


def _dealt(files: DataFrame) -> DataFrame:
    """Files dealt evenly to as many tasks as their number and length ask for."""
    told = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
    return files.select("rel", "length").repartition(1 + told["n"] // TASK_FILES + told["size"] // TASK_BYTES, "rel")


def contents(files: DataFrame, root: str) -> DataFrame:
    """``(rel, length, content)`` of listed files, each read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        names, data, held = [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(names, pa.string()), pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["rel", "length", "content"])

        for rel in (r for b in batches for r in b.column(0).to_pylist()):
            with system.open_input_stream(f"{base}/{rel}", compression=None) as file:
                raw = file.read()
            if data and held + len(raw) > BATCH_BYTES:
                yield batch()
                names, data, held = [], [], 0
            names.append(rel)
            data.append(raw)
            held += len(raw)
        if data:
            yield batch()

    return _dealt(files).mapInArrow(run, "rel string, length bigint, content binary")


def _lines(system: fs.FileSystem, path: str) -> Iterator[bytes]:
    r"""Lines as Spark's text reader has them: ended by ``\n``, ``\r`` or both, without a byte order mark in front."""
    with system.open_input_stream(path, compression=CODECS.get(os.path.splitext(path)[1])) as file:
        # one character per byte, so that bytes of any encoding pass through
        for k, line in enumerate(io.TextIOWrapper(file, "latin-1", newline=None)):
            if k == 0 and not (line := line.removeprefix("\xef\xbb\xbf")):
                return
            yield line.removesuffix("\n").encode("latin-1")


def lines(files: DataFrame, root: str) -> DataFrame:
    """``(file, line_no, value)``: the numbered lines of listed files."""
    prefix = shown(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        names, numbers, values, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(values, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "line_no", "value"])

        for rel in (r for b in batches for r in b.column(0).to_pylist()):
            file = _metadata_path(prefix + rel)
            for number, value in enumerate(_lines(system, f"{base}/{rel}"), 1):
                if len(values) >= BATCH_ROWS or (values and held + len(value) > BATCH_BYTES):
                    yield batch()
                    names, numbers, values, held = [], [], [], 0
                names.append(file)
                numbers.append(number)
                values.append(value)
                held += len(value)
        if values:
            yield batch()

    return _dealt(files).mapInArrow(run, "file string, line_no bigint, value binary").select("file", "line_no", F.col("value").cast("string").alias("value"))
