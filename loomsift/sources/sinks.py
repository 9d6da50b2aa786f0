"""Writers of training rows and readable dumps."""

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_training(df: DataFrame, path: str, text: str = "chat") -> None:
    """Append ``{"text": …}`` lines; non-ASCII characters are kept."""
    df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).write.mode("append").json(path)


def filtered_path(path: str) -> str:
    stem = path.rstrip("/")
    return stem.removesuffix(".jsonl") + "_filtered" + (".jsonl" if stem.endswith(".jsonl") else "")


def write_filtered(kept: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write the kept entries (``entry``, a whole line each) next to the dataset; the dataset itself is not touched."""
    target = filtered_path(path)
    kept.select("entry").write.mode(mode).text(target)
    return target


def write_files(files: DataFrame, root: str) -> None:
    """Write each row ``(rel_path, content)`` as a file of its own below ``root``; a path that is there twice keeps either content."""

    def write(rows) -> None:
        system, base = (fs.LocalFileSystem(), root.removeprefix("file://").removeprefix("file:")) if root.startswith(("/", "file:")) else fs.FileSystem.from_uri(root)
        for row in rows:
            path = f"{base.rstrip('/')}/{row['rel_path']}"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path, compression=None) as out:
                out.write(bytes(row["content"]))

    files.select("rel_path", F.col("content").cast("binary").alias("content")).foreachPartition(write)


def readable_entry(number: Column, text: Column) -> Column:
    """One entry of the readable dump, with its trailing blank line."""
    rule = "=" * 80
    head = F.concat(F.lit(f"{rule}\nEntry "), number.cast("string"), F.lit(f"\n{rule}\n"))
    return F.concat(head, F.coalesce(text, F.lit("")), F.lit("\n\n"))


def to_readable(rows: DataFrame, number: str = "line_no", text: str = "text") -> DataFrame:
    """``(number, value)``: readable form of numbered dataset rows."""
    return rows.select(number, readable_entry(F.col(number), F.col(text)).alias("value"))


def write_readable(rows: DataFrame, path: str, number: str = "line_no", text: str = "text") -> None:
    """Write the readable form in the order of the numbers: the part files one after the other are the dump."""
    ordered = rows.select(number, text).repartitionByRange(number).sortWithinPartitions(number)
    to_readable(ordered, number, text).select("value").write.mode("errorifexists").text(path)


def preview(rows: DataFrame, order: str = "line_no", text: str = "text", chars: int = 2000, lines: int = 40) -> DataFrame:
    """One row: the first lines of the first entry and the number of characters left out."""
    first = rows.orderBy(order).limit(1)
    shown = F.slice(F.split(F.substring(text, 1, chars), "\n"), 1, lines)
    return first.select(
        order,
        F.array_join(shown, "\n").alias("preview"),
        F.greatest(F.lit(0), F.length(text) - chars).alias("more_chars"),
    )
