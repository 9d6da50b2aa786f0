"""Source files: selection, metadata, formatting and chunks."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.functions.dialect import rx, strip, without_broken_bytes


def extension(path: Column) -> Column:
    """Extension with its dot, case kept; empty for names without one or with leading dots only."""
    return F.regexp_extract(path, r"(?:^|/)(?:\.*[^./][^/]*)(\.[^./]*)$", 1)


def select_code(files: DataFrame, path: str = "path") -> DataFrame:
    """Keep files with a known extension outside pruned folders."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    pruned = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in vocab.PRUNED_FOLDERS]))
    return files.filter(F.lower(extension(F.col(path))).isin(vocab.CODE_EXTENSIONS) & ~pruned)


def decode_code(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """Binary ``content`` to text; NULL where a file counts as unreadable.

    Empty files, those above ``max_size`` bytes if it is given, files with NUL and files with under ten characters are unreadable.
    (Empty files are not even listed by Spark's binary reader.)
    Invalid UTF-8 is dropped and line ends become newlines.
    """
    sized = F.col("length") >= 1 if max_size is None else F.col("length").between(1, max_size)
    text = without_broken_bytes(F.col("content").cast("string"))
    df = files.withColumn("content", F.when(sized, F.regexp_replace(text, "\r\n?", "\n")))
    readable = ~F.col("content").contains("\0") & (F.length(strip(F.col("content"))) >= 10)
    return df.withColumn("content", F.when(readable, F.col("content")))


def metadata_columns(content: Column) -> dict[str, Column]:
    functions = F.concat(
        *[F.regexp_extract_all(content, F.lit(rx(p)), F.lit(1)) for p in vocab.FUNCTION_PATTERNS]
    )
    comments = reduce(
        lambda a, b: a + b, [F.regexp_count(content, F.lit(rx(p, "s"))) for p in vocab.COMMENT_PATTERNS]
    )
    return {
        "functions": functions,
        "classes": F.regexp_extract_all(content, F.lit(rx(vocab.CLASS_PATTERN)), F.lit(1)),
        "comments": comments,
        "lines": F.size(F.split(content, "\n")),
    }


def code_metadata(files: DataFrame, content: str = "content") -> DataFrame:
    """Add function and class names, comment count and line count."""
    return files.withColumns(metadata_columns(F.col(content)))


def format_code(
    with_metadata: DataFrame, rel_path: str = "rel_path", content: str = "content", out: str = "formatted", named: int = 10
) -> DataFrame:
    """Header lines, then the code. Lists name the first ``named`` entries; empty lists leave no line."""

    def listed(label: str, names: str) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(names, 1, named), ", ")))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), F.col(rel_path)),
        F.concat(F.lit("Language: "), F.substr(extension(F.col(rel_path)), F.lit(2))),
        F.concat(F.lit("Lines: "), F.col("lines").cast("string")),
        listed("Functions", "functions"),
        listed("Classes", "classes"),
        F.lit("\nCode:\n"),
        F.col(content),
    )
    return with_metadata.withColumn(out, F.when(F.col(content).isNotNull(), text))


def chunk_code(files: DataFrame, size: int = vocab.CHUNK_LINES, content: str = "content") -> DataFrame:
    """``(…, chunk, chunk_text)``: consecutive chunks of ``size`` lines (20 to 200).

    A last chunk of under 20 lines is joined to the one before. Chunks are cut inside the row, so
    no shuffle is needed.
    """
    size = max(vocab.CHUNK_MIN, min(vocab.CHUNK_MAX, size))
    df = files.withColumn("_lines", F.split(content, "\n")).withColumn("_n", F.size("_lines"))
    rest = F.col("_n") % size
    whole = (F.col("_n") - rest) / size
    chunks = F.when((rest == 0) | ((rest < vocab.CHUNK_MIN) & (whole > 0)), whole).otherwise(whole + 1).cast("int")
    df = df.withColumn("_chunks", chunks)

    def cut(i: Column) -> Column:
        length = F.when(i == F.col("_chunks") - 1, F.col("_n") - i * size).otherwise(size)
        return F.array_join(F.slice("_lines", i * size + 1, length), "\n")

    texts = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), cut)
    kept = [c for c in files.columns if c != content]
    # the outer form: Catalyst would otherwise add a size test below and cut the chunks twice
    return df.filter(F.col(content).isNotNull()).select(*kept, F.posexplode_outer(texts).alias("chunk", "chunk_text"))
