"""Jobs on source folders and on existing datasets."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.functions.session import fresh_folder
from loomsift.operators import code, gates, render
from loomsift.options import CodeOptions
from loomsift.sources.sinks import filtered_path, write_filtered, write_training
from loomsift.sources.tables import parse_jsonl, scan_code


def curate_code(files: DataFrame, options: CodeOptions = CodeOptions()) -> DataFrame:
    """Outcome and training text of decoded files ``(rel_path, content)``; a single narrow pass."""
    n = F.length("content")
    df = files.withColumn(
        "outcome", F.when(F.col("content").isNull(), "failed").when(n < options.min_chars, "skipped").otherwise("success")
    )
    df = df.withColumn("content", F.when(F.col("outcome") == "success", F.col("content")))
    df = df.withColumn("chars", F.coalesce(F.length("content"), F.lit(0)))
    df = code.format_code(code.code_metadata(df))
    df = render.render_chat(df, options.render, "formatted")
    return df.select("rel_path", "outcome", "chars", "chat")


def curate_code_folder(spark: SparkSession, root: str, target: str, options: CodeOptions = CodeOptions()) -> DataFrame:
    """Read a source folder, append its training rows to ``target`` and return the statistics."""
    folder = fresh_folder(spark, "code")
    files = code.decode_code(scan_code(spark, root, options.max_size), options.max_size)
    curate_code(files, options).write.parquet(folder)
    done = spark.read.parquet(folder)
    write_training(done.filter("outcome = 'success'"), target)
    return code_stats(done)


def code_stats(outcomes: DataFrame) -> DataFrame:
    """Files and characters per outcome."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("files"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


def flag_dataset(rows: DataFrame) -> DataFrame:
    """Junk reason of the assistant turn of every dataset row ``(text, url)``; NULL keeps the row."""
    df = render.unwrap_assistant(rows).withColumn("url", F.coalesce("url", F.lit("")))
    return gates.junk_gate(df, "content", "url", out="reason")


REPORT = "reason string, rows bigint"


def report_path(path: str) -> str:
    return filtered_path(path) + ".report"


def refilter_report(spark: SparkSession, path: str) -> DataFrame | None:
    """``(reason, rows)`` of a finished re-filtering of a dataset, NULL for kept entries; None if there is none."""
    try:
        return spark.read.schema(REPORT).json(report_path(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def refilter_dataset(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Write the kept entries of a JSON-lines dataset, as they are, beside it; returns their path and the rows per reason.

    One pass over the dataset: the rows per reason are observed while the kept entries are written. The report is written last and marks the
    kept entries as complete. Entries without a report are left from a run that was cut off, and are replaced; a finished
    result is not.
    """
    if refilter_report(spark, path) is not None:
        raise FileExistsError(report_path(path))
    seen = Observation()
    counts = [F.count_if(F.col("reason") == reason).alias(f"r{k}") for k, reason in enumerate(vocab.REASONS)]
    flagged = flag_dataset(parse_jsonl(spark.read.text(path))).observe(seen, F.count("*").alias("rows"), F.count("reason").alias("rejected"), *counts)
    target = write_filtered(flagged.filter(F.col("reason").isNull()), path, "overwrite")
    told = seen.get
    rows = [(reason, told[f"r{k}"]) for k, reason in enumerate(vocab.REASONS) if told[f"r{k}"]]
    if sum(n for _, n in rows) != told["rejected"]:
        raise ValueError("a reason is not in the list of reasons")
    report = spark.createDataFrame([(None, told["rows"] - told["rejected"]), *rows], REPORT)
    report.coalesce(1).write.mode("errorifexists").json(report_path(path), ignoreNullFields=False)
    return target, refilter_report(spark, path)
