"""Pages to training rows in one pass, and the statistics of a run."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.functions import urls, vocab
from loomsift.functions.dialect import contains_any
from loomsift.functions.session import cut, fence
from loomsift.operators import extract, gates, quality, render
from loomsift.operators.ranking import first_rows
from loomsift.options import GateOptions, RenderOptions


def gated_text(pages: DataFrame, options: GateOptions = GateOptions()) -> DataFrame:
    """``(…, url_gate, text, error)``: URL gates, then extraction of the pages that pass them.

    The html of gated pages becomes NULL before the extraction, which then costs nothing.
    """
    url_gate = F.coalesce(
        urls.gate_reason(F.col("url")),
        F.when(contains_any(F.lower("url"), options.domain_blacklist), "blacklist"),
    )
    df = pages.withColumn("url_gate", url_gate).withColumn("html", F.when(F.col("url_gate").isNull(), F.col("html")))
    df = extract.extract_text(df, options.clean_code, limit=options.text_limit)
    short = F.col("url_gate").isNull() & (F.coalesce(F.length("text"), F.lit(0)) < vocab.MIN_EXTRACTED)
    return df.withColumn("error", F.when(short, vocab.NO_CONTENT))


def apply_gates(df: DataFrame, options: GateOptions = GateOptions()) -> DataFrame:
    """Outcome of extracted rows ``(url, text, url_gate, error)``.

    Adds ``outcome`` (success, failed, skipped), ``stage`` and ``reason`` of the rejection,
    ``chars`` and ``quality``; ``text`` is the truncated text of successes and NULL otherwise.
    A row that one gate rejects is NULL for the gates after it.
    """
    df = df.withColumn("text", F.when(F.col("url_gate").isNull() & F.col("error").isNull(), F.col("text")))
    df = gates.junk_gate(df, digit_density=options.digit_density)
    df = df.withColumn("text", F.when(F.col("junk_reason").isNull(), F.col("text")))
    df = df.withColumns({"_n": F.length("text"), "_keyword": gates.keyword_reason(F.col("text"), options)})
    is_short = F.col("_n") < options.min_chars

    # short texts are scored whole, others after truncation, and only where a score is asked for
    needs_score = F.lit(options.use_quality_filter)
    if options.ignore_quality_short or options.allow_short_quality:
        needs_score = needs_score | is_short
    alive = ~is_short | (F.col("_n") >= options.short_min_chars)
    if options.max_chars is not None:
        df = df.withColumn("text", F.when(is_short, F.col("text")).otherwise(F.substring("text", 1, options.max_chars)))
    df = df.withColumn("_scored", F.when(needs_score & alive, F.col("text")))
    df = quality.with_rejection_reason(quality.score_content(df, "_scored"))

    df = df.withColumn("_length", gates.length_decision(F.col("_n"), F.col("overall"), options))
    too_low = F.col("overall") < F.lit(float(options.quality_threshold))
    df = df.withColumn(
        "stage",
        F.when(F.col("url_gate").isNotNull(), "url")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("junk_reason").isNotNull(), "junk")
        .when(F.col("_length") == "short", "length")
        .when(F.col("_keyword").isNotNull(), "keyword")
        .when(F.lit(options.use_quality_filter) & (F.col("_length") == "ok") & too_low, "quality"),
    )
    accepted = F.col("stage").isNull()
    done = df.select(
        *[c for c in df.columns if c in ("page_id", "doc_id", "url", "ts")],
        F.when(accepted, "success").when(F.col("stage") == "error", "failed").otherwise("skipped").alias("outcome"),
        "stage",
        F.when(F.col("stage") == "url", F.col("url_gate"))
        .when(F.col("stage") == "error", F.col("error"))
        .when(F.col("stage") == "junk", F.col("junk_reason"))
        .when(F.col("stage") == "length", "too short")
        .when(F.col("stage") == "keyword", F.col("_keyword"))
        .when(F.col("stage") == "quality", F.col("reason"))
        .alias("reason"),
        F.when(accepted, F.length("text")).otherwise(0).alias("chars"),
        F.when(accepted, F.coalesce("overall", F.lit(0.0)))
        .when(F.col("stage") == "quality", F.col("overall"))
        .otherwise(0.0)
        .alias("quality"),
        F.when(accepted, F.col("text")).alias("text"),
    )
    return fence(done, "outcome", "stage", "reason", "chars", "quality", "text")


def curation_funnel(pages: DataFrame, options: GateOptions = GateOptions()) -> DataFrame:
    """Outcome of every page, with the kept text of the successes."""
    return apply_gates(gated_text(pages, options), options)


def training_rows(funnel: DataFrame, options: RenderOptions = RenderOptions()) -> DataFrame:
    """Rendered rows of the successes of a funnel."""
    return render.render_chat(funnel.filter("outcome = 'success'"), options)


def run_stats(funnel: DataFrame) -> DataFrame:
    """One row of run counters; junk and quality rejections are also in ``skipped``."""
    return funnel.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("outcome") == "success").alias("success"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.coalesce(F.col("stage") == "junk", F.lit(False))).alias("junk_filtered"),
        F.count_if(F.coalesce(F.col("stage") == "quality", F.lit(False))).alias("quality_filtered"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"),
    )


def average_quality(funnel: DataFrame) -> DataFrame:
    """Mean score of accepted rows with a score."""
    scored = (F.col("outcome") == "success") & (F.col("quality") > 0)
    return funnel.agg(F.round(F.avg(F.when(scored, F.col("quality"))), 6).alias("avg_quality"))


def reason_histogram(flagged: DataFrame, reason: str = "reason") -> DataFrame:
    """Rejected rows per reason, most frequent first."""
    counts = flagged.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), F.asc(reason))


def kept_share(flagged: DataFrame, reason: str = "reason") -> DataFrame:
    """One row: rows, kept rows and the kept percentage."""
    kept = F.count_if(F.col(reason).isNull())
    return flagged.agg(
        F.count("*").alias("rows"),
        kept.alias("kept"),
        F.when(F.count("*") > 0, F.round(kept / F.count("*") * 100, 6)).alias("kept_percent"),
    )


def stop_after(accepted: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` accepted rows in the given order, whose columns identify a row; 0 means all of them.

    The n-th value is selected by counts over the columns of the order, so that nothing is sorted and no text moves.
    """
    return first_rows(cut(accepted), n, *order) if n > 0 else accepted
