"""Gates that keep or reject rows.

Each gate adds a column instead of dropping rows; :mod:`loomsift.plans.curate` chains them so
that one pass over the pages gives both the kept rows and the funnel.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import urls, vocab
from loomsift.functions.dialect import contains_any, count_hits, filled_lines, word_count
from loomsift.functions.session import fence
from loomsift.options import GateOptions


def url_gate(df: DataFrame, url: str = "url") -> DataFrame:
    """``url_reason``: ``browse``, ``non_content`` or NULL."""
    return df.withColumn("url_reason", urls.gate_reason(F.col(url)))


def domain_blacklist(df: DataFrame, blacklist, url: str = "url") -> DataFrame:
    """Keep rows whose lower-cased URL holds none of the listed strings."""
    return df.filter(~contains_any(F.lower(url), blacklist))


def junk_reason(text: Column, url: Column, lowered: Column, lines: Column, digit_density: bool = True) -> Column:
    """Reason of the first failing check, NULL for valid content.

    ``lines`` are the stripped non-blank lines of the text.
    """
    lowered_url = F.lower(url)
    n_lines = F.size(lines)
    first_lines = F.slice(lines, 1, 30)
    title_like = F.size(
        F.filter(first_lines, lambda x: (F.length(x) > 15) & (F.length(x) < 60) & x.rlike(r"^\p{IsUppercase}"))
    )
    n_words = word_count(text)
    digits_rare = F.try_divide(F.regexp_count(text, F.lit(r"\p{Nd}+")), n_words) < 0.015
    total_length = F.length(F.array_join(lines, ""))
    reason = (
        F.when(text.isNull() | lowered_url.contains(vocab.MEAL_BYPASS), None)
        .when(count_hits(lowered, vocab.JUNK_KEYWORDS) >= 3, vocab.REASON_JUNK)
        .when((n_lines > 20) & (title_like > F.size(first_lines) * F.lit(0.85)), vocab.REASON_INDEX)
        .when(
            contains_any(lowered_url, vocab.LISTING_URLS)
            & (count_hits(lowered, vocab.INGREDIENT_WORDS) < 2)
            & (count_hits(lowered, vocab.INSTRUCTION_WORDS) < 3),
            vocab.REASON_LISTING,
        )
    )
    if digit_density:
        reason = reason.when((n_words > 150) & digits_rare, vocab.REASON_DIGITS)
    return reason.when((n_lines > 25) & (F.try_divide(total_length, n_lines) < 20), vocab.REASON_SHORT_LINES)


def junk_gate(
    df: DataFrame, text: str = "text", url: str = "url", digit_density: bool = True, out: str = "junk_reason"
) -> DataFrame:
    """Add the junk reason, NULL for valid content."""
    df = df.withColumn("_lower", F.lower(text)).withColumn("_lines", filled_lines(F.col(text)))
    reason = junk_reason(F.col(text), F.col(url), F.col("_lower"), F.col("_lines"), digit_density)
    return fence(df.withColumn(out, reason).drop("_lower", "_lines"), out)


def length_decision(n: Column, overall: Column, options: GateOptions) -> Column:
    """``ok``, ``short_ok`` (accepted despite its length) or ``short``; NULL for a NULL length."""
    decision = F.when(n >= options.min_chars, "ok").when(n < options.short_min_chars, "short")
    if options.ignore_quality_short:
        return decision.when(n.isNotNull(), "short_ok")
    if options.allow_short_quality:
        return decision.when(overall >= vocab.SHORT_QUALITY, "short_ok").when(n.isNotNull(), "short")
    return decision.when(n.isNotNull(), "short")


def length_gate(df: DataFrame, options: GateOptions, text: str = "text", overall: str = "overall") -> DataFrame:
    """``length_gate`` decision; the overall score is only read for short texts."""
    return df.withColumn("length_gate", length_decision(F.length(text), F.col(overall), options))


def truncate(df: DataFrame, max_chars: int, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.substring(text, 1, max_chars))


def keyword_reason(text: Column, options: GateOptions) -> Column:
    lowered = F.lower(text)
    reason = F.when(text.isNull(), None)
    if options.keywords_in:
        reason = reason.when(~contains_any(lowered, options.keywords_in), "missing keyword")
    if options.keywords_out:
        reason = reason.when(contains_any(lowered, options.keywords_out), "excluded keyword")
    return reason


def keyword_gate(df: DataFrame, options: GateOptions, text: str = "text") -> DataFrame:
    """``keyword_reason`` from the include and exclude lists; NULL passes."""
    return df.withColumn("keyword_reason", keyword_reason(F.col(text), options))


def quality_gate(scored: DataFrame, threshold: float = 50.0) -> DataFrame:
    """``accepted`` by the overall score."""
    return scored.withColumn("accepted", F.col("overall") >= F.lit(float(threshold)))
