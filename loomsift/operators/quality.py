"""Quality scores of texts.

All scores are integers; a NULL text gives NULL scores, so rows that an earlier gate has rejected
cost nothing here.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import urls, vocab
from loomsift.functions.dialect import any_phrase, const_array, count_matches, key_words, rx, word_tokens, words
from loomsift.functions.session import fence

DIMENSIONS = list(vocab.WEIGHTS)


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def length_score(text: Column, lowered: Column) -> Column:
    n = F.length(text)
    instructional = count_matches(lowered, [rx(p) for p in vocab.SHORT_INSTRUCTIONAL])
    return (
        F.when(n < 100, 0)
        .when(n < 200, F.when(instructional >= 2, 70).otherwise(20))
        .when(n < 300, 55)
        .when(n < 500, 65)
        .when(n < 800, 75)
        .when(n <= 5000, 100)
        .when(n <= 10000, 85)
        .when(n <= 20000, 70)
        .when(n > 20000, 50)
    )


_HIGH_VALUE = [p for patterns in vocab.HIGH_VALUE.values() for p in patterns]
_TOKENS = sorted({w for p in [*_HIGH_VALUE, *vocab.LOW_VALUE] for w in key_words(p)})


def _count_phrases(lowered: Column, tokens: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [any_phrase(lowered, tokens, p).cast("int") for p in patterns])


def category_hits(lowered: Column, tokens: Column) -> list[Column]:
    """Matching high-value patterns of each category."""
    return [_count_phrases(lowered, tokens, patterns) for patterns in vocab.HIGH_VALUE.values()]


def information_density(text: Column, n_words: Column, n_unique: Column, hits: list[Column]) -> Column:
    sentences = F.regexp_count(text, F.lit("[.!?]+"))
    per_sentence = F.try_divide(n_words, sentences)
    pace = (
        F.when(per_sentence.between(15, 25), 20)
        .when((per_sentence >= 10) & (per_sentence <= 35), 10)
        .when((per_sentence < 5) | (per_sentence > 50), -20)
        .otherwise(0)
    )
    patterns = F.least(F.lit(30), reduce(lambda a, b: a + b, hits) * 3)
    repetitive = F.when(F.try_divide(n_unique, n_words) < 0.3, 20).otherwise(0)
    return F.when(sentences == 0, 0).otherwise(_clamp(F.lit(50) + pace + patterns - repetitive))


# A character without which a structure cannot occur: a cheap test ahead of the pattern.
_STRUCTURE_MARK = {"hash_headings": "#", "label_headings": ":", "code": "`", "quotes": ">"}


def _has_structure(text: Column, name: str) -> Column:
    if name == "label_headings":
        # consuming the run up to a stop mark or colon decides all line starts inside it at once
        labels = F.regexp_extract_all(text, F.lit(rx(r"(?:^|\n)[A-Z][^.!?:]*+(:?)")), F.lit(1))
        found = F.array_contains(labels, ":")
    else:
        found = text.rlike(rx(vocab.STRUCTURE[name]))
    mark = _STRUCTURE_MARK.get(name)
    return text.contains(mark) & found if mark else found


def structure(text: Column) -> Column:
    headings = _has_structure(text, "hash_headings") | _has_structure(text, "label_headings")
    present = [_has_structure(text, n) for n in ("lists", "numbered")]
    present += [headings] + [_has_structure(text, n) for n in ("code", "quotes")]
    paragraphs = F.size(F.split(text, "\n\n"))
    score = reduce(lambda total, p: total + p.cast("int") * 12, present, F.lit(40))
    score = score + F.when(paragraphs.between(2, 20), 15).when(paragraphs > 20, 5).otherwise(0)
    return F.least(F.lit(100), score)


def educational_value(hits: list[Column]) -> Column:
    found = reduce(lambda a, b: a + b, [(h > 0).cast("int") for h in hits])
    bonus = F.when(found >= 3, 20).when(found == 2, 10).otherwise(0)
    return F.least(F.lit(100), F.lit(30) + found * 15 + bonus)


def noise_level(lowered: Column, tokens: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - _count_phrases(lowered, tokens, vocab.LOW_VALUE) * 8)


def overall(scores: dict[str, Column]) -> Column:
    """Weighted sum, added in the order of the weights."""
    terms = [scores[name].cast("double") * F.lit(weight) for name, weight in vocab.WEIGHTS.items()]
    return reduce(lambda a, b: a + b, terms)


def rating(total: Column) -> Column:
    ladder = F.when(total.isNull(), None)
    for bound, name in vocab.RATINGS:
        ladder = ladder.when(total >= bound, name)
    return ladder.otherwise(vocab.LOWEST_RATING)


def rejection_reason(total: Column, scores: dict[str, Column]) -> Column:
    """Text of the weakest dimension (the first one on ties); NULL from an overall score of 50 on."""
    lowest = F.least(*[scores[name] for name in DIMENSIONS])
    reason = F.when(total.isNull() | (total >= 50), None)
    for name in DIMENSIONS:
        reason = reason.when(scores[name] == lowest, vocab.WEAKNESS[name])
    return reason


def score_content(df: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """Add the six scores, ``overall`` and ``rating``."""
    df = df.withColumn("_lower", F.lower(text))
    df = df.withColumn("_words", words(F.col("_lower")))
    df = df.withColumn("_unique", F.array_distinct("_words"))
    # of the tokens only those that any pattern asks for are kept
    wanted = F.array_intersect(word_tokens(F.col("_unique")), const_array(_TOKENS))
    df = df.withColumns({"_n_words": F.size("_words"), "_n_unique": F.size("_unique"), "_tokens": wanted})
    hits = category_hits(F.col("_lower"), F.col("_tokens"))
    df = df.withColumns({f"_hits{i}": h for i, h in enumerate(hits)})
    counted = [F.col(f"_hits{i}") for i in range(len(hits))]
    scores = {
        "length": length_score(F.col(text), F.col("_lower")),
        "information_density": information_density(F.col(text), F.col("_n_words"), F.col("_n_unique"), counted),
        "structure": structure(F.col(text)),
        "educational_value": educational_value(counted),
        "noise_level": noise_level(F.col("_lower"), F.col("_tokens")),
        "url_quality": urls.quality(F.col(url)),
    }
    # least() and greatest() pass over NULL
    df = df.withColumns({name: F.when(F.col(text).isNotNull(), score) for name, score in scores.items()}).drop("_lower", "_words", "_unique", "_tokens", "_n_words", "_n_unique", *[f"_hits{i}" for i in range(len(hits))])
    df = df.withColumn("overall", overall({name: F.col(name) for name in DIMENSIONS}))
    return fence(df.withColumn("rating", rating(F.col("overall"))), *DIMENSIONS, "overall", "rating")


def with_rejection_reason(scored: DataFrame) -> DataFrame:
    return scored.withColumn(
        "reason", rejection_reason(F.col("overall"), {name: F.col(name) for name in DIMENSIONS})
    )


def rating_summary(scored: DataFrame) -> DataFrame:
    """Rows and average score per rating."""
    return scored.groupBy("rating").agg(F.count("*").alias("rows"), F.round(F.avg("overall"), 6).alias("avg_overall"))
