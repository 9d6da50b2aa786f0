"""String rules: results must equal those of Python's str and re."""

import re

import pytest
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.functions.dialect import (
    any_phrase,
    count_hits,
    filled_lines,
    key_words,
    longest,
    may_hold,
    rx,
    strip,
    word_count,
    word_tokens,
    words,
)

TEXTS = [
    "",
    "   ",
    "plain words here",
    "a b  c d\x1ce",
    "　 lead and trail \x1f\x85",
    "line one\r\nline two still two\n\n  \n three ",
    "École ÉCOLE straße ſcript K",
    "naïve test tested attest test. (test)",
    "emoji 😀 and é combined",
    "price US$99a and US$99 and $5",
    "step 12 of the basics of it\tlearn more",
    "digits ٣٤ and 12 and ½",
]


def _column(spark, expr, texts=TEXTS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strip_words_and_lines(spark):
    assert _column(spark, strip(F.col("t"))) == [t.strip() for t in TEXTS]
    assert _column(spark, words(F.col("t"))) == [t.split() for t in TEXTS]
    assert _column(spark, word_count(F.col("t"))) == [len(t.split()) for t in TEXTS]
    expected = [[line.strip() for line in t.split("\n") if line.strip()] for t in TEXTS]
    assert _column(spark, filled_lines(F.col("t"))) == expected


@pytest.mark.parametrize("pattern", [r"\s+", r"\w+", r"\d+", r"[A-Z\s/]*c", r".+$", r"[^\d]{1,5}"])
def test_tokens_match_like_python(spark, pattern):
    got = _column(spark, F.regexp_extract_all("t", F.lit(rx(pattern)), F.lit(0)))
    assert got == [[m.group() for m in re.finditer(pattern, t)] for t in TEXTS]


@pytest.mark.parametrize("pattern", ["école", "script", "k", "<ScRipt"])
def test_case_folding_matches_python(spark, pattern):
    texts = [*TEXTS, "<ſcript>", "<SCRIPT>"]
    got = _column(spark, F.col("t").rlike(rx(pattern, "i")), texts)
    assert got == [bool(re.search(pattern, t, re.I)) for t in texts]


def test_odd_folds_are_noticed(spark):
    got = _column(spark, F.expr(may_hold("t", ["needle"])), ["abc", "\u017f", "\u212a", "\u0130", "\u0131", "a NEEDLE"])
    assert got == [False, True, True, True, True, True]


@pytest.mark.parametrize("alternatives", [p for ps in vocab.HIGH_VALUE.values() for p in ps] + vocab.LOW_VALUE)
def test_phrases_match_like_word_edges(spark, alternatives):
    samples = []
    for phrase in alternatives.split("|"):
        plain = phrase.replace(r"\d+", "42").replace("\\", "")
        samples += [plain, f"x{plain}", f"{plain}x", f"é{plain}", f"a ({plain})!", f"us{plain}", f"{plain}_", plain.upper()]
    samples += TEXTS
    low = F.lower("t")
    got = _column(spark, any_phrase(low, word_tokens(F.array_distinct(words(low))), alternatives), samples)
    assert got == [bool(re.search(rf"\b({alternatives})\b", s.lower())) for s in samples]
    assert all(key_words(alternatives)[:1])


def test_count_hits_and_longest(spark):
    assert _column(spark, count_hits(F.col("t"), ["test", "(test)", "absent"]))[7] == 2
    df = spark.createDataFrame([(["ab", "cde", "xyz"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(longest(F.col("a"))).collect()] == ["cde", None]
