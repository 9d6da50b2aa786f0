import pytest
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.operators import quality


def _scores(spark, text, url="https://h.com/x"):
    df = spark.createDataFrame([(text, url)], "text string, url string")
    return quality.with_rejection_reason(quality.score_content(df)).first()


@pytest.mark.parametrize(
    "n,score",
    [(0, 0), (99, 0), (100, 20), (199, 20), (200, 55), (299, 55), (300, 65), (499, 65), (500, 75), (799, 75), (800, 100),
     (5000, 100), (5001, 85), (10000, 85), (10001, 70), (20000, 70), (20001, 50)],
)
def test_length_steps(spark, n, score):
    assert _scores(spark, "x" * n)["length"] == score


@pytest.mark.parametrize("words,score", [("first of all", 20), ("first of all then", 70), ("Steps: and 3.", 70)])
def test_short_instructional_text(spark, words, score):
    assert _scores(spark, words.ljust(150, "x"))["length"] == score


@pytest.mark.parametrize(
    "per_sentence,score",
    [(4, 30), (5, 50), (9, 50), (10, 60), (14, 60), (15, 70), (25, 70), (26, 60), (35, 60), (36, 50), (50, 50), (51, 30)],
)
def test_words_per_sentence(spark, per_sentence, score):
    text = " ".join(f"w{i}" for i in range(per_sentence)) + "."
    assert _scores(spark, text)["information_density"] == score


def test_no_sentence_and_repetition(spark):
    assert _scores(spark, "no mark at all")["information_density"] == 0
    assert _scores(spark, " ".join(["again"] * 20) + ".")["information_density"] == 50
    assert _scores(spark, " ".join(["w1 w2 w3"] + ["w1"] * 7) + " .")["information_density"] == 60


def test_structure_parts(spark):
    assert _scores(spark, "plain")["structure"] == 40
    assert _scores(spark, "x\n- a\n* b\n• c")["structure"] == 52
    assert _scores(spark, "x\n- a\n- b")["structure"] == 40
    assert _scores(spark, "x\n1. a\n2) b\n3. c")["structure"] == 52
    assert _scores(spark, "# title")["structure"] == 52
    assert _scores(spark, "Label: text")["structure"] == 52
    assert _scores(spark, "Label. text: more")["structure"] == 40
    assert _scores(spark, "use `x` now")["structure"] == 52
    assert _scores(spark, "a\n  > quoted")["structure"] == 52
    assert _scores(spark, "a\n\nb")["structure"] == 55
    assert _scores(spark, "\n\n".join("ab" * 21))["structure"] == 45


def test_many_bullets_do_not_overflow(spark):
    assert _scores(spark, "x" + "\n- item text" * 20000)["structure"] == 52


def test_educational_value(spark):
    assert _scores(spark, "nothing")["educational_value"] == 30
    assert _scores(spark, "a tutorial")["educational_value"] == 45
    assert _scores(spark, "a tutorial on history")["educational_value"] == 70
    assert _scores(spark, "a tutorial on history and method")["educational_value"] == 95
    assert _scores(spark, "a tutorial on history, method, review")["educational_value"] == 100


def test_noise(spark):
    assert _scores(spark, "clean words")["noise_level"] == 100
    assert _scores(spark, "home and search and sale")["noise_level"] == 76
    everything = " . ".join(p.split("|")[0] for p in vocab.LOW_VALUE)
    assert _scores(spark, everything)["noise_level"] == 12


@pytest.mark.parametrize("total,name", [(80.0, "excellent"), (79.9, "good"), (65.0, "good"), (64.9, "fair"), (50.0, "fair"), (49.95, "poor")])
def test_rating(spark, total, name):
    assert spark.range(1).select(quality.rating(F.lit(total))).first()[0] == name


def test_rejection_reason_takes_first_weakest(spark):
    names = quality.DIMENSIONS
    values = dict.fromkeys(names, 40) | {"structure": 10, "noise_level": 10}
    scores = {n: F.lit(v) for n, v in values.items()}
    row = spark.range(1).select(quality.rejection_reason(F.lit(30.0), scores), quality.rejection_reason(F.lit(50.0), scores)).first()
    assert tuple(row) == (vocab.WEAKNESS["structure"], None)


def test_null_text_has_no_scores(spark):
    row = _scores(spark, None)
    assert row["overall"] is None and row["rating"] is None and row["reason"] is None
