import pytest
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.operators import gates
from loomsift.options import GateOptions, word_list
from loomsift.plans import curate


def _junk(spark, text, url="https://h.com/x", **options):
    df = spark.createDataFrame([(text, url)], "text string, url string")
    return gates.junk_gate(df, **options).first()["junk_reason"]


def test_junk_keywords(spark):
    assert _junk(spark, "privacy policy, about us") is None
    assert _junk(spark, "Privacy Policy, about us, GDPR") == vocab.REASON_JUNK
    assert _junk(spark, "privacy policy, about us, gdpr", "https://h.com/Meal/1") is None


def _index(n_titles, n_other):
    return "\n".join([f"Title of dish number {i}" for i in range(n_titles)] + ["lower case line of text here"] * n_other)


@pytest.mark.parametrize("titles,other,reason", [(20, 0, None), (21, 0, vocab.REASON_INDEX), (17, 4, None), (18, 3, vocab.REASON_INDEX)])
def test_index_pages(spark, titles, other, reason):
    assert _junk(spark, _index(titles, other)) == reason


def test_listing_urls_need_recipe_words(spark):
    assert _junk(spark, "some words", "https://h.com/browse/x") == vocab.REASON_LISTING
    assert _junk(spark, "some words", "https://h.com/other/x") is None
    assert _junk(spark, "a cup and a pinch", "https://h.com/browse/x") is None
    assert _junk(spark, "cook, bake and fry", "https://h.com/tag/x") is None


@pytest.mark.parametrize("words,digits,reason", [(150, 0, None), (151, 0, vocab.REASON_DIGITS), (200, 2, vocab.REASON_DIGITS), (200, 3, None)])
def test_digit_density(spark, words, digits, reason):
    text = " ".join(["word"] * (words - digits) + ["7"] * digits)
    assert _junk(spark, text) == reason
    assert _junk(spark, text, digit_density=False) is None


def test_short_lines(spark):
    assert _junk(spark, "\n".join(["ten chars."] * 25)) is None
    assert _junk(spark, "\n".join(["ten chars."] * 26)) == vocab.REASON_SHORT_LINES
    assert _junk(spark, "\n".join(["twenty characters xx"] * 26)) is None


@pytest.mark.parametrize(
    "n,overall,strict,allowed,ignored",
    [(49, 90.0, "short", "short", "short"), (50, 69.9, "short", "short", "short_ok"), (50, 70.0, "short", "short_ok", "short_ok"),
     (149, 70.0, "short", "short_ok", "short_ok"), (150, 0.0, "ok", "ok", "ok")],
)
def test_length_gate(spark, n, overall, strict, allowed, ignored):
    options = [GateOptions(), GateOptions(allow_short_quality=True, short_min_chars=50), GateOptions(ignore_quality_short=True, short_min_chars=50)]
    row = spark.range(1).select(*[gates.length_decision(F.lit(n), F.lit(overall), o).alias(str(i)) for i, o in enumerate(options)])
    assert tuple(row.first()) == (strict, allowed, ignored)


def test_keywords_are_read_before_truncation(spark):
    options = GateOptions(keywords_in=word_list("Needed , other"), keywords_out=word_list("banned"), max_chars=10, use_quality_filter=False)
    rows = [("x" * 200 + " needed",), ("x" * 200,), ("needed" + "x" * 200 + "BANNED",)]
    df = spark.createDataFrame(rows, "text string").withColumns(
        {"url": F.lit("https://h.com/x"), "url_gate": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
    )
    got = [(r.outcome, r.reason, r.chars) for r in curate.apply_gates(df, options).collect()]
    assert sorted(got) == [("skipped", "excluded keyword", 0), ("skipped", "missing keyword", 0), ("success", None, 10)]


def test_blacklist(spark):
    df = spark.createDataFrame([("https://Bad.com/x",), ("https://ok.com/bad.COM",), ("https://ok.com",)], "url string")
    assert [r.url for r in gates.domain_blacklist(df, word_list("bad.com")).collect()] == ["https://ok.com"]
    assert gates.domain_blacklist(df, ()).count() == 3


def _pages(spark):
    body = "How to learn this: the definition of a method, step 1 and 2. " * 6
    rows = [
        (1, "https://h.com/privacy", f"<p>{body}</p>"),
        (2, "https://h.com/tiny", "<p>tiny page</p>"),
        (3, "https://h.com/good", f"<p>{body}</p>"),
        (4, "https://h.com/junk", f"<p>{body} privacy notice, contact us, gdpr, copyright, cookie policy info</p>"),
        (5, "https://h.com/api/x.json", f"<p>{body}</p>"),
        (6, "https://h.com/short", "<p>A line of some words that is just over the fifty characters.</p>"),
        (7, "https://h.com/dull", "<p>" + "some dull words again 1 " * 20 + "</p>"),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_funnel_accounts_for_every_page(spark):
    funnel = curate.curation_funnel(_pages(spark), GateOptions(quality_threshold=60.0)).cache()
    got = {r.page_id: (r.outcome, r.stage) for r in funnel.collect()}
    assert got == {
        1: ("skipped", "url"), 2: ("failed", "error"), 3: ("success", None), 4: ("skipped", "junk"),
        5: ("skipped", "url"), 6: ("skipped", "length"), 7: ("skipped", "quality"),
    }
    stats = curate.run_stats(funnel).first()
    assert stats.processed == stats.success + stats.failed + stats.skipped == 7
    assert (stats.junk_filtered, stats.quality_filtered) == (1, 1)
    assert curate.training_rows(funnel).count() == 1
    assert curate.stop_after(funnel, 0).count() == 7 and curate.stop_after(funnel, 2, "page_id").count() == 2


def test_no_reason_for_scores_from_fifty_on(spark):
    funnel = curate.curation_funnel(_pages(spark).filter("page_id = 3"), GateOptions(quality_threshold=99.0))
    row = funnel.first()
    assert (row.stage, row.reason) == ("quality", None) and row.quality >= 50


def test_gates_are_idempotent(spark):
    once = curate.curation_funnel(_pages(spark)).filter("outcome = 'success'").select("page_id", "url", "text")
    nothing = F.lit(None).cast("string")
    again = curate.apply_gates(once.withColumns({"url_gate": nothing, "error": nothing}))
    assert [r.outcome for r in again.collect()] == ["success"] * once.count()
