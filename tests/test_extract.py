import random

import pytest
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.operators import extract


def _text(spark, html, **options):
    df = spark.createDataFrame([(1, "https://h.com/x", html)], "page_id bigint, url string, html string")
    return extract.extract_text(df, **options).first()["text"]


def test_noise_and_tags_go(spark):
    html = (
        "<NAV class='a'>menu one two</nav><script>var x = 1;</script><!-- gone --><p>Kept line one.</p>"
        "<form><input type=x>ask me</form><aside>ad words</aside><p>Kept line two.</p>"
    )
    assert _text(spark, html) == "Kept line one.\nKept line two."


def test_unclosed_elements_stay(spark):
    assert _text(spark, "<nav>one <b>two</b> <script>a < b") == "one two a < b"
    many = "</nav>" + "<nav>" * 3000 + "end of page"
    assert _text(spark, many) == "end of page"


def test_main_part_needs_more_than_200_characters(spark):
    short, enough = "a " * 100, "b " * 100 + "c"
    assert "outside text" in _text(spark, f"<main>{short}</main><p>outside text</p>")
    assert "outside text" not in _text(spark, f"<main>{enough}</main><p>outside text</p>")


def test_longest_article_wins_and_first_on_ties(spark):
    one, two = "first one " * 30, "other two " * 30
    assert _text(spark, f"<article>{one}</article><article>{two}</article>").startswith("first one")
    # a pattern that occurs with a short match is not passed over for the next one
    both = _text(spark, f"<main>too short</main><article>{one}</article>")
    assert both.startswith("too short")


def test_blocks_and_entities(spark):
    html = "<h2>Head line</h2>body text<br/>next row<li>list item</li><p>a &amp;lt; b &copy;&nbsp;c</p>tail end"
    assert _text(spark, html) == "Head line\nbody text\nnext row\n- list item a < b &copy; c\ntail end"


def test_heading_over_two_lines_is_only_stripped(spark):
    assert _text(spark, "x y<h1>a b\nc d</h1>e f") == "x y a b\nc d e f"


def test_link_element_before_item(spark):
    assert _text(spark, "<link rel='x'>head words<li>item words</li>") == "- head words item words"


def test_code_option(spark):
    html = "<p>some words</p><pre>def f</pre><p>more <code>x</code> words</p>"
    assert "def f" in _text(spark, html)
    assert _text(spark, html, clean_code=True) == "some words\nmore words"


def test_boilerplate(spark):
    html = "<p>Skip to main content here we go</p><p>Copyright 2024 by us</p><p>Browse all Meals/Food. next words</p>"
    assert _text(spark, html) == "here we go\nby us\n. next words"


def test_short_and_single_word_lines(spark):
    html = "ab<br>word<br>two words<br>-x<br>-xy<br>a b"
    assert _text(spark, html) == "two words\n-xy\na b"


def test_recipe_lines(spark):
    html = "Title here<br>2 cups flour<br>- 3 tbsp sugar<br>1) Mix well<br>2. Bake it<br>Add 5 g salt"
    assert _text(spark, html) == "Title here\n- 2 cups flour\n- 3 tbsp sugar\n1. ) Mix well\n2. Bake it\nAdd 5 g salt"


def _walk(kinds):
    """Recipe formatting as a walk over (measure, step) flags: what happens to each line."""
    part, done = None, []
    for measure, step in kinds:
        if measure and part is None:
            part = "ingredients"
        elif step and part != "steps":
            part = "steps"
        done.append("bullet" if part == "ingredients" and measure else "number" if part == "steps" and step else "")
    return done


def test_recipe_lines_equal_a_walk(spark):
    lines = {(False, False): "plain words", (True, False): "about 2 cups", (False, True): "7. wash up", (True, True): "3. heat 2 cups"}
    rng = random.Random(3)
    docs = [[rng.choice(list(lines)) for _ in range(rng.randint(1, 9))] for _ in range(300)]
    rows = [(i, "\n".join(lines[k] for k in doc)) for i, doc in enumerate(docs)]
    got = extract.recipe_lines(spark.createDataFrame(rows, "i int, text string")).orderBy("i").collect()
    for row, doc in zip(got, docs):
        expected = []
        for kind, act in zip(doc, _walk(doc)):
            line = lines[kind]
            expected.append(f"- {line}" if act == "bullet" else line)
        assert row.text.split("\n") == expected, doc


@pytest.mark.parametrize("n,failed", [(49, True), (50, False)])
def test_extraction_error(spark, n, failed):
    df = spark.createDataFrame([("x" * n,)], "text string")
    assert (extract.with_extraction_error(df).first()["error"] == vocab.NO_CONTENT) is failed


def test_null_and_empty_pages(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "page_id bigint, html string")
    rows = {r.page_id: r.text for r in extract.extract_text(df).collect()}
    assert rows == {1: None, 2: ""}


def test_long_text_is_cut_on_request_only(spark):
    assert len(_text(spark, "many words " * 30000)) == 11 * 30000 - 1
    df = spark.createDataFrame([(1, "many words " * 300)], "page_id bigint, html string")
    assert extract.extract_text(df, limit=100).first()["text"] == ("many words " * 300)[:100]


def test_extraction_runs_once_under_a_filter(spark):
    df = spark.createDataFrame([(1, "<p>a b</p>")], "page_id bigint, html string")
    kept = extract.extract_text(df).filter(F.length("text") > 1)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(replace") == 0 and plan.count("Follow us on (?:Facebook") == 1
