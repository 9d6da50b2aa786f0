import random

import pytest

from loomsift.functions import vocab
from loomsift.operators import render
from loomsift.options import RenderOptions


def _frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


@pytest.mark.parametrize(
    "text,title",
    [("", vocab.NO_TITLE), ("\n\n  My title \nx", "My title"), ("Recipe API page\nReal one", "Real one"),
     ("https://h.com\nwww.x.y\nab\nAbc", "Abc"), ("a" * 151 + "\n" + "b" * 150, "b" * 150), ("ab\n" * 5 + "late", vocab.NO_TITLE),
     ("Costs $5 {x}", "Costs $5 {x}")],
)
def test_title(spark, text, title):
    assert render.with_title(_frame(spark, text)).first()["title"] == title


def _walk(text, title):
    kept, gone = [], 0
    for i, line in enumerate(text.strip().split("\n")):
        if i < 3 and any(b in line.lower() for b in vocab.ANSWER_BRANDING):
            gone += 1
        elif i > 0 and gone < 2 and line.strip() == title:
            gone += 1
        else:
            kept.append(line)
    return "\n".join(kept)


def test_answer_equals_a_walk(spark):
    rng = random.Random(5)
    pool = ["Title", " Title ", "TheMealDB here", "get it - free", "body line", "", "Titled"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    rows = render.with_answer(render.with_title(_frame(spark, *texts))).orderBy("i").collect()
    for row in rows:
        assert row.answer == _walk(row.text, row.title), row.text


def test_chat_text(spark):
    options = RenderOptions(template="Qwen2.5 Instruct", content_type="Tutorial", system_prompt="  Be kind. ")
    got = render.render_chat(_frame(spark, "Set $1 up\nbody \\\\n end"), options).first()["chat"]
    assert got == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user\nHow do I Set $1 up?<|im_end|>\n"
        "<|im_start|>assistant\nSet $1 up\nbody \n end<|im_end|>\n"
    )


def test_blank_system_and_unknown_names(spark):
    options = RenderOptions(template="none such", content_type="none such", system_prompt=" ")
    got = render.render_chat(_frame(spark, "abc"), options).first()["chat"]
    assert got == (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nabc<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\nabc<|eot_id|>"
    )
    assert render.prompt_template("Recipe", " Tell {title} ") == "Tell {title}"


@pytest.mark.parametrize("template", list(vocab.CHAT_TEMPLATES))
def test_unwrap_gives_the_answer_back(spark, template):
    df = render.render_chat(_frame(spark, "A title\nsome body\nlast"), RenderOptions(template=template), out="text2")
    assert render.unwrap_assistant(df, "text2").first()["content"] == "A title\nsome body\nlast"


def test_unwrap_edges(spark):
    marker, end = vocab.ASSISTANT_MARKERS[0]
    texts = ["no marker", f"x{marker} open ended ", f"a{marker} one {marker} two {end}", None]
    got = [r.content for r in render.unwrap_assistant(_frame(spark, *texts)).orderBy("i").collect()]
    assert got == ["no marker", "open ended", "one", ""]


def test_null_rows_stay_null(spark):
    assert render.render_chat(_frame(spark, None)).first()["chat"] is None


def test_whole_conversations(spark):
    rows = [(1, 0, "system", "rules"), (1, 2, "assistant", " a "), (1, 1, "user", "q"), (1, 3, "user", "open"), (2, 0, "user", None), (2, 1, "tool", "x")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in render.render_turns(df, RenderOptions(template="Qwen2.5 Instruct", system_prompt="default")).collect()}
    assert (got[1].turns, got[2].turns) == (4, 1)
    places = [got[1].chat.index(x) for x in ("rules", "q", "assistant\na<", "open")]
    assert places == sorted(places) and "default" not in got[1].chat and "default" in got[2].chat
