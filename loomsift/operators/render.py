"""Chat-format rows: titles, prompts, answers, and the way back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.functions.dialect import contains_any, quote, strip
from loomsift.functions.session import fence
from loomsift.options import RenderOptions


def title(content: Column) -> Column:
    """First of the first five lines that can be a title."""
    lines = F.transform(F.slice(F.split(content, "\n"), 1, 5), strip)
    branding = "^(?:" + "|".join(quote(w) for w in vocab.TITLE_BRANDING) + ")"
    link = "^(?:" + "|".join(quote(w) for w in vocab.TITLE_LINKS) + ")"
    fitting = F.filter(
        lines, lambda x: F.length(x).between(3, 150) & ~F.lower(x).rlike(branding) & ~x.rlike(link)
    )
    return F.coalesce(F.get(fitting, F.lit(0)), F.lit(vocab.NO_TITLE))


def with_title(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("title", title(F.col(text)))


def with_answer(df: DataFrame, text: str = "text", title_col: str = "title", out: str = "answer") -> DataFrame:
    """The content without branding in its first three lines and without repeats of the title.

    Branding lines always go. A title line after the first line goes while fewer than two lines
    are gone, that is when it is one of the first two candidates for removal.
    """
    df = df.withColumn("_lines", F.split(strip(F.col(text)), "\n"))
    # only lines that hold branding or equal the title matter: their positions, in order
    flagged = F.transform(
        "_lines",
        lambda x, i: F.when((i < 3) & contains_any(F.lower(x), vocab.ANSWER_BRANDING), i)
        .when((i > 0) & x.contains(F.col(title_col)) & (strip(x) == F.col(title_col)), i + F.lit(1_000_000_000))
        .otherwise(-1),
    )
    df = df.withColumn("_gone", F.filter(flagged, lambda k: k >= 0))
    early = F.slice("_gone", 1, 2)
    df = df.withColumn(
        "_gone",
        F.transform(
            F.array_union(F.filter("_gone", lambda k: k < 1_000_000_000), early), lambda k: k % 1_000_000_000
        ),
    )
    kept = F.when(F.size("_gone") == 0, F.col("_lines")).otherwise(
        F.filter("_lines", lambda x, i: ~F.array_contains(F.col("_gone"), i))
    )
    return df.withColumn(out, F.array_join(kept, "\n")).drop("_lines", "_gone")


def prompt_template(content_type: str, custom_prompt: str = "") -> str:
    """Prompt of a content type, unless a custom one is given; unknown types use the custom type."""
    fallback = vocab.CONTENT_TYPES[vocab.CUSTOM_CONTENT_TYPE]
    return custom_prompt.strip() or vocab.CONTENT_TYPES.get(content_type, fallback)[0]


def with_user_prompt(df: DataFrame, options: RenderOptions, title_col: str = "title", out: str = "prompt") -> DataFrame:
    template = prompt_template(options.content_type, options.custom_prompt)
    return df.withColumn(out, F.replace(F.lit(template), F.lit("{title}"), F.col(title_col)))


def _frame(template: str, slot: str, value: Column) -> Column:
    before, after = template.split("{" + slot + "}")
    return F.concat(F.lit(before), value, F.lit(after))


def chat_text(prompt: Column, answer: Column, options: RenderOptions) -> Column:
    """One training text in the chosen chat template."""
    tpl = vocab.CHAT_TEMPLATES.get(options.template, vocab.CHAT_TEMPLATES[vocab.DEFAULT_TEMPLATE])
    system = options.system_prompt.strip()
    parts = [F.lit(tpl["begin"])]
    if system:
        parts.append(_frame(tpl["system"], "system", F.lit(system)))
    parts += [_frame(tpl["user"], "user", prompt), _frame(tpl["assistant"], "assistant", answer)]
    # two backslashes and an n stand for a newline
    return F.replace(F.concat(*parts), F.lit("\\\\n"), F.lit("\n"))


def render_chat(df: DataFrame, options: RenderOptions = RenderOptions(), text: str = "text", out: str = "chat") -> DataFrame:
    """Add the training text of every row; a NULL text stays NULL."""
    df = with_answer(df.withColumn("_title", title(F.col(text))), text, "_title", "_answer")
    df = with_user_prompt(df, options, "_title", "_prompt")
    rendered = F.when(F.col(text).isNotNull(), chat_text(F.col("_prompt"), F.col("_answer"), options))
    return fence(df.withColumn(out, rendered).drop("_title", "_answer", "_prompt"), out)


def with_template(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Prompt and system prompt per row by content type, that of the custom type on a miss."""
    spark = df.sparkSession
    rows = [(name, prompt, system) for name, (prompt, system) in vocab.CONTENT_TYPES.items()]
    types = spark.createDataFrame(rows, f"`{content_type}` string, user_prompt string, system_prompt string")
    prompt, system = vocab.CONTENT_TYPES[vocab.CUSTOM_CONTENT_TYPE]
    # eleven rows: a fixed table is always small enough to broadcast
    joined = df.join(F.broadcast(types), content_type, "left")
    return joined.fillna({"user_prompt": prompt, "system_prompt": system})


def unwrapped(text: Column) -> Column:
    """Stripped text of the first assistant turn, whatever the template; the whole text without one."""
    result = F.when(text.isNull(), F.lit(""))
    for marker, end in vocab.ASSISTANT_MARKERS:
        turn = F.get(F.split(text, quote(marker), 3), F.lit(1))
        result = result.when(text.contains(marker), strip(F.substring_index(turn, end, 1)))
    return result.otherwise(text)


def unwrap_assistant(df: DataFrame, text: str = "text", out: str = "content") -> DataFrame:
    return df.withColumn(out, unwrapped(F.col(text)))


def render_turns(conversations: DataFrame, options: RenderOptions = RenderOptions()) -> DataFrame:
    """``(conv_id, turns, chat)``: one training text per conversation with all its turns in order.

    A system turn stands where it is; without one the system prompt of the options comes first. Turns of other roles than system,
    user and assistant are left out and do not count. Null texts are empty.
    """
    tpl = vocab.CHAT_TEMPLATES.get(options.template, vocab.CHAT_TEMPLATES[vocab.DEFAULT_TEMPLATE])
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.when(F.col("role") == "assistant", _frame(tpl["assistant"], "assistant", strip(text)))
    for role in ("system", "user"):
        part = part.when(F.col("role") == role, _frame(tpl[role], role, text))
    parts = conversations.select("conv_id", "turn", "role", part.alias("part")).filter(F.col("part").isNotNull())
    whole = parts.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.bool_or(F.col("role") == "system").alias("_system"),
        F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("_parts"),
    )
    head, system = F.lit(tpl["begin"]), options.system_prompt.strip()
    if system:
        head = F.concat(head, F.when(F.col("_system"), F.lit("")).otherwise(_frame(tpl["system"], "system", F.lit(system))))
    chat = F.concat(head, F.array_join("_parts.part", ""))
    return whole.select("conv_id", "turns", F.replace(chat, F.lit("\\\\n"), F.lit("\n")).alias("chat"))
