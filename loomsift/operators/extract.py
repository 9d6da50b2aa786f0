"""Main text of html pages.

Every step is a projection over one working column, so that each pattern runs once per page: a
step that needs its input twice starts a new projection instead of nesting the expression.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.functions.dialect import BLANK, filled_lines, longest, may_hold, rx
from loomsift.functions.session import fence


def _head(last: str, col: str = "html") -> str:
    """SQL for the part of a column that ends with the last match of ``last``; empty without one."""
    lead, rest = ("<", last[1:]) if last.startswith("<") else ("", last)
    return rf"regexp_extract({col}, r'(?ds)\A.*{lead}(?iu){rest}', 0)"


def _replace_up_to(col: str, last: str, pattern: str, by: str) -> str:
    """SQL to replace ``pattern`` in the head of a column.

    Every match ends with ``last``, so the result is the same as on the whole text, but opening
    tags that are never closed do not each scan to the end of the page.
    """
    head = _head(last, col)
    return f"concat(regexp_replace({head}, r'{pattern}', r'{by}'), substr({col}, length({head}) + 1))"


def _element(name: str) -> str:
    return rx(f"<{name}[^>]*>.*?</{name}>", "is")


def _drop(name: str, by: str = " ") -> tuple:
    """Step (literals of which one is in every match, SQL on a column) that drops an element."""
    last = f"</{name}>"
    return [last], lambda h: _replace_up_to(h, last, _element(name), by)


def _replace(pattern: str, by: str):
    return lambda h: f"regexp_replace({h}, r'{pattern}', r'{by}')"


_NOISE_STEPS = (
    [_drop(name) for name in vocab.NOISE_ELEMENTS]
    + [(["<!--"], lambda h: _replace_up_to(h, "-->", rx("<!--.*?-->", "s"), " "))]
    + [
        (["<input"], lambda h: _replace_up_to(h, ">", rx("<input[^>]*>", "i"), " ")) if name == "input" else _drop(name)
        for name in vocab.FORM_ELEMENTS
    ]
)
_BLOCK_STEPS = [
    (["</h"], lambda h: _replace_up_to(h, "</h[1-6]>", rx(r"<h[1-6][^>]*>(.*?)</h[1-6]>", "i"), "\n\n$1\n")),
    (["</li>"], lambda h: _replace_up_to(h, "</li>", rx(r"<li[^>]*>(.*?)</li>", "i"), "\n- $1")),
    (["</p>"], _replace(rx("</p>", "i"), "\n\n")),
    (["<br"], _replace(rx(r"<br\s*/?>", "i"), "\n")),
]
# these cut without leaving a blank, so that one may complete a tag of the next
_CODE_LITERALS = [f"</{name}>" for name in vocab.CODE_ELEMENTS]
_CODE_STEPS = [(_CODE_LITERALS, _drop(name, "")[1]) for name in vocab.CODE_ELEMENTS]
_LITERALS = sorted({x for literals, _ in [*_NOISE_STEPS, *_BLOCK_STEPS, *_CODE_STEPS] for x in literals})


def _flag(df: DataFrame, col: str) -> DataFrame:
    """Note which literals the page holds, once for all steps.

    Replacements are blanks or line structure and put no tag together, so a step whose literal is
    not in the page has nothing to do.
    """
    if "_has" in df.columns:
        return df
    tests = [f"contains(lower({col}), '{x}') AS t{i}" for i, x in enumerate(_LITERALS)]
    odd = f"{may_hold(col, [])} AS odd"
    return df.withColumn("_has", F.expr(f"struct({', '.join([*tests, odd])})"))


def _run_steps(df: DataFrame, col: str, steps) -> DataFrame:
    """Apply the steps in order as one select; each refers to the result of the one before."""
    known = "_has" in df.columns
    df = _flag(df, col)
    others = [c for c in df.columns if c != col]
    results, source = [], col
    for i, (literals, step) in enumerate(steps):
        present = " OR ".join(["_has.odd"] + [f"_has.t{_LITERALS.index(x)}" for x in literals])
        results.append(F.expr(f"CASE WHEN {present} THEN {step(source)} ELSE {source} END").alias(f"_step{i}"))
        source = f"_step{i}"
    df = df.select(*others, col, *results).select(*others, F.col(source).alias(col))
    return df if known else df.drop("_has")


def strip_noise(df: DataFrame, col: str = "html") -> DataFrame:
    """Drop navigation, scripts, comments and forms with their content."""
    return _run_steps(df, col, _NOISE_STEPS)


def pick_main(df: DataFrame, col: str = "html") -> DataFrame:
    """Keep the longest match of the first main-content pattern that occurs, if it is long enough."""

    def candidates(pattern: str, closing: str) -> Column:
        return longest(F.regexp_extract_all(F.expr(_head(closing, col)), F.lit(rx(pattern, "is")), F.lit(1)))

    picked = F.coalesce(*[candidates(p, c) for p, c in vocab.MAIN_CONTENT])
    df = df.withColumn("_main", picked)
    return df.withColumn(
        col, F.when(F.length("_main") > vocab.MAIN_CONTENT_MIN, F.col("_main")).otherwise(F.col(col))
    ).drop("_main")


def mark_blocks(df: DataFrame, col: str = "html") -> DataFrame:
    """Headings, list items, paragraphs and line breaks as line structure."""
    return _run_steps(df, col, _BLOCK_STEPS)


def drop_code(df: DataFrame, col: str = "html") -> DataFrame:
    return _run_steps(df, col, _CODE_STEPS)


def strip_tags(df: DataFrame, col: str = "html") -> DataFrame:
    return df.withColumn(col, F.expr(_replace_up_to(col, ">", "<[^>]+>", " ")))


def decode_entities(df: DataFrame, col: str = "html") -> DataFrame:
    text = F.col(col)
    for entity, char in vocab.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return df.withColumn(col, text)


# Lower-cased literals of which one is part of every match, where the pattern starts with none.
_BOILERPLATE_NEEDLES = {
    r"(?:Toggle|Open|Close) (?:navigation|menu)": [" navigation", " menu"],
    r"(?:Share|Like|Tweet|Pin) (?:this|on)": ["share ", "like ", "tweet ", "pin "],
    r"\d+ premium supporters?": [" premium supporter"],
}


def _needles(pattern: str) -> list[str]:
    if pattern in _BOILERPLATE_NEEDLES:
        return _BOILERPLATE_NEEDLES[pattern]
    # the leading literal text, up to the first operator or the character it makes optional
    return [re.match(r"(?:[A-Za-z -](?![?*]))+", pattern).group().lower()]


def drop_boilerplate(df: DataFrame, col: str = "html") -> DataFrame:
    """Delete the boilerplate phrases; texts that cannot hold any are passed on after substring tests."""
    text = F.col(col)
    needles = sorted({needle for pattern in vocab.BOILERPLATE for needle in _needles(pattern)})
    possible = F.expr(may_hold(col, needles))
    cleaned = reduce(lambda t, pattern: F.regexp_replace(t, rx(pattern, "i"), ""), vocab.BOILERPLATE, text)
    return df.withColumn(col, F.when(possible, cleaned).otherwise(text))


def format_recipe_lines(df: DataFrame, lines: str = "lines") -> DataFrame:
    """Bullets on measure lines and numbering on step lines of an array of stripped lines.

    The ingredients part starts at the first measure line unless a step line comes first; it ends
    where the steps part starts: at the first step line after it. The steps part never ends.
    """
    measure, step = rx(vocab.MEASURE_LINE, "i"), rx(vocab.STEP_LINE, "i")
    never = F.lit(2**31 - 1)

    def first_true(flags: Column) -> Column:
        at = F.array_position(flags, True)
        return F.when(at > 0, at - 1).otherwise(never)

    df = df.withColumn("_measure", F.transform(lines, lambda x: x.rlike(measure))).withColumn(
        "_step", F.transform(lines, lambda x: x.rlike(step))
    )
    df = df.withColumn("_m1", first_true(F.col("_measure"))).withColumn("_s1", first_true(F.col("_step")))
    after_m1 = F.array_position(F.slice("_step", (F.col("_m1") + 2).cast("int"), F.size("_step")), True)
    df = df.withColumn(
        "_steps_from",
        F.when(F.col("_s1") < F.col("_m1"), F.col("_s1"))
        .when(F.col("_m1") == never, never)
        .when(after_m1 > 0, F.col("_m1") + after_m1)
        .otherwise(never),
    )

    def rewrite(line: Column, i: Column) -> Column:
        is_measure, is_step = F.get("_measure", i), F.get("_step", i)
        bullet = (i >= F.col("_m1")) & (i < F.col("_steps_from")) & is_measure & ~line.startswith("-")
        number = (i >= F.col("_steps_from")) & is_step
        return F.when(bullet, F.concat(F.lit("- "), line)).when(
            number, F.regexp_replace(line, rx(r"^(\d+)\.?\s*"), "$1. ")
        ).otherwise(line)

    untouched = (F.col("_m1") == never) & (F.col("_s1") == never)
    return df.withColumn(
        lines, F.when(untouched, F.col(lines)).otherwise(F.transform(lines, rewrite))
    ).drop("_measure", "_step", "_m1", "_s1", "_steps_from")


def clean_lines(df: DataFrame, lines: str = "lines", out: str = "text", limit: int | None = None) -> DataFrame:
    """Drop lines under three characters and one-word lines that are no list item; cut after ``limit`` characters if it is given."""
    kept = F.filter(lines, lambda x: (F.length(x) >= 3) & (x.startswith("-") | x.rlike(BLANK)))
    text = F.array_join(kept, "\n")
    return df.withColumn(out, text if limit is None else F.substring(text, 1, limit))


def extract_text(pages: DataFrame, clean_code: bool = False, col: str = "html", out: str = "text", limit: int | None = None) -> DataFrame:
    """Replace the html column by the clean main text. A NULL html gives a NULL text."""
    df = mark_blocks(pick_main(strip_noise(_flag(pages, col), col), col), col)
    if clean_code:
        df = drop_code(df, col)
    df = df.drop("_has")
    df = drop_boilerplate(decode_entities(strip_tags(df, col), col), col)
    # runs of spaces may be collapsed before the lines are formatted: no line rule depends on them
    df = df.withColumn("_lines", filled_lines(F.regexp_replace(col, " {2,}", " "))).drop(col)
    return fence(clean_lines(format_recipe_lines(df, "_lines"), "_lines", out, limit).drop("_lines"), out)


def recipe_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the recipe formatting: the stripped, non-blank lines of a text, rewritten."""
    df = format_recipe_lines(df.withColumn("_lines", filled_lines(F.col(text))), "_lines")
    return fence(df.withColumn(text, F.array_join("_lines", "\n")).drop("_lines"), text)


def with_extraction_error(df: DataFrame, text: str = "text") -> DataFrame:
    """``error`` for texts that are missing or too short to be content."""
    short = F.col(text).isNull() | (F.length(text) < vocab.MIN_EXTRACTED)
    return df.withColumn("error", F.when(short, vocab.NO_CONTENT))
