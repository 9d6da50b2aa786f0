"""Regular expressions and string helpers with Python string semantics, as Spark columns.

Spark runs Java regular expressions, whose ``\\s \\w \\d \\b`` are ASCII and whose ``.`` and ``$``
know more line ends than a newline. :func:`rx` spells those tokens out.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# str.isspace(); the property class is several times faster than a list of ranges
BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]"
NOT_BLANK = r"[^\p{IsWhite_Space}\x1c-\x1f]"
BLANK_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WORD = r"[\p{L}\p{N}_]"

_TOKENS = ((r"[\s\S]", "[\\x{0}-\\x{10ffff}]"), (r"\s", BLANK), (r"\w", WORD), (r"\d", r"\p{Nd}"))


def rx(pattern: str, flags: str = "") -> str:
    """Java form of a Python pattern. ``i`` folds Unicode case; ``s`` lets the dot match newlines."""
    for token, spelled in _TOKENS:
        pattern = pattern.replace(token, spelled)
    if "i" not in flags:
        return f"(?d{flags}){pattern}"
    # a leading "<" has no case: matched as it is, the search skips other characters faster
    lead = "<" if pattern.startswith("<") else ""
    return f"(?d{flags.replace('i', '')}){lead}(?iu){pattern[len(lead):]}"


def phrase_rx(phrases: list[str]) -> str:
    """Search for any of the phrases between word edges."""
    # a word edge before a non-word character means that a word character precedes it
    edged = [(f"(?<={WORD})" if p.startswith("\\$") else f"(?<!{WORD})") + p for p in phrases]
    return rx(f"(?:{'|'.join(edged)})(?!{WORD})")


def _key_word(phrase: str) -> str:
    """The longest plain word of a phrase; empty when it has none."""
    return max(re.findall(r"\w+", re.sub(r"\\[d$]\+?", " ", phrase)), key=len, default="")


def key_words(alternatives: str) -> list[str]:
    """One word of every alternative, without which it cannot occur."""
    return [w for w in map(_key_word, alternatives.split("|")) if w]


def const_array(items) -> Column:
    """Array of constants; folded to a literal by the optimizer."""
    return F.split(F.lit("|".join(items)), r"\|")


def any_phrase(lowered: Column, tokens: Column, alternatives: str) -> Column:
    """True when any alternative occurs between word edges in the lower-cased text.

    ``tokens`` are the word tokens of the text, at least those among the key words. A single word
    is found there; longer phrases are searched for in the text only where a key word is present.
    """
    phrases = alternatives.split("|")
    single = [p for p in phrases if re.fullmatch(r"\w+", p)]
    longer = [p for p in phrases if p not in single]
    hit = F.arrays_overlap(tokens, const_array(single)) if single else F.lit(False)
    if longer:
        possible = F.arrays_overlap(tokens, const_array(key_words("|".join(longer))))
        if any(not _key_word(p) for p in longer):
            possible = possible | lowered.contains("$")
        hit = hit | (possible & lowered.rlike(phrase_rx(longer)))
    return hit


def quote(literal: str) -> str:
    """Java pattern that matches ``literal`` itself."""
    return "\\Q" + literal + "\\E"


def strip(text: Column) -> Column:
    """``str.strip()``: drop blanks of any kind at both ends."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def words(text: Column) -> Column:
    """``str.split()``: the runs of non-blank characters."""
    stripped = strip(text)
    none = F.array().cast("array<string>")
    return F.when(stripped == "", none).otherwise(F.split(stripped, f"{BLANK}+"))


def word_tokens(distinct_words: Column) -> Column:
    """The runs of word characters inside an array of words."""
    joined = F.array_join(distinct_words, " ")
    return F.split(F.regexp_replace(joined, r"[^\p{L}\p{N}_ ]", " "), " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_BLANK}+"))


def filled_lines(text: Column) -> Column:
    """Stripped lines of ``text`` without the empty ones; an empty array when there is none."""
    return F.array_remove(F.transform(F.split(text, "\n"), strip), "")


# Characters that fold to i, k or s without being lower-cased to one.
ODD_FOLDS = "\u0130\u0131\u212a\u017f"


def may_hold(col: str, literals) -> str:
    """SQL test that is true wherever a case-ignoring search of a lower-cased literal can match.

    Substring tests are many times faster than one pattern with all the literals.
    """
    tests = [f"contains(lower({col}), '{x}')" for x in literals] + [f"contains({col}, '{c}')" for c in ODD_FOLDS]
    return "(" + " OR ".join(tests) + ")"


def contains_any(text: Column, needles) -> Column:
    """True when any literal occurs in ``text``: one pass with a single alternation."""
    needles = list(needles)
    if not needles:
        return F.lit(False)
    return text.rlike("|".join(quote(n) for n in needles))


def count_hits(text: Column, needles) -> Column:
    """How many of the literals occur in ``text`` at least once."""
    return F.size(F.filter(const_array(needles), lambda needle: text.contains(needle)))


def count_matches(text: Column, patterns) -> Column:
    """How many of the (Java) patterns are found in ``text``."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + text.rlike(pattern).cast("int")
    return total


def occurrences(text: Column, char: str) -> Column:
    """Number of occurrences of one character."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def longest(items: Column) -> Column:
    """Longest string of an array, the first one on ties; NULL when the array is empty."""
    sized = F.transform(items, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("text")))
    return F.array_max(sized)["text"]


def without_broken_bytes(text: Column) -> Column:
    """Text without bytes that are no UTF-8. Valid text stays as it is, replacement characters of its own included."""
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
