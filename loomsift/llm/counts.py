"""Token counts of documents with a shortcut for pre-tokens that are whole tokens.

Which strings of the vocabulary become one token when they stand alone is proved once, ahead of the job, by encoding all of
them. Such a pre-token counts one without being encoded. Only the others are merged, many distinct ones at once, and remembered.
"""

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomsift.llm.common import Memo, id_text, mapped, pieces_of

VOCABULARY = "word_bpe_49k.json"
#: The way of cutting texts that this module knows, as the file of the vocabulary has it.
SHAPE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"],
    "end": "</w>",
}


def _ranges(kind: str) -> str:
    """Latin characters of a major category as the inside of a pattern's brackets."""
    return "".join(re.escape(chr(c)) for c in range(0x21, 0x180) if unicodedata.category(chr(c))[0] == kind)


_LETTERS, _NUMBERS = _ranges("L"), _ranges("N")
# Composing changes no character below U+0180, and lower-casing makes one of them of each but the capital I with a dot. Control characters
# and odd blanks are left to the library.
LATIN = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0İƀ-\U0010ffff]*")
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t\n\r {_LETTERS}{_NUMBERS}]+")
BLANKS = re.compile("[\t\n\r ]+")
SPECIAL = "<|"


@lru_cache(maxsize=4)
def load(path: str) -> tuple[Tokenizer, np.ndarray]:
    """The tokenizer, and whether an id ends a pre-token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    shape = {
        "normalizer": [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])],
        "pattern": [p["pattern"]["Regex"] for p in told["pre_tokenizer"].get("pretokenizers", []) if "pattern" in p],
        "end": told["model"].get("end_of_word_suffix"),
    }
    if shape != SHAPE or not all(t["content"].startswith(SPECIAL) for t in told["added_tokens"]):
        raise ValueError(f"{path} cuts texts in a way that is not known here")
    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith(SHAPE["end"])
    return tokenizer, ends


def merged_counts(path: str, words: list[str], at_once: int = 1000) -> list[int]:
    """Tokens of each Latin pre-token in lower case, by the merges of the vocabulary."""
    tokenizer, ends = load(path)
    out: list[int] = []
    for at in range(0, len(words), at_once):
        part = words[at : at + at_once]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
        last = np.flatnonzero(ends[ids])
        if len(last) != len(part):
            raise ValueError("a pre-token is not one for the library")
        out += np.diff(last, prepend=-1).tolist()
    return out


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens that are proved to be one token: the strings of the vocabulary that end a word, each encoded alone."""
    tokenizer, _ = load(path)
    byte_of = {c: b for b, c in enumerate(_byte_letters())}
    found = []
    for token in tokenizer.get_vocab():
        letters = token.removesuffix(SHAPE["end"])
        if letters != token and all(c in byte_of for c in letters):
            text = bytes(byte_of[c] for c in letters).decode("utf-8", errors="replace")
            if text and LATIN.fullmatch(text) and text == text.lower() and PRE_TOKEN.fullmatch(text) and SPECIAL not in text:
                found.append(text)
    return frozenset(sys.intern(w) for w, n in zip(found, merged_counts(path, found)) if n == 1)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Counter:
    """Counts tokens of texts; ``whole`` is the proved set."""

    def __init__(self, path: str, whole: frozenset[str], limit: int = 400_000):
        self.path, self.whole = path, whole
        self.rest = Memo(lambda words: merged_counts(path, words), limit)
        self.odd = Memo(self._by_library, limit // 8)
        self.direct = self.merged = 0  # pre-tokens of each kind so far

    def _by_library(self, words: list[str]) -> list[int]:
        tokenizer, out = load(self.path)[0], []
        for at in range(0, len(words), 1000):
            out += [len(e.ids) for e in tokenizer.encode_batch_fast(words[at : at + 1000], add_special_tokens=False)]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Latin texts are cut here. Of others only the blank-free strings with other characters or special strings go through the library,
        as the vocabulary joins nothing across blanks."""
        split, odd = [], []
        for text in texts:
            strange: list[str] = []
            if SPECIAL in text or not LATIN.fullmatch(text):
                words = BLANKS.split(text)
                strange = [w for w in words if SPECIAL in w or not LATIN.fullmatch(w)]
                text = " ".join([w for w in words if SPECIAL not in w and LATIN.fullmatch(w)])
            found = PRE_TOKEN.findall(text.lower())
            rest = [w for w in found if w not in self.whole]
            split.append((len(found) - len(rest), rest))
            odd.append(strange)
        self.rest.learn([w for _, rest in split for w in rest])
        self.odd.learn([w for own in odd for w in own])
        self.direct += sum(n for n, _ in split)
        self.merged += sum(len(rest) for _, rest in split)
        look, look_odd = self.rest.__getitem__, self.odd.__getitem__
        return [n + sum(map(look, rest)) + sum(map(look_odd, own)) for (n, rest), own in zip(split, odd)]


@lru_cache(maxsize=2)
def _counter(path: str, whole: frozenset[str]) -> Counter:
    """What a worker has merged serves its later tasks too."""
    return Counter(path, whole)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row, without added tokens; special strings in a text are one token each.

    Narrow: a row in, a row out. Null texts are empty and have no tokens; a null id stays; repeated rows each count; very long texts are cut
    like others, a long string without blanks goes through the library in one piece. An empty table gives no rows. Columns other than id and text
    play no part. The proved set is bounded by the vocabulary and goes to the tasks with the function.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    whole = whole_tokens(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, whole)
        for part in pieces_of(batches, size=1 << 20):
            counts = counter.counts(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = id_text(docs).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    found = mapped(sized, count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
