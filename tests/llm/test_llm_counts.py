"""Token counts against the library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomsift.llm import counts, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, n_tokens string, n_bytes int"
PATH = public_tokenizers.path(counts.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_library(library, texts):
    return [len(e.ids) for e in library.encode_batch(list(texts), add_special_tokens=False)]


def test_proved_strings_are_one_token(library):
    whole = sorted(counts.whole_tokens(PATH))
    assert len(whole) > 30_000 and {"the", "'s", "1", "!!!"} <= set(whole)
    assert set(by_library(library, whole)) == {1}
    # the proof is no guess from the vocabulary: some of its strings are not reached by merging
    for text in ("thing", "don", "it's", "zzzzz"):
        assert (text in whole) == (counts.PRE_TOKEN.fullmatch(text) is not None and by_library(library, [text]) == [1])


def test_random_strings_equal_the_library(library):
    rng = random.Random(4)
    pool = [chr(c) for c in range(1, 0x250)] + list("'''\"  \n\t\r<|>sStTreved") + ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "ß", "İ", "ﬁ", "é"]
    pool += ["中", "文", "​", "😀", "Σ", "ς", "\x1c", "\x85", " ", "́", "it", "ing"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(20_000)] + [chr(c) for c in range(1, 0x3000)]
    counter = counts.Counter(PATH, counts.whole_tokens(PATH), limit=500)  # much is forgotten on the way
    got = [n for at in range(0, len(texts), 1000) for n in counter.counts(texts[at : at + 1000])]
    assert got == by_library(library, texts)
    assert counter.direct > 1000 and counter.merged > 1000


def test_documents_equal_the_library(spark, library):
    odd = [None, "", " ", "\n\n", "It's  GOOD\nnews<|endoftext|> x", "<|ENDOFTEXT|>", "a" * 200_000, "ab " * 70_000, "日本語" * 3000, "x", "x"]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ids = [None if k == 3 else 7 if k < 3 else k for k in range(len(texts))]
    rows = counts.token_counts(spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], DOC)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    want = [(i, len((t or "").encode()), n, n > 2048) for i, t, n in zip(ids, texts, by_library(library, [t or "" for t in texts]))]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert counts.token_counts(spark.createDataFrame([], DOC)).count() == 0


def test_another_vocabulary_is_refused():
    with pytest.raises(ValueError):
        counts.whole_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark):
    assert queries.op11_token_counts(spark, SF).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
