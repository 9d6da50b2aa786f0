"""Ranked search against a plain program and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomsift.llm import oracle, queries, search

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, item_id string, score int"
ITEM = "item_id bigint, text string, doc_id int, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [None, "", " .,", "A a À à", "naïve_naïve-x1", "ab" * 3000 + " tail", "the " * 4000, "one two three", "one two three", "ONE Two three four"]


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def plain(docs, items, k=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        own = set(terms(text))
        found = []
        for doc_id, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t]
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_terms():
    texts = [*ODD[1:], "a\x80b c É é ÀB_c[d]e{f}g@h/i:j`k\x7fl", "".join(map(chr, range(1, 0x300)))]
    for text in texts:
        assert [t.decode() for t in search.terms_of(text.encode())] == terms(text)


def test_bounds_are_never_too_low():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    for trial in range(30):
        docs = [Counter(rng.choices(words[: rng.choice([5, 60])], k=rng.randrange(1, 200))) for _ in range(rng.randrange(1, 40))]
        made = [search.signature(Counter({t.encode(): n for t, n in d.items()})) for d in docs]
        log = max(s[0] for s in made)
        rows = [(d, s[1]) for d, s in zip(docs, made) if s[0] == log]
        items = search.Items([[w.encode() for w in rng.sample(words, 9)] for _ in range(7)], {w.encode(): rng.randrange(900) for w in words})
        m = np.array([rng.randrange(50, 400) for _ in rows], np.float64)
        bounds = search.upper_bounds(items, search.slices_of([s for _, s in rows], log), log, m)
        for k, scored in enumerate(items.scored):
            for d, (counts, _) in enumerate(rows):
                exact = search.exact_score(scored, Counter({t.encode(): n for t, n in counts.items()}), int(m[d]))
                assert exact <= bounds[k, d]


def test_slices_of_long_signatures():
    rows = np.random.default_rng(1).integers(0, 256, (19, 1 << 13), np.uint8)
    want = np.packbits(np.unpackbits(rows, axis=1).T, axis=1)
    assert (search.slices_of([r.tobytes() for r in rows], 16) == want).all()


@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_a_plain_program(spark, k):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choices(["one", "two", "three", "ñu", "x1", "z" * 9, *map(str, range(40))], k=rng.randrange(1, 60))) for _ in range(300)]
    texts += texts[20:40]  # copies tie
    ids = [None if n in (7, 30) else n % 290 for n in range(len(texts))]
    items = [(1, "One, two!"), (2, None), (3, "nothing-here"), (4, ""), (5, "the naïve " + "ab" * 3000), (6, "7 8 9 10 11 ñu"), (6, "three"), (None, "X1 x1")]
    got = search.rank_documents(
        spark.createDataFrame([(i, t, "a", 1) for i, t in zip(ids, texts)], DOC).repartition(5),
        spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEM), k,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert answers(got) == plain(list(zip(ids, texts)), items, k)


def test_few_documents_are_scored_exactly(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    counted = [Counter(search.terms_of((t or "").encode())) for _, t in docs]
    counted = [c for c in counted if c]
    df = Counter(t for c in counted for t in c)
    asked = [sorted(set(search.terms_of((r["text"] or "").encode()))) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    weight = {t: math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * n + 1))) for t, n in df.items()}
    items = search.Items(asked, weight)
    best, total = search.Best(items, 10), sum(sum(c.values()) for c in counted)
    for c in counted:
        log, bits = search.signature(c)
        m = 50 + 50 * sum(c.values()) * len(counted) // total
        text = b" ".join(t for t, n in c.items() for _ in range(n))
        bounds = search.upper_bounds(items, search.slices_of([bits], log), log, np.array([m], np.float64))
        best.block(bounds, [1], [m], pa.array([text], pa.binary()))
    assert best.rescored < best.seen / 4


def test_more_items_than_one_pass_takes(spark, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    monkeypatch.setattr(search, "ITEMS", 15)
    assert answers(queries.op12_ranked_search(spark, SF)) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 1)], DOC), spark.createDataFrame([(1, "a b", 1, "")], ITEM)
    assert answers(search.rank_documents(docs, items)) == plain([(1, "a b")], [(1, "a b")])
    assert search.rank_documents(docs.limit(0), items).count() == 0
    assert search.rank_documents(docs, items.limit(0)).count() == 0
    assert search.rank_documents(docs.limit(0), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({oracle.OP12})").fetchall()
    assert answers(queries.op12_ranked_search(spark, SF)) == sorted(want, key=repr)
