"""Near-duplicate forest, archives, line alignment and suffix arrays against brute force."""

import hashlib
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsift.llm import decontaminate, forest, graph, lines, suffixes, warc
from loomsift.llm.common import file_system, shared_files

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, row int, component string, node string"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in zip(ids, texts)], DOC)


EDGE = [None, "", " ", "a", "A", "\n\n", "ñ " * 20_000, "x" * 5000, "😀 ok"]


def reachable(count, linked):
    root = list(range(count))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(count)]


# 5 ----------------------------------------------------------------------------------------------------------------------


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def plain_classes(texts):
    sets = [plain_set(t) for t in texts]
    linked = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, reachable(len(sets), linked)


def near_copies(rng, count):
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(count):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 4])):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("limit", [10_000, 1])
def test_near_groups_equal_brute_force(spark, limit):
    texts = near_copies(random.Random(8), 30 if limit > 1 else 12) + EDGE
    sets, root = plain_classes(texts)
    rows = forest.near_groups(docs_of(spark, texts).repartition(3), region_nodes=limit).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == len(texts)
    assert got == {k: (len(sets[k]), root[k], root[k] == k) for k in range(len(texts))}


def template_texts(rng, families, size):
    """Texts of a common template; each family has words of its own, so that links are inside families only."""
    vocabulary = [f"w{k}" for k in range(900)]
    template = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(families):
        base = template + [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(60, 120)] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("run", [2, 5, forest.RUN])
def test_crowded_prefixes_equal_brute_force(spark, run):
    texts = template_texts(random.Random(14), 25, 4) + [f"a b c d e f g h i j k l m n o p q r s t u v w x y z {k}" for k in range(30)]
    sets, root = plain_classes(texts)
    rows = forest.near_groups(docs_of(spark, texts).repartition(3), run=run).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(root))
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {k: len(s) for k, s in enumerate(sets)}


def region_texts(rng, families, size):
    """Texts of a region: families of near copies, not similar to each other, with most words from one template."""
    vocabulary = [f"w{k}" for k in range(900)]
    template = [rng.choice(vocabulary) for _ in range(100)]
    texts = []
    for k in range(families):
        base = template + [rng.choice(vocabulary) for _ in range(24)]
        for _ in range(size * (1 + 3 * (k == 1))):
            own = list(base)
            own[rng.randrange(100, 124)] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def test_near_groups_in_large_regions_equal_brute_force(spark):
    texts = region_texts(random.Random(4), 6, 5) + ["alone " * 9, ""]
    _, root = plain_classes(texts)
    assert 6 < len(set(root)) < 20
    rows = forest.near_groups(docs_of(spark, texts).repartition(3), region_shingles=200).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(root))


def test_first_of_each_group_in_large_regions(spark):
    texts = region_texts(random.Random(5), 4, 4)
    _, root = plain_classes(texts)
    docs = docs_of(spark, texts).repartition(3).withColumn("lang", F.lit("en"))
    kept = forest.first_of_each_group(docs, region_nodes=1)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in kept.collect()) == [(k, texts[k], "en") for k in sorted(set(root))]


@pytest.mark.parametrize("at_once, share_nodes, leader_shingles", [(16, 1000, 1 << 40), (64, 5, 600)])
def test_large_links_in_rounds_equal_brute_force(spark, at_once, share_nodes, leader_shingles):
    rng = random.Random(6)
    parts = [region_texts(rng, 3, 3), region_texts(rng, 2, 2), [f"a b c d e f g h i {k}" for k in range(5)]]
    texts, regions = [t for part in parts for t in part], [k for k, part in enumerate(parts) for _ in part]
    sets, root = plain_classes(texts)
    rows = spark.createDataFrame([(r, k, t) for k, (r, t) in enumerate(zip(regions, texts))], "region bigint, node bigint, text string").repartition(3)
    sizes = rows.groupBy("region").agg(F.count("*").alias("nodes"), F.lit(30).alias("shingles"))
    links = forest._large_links(rows, sizes, at_once, share_nodes, 10, leader_shingles).collect()
    assert reachable(len(texts), [(r["u"], r["v"]) for r in links]) == root
    assert all(r["v"] == root[r["u"]] for r in links)


def test_leaders_stay_over_batches():
    import pyarrow as pa

    rng = random.Random(7)
    rows = []
    for region, salt in ((1, 0), (1, 1), (2, 0)):
        rows += [(region, salt, 0, k, k, list(range(10 * k, 10 * k + 12))) for k in (1, 2)]
        rows += [(region, salt, 1, 10 * k + c, c, sorted(rng.sample(range(10 * k, 10 * k + 12), 11))) for k in (1, 2) for c in (1, 2, 3 + salt, 5)]
    names = ["region", "salt", "member", "node", "component", "numbers"]
    table = pa.RecordBatch.from_pylist([dict(zip(names, (*r[:5], np.array(r[5], "<u8").tobytes()))) for r in rows])
    for size in (1, 4, 50):
        found = [b for k in range(0, len(rows), size) for b in [table.slice(k, size)]]
        links = {(u, v) for out in forest._against(iter(found)) for u, v in zip(*[c.to_pylist() for c in out.columns])}
        assert links == {(1, 2), (2, 1), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5)}


def test_alike_rows_equal_brute_force():
    rng = np.random.default_rng(4)
    for n in [*range(1, 12), 60]:
        base = rng.integers(0, 256, (4, forest.VALUES), dtype=np.uint8)
        rows = base[rng.integers(0, 4, n)]
        rows = np.where(rng.random(rows.shape) < 0.3, rng.integers(0, 256, rows.shape, dtype=np.uint8), rows)
        linked = [(a, b) for a in range(n) for b in range(a) if (rows[a] == rows[b]).sum() >= forest.ALIKE]
        assert forest._alike(rows).tolist() == reachable(n, linked)


def test_runs_are_held_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 3, 9 * forest.RUN))
    sketch = np.repeat(rng.integers(0, 256, (len(keys), 1), dtype=np.uint8) % 5, forest.VALUES, axis=1)
    names = ["tree", "key", "part", "node", "sketch"]
    columns = [
        pa.array(np.zeros(len(keys), np.int32)), pa.array([b"%d" % k for k in keys]), pa.array(np.zeros(len(keys), np.int32)),
        pa.array(np.arange(len(keys))), pa.array([s.tobytes() for s in sketch]),
    ]
    rows = pa.RecordBatch.from_arrays(columns, names=names)
    cuts = [rows.slice(k, 700) for k in range(0, len(keys), 700)] + [rows.slice(0, 0)]
    links = [(a, b) for out in forest._neighbours(iter(cuts)) for a, b in zip(*[c.to_pylist() for c in out.columns])]
    root = reachable(len(keys), links)
    assert len({(k, s[0], r) for k, s, r in zip(keys, sketch, root)}) == len({(k, s[0]) for k, s in zip(keys, sketch)}) == len(set(root))
    assert list(forest._neighbours(iter([]))) == []


def test_near_groups_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    sets, root = plain_classes([texts[i] for i in ids])
    rows = {r["doc_id"]: r for r in forest.near_groups(docs).collect()}
    assert {i: rows[i]["component_id"] for i in ids} == {i: ids[root[k]] for k, i in enumerate(ids)}
    assert all(rows[i]["n_shingles"] == len(sets[k]) for k, i in enumerate(ids))


def test_near_groups_with_repeated_and_null_ids(spark):
    text = "one two three four five six"
    rows = forest.near_groups(docs_of(spark, [text, text, text, "other"], [4, 4, None, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (-1, 4, False), (4, 4, False), (4, 4, True)]
    assert forest.near_groups(docs_of(spark, [])).count() == 0


def test_classes_of_sets():
    rng = random.Random(2)
    for _ in range(60):
        sets = [np.unique(np.array(rng.sample(range(14), rng.randrange(1, 12)), np.uint64)) for _ in range(rng.randrange(1, 14))]
        linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
        assert forest.classes(sets) == reachable(len(sets), linked)


def test_classes_of_a_template_take_no_pairwise_time():
    import time

    rng = np.random.default_rng(3)
    template = rng.integers(0, 1 << 60, 150, dtype=np.uint64)
    sets = [np.unique(np.concatenate((template, rng.integers(0, 1 << 60, 100, dtype=np.uint64)))) for _ in range(3000)]
    begin = time.process_time()
    assert forest.classes([*sets, sets[7], sets[9][:240]]) == [*range(3000), 7, 9]
    assert time.process_time() - begin < 5


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    root = reachable(150, pairs)
    assert got == {k: root[k] for k in {x for p in pairs if p[0] != p[1] for x in p}}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# 7 ----------------------------------------------------------------------------------------------------------------------


def test_loser_tree():
    rng = random.Random(1)
    for runs in range(1, 12):
        lists = [sorted(rng.randrange(30) for _ in range(rng.randrange(9))) for _ in range(runs)]
        assert list(warc.LoserTree([iter(x) for x in lists])) == sorted(x for y in lists for x in y)
    assert list(warc.LoserTree([])) == []


def test_archives_round_trip(spark):
    html = ["<p>a</p>", None, "<p>a</p>", "", "é\r\n\r\nWARC/1.1\r\n" * 3, "<p>a</p>", "z" * 200_000]
    urls = ["http://b.org/x", None, "http://a.org/", "HTTP://A.org/Q?b=1", "not a url\n x: y", "http://[bad", "http://a.org/"]
    pages = spark.createDataFrame([(10 - k, u, h, "x") for k, (u, h) in enumerate(zip(urls, html))] + [(None, "u", "h", "x")], "page_id bigint, url string, html string, file string")
    rows = warc.archive_pages(pages.repartition(3), archive_bytes=300).collect()
    by = {r["page_id"]: r for r in rows}
    assert len(rows) == len(html)
    for k, h in enumerate(html):
        payload, same = (h or "").encode(), [10 - j for j, x in enumerate(html) if (x or "") == (h or "")]
        r = by[10 - k]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), warc.payload_digest(payload))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if min(same) == 10 - k else ("revisit", min(same)))
    order = [(r["url_key"], r["ts"], r["page_id"]) for r in sorted(rows, key=lambda r: (r["range_no"], r["place"]))]
    assert order == sorted(order)
    r = by[6]
    system, path = file_system(r["file"])
    with system.open_input_file(path) as f:
        raw = f.read_at(r["size"], r["offset"])
    ((_, _, headers, block),) = warc.records_of(iter([raw]))
    assert block.decode() == html[4] and headers["WARC-Type"] == "response"
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_with_repeated_and_null_ids(spark):
    given = [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "c"), (4, "d"), (4, "d"), (4, "c"), (None, "e"), (None, "e"), (None, "d")]
    given += [(5, "f"), (5, "f"), (5, "f"), (6, "f"), (7, "")]
    pages = spark.createDataFrame([(i, "http://a.org/", h) for i, h in given], "page_id bigint, url string, html string")
    want = [(i, h, None) for i, h in given if (i, h) in {(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "e"), (7, "")}] + [(5, "f", None), (5, "f", 5), (5, "f", 5), (6, "f", 5)]
    want += [(2, "a", 1), (4, "c", 3), (4, "c", 3), (4, "d", 3), (4, "d", 3), (None, "d", 3)]
    names = {warc.payload_digest(h.encode()): h for h in [*"abcdef", ""]}
    for parts in (1, 3):
        rows = warc.archive_pages(pages.repartition(parts), archive_bytes=300, unnamed=True).collect()
        got = [(r["page_id"], names[r["payload_digest"]], r["refers_to"]) for r in rows]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert all((r["record_type"] == "response") == (r["refers_to"] is None) and r["payload_bytes"] == (r["page_id"] != 7) for r in rows)
        assert len({(r["file"], r["offset"]) for r in rows}) == len(given)
        order = [(r["ts"], r["page_id"] is None, r["page_id"] or 0) for r in sorted(rows, key=lambda r: (r["range_no"], r["place"]))]
        assert order == sorted(order)
        read, responses, referred = set(), set(), set()
        for r in rows:
            system, path = file_system(r["file"])
            with system.open_input_file(path) as f:
                ((_, _, headers, _),) = warc.records_of(iter([f.read_at(r["size"], r["offset"])]))
            read.add(headers["WARC-Record-ID"])
            responses |= {headers["WARC-Record-ID"]} if r["record_type"] == "response" else set()
            referred |= {headers["WARC-Refers-To"]} if r["refers_to"] is not None else set()
        assert len(read) == len(given) and referred <= responses


def test_histories_are_in_order_with_many_runs(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/same", f"{k % 50}") for k in range(400)], "page_id bigint, url string, html string")
    archives = warc.write_archives(warc.plan_captures(pages), shared_files(spark, "warc"), archive_bytes=2000)
    for options, least in (({"ranges": 5, "run_rows": 1}, 2), ({"range_rows": 15}, 12)):
        rows = warc.capture_histories(archives, fan_in=2, **options).collect()
        order = [(r["url_key"], r["ts"], r["page_id"]) for r in sorted(rows, key=lambda r: (r["range_no"], r["place"]))]
        assert len(order) == 400 and order == sorted(order) and len({r["range_no"] for r in rows}) >= least
        assert sum(r["record_type"] == "revisit" for r in rows) == 350


# 9 ----------------------------------------------------------------------------------------------------------------------


def test_patience_aligns_equal_lines():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        points = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(8)})
        points = [p for k, p in enumerate(points) if all(p[0] != q[0] and p[1] != q[1] for q in points[:k])]
        best = {}
        for p in points:
            best[p] = 1 + max((best[q] for q in best if q[1] < p[1]), default=0)
        chain = lines._longest(points)
        assert len(chain) == max(best.values()) and all(p[1] < q[1] for p, q in zip(chain, chain[1:]))
    assert lines.patience([1, 2, 3, 2, 4], [9, 2, 3, 4]) == [(1, 1), (2, 2), (4, 3)]
    assert lines.patience([1, 0, 2], [3, 0, 4]) == []  # blank lines alone are no anchor


def test_common_blocks_equal_another_alignment():
    import difflib

    rng = random.Random(21)
    for _ in range(200):
        fresh = iter(range(1, 10_000))
        shared = [[next(fresh) if rng.random() < 0.9 else 0 for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(4))]
        shared = [[next(fresh), *block, next(fresh)] for block in shared]
        later, earlier = ([x for block in [*shared, []] for x in [*(next(fresh) for _ in range(rng.randrange(1, 5))), *block]] for _ in range(2))
        sizes = [rng.randrange(1, 30) if x else 0 for x in later]
        blocks = difflib.SequenceMatcher(None, later, earlier, autojunk=False).get_matching_blocks()
        want = [(m.a, m.a + m.size) for m in blocks if m.size and sum(sizes[m.a : m.a + m.size]) >= 40]
        assert lines.common_blocks(later, earlier, sizes, 40) == want


def test_patience_without_unique_lines():
    assert lines.patience([1, 9, 2, 9, 3], [4, 9, 5]) == [(1, 1)]
    assert lines.patience([4, 9, 5], [1, 9, 2, 9, 3]) == [(1, 1)]
    # both lines of a block stay together
    assert lines.patience([1, 8, 9, 2, 8, 0, 9, 3], [4, 8, 9, 5]) == [(1, 1), (2, 2)]
    assert lines.patience([1, 8, 2, 8, 9, 3, 9], [4, 8, 9, 5, 8, 9, 6]) == [(3, 1), (4, 2), (6, 5)]
    assert lines.patience([1, 7, 7, 2, 9, 4, 9], [3, 9, 5, 7, 7, 6], [1, 2, 2, 1, 50, 1, 50]) == [(4, 1)]
    assert lines.common_blocks([1, 9, 2, 9, 3], [4, 9, 5], [50] * 5, 40) == [(1, 2)]
    rng = random.Random(10)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        sizes = [rng.randrange(1, 9) * (x > 0) for x in a]
        blocks = [(sum(sizes[i : i + n]), -i, -j, n) for i in range(len(a)) for j in range(len(b)) for n in range(1, 12) if a[i : i + n] == b[j : j + n] and i + n <= len(a) and j + n <= len(b)]
        most = max(blocks, default=(0,))[0]
        got = lines._longest_block(a, b, 0, len(a), 0, len(b), sizes)
        if got is None:
            assert most == 0
        else:
            i, j, n = got
            assert a[i : i + n] == b[j : j + n] and sum(sizes[i : i + n]) == most


def test_periodic_lines_take_linear_time():
    import time

    a, b = [1 + k % 3 for k in range(20_000)], [(1, 2, 4)[k % 3] for k in range(20_000)]
    start = time.perf_counter()
    pairs = lines.patience(a, b)
    assert time.perf_counter() - start < 10 and len(pairs) > 13_000
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_different_long_lines_stay(spark):
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    mirror = word.translate(str.maketrans("ab", "ba"))
    rows = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs_of(spark, [word, mirror, word])).collect()}
    assert [rows[k]["text"] for k in range(3)] == [word, mirror, ""]
    near = {r["doc_id"]: r["component_id"] for r in forest.near_groups(docs_of(spark, [f"a b c d {word}", f"a b c d {mirror}"])).collect()}
    assert near == {0: 0, 1: 1}
    item = spark.createDataFrame([(1, " ".join([word, *"bcdefghij"]))], "item_id bigint, text string")
    hit = decontaminate.contamination(docs_of(spark, [" ".join([mirror, *"bcdefghij"]), " ".join([word, *"bcdefghij"])]), item)
    assert {r["doc_id"]: r["contaminated"] for r in hit.collect()} == {0: False, 1: True}


def test_repeated_lines_go_from_later_documents(spark):
    first = "\n".join(f"line number {k} of the first document here" for k in range(6))
    texts = [
        first,
        "own start\n" + first.split("\n")[2] + "\n" + first.split("\n")[3] + " \nown end",
        "own start\nshort\nlast",
        first,
        *EDGE,
    ]
    for parts in (1, 3):
        rows = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs_of(spark, texts).repartition(parts)).collect()}
        assert len(rows) == len(texts)
        assert rows[0]["text"] == first and rows[1]["text"] == "own start\nown end" and rows[1]["n_removed"] == 2
        assert rows[2]["text"] == texts[2] and rows[3]["text"] == "" and rows[3]["n_removed"] == 6
        assert all(rows[k]["text"] == (texts[k] or "") for k in range(4, len(texts)))
    assert lines.drop_repeated_lines(docs_of(spark, [])).count() == 0


def test_lines_equal_brute_force(spark):
    rng = random.Random(12)
    pool = [f"sentence {k} " + "x" * rng.randrange(40) for k in range(40)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(50)]
    rare = 6
    owner, df = {}, {}
    for k, t in enumerate(texts):
        for line in {x.strip() for x in t.split("\n")} - {""}:
            owner.setdefault(line, k)
            df[line] = df.get(line, 0) + 1
    want = {}
    for k, t in enumerate(texts):
        own = [x.strip() for x in t.split("\n")]
        shared = {x for x in own if x and owner[x] < k}
        bound = max([rare, *([min(df[x] for x in shared)] if shared else [])])
        gone = set()
        for o in {owner[x] for x in shared if df[x] <= bound}:
            names = {x: n for n, x in enumerate({"", *own, *(y.strip() for y in texts[o].split("\n"))} - {""}, 1)} | {"": 0}
            later, earlier = [names[x] for x in own], [names[x.strip()] for x in texts[o].split("\n")]
            for a, b in lines.common_blocks(later, earlier, [len(x) for x in own], 40):
                gone |= set(range(a, b))
        want[k] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone) if gone else t
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs_of(spark, texts), rare=rare).collect()}
    assert got == want


def test_common_lines_go_beside_rare_ones(spark):
    common, rare = "a line of a licence that is in every document here", "a line that is in two of the documents only, no more"
    texts = [f"{common}\nown 0", f"{rare}\nown 1", *[f"own {k}\n{common}\nend {k}" for k in range(2, 30)], f"{rare}\nown 30\n{common}\nend 30"]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs_of(spark, texts)).collect()}
    assert got == {0: texts[0], 1: texts[1], **{k: f"own {k}\nend {k}" for k in range(2, 31)}}


def test_lines_equal_brute_force_over_all_owners(spark):
    rng = random.Random(13)
    pool = [f"sentence {k} " + "x" * rng.randrange(60) for k in range(40)]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.7 else pool[0] for _ in range(rng.randrange(9))) for _ in range(60)]
    owner, want = {}, {}
    for k, t in enumerate(texts):
        own, gone = t.split("\n"), set()
        for o in {owner[x] for x in own if x in owner}:
            names = {x: n for n, x in enumerate({*own, *texts[o].split("\n")} - {""}, 1)} | {"": 0}
            for a, b in lines.common_blocks([names[x] for x in own], [names[x] for x in texts[o].split("\n")], [len(x) for x in own], 40):
                gone |= set(range(a, b))
        for x in set(own) - {""}:
            owner.setdefault(x, k)
        want[k] = "\n".join(x for n, x in enumerate(own) if n not in gone) if gone else t
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs_of(spark, texts)).collect()}
    assert got == want


# 10 ---------------------------------------------------------------------------------------------------------------------


def plain_repeats(raws, width):
    seen, masks = set(), []
    for raw in raws:
        mask = np.zeros(len(raw), bool)
        for p in range(len(raw) - width + 1):
            if raw[p : p + width] in seen:
                mask[p : p + width] = True
            seen.add(raw[p : p + width])
        masks.append(mask)
    return masks


def test_suffix_array_and_prefixes():
    rng = random.Random(4)
    for _ in range(400):
        size = rng.choice([2, 3, 6])
        text = [rng.randrange(size) for _ in range(rng.randrange(50))]
        array = suffixes.suffix_array(np.array(text, np.int64), size).tolist()
        assert array == sorted(range(len(text)), key=lambda k: text[k:])
        if text:
            prefixes = suffixes.permuted_prefixes(text, np.array(array), 7)
            for a, b in zip(array, array[1:]):
                common = next((k for k in range(len(text)) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), len(text))
                assert prefixes[b] == min(7, common)


def test_suffix_array_and_prefixes_of_runs_and_passages():
    rng = random.Random(5)
    texts = [[3] * 700, [k % 2 for k in range(501)], [0] * 40 + [4] * 300 + [0] * 300, [rng.randrange(70_000) for _ in range(400)]]
    for _ in range(12):
        pool = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))] for _ in range(3)]
        texts.append(sum((rng.choice(pool) + [0] * rng.randrange(2) for _ in range(30)), []))
    for text in texts:
        array = suffixes.suffix_array(np.array(text, np.int64), max(text) + 1).tolist()
        assert array == sorted(range(len(text)), key=lambda k: text[k:])
        for limit in (1, 5, 100):
            prefixes = suffixes.permuted_prefixes(text, np.array(array), limit)
            for a, b in zip(array, array[1:]):
                common = next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), len(text) - max(a, b))
                assert prefixes[b] == min(limit, common)


def test_shards_are_sorted_by_arrays_not_byte_by_byte():
    rng = random.Random(6)
    passages = [bytes(rng.choice(b"etaoin shrdlu") for _ in range(160)) for _ in range(200)]
    shard = []
    for row in range(600):
        at = rng.randrange(40)
        shard.append((row, 0, bytes(rng.choice(b"xyz") for _ in range(at)) + rng.choice(passages)[at:]))
    executed = 0

    def count(frame, event, arg):
        nonlocal executed
        executed += event == "line"
        return count if frame.f_code.co_filename == suffixes.__file__ else None

    before = sys.gettrace()
    sys.settrace(count)
    try:
        spans = suffixes.repeated_in(shard)
    finally:
        sys.settrace(before)
    size = sum(len(raw) for _, _, raw in shard)
    assert executed < size  # lines of Python; by lists it was several a byte
    masks = plain_repeats([raw for _, _, raw in shard], suffixes.WIDTH)
    got = [np.zeros(len(raw), bool) for _, _, raw in shard]
    for row, start, length in spans.tolist():
        got[row][start : start + length] = True
    assert all((a == b).all() for a, b in zip(got, masks))


def test_contexts_are_the_same_in_blocks_of_any_size(monkeypatch):
    rng = random.Random(8)
    raws = [bytes(rng.choice(b"ab ") for _ in range(rng.choice([0, 3, 39, 40, 41, 90, 400]))) for _ in range(60)] + [b"", b"a" * 300, b""]
    rows, begins = list(range(len(raws))), [0] * len(raws)
    want = suffixes.contexts_of(rows, raws, begins, 40, 16)
    seen = np.zeros((len(raws), 500), int)
    for _, _, row, start, size in want.tolist():
        seen[row, start : start + size - 39] += 1
    assert all((seen[k] == (np.arange(500) + 40 <= len(raw))).all() for k, raw in enumerate(raws))
    for block in (1, 7, 64, 1000):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        assert (suffixes.contexts_of(rows, raws, begins, 40, 16) == want).all()


@pytest.mark.parametrize("share", [1 / 20_000, 0.0])
def test_repeats_equal_brute_force(spark, share, monkeypatch):
    rng = random.Random(7)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(5, 90))) for _ in range(14)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(7))) for _ in range(60)] + EDGE + ["aaaa" * 300]
    width, gram = 40, 16
    if share == 0.0:  # all anchors that are there more than once take the way of common ones
        monkeypatch.setattr(suffixes, "_common_grams", lambda rows, w, g, s: _every_gram(rows, w, g))
    rows = {r["doc_id"]: r for r in suffixes.remove_repeats(docs_of(spark, texts).repartition(4), width, gram, share, shard_bytes=300).collect()}
    raws = [(t or "").encode() for t in texts]
    for k, mask in enumerate(plain_repeats(raws, width)):
        kept = np.frombuffer(raws[k], np.uint8)[~mask].tobytes()
        assert (rows[k]["n_bytes"], bytes(rows[k]["kept"])) == (len(raws[k]), kept)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0])))).tolist()
        assert [tuple(s) for s in rows[k]["spans"]] == list(zip(edges[::2], edges[1::2]))


def _every_gram(rows, width, gram):
    raws = [(r["row"], r["text"].encode()) for r in rows.collect()]
    found = suffixes.contexts_of([r for r, _ in raws], [t for _, t in raws], [0] * len(raws), width, gram)
    return np.unique(found["gram"])[::2]


def test_repeats_in_pieces_of_long_texts_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 150)
    rng = random.Random(3)
    long = "".join(rng.choice("ab ") for _ in range(900))
    texts, ids = [long, long[200:700], long, "q" * 120], [5, 5, None, None]
    rows = suffixes.remove_repeats(docs_of(spark, texts, ids)).collect()
    order = sorted(range(4), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
    masks = plain_repeats([texts[k].encode() for k in order], 100)
    want = sorted((ids[k] or -1, len(texts[k]), int(m.sum())) for k, m in zip(order, masks))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_bytes"] - len(r["kept"])) for r in rows) == want
    assert suffixes.remove_repeats(docs_of(spark, [])).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


# pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as p
    from test_llm_text import brute_hits

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "piece_ids"]
    made, before = {}, docs
    for name, stage in p.STAGES:
        after = p.stored(stage(spark, before, sf), name)
        made[name] = {r["doc_id"]: r for r in after.collect()}
        if name != "piece_ids":
            assert after.columns == docs.columns
        before = after
    given = {r["doc_id"]: r for r in docs.collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
    assert bad and not bad & set(made["quality"]) and all(given[k] == r for k, r in made["quality"].items())
    own = made["line_dedup"]
    assert set(own) <= set(made["quality"]) and all(r["n_chars"] == len(r["text"]) for r in own.values())
    assert all(set(r["text"].split("\n")) <= set(made["quality"][k]["text"].split("\n")) for k, r in own.items())
    ids = sorted(own)
    _, root = plain_classes([own[i]["text"] for i in ids])
    assert set(made["near_dedup"]) == {ids[r] for r in root}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, r in made["near_dedup"].items() if not brute_hits(r["text"], items)[1]}
    assert set(made["decontamination"]) == clean and clean != set(made["near_dedup"])
    assert set(made["piece_ids"]) == clean and all(r["lossless"] for r in made["piece_ids"].values())
    back = {r["doc_id"]: r["text"] for r in p.pieces.decode(before.select("doc_id", "ids")).collect()}
    assert back == {i: made["decontamination"][i]["text"] for i in clean}


def test_pipeline_stages_with_odd_rows(spark):
    import corpus_pipeline as p

    line = "A line of more than forty characters that two documents share."
    texts = [line, f"{line}\n\n \t\n", "\n \n", None, "other words of a text", "other words of a text", f"{line}\nand one of its own"]
    ids = [1, 2, 3, 4, 5, 5, None]
    stages = dict(p.STAGES)
    left = stages["line_dedup"](spark, docs_of(spark, texts, ids), SF)
    assert left.columns == ["doc_id", "text", "row", "component", "node"]
    want = [(1, line), (3, "\n \n"), (4, ""), (5, texts[4]), (5, texts[4]), (None, "and one of its own")]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(want, key=repr)
    one = stages["near_dedup"](spark, docs_of(spark, texts, ids), SF).collect()
    assert sum(r["text"] == texts[4] for r in one) == 1 and len(one) == 5  # 2 has the words of 1
    assert stages["decontamination"](spark, docs_of(spark, texts, ids), SF).count() == len(texts)
    assert stages["piece_ids"](spark, docs_of(spark, texts, ids), SF).filter("lossless").count() == len(texts)
    for stage in stages.values():
        assert stage(spark, docs_of(spark, []), SF).count() == 0
