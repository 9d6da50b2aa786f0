import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.operators import code
from loomsift.options import CodeOptions
from loomsift.plans import curate, datasets
from loomsift.sources import sinks, tables


def _write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


@pytest.fixture
def code_root(tmp_path):
    root = str(tmp_path / "build" / "project")  # pruned names above the root do not count
    files = {
        "src/main.PY": b"def run(a):\r\n    return 1\r\n",
        "src/node_modules/x.js": b"function skip() { return 1 }",
        "src/readme.txt": b"not a source file at all",
        "src/noext": b"nothing to see here, really",
        "src/.py": b"a hidden file without extension",
        "src/a.tar.go": b"func main() { }",
        "src/empty.py": b"",
        "src/nine.py": b"123456789",
        "src/ten.py": b"  1234567890  ",
        "src/nul.py": b"abc\x00defghijkl",
        "src/bad.py": b"caf\xe9 = 'abcdefgh'",
        "src/big.py": b"x" * 201,
        "src/fits.py": b"x" * 200,
    }
    for name, content in files.items():
        _write(os.path.join(root, name), content)
    return root


def test_scan_and_decode(spark, code_root):
    found = tables.scan_code(spark, code_root)
    decoded = {r.rel_path: r.content for r in code.decode_code(found, 200).collect()}
    assert decoded == {
        "src/main.PY": "def run(a):\n    return 1\n",
        "src/a.tar.go": "func main() { }",
        # Spark's reader does not list empty files
        "src/nine.py": None,
        "src/ten.py": "  1234567890  ",
        "src/nul.py": None,
        "src/bad.py": "caf = 'abcdefgh'",
        "src/big.py": None,
        "src/fits.py": "x" * 200,
    }
    assert [(r.length, r.content) for r in tables.scan_code(spark, code_root, 200).filter("rel_path = 'src/big.py'").collect()] == [(201, None)]


def test_files_beyond_the_reader_are_listed(spark, code_root):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "150")
    try:
        found = {r.rel_path: r.content for r in tables.scan_code(spark, "file://" + code_root).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found["src/big.py"] is None and found["src/fits.py"] is None and found["src/ten.py"] is not None


def test_code_folder_to_training_rows(spark, code_root, tmp_path):
    target = str(tmp_path / "rows")
    stats = {r.outcome: (r.files, r.chars) for r in datasets.curate_code_folder(spark, code_root, target, CodeOptions(max_size=200)).collect()}
    assert stats == {"failed": (3, 0), "skipped": (4, 0), "success": (1, 200)}
    (row,) = tables.read_jsonl(spark, target).collect()
    assert "Explain this code from File: src/fits.py" in row.text and "Language: py\nLines: 1\n\nCode:\n\nxxx" in row.text


def test_code_metadata_and_format(spark):
    text = "def a (x):\n# note http://u\nfunction b(y) {\npublic int c(int z) {\nclass D:\n/* e\nf */\nclass E"
    df = spark.createDataFrame([("p/x.java", text)], "rel_path string, content string")
    row = code.format_code(code.code_metadata(df)).first()
    assert row.functions[:2] == ["a", "b"] and "c" in row.functions
    assert row.classes == ["D", "E"] and row.lines == 8 and row.comments == 3
    many = "\n".join(f"def f{i}(): pass" for i in range(12))
    row = code.format_code(code.code_metadata(spark.createDataFrame([("a.py", many)], "rel_path string, content string"))).first()
    assert row.formatted.split("\n")[:4] == ["File: a.py", "Language: py", "Lines: 12", "Functions: " + ", ".join(f"f{i}" for i in range(10))]
    assert row.formatted.split("\n")[4:7] == ["", "Code:", ""]


@pytest.mark.parametrize("n,size,expected", [(19, 50, [19]), (50, 50, [50]), (51, 50, [51]), (69, 50, [69]), (70, 50, [50, 20]), (120, 50, [50, 50, 20]), (119, 50, [50, 69]), (45, 5, [20, 25]), (450, 999, [200, 200, 50])])
def test_chunks(spark, n, size, expected):
    text = "\n".join(f"line {i}" for i in range(n))
    rows = code.chunk_code(spark.createDataFrame([(1, text)], "id int, content string"), size).orderBy("chunk").collect()
    assert [len(r.chunk_text.split("\n")) for r in rows] == expected
    assert "\n".join(r.chunk_text for r in rows) == text


def test_seeds(spark, tmp_path):
    path = str(tmp_path / "seeds.txt")
    _write(path, b"  https://H.com/a/?q \nftp://x\n\nsee http://no\nhttp://i.com/#t\n")
    assert sorted(r.url for r in tables.read_seeds(spark, path).collect()) == ["http://i.com", "https://H.com/a"]


def test_binary_pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "u", bytearray(b"<p>caf\xe9 ok</p>"))], "page_id bigint, url string, html binary").write.parquet(path)
    assert tables.read_pages(spark, path).first()["html"] == "<p>caf ok</p>"


LINES = ['{"text": "first ü"}', "", "broken {", '{"text": null}', '{"text": "fifth", "url": "https://h.com/meal/1"}', '{"url": "x"}']


@pytest.fixture
def dataset(tmp_path):
    path = str(tmp_path / "set.jsonl")
    _write(path, ("\n".join(LINES) + "\n").encode())
    return path


def test_jsonl_readers_agree(spark, dataset):
    expected = sorted([("first ü", None), (None, None), ("fifth", "https://h.com/meal/1"), (None, "x")], key=str)
    assert sorted((tuple(r) for r in tables.read_jsonl(spark, dataset).collect()), key=str) == expected
    parsed = tables.parse_jsonl(tables.numbered_lines(spark, dataset)).select("line_no", "text", "url")
    assert sorted((r[1:] for r in map(tuple, parsed.collect())), key=str) == expected
    assert sorted(r.line_no for r in parsed.collect()) == [1, 4, 5, 6]


def test_line_numbers_across_splits(spark, tmp_path):
    path = str(tmp_path / "many.txt")
    _write(path, "".join(f"row {i}\n" for i in range(1, 5001)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        numbered = tables.numbered_lines(spark, path)
        assert numbered.rdd.getNumPartitions() > 1
        assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString()
        assert all(r.value == f"row {r.line_no}" for r in numbered.collect()) and numbered.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_readable_and_preview(spark, dataset):
    rows = tables.parse_jsonl(tables.numbered_lines(spark, dataset))
    value = sinks.to_readable(rows).filter("line_no = 5").first()["value"]
    assert value == "=" * 80 + "\nEntry 5\n" + "=" * 80 + "\nfifth\n\n"
    long = spark.createDataFrame([(2, "late"), (1, "\n".join(["x" * 100] * 50))], "line_no int, text string")
    row = sinks.preview(long).first()
    assert row.line_no == 1 and len(row.preview) == 2000 and row.more_chars == 3049


def test_readable_dump_is_in_order(spark, tmp_path):
    path = str(tmp_path / "dump")
    rows = spark.createDataFrame([(k, f"text {k}") for k in random.Random(4).sample(range(500), 500)], "line_no int, text string").repartition(5)
    sinks.write_readable(rows, path)
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    lines = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in parts).split("\n")
    assert [x for x in lines if x.startswith("Entry ")] == [f"Entry {k}" for k in range(500)]


def test_training_rows_keep_nulls_and_unicode(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("ü — 😀",), (None,)], "chat string")
    sinks.write_training(df, path)
    sinks.write_training(df, path)
    lines = [line for f in os.listdir(path) if f.endswith(".json") for line in open(os.path.join(path, f), encoding="utf-8")]
    assert sorted(json.loads(line)["text"] for line in lines) == ["", "", "ü — 😀", "ü — 😀"]
    assert any("😀" in line for line in lines)


def test_refilter(spark, tmp_path):
    path = str(tmp_path / "set.jsonl")
    junk = "privacy policy about us gdpr"
    marker, end = vocab.ASSISTANT_MARKERS[0]
    rows = [{"text": f"{junk}{marker}fine text{end}", "id": 7, "lang": "en"}, {"text": f"x{marker}{junk}{end}"}, {"text": junk, "url": "https://h.com/meal/1"}]
    _write(path, "\n".join(json.dumps(r) for r in rows).encode())
    target, reasons = datasets.refilter_dataset(spark, path)
    assert target.endswith("set_filtered.jsonl") and open(path).read().count("\n") == 2
    assert sorted(r.value for r in spark.read.text(target).collect()) == sorted(json.dumps(rows[k]) for k in (0, 2))
    assert {r.reason: r.rows for r in reasons.collect()} == {None: 2, vocab.REASON_JUNK: 1}
    flagged = datasets.flag_dataset(tables.parse_jsonl(spark.read.text(path)))
    assert [tuple(r) for r in curate.reason_histogram(flagged).collect()] == [(vocab.REASON_JUNK, 1)]
    assert tuple(curate.kept_share(flagged).first()) == (3, 2, pytest.approx(66.666667))
    with pytest.raises(FileExistsError):
        datasets.refilter_dataset(spark, path)


def test_refilter_replaces_what_a_broken_run_left(spark, tmp_path):
    path = str(tmp_path / "set.jsonl")
    _write(path, b'{"text": "fine"}\n{"text": \n')
    spark.createDataFrame([("half",)], "entry string").write.text(sinks.filtered_path(path))  # no report
    assert datasets.refilter_report(spark, path) is None
    target, reasons = datasets.refilter_dataset(spark, path)
    assert [r.value for r in spark.read.text(target).collect()] == ['{"text": "fine"}'] and [tuple(r) for r in reasons.collect()] == [(None, 1)]


def test_files_are_written_by_name(spark, tmp_path):
    rows = [("a/b.txt", bytearray(b"x\xff")), ("c.py", bytearray())]
    sinks.write_files(spark.createDataFrame(rows, "rel_path string, content binary"), str(tmp_path))
    assert {p: (tmp_path / p).read_bytes() for p, _ in rows} == {"a/b.txt": b"x\xff", "c.py": b""}


def test_kept_share_of_nothing(spark):
    empty = spark.createDataFrame([], "reason string")
    assert tuple(curate.kept_share(empty).first()) == (0, 0, None)
    assert curate.average_quality(spark.createDataFrame([], "outcome string, quality double")).first()[0] is None


def test_replacement_characters_of_valid_text_stay(spark):
    rows = [(1, "a\ufffdb 0123456789".encode()), (2, b"c\xffd 0123456789")]
    files = spark.createDataFrame(rows, "id int, content binary").withColumn("length", F.octet_length("content"))
    assert {r.id: r.content for r in code.decode_code(files).collect()} == {1: "a\ufffdb 0123456789", 2: "cd 0123456789"}


def test_url_bypass_uses_optional_column(spark):
    rows = spark.createDataFrame([("privacy policy about us gdpr", None)], "text string, url string")
    assert datasets.flag_dataset(rows).select(F.col("reason")).first()[0] == vocab.REASON_JUNK
