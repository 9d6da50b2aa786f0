"""Folders that tasks list and read, beside what Spark's own readers give."""

import bz2
import gzip

import pytest

from loomsift.sources import files, sinks, tables

NAMES = {
    "a b%20é.txt": b"one\r\ntwo\rthree\n\nfour", "mark.txt": b"\xef\xbb\xbfx\n\xef\xbb\xbfy", "only.txt": b"\xef\xbb\xbf", "bad.txt": b"caf\xe9\n\x85\x0b\n\r\n\r", "empty.txt": b"",
    ".hidden": b"h", "_hidden": b"h", "_k=v": b"shown", "x._COPYING_": b"h", "z.gz": gzip.compress(b"p\nq\n") + gzip.compress(b"r"), "z.bz2": bz2.compress(b"s\nt"),
    "sub/not [1]*{2}.txt": b"below\nbelow", "sub/deep/three.py": b"a = 1\n", ".git/x.py": b"b = 1\n",
}


@pytest.fixture
def root(tmp_path):
    for name, data in NAMES.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(data)
    return str(tmp_path / "r")


def _numbered(df):
    return sorted((r.file, r.line_no, bytes(r.value)) for r in df.selectExpr("file", "line_no", "cast(value as binary) value").collect())


@pytest.mark.parametrize("path", ["", "/*", "/s*", "/*/not*", "/?.txt", "/*.txt"])
@pytest.mark.parametrize("most", [files.TASK_BYTES, 3])
def test_lines_as_sparks_reader_has_them(spark, root, monkeypatch, path, most):
    monkeypatch.setattr(files, "TASK_BYTES", most)  # larger files are read in splits
    got = _numbered(tables.numbered_lines(spark, "file://" + root + path))
    assert got == (_numbered(tables._lines_of_splits(spark, root + path)) if path != "/?.txt" else [])  # Spark takes no path without a file


def test_lines_of_partition_folders(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "value string, k int").write.partitionBy("k").text(str(tmp_path / "t"))
    got = _numbered(tables.numbered_lines(spark, str(tmp_path / "t")))
    assert got == _numbered(tables._lines_of_splits(spark, str(tmp_path / "t"))) and len(got) == 2


def test_no_row_per_file_in_the_driver(spark, root, monkeypatch):
    """Neither Spark's listing nor a row per file: the driver sees counts only."""
    held = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: held.append(rows := collect(df)) or rows)
    lines = tables.numbered_lines(spark, root)
    found = tables.scan_code(spark, root)
    monkeypatch.undo()
    assert not any(len(rows) > 1 for rows in held)
    for df in (lines, found):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "binaryFile" not in plan and "Relation [value" not in plan
    assert [(r.rel_path, r.length, bytes(r.content)) for r in found.collect()] == [("sub/deep/three.py", 6, b"a = 1\n")]


def test_tasks_follow_the_files_not_the_cores(spark, tmp_path):
    """600 small files are a task's work, where Spark's reader makes a task of every 32 or fewer."""
    rows = [(f"d{i % 7}/{i}.py", f"x = {i}\n") for i in range(600)]
    sinks.write_files(spark.createDataFrame(rows, "rel_path string, content string"), str(tmp_path))
    found = tables.scan_code(spark, str(tmp_path))
    assert found.count() == 600 and {(r.rel_path, bytes(r.content).decode()) for r in found.collect()} == set(rows)
    listed = files.list_files(spark, str(tmp_path), deep=True)
    assert files.contents(listed, str(tmp_path)).rdd.getNumPartitions() == 1


def test_missing_folders_are_errors_of_sparks_reader(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.numbered_lines(spark, str(tmp_path / "none"))
