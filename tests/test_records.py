"""CSV in parts, and headers from the first rows."""

import csv
import random

import pytest

from perilscope.sources import records, tables


@pytest.fixture
def parts(spark):
    """Files are cut into parts of some hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def written(path, rows, **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, **{"lineterminator": "\n", **options}).writerows(rows)


def odd(rng, n):
    return "".join(rng.choice(["a", "b", '"', "\n", ",", "é ", " x", "\n\n"]) for _ in range(n))


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_large_files(spark, parts, tmp_path, quoting, end):
    rng = random.Random(3)
    want = []
    for f in range(3):
        sizes = [0, 3, 12, 25, 500 if f else 900]  # some values are longer than several parts
        rows = [[str(i), odd(rng, rng.choice(sizes)), "z" * (i % 4)] for i in range(30)]
        written(tmp_path / f"f{f}.csv", rows, quoting=quoting, lineterminator=end)
        want += rows
    found = records.read_records(spark, str(tmp_path))
    assert records.text_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    cells = records.parsed(found, tables.cell_schema(3)).orderBy("file", "block", "at").collect()
    assert [[r["c0"], r["c1"] or "", r["c2"] or ""] for r in cells] == want
    # a record is numbered among those that begin in its part
    for r, following in zip(cells, cells[1:]):
        same = (r["file"], r["block"]) == (following["file"], following["block"])
        assert following["n"] == (r["n"] + 1 if same else 0)


def test_empty_lines_and_an_open_quote(spark, parts, tmp_path):
    (tmp_path / "a.csv").write_text('\n\nx,1\n\r\ny,2\n"open,\n\nto the end')
    (tmp_path / "b.csv").write_text("")
    got = records.read_records(spark, str(tmp_path)).orderBy("block", "at").collect()
    assert [r["record"] for r in got] == ["x,1", "y,2", '"open,\n\nto the end']
    assert records.read_records(spark, str(tmp_path / "b.csv")).collect() == []


def test_table_with_odd_headers(spark, parts, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    rows = [[str(i), f"v\n{i}", "w" * i] for i in range(60)]
    for f in range(2):
        written(folder / f"{f}.csv", [["a\nb", "", "A\nB"], *rows[f::2]])
    got = tables.read_table(spark, str(folder), multi_line=True)
    assert got.columns == ["a\nb0", "_c1", "A\nB2"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, c or None) for a, b, c in rows)
    typed = tables.read_table(spark, str(folder), "k bigint, v string, w string", multi_line=True)
    assert typed.agg({"k": "sum"}).first()[0] == sum(range(60))


def test_header_of_many_files_is_found_in_the_first(spark, tmp_path):
    """Files that cannot be read as CSV show that the search opens no other one."""
    written(tmp_path / "00.csv", [])
    written(tmp_path / "01.csv", [["report", ""], ["key", "name"], ["1", "one"]])
    for i in range(2, 30):
        (tmp_path / f"{i:02}.csv.gz").write_bytes(b"no archive")
    file, rows = tables.first_rows(spark, str(tmp_path), 50)
    assert file.endswith("01.csv") and rows == [["report", None], ["key", "name"], ["1", "one"]]


@pytest.mark.parametrize("multi_line", [False, True])
def test_rows_above_the_header_go(spark, parts, tmp_path, multi_line):
    body = [[str(i), f"n{i}"] for i in range(200)]
    written(tmp_path / "1.csv", [["report", ""], ["", "x"], ["key", "name"], *body[:120]])
    written(tmp_path / "2.csv", body[120:])
    path = str(tmp_path)
    for probe in (1000, 2):  # the header is below what is looked at: all rows are searched
        got = tables.read_with_header(spark, path, 2, ["key"], multi_line=multi_line, probe=probe)
        assert got.columns == ["key", "name"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, body))
    first = tables.read_with_header(spark, path, 3, ["nowhere"], multi_line=multi_line)
    assert first.columns == ["report", "Unnamed: 1", "Unnamed: 2"] and first.count() == 202
    (tmp_path / "none").mkdir()
    assert tables.read_with_header(spark, str(tmp_path / "none"), 2, ["key"], multi_line=multi_line).columns == ["c0", "c1"]
