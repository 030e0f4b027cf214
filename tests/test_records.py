"""CSV files cut by byte ranges: the same rows as one task reads, whatever stands at the cuts."""

import csv
import io
import random

import pytest
from harness import compare, duckdb_connection

import catalogue
from tabulift.sources import records
from tabulift.sources.tables import byte_size, load_csv


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield use
    for n, value in before.items():
        spark.conf.set(n, value)


def plain_state(line, inside):
    """One character at a time."""
    state, i = ("quoted" if inside else "begin"), 0
    while i < len(line):
        c = line[i]
        if state == "begin":
            state = "quoted" if c == '"' else "begin" if c == "," else "plain"
        elif state == "plain":
            state = "begin" if c == "," else "plain"
        elif c == '"' and line[i + 1 : i + 2] == '"':
            i += 1
        elif c == '"':
            state = "plain"
        i += 1
    return state == "quoted"


def test_state_behind_a_line():
    r = random.Random(1)
    for _ in range(4000):
        line = "".join(r.choice('",a') for _ in range(r.randint(0, 12)))
        for inside in (False, True):
            assert records.inside_after(line, inside) == plain_state(line, inside), (line, inside)


def cells(seed, rows):
    r = random.Random(seed)
    values = ["plain", "with, comma", 'say "x"', "two\nlines", "\n", '"', '""', ",", "é日本", 'a"b', "end\n\n", '\n"\n', " blank ", "x" * 300, "y\n" * 90]
    return [[f"row{i}", *(r.choice(values) for _ in range(3))] for i in range(rows)]


def written(rows, quoting, end):
    out = io.StringIO()
    csv.writer(out, quoting=quoting, lineterminator=end).writerows([["key", "b", "c d", "e"], *rows])
    return out.getvalue()


@pytest.mark.parametrize(
    "size,quoting,end,kept",
    [(2000, csv.QUOTE_MINIMAL, "\n", 1 << 20), (2500, csv.QUOTE_ALL, "\r\n", 1 << 20), (1900, csv.QUOTE_MINIMAL, "\n", 40), (10**6, csv.QUOTE_ALL, "\n", 9)],
)
def test_records_of_ranges(spark, tmp_path, small_ranges, monkeypatch, size, quoting, end, kept):
    monkeypatch.setattr(records, "KEPT_CHARS", kept)
    folder = tmp_path / "rows.csv"
    folder.mkdir()
    rows = [cells(seed, 200) for seed in (1, 2)]
    for i, part in enumerate(rows):
        (folder / f"{i}.csv").write_text(written(part, quoting, end) + (end * 2 if i else ""), newline="")
    (folder / "empty.csv").write_text("")
    (folder / "header.csv").write_text("key,b,c d,e", newline="")
    small_ranges(size)
    found = load_csv(spark, str(folder), "key string, b string, `c d` string, e string", split=True)
    assert size > 10_000 or spark.read.text(str(folder)).rdd.getNumPartitions() > 5
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(x) for part in rows for x in part)


def test_one_long_cell_over_many_ranges(spark, tmp_path, small_ranges):
    rows = [["a", "1\n" * 2000, "", "x"], ["b", "2", 'q"\n' * 1000, "y"], ["c", "3", "4", "z"]]
    (tmp_path / "long.csv").write_text(written(rows, csv.QUOTE_MINIMAL, "\n"), newline="")
    small_ranges(2000)
    found = load_csv(spark, str(tmp_path / "long.csv"), "key string, b string, `c d` string, e string", split=True)
    assert sorted(tuple(r) for r in found.collect()) == [tuple(x or None for x in row) for row in rows]


def test_same_as_one_task(spark, tmp_path, small_ranges):
    text = 'k,n,t\n1,2.5,"a\nb"\n\n2,,plain "quoted" inside\n3,NA,5" pipe, left\n4,7\n5,8," spaced "\n'
    text = text.replace(", left", " left") + "".join(f'{i},1.5,"line\n,{i}"\n{i},,5" pipe\n' for i in range(300))
    (tmp_path / "odd.csv").write_text(text, newline="")
    whole = load_csv(spark, str(tmp_path / "odd.csv"), split=False)
    small_ranges(2000)
    parts = load_csv(spark, str(tmp_path / "odd.csv"), split=True)
    assert parts.schema == whole.schema
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert sorted(map(tuple, load_csv(spark, str(tmp_path / "odd.csv")).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_surplus_cells_fail_in_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "wide.csv").write_text("a,b\n1,2\n3,4,5\n")
    small_ranges(2000)
    with pytest.raises(Exception, match="more cells than the header"):
        load_csv(spark, str(tmp_path / "wide.csv"), "a int, b int", split=True).collect()


def test_documents_in_many_ranges(spark, folder, small_ranges):
    small_ranges(20_000)
    assert compare(catalogue.QUERIES["load_csv_split"](spark, folder), duckdb_connection(folder), catalogue.SQL["load_csv_split"]) is None


def test_sizes():
    assert [byte_size(t) for t in ("134217728b", "128MB", "64k", "1g", "7")] == [1 << 27, 1 << 27, 1 << 16, 1 << 30, 7]


def test_files_do_not_grow_with_the_table(spark, tmp_path):
    """One task writes a file, so a table of more splits makes more files, and each is still cut into ranges."""
    import glob

    import catalogue
    from tabulift.sources import tables

    docs = spark.range(3000).selectExpr("id AS doc_id", "concat(repeat('a line, \"quoted\"\\n', 20), id) AS text", "'en' AS lang", "id AS n_chars")
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    seen, read = [], tables.read_records
    tables.read_records = lambda s, path: seen.append(path) or read(s, path)
    try:
        made = catalogue.QUERIES["load_csv_split"](spark, str(tmp_path))
        assert sorted(made.collect()) == sorted(docs.select("doc_id", "text", "lang", "n_chars").collect())
    finally:
        tables.read_records = read
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(glob.glob(f"{seen[0]}/*.csv")) > 1
