"""Quoted line breaks in splits: the same records as Spark's reader gives from one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.sources import quoted, tabular


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def in_one_task(spark, path):
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return sorted(tuple((v or "").strip(" ") for v in r) for r in raw.collect())


def cell(rng):
    text = "".join(rng.choice(['a', 'b', 'é', ',', '"', '\n', ' ', '\n\n']) for _ in range(rng.choice([0, 1, 3, 9, 60])))
    plain = not any(c in text for c in ',"\n')
    return text if plain and rng.random() < 0.8 else '"' + text.replace('"', '""') + '"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_cells_equal_the_reader_of_one_task(spark, tmp_path, small_splits, end):
    rng = random.Random(7)
    for f in range(2):
        rows = [f"{i},{cell(rng)},{cell(rng)}" for i in range(80)]
        (tmp_path / f"{f}.csv").write_text(end.join(["id,a,b", *rows]) + (end if f else ""), encoding="utf-8", newline="")
    path = str(tmp_path / "*.csv")
    assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 20
    got = tabular.read_csv(spark, path)
    assert got.columns == ["id", "a", "b"]
    assert sorted(map(tuple, got.collect())) == in_one_task(spark, path)


def test_quotes_within_unquoted_cells_blank_lines_and_short_records(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,a,b\n1,5" pipe,x\n\n2,"two\n\nlines, ""so""",y\n3\n4,q"r"s,"z"\n' + "".join(f'{i},"{"w" * 50}\n,{i}",v\n' for i in range(5, 40)))
    got = sorted(map(tuple, tabular.read_csv(spark, str(tmp_path / "a.csv")).collect()))
    assert got == in_one_task(spark, str(tmp_path / "a.csv"))
    assert ("1", '5" pipe', "x") in got and ("2", 'two\n\nlines, "so"', "y") in got and ("3", "", "") in got


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, with a comma" for i in range(200))
    (tmp_path / "a.csv").write_text(f'id,a\n1,"{long}"\n2,"{long}\n"\n3,x\n')
    assert sorted(map(tuple, tabular.read_csv(spark, str(tmp_path / "a.csv")).collect())) == [("1", long), ("2", long + "\n"), ("3", "x")]
    numbers = quoted.records(spark, str(tmp_path / "a.csv")).select("number").orderBy("number").collect()
    assert [r.number for r in numbers] == [1, 2, 3, 4]


def test_only_lines_of_longer_records_are_shuffled_again(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n1,x\n")
    (tmp_path / "empty.csv").write_text("")
    assert quoted.records(spark, str(tmp_path / "*.csv")).count() == 2
    (tmp_path / "tabs").mkdir()
    (tmp_path / "tabs" / "t.txt").write_text('id\ta|b\n1\t"x\ty\nz"\n')
    found = tabular.read_csv(spark, str(tmp_path / "tabs" / "t.txt"), sep="\t")
    assert found.where(F.col("id") == "1").first()["a|b"] == "x\ty\nz"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_stay_where_they_are_in_files_without_longer_records(spark, tmp_path, small_splits):
    rows = [f'{i},"q, {i}",v' for i in range(60)]
    (tmp_path / "a.csv").write_text("\n\nid,a,b\n" + "\n".join([*rows[:30], "id,a,b", "", "id,a,b", *rows[30:]]) + "\r\n", newline="")
    (tmp_path / "empty.csv").write_text("")
    plain = tabular.read_csv(spark, str(tmp_path / "a.csv"))
    assert "Window" not in plan(plain) and "Exchange" not in plan(plain)
    want = [(str(i), f"q, {i}", "v") for i in range(60)] + [("id", "a", "b")] * 2
    assert sorted(map(tuple, plain.collect())) == sorted(want)
    (tmp_path / "b.csv").write_text('id,a,b\r\n7,"two\nlines",x\r\nid,a,b\r\n', newline="")
    want += [("7", "two\nlines", "x"), ("id", "a", "b")]
    assert sorted(map(tuple, tabular.read_csv(spark, str(tmp_path / "*.csv")).collect())) == sorted(want)
    (tmp_path / "c.csv").write_text('b,id\n1,"8\n9"\n2,10\n')
    (found,) = [f for f in quoted.alike(spark, str(tmp_path / "*.csv")) if f.head == "b,id"]
    assert (found.plain, len(found.longer)) == (0, 1)
    assert sorted(map(tuple, tabular.read_csv(spark, str(tmp_path / "*.csv")).select("id", "a", "b").collect())) == sorted([*want, ("8\n9", "", "1"), ("10", "", "2")])


def test_what_is_asked_of_cells_is_never_asked_of_a_header(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("id,n\n" + "".join(f"{i},{i}\n" for i in range(90)))
    read = tabular.read_csv(spark, str(tmp_path / "a.csv"))
    numbers = read.select("id", F.col("n").cast("long").alias("n")).where("n >= 30")
    other = spark.range(40, 200).select(F.col("id").alias("n"))
    assert (numbers.count(), numbers.join(other, "n").count(), numbers.distinct().agg(F.sum("n")).first()[0]) == (60, 50, sum(range(30, 90)))


def test_a_window_holds_a_run_of_lines_and_no_split(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("id,a\n" + "".join(f'{i},"two\n\nlines, {i}"\n' if i % 3 else f"{i},x\n" for i in range(300)))
    for bits in (0, 2, quoted.RUN_BITS):
        monkeypatch.setattr(quoted, "RUN_BITS", bits)
        df = tabular.read_csv(spark, str(tmp_path / "a.csv"))
        assert sorted(map(tuple, df.collect())) == sorted((str(i), f"two\n\nlines, {i}" if i % 3 else "x") for i in range(300))
    assert "run#" in re.search(r"hashpartitioning\(file#\d+, at#\d+L, (\w+#)", plan(df))[1]


def test_headers_are_found_without_sorting_lines(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("id,a\n1,x\n")
    seen = []
    monkeypatch.setattr(quoted, "cut", lambda df: seen.append(df) or df)
    assert quoted.alike(spark, str(tmp_path / "a.csv")) == [quoted.Alike(str(tmp_path / "a.csv"), "id,a", 1, [])]
    assert "ObjectHashAggregate" in plan(seen[0]) and "Sort" not in plan(seen[0])


def test_only_records_over_the_ends_of_runs_are_shuffled_again(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n" + "".join(f'{i},"two\nlines, {i}"\n' for i in range(9000)))
    df = quoted.records(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.where("number in (1, 2, 9001)").orderBy("number").select("number", "record").collect()] == [(1, "id,a"), (2, '0,"two\nlines, 0"'), (9001, '8999,"two\nlines, 8999"')]
    assert df.count() == df.agg(F.max("number")).first()[0] == 9001
    assert re.search(r"hashpartitioning\(file#\d+, number#\d+L?,[^\n]*\n(?:[^\n]*\n){1,5}[^\n]*Filter[^\n]*NOT whole#", plan(df))
