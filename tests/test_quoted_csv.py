"""CSV with quoted newlines in many splits, against Python's csv module."""
import csv
import os
import random

import pytest
from pyspark.errors import PySparkException

from ballotlens.sources import quoted_csv, readers


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["a", 'say ""', '"', '""', "x,y", "line\nbreak", "\n", "\n\n", "é", " pad ", '",\n"', "plain text"])
    return [[str(i), "".join(word() for _ in range(r.randint(0, 6))), r.choice(["", "k", 'q"']), "end"] for i in range(n)]


def write(path, rows, newline="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator=newline).writerows([["id", "text", "a `b`", "last"], *rows])


def read_back(path):
    with open(path, encoding="utf-8") as f:      # universal newlines, as the loaders open files
        return [tuple(v or None for v in r.values()) for r in csv.DictReader(f)]


@pytest.mark.parametrize("seed,newline", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_as_python_csv(spark, scratch, small_splits, seed, newline):
    want = []
    for k in range(2):
        path = os.path.join(scratch, f"part-{k}.csv")
        write(path, rows_of(seed * 10 + k, 150), newline)
        want += read_back(path)
    df = readers.read_proposals_csv(spark, scratch)
    assert df.columns == ["id", "text", "a `b`", "last"]
    got = [tuple(v or None for v in r) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 300
    lines = spark.read.text(scratch)
    assert lines.rdd.getNumPartitions() > 20
    plan = df._jdf.queryExecution().toString()
    assert "multiLine" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_records_are_numbered_and_blank_lines_left_out(spark, scratch, small_splits):
    with open(os.path.join(scratch, "a.csv"), "w") as f:
        f.write('h\n"one\n\ntwo"\n\nthree\n"" \n')
    got = {r.record: r.text for r in quoted_csv.csv_records(spark, scratch).collect()}
    assert got == {1: "h", 2: '"one\n\ntwo"', 4: "three", 5: '"" '}


def test_unpaired_quotes_and_giant_records_are_errors(spark, scratch, small_splits):
    with open(os.path.join(scratch, "a.csv"), "w") as f:
        f.write('h\n"open\n' + "text\n" * 300)
    with pytest.raises(PySparkException, match="never closed"):
        readers.read_proposals_csv(spark, scratch).collect()
    with open(os.path.join(scratch, "a.csv"), "a") as f:
        f.write('closed"\n')
    assert readers.read_proposals_csv(spark, scratch).count() == 1
    with pytest.raises(PySparkException, match="more than 1000 characters"):
        quoted_csv.read_quoted_csv(spark, scratch, max_record=1000).collect()


def test_empty_file_with_header_only(spark, scratch):
    write(os.path.join(scratch, "a.csv"), [])
    assert readers.read_proposals_csv(spark, scratch).count() == 0
