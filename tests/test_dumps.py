"""The rewritten dump against a line-by-line rewrite."""
import os
import random
import re

import pytest

from ballotlens.sources import dumps

INSERT = re.compile(r"^INSERT INTO `([^`]+)` VALUES (.+);$")


def plain_rewrite(lines, size):
    out, table, batch = [], None, []

    def flush():
        nonlocal batch
        if batch:
            out.append(f"INSERT INTO `{table}` VALUES")
            out.extend(v + ("," if i < len(batch) - 1 else ";") for i, v in enumerate(batch))
        batch = []

    for line in lines:
        m = INSERT.match(line.strip())
        if m:
            if m.group(1) != table or len(batch) == size:
                flush()
            table = m.group(1)
            batch.append(m.group(2))
        else:
            flush()
            table = None
            out.append(line)
    flush()
    return out


def some_dump(seed, n):
    r, out = random.Random(seed), []
    while len(out) < n:
        kind = r.random()
        if kind < 0.2:
            out.append(r.choice(["", "-- comment", "CREATE TABLE `t` (", "INSERT INTO `t` VALUES (1)", "INSERT INTO t VALUES (1);", "INSERT INTO `` VALUES (1);", "insert into `t` VALUES (1);"]))
        else:
            t = r.choice(["account_voted", "account_unvoted"])
            out += [r.choice(["", "  ", "\t"]) + f"INSERT INTO `{t}` VALUES ({i},'it''s; (x), `y`',NULL),({i});" + r.choice(["", " ", "\t "]) for i in range(r.randint(1, 30))]
    return out


@pytest.mark.parametrize("batch,block", [(1, 7), (4, 1_000_000), (10, 40)])
def test_files_as_plain_rewrite(spark, scratch, batch, block):
    src, dst = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    os.makedirs(src)
    dump = {f"{k}.sql": some_dump(k, 400) for k in "ab"}
    for name, lines in dump.items():
        with open(os.path.join(src, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        lines = dumps.number_lines(spark, src)
        assert spark.read.text(src).rdd.getNumPartitions() > 10
        lines = lines.selectExpr("substring_index(file, '/', -1) as name", "line_no", "line")
        dumps.write_dump(dumps.rewrite_dump(lines, batch, file_col="name", block_lines=block), dst, file_col="name")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, lines in dump.items():
        folder = os.path.join(dst, f"name={name}")
        text = "".join(open(os.path.join(folder, p)).read() for p in sorted(os.listdir(folder)) if p.startswith("part-"))
        assert text.split("\n")[:-1] == plain_rewrite(lines, batch), name


def test_padded_lines_go_on_with_their_run(spark):
    rows = [(1, "INSERT INTO `t` VALUES (1);"), (2, "  INSERT INTO `t` VALUES (2); "), (3, "INSERT INTO `t` VALUES (3);")]
    got = dumps.insert_statement_batches(spark.createDataFrame(rows, "line_no long, line string")).collect()
    assert [(r.table_name, r.first_line, r.last_line, r.n_lines) for r in got] == [("t", 1, 3, 3)]
    assert dumps.rewrite_dump(spark.createDataFrame([], "line_no long, line string")).count() == 0
