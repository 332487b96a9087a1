"""CSV split among tasks gives the rows of an unsplit reader."""

import csv
import io
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from mirrortab.sources import splitting
from mirrortab.sources.tables import CSV, read_table

CELLS = ["", "a", "b c", "1", "-2.5", 'say "hi"', "x,y", "two\nlines", 'q"\n"\n,"', "\n", '"', ",", "é", "NA", "tail ", "a\n\n\nb", '""', "many " * 40]


def written(path, rows, end="\n", header=("id", "one", "two words", "three")):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def unsplit(spark, path):
    return spark.read.options(**CSV).option("multiLine", True).csv(str(path))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_blocks(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "200"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_of_a_split_file(spark, tmp_path, small_blocks, end):
    r = random.Random(7)
    rows = [[i, *[r.choice(CELLS) for _ in range(3)]] for i in range(400)]
    written(tmp_path / "t.csv", rows, end)
    path = str(tmp_path / "t.csv")
    assert splitting.physical_lines(spark, path).rdd.getNumPartitions() > 30
    got = splitting.read_csv(spark, path, CSV)
    want = unsplit(spark, path)
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and got.count() == 400


def test_one_record_over_many_blocks(spark, tmp_path, small_blocks):
    rows = [[1, "x", "y", "z"], [2, "line\n" * 900, 'q""\n' * 300, ""], [3, "a", "b", "c"]]
    written(tmp_path / "t.csv", rows)
    assert rows_of(splitting.read_csv(spark, str(tmp_path / "t.csv"), CSV)) == rows_of(unsplit(spark, tmp_path / "t.csv"))


def test_quotes_inside_plain_cells_do_not_count(spark, tmp_path, small_blocks):
    lines = ["id,one,two words,three"] + [x for i in range(60) for x in (f'{i},5" pipe,a"b"c,"', f'in {i}","z"', f"{i},plain,,", '7,"x"y,2,3')]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    got = rows_of(splitting.read_csv(spark, str(tmp_path / "t.csv"), CSV))
    assert got == rows_of(unsplit(spark, tmp_path / "t.csv"))


def test_several_files_blank_lines_and_no_rows(spark, tmp_path, small_blocks):
    written(tmp_path / "a.csv", [[1, "p\nq", "", ""], [2, "x", "y", "z"]])
    written(tmp_path / "b.csv", [[3, "", "r", "s,t"]])
    (tmp_path / "c.csv").write_text("id,one,two words,three\n\n\n4,a,b,c\n\n")
    got = splitting.read_csv(spark, str(tmp_path), CSV)
    assert rows_of(got) == rows_of(unsplit(spark, tmp_path)) and got.count() == 4
    alone = tmp_path / "none"
    alone.mkdir()
    (alone / "d.csv").write_text("id,one\n")
    assert splitting.read_csv(spark, str(alone), CSV).count() == 0


def test_plain_files_are_not_shuffled(spark, tmp_path, small_blocks):
    written(tmp_path / "t.csv", [[i, "a", "b,c", 'd"e'] for i in range(200)])
    df = splitting.records(spark, str(tmp_path / "t.csv"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.rdd.getNumPartitions() > 10


def test_types_and_missing_words(spark, tmp_path, small_blocks):
    written(tmp_path / "t.csv", [[i, i / 2, "true" if i % 2 else "False", "NA" if i % 3 else f"line\n{i}"] for i in range(50)])
    df = read_table(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string"]
    assert df.where(F.col("three").isNull()).count() == 33 and df.where("three = 'line\\n48'").count() == 1
    given = read_table(spark, str(tmp_path / "t.csv"), schema="id int, one float, `two words` string, three string")
    assert [f.dataType.simpleString() for f in given.schema.fields] == ["int", "float", "string", "string"] and given.where("id = 48 AND one = 24.0").count() == 1


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {p: os.path.getsize(p) for i in range(files.size()) if (p := files.apply(i).getPath()).endswith(".data") and os.path.exists(p)}


def test_texts_of_many_lines_stay_where_they_are_read(spark, tmp_path):
    r = random.Random(3)
    rows = [[i, "\n".join(f"{r.getrandbits(256):x}, \"{r.getrandbits(256):x}\"" for _ in range(12)), "x", "y"] for i in range(1500)]
    written(tmp_path / "t.csv", rows)
    size = (tmp_path / "t.csv").stat().st_size
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 6))
    try:
        before = shuffle_files(spark)
        got = read_table(spark, str(tmp_path / "t.csv"))
        kept = sorted(tuple(x) for x in got.collect())
        moved = sum(n for p, n in shuffle_files(spark).items() if p not in before)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert kept == [tuple(x) for x in rows] and moved < size / 10


@pytest.mark.parametrize("batch", ["1", "4", "10000"])
def test_records_of_any_quotes_and_their_places(spark, tmp_path, small_blocks, batch):
    r = random.Random(5)
    text = "".join(r.choice(['"', '""', "a", ",", "\n", "\n\n", '"\n', '\n"', '","', "plain,line\n" * 5, '"in\nside",\n']) for _ in range(700))
    (tmp_path / "t.csv").write_text(text)
    want, held, inside = [], [], False
    for line in text.removesuffix("\n").split("\n"):
        held.append(line)
        inside = bool(re.search(splitting.STAYS if inside else splitting.OPENS, line))
        if not inside:
            want, held = [*want, "\n".join(held)], []
    want = [x for x in [*want, "\n".join(held)] if x]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = splitting.records(spark, str(tmp_path / "t.csv")).orderBy("block", "at").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [x["record"] for x in got] == want and len({x["block"] for x in got}) > 5
