import csv
import random

import pytest
from pyspark.sql import functions as F

from defgrain import read_csv
from defgrain.config import ROW_ID
from defgrain.sources import split_csv

CELLS = ["", "plain", 'say "yes"', "two\nlines", "\n\n", "a,b", '"', "x" * 300 + "\n" + "y" * 300, "  ", "ä漢\n", "end\n\n\n"]


def write(path, rows, line="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator=line)
        writer.writerow(["id", "code", "doc"])
        writer.writerows(rows)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, root = random.Random(3), tmp_path_factory.mktemp("csv")
    for k, line in enumerate(("\n", "\r\n", "\n")):
        cells = [c.replace("\n", line) for c in CELLS]
        write(root / f"f{k}.csv", [(f"{k}-{i}", rng.choice(cells), rng.choice(cells)) for i in range(400)], line)
    # One cell over many ranges, and a file without a last line end.
    write(root / "g.csv", [("g-0", "big" + "\nq" * 6000, "z"), ("g-1", "after", "")])
    (root / "h.csv").write_bytes(b'id,code,doc\n\nh-0,"a\nb",c\n\nh-1,"last\nline",""')
    return str(root)


def rows_of(df):
    return sorted(map(tuple, df.select("id", "code", "doc").collect()), key=str)


@pytest.mark.parametrize("size", [500, 1111, 4096, 1 << 20])
def test_equals_one_task_a_file(spark, files, size):
    want = rows_of(read_csv(spark, files, whole_files=True))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_csv(spark, files)
        got = df.select(ROW_ID, "id", "code", "doc").collect()
        if size == 500:
            assert split_csv._lines(spark, files).rdd.getNumPartitions() > 100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(((r["id"], r["code"], r["doc"]) for r in got), key=str) == want and len(want) == 1204
    # Row ids are unique and follow the order in the files.
    order = [r["id"] for r in sorted(got, key=lambda r: tuple(r[ROW_ID]))]
    assert len({tuple(r[ROW_ID]) for r in got}) == len(got)
    assert order == sorted(order, key=lambda i: (i[0] if i[0] in "gh" else "f" + i[0], int(i.split("-")[1])))


def test_key_and_columns(spark, files):
    assert read_csv(spark, files, key="id").select(F.min(ROW_ID)).first()[0] == "0-0"
    named = read_csv(spark, files, columns=["a", "b", "c"])
    assert named.columns == [ROW_ID, "a", "b", "c"] and named.count() == 1204


def test_stray_quotes_are_refused(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,code,doc\n1,5" wide,x\n')
    with pytest.raises(ValueError, match="odd number of quotes"):
        read_csv(spark, str(tmp_path / "s.csv"))
    assert read_csv(spark, str(tmp_path / "s.csv"), whole_files=True).count() == 1


def test_header_only(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,code,doc\n")
    assert read_csv(spark, str(tmp_path / "e.csv")).count() == 0
