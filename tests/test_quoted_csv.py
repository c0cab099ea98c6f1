"""CSV in ranges against reading each file whole."""

import csv
import io
import random

import pytest

from framewright.sources.index import read_image_csv
from framewright.sources.quoted_csv import ends_inside, read_quoted_csv


@pytest.mark.parametrize(
    ("line", "inside", "after"),
    [
        ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True),
        ('a,5" disk,c', False, False), ('"', False, True), ('"', True, False), ('""', False, False), ('""', True, True),
        ('x"', True, False), ('x",y,"z', True, True), ('"a ""b"" c","d', False, True), ('b","c"', True, False), ("", True, True),
        ('x"",y', True, True), ('"""', False, True), ('""""', False, False),
    ],
)
def test_state_behind_a_line(line, inside, after):
    assert ends_inside(line, inside) is after


def made(rows, seed):
    rng = random.Random(seed)
    values = ["", "x", 'say "hi"', "two\nlines", "a\n\n\nb", ",", '"', "é\r\nü", "long " * 60, '\n"\n', "5 in"]
    out = [["ImageID", "Title", "Author"]]
    out += [[str(i), *(rng.choice(values) for _ in range(2))] for i in range(rows)]
    return out


def write(path, rows, **options):
    text = io.StringIO()
    csv.writer(text, **options).writerows(rows)
    path.write_bytes(text.getvalue().encode())


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_ranges_equal_the_whole_file(spark, tmp_path, split):
    tables = [made(150, 1), made(90, 2), [["ImageID", "Title", "Author"]]]
    write(tmp_path / "a.csv", tables[0])
    write(tmp_path / "b.csv", tables[1], lineterminator="\n", quoting=csv.QUOTE_ALL)
    write(tmp_path / "c.csv", tables[2])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        read = read_quoted_csv(spark, str(tmp_path)).orderBy("place")
        got = [[r[c] or "" for c in ("ImageID", "Title", "Author")] for r in read.collect()]
        tasks = len({(r.place.file, r.place.block) for r in read.collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == tables[0][1:] + tables[1][1:]
    assert tasks > (20 if split == 64 else 4 if split == 700 else 1)


def test_unquoted_quotes_and_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ImageID,Title\n1,a 5" disk\n2\n3,"b\n\nc"\n\n1,again\n')
    rows = [(r["image_id"], r["title"]) for r in read_image_csv(spark, str(tmp_path)).orderBy("image_id").collect()]
    assert rows == [("1", 'a 5" disk'), ("2", ""), ("3", "b\n\nc")]


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_image_csv(spark, str(tmp_path)).count() == 0
