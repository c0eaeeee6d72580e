"""Split reading of CSV against the reader that takes a file whole."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from loomline.sources.csv_splits import _ends_inside, _lines
from loomline.sources.readers import read_csv_records

VALUES = ["plain", "", "a,b", "two\nlines", "\n\n", 'say "so"', '""', "x\r\ny", ",\n\",\"\n", 'in 5" wide', "ü€", "long " * 30 + "\n" + "tail " * 20, "\n" * 90]


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "207")
    yield
    spark.conf.set(key, before)


def quoted(value: str, rng: random.Random) -> str:
    plain = not any(c in value for c in ',\n\r') and not value.startswith('"') and value
    return value if plain and rng.random() < 0.7 else '"' + value.replace('"', '""') + '"'


def write_file(path, rows, rng, end="\n", header="id,u,v", last_end=True):
    lines = ([header] if header else []) + [",".join([str(i), quoted(u, rng), quoted(v, rng)]) for i, u, v in rows]
    path.write_bytes((end.join(lines) + (end if last_end else "")).encode())


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_splits_give_the_rows_of_whole_files(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    end, header = ("\r\n" if seed % 2 else "\n"), "id,u,v" if seed < 3 else None
    given = Counter()
    for n in range(3):
        rows = [(i, rng.choice(VALUES), rng.choice(VALUES)) for i in range(16 * n + 1)]
        write_file(tmp_path / f"{n}.csv", rows, rng, end, header, last_end=n != 1)
        given.update((str(i), u or None, v or None) for i, u, v in rows)
    path = str(tmp_path)
    split = read_csv_records(spark, path, ["id", "u", "v"], header=bool(header))
    whole = read_csv_records(spark, path, ["id", "u", "v"], header=bool(header), by_file=True)
    assert _lines(spark, path).select("path", "start").distinct().count() >= 10
    assert rows_of(split) == given
    if end == "\n":  # the whole-file reader turns every line break of such files into \n
        assert rows_of(whole) == given


def test_names_types_blank_lines_and_damaged_records(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('\nid,"two\nwords",n\n\n1,"a\n\nb",7\n2,x\n3,"q"r,9,extra\n  \n4,y,oops\n5,"' + "never closed\n" * 30 + "end")
    for schema in (None, "id string, t string, n int"):
        split = read_csv_records(spark, str(tmp_path), schema=schema)
        whole = read_csv_records(spark, str(tmp_path), schema=schema, by_file=True)
        assert split.columns == whole.columns and rows_of(split) == rows_of(whole)


def test_empty_files_and_no_quotes(spark, small_splits, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("id,v\n")
    assert read_csv_records(spark, str(tmp_path), ["id", "v"]).count() == 0
    (tmp_path / "plain.csv").write_text("id,v\n" + "".join(f"{i},w{i}\n" for i in range(200)))
    assert rows_of(read_csv_records(spark, str(tmp_path), ["id", "v"])) == Counter((str(i), f"w{i}") for i in range(200))


def test_states_of_a_line():
    ends = _ends_inside(",")
    outside = {'a,"b': True, 'a"b': False, '"a""': True, '"a"': False, '"",""': False, '"a,b': True, 'a,"b","': True, '"x"y,"': True, "": False}
    inside = {"a": True, 'a"': False, 'a",b': False, 'a","b': True, 'a""b': True, '""': True, '"': False, '"x,"y': True, "": True}
    assert {k: ends(k, False) for k in outside} == outside
    assert {k: ends(k, True) for k in inside} == inside
