"""CSV records over splits: quotes, blank lines, fields over lines and blocks, and long integers, held against pandas."""

import io
import random
from contextlib import contextmanager
from decimal import Decimal

import pandas as pd
import pytest

from factsheet import ProfileRefused
from factsheet.sources import csv as C


@contextmanager
def tiny_splits(spark, size=97):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def made(seed, n=260):
    rng = random.Random(seed)
    shapes = ['x', '5" pipe', 'a"b"c', '"q"', '"a,b"', '"two\nlines"', '"""x"""', '"say ""hi"", then\n\n""left"""', '"' + "long " * 40 + '\n,\n"', "", "é文"]
    lines = ["id,left,right"]
    for k in range(n):
        lines.append(",".join([str(k), *rng.choices(shapes, k=rng.choice([0, 1, 2, 2, 2]))]))
        lines += rng.choice([[], [], [], [""], ["  \t"]])
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n")])
def test_records_equal_pandas(spark, tmp_path, seed, end):
    text = made(seed)
    if end == "\r\n":  # line ends outside of quotes only: those inside belong to the field
        out, inside = [], False
        for c in text:
            inside ^= c == '"'
            out.append("\r\n" if c == "\n" and not inside else c)
        text = "".join(out) if text.count('5" pipe') == 0 else text.replace('5" pipe', "5 pipe")
    path = write(tmp_path / "made.csv", text)
    want = pd.read_csv(io.StringIO(text), dtype=str, engine="c")
    want = [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]
    with tiny_splits(spark):
        got = C.scan(spark, path, ["id", "left", "right"], multiline=True)
        assert got.rdd.getNumPartitions() >= 1
        rows = sorted((tuple(r)[:3] for r in got.collect()), key=lambda r: int(r[0]))
        assert rows == want
        assert C.text_faults(spark, path, True) == {"not_utf8": 0, "open_quotes": 0}


def test_quote_state_across_blocks(spark, tmp_path):
    good = 'a,b\n1,"' + "\n".join(f'line {k}, ""x""' for k in range(60)) + '"\n2,5" pipe\n'
    broken = 'a,b\n1,x\n2,"open\n' + "".join(f"{k},y\n" for k in range(3, 90))
    twice = 'a,b\n1,"open\n2,x\n3,y"z\n' + "4,z\n" * 40  # closed again: one field over three lines
    with tiny_splits(spark, 64):
        assert C.text_faults(spark, write(tmp_path / "good.csv", good), True)["open_quotes"] == 0
        assert C.text_faults(spark, write(tmp_path / "broken.csv", broken), True)["open_quotes"] == 1
        assert C.text_faults(spark, write(tmp_path / "twice.csv", twice), True)["open_quotes"] == 0
        df = C.load_csv(spark, str(tmp_path / "good.csv"), multiline=True)
        rows = {r.a: r.b for r in df.collect()}
        assert rows[2] == '5" pipe' and rows[1].count("\n") == 59 and rows[1].endswith('"x"')
        with pytest.raises(ProfileRefused) as e:
            C.load_csv(spark, str(tmp_path / "broken.csv"), multiline=True)
        assert e.value.code == "UNPARSEABLE_CSV"


def test_two_faulty_files_do_not_cancel_out(spark, tmp_path):
    write(tmp_path / "1.csv", 'a,b\n1,"open\n')
    write(tmp_path / "2.csv", 'a,b\n2,"open\n')
    assert C.text_faults(spark, str(tmp_path), True)["open_quotes"] == 2


@pytest.mark.parametrize("multiline", [False, True])
def test_quote_inside_blank_first_line_and_overflow_name(spark, tmp_path, multiline):
    path = write(tmp_path / "a.csv", '\n  \na,_overflow,c\n\n1,5" pipe,2\n3,x,4\n')
    df = C.load_csv(spark, path, multiline=multiline)
    assert df.columns == ["a", "_overflow", "c"]
    assert sorted(map(tuple, df.collect())) == [(1, '5" pipe', 2), (3, "x", 4)]
    long = write(tmp_path / "b.csv", "_overflow,_OVERFLOW_,c\n1,2,3\n1,2,3,4\n")
    with pytest.raises(ProfileRefused) as e:
        C.load_csv(spark, long, multiline=multiline)
    assert e.value.code == "UNPARSEABLE_CSV"


def test_long_integers(spark, tmp_path):
    path = write(tmp_path / "ids.csv", "key,huge,neg,name\n18446744073709551615,99999999999999999999999,-1,a\n5,1,18446744073709551615,b\n")
    df = C.load_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["decimal(20,0)", "string", "string", "string"]
    assert {r.key for r in df.collect()} == {Decimal(18446744073709551615), Decimal(5)}
    assert {r.huge for r in df.collect()} == {"99999999999999999999999", "1"}
    frame = pd.read_csv(path)
    assert [str(t) for t in frame.dtypes[:3]] == ["uint64", "object", "object"]


def test_kinds_join_in_any_order(spark):
    values = [None, "1", "-3", "18446744073709551615", "1.5", "True", "x", " 7 ", "99999999999999999999"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(C.value_kinds(C.col_("v")).alias("k")).collect()
    kinds = [r.k for r in df]
    assert kinds[:7] == [C.GAP, C.INT64, C.INT64 | C.NEGATIVE, C.UINT64, C.REAL, C.BOOL, C.TEXT] and kinds[8] == C.HUGE
