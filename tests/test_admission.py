"""CSV admission: one file per refusal code."""

import os

import pytest

from factsheet import ProfileRefused, profile_table
from factsheet.sources import csv as C


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


@pytest.mark.parametrize("name,text,code", [
    ("empty.csv", "", "EMPTY_DATASET"),
    ("header_only.csv", "id,age,city,churn\n", "HEADER_ONLY"),
    ("single.csv", "only_column\n1\n2\n", "SINGLE_COLUMN"),
    ("dups.csv", "id,age,id,churn\n1,2,3,4\n", "DUPLICATE_COLUMNS"),
    ("ragged.csv", "a,b,c\n1,2\n1,2,3,4\n", "UNPARSEABLE_CSV"),
])
def test_refusals(spark, tmp_path, name, text, code):
    p = _write(str(tmp_path), name, text)
    with pytest.raises(ProfileRefused) as e:
        C.load_csv(spark, p)
    assert e.value.code == code


def test_short_rows_padded_and_na_tokens(spark, tmp_path):
    p = _write(str(tmp_path), "ok.csv", "﻿a,b,c\n1,n/a,x\n2,3\n4,NULL,\n")
    df = C.load_csv(spark, p)
    rows = [tuple(r) for r in df.orderBy("a").collect()]
    assert df.columns == ["a", "b", "c"]
    assert rows == [(1, None, "x"), (2, 3.0, None), (4, None, None)]


def test_native_types_are_applied(spark, tmp_path):
    p = _write(str(tmp_path), "typed.csv", "id,year,amount,flag,churn\n1,2001,1.5,True,a\n2,1999,2,false,b\n3,2024,0.25,TRUE,a\n")
    df = C.load_csv(spark, p)
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "double", "boolean", "string"]
    assert [r.flag for r in df.orderBy("id").collect()] == [True, False, True]
    cols = {r["name"]: r for r in profile_table(df, "churn").columns.collect()}
    assert not any("numeric_as_string" in r["flags"] for r in cols.values())
    assert cols["year"]["inferred_type"].startswith("numeric")


@pytest.mark.parametrize("line,want", [
    ('1,"He said ""hi"", ok",x', ("He said \"hi\", ok", "x")),
    ('1,"say ""hi"" now",x', ('say "hi" now', "x")),
    ('1,"C:\\",y', ("C:\\", "y")),
])
def test_quoted_fields(spark, tmp_path, line, want):
    p = _write(str(tmp_path), "quoted.csv", f"a,b,c\n{line}\n")
    assert tuple(C.load_csv(spark, p).first())[1:] == want


def test_newline_in_quotes(spark, tmp_path):
    p = _write(str(tmp_path), "lines.csv", 'a,b\n1,"two\nlines"\n2,x\n')
    with pytest.raises(ProfileRefused) as e:
        C.load_csv(spark, p)
    assert e.value.code == "UNPARSEABLE_CSV"
    assert sorted(map(tuple, C.load_csv(spark, p, multiline=True).collect())) == [(1, "two\nlines"), (2, "x")]


@pytest.mark.parametrize("multiline", [False, True])
def test_open_quote_and_bad_bytes(spark, tmp_path, multiline):
    p = _write(str(tmp_path), "open.csv", 'a,b\n1,"open\n2,x\n')
    q = os.path.join(str(tmp_path), "bytes.csv")
    with open(q, "wb") as f:
        f.write(b"a,b\n1,caf\xe9\n2,x\n")
    for path in (p, q):
        with pytest.raises(ProfileRefused) as e:
            C.load_csv(spark, path, multiline=multiline)
        assert e.value.code == "UNPARSEABLE_CSV"


def test_headers_of_all_files(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    _write(str(d), "1.csv", "a,b\n1,2\n")
    _write(str(d), "2.csv", "a,b\n3,4\n")
    assert sorted(map(tuple, C.load_csv(spark, str(d)).collect())) == [(1, 2), (3, 4)]
    _write(str(d), "3.csv", "b,a\n5,6\n")
    with pytest.raises(ProfileRefused) as e:
        C.load_csv(spark, str(d))
    assert e.value.code == "UNPARSEABLE_CSV"


def test_dotted_and_quoted_names(spark, tmp_path):
    p = _write(str(tmp_path), "names.csv", "a.b,c`d,e\n1,2,x\n3,4,y\n")
    df = C.load_csv(spark, p)
    assert df.columns == ["a.b", "c`d", "e"]
    assert {r["column_name"]: r["native_type"] for r in C.native_types(df).collect()} == {"a.b": "int64", "c`d": "int64", "e": "object"}


def test_duplicate_names_each_once_in_order(spark):
    assert C.duplicate_headers(spark, ["id", "x", "ID", "id", "x", "id"]) == ["id", "x"]


def test_column_cap(spark, tmp_path):
    for n, ok in ((1000, True), (1001, False)):
        head = ",".join(f"c{i}" for i in range(n))
        row = ",".join("1" for _ in range(n))
        p = _write(str(tmp_path), f"w{n}.csv", head + "\n" + row + "\n")
        if ok:
            assert len(C.load_csv(spark, p, max_cols=1000).columns) == n
        else:
            with pytest.raises(ProfileRefused) as e:
                C.load_csv(spark, p, max_cols=1000)
            assert e.value.code == "TOO_MANY_COLUMNS"


def test_native_types(spark):
    df = spark.createDataFrame([(" 1", "1.5", "True", "x", None), ("2", "2", "false", "1", None)],
                               "a string, b string, c string, d string, e string")
    got = {r["column_name"]: r["native_type"] for r in C.native_types(df).collect()}
    assert got == {"a": "int64", "b": "float64", "c": "bool", "d": "object", "e": "float64"}
