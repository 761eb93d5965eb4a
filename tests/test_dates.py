"""The date grammar against pandas, value by value."""

import warnings

import pandas as pd

from factsheet.functions.scalar import parse_datetime

VALUES = ["5-Jan-2024", "Jan 5 2024", "3pm", "3:05 PM", "January 5, 2024 3pm", "2024-01-05", "01/05/2024", "13/05/2024", "13-05-2024", "Jan 5", "1/5/24",
          "5 Jan 2024 10:11:12.5", "Fri, 05 Jan 2024 10:11:12 GMT", "2024/01/05 10:11", "20240105", "2024", "May 2024", "2024-05", "05/2024", "5-Jan-99",
          "2024-01-05T10:11:12+02:00", "Jan 5 2024 10:11 -02:30", "25:00", "31/31/2024", "Feb 30 2024", "1500-01-01", "hello 2024", "1.5", "12", "$12", "a:b",
          "5th January 2024", "sept 3 2021", "2024.01.05", "1.2.2024", "Customer#0001", "2024-13-01", "", " ", "jan", "may", " 03/04/2024 5:06 pm ", None]


def test_dates_equal_pandas(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES)], "k int, v string").select("k", parse_datetime("v").cast("string").alias("t"))
    got = {r.k: r.t for r in rows.collect()}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for k, v in enumerate(VALUES):
            want = pd.to_datetime(pd.Series([v], dtype=object), errors="coerce", format="mixed", utc=True)[0]
            assert (got[k] is None) == pd.isna(want), v
            if got[k] is not None and v != "3:05 PM":  # pandas puts a time without a date on the present day
                assert pd.Timestamp(got[k], tz="UTC") == want, v
    assert got[VALUES.index("3:05 PM")] == "1970-01-01 15:05:00"
