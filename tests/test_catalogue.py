"""Catalogue snapshots under competing and killed writers, file listing, checked JSON and the selection chain."""

import json
import os
import time

import pytest
from pyspark.sql import types as ST

from factsheet.operators import catalog as K
from factsheet.operators import selection as S
from factsheet.operators.snapshots import Catalogue

NOW, OLD = "2024-05-02 12:00:00", "2024-04-01 00:00:00"


def rows(spark, *ids, at="2024-05-02 10:00:00", n=1):
    return spark.createDataFrame([(i, f"{i}.csv", f"up/{i}.csv", n, 2, "[]", at) for i in ids],
                                 "dataset_id string, filename string, stored_path string, n_rows bigint, n_columns bigint, columns_json string, created_at string")


def ids(df):
    return sorted(r.dataset_id for r in df.collect())


def test_insert_profile_get_and_expire(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path / "cat"))
    assert c.head() == (0, []) and c.snapshot().count() == 0 and c.expire(NOW)[0] == 0
    c.insert(rows(spark, "a", "b"))
    c.insert(rows(spark, "old", at=OLD))
    c.insert(rows(spark, "b", n=9))  # the last write counts
    for text in ("first", "second"):
        c.save_profiles(spark.createDataFrame([("a", text, False), ("unknown", text, True)], "dataset_id string, profile_json string, task_overridden boolean"))
    got = {r.dataset_id: (r.n_rows, r.profile_json, r.state) for r in c.snapshot().collect()}
    assert got == {"a": (1, "second", "complete"), "b": (9, None, "pending"), "old": (1, None, "pending")}
    asked = spark.createDataFrame([("a",), ("old",), ("never",), (None,)], "dataset_id string")
    assert ids(c.get(asked, NOW)) == ["a"]  # unknown and expired look the same
    n, gone = c.expire(NOW)
    assert n == 1 and [tuple(r) for r in gone.collect()] == [("old", "up/old.csv")]
    assert ids(c.snapshot()) == ["a", "b"] and len(c.head()[1]) == 1
    assert {r.dataset_id: r.profile_json for r in c.snapshot().collect()} == {"a": "second", "b": None}


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    one, two = (Catalogue(spark, str(tmp_path / "cat")) for _ in range(2))
    one.insert(rows(spark, "old", at=OLD))
    publish, raced = one._publish, []

    def late(number, folders):
        if not raced:  # the other writer commits between this one's reading and its commit
            raced.append(number)
            two.insert(rows(spark, f"other{len(folders)}"))
        return publish(number, folders)

    monkeypatch.setattr(one, "_publish", late)
    one.insert(rows(spark, "mine"))
    assert ids(one.snapshot()) == ["mine", "old", "other2"]
    raced.clear()
    assert one.expire(NOW)[0] == 1  # lost the race once and started over
    assert ids(two.snapshot()) == ["mine", "other1", "other2"]


def test_killed_writer_leaves_a_readable_catalogue(spark, tmp_path, monkeypatch):
    c = Catalogue(spark, str(tmp_path / "cat"))
    c.insert(rows(spark, "a"))
    before = c.head()

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(c, "_publish", killed)
    for write in (lambda: c.insert(rows(spark, "b")), lambda: c.expire("2030-01-01 00:00:00")):
        with pytest.raises(KeyboardInterrupt):
            write()
    (tmp_path / "cat" / "commits" / "draft-0").write_text("[\"half")
    again = Catalogue(spark, str(tmp_path / "cat"))
    assert again.head() == before and ids(again.snapshot()) == ["a"]


def test_orphan_files_by_listing_and_age(spark, tmp_path):
    for name, old in (("a/1.csv", True), ("a/2.csv", True), ("b/3.csv", False), ("b/4.csv", True), ("b/note.txt", True)):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text("x,y\n1,2\n")
        if old:
            os.utime(f, (time.time() - 90000, time.time() - 90000))
    files = K.stored_files(spark, str(tmp_path), "*.csv")
    assert files.count() == 4 and K.stored_files(spark, str(tmp_path / "none")).count() == 0
    named = files.where("stored_path LIKE '%/1.csv'").select("stored_path")
    as_of = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())
    orphans = K.orphan_files(files, named, "stored_path", "modified_at", as_of)
    assert sorted(r.stored_path[-5:] for r in orphans.collect()) == ["2.csv", "4.csv"]
    assert K.remove_files(orphans) == 2 and not (tmp_path / "a/2.csv").exists() and (tmp_path / "b/3.csv").exists()


def test_checked_json_paths(spark):
    schema = ST.StructType([ST.StructField("n", ST.LongType(), False), ST.StructField("tags", ST.ArrayType(ST.StringType(), False), True),
                            ST.StructField("deep", ST.StructType([ST.StructField("x.y", ST.DoubleType(), False)]), True)])
    texts = {'{"n": 1}': ("valid", None), '{"n": 1, "tags": ["a", null]}': ("mismatch", "$.tags[1]"), '{"n": 1, "tags": "a"}': ("mismatch", "$.tags"),
             '{"n": 1, "deep": {}}': ("mismatch", "$.deep.x.y"), '{"n": 1, "deep": {"x.y": 2}}': ("valid", None), '{"n": null}': ("mismatch", "$.n"),
             "": ("malformed", None), "null": ("mismatch", "$"), "{": ("malformed", None), '{"n": 1, "deep": 5}': ("mismatch", "$.deep")}
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "profile_json string")
    got = {r.profile_json: (r.status, r.failed_path) for r in S.check_json(docs, schema).collect()}
    assert got == {**texts, None: ("missing", None)}


def test_selection_chain_edges(spark):
    dataset = spark.createDataFrame([("d", "t", 5), ("e", "t", 1)], "dataset_id string, target_column string, n_columns bigint")
    names = [("d", 0, "w", [], 0.1), ("d", 1, "x", ["flag"], None), ("d", 2, "t", [], None), ("d", 3, "y", [], 0.9), ("d", 4, "z", [], 0.9), ("e", 0, "t", [], None)]
    columns = spark.createDataFrame(names, "dataset_id string, ordinal int, name string, flags array<string>, target_association double")
    asked = spark.createDataFrame([("d", "z", 0), ("d", "z", 1), ("d", "w", 2), ("e", "z", 0)], "dataset_id string, requested string, place int")
    read = lambda df: {r.dataset_id: (json.loads(r.profile_json), r.refused) for r in df.collect()}
    got = read(S.prompt_json(dataset, columns, asked, budget=2))
    d, refused = got["d"]
    assert [c["name"] for c in d["columns"]] == ["x", "t"] and d["columns_omitted_from_this_prompt"] == 1 and d["n_columns"] == 5
    assert d["columns_excluded_by_user"] == ["z", "w"] and refused == []
    assert got["e"][1] == ["z"] and set(got["e"][0]) == {"target_column", "n_columns", "columns"}
    plain, _ = read(S.prompt_json(dataset, columns))["d"]
    assert [c["name"] for c in plain["columns"]] == ["w", "x", "t", "y", "z"] and "columns_omitted_from_this_prompt" not in plain
