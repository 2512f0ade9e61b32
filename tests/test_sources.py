"""Sources and sinks: L1 load with blank/NA -> null, L2 load-or-create,
L3 versions, L5 admission."""

import pytest

from pyspark.sql import types as T

from leadsmith.sources.io import (
    NA_WORDS,
    append_rows,
    captured_pages,
    load_latest,
    load_or_create,
    load_table,
    version_path,
    write_version,
)
from tests.conftest import rows

SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("date", T.StringType()),
                       T.StructField("url_checked", T.BooleanType())])


def test_load_csv_blank_and_na_words(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('url,date,url_checked\nu1,,true\nu2,  ,false\nu3,N/A,\nu4,2024-01-01,true\n')
    df = load_table(spark, str(p), SCHEMA, fmt="csv", na_words=NA_WORDS)
    assert rows(df) == [("u1", None, True), ("u2", None, False), ("u3", None, None), ("u4", "2024-01-01", True)]


def test_versions_of_a_table(spark, tmp_path):
    root = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        load_latest(spark, root)
    empty, version = load_or_create(spark, root, SCHEMA)
    assert empty.count() == 0 and version == 1
    data = spark.createDataFrame([("u1", "d1", None)], SCHEMA)
    # the new version is produced from a plan that reads the current one
    write_version(empty.unionByName(data), root, 2)
    latest, version = load_or_create(spark, root, SCHEMA)
    assert rows(latest) == [("u1", "d1", None)] and version == 2
    assert spark.read.schema(SCHEMA).parquet(version_path(root, 1)).count() == 0   # untouched
    with pytest.raises(Exception, match="already exists"):      # a second writer of the same version
        write_version(data, root, 2)


def test_an_incomplete_version_is_not_current(spark, tmp_path):
    root = tmp_path / "state"
    write_version(spark.createDataFrame([("u1", "d1", None)], SCHEMA), str(root), 1)
    (root / "v=2").mkdir()
    assert load_latest(spark, str(root))[1] == 1


def test_append_keeps_duplicates(spark, tmp_path):
    path = str(tmp_path / "master")
    df = spark.createDataFrame([("a@x.example",)], "email string")
    append_rows(df, path)
    append_rows(df, path)
    assert spark.read.parquet(path).count() == 2


def test_admission(spark):
    html = "ab" + "é" * 5
    df = spark.createDataFrame([(1, html, 200, "text/html; charset=utf-8"), (2, html, 404, "text/html"),
                                (3, html, 200, "application/json"), (4, html, 200, None)],
                               "page_id long, html string, status int, content_type string")
    assert [(r.page_id, r.html) for r in captured_pages(df).collect()] == [(1, html)]
    assert captured_pages(df.drop("status", "content_type")).count() == 4
