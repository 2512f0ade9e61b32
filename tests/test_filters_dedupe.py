"""Blocklist, keep-first, title exclusion, null filter (FIXTURES.md)."""

import datetime as dt

import pytest

from leadsmith.functions.text import email_domain_first, email_domain_last
from leadsmith.operators.dedupe import anti_master, keep_first
from leadsmith.operators.filters import (
    drop_any_null,
    drop_incomplete,
    email_blocklist,
    exclude_terms,
    recency_filter,
)
from leadsmith.sources.lookups import TITLE_TERMS
from tests.conftest import rows, terms_df

BLOCK = ["hays.example", "x@full.example"]
EMAILS = ["u@hays.example", "u@sub.hays.example", "u@thehays.example", " X@Full.example ",
          "hays.example", None, None, "A@ok.example", "a@ok.example", "u@a@hays.example"]


def _df(spark):
    return spark.createDataFrame([(i, e) for i, e in enumerate(EMAILS)], "seq long, email string")


def test_blocklist_literal_suffix(spark):
    kept = [r.email for r in email_blocklist(_df(spark), "email", BLOCK).orderBy("seq").collect()]
    assert kept == [None, None, "A@ok.example", "a@ok.example"]


def test_blocklist_boundary(spark):
    kept = [r.email for r in email_blocklist(_df(spark), "email", BLOCK, boundary=True).orderBy("seq").collect()]
    assert kept == ["u@thehays.example", None, None, "A@ok.example", "a@ok.example"]


def test_blocklist_long_list_join_path_matches_inline(spark):
    many = terms_df(spark, BLOCK + [f"filler{i}.example" for i in range(400)])
    for boundary in (False, True):
        a = email_blocklist(_df(spark), "email", BLOCK, boundary=boundary)
        b = email_blocklist(_df(spark), "email", many, boundary=boundary)
        assert rows(a) == rows(b)


def test_keep_first_nulls_and_case(spark):
    df = email_blocklist(_df(spark), "email", BLOCK)
    raw = rows(keep_first(df, "email", "seq"), "seq", "email")
    assert raw == [(5, None), (7, "A@ok.example"), (8, "a@ok.example")]
    norm = rows(keep_first(df, "email", "seq", normalize_key=True), "seq", "email")
    assert norm == [(5, None), (7, "A@ok.example")]


def test_keep_first_one_row_per_key_with_hot_key(spark):
    data = [(i, "hot@x.example" if i % 3 == 0 else f"k{i}@x.example") for i in range(3000)]
    df = spark.createDataFrame(data, "seq long, email string")
    out = keep_first(df, "email", "seq")
    assert out.count() == out.select("email").distinct().count() == 2001
    assert out.where("email = 'hot@x.example'").first().seq == 0


def test_domain_first_vs_last_at(spark):
    df = spark.createDataFrame([("u@a@hays.example",), ("nobody",), (None,)], "e string")
    got = [(r.f, r.l) for r in df.select(email_domain_first("e").alias("f"), email_domain_last("e").alias("l")).collect()]
    assert got == [("a@hays.example", "hays.example"), (None, "nobody"), (None, None)]


def test_anti_master_null_safe(spark):
    new = spark.createDataFrame([("a",), (None,), ("b",)], "email string")
    m1 = spark.createDataFrame([("a",)], "email string")
    m2 = spark.createDataFrame([("a",), (None,)], "email string")
    assert set(rows(anti_master(new, m1, "email"))) == {("b",), (None,)}
    assert set(rows(anti_master(new, m2, "email"))) == {("b",)}


def test_title_terms(spark):
    df = spark.createDataFrame([("SAP Berater",), ("Sapient Rollout",), ("Python Dev",), (None,)], "project_name string")
    assert rows(exclude_terms(df, "project_name", TITLE_TERMS)) == [("Python Dev",), (None,)]
    for n in (0, 300, 2000):
        table = terms_df(spark, TITLE_TERMS + [f"zz{i}" for i in range(n)])
        assert rows(exclude_terms(df, "project_name", table)) == [("Python Dev",), (None,)]
    assert rows(exclude_terms(df, "project_name", terms_df(spark, []))) == rows(df)


def test_wild_lists_keep_the_same_rows_in_either_form(spark):
    terms = ["\u00a0dev", " SAP ", "a.b*", "", None, "  ", "ß", "x" * 600]
    df = spark.createDataFrame([(v,) for v in ["SAP dev", "sap", "\u00a0dev", "a.b*c", "aXb", "", None, "STRASSE ß", "x" * 700]],
                               "v string")
    for n in (0, 301):
        more = terms + [f"never{i}" for i in range(n)]
        assert rows(exclude_terms(df, "v", more)) == rows(exclude_terms(df, "v", terms_df(spark, more)))
    block = [".", "..", " .x.de", "A@b.de", "", None, "c.de"]
    mails = spark.createDataFrame([(v,) for v in ["", "x@", "a@b.de", "u@x.de", "u@yx.de", "c.de", None, "@c.de"]], "v string")
    for n in (0, 301):
        for boundary in (False, True):
            more = block + [f"never{i}.example" for i in range(n)]
            assert rows(email_blocklist(mails, "v", more, boundary=boundary)) == \
                rows(email_blocklist(mails, "v", terms_df(spark, more), boundary=boundary))


def test_drop_any_null_and_incomplete(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (" ", "b")], "x string, y string")
    assert rows(drop_any_null(df)) == [(" ", "b"), ("a", "b")]
    assert rows(drop_incomplete(df, ["x", "y"])) == [("a", "b")]


def test_recency_periods(spark):
    ts = [dt.datetime(2024, 1, d, 12) for d in (20, 22, 23, 29, 30, 31)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, ts timestamp")
    pick = lambda p: [r.i for r in recency_filter(df, "ts", p, "2024-01-30").orderBy("i").collect()]
    assert pick(0) == [4]
    assert pick(1) == [3]
    assert pick(7) == [2, 3, 4]
    with pytest.raises(ValueError):
        recency_filter(df, "ts", 3, "2024-01-30")


def test_recency_filter_reaches_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = recency_filter(df, "ts", 7, "2024-01-30")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
