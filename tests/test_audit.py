"""Audits in the pass that writes (A1, P7, P9): counts, order of the steps, lists and tables."""

import pytest
from pyspark.sql import functions as F

from leadsmith.operators.audit import contact_steps, funnel, observation_row, observed, posting_steps, record_steps
from leadsmith.operators.filters import missing_fields
from leadsmith.plans.flows import (
    audited_contacts,
    audited_postings,
    clean_contacts,
    clean_postings,
    contact_funnel_counts,
    posting_funnel_counts,
    search_domains,
)
from tests.conftest import rows

CONTACTS = [(1, "c", "p", "a@ok.example"), (2, "c", "p", "b@hays.de"), (3, "d", "q", "a@ok.example"), (4, "d", "q", None),
            (5, "e", "r", "old@ok.example"), (6, "e", "r", None), (7, "f", "s", "x@sub.hays.de"), (8, "f", "s", "old@ok.example")]


def _contacts(spark):
    return spark.createDataFrame(CONTACTS, "ingest_seq long, company string, person string, email string")


def _written(df, tmp_path, name="out"):
    df.write.parquet(str(tmp_path / name))
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


@pytest.mark.parametrize("as_table", [False, True])
@pytest.mark.parametrize("known", [["old@ok.example", "old@ok.example"], ["old@ok.example", None], []])
def test_contacts_and_funnel_from_one_pass(spark, tmp_path, as_table, known):
    master = spark.createDataFrame([(k,) for k in known], "email string")
    blocked = ["hays.de"]
    block = spark.createDataFrame([(t,) for t in blocked], "term string") if as_table else blocked
    kept, seen = audited_contacts(_contacts(spark), master, block)
    out = _written(kept, tmp_path)
    assert rows(out, "company", "person", "email") == rows(clean_contacts(_contacts(spark), master, blocked), "company", "person", "email")
    got = observation_row(spark, seen, contact_steps()).first().asDict()
    assert got == contact_funnel_counts(_contacts(spark), master, block).first().asDict()
    n_known = 0 if not known else 2 if None in known else 1
    assert got == {"input": 8, "duplicates": 3, "already_known": n_known, "excluded": 2, "removed": 5 + n_known,
                   "left": out.count()}
    assert got["removed"] == got["duplicates"] + got["already_known"] + got["excluded"] == got["input"] - got["left"]


@pytest.mark.parametrize("terms", [["sap", " Java"], ["  SAP "], []])
def test_postings_funnel_follows_the_rules_of_the_result(spark, tmp_path, terms):
    raw = spark.createDataFrame([("SAP Berater", "x"), ("Rust", "y"), ("no-break sap", "z"), (None, "q"), ("SAP", None),
                                 (" java", "w")], "project_name string, person string")
    want = rows(clean_postings(raw, terms))
    table = spark.createDataFrame([(t,) for t in terms] + [(None,), (" ",)], "term string")
    for k, given in enumerate((terms, table)):
        kept, seen = audited_postings(raw, given)
        assert rows(_written(kept, tmp_path, str(k))) == want
        got = observation_row(spark, seen, posting_steps()).first().asDict()
        assert got == posting_funnel_counts(raw, given).first().asDict()
        assert got["left"] == len(want) and got["input"] == 6 == got["incomplete"] + got["excluded"] + got["left"]


def test_records_are_counted_for_each_missing_field(spark, tmp_path):
    df = spark.createDataFrame([("u", "a", None), ("u", " ", None), ("u", "b", "c"), (None, "b", "c")],
                               "url string, company string, email string")
    names = ["url", "company", "email"]
    flagged, seen = observed(df.withColumn("missing", missing_fields(names)), record_steps(names))
    _written(flagged.where(F.size("missing") == 0), tmp_path)
    assert observation_row(spark, seen, record_steps(names)).first().asDict() == {
        "input": 4, "without_url": 1, "without_company": 1, "without_email": 2, "removed": 3, "left": 1}


def test_an_empty_table_counts_zero(spark, tmp_path):
    none = _contacts(spark).limit(0)
    kept, seen = audited_contacts(none, none.select("email"), ["x.example"])
    _written(kept, tmp_path)
    assert set(observation_row(spark, seen, contact_steps()).first().asDict().values()) == {0}
    assert set(funnel(none.selectExpr("1 AS n", "true AS known", "true AS blocked"), contact_steps()).first().asDict().values()) == {0}


def test_rejected_domains_are_listed_and_counted(spark, tmp_path):
    contacts = spark.createDataFrame([(1, "a@Acme.example"), (2, "b@acme.example"), (3, "c@intranet"), (4, "no address"),
                                      (5, None), (6, "d@jobs.aplitrak.com"), (7, "e@old.example")], "seq long, email string")
    master = spark.createDataFrame([("old.example", None)], "domain string, email_common string")
    got = search_domains(contacts, master, str(tmp_path / "run"))
    assert rows(got["ready"]) == [("acme.example", "acme.example")]
    assert sorted(rows(got["rejected"]), key=str) == [("intranet", 1), (None, 2)]
    f = got["funnel"].first().asDict()
    assert f == {"input": 7, "excluded": 1, "already_known": 1, "duplicates": 2, "invalid": 2, "removed": 6, "left": 1}
    assert f["removed"] == f["excluded"] + f["already_known"] + f["duplicates"] + f["invalid"]
