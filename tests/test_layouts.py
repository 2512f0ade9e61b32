"""Laid-out tables: what a plan reads and shuffles; broken records; findings per domain; stateful keep-first."""

import re
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsmith.operators.dedupe import anti_master
from leadsmith.operators.mailbox import domain_addresses, domain_summary
from leadsmith.operators.master import append_to_master, not_in_master, open_master
from leadsmith.operators.state import state_load
from leadsmith.sources.io import append_by_day, load_period, load_with_rejects
from leadsmith.streaming.ingest import earliest_to_table, landed_files
from tests.conftest import rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("null_known", [False, True])
def test_the_master_is_joined_without_an_exchange(spark, tmp_path, no_broadcast, null_known):
    schema = T.StructType.fromDDL("email string, n int")
    name = f"m_{uuid.uuid4().hex}"
    open_master(spark, name, str(tmp_path / "m"), schema, "email", 8)
    old = [(f"a{k}", k) for k in range(0, 200, 2)] + ([(None, -1)] if null_known else [])
    append_to_master(spark.createDataFrame(old[:50], schema), name, "email", 8)
    append_to_master(spark.createDataFrame(old[50:], schema), name, "email", 8)
    new = spark.createDataFrame([(f"a{k}", k) for k in range(200)] + [(None, 7), ("a3", 8)], schema)
    got = not_in_master(new, spark.table(name), "email")
    assert rows(got) == rows(anti_master(new, spark.table(name), "email"))
    plan = _plan(got).split("\n+- == Initial Plan ==")[0]      # as it was run
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 8 out of 8" in plan
    # One of the batch's rows; the look for a null key needs a single number of the master.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    again = open_master(spark, name, str(tmp_path / "m"), schema, "email", 8)
    assert again.count() == len(old)


def test_a_period_reads_its_days_only(spark, tmp_path):
    df = spark.createDataFrame([(k, f"2024-01-{k + 1:02d} 13:00:00") for k in range(31)] + [(99, None)], "k int, at string") \
        .withColumn("ts", F.to_timestamp("at"))
    append_by_day(df, str(tmp_path / "t"), "ts")
    for period, want in ((0, [30]), (1, [29]), (7, list(range(23, 31)))):
        got = load_period(spark, str(tmp_path / "t"), period, "2024-01-31")
        assert rows(got, "k") == [(k,) for k in want] and got.columns == df.columns
        assert re.search(r"PartitionFilters: \[.*day", _plan(got))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 32


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_no_line_is_lost(spark, tmp_path, fmt):
    lines = {"csv": ["k,v", "1,a", "x,b", "2,", "3,c,d", '4,"e,f"', "5"],
             "json": ['{"k": 1, "v": "a"}', '{"k": "x", "v": "b"}', '{"k": 2, "v": " "}', '{"k": 3', '{"k": 4, "v": "e,f"}', "no json"]}[fmt]
    (tmp_path / "f").write_text("\n".join(lines) + "\n")
    kept, rejects = load_with_rejects(spark, str(tmp_path / "f"), T.StructType.fromDDL("k long, v string"), fmt)
    assert rows(kept) == [(1, "a"), (2, None), (4, "e,f")]
    want = {"csv": ["x,b", "3,c,d", "5"], "json": ['{"k": "x", "v": "b"}', '{"k": 3', "no json"]}[fmt]
    assert sorted(r.line for r in rejects.select("line").collect()) == sorted(want)
    assert kept.select("v").count() == 3 and rejects.count() == 3 and rejects.first().file.endswith("/f")
    with pytest.raises(ValueError):
        load_with_rejects(spark, str(tmp_path), T.StructType.fromDDL("k long"), "parquet")


def test_findings_per_domain(spark):
    found = spark.createDataFrame([("d", "u1", "text", "a@d"), ("d", "u1", "raw", "a@d"), ("d", "u2", "raw", "a@d"),
                                   ("d", "u2", "raw", "b@d"), ("e", "u3", "cf", "c@e")],
                                  "domain string, url string, source string, email string")
    assert rows(domain_summary(found)) == [("d", 2, 2, 2), ("e", 1, 1, 1)]
    assert [tuple(r) for r in domain_addresses(found).orderBy("email").collect()] == [
        ("d", "a@d", 2, ["raw", "text"]), ("d", "b@d", 1, ["raw"]), ("e", "c@e", 1, ["cf"])]
    exchanges = re.findall(r"hashpartitioning\((.*?), \d+", _plan(domain_summary(found)))
    assert len(exchanges) == 2      # by domain and value, then by domain


def test_the_earliest_row_of_a_key_over_all_batches(spark, tmp_path):
    batches = [[(1, 50, "a"), (2, 10, "b"), (None, 5, "n")], [(1, 20, "c"), (3, 1, "d")], [(1, 90, "e"), (2, 9, "f"), (None, 4, "m")]]
    schema = "k int, ts long, v string"
    for b, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = landed_files(spark, str(tmp_path / "in"), T.StructType.fromDDL(schema), max_files_per_trigger=1)
        earliest_to_table(stream, ["k"], ["ts"], str(tmp_path / "out"), str(tmp_path / "cp"), buckets=4)
        seen = [r for x in batches[:b + 1] for r in x]
        want = {k: min((ts, v) for q, ts, v in seen if q == k) for k in {r[0] for r in seen}}
        got = state_load(spark, str(tmp_path / "out")).collect()
        assert {r.k: (r.ts, r.v) for r in got} == want and len(got) == len(want)
