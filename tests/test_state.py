"""State tables by buckets (U4-U6, C9): what is rewritten, what stays."""

import os

import pytest
from pyspark.sql import functions as F

from leadsmith.operators import state
from leadsmith.operators.state import bucket_of, put_buckets, state_create, state_load, state_update
from leadsmith.operators.tables import apply_changes, delete_keys
from tests.conftest import rows

CHANGES = "seq long, url string, column string, value string"


def _base(spark, n=400):
    return spark.createDataFrame([(f"u{k}", f"d{k}", None) for k in range(n)] + [("u1", "twice", "x"), (None, "null", "z")],
                                 "url string, date string, flag string")


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "state")
    state_create(root, _base(spark), buckets=64)
    before = _files(root)
    changes = spark.createDataFrame([(1, "u3", "flag", "a"), (2, "u1", "status", "new"), (3, "fresh", "flag", "b"),
                                     (4, None, "flag", "no")], CHANGES)
    touched = state_update(root, changes)
    after = _files(root)
    names = {f"bucket={b}" for b in touched}
    assert len(touched) <= 3
    assert {p for p in before if p in after and before[p] == after[p]} == {p for p in before if p.split(os.sep)[-2] not in names}
    assert rows(state_load(spark, root), "url", "date", "flag", "status") == rows(
        apply_changes(_base(spark), changes), "url", "date", "flag", "status")


def test_columns_of_earlier_batches_stay(spark, tmp_path):
    root, want = str(tmp_path / "state"), _base(spark)
    state_create(root, want, buckets=16)
    for k in range(3):
        changes = spark.createDataFrame([(1, f"u{7 * k}", f"added{k}", str(k)), (2, f"u{k}", "flag", f"f{k}")], CHANGES)
        deletes = spark.createDataFrame([(f"u{300 + k}",), (None,)], "url string")
        state_update(root, changes, deletes)
        want = delete_keys(apply_changes(want, changes), deletes)
    columns = ["url", "date", "flag", "added0", "added1", "added2"]
    assert rows(state_load(spark, root), *columns) == rows(want, *columns)


def test_an_emptied_bucket_is_removed_and_an_update_can_be_repeated(spark, tmp_path):
    root = str(tmp_path / "state")
    base = _base(spark, 20)
    state_create(root, base, buckets=64)
    gone = base.where("url = 'u5'").select("url")
    for _ in range(2):
        state_update(root, deletes=gone)
        assert rows(state_load(spark, root), "url") == rows(base.where("url IS NULL OR url <> 'u5'"), "url")


def test_all_rows_deleted_and_a_table_created_empty(spark, tmp_path):
    root, base = str(tmp_path / "state"), _base(spark, 20).where("url IS NOT NULL")
    state_create(root, base, buckets=64)
    state_update(root, deletes=base.select("url"))
    assert state_load(spark, root).count() == 0 and state_load(spark, root).columns == base.columns
    state_update(root, spark.createDataFrame([(1, "u3", "flag", "a")], CHANGES))
    assert rows(state_load(spark, root)) == [("u3", None, "a")]
    assert {r[0] for r in spark.read.parquet(root).select("bucket").distinct().collect()} \
        == {base.where("url = 'u3'").select(bucket_of("url", 64)).first()[0]}
    state_create(str(tmp_path / "none"), base.limit(0), buckets=4)
    state_update(str(tmp_path / "none"), spark.createDataFrame([(1, "u3", "flag", "a")], CHANGES))
    assert rows(state_load(spark, str(tmp_path / "none"))) == [("u3", None, "a")]


def test_an_update_that_broke_off_is_finished_from_its_files(spark, tmp_path, monkeypatch):
    root, kept = str(tmp_path / "state"), {}
    state_create(root, _base(spark), buckets=8)
    monkeypatch.setattr(state, "put_buckets", lambda *a: kept.update(args=a))
    changes = spark.createDataFrame([(1, "u3", "flag", "a")], CHANGES)
    state_update(root, changes)
    assert rows(state_load(spark, root), "url", "flag") == rows(_base(spark), "url", "flag")
    for _ in range(2):
        put_buckets(*kept["args"])
        assert rows(state_load(spark, root), "url", "flag") == rows(apply_changes(_base(spark), changes), "url", "flag")


def test_null_and_hot_keys(spark, tmp_path):
    root = str(tmp_path / "state")
    base = spark.createDataFrame([("hot" if i % 3 == 0 else None if i % 3 == 1 else f"u{i}", f"d{i}", None) for i in range(3_000)],
                                 "url string, date string, flag string")
    state_create(root, base, buckets=4)
    changes = spark.createDataFrame([(1, "hot", "flag", "a")], CHANGES)
    state_update(root, changes)
    got = state_load(spark, root)
    assert got.count() == 3_000 and got.where("url IS NULL AND flag IS NULL").count() == 1_000
    assert got.where("url = 'hot' AND flag = 'a'").count() == 1_000


def test_wrong_use_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        state_load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        state_update(str(tmp_path / "none"))
    state_create(str(tmp_path / "one"), _base(spark, 3), buckets=2)
    assert state_update(str(tmp_path / "one"), deletes=spark.createDataFrame([(None,)], "url string")) == []
    with pytest.raises(Exception, match="already exists"):
        state_create(str(tmp_path / "one"), _base(spark, 3).select("url", F.lit(1).alias("n")))
