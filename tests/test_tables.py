"""Keyed table changes, merges and snapshots (FIXTURES.md 'URL state', 'Master')."""


from leadsmith.operators.tables import (
    accumulate_merge,
    append_union,
    apply_changes,
    delete_keys,
    rejected_changes,
)
from leadsmith.plans.flows import append_master, clean_contacts, url_state_create, url_state_update
from leadsmith.sources.io import load_latest
from tests.conftest import rows


def _base(spark):
    return spark.createDataFrame([("u1", "d1", None), ("u2", "d2", "x"), ("u2", "d3", "y"), (None, "d4", "z")],
                                 "url string, date string, flag string")


def _changes(spark):
    return spark.createDataFrame([(1, "u1", "flag", "1"), (2, "u2", "flag", None), (3, "u9", "status", "new"),
                                  (4, "u1", "flag", "2")], "seq long, url string, column string, value string")


def test_upsert_fixture(spark):
    out = apply_changes(_base(spark), _changes(spark))
    got = rows(out, "url", "date", "flag", "status")
    assert got == [("u1", "d1", "2", None), ("u2", "d2", None, None), ("u2", "d3", None, None),
                   ("u9", None, None, "new"), (None, "d4", "z", None)]


def test_delete_keeps_null_key(spark):
    out = delete_keys(apply_changes(_base(spark), _changes(spark)), ["u1"])
    assert rows(out, "url", "date") == [("u2", "d2"), ("u2", "d3"), ("u9", None), (None, "d4")]


def test_upsert_then_delete_leaves_other_keys(spark):
    base = _base(spark)
    out = delete_keys(apply_changes(base, _changes(spark).where("url = 'u9'")), ["u9"])
    assert rows(out, "url", "date", "flag") == rows(base, "url", "date", "flag")


def test_url_state_versions_keep_added_columns(spark, tmp_path):
    root = str(tmp_path / "url_state")
    url_state_create(root, _base(spark))
    url_state_update(root, changes=_changes(spark))
    more = spark.createDataFrame([(9, "u2", "flag", "z")], "seq long, url string, column string, value string")
    url_state_update(root, changes=more, deletes=spark.createDataFrame([("u1",)], "url string"))
    state, version = load_latest(spark, root)
    assert version == 3
    assert rows(state, "url", "flag", "status") == [("u2", "z", None), ("u2", "z", None), ("u9", None, "new"),
                                                    (None, "z", None)]


def test_a_missing_table_is_an_error(spark, tmp_path):
    import pytest
    with pytest.raises(FileNotFoundError):
        url_state_update(str(tmp_path / "none"), changes=_changes(spark))


def test_a_bad_value_spoils_only_itself(spark):
    base = spark.createDataFrame([("u1", None), ("u2", True)], "url string, checked boolean")
    changes = spark.createDataFrame([(1, "u1", "checked", "true"), (2, "u1", "checked", "maybe"),
                                     (3, "u2", "checked", None), (4, None, "checked", "true"), (5, "u3", "note", "x")],
                                    "seq long, url string, column string, value string")
    out = apply_changes(base, changes)
    assert rows(out, "url", "checked", "note") == [("u1", True, None), ("u2", None, None), ("u3", None, "x")]
    assert rows(rejected_changes(base, changes), "seq") == [(2,), (4,)]


def test_accumulate_merge_idempotent_and_sorted(spark):
    base = spark.createDataFrame([("b", 1), ("a", 2)], "name string, n int")
    new = spark.createDataFrame([("a", 2, "x"), ("c", 3, None), ("a", 2, "x")], "name string, n int, extra string")
    once = accumulate_merge(base, new)
    assert once.columns == ["name", "n", "extra"]
    # ("a", 2, None) is a base row, so it precedes the new ("a", 2, "x")
    assert [tuple(r) for r in once.collect()] == [("a", 2, None), ("a", 2, "x"), ("b", 1, None), ("c", 3, None)]
    twice = accumulate_merge(once, new)
    got = [tuple(r) for r in twice.collect()]
    # the same rows, sorted on the lead column (both "a" rows are base rows
    # now; without an order column their relative order is not defined)
    assert sorted(got, key=str) == sorted([tuple(r) for r in once.collect()], key=str)
    assert [r[0] for r in got] == ["a", "a", "b", "c"]
    empty = spark.createDataFrame([], new.schema)
    same = accumulate_merge(base, empty)
    assert same.schema == once.schema       # whatever the inputs hold
    assert [tuple(r) for r in same.collect()] == [("a", 2, None), ("b", 1, None)]


def test_accumulate_merge_stable_with_order_column(spark):
    base = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("b", 0, 3)], "name string, v int, seq int")
    new = spark.createDataFrame([("a", 0, 9), ("a", 1, 2)], "name string, v int, seq int")
    out = [tuple(r) for r in accumulate_merge(base, new, order_col="seq").collect()]
    assert out == [("a", 2, 1), ("a", 1, 2), ("a", 0, 9), ("b", 0, 3)]


def test_append_union_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    b = spark.createDataFrame([(1, 5.0)], "id long, score double")
    assert rows(append_union(a, b), "id", "name", "score") == [(1, "x", None), (1, None, 5.0)]


def test_clean_then_append_twice_equals_once(spark):
    new = spark.createDataFrame([(1, "c", "p", "a@ok.example"), (2, "c", "p", "b@hays.de"), (3, "c", "p", "a@ok.example")],
                                "ingest_seq long, company string, person string, email string")
    master = spark.createDataFrame([(None, None, "old@ok.example")], "company string, person string, email string")
    cleaned = clean_contacts(new, master)
    assert rows(cleaned, "email") == [("a@ok.example",)]
    once = append_master(master, cleaned)
    twice = append_master(once, clean_contacts(new, once))
    assert rows(once) == rows(twice)
    assert cleaned.join(master, "email").count() == 0


def test_upsert_hot_key(spark):
    base = spark.createDataFrame([("hot" if i % 3 == 0 else f"u{i}", f"d{i}", None) for i in range(3000)],
                                 "url string, date string, flag string")
    changes = spark.createDataFrame([(1, "hot", "flag", "a"), (2, "hot", "flag", "b"), (3, "new", "flag", "c")],
                                    "seq long, url string, column string, value string")
    out = apply_changes(base, changes)
    assert out.count() == 3001
    assert out.where("url = 'hot'").groupBy("flag").count().collect()[0]["count"] == 1000
    assert {r.flag for r in out.where("url = 'hot'").collect()} == {"b"}
    assert out.where("url = 'new'").first().flag == "c"
