"""Property checks on random inputs (SURVEY §5 (c))."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leadsmith.operators.dedupe import keep_first
from leadsmith.operators.filters import email_blocklist
from leadsmith.operators.tables import accumulate_merge, apply_changes, delete_keys
from leadsmith.plans.flows import clean_contacts, contact_funnel_counts
from tests.conftest import rows, terms_df

LOCALS = st.sampled_from(["a", "b", "info", "X", "u.v"])
DOMAINS = st.sampled_from(["ok.example", "hays.de", "sub.hays.de", "thehays.de", "full.example", "x.at"])
EMAIL = st.one_of(st.none(), st.builds(lambda l, d: f"{l}@{d}", LOCALS, DOMAINS), st.just("hays.de"))
BLOCK = ["hays.de", "x@full.example", ".x.at"]
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(EMAIL, max_size=25))
def test_keep_first_one_row_per_key_minimal_order(spark, emails):
    df = spark.createDataFrame([(i, e) for i, e in enumerate(emails)], "seq long, email string")
    out = rows(keep_first(df, "email", "seq"), "email", "seq")
    firsts = {}
    for i, e in enumerate(emails):
        firsts.setdefault(e, i)
    assert sorted(out, key=str) == sorted(firsts.items(), key=str)


@SETTINGS
@given(st.lists(EMAIL, max_size=25), st.booleans())
def test_blocklist_inline_equals_join_path(spark, emails, boundary):
    df = spark.createDataFrame([(i, e) for i, e in enumerate(emails)], "seq long, email string")
    long_list = terms_df(spark, BLOCK + [f"pad{i}.example" for i in range(300)])
    a = rows(email_blocklist(df, "email", BLOCK, boundary=boundary))
    b = rows(email_blocklist(df, "email", long_list, boundary=boundary))
    assert a == b


@SETTINGS
@given(st.lists(EMAIL, max_size=20), st.lists(EMAIL, max_size=6))
def test_clean_contacts_disjoint_from_master_and_funnel_adds_up(spark, emails, known):
    new = spark.createDataFrame([(i, "c", "p", e) for i, e in enumerate(emails)],
                                "ingest_seq long, company string, person string, email string")
    master = spark.createDataFrame([(e,) for e in known], "email string")
    out = clean_contacts(new, master, BLOCK)
    kept = [r.email for r in out.collect()]
    assert len(kept) == len(set(kept))
    assert not (set(kept) & set(known))
    f = contact_funnel_counts(new, master, BLOCK).first()
    if emails:
        assert f.input == len(emails)
        assert f.removed == f.duplicates + f.already_known + f.excluded
        assert f.left == len(kept)


ROW = st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 2))


@SETTINGS
@given(st.lists(ROW, max_size=10), st.lists(ROW, min_size=1, max_size=10))
def test_accumulate_merge_idempotent_and_order_free(spark, base_rows, new_rows):
    schema = "name string, n int"
    base = spark.createDataFrame(base_rows, schema)
    new = spark.createDataFrame(new_rows, schema)
    once = accumulate_merge(base, new)
    twice = accumulate_merge(once, new)
    flipped = accumulate_merge(base, spark.createDataFrame(list(reversed(new_rows)), schema))
    assert rows(once) == rows(twice) == rows(flipped)
    assert len(rows(once)) == len(set(base_rows) | set(new_rows))


KEYS = st.sampled_from(["u1", "u2", "u3", None])


@SETTINGS
@given(st.lists(st.tuples(KEYS, st.sampled_from(["d1", "d2"])), max_size=8),
       st.lists(st.tuples(KEYS, st.sampled_from(["flag", "status"]), st.sampled_from(["1", "2", None])), max_size=6))
def test_upsert_then_delete_leaves_other_keys(spark, base_rows, changes):
    base = spark.createDataFrame(base_rows, "url string, date string")
    ch = spark.createDataFrame([(i, u, c, v) for i, (u, c, v) in enumerate(changes)],
                               "seq long, url string, column string, value string")
    touched = {u for u, _, _ in changes if u is not None}
    out = delete_keys(apply_changes(base, ch), sorted(touched))
    untouched = [(u, d) for u, d in base_rows if u not in touched]
    assert rows(out, "url", "date") == rows(spark.createDataFrame(untouched, "url string, date string"), "url", "date")
