"""Pages and lists that must not stall a task: bad markup, long values, short terms."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from leadsmith.functions import html
from leadsmith.functions.text import deobfuscate, strip_markup
from leadsmith.operators.extract import json_strings, label_emails, with_nodes
from leadsmith.operators.filters import email_blocklist, exclude_terms, term_candidates, term_index
from leadsmith.plans.flows import listed_details
from tests.conftest import rows

N = 1_000_000
BAD_PAGES = {
    "cut off in a tag": "<p>contact</p><a " + "n" * N,
    "many cut-off tags": "<a" * (N // 2),
    "cut-off tags with a quote": '<a "' * (N // 4),
    "cut-off tags with both quotes": "<a \"'" * (N // 5),
    "odd quotes": '<img xxxx alt="abc>' * (N // 19),
    "stray <": "<" * N,
    "< and blanks": "< a" * (N // 3),
    "unclosed scripts": "<script>" * (N // 8),
    "unclosed comments": "<!--" * (N // 4),
    "cut-off end tags": "</a" * (N // 3),
    "blanks": "a" + " " * N + "b",
    "end tags without start": "<b>" + "</i>" * (N // 4),
    "json quotes": '<script type="application/ld+json">' + '{"' * (N // 2),
    "protected address, never closed": "<a __cf_email__ " + "__cf_email__ " * (N // 13),
}


@pytest.mark.parametrize("name", BAD_PAGES)
def test_scan_of_bad_pages_takes_time_in_proportion(name):
    """Four times the page must not take more than some six times as long."""
    def seconds(page):
        start = time.process_time()
        html._Blocks(page)
        html._label_segments(html._Page(page), re.compile("(?i)contact"))
        html._json_texts(page)
        return time.process_time() - start

    page = BAD_PAGES[name]
    small = min(seconds(page[:len(page) // 4]) for _ in range(2))
    assert seconds(page) < 8 * small + 1


def test_patterns_on_bad_pages(spark):
    df = spark.createDataFrame([(k, v) for k, v in BAD_PAGES.items()], "name string, html string")
    start = time.time()
    got = df.select("name", F.length(deobfuscate(strip_markup(F.col("html")))).alias("n")).collect()
    from leadsmith.operators.extract import cfemail_emails, mailto_emails
    df.select(F.size(cfemail_emails(F.col("html"))), F.size(mailto_emails(F.col("html")))).collect()
    assert len(got) == len(BAD_PAGES) and time.time() - start < 60
    assert {r.name: r.n for r in got}["unclosed scripts"] <= 1 and {r.name: r.n for r in got}["blanks"] == 3


def test_tags_end_outside_quotes():
    doc = html._Page("""a<p title='x > y' id="b'>c">d<i>e</i></p>f < g <3 h<br/>i<a x="j""")
    assert doc.tags == ["p", "i", "br"] and doc.texts == ["a", "d", "e", "f < g <3 h", 'i<a x="j']
    assert doc.attributes(0) == {"title": "x > y", "id": "b'>c"} and doc.inner(0) == "de" and doc.owner == [-1, 0, 1, -1, -1]
    doc = html._Page("<div><p>1<p>2</div>3<script>x<p></script>4<!-- <p> -->5<!doctype p>6</p>")
    assert doc.tags == ["div", "p", "p", "script"] and doc.parents == [-1, 0, 1, -1]
    assert doc.texts == ["1", "2", "3", "4", "5", "6"] and doc.raw == {3: "x<p>"} and doc.inner(0) == "12"


def test_a_label_in_a_label_belongs_to_the_outer_element(spark):
    page = "<div>Contact <p>E-Mail: <b>a@x.example</b></p><p>b@x.example</p></div><p>c@x.example</p>"
    df = with_nodes(spark.createDataFrame([(page,)], "html string"))
    assert df.first()["__nodes"]["segments"] == ["Contact  E-Mail:  a@x.example b@x.example"]
    assert sorted(df.select(label_emails(F.col("__nodes"))).first()[0]) == ["a@x.example", "b@x.example"]


def test_json_texts_one_after_another():
    assert html._json_texts(' {"a":"}"} [1,"]"] "x" 5 true') == ['{"a":"}"}', '[1,"]"]', '"x"', "5", "true"]
    assert html._json_texts('{"a":1} , {"b":2}') == ['{"a":1}', ', {"b":2}']
    assert html._json_texts('{"a":"b') == ['{"a":"b'] and html._json_texts("]") == ["]"] and html._json_texts(" ") == []


def test_json_strings_equal_a_parser(spark):
    values = [{"email": "a@x.de", "n": ["b@x.de", {"E-Mail": "c\"@x.de", "deep": [[{"k": "d\\@x.de"}]]}]}, ["e@x.de"], "f@x.de",
              {"g@x.de": "no", "email": ["h@x.de"], "x": {"email": 5}, "u": "é i@x.de"}]

    def strings(v, key=None):
        if isinstance(v, str):
            yield key, v
        elif isinstance(v, dict):
            for k, x in v.items():
                yield from strings(x, k)
        elif isinstance(v, list):
            for x in v:
                yield from strings(x)

    for ascii_only in (True, False):
        bodies = [[json.dumps(v, ensure_ascii=ascii_only, indent=i) for i in (None, 2)] for v in values]
        want = sorted(2 * [(k or "", s) for v in values for k, s in strings(v) if "@" in s])
        df = spark.createDataFrame([(bodies,)], "b array<array<string>>").select(json_strings(F.col("b")).alias("s"))
        assert sorted((r["key"] or "", r["value"]) for r in df.first()["s"]) == want
    broken = spark.createDataFrame([([['{"a":"1@x.de"}', '{"a":', '{"a":"2@x.de"}'], ['"\\u0040 3"']],)], "b array<array<string>>")
    assert [(r["key"], r["value"]) for r in broken.select(json_strings(F.col("b"))).first()[0]] == [("a", "1@x.de"), (None, "@ 3")]


def test_one_short_term_leaves_the_others_their_own_postings(spark):
    terms = spark.createDataFrame([(f"engineer{i:05d}",) for i in range(2_000)] + [("q",), ("ab",)], "term string")
    values = spark.createDataFrame([(f"senior engineer{i % 2_500:05d} of {i}",) for i in range(300)] + [("has q",), (None,)], "v string")
    index = term_index(terms)
    assert index.count() == 2_002 and index.groupBy("__k", "__gram").count().agg(F.max("count")).first()[0] == 1
    distinct = values.where("v IS NOT NULL").distinct()
    assert term_candidates(distinct, "v", index).count() <= 2 * 301
    kept = exclude_terms(values, "v", terms)
    assert sorted(rows(kept), key=str) == [(None,)]
    assert exclude_terms(values, "v", terms.where("term = 'ab'")).count() == 302
    assert exclude_terms(values, "v", terms.limit(0)).count() == 302


def _broadcast_after_explode(df):
    """The exploding nodes of the plan as it was run whose rows a broadcast takes as they are."""
    df.collect()
    found, broadcast, below = [], None, None
    for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines():
        depth = len(line) - len(line.lstrip(" :+-*("))
        broadcast = None if broadcast is not None and depth <= broadcast else broadcast
        below = None if below is not None and depth <= below else below
        if "BroadcastExchange" in line:
            broadcast, below = depth, None
        elif broadcast is not None and below is None and re.search(r"[- ]Exchange ", line):
            below = depth
        elif broadcast is not None and below is None and "Generate " in line:
            found.append(line.strip())
    return found


@pytest.fixture
def small_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "100k")
    yield
    spark.conf.set(name, before)


def test_runs_of_terms_and_values_are_not_broadcast(spark, small_broadcast):
    """Few values and more terms: Spark takes the values' runs to be as small as the values."""
    values = spark.createDataFrame([(" ".join(f"w{i:03d}v{k:04d}" for k in range(60)),) for i in range(40)] + [(None,)], "v string").repartition(2)
    terms = spark.createDataFrame([(f"w{i:03d}v{i % 100:04d}",) for i in range(4_000) if i % 7], "term string").repartition(2)
    kept = exclude_terms(values, "v", terms)
    assert _broadcast_after_explode(kept) == []
    text = [r["v"] for r in values.collect()]
    listed = [r["term"] for r in terms.collect()]
    assert rows(kept) == sorted([(v,) for v in text if v is None or not any(t in v for t in listed)], key=lambda r: (r[0] is None, str(r[0])))


def test_links_of_listing_pages_are_not_broadcast(spark, small_broadcast):
    def listing(page):
        return "".join(f'<search-project-card><a class="small fw-semibold link-warning" href="/p/{page}-{k}">'
                       "</a></search-project-card>" for k in range(20))
    board = "https://projects.example/"
    pages = spark.createDataFrame([(f"{board}p/{i}-{k}", "x") for i in range(30) for k in range(0, 40, 5)], "url string, html string").repartition(2)
    found = listed_details(spark.createDataFrame([(i, f"{board}?page={i}", listing(i)) for i in range(20)],
                                                 "page_id long, url string, html string").repartition(2), pages)
    assert _broadcast_after_explode(found) == []
    assert rows(found, "url") == sorted((f"{board}p/{i}-{k}",) for i in range(20) for k in range(0, 20, 5))


@pytest.mark.parametrize("boundary", [False, True])
def test_a_long_value_has_as_many_suffixes_as_terms_have_lengths(spark, boundary):
    values = ["x" * N, "y." * 300_000 + "bad.example", "a@sub.bad.example", "a@notbad.example", None, "a@b.c"]
    terms = [".bad.example", "c", "x.example"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    start = time.time()
    got = rows(email_blocklist(df, "v", table, boundary=boundary).select("k"))
    assert got == rows(email_blocklist(df, "v", terms, boundary=boundary).select("k")) and time.time() - start < 60
