"""Extraction fixtures F1-F7 (FIXTURES.md section 2)."""

from pyspark.sql import functions as F

from leadsmith.operators.extract import (
    cfemail_emails,
    decode_cfemail,
    extract_page_findings,
    iframe_links,
    jsonld_emails,
    label_emails,
    mailto_emails,
    page_links,
    page_summaries,
    posting_fields,
    posting_links,
    with_nodes,
)
from leadsmith.functions.text import clean_text, email_matches, resolve_url, visible_text

BASE = "https://acme.example/"


def on_nodes(spark, html, expr):
    df = with_nodes(spark.createDataFrame([(html,)], "html string"))
    return df.select(expr().alias("v")).first()["v"]


def one(spark, html, expr):
    df = spark.createDataFrame([(html,)], "html string")
    return df.select(expr(F.col("html")).alias("v")).first()["v"]


def test_f1_mailto(spark):
    html = """<a HREF="MAILTO:Info@Acme.example?subject=Hi%20x">m</a><a href='mailto:a.b@acme.example'>x</a>"""
    assert sorted(one(spark, html, mailto_emails)) == ["a.b@acme.example", "info@acme.example"]


def test_f2_jsonld_top_level_array(spark):
    html = ('<script type="application/ld+json">[{"contactPoint":{"email":"Jobs@acme.example"}},'
            '{"x":["see hr@acme.example"]}]</script>')
    assert sorted(on_nodes(spark, html, lambda: jsonld_emails(F.col("__json")))) == ["hr@acme.example", "jobs@acme.example"]


F3 = ('<html><style>p{color:red}</style><script>var t="q@no.example";</script>'
      '<!-- c@no.example --><p>kontakt [at] acme [dot] example</p></html>')


def test_f3_text_raw_and_strict_domain(spark):
    text = one(spark, F3, lambda c: visible_text(c))
    assert text == "kontakt@acme.example"
    raw = sorted(one(spark, F3, lambda c: F.transform(email_matches(c), lambda m: F.lower(m))))
    assert raw == ["c@no.example", "q@no.example"]
    pages = spark.createDataFrame([(1, BASE, F3, "acme.example")], "page_id long, url string, html string, domain string")
    found = extract_page_findings(pages, prefer_same_domain=True).select("email").distinct().collect()
    assert [r.email for r in found] == ["kontakt@acme.example"]
    everything = {r.email for r in extract_page_findings(pages).select("email").collect()}
    assert everything == {"kontakt@acme.example", "q@no.example", "c@no.example"}
    summary = page_summaries(pages).first()
    assert summary.emails_extracted == "kontakt@acme.example"


def test_f4_iframes_same_host_resolved(spark):
    html = ('<iframe src="/kontakt"></iframe><iframe src="https://sub.acme.example/a"></iframe>'
            '<iframe src="https://other.example/b"></iframe>')
    got = on_nodes(spark, html, lambda: iframe_links(F.col("__nodes"), F.lit(BASE), F.lit("acme.example")))
    assert got == ["https://acme.example/kontakt", "https://sub.acme.example/a"]


def test_f4_every_iframe_unless_limited(spark):
    html = "".join(f'<iframe src="/f{i}"></iframe>' for i in range(5))
    for limit, n in ((None, 5), (3, 3)):
        got = on_nodes(spark, html, lambda: iframe_links(F.col("__nodes"), F.lit(BASE), F.lit("acme.example"), limit))
        assert got == [f"https://acme.example/f{i}" for i in range(n)]


def test_mailto_in_any_quoting(spark):
    html = ('<a href="mailto:o\'brien@x.de">a</a><a class=k href=mailto:bare@x.de?subject=1>b</a>'
            "<A HREF = 'MAILTO: Single@x.de '>c</A><a href=\"mailto:a&#64;x.de\">d</a><a href='mailto:'>e</a>")
    assert sorted(one(spark, html, mailto_emails)) == ["a@x.de", "bare@x.de", "o'brien@x.de", "single@x.de"]


def test_links_in_any_quoting(spark):
    html = '<a href=/x>1</a><a href="it\'s.html">2</a><a href="/a?b=1&amp;c=2">3</a><a href="">4</a>'
    pages = spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")
    assert [r.link for r in page_links(pages).orderBy("pos").collect()] == [
        BASE + "x", BASE + "it's.html", BASE + "a?b=1&c=2"]


def test_jsonld_values_escapes_keys_and_broken_bodies(spark):
    html = ('<script type="application/ld+json">{"e-mail":" Info\\u0040x.de ","key@x.de":1,"n":[{"t":"ask b@x.de"}]}</script>'
            '<script type="application/LD+JSON">{"a":"c@x.de"} {broken "d@x.de"}</script>'
            '<script type="text/javascript">{"a":"no@x.de"}</script>')
    got = on_nodes(spark, html, lambda: jsonld_emails(F.col("__json")))
    assert sorted(got) == ["b@x.de", "c@x.de", "info@x.de"]


def test_label_takes_the_whole_element(spark):
    far = "word " * 100
    html = (f"<div><p>Impressum {far}<b>one [at] x [dot] de</b></p><p>other@x.de</p></div>"
            f"<section>contact <span>{far}</span>two@x.de, three@x.de</section>")
    got = on_nodes(spark, html, lambda: label_emails(F.col("__nodes")))
    assert sorted(got) == ["one@x.de", "three@x.de", "two@x.de"]


DETAIL = """<div class="x highlight-text"><h1 class="margin-bottom-xs"> Title &amp; more </h1></div>
<div class="project-header"><div><span>a</span></div></div><a onclick="window.open(1)">WRONG</a>
<div class="project-header"><p><a onclick="window.open('/f')">Right <b>AG</b></a></p></div>
<div class="media-body"><div class="col-md-6">
 Ann Berg\nRecruiting</div></div>
<div class="col-sm-6 margin-bottom-sm"><b>e-mail:</b> <i><a href="mailto:a@b.de"> a@b.de </a></i></div>
<div class="panel-body highlight-text">one <div>two</div> three</div> four"""


def test_posting_fields_follow_the_elements(spark):
    pages = spark.createDataFrame([("u", DETAIL), ("v", "<p>nothing</p>"), ("w", None)], "url string, html string")
    got = {r.url: (r.project_name, r.project_description, r.company, r.person, r.email) for r in posting_fields(pages).collect()}
    assert got == {"u": ("Title & more", "one two three", "Right AG", "Ann Berg", "a@b.de"),
                   "v": (None,) * 5, "w": (None,) * 5}


def test_posting_links_inside_cards(spark):
    html = ("<search-project-card><a class='small fw-semibold link-warning' href=/a>1</a></search-project-card>"
            "<search-project-card><div><a href=/no>x</a><p><a class='link-warning x small fw-semibold' href=\"/b?c=1&amp;d=2\">2</a>"
            "</p></div></search-project-card><search-project-card><a href=/none>3</a></search-project-card>"
            "<a class='small fw-semibold link-warning' href=/outside>4</a>")
    pages = spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")
    assert [(r.pos, r.link) for r in posting_links(pages).orderBy("pos").collect()] == [(1, BASE + "a"), (2, BASE + "b?c=1&d=2")]


def test_zero_width_before_composition(spark):
    assert one(spark, "a\u200b\u0308", lambda c: clean_text(c)) == "ä"


def _cf_hex(addr: str, key: int = 0x5A) -> str:
    return f"{key:02x}" + "".join(f"{ord(ch) ^ key:02x}" for ch in addr)


def test_f5_protected_address(spark):
    df = spark.createDataFrame([(_cf_hex("a.b@ex.de"),), ("5a1",), ("zz11",), (_cf_hex("nobody"),)], "h string")
    got = [r.v for r in df.select(decode_cfemail(F.col("h")).alias("v")).collect()]
    assert got == ["a.b@ex.de", None, None, None]
    html = f'<span class="__cf_email__" data-cfemail="{_cf_hex("a.b@ex.de")}">[email protected]</span>'
    assert one(spark, html, cfemail_emails) == ["a.b@ex.de"]


def test_f6_literal_at_rule(spark):
    assert one(spark, "meet at example.com", lambda c: clean_text(c)) == "meet@example.com"


def test_f7_unicode_word_boundary(spark):
    got = one(spark, "müller@x.de ok.a@b.de.", email_matches)
    assert got == ["ok.a@b.de"]


def test_resolve_url_shapes(spark):
    cases = [
        ("https://a.example/x/y?q=1#f", "/p", "https://a.example/p"),
        ("https://a.example/x/y?q=1#f", "z", "https://a.example/x/z"),
        ("https://a.example/x/y?q=1#f", "?k=2", "https://a.example/x/y?k=2"),
        ("https://a.example/x/y?q=1#f", "#g", "https://a.example/x/y?q=1#g"),
        ("https://a.example", "kontakt", "https://a.example/kontakt"),
        ("https://a.example/", "//cdn.example/s", "https://cdn.example/s"),
        ("https://a.example/", "mailto:x@a.example", "mailto:x@a.example"),
        ("https://a.example/x", "", "https://a.example/x"),
    ]
    df = spark.createDataFrame(cases, "b string, h string, want string")
    for r in df.select(resolve_url("b", "h").alias("got"), "want").collect():
        assert r.got == r.want


def test_clean_text_exact_path(spark):
    # NFKC (fullwidth, ligature) and a rare entity go through the exact path.
    got = one(spark, "ｉｎｆｏ (at) acme &lbrack;dot&rbrack; example", lambda c: clean_text(c))
    assert got == "info@acme.example"


def test_long_tokens_do_not_backtrack(spark):
    import time
    long_token = "<p>" + "x" * 200_000 + "contact" + "y" * 10 + " info@acme.example"
    dotted = "a." * 100_000
    df = spark.createDataFrame([(long_token,), (dotted,)], "html string")
    t0 = time.time()
    got = [r.e for r in with_nodes(df).select(label_emails(F.col("__nodes")).alias("e")).collect()]
    found = [r.e for r in df.select(email_matches(F.col("html")).alias("e")).collect()]
    assert got[0] == ["info@acme.example"] and got[1] == []
    assert found == [["info@acme.example"], []]
    assert time.time() - t0 < 30


def test_resolve_url_dot_segments_like_urljoin(spark):
    from urllib.parse import urljoin
    cases = [("https://a.example/a/b/c", "../d"), ("https://a.example/a/b/c", "./d/../e?x=1#y"),
             ("https://a.example/a/b/", "../../../z"), ("https://a.example/a/b/c", "/x/./y/../z/"),
             ("https://a.example/a/b/c", ".."), ("https://a.example/a/b/c", "."),
             ("https://a.example/a//b/c", "d"), ("https://a.example/a/b/c", "/..")]
    df = spark.createDataFrame(cases, "b string, h string")
    for r in df.select("b", "h", resolve_url("b", "h").alias("got")).collect():
        assert r.got == urljoin(r.b, r.h), (r.b, r.h)
