"""Classifiers (held-out accuracy), page extraction, minimum cut, the pipeline."""

import itertools
import zlib

import numpy as np
import pytest

from leadsmith.llm import html_mincut, quality_mil, toxicity
from leadsmith.llm.html_mincut import content_side, extract, main_text
from leadsmith.llm.queries import QUERIES, usable_labels
from tests.llm.conftest import as_docs

SF = "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "id long, label long")


@pytest.mark.parametrize("module", [toxicity, quality_mil])
def test_models_without_usable_labels_score_the_prior(messy, messy_rows, no_docs, spark, module):
    # no label; one class only; labels of documents that are not there
    for rows, want in (([], 0.5), ([(100, 0), (101, 0), (None, 1), (102, None)], 0.01), ([(-5, 0), (-6, 1)], 0.5)):
        model = module.fit(messy, labels_of(spark, rows))
        scored = module.score(messy, model)
        name = "score" if "score" in scored.columns else "__score"
        got = [r[name] for r in scored.collect()]
        assert len(got) == len(messy_rows) and all(abs(x - want) < 1e-9 for x in got)
        assert module.score(no_docs, model).count() == 0


def held_out_accuracy(spark, query, label, folds, fold):
    got = {r["doc_id"]: r for r in QUERIES[query](spark, SF).collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % folds == fold) for i, r in got.items())
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    return [(r[label], got[r["doc_id"]]["predicted"]) for r in labels if got[r["doc_id"]]["held_out"]]


def test_quality_on_held_out_rows(spark):
    pairs = held_out_accuracy(spark, "op7_quality", "quality", 4, 2)
    assert np.mean([a == b for a, b in pairs]) > 0.93


def test_toxicity_on_held_out_rows(spark):
    pairs = held_out_accuracy(spark, "op2_toxicity", "toxic", 3, 1)
    assert np.mean([a == b for a, b in pairs]) > 0.88
    assert np.mean([b for a, b in pairs if a == 0]) < 0.03


def test_toxicity_learns_words_and_ignores_copies(spark):
    clean = [(i, f"plain words number {i} follow here") for i in range(200)]
    toxic = [(1000 + i, f"you zorgling number {i} follow here") for i in range(60)]
    docs = as_docs(spark, clean + toxic + [(5000, "another zorgling text"), (5001, "another plain text"), (5002, None)])
    model = toxicity.fit(docs, labels_of(spark, [(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic]))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert got[5000] == 1 and got[5001] == 0 and got[5002] == 0


def test_features_do_not_depend_on_how_texts_are_cut(monkeypatch):
    texts = [b"abc defgh " * 30, b"", "äöü".encode() * 20, b"xyz" * 200, b"hello world"]
    whole = toxicity.distinct_features(texts, None, 1 << 20)
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 37)
    assert all(np.array_equal(a, b) for a, b in zip(whole, toxicity.distinct_features(texts, None, 1 << 20), strict=True))
    x, bag = quality_mil.passages(texts)
    monkeypatch.setattr(quality_mil, "PIECE_BYTES", 260)
    y, bag2 = quality_mil.passages(texts)
    assert np.allclose(x, y) and np.array_equal(bag, bag2)


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    model = quality_mil.QualityModel(*[None, None], *(rng.standard_normal(s) for s in
                                                      [(133, 5), (5,), (5, 4), (5, 4), (4,), (5,), (1,)]))
    x, bag = rng.standard_normal((9, 133)) * 0.1, np.array([0, 0, 0, 1, 2, 2, 2, 2, 2])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = model.forward(x, bag, 3)[-1]
        return float((-w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 3)

    for name, g in quality_mil._gradient(model, x, bag, y, w).items():
        part = getattr(model, name)
        at = tuple(0 for _ in part.shape)
        part[at] += 1e-5
        up = loss()
        part[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-5
        part[at] += 1e-5


# ---------------------------------------------------------------- pages

def test_minimum_cut_equals_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 8))
        a, b = rng.random(n) * 3, rng.random(n) * 3
        edges = [(int(i), int(j), float(rng.random())) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.6]

        def cost(keep):
            return (sum(b[i] if k else a[i] for i, k in enumerate(keep))
                    + sum(w for i, j, w in edges if keep[i] != keep[j]))

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert abs(cost(content_side(list(a), list(b), edges)) - best) < 1e-7


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header>
<div id="cookie-notice">We use cookies here, please accept them.</div><main><article><h1>A &amp; B</h1>
<p>First   paragraph\n with some words.<br>More of it.<p>Second <b>bold</b> one.</p><div class="ad">Buy it now, it is cheap.</div>
<p>Ok.</p></article><section class="comments"><p>I liked this article very much, thanks.</p></section></main>
<form><label>Mail</label></form><aside>Read this other article of ours too.</aside><footer>&copy; Us.</footer>"""


def test_naming_habits():
    page = """<body class="has-sidebar article"><div role="navigation"><a href=/>Home</a> <a href=/x>News of today</a></div>
    <div class="page-header">The site of all sites.</div><div class="leftSidebar">Some text in a sidebar, a sentence.</div>
    <article class="post"><div class="post-header"><h2>The title</h2></div><p>Text one.</p><div class="cookieBanner">Cookies, yes.</div>
    <ul><li>Point <a href=/p>a</a></li><li>Point b</li></ul><div class="related-posts"><p>Read on here, it is good.</p></div>
    <div id="disqus_thread">A reader writes a long comment here.</div></article>
    <article class="comment"><p>Another reader says something.</p></article><noscript>Enable it.</noscript></body>"""
    assert main_text(page) == "The title\nText one.\nPoint a\nPoint b"


@pytest.mark.parametrize("tag", ["button", "select", "svg", "math", "object", "iframe", "noscript", "template"])
def test_unclosed_tags_lose_no_text(tag):
    first, second = "First words of the text, a sentence.", "Second words of the text, a sentence."
    for extra in ("", " class='menu ad'", "/"):
        for before, inside in ((f"<{tag}{extra}>", ""), ("", f"<{tag}{extra}>")):
            for after in ("", f"<footer><{tag}>x</{tag}></footer>"):
                page = (f"<html><body><div>{before}</div>{before}<article><p>{first}</p>{inside}<p>{inside}{second}</p>"
                        f"</article>{after}</body></html>")
                assert main_text(page) == f"{first}\n{second}", page


def test_text_of_embedded_elements():
    page = """<article><p>The sum <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> is shown here.</p>
    <object data="a.pdf"><param name="x"><p>The fallback of an object, a sentence.</p></object>
    <p>An icon <svg class="menu"><title>Icon</title><desc>drawn</desc><path d="M0"/><text>A</text></svg> within a sentence.</p>
    <p>Text one. <button class="copy">Copy</button></p><p>Pick <select><option>Red<option>Blue</select></p>
    <select><option>Left<option>Right<p>Behind an unclosed selection, a sentence.</p>
    <iframe src="x">No frames.</iframe><template><p>Hidden one, a sentence.</p><template></template></template>
    <noscript>Enable it.</noscript><p>The end of it.</p></article>"""
    assert main_text(page) == ("The sum x=2 is shown here.\nThe fallback of an object, a sentence.\n"
                               "An icon A within a sentence.\nText one.\nPick\n"
                               "Behind an unclosed selection, a sentence.\nThe end of it.")
    assert main_text("<button>" * 30_000 + "<iframe 'x" * 30_000 + "<p>Still a sentence of the page, at the end.") is not None


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>one long sentence of plain page text.</p>"),
            (1, "u", PAGE), (5, "u", "<nav><a>x</a></nav><p cla")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS text", "1 AS n_chars")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in extract(pages).collect()), key=str)
    want = "A & B\nFirst paragraph with some words. More of it.\nSecond bold one.\nOk."
    assert got == sorted([(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0), (5, "", 0),
                         (None, "one long sentence of plain page text.", 37)], key=str)
    assert extract(pages.limit(0)).count() == 0


def test_extract_keeps_every_block_of_given_articles(spark):
    import html
    import re

    for page_id, page in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect():
        article = page.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert main_text(page) == "\n".join(b for b in blocks if b), page_id


def test_long_pages_are_linear_enough():
    page = "<article>" + "<p>Some words of a sentence.</p><div class='ad'>Buy.</div>" * 20_000
    assert main_text(page).count("\n") == 19_999
    assert html_mincut.main_text("<" * 50_000 + "<p \"" * 2_000) is not None


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from leadsmith.llm.common import stored

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = " ".join(f"Shared words number {i}, of the passage." for i in range(15))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    good = [r["text"] for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
            .where("quality = 1 and length(text) between 1500 and 3000").orderBy("doc_id").limit(4).collect()]
    planted = [(90001, good[0]), (90002, good[0]), (90003, good[1] + " " + passage), (90004, good[2] + " " + passage),
               (90005, bench + " " + bench[:40]), (90006, None), (90007, "")]
    extra = spark.createDataFrame([(i, t, "en", "test", len(t or "")) for i, t in planted], docs.schema)
    state = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, state, SF), "test_pipeline")
        if name != "byte-level bpe":
            assert out.columns == docs.columns
        seen[name] = {r["doc_id"]: r.asDict() for r in out.collect()}
        state = out
    ids = [set(s) for s in seen.values()]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [labels[i] for i in seen["quality classifier"] if i in labels]
    assert np.mean(kept) > 0.97 and sum(kept) > 0.97 * sum(labels.values())
    assert len({90001, 90002} & set(seen["simhash near-dedup"])) == 0     # copies of a document with a smaller id
    a, b = seen["suffix-array dedup"][90003]["text"], seen["suffix-array dedup"][90004]["text"]
    assert passage in a and passage[60:-60] not in b
    assert 90005 not in seen["benchmark decontamination"]
    last = seen["byte-level bpe"]
    assert set(last) == set(seen["benchmark decontamination"]) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in last.values())


def test_labels_of_the_held_out_fold_are_not_used(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    used = {r["id"] for r in usable_labels(labels, "toxic", 3, 1).collect()}
    assert used == {r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}


# ---------------------------------------------------------------- regions and the fitted classifier

@pytest.mark.parametrize("page, text", [
    ('<article><h1>T</h1><div class="share-price"><p>The price rose by two per cent on Monday.</p></div></article>',
     "T\nThe price rose by two per cent on Monday."),
    ('<div class="promo-story"><p>A story that was the only text of the page, long enough.</p></div>',
     "A story that was the only text of the page, long enough."),
    ('<article><p>Intro text of it.</p><div class="comment-quote"><p>As one of them said, it is so.</p></div></article>',
     "Intro text of it.\nAs one of them said, it is so."),
    ('<article><p>Results follow here.</p><table class="search-results"><tr><td>alpha</td><td>12</td></tr></table></article>',
     "Results follow here.\nalpha\n12"),
    ('<article><p>Text of it.</p><div class="ad">Buy this now, it is cheap.</div><div id="comments-list"><p>Nice, thanks.</p></div></article>',
     "Text of it."),
    ('<div class="nav-bar"><p>Home is where we are.</p></div><article><p>x</p><p>y z.</p></article><div class="cookie notice">We use them.</div>',
     "x\ny z."),
])
def test_a_name_counts_as_a_whole(page, text):
    assert main_text(page) == text


def test_many_paragraphs_overrule_a_name_but_no_tag():
    paragraphs = "".join(f"<p>This is a longer sentence of number {k} in the only text there is.</p>" for k in range(30))
    assert main_text(f'<div class="promo">{paragraphs}</div>').count("\n") == 29
    assert main_text('<div class="promo"><p>Buy two of them today, it is cheap.</p></div>') == ""
    assert main_text(f"<aside>{paragraphs}</aside>") == "" and main_text(f'<div class="comments">{paragraphs}</div>') == ""


def test_the_cut_decides_labels_of_the_given_pages():
    import duckdb
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    labels = [x for (page,) in pages for x in html_mincut.labels_of(page)]
    changed = [(z, kept) for _, z, kept in labels if (z > 0) != kept]
    assert len(changed) > 0.05 * len(labels)     # sentences of adverts and footers go
    short = html_mincut.labels_of("<article><p>x</p><p><a href=/>All of it is a link</a></p><p>The text of it.</p></article>")
    assert all(kept for *_, kept in short) and short[0][1] < 0


def test_the_classifier_is_fitted_and_drawn_to_the_stated_weights(spark):
    rng = np.random.default_rng(2)
    rows = np.column_stack([np.ones(60_000), rng.uniform(0, 4, 60_000), rng.uniform(0, 1, 60_000), rng.integers(0, 2, 60_000), np.zeros(60_000)])
    true = np.array([-2.0, 1.5, -2.0, 1.0, 0.0])
    labels = rng.uniform(size=60_000) < 1 / (1 + np.exp(-rows @ true))
    got = np.array(html_mincut.fitted(rows, labels))
    assert np.abs(got[1:4] - true[1:4]).max() < 0.3
    # Where the penalised likelihood has no slope.
    p = 1 / (1 + np.exp(-rows @ got))
    share = np.where(labels, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    slope = rows.T @ (share * (labels - p)) - html_mincut.PRIOR_BLOCKS * (got - np.array(html_mincut.WEIGHTS))
    assert np.abs(slope).max() < 1e-3
    few = np.array(html_mincut.fitted(rows[:20], labels[:20]))
    assert np.abs(few - np.array(html_mincut.WEIGHTS)).max() < 0.1
    assert html_mincut.fitted(rows[:5], np.ones(5, bool)) == html_mincut.WEIGHTS
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_mincut.fit(pages)
    assert weights == html_mincut.fit(pages.repartition(7)) and weights != html_mincut.WEIGHTS
    assert html_mincut.fit(pages.limit(0)) == html_mincut.WEIGHTS
