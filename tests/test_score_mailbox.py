"""Keyword score, frontier, candidate priority, funnel audit."""


from leadsmith.operators.mailbox import best_candidate, candidates, frontier
from leadsmith.operators.score import keyword_scores
from leadsmith.plans.flows import contact_funnel_counts
from leadsmith.sources.lookups import LOCAL_PARTS


def _terms(mini_w=None, top_w=None):
    mini = [("p", "mini", f"m{i:02d}", None) for i in range(20)]
    top = [("p", "top", t, None) for t in ("t1", "t2", "t3")]
    return mini + top + [("p", "heading", "head", None), ("p", "exclude", "sap", None)]


def test_keyword_score_stated_weights(spark):
    text = "head line\nm00 m01 m02 t1 t2"
    docs = spark.createDataFrame([(1, text), (2, text + " SAP")], "doc_id long, text string")
    out = keyword_scores(docs, _terms()).collect()
    assert len(out) == 1  # doc 2 excluded
    assert abs(out[0].score - 0.6056) < 1e-4
    assert out[0].passes is False


def test_keyword_score_notes_sum(spark):
    docs = spark.createDataFrame([(1, "head line\nm00 m01 m02 t1 t2")], "doc_id long, text string")
    out = keyword_scores(docs, _terms(), weights={"mini": 1.0, "top": 0.5, "heading": 1 / 3}).first()
    assert abs(out.score - 0.8167) < 1e-4
    assert out.passes is True


def test_weights_of_single_terms(spark):
    docs = spark.createDataFrame([(1, "x\nalpha"), (2, "x\nbeta")], "doc_id long, text string")
    terms = [("p", "mini", "alpha", 1.0), ("p", "mini", "beta", 9.0)]
    got = {r.doc_id: r.score for r in keyword_scores(docs, terms, weights={"mini": 1.0}).collect()}
    assert abs(got[1] - 0.1) < 1e-6 and abs(got[2] - 0.9) < 1e-6
    table = spark.createDataFrame(terms, "profile string, grp string, term string, weight double")
    assert {r.doc_id: r.score for r in keyword_scores(docs, table, weights={"mini": 1.0}).collect()} == got


def test_site_findings_on_normalised_urls_and_every_frame(spark):
    from leadsmith.operators.mailbox import best_hits, site_findings
    frames = "".join(f"<iframe src='/f{i}'></iframe>" for i in range(5))
    pages = spark.createDataFrame([
        ("HTTPS://Www.ACME.example:443/kontakt#x", frames), ("https://www.acme.example/f4", "<p>info@acme.example</p>"),
        ("http://b.example:80", "mail team@b.example"), ("https://c.example/other", "info@c.example"),
        ("https://c.example:8443/", "info@c.example"), ("https://d.example/?x=1", "info@d.example")],
        "url string, html string")
    domains = spark.createDataFrame([("acme.example",), ("b.example",), ("c.example",), ("d.example",)], "domain string")
    got = {r.domain: r.email_common for r in best_hits(site_findings(domains, pages)).collect()}
    assert got == {"acme.example": "info@acme.example", "b.example": "team@b.example"}


def test_frontier_counts_and_order(spark):
    d = spark.createDataFrame([("acme.example",)], "domain string")
    f = frontier(d)
    assert f.where("tier = 1").count() == 54 and f.where("tier = 2").count() == 54
    first = f.orderBy("tier", "url_rank").first()
    assert (first.tier, first.url_rank, first.url) == (1, 1, "https://acme.example/")
    extra = frontier(d, extra_paths=["kontakt", "jobs", "/kontakt", "https://acme.example/jobs"])
    # "kontakt" is already listed; "/kontakt" and the absolute URL resolve to listed URLs
    assert extra.where("tier = 1").count() == 56
    assert extra.where("url = 'https://acme.example/jobs' and tier = 1").first().url_rank == 28


def test_candidates_order(spark):
    d = spark.createDataFrame([("acme.example",)], "domain string")
    c = candidates(d, ["info", " ", "Kontakt"]).orderBy("rank").collect()
    assert [(r.rank, r.email) for r in c] == [(1, "info@acme.example"), (2, "kontakt@acme.example")]
    table = spark.createDataFrame([(2, "Kontakt"), (1, "info"), (3, " ")], "rank int, local_part string")
    assert [(r.rank, r.email) for r in candidates(d, table).orderBy("rank").collect()] == [
        (1, "info@acme.example"), (2, "kontakt@acme.example")]


def test_best_candidate_priority_and_tier(spark):
    domains = spark.createDataFrame([("a.example",), ("b.example",), ("c.example",)], "domain string")
    found = spark.createDataFrame([
        ("a.example", 1, "team@a.example"), ("a.example", 1, "kontakt@a.example"), ("a.example", 2, "info@a.example"),
        ("b.example", 2, "office@b.example"), ("b.example", 2, "x.y@b.example"),
        ("c.example", 1, "info@other.example"),
    ], "domain string, tier int, email string")
    got = {r.domain: r.email_common for r in best_candidate(domains, found).collect()}
    assert got == {"a.example": "kontakt@a.example", "b.example": "office@b.example", "c.example": None}
    assert LOCAL_PARTS.index("kontakt") < LOCAL_PARTS.index("team")


def test_funnel_counts_add_up(spark):
    new = spark.createDataFrame([("a@x.example",), ("a@x.example",), ("k@x.example",), ("z@hays.de",), ("b@x.example",)],
                                "email string")
    master = spark.createDataFrame([("k@x.example",)], "email string")
    r = contact_funnel_counts(new, master).first()
    assert (r.input, r.duplicates, r.already_known, r.excluded, r.left) == (5, 1, 1, 1, 2)
    assert r.removed == r.duplicates + r.already_known + r.excluded
