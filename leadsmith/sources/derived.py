"""Contact-site tables derived from the driver's ``supplier`` and ``nation``.

The driver's ``pages`` hold no mailto link, protected address, JSON-LD block or
iframe, so the extractors and the mailbox finder also run over captured
company sites that Spark builds from the supplier table: one site per
supplier, three pages each, so the corpus grows with the data. What a site
contains depends on the supplier's region (``n_regionkey``):

* region 0 — home page: a ``MAILTO:`` link with ``?subject=`` to ``info@``, and for
  even suppliers an unquoted one to ``sales@``
* region 1 — home page: a protected ``kontakt@`` address and a JSON-LD block
  (a top-level array) with an escaped ``Jobs@``, a text with ``hr@`` and an address
  as a key
* region 2 — home page: four same-host iframes, the last to ``/frame/kontakt`` whose
  page spells ``office [at] … [dot] …`` 300 characters after its label
* region 3 — only the http page ``/impressum`` has ``team@`` (single-quoted mailto)
* region 4 — no generic mailbox; a double-quoted mailto with an apostrophe

Every home page also carries a personal address of the site's domain, a
third-party address in a script and one in a comment (dropped by the
same-domain preference), and an off-site iframe. Some URLs are written with an
upper-case host, the default port and a fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsmith.sources.io import read_parquet, spread


def site_domain(suppkey: Column, nation_name: Column) -> Column:
    return F.concat(F.lit("s"), suppkey.cast("string"), F.lit("."),
                    F.regexp_replace(F.lower(nation_name), "[^a-z0-9]", ""), F.lit(".example"))


def cf_encode(address: Column, key: Column) -> Column:
    """Protected-address hex: key byte, then every byte XOR key (ASCII input)."""
    body = F.array_join(F.transform(F.split(address, ""),
                                    lambda c: F.lpad(F.hex(F.ascii(c).bitwiseXOR(key)), 2, "0")), "")
    return F.concat(F.lpad(F.hex(key), 2, "0"), body)


def suppliers_with_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    nat = read_parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey)
            .select("s_suppkey", "s_name", "s_acctbal", "n_regionkey",
                    site_domain(F.col("s_suppkey"), F.col("n_name")).alias("domain")))


def contact_site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html)`` — three captured pages per supplier site."""
    s = suppliers_with_sites(spark, sf_dir)
    k, d, r = F.col("s_suppkey"), F.col("domain"), F.col("n_regionkey")
    person = F.concat(F.lit("p"), k.cast("string"), F.lit(".contact@"), d)
    key = (k % 200 + 16).cast("int")

    def when_region(n: int, html: Column) -> Column:
        return F.when(r == n, html).otherwise(F.lit(""))

    home = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), F.col("s_name"), F.lit("</title>"),
        when_region(1, F.concat(
            F.lit('<script type="application/ld+json">[{"@type":"Organization","contactPoint":{"email":"Jobs\\u0040'),
            d, F.lit('"}},{"x":["see hr@'), d, F.lit('"],"key@'), d, F.lit('":1}]</script>'))),
        F.lit('<style>p{margin:0}</style><script>var t="q@tracker.example";</script></head><body>'),
        F.lit("<!-- c@comment.example --><h1>"), F.col("s_name"), F.lit("</h1>"),
        when_region(0, F.concat(F.lit('<a HREF="MAILTO:Info@'), d,
                                F.lit('?subject=Hi%20x">Mail</a>'),
                                F.when(k % 2 == 0, F.concat(F.lit("<a href=mailto:Sales@"), d, F.lit(">Sales</a>")))
                                .otherwise(F.lit("")))),
        when_region(1, F.concat(F.lit('<span class="__cf_email__" data-cfemail="'),
                                cf_encode(F.concat(F.lit("kontakt@"), d), key),
                                F.lit('">[email protected]</span>'))),
        when_region(2, F.lit('<iframe src="/frame/a"></iframe><iframe src=/frame/b></iframe>'
                             "<iframe src='/frame/c'></iframe>" '<iframe src="/frame/kontakt"></iframe>')),
        when_region(4, F.concat(F.lit('<a href="mailto:O\'Brien@'), d, F.lit('">B</a>'))),
        F.lit("<p>Ansprechpartner: "), person, F.lit("</p>"),
        F.lit('<iframe src="https://other.example/b"></iframe></body></html>'),
    )
    frame = F.concat(
        F.lit("<html><body><p>Kontakt: "),
        when_region(2, F.concat(F.lit("<b>"), F.repeat(F.lit("lorem "), 50), F.lit("</b>office [at] "), F.replace(d, F.lit("."), F.lit(" [dot] ")))),
        F.lit("</p></body></html>"),
    )
    imprint = F.concat(
        F.lit("<html><body><h2>Impressum</h2>"),
        when_region(3, F.concat(F.lit("<a href='mailto:team@"), d, F.lit("'>Team</a>"))),
        F.lit("<p>"), F.col("s_name"), F.lit("</p></body></html>"),
    )
    home_url = F.when(k % 3 == 0, F.concat(F.lit("https://"), F.upper(d), F.lit(":443/#top"))) \
        .otherwise(F.concat(F.lit("https://"), d, F.lit("/")))
    imprint_url = F.when(k % 3 == 1, F.concat(F.lit("HTTP://"), F.upper(d), F.lit(":80/impressum"))) \
        .otherwise(F.concat(F.lit("http://"), d, F.lit("/impressum")))
    pages = F.array(
        F.struct((k * 10 + 1).alias("page_id"), home_url.alias("url"),
                 home.alias("html")),
        F.struct((k * 10 + 2).alias("page_id"), F.concat(F.lit("https://"), d, F.lit("/frame/kontakt")).alias("url"),
                 frame.alias("html")),
        F.struct((k * 10 + 3).alias("page_id"), imprint_url.alias("url"),
                 imprint.alias("html")),
    )
    return s.select(F.explode(pages).alias("p")).select("p.page_id", "p.url", "p.html")


def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, email)`` — one personal contact per supplier (mixed case), a
    second one for region-0 sites, and a job-board relay address for
    suppliers with a balance over 9000 (dropped by the domain bad list)."""
    s = suppliers_with_sites(spark, sf_dir)
    k, d = F.col("s_suppkey"), F.col("domain")
    person = s.select(k.alias("seq"), F.concat(F.lit("P"), k.cast("string"), F.lit(".Contact@"),
                                                F.upper(d)).alias("email"))
    second = s.where(F.col("n_regionkey") == 0).select(
        (k + F.lit(1_000_000_000)).alias("seq"), F.concat(F.lit("sales."), k.cast("string"), F.lit("@"), d).alias("email"))
    relay = s.where(F.col("s_acctbal") > 9000).select(
        (k + F.lit(2_000_000_000)).alias("seq"), F.concat(F.lit("x"), k.cast("string"), F.lit("@jobs.aplitrak.com")).alias("email"))
    return person.unionByName(second).unionByName(relay)


def site_domain_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(domain, email_common)`` already known: sites of suppliers in debt."""
    s = suppliers_with_sites(spark, sf_dir)
    return s.where(F.col("s_acctbal") < 0).select("domain", F.lit(None).cast("string").alias("email_common"))


# ---------------------------------------------------------------------------
# Contacts derived from ``customer``: a person name in one of seven shapes
# (plain, "Last, First", titles and particles, a middle name, one word,
# blank; some with a suffix), null for customers in debt; the e-mail is built from the name.
# ---------------------------------------------------------------------------
FIRST_NAMES = ["Anna", "Max", "Lena", "Jan", "Maria", "Paul", "Sophie", "Lukas", "Andrea", "Kim"]
LAST_NAMES = ["Mueller", "Schmidt", "Heide", "Berg", "Wagner", "Becker", "Hoffmann", "Koch", "Richter", "Wolf"]
NAME_GENDER = [("Anna", "female"), ("Max", "male"), ("Lena", "female"), ("Jan", "male"),
               ("Maria", "female"), ("Paul", "male"), ("Sophie", "mostly_female"),
               ("Lukas", "male"), ("Andrea", "andy")]


def customer_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ingest_seq, company, person, email)`` — one contact per customer."""
    c = read_parquet(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey")
    first = F.element_at(F.array(*[F.lit(n) for n in FIRST_NAMES]), (k % 10 + 1).cast("int"))
    last = F.element_at(F.array(*[F.lit(n) for n in LAST_NAMES]), (F.floor(k / 10) % 10 + 1).cast("int"))
    shape = k % 7
    person = (F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
              .when(shape == 0, F.concat(first, F.lit(" "), last, F.when(k % 3 == 1, F.lit(" MBA")).otherwise(F.lit(""))))
              .when(shape == 1, F.concat(last, F.lit(", "), first))
              .when(shape == 2, F.concat(F.lit("Dr. "), first, F.lit(" von der "), last))
              .when(shape == 3, F.concat(first, F.lit(" Maria "), last, F.when(k % 2 == 1, F.lit(", PhD")).otherwise(F.lit(""))))
              .when(shape == 4, first)
              .when(shape == 5, F.concat(F.lit("Prof. Dr. "), first, F.lit(" van den "), last))
              .otherwise(F.lit("  ")))
    email = F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("."), k.cast("string"),
                     F.lit("@"), F.lower(F.col("c_mktsegment")), F.lit(".example"))
    return c.select(k.alias("ingest_seq"), F.col("c_mktsegment").alias("company"),
                    person.alias("person"), email.alias("email"))


def name_gender_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAME_GENDER, "first_name string, gender string")


def part_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings derived from ``part``: one per part; the contact person is
    missing for the largest sizes (so the any-null filter has work)."""
    p = read_parquet(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    brand = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    return p.select(
        F.col("p_partkey").alias("ingest_seq"),
        F.concat(F.lit("https://projects.example/projekte/projekt-"), F.col("p_partkey").cast("string"),
                 F.lit("-"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("url"),
        F.col("p_name").alias("project_name"),
        F.col("p_type").alias("project_description"),
        F.col("p_brand").alias("company"),
        F.when(F.col("p_size") <= 45, F.concat(F.lit("Agent "), brand)).alias("person"),
        F.concat(F.lit("jobs@"), brand, F.lit(".example")).alias("email"),
    )


# ---------------------------------------------------------------------------
# Job-board pages derived from ``part`` (the projects) and the first supplier
# of each part in ``lineitem`` (the agency): one detail page per part and
# listing pages of 100 cards. Parts without a supplier have no agency block.
# The contact block uses layout variant 1 for even sizes, variant 2 for odd.
# ---------------------------------------------------------------------------
LISTING_PAGE_SIZE = 100


def _part_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_parquet(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    # first line of the part by (order, line number); line numbers are below 100,
    # so the packed long keeps that order and the aggregate stays fixed-width.
    first = li.groupBy("l_partkey").agg(
        F.min_by("l_suppkey", F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("l_suppkey"))
    sup = read_parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = spread(read_parquet(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return (part.join(first, part.p_partkey == first.l_partkey, "left")
            .join(sup, F.col("l_suppkey") == sup.s_suppkey, "left")
            .select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "s_suppkey", "s_name"))


def _agent(k: Column) -> tuple[Column, Column, Column]:
    """First name, last name and address of a supplier's contact."""
    first = F.element_at(F.array(*[F.lit(n) for n in FIRST_NAMES]), (k % 10 + 1).cast("int"))
    last = F.element_at(F.array(*[F.lit(n) for n in LAST_NAMES]), (F.floor(k / 10) % 10 + 1).cast("int"))
    return first, last, F.concat(F.lower(first), F.lit("@s"), k.cast("string"), F.lit(".example"))


def posting_url(partkey: Column, name: Column) -> Column:
    return F.concat(F.lit("https://projects.example/projekte/projekt-"), partkey.cast("string"),
                    F.lit("-"), F.replace(name, F.lit(" "), F.lit("-")))


def posting_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html)`` — one detail page per part."""
    a = _part_agency(spark, sf_dir)
    k = F.col("s_suppkey")
    first, last, email = _agent(k)
    person = F.concat(first, F.lit(" "), last)
    v1 = F.concat(
        F.lit('<div class="list-item-main"><span class="h5">'), person, F.lit("</span></div>"),
        F.lit('<div class="col-sm-6 margin-bottom-sm"><b>E-Mail:</b> <a href="mailto:'), email, F.lit('">'),
        email, F.lit("</a></div>"))
    v2 = F.concat(
        F.lit('<div class="media-body"><div class="col-md-6">'), person, F.lit("\nRecruiting</div></div>"),
        F.lit('<div class="col-md-6">Kontakt: '), email, F.lit(' <a href="mailto:'), email, F.lit('">'),
        email, F.lit("</a></div>"))
    agency = F.when(k.isNull(), F.lit("")).otherwise(F.concat(
        F.lit('<div class="project-header"><span>Projekt</span> <a onclick="window.open(\'/firma/'),
        k.cast("string"), F.lit('\')" href="#">'), F.col("s_name"), F.lit("</a></div>"),
        F.when(F.col("p_size") % 2 == 0, v1).otherwise(v2)))
    html = F.concat(
        F.lit('<html><body><div class="highlight-text"><h1 class="margin-bottom-xs"> '), F.col("p_name"),
        F.lit(" </h1></div>"), agency,
        F.lit('<div class="other"><a onclick="window.open(1)">Another company</a></div>'
              '<div class="panel-body highlight-text"><div><p>'), F.col("p_type"), F.lit("</p></div> <div><p>"),
        F.col("p_brand"), F.lit("</p></div></div><div>After the description</div></body></html>"))
    return a.select(F.col("p_partkey").alias("page_id"),
                    posting_url(F.col("p_partkey"), F.col("p_name")).alias("url"), html.alias("html"))


def posting_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html, listed_at)`` — listing pages of ``LISTING_PAGE_SIZE`` cards.
    A page gathers at most that many cards, so no group is unbounded."""
    p = read_parquet(spark, sf_dir, "part").select("p_partkey", "p_name")
    link = F.concat(F.lit("/projekte/projekt-"), F.col("p_partkey").cast("string"), F.lit("-"),
                    F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    card = F.when(F.col("p_partkey") % 2 == 0, F.concat(
        F.lit('<search-project-card><a class="small fw-semibold link-warning" href="'), link, F.lit('">'))).otherwise(F.concat(
            F.lit("<search-project-card><div><a href=/firma/1>Firma</a><p><a href='"), link,
            F.lit("' class='link-warning fw-semibold x small'>")))
    card = F.concat(card, F.col("p_name"), F.lit("</a></div></search-project-card>"))
    page_no = (F.floor(F.col("p_partkey") / LISTING_PAGE_SIZE) + 1).cast("long")
    grouped = (p.select(page_no.alias("page_id"), F.struct("p_partkey", card.alias("card")).alias("c"))
               .groupBy("page_id").agg(F.sort_array(F.collect_list("c")).alias("cards")))
    return grouped.select(
        "page_id",
        F.concat(F.lit("https://projects.example/projekte?page="), F.col("page_id").cast("string"),
                 F.lit("&pageSize="), F.lit(str(LISTING_PAGE_SIZE))).alias("url"),
        F.concat(F.lit("<html><body>"), F.array_join(F.transform("cards", lambda c: c["card"]), ""),
                 F.lit("</body></html>")).alias("html"),
        F.date_sub(F.lit("2024-01-30").cast("date"), (F.col("page_id") % 10).cast("int")).cast("timestamp_ntz")
        .alias("listed_at"))


def agency_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact master of earlier runs: the agencies of every fourth supplier."""
    s = read_parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_name").where(F.col("s_suppkey") % 4 == 0)
    first, last, email = _agent(F.col("s_suppkey"))
    return s.select(F.col("s_name").alias("company"), F.concat(first, F.lit(" "), last).alias("person"),
                    email.alias("email"), F.lit("unknown").alias("gender"), first.alias("first_name"),
                    last.alias("last_name"))
