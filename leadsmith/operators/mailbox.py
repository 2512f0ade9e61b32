"""Generic-mailbox selection per company domain (J3-J6, J8, A2-A4, C5 core).

Instead of fetching URLs one domain at a time, all domains are handled at
once: a captured page's URL is cut into scheme, host and path, pages with a
contact path are joined with the domains on the host (one row per domain),
findings are extracted inside the tasks, same-host iframe pages are joined on
their URL, and the best candidate per domain is one ``min_by`` aggregate over
(scheme tier, local-part rank).
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.functions.text import norm_str, normalize_url
from leadsmith.operators.dedupe import keep_first
from leadsmith.operators.extract import _staged_pages, kept_emails
from leadsmith.session import ensure_checkpoint_root
from leadsmith.sources.lookups import BASE_TEMPLATES, CONTACT_PATHS, LOCAL_PARTS

def _ranked_parts(spark, local_parts) -> DataFrame:
    """``(lp, rank)``: the first rank of every local part (list order)."""
    if isinstance(local_parts, DataFrame):
        rows = local_parts.select(F.col("local_part").alias("lp"), F.col("rank"))
    else:
        rows = spark.createDataFrame([(p, i + 1) for i, p in enumerate(local_parts)], "lp string, rank int")
    return (rows.select(norm_str("lp").alias("lp"), "rank").where(F.col("lp").isNotNull() & (F.col("lp") != ""))
            .groupBy("lp").agg(F.min("rank").alias("rank")))


def candidates(domains: DataFrame, local_parts=LOCAL_PARTS, domain_col: str = "domain") -> DataFrame:
    """``lp@domain`` per domain and local part, lower-cased, with ``rank``
    (list order); blank local parts skipped. One explode per domain row."""
    if isinstance(local_parts, DataFrame):
        listed = local_parts.select("rank", norm_str("local_part").alias("lp")).where(
            F.col("lp").isNotNull() & (F.col("lp") != ""))
        parts = listed.agg(F.array_sort(F.collect_list(F.struct("rank", "lp")))).scalar()
    else:
        named = [p.strip().lower() for p in local_parts if p is not None and p.strip() != ""]
        parts = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(p).alias("lp")) for i, p in enumerate(named)])
    return (domains.select(domain_col).distinct()
            .select(domain_col, F.inline(parts))
            .select(domain_col, "rank", F.lower(F.concat("lp", F.lit("@"), F.col(domain_col))).alias("email")))


def frontier(domains: DataFrame, extra_paths: Sequence[str] = (), domain_col: str = "domain") -> DataFrame:
    """J4 + U3: every URL to look at per domain: tier 1 = https, tier 2 = http;
    within a tier ``url_rank`` orders base then path; each URL is the path
    resolved against the base.

    The default paths are distinct relative paths and the two bases of a
    tier differ in host, so every (domain, URL) is unique and no
    de-duplication pass runs. Extra paths (possibly absolute or rooted) can
    resolve to a URL already listed; then the first by rank is kept."""
    paths: list[str] = []
    for p in [*CONTACT_PATHS, *extra_paths]:
        if p not in paths:
            paths.append(p)
    # The grid is a small literal list: each base + path is resolved once here
    # (standard URL joining against a "{d}" placeholder host); per row only the
    # domain is put in.
    grid = []
    for tier, base_rank, template in BASE_TEMPLATES:
        for path_rank, path in enumerate(paths, start=1):
            grid.append(F.struct(F.lit(tier).alias("tier"),
                                 F.lit((base_rank - 1) * len(paths) + path_rank).alias("url_rank"),
                                 F.lit(urljoin(template, path)).alias("url_template")))
    d = F.col(domain_col)
    urls = (domains.select(domain_col).distinct()
            .select(domain_col, F.inline(F.array(*grid)))
            .select(domain_col, "tier", "url_rank",
                    F.replace(F.col("url_template"), F.lit("{d}"), d).alias("url")))
    if not extra_paths:
        return urls
    return keep_first(urls, [domain_col, "tier", "url"], "url_rank")


def fetch(domains: DataFrame, pages: DataFrame, extra_paths: Sequence[str] = (),
          domain_col: str = "domain") -> DataFrame:
    """The captured pages of each domain's frontier, on normalised URLs (host
    case, default port, fragment): ``(domain, tier, url_rank, url, html)``.

    The contact paths are looked up in the scan; only pages that have one meet the
    domains, on their host. Extra paths are taken below the domain."""
    paths = list(dict.fromkeys(urlsplit(urljoin("http://host/", p)).path.lstrip("/")
                               + (f"?{q}" if (q := urlsplit(p).query) else "")
                               for p in [*CONTACT_PATHS, *extra_paths]))
    path_rank = F.create_map(*[x for i, p in enumerate(paths, 1) for x in (F.lit(p), F.lit(i))])
    parts = with_url_parts(pages.select("url", "html"), "url")
    tier = F.when(F.col("__scheme") == "https", 1).when(F.col("__scheme") == "http", 2)
    www = F.startswith(F.col("__host"), F.lit("www."))
    found = (parts.where(F.col("__path").isin(paths) & tier.isNotNull())
             .select(F.regexp_replace("__host", r"^www\.", "").alias(domain_col), tier.alias("tier"),
                     (F.when(www, len(paths)).otherwise(0) + path_rank[F.col("__path")]).alias("url_rank"),
                     F.col("__url").alias("url"), "html"))
    return found.join(domains.select(domain_col).distinct(), domain_col)


def with_url_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Adds ``__url`` (normalised), ``__scheme``, ``__host`` and ``__path`` (with its
    query, without the leading slash)."""
    staged = df.select("*", normalize_url(url_col).alias("__url"))
    rest = F.regexp_extract("__url", r"^[a-z][a-z0-9+.\-]*://([^/?]*)(.*)$", 2)
    return staged.select("*", F.split_part(F.col("__url"), F.lit(":"), F.lit(1)).alias("__scheme"),
                         F.regexp_extract("__url", r"^[a-z][a-z0-9+.\-]*://([^/?]*)", 1).alias("__host"),
                         F.regexp_replace(rest, "^/", "").alias("__path"))


def page_items(domains: DataFrame, pages: DataFrame, exact_text: bool = True, extra_paths: Sequence[str] = (),
               frame_limit: int | None = None) -> DataFrame:
    """``(domain, tier, url, kind, value)``: the addresses (kind ``email``) and iframe
    URLs (``frame``) of the domains' captured pages."""
    fetched = fetch(domains, pages, extra_paths)
    staged = _staged_pages(fetched, "url_rank", "url", "html", "domain", ["tier"], exact_text, frame_limit)
    items = F.concat(
        F.transform(kept_emails("domain"), lambda e: F.struct(F.lit("email").alias("kind"), e.alias("value"))),
        F.transform("iframes", lambda u: F.struct(F.lit("frame").alias("kind"), u.alias("value"))),
    )
    return staged.select("domain", "tier", "url", F.inline(items))


def site_findings(domains: DataFrame, pages: DataFrame, exact_text: bool = True, extra_paths: Sequence[str] = (),
                  frame_limit: int | None = None) -> DataFrame:
    """Findings ``(domain, tier, url, email)`` of the domains' captured pages: the
    page's own addresses (A3 applied in the page's row) plus those of its same-host
    iframe pages (J6, A3 per frame page). Rows may repeat.

    Each fetched page becomes small item rows (an address, or an iframe URL), which
    are the one written intermediate (a reliable checkpoint): the HTML work is done
    once. The iframe pages are then joined on their normalised URL."""
    ensure_checkpoint_root(pages.sparkSession)
    rows = page_items(domains, pages, exact_text, extra_paths, frame_limit).checkpoint(eager=True)
    own = rows.where(F.col("kind") == "email").select("domain", "tier", "url", F.col("value").alias("email"))
    frame_items = rows.where(F.col("kind") == "frame").select(
        "domain", "tier", "url", normalize_url("value").alias("frame_url"))
    frame_pages = pages.select(normalize_url("url").alias("frame_url"), "html")
    framed = frame_items.join(frame_pages, "frame_url")
    staged_frames = _staged_pages(framed, "frame_url", "frame_url", "html", "domain", ["tier", "url"], exact_text)
    frame_found = (staged_frames.select("domain", "tier", "url", F.explode_outer(kept_emails("domain")).alias("email"))
                   .where(F.col("email").isNotNull()))
    return own.unionByName(frame_found)


def best_hits(findings: DataFrame, local_parts=LOCAL_PARTS, domain_col: str = "domain") -> DataFrame:
    """J5 + A2 + A4: ``(domain, email_common)`` for domains with a hit.

    Each finding is tested directly: it is a candidate iff it ends with
    ``@domain`` and the part before is in the local-part list, which is joined on
    that part; no candidate table is built. Repeated findings do not change a
    ``min_by``, so none are removed first; the aggregate is partial (map-side),
    so a domain never sits whole in one task."""
    d, e = F.col(domain_col), F.col("email")
    suffix = F.concat(F.lit("@"), d)
    hits = (findings.select(domain_col, "tier", "email").where(e.endswith(suffix))
            .withColumn("lp", F.substr(e, F.lit(1), F.length(e) - F.length(suffix)))
            .join(_ranked_parts(findings.sparkSession, local_parts), "lp"))
    return hits.groupBy(domain_col).agg(
        F.min_by("email", F.struct("tier", "rank")).alias("email_common"))


def best_candidate(domains: DataFrame, findings: DataFrame, local_parts=LOCAL_PARTS,
                   domain_col: str = "domain") -> DataFrame:
    """``best_hits`` for every domain of ``domains``; null where none was found."""
    return domains.select(domain_col).distinct().join(
        best_hits(findings, local_parts, domain_col), domain_col, "left")


def domain_addresses(findings: DataFrame, domain_col: str = "domain", url_col: str = "url", email_col: str = "email",
                     source_col: str = "source") -> DataFrame:
    """A2: ``(domain, email, n_pages, sources)``: every address found for a domain. A group
    is one address of one domain, so a free-mail domain is split by its addresses."""
    return (findings.groupBy(domain_col, email_col)
            .agg(F.count_distinct(url_col).alias("n_pages"), F.array_sort(F.collect_set(source_col)).alias("sources")))


def domain_summary(findings: DataFrame, domain_col: str = "domain", url_col: str = "url", email_col: str = "email",
                   source_col: str = "source") -> DataFrame:
    """A2: ``(domain, n_addresses, n_pages, n_sources)``. Distinct counts of several
    columns are two aggregates in Spark: the first over (domain, value), which splits a
    domain with many values, the second counts what is left."""
    return findings.groupBy(domain_col).agg(
        F.count_distinct(email_col).alias("n_addresses"), F.count_distinct(url_col).alias("n_pages"),
        F.count_distinct(source_col).alias("n_sources"))
