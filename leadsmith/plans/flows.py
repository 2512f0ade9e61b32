"""Composite flows (C1-C9): the reference's end-to-end steps as lazy plans.

Each flow is a chain of the library's operators. Filters that only depend on
a de-duplication key are applied before the de-duplication aggregate (same
rows, smaller shuffle); the funnel audit still reports in the original step
order because it is computed from flags, not from intermediate counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leadsmith.functions.text import email_domain_first, normalize_domain, normalize_url
from leadsmith.operators.audit import (
    contact_steps,
    domain_steps,
    funnel,
    observation_row,
    observed,
    posting_steps,
    record_steps,
)
from leadsmith.operators.dedupe import anti_master, keep_first
from leadsmith.operators.enrich import enrich_contacts
from leadsmith.operators.extract import POSTING_FIELDS, posting_fields, posting_links
from leadsmith.operators.filters import (
    drop_any_null,
    drop_incomplete,
    email_blocklist,
    exclude_terms,
    missing_fields,
    recency_filter,
    valid_domain,
    with_blocked_flag,
    with_term_flag,
)
from leadsmith.operators.mailbox import best_hits, site_findings
from leadsmith.operators.outbox import DEFAULT_TEMPLATE, build_outbox
from leadsmith.operators.tables import accumulate_merge, append_union, apply_changes, delete_keys
from leadsmith.sources.io import captured_pages, load_latest, write_version
from leadsmith.sources.lookups import CONTACT_BLOCKLIST, DOMAIN_BAD_LIST, LOCAL_PARTS, TITLE_TERMS


def common_mailbox(contacts: DataFrame, domain_master: DataFrame, pages: DataFrame,
                   local_parts=LOCAL_PARTS, bad_list: Sequence[str] | DataFrame = DOMAIN_BAD_LIST,
                   email_col: str = "email", order_col: str = "seq",
                   extra_paths: Sequence[str] = ()) -> DataFrame:
    """``(domain, email_common)`` for every new company domain.

    T4 domain of each contact -> P6 bad list on the domain -> J2 minus the
    domain master -> W2 first contact per domain -> P9 valid domain -> J4
    frontier -> J8 captured pages -> E*/U7 + J6 iframes + A3 -> J5/A4 best.
    """
    df = contacts.select(order_col, email_domain_first(email_col).alias("domain"))
    df = exclude_terms(df, "domain", bad_list)
    df = anti_master(df, domain_master, "domain")
    df = keep_first(df, "domain", order_col)
    df = df.select("domain", normalize_domain("domain").alias("search_domain"))
    return _mailboxes(df.where(valid_domain("search_domain")), pages, local_parts, extra_paths)


def flagged_domains(contacts: DataFrame, domain_master: DataFrame,
                    bad_list: Sequence[str] | DataFrame = DOMAIN_BAD_LIST, email_col: str = "email") -> DataFrame:
    """C5 up to the search, nothing dropped: one row per domain with its contacts
    (``n``), ``search_domain`` and what the steps say: ``listed``, ``known``, ``valid``."""
    per = contacts.select(email_domain_first(email_col).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    known = _known_keys(domain_master, "domain")
    per = with_term_flag(per, "domain", bad_list, "listed")
    per = per.join(known, per["domain"].eqNullSafe(known["__known_key"]), "left").drop("__known_key")
    return per.select("domain", "n", "listed", F.coalesce("__known", F.lit(False)).alias("known"),
                      normalize_domain("domain").alias("search_domain")) \
        .withColumn("valid", valid_domain("search_domain"))


def search_domains(contacts: DataFrame, domain_master: DataFrame, out_root: str,
                   bad_list: Sequence[str] | DataFrame = DOMAIN_BAD_LIST, email_col: str = "email") -> dict[str, DataFrame]:
    """C5 up to the search, with its audit. The flagged domains are written once below
    ``out_root`` and counted in that pass. Returns ``ready`` ``(domain, search_domain)``,
    ``rejected`` ``(domain, n)``: the new domains that are not valid (P9) and their
    contacts, and ``funnel``."""
    steps = domain_steps()
    found, seen = observed(flagged_domains(contacts, domain_master, bad_list, email_col), steps)
    domains = _written(found, f"{out_root.rstrip('/')}/domains")
    new = domains.where(~F.col("listed") & ~F.col("known"))
    return {"ready": new.where(F.col("valid")).select("domain", "search_domain"),
            "rejected": new.where(~F.col("valid")).select("domain", "n"),
            "funnel": observation_row(contacts.sparkSession, seen, steps)}


def mailbox_run(contacts: DataFrame, domain_master: DataFrame, pages: DataFrame, out_root: str,
                local_parts=LOCAL_PARTS, bad_list: Sequence[str] | DataFrame = DOMAIN_BAD_LIST,
                email_col: str = "email", extra_paths: Sequence[str] = ()) -> dict[str, DataFrame]:
    """C5 with its audit: ``mailboxes`` (the rows of ``common_mailbox``), and ``rejected``
    and ``funnel`` of ``search_domains``."""
    found = search_domains(contacts, domain_master, out_root, bad_list, email_col)
    return {"mailboxes": _mailboxes(found["ready"], pages, local_parts, extra_paths),
            "rejected": found["rejected"], "funnel": found["funnel"]}


def _mailboxes(ready: DataFrame, pages: DataFrame, local_parts, extra_paths: Sequence[str]) -> DataFrame:
    hits = site_findings(ready.select(F.col("search_domain").alias("domain")), captured_pages(pages), extra_paths=extra_paths)
    best = best_hits(hits, local_parts).withColumnRenamed("domain", "search_domain")
    return ready.join(best, "search_domain", "left").select("domain", "email_common")


def _known_keys(master: DataFrame, key: str) -> DataFrame:
    return master.select(F.col(key).alias("__known_key")).distinct().withColumn("__known", F.lit(True))


def _written(df: DataFrame, path: str) -> DataFrame:
    """A step's result as a table: written once, read by all that need it."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------- C1

CONTACT_COLS = ["company", "person", "email"]


def clean_contacts(new: DataFrame, master: DataFrame, blocklist=CONTACT_BLOCKLIST,
                   key: str = "email", order_col: str = "ingest_seq",
                   columns: Sequence[str] | None = None, normalize_key: bool = False) -> DataFrame:
    """P1 -> W1 keep first per address -> J1 minus master -> P5 blocklist.

    J1 and P5 depend only on the address, so they run before the keep-first
    aggregate (same rows, smaller shuffle)."""
    cols = list(columns) if columns is not None else [c for c in CONTACT_COLS if c in new.columns] or new.columns
    df = new.select(*dict.fromkeys([*cols, key, order_col]))
    df = anti_master(df, master, key)
    df = email_blocklist(df, key, blocklist)
    return keep_first(df, key, order_col, normalize_key=normalize_key).select(*dict.fromkeys([*cols, key]))


def flagged_contacts(new: DataFrame, master: DataFrame, blocklist=CONTACT_BLOCKLIST, key: str = "email",
                     order_col: str = "ingest_seq", columns: Sequence[str] | None = None) -> DataFrame:
    """C1 with nothing dropped: one row per address, the first one's columns (in
    ``row``), its rows (``n``) and what the steps say: ``known``, ``blocked``. All flags
    stand after the plan's one shuffle of rows, so a single pass gives result and audit."""
    cols = list(columns) if columns is not None else [c for c in CONTACT_COLS if c in new.columns] or new.columns
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*cols, key])])
    per = new.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"), F.min_by(row, F.struct(order_col)).alias("row"))
    known = _known_keys(master, key)
    per = per.join(known, per["__key"].eqNullSafe(known["__known_key"]), "left").drop("__known_key")
    return (with_blocked_flag(per.withColumn("known", F.coalesce("__known", F.lit(False))), "__key", blocklist, "blocked")
            .select("row", "n", "known", "blocked"))


def audited_contacts(new: DataFrame, master: DataFrame, blocklist=CONTACT_BLOCKLIST, key: str = "email",
                     order_col: str = "ingest_seq", columns: Sequence[str] | None = None) -> tuple[DataFrame, Observation]:
    """C1 and its funnel (A1) in one pass: the rows of ``clean_contacts``, and the
    observation of ``contact_steps``, filled when they are written."""
    flagged, seen = observed(flagged_contacts(new, master, blocklist, key, order_col, columns), contact_steps())
    return flagged.where(~F.col("known") & ~F.col("blocked")).select("row.*"), seen


def contact_funnel_counts(new: DataFrame, master: DataFrame, blocklist=CONTACT_BLOCKLIST,
                          key: str = "email") -> DataFrame:
    """A1 for C1 alone, in the reference's step order (duplicates, known, excluded)."""
    per = new.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = _known_keys(master, key)
    per = per.join(known, per[key].eqNullSafe(known["__known_key"]), "left").withColumnRenamed("__known", "known")
    return funnel(with_blocked_flag(per, key, blocklist, "blocked"), contact_steps())


# ---------------------------------------------------------------------------- C2
def clean_postings(raw: DataFrame, title_terms=TITLE_TERMS, title_col: str = "project_name") -> DataFrame:
    """P3 drop rows with any null -> P4 title exclusion."""
    return exclude_terms(drop_any_null(raw), title_col, title_terms)


def flagged_postings(raw: DataFrame, title_terms=TITLE_TERMS, title_col: str = "project_name") -> DataFrame:
    """C2 with nothing dropped: every raw row (``row``) with ``complete`` and ``excluded``,
    by the rules of ``clean_postings``, for a list of terms and for a table."""
    complete = F.lit(True)
    for c in raw.columns:
        complete = complete & F.col(c).isNotNull()
    packed = raw.select(F.struct(*[F.col(c) for c in raw.columns]).alias("row"), complete.alias("complete"),
                        F.col(title_col).alias("__title"))
    return with_term_flag(packed, "__title", title_terms, "excluded").drop("__title")


def audited_postings(raw: DataFrame, title_terms=TITLE_TERMS, title_col: str = "project_name") -> tuple[DataFrame, Observation]:
    """C2 and its funnel (A1) in one pass: the rows of ``clean_postings``, and the
    observation of ``posting_steps``, filled when they are written."""
    flagged, seen = observed(flagged_postings(raw, title_terms, title_col), posting_steps())
    return flagged.where(F.col("complete") & ~F.col("excluded")).select("row.*"), seen


def posting_funnel_counts(raw: DataFrame, title_terms=TITLE_TERMS, title_col: str = "project_name") -> DataFrame:
    """A1 for C2 alone."""
    return funnel(flagged_postings(raw, title_terms, title_col), posting_steps())


# ---------------------------------------------------------------------------- C3 / C4 / C7
def enrich(df: DataFrame, name_gender: DataFrame, person_col: str = "person") -> DataFrame:
    """Gender, first and last name."""
    return enrich_contacts(df, name_gender, person_col)


def append_master(master: DataFrame, enriched: DataFrame, key: str = "email") -> DataFrame:
    """C4: rows not yet in the master (J1), appended by name (U2). Running it
    twice with the same input adds nothing the second time."""
    return append_union(master, anti_master(enriched, master, key))


def outbox(enriched: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """The mails to send, as a table."""
    return build_outbox(enriched, template)


# ---------------------------------------------------------------------------- C9
def url_state_create(table_root: str, initial: DataFrame) -> str:
    """Version 1 of the URL state table. Fails if there is one already."""
    return write_version(initial, table_root, 1)


def url_state_update(table_root: str, changes: DataFrame | None = None, deletes: DataFrame | None = None,
                     key: str = "url", columns: Sequence[str] | None = None) -> str:
    """Apply a batch of upserts and deletes to the latest version of the URL
    state table and write the result as the next one. Columns that earlier batches
    added stay; a table that is missing raises. Returns the new version's path."""
    if changes is None and deletes is None:
        raise ValueError("nothing to apply")
    spark = (changes if changes is not None else deletes).sparkSession
    state, version = load_latest(spark, table_root)
    if changes is not None:
        state = apply_changes(state, changes, key=key, columns=columns)
    if deletes is not None:
        state = delete_keys(state, deletes, key=key)
    return write_version(state, table_root, version + 1)


# ---------------------------------------------------------------------------- C6 / C8

RAW_COLS = ["url", *POSTING_FIELDS]
AGENCY_COLS = ["company", "person", "email"]


def listed_details(listing: DataFrame, pages: DataFrame, period: int | None = None, as_of=None,
                   listed_col: str = "listed_at") -> DataFrame:
    """E8 links of the listing pages (P2: of a period, if one is given) -> the
    captured pages they lead to, on normalised URLs."""
    if period is not None:
        listing = recency_filter(listing, listed_col, period, as_of)
    links = posting_links(listing).select(normalize_url("link").alias("__link"))
    # Spark takes a page's exploded links to be as small as the page: without the hint it broadcasts them all.
    return pages.join(links.hint("shuffle_hash"), normalize_url(pages["url"]) == links["__link"], "left_semi")


def new_postings(listing: DataFrame, pages: DataFrame, period: int | None = None, as_of=None) -> DataFrame:
    """E9 fields of every listed detail page -> P7 complete records only."""
    fields = posting_fields(listed_details(listing, pages, period, as_of)).select(*RAW_COLS)
    return drop_incomplete(fields, RAW_COLS)


def audited_new_postings(listing: DataFrame, pages: DataFrame, period: int | None = None,
                         as_of=None) -> tuple[DataFrame, Observation]:
    """C6 up to P7, and why records failed: the rows of ``new_postings``, and the
    observation of ``record_steps`` over the required fields, filled in the same pass."""
    fields = posting_fields(listed_details(listing, pages, period, as_of)).select(*RAW_COLS)
    flagged, seen = observed(fields.withColumn("missing", missing_fields(RAW_COLS)), record_steps(RAW_COLS))
    return flagged.where(F.size("missing") == 0).drop("missing"), seen


def collect_postings(new: DataFrame, raw_base: DataFrame, sort: bool = True) -> DataFrame:
    """U1 of the new complete records into the accumulated raw postings table."""
    return accumulate_merge(raw_base.select(*RAW_COLS), new.select(*RAW_COLS), sort=sort)


def collect_agencies(new: DataFrame, agency_base: DataFrame, sort: bool = True) -> DataFrame:
    """C6 second half: the contact columns, accumulated the same way."""
    return accumulate_merge(agency_base.select(*AGENCY_COLS), new.select(*AGENCY_COLS), sort=sort)


def daily_run(listing: DataFrame, pages: DataFrame, raw_base: DataFrame, agency_base: DataFrame, master: DataFrame,
              name_gender: DataFrame, out_root: str, period: int | None = None, as_of=None,
              title_terms=TITLE_TERMS, blocklist=CONTACT_BLOCKLIST,
              template: str = DEFAULT_TEMPLATE) -> dict[str, DataFrame]:
    """C6 collect (postings and agencies) -> C2 postings -> C1 contacts -> C3
    enrich -> C4 master, C7 outbox, with the audit (A1) of each clean-up. The new
    records, the raw table, the postings and the contacts are written once below
    ``out_root`` and counted in that pass; every result reads them from there. Returns
    the results by name and the audits: ``record_funnel`` (P7: records without a
    field), ``posting_funnel`` and ``contact_funnel``. The caller writes the others, sorted
    if wanted."""
    spark, root = listing.sparkSession, out_root.rstrip("/")
    found, records = audited_new_postings(listing, pages, period, as_of)
    new = _written(found, f"{root}/new_postings")
    raw = _written(collect_postings(new, raw_base, sort=False), f"{root}/raw")
    kept, posted = audited_postings(raw, title_terms)
    postings = _written(kept, f"{root}/postings")
    first, met = audited_contacts(raw.select("url", *AGENCY_COLS), master, blocklist, order_col="url")
    contacts = _written(first, f"{root}/contacts")
    enriched = enrich(contacts, name_gender)
    return {"raw": raw, "agencies": collect_agencies(new, agency_base, sort=False),
            "postings": postings, "contacts": contacts, "enriched": enriched,
            "master": append_master(master, enriched), "outbox": outbox(enriched, template),
            "record_funnel": observation_row(spark, records, record_steps(RAW_COLS)),
            "posting_funnel": observation_row(spark, posted, posting_steps()),
            "contact_funnel": observation_row(spark, met, contact_steps())}
