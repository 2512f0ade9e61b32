"""Text -> contact extraction (E1-E10, U7, A3, A5) over page / document tables.

Addresses and attribute values are found with Java patterns; whatever depends
on the structure of a page (labels, cards, posting fields, scripts) is stated
on what one scan of the page returns (``functions.html``). Findings are
rows ``(<id cols>, source, email)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsmith.functions.html import card_links, page_parts, posting_texts
from leadsmith.functions.text import (
    _c,
    clean_text,
    email_matches,
    norm_str,
    resolve_url,
    same_host,
    strip_ws,
    unescape_basic,
    with_visible_text,
)
from leadsmith.operators.filters import non_empty_link
from leadsmith.sources.lookups import CARD_LINK_CLASSES, CARD_TAG, EMAIL_PATTERN, LABEL_PATTERN, ZERO_WIDTH

# An attribute's value is written "..", '..' or bare.
MAILTO_RE = r"""(?is)\bhref\s*=\s*("\s*mailto:[^"]*"|'\s*mailto:[^']*'|mailto:[^\s"'<>]*)"""
ANCHOR_HREF_RE = r"""(?is)<a\b[^<>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
CF_TAG_RE = r"""(?is)<(?:a|span)\b(?=[^<>]*+>)[^<>]*__cf_email__[^<>]*+>"""
CF_ATTR_RE = r"""(?is)data-cfemail\s*=\s*["']\s*([^"'\s]*)"""
# Pages without any of these hold no label, JSON-LD or iframe finding.
STRUCTURE_RE = r"(?i)ld\+json|<iframe|e-?mail|kontakt|contact|impressum"
# A text without any of these holds no address, not even one written out in words.
MAY_HOLD_ADDRESS_RE = r"(?i)@|&|\bat\b|[" + "".join(ZERO_WIDTH) + "]"


def _attribute_value(written: Column) -> Column:
    return unescape_basic(F.regexp_replace(written, r"""^(["'])(.*)\1$""", "$2"))


_parts = page_parts(LABEL_PATTERN)
_card_links = card_links(CARD_TAG, CARD_LINK_CLASSES)


# --------------------------------------------------------------------------- E1


def scan_emails(df: DataFrame, text_col: str, keep: Sequence[str], source: str = "raw",
                with_pos: bool = False) -> DataFrame:
    """Every generic address match, lower-cased; ``pos`` is the 1-based match order.
    The generators are outer ones, so that no text is searched twice (see
    ``extract_page_findings``)."""
    if with_pos:
        return (df.select(*keep, F.posexplode_outer(email_matches(text_col)).alias("pos", "email"))
                .where(F.col("email").isNotNull())
                .select(*keep, (F.col("pos") + 1).alias("pos"), F.lit(source).alias("source"),
                        F.lower("email").alias("email")))
    return (df.select(*keep, F.explode_outer(email_matches(text_col)).alias("email"))
            .where(F.col("email").isNotNull())
            .select(*keep, F.lit(source).alias("source"), F.lower("email").alias("email")))


# --------------------------------------------------------------------------- E2 / E3


def mailto_emails(html: Column) -> Column:
    """Addresses of ``mailto:`` links (any case, ``?query`` cut off),
    unescaped, stripped, lower-cased; empty ones dropped."""
    values = F.transform(F.regexp_extract_all(html, F.lit(MAILTO_RE), F.lit(1)), _attribute_value)
    cleaned = F.transform(values, lambda v: F.lower(strip_ws(F.split_part(
        F.regexp_replace(v, r"(?i)^\s*mailto:", ""), F.lit("?"), F.lit(1)))))
    return F.array_distinct(F.filter(cleaned, lambda m: m != ""))


# --------------------------------------------------------------------------- E4


def decode_cfemail(hex_col) -> Column:
    """First byte is the XOR key for the rest; UTF-8 with bad bytes dropped;
    null unless the result contains ``@``; odd length or non-hex -> null."""
    h = strip_ws(_c(hex_col))
    n = F.length(h)
    valid = (n >= 2) & (n % 2 == 0) & h.rlike(r"^[0-9A-Fa-f]+$")
    key = F.conv(F.substr(h, F.lit(1), F.lit(2)), 16, 10).cast("int")
    body = F.array_join(
        F.transform(
            F.sequence(F.lit(2), F.greatest(n / 2, F.lit(2)).cast("int")),
            lambda i: F.lpad(F.hex(F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
                                   .bitwiseXOR(key)), 2, "0"),
        ),
        "",
    )
    decoded = F.replace(F.make_valid_utf8(F.unhex(body).cast("string")), F.lit("\ufffd"), F.lit(""))
    decoded = F.when(n > 2, decoded).otherwise(F.lit(""))
    return F.when(valid & decoded.contains("@"), decoded)


def cfemail_emails(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit(CF_TAG_RE), F.lit(0))
    hexes = F.transform(tags, lambda t: F.regexp_extract(t, CF_ATTR_RE, 1))
    decoded = F.transform(F.filter(hexes, lambda x: x != ""), lambda x: F.lower(decode_cfemail(x)))
    return F.filter(decoded, lambda x: x.isNotNull())


# --------------------------------------------------------------------------- E5

# A JSON string; a key with the string under it, a key alone, or a string alone.
_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'
JSON_TOKEN_RE = rf"(?s){_JSON_STRING}(?:\s*+:(?:\s*+{_JSON_STRING})?+)?+"
JSON_KEYED_RE = rf"(?s)^({_JSON_STRING})\s*+:\s*+({_JSON_STRING})$"


def _json_decoded(literal: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(literal), "$", "string")


def json_strings(bodies: Column) -> Column:
    """``(key, value)``: the strings with ``@`` in the JSON texts of each script body of
    a page, with the key that they directly stand under. A text counts if it parses as
    a VARIANT; from the first broken one on, the rest of its body is skipped. The
    strings of a text that parses are found by a pattern that never goes back."""
    def whole(texts):
        broken = F.array_position(F.transform(texts, lambda t: F.try_parse_json(t).isNull()), True)
        return F.when(broken == 0, texts).otherwise(F.slice(texts, F.lit(1), (broken - 1).cast("int")))

    texts = F.flatten(F.transform(bodies, whole))
    # Few texts hold an address at all: plain, or with a written-out code point.
    texts = F.filter(texts, lambda t: F.contains(t, F.lit("@")) | F.contains(t, F.lit("\\u")))
    tokens = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(JSON_TOKEN_RE), F.lit(0))))
    tokens = F.filter(tokens, lambda t: ~F.endswith(t, F.lit(":")) & (F.contains(t, F.lit("@")) | F.contains(t, F.lit("\\u"))))

    def pair(t):
        key = F.regexp_extract(t, JSON_KEYED_RE, 1)
        return F.struct(F.when(key != "", _json_decoded(key)).alias("key"),
                        _json_decoded(F.when(key != "", F.regexp_extract(t, JSON_KEYED_RE, 2)).otherwise(t)).alias("value"))

    return F.filter(F.transform(tokens, pair), lambda s: F.contains(s["value"], F.lit("@")))


def jsonld_emails(strings: Column) -> Column:
    """E5 on ``json_strings``: generic matches in the string values, and every value
    with ``@`` under an ``email`` / ``e-mail`` key. Keys are no values."""
    generic = F.flatten(F.transform(strings, lambda s: email_matches(s["value"])))
    keyed = F.transform(F.filter(strings, lambda s: F.lower(s["key"]).isin("email", "e-mail")
                                 & F.contains(s["value"], F.lit("@"))), lambda s: s["value"])
    return F.array_distinct(F.transform(F.concat(generic, keyed), lambda m: F.lower(strip_ws(m))))


def with_nodes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``__nodes`` (a page's iframes and label segments) and ``__json`` (its JSON-LD
    strings), from one scan of the page. Pages that can hold no structural finding have
    none."""
    staged = pages.select("*", _parts(F.when(F.col(html_col).rlike(STRUCTURE_RE), F.col(html_col))).alias("__nodes"))
    return staged.select("*", json_strings(F.col("__nodes")["json"]).alias("__json"))


# --------------------------------------------------------------------------- E6 / E10


def text_emails(text: Column) -> Column:
    return F.transform(email_matches(text), lambda m: F.lower(m))


def label_emails(nodes: Column) -> Column:
    """Addresses in the element around each text that holds a contact label,
    whatever its length; the element's text is cleaned like any other (T1, without
    the compatibility forms that the text of the page covers)."""
    segments = F.transform(F.filter(nodes["segments"], lambda t: F.rlike(t, F.lit(MAY_HOLD_ADDRESS_RE))),
                           lambda t: clean_text(t, exact=False))
    return F.array_distinct(F.flatten(F.transform(segments, text_emails)))


# --------------------------------------------------------------------------- E7 / E8


def iframe_links(nodes: Column, base_url: Column, domain: Column, limit: int | None = None) -> Column:
    """Resolved same-host iframe URLs in document order; with a ``limit``
    the first ones only."""
    srcs = F.transform(nodes["iframes"], strip_ws)
    resolved = F.transform(F.filter(srcs, lambda s: s != ""), lambda s: resolve_url(base_url, s))
    found = F.filter(resolved, lambda u: same_host(u, domain))
    return found if limit is None else F.slice(found, 1, limit)


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """E8 + T3 + P10: every anchor ``href`` in document order, made absolute."""
    hrefs = F.transform(F.regexp_extract_all(F.col(html_col), F.lit(ANCHOR_HREF_RE), F.lit(1)), _attribute_value)
    return (pages.select(id_col, url_col, F.posexplode_outer(hrefs).alias("pos", "href"))
            .where(non_empty_link("href"))
            .select(id_col, (F.col("pos") + 1).alias("pos"),
                    resolve_url(F.col(url_col), F.col("href")).alias("link")))


# --------------------------------------------------------------------------- U7 / A3


def _page_arrays(html: Column, text: Column) -> list[tuple[str, Column]]:
    """The finding sources of a page staged with ``with_nodes``."""
    return [
        ("cf", cfemail_emails(html)),
        ("mailto", mailto_emails(html)),
        ("jsonld", jsonld_emails(F.col("__json"))),
        ("text", text_emails(text)),
        ("label", label_emails(F.col("__nodes"))),
        ("raw", F.transform(email_matches(html), lambda m: F.lower(m))),
    ]


def _staged_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str, domain_col: str,
                  keep: Sequence[str], exact_text: bool, frame_limit: int | None = None) -> DataFrame:
    """Visible text and nodes staged once, then every source array of the page,
    their union, its iframes and the same-domain flag (A3), all in its own row."""
    staged = with_visible_text(pages.select(id_col, *keep, url_col, domain_col, html_col),
                               html_col, "__text", exact=exact_text)
    staged = with_nodes(staged, html_col)
    html = F.col(html_col)
    arrays = _page_arrays(html, F.col("__text"))
    staged = staged.select(
        id_col, *keep, url_col, domain_col,
        F.length("__text").alias("text_len"),
        iframe_links(F.col("__nodes"), F.col(url_col), F.col(domain_col), frame_limit).alias("iframes"),
        F.array(*[F.struct(F.lit(name).alias("source"), arr.alias("emails")) for name, arr in arrays])
        .alias("__src"),
    )
    all_emails = F.filter(F.array_distinct(F.flatten(F.transform("__src", lambda x: x["emails"]))),
                          lambda e: e.isNotNull() & (e != ""))
    suffix = F.concat(F.lit("@"), F.col(domain_col))
    staged = staged.select("*", all_emails.alias("__all"))
    return staged.select(
        "*", F.coalesce(F.exists("__all", lambda e: e.endswith(suffix)), F.lit(False)).alias("__any_same"))


def extract_page_findings(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                          html_col: str = "html", domain_col: str = "domain",
                          exact_text: bool = True, keep: Sequence[str] = (),
                          prefer_same_domain: bool = False, with_iframes: bool = True) -> DataFrame:
    """All finding sources of a page in one scan, one ``explode``.

    Output ``(id, [keep], url, domain, text_len, [iframes], source, email)``.
    With ``prefer_same_domain`` the A3 rule (keep only ``@domain`` addresses
    when the page has any) is applied inside the page's row, before the
    explode: no join and no shuffle.
    """
    keep = list(keep)
    staged = _staged_pages(pages, id_col, url_col, html_col, domain_col, keep, exact_text)
    extra = ["iframes"] if with_iframes else []
    suffix = F.concat(F.lit("@"), F.col(domain_col))
    # Outer generators: for the others Spark would test the arrays for rows beforehand,
    # below the projection, and so read every page twice.
    rows = (staged.select(id_col, *keep, url_col, domain_col, "text_len", *extra, "__any_same",
                          F.explode_outer("__src").alias("__s"))
            .select(id_col, *keep, url_col, domain_col, "text_len", *extra,
                    "__any_same", F.col("__s.source").alias("source"), F.explode_outer("__s.emails").alias("email"))
            .where(F.col("email").isNotNull() & (F.col("email") != "")))
    if prefer_same_domain:
        rows = rows.where(~F.col("__any_same") | F.col("email").endswith(suffix))
    return rows.drop("__any_same")


def page_summaries(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", domain_col: str = "domain",
                   exact_text: bool = True, frame_limit: int | None = None) -> DataFrame:
    """U7 + A3 + A5 per page, without a shuffle: ``(id, emails_extracted,
    iframe_candidates, text_len)`` for every page: the sorted distinct
    addresses kept by the same-domain rule and the same-host iframe URLs
    (document order), comma-joined, and the length of the visible text."""
    staged = _staged_pages(pages, id_col, url_col, html_col, domain_col, [], exact_text, frame_limit)
    return staged.select(
        id_col,
        F.array_join(F.sort_array(kept_emails(domain_col)), ",").alias("emails_extracted"),
        F.array_join("iframes", ",").alias("iframe_candidates"),
        F.col("text_len").cast("long").alias("text_len"),
    )


def kept_emails(domain_col: str = "domain") -> Column:
    """A3 in-row on a staged page: the page's addresses of its own domain if
    it has any, else all of them."""
    suffix = F.concat(F.lit("@"), F.col(domain_col))
    return F.when(F.col("__any_same"), F.filter("__all", lambda e: e.endswith(suffix))) \
        .otherwise(F.col("__all"))


def prefer_domain(findings: DataFrame, group_col: str, email_col: str = "email",
                  domain_col: str = "domain") -> DataFrame:
    """A3 on a findings table: per group, if any address ends with
    ``@domain`` keep only those. A window over the group (the findings of
    one page or document, bounded by its text); no self-join, so the input
    is computed once. Row-level page extraction applies the same rule inside
    the page's row instead (``kept_emails``)."""
    from pyspark.sql import Window
    is_same = F.coalesce(F.col(email_col).endswith(F.concat(F.lit("@"), F.col(domain_col))), F.lit(False))
    flagged = findings.withColumn("__same", is_same)
    w = Window.partitionBy(group_col)
    return (flagged.withColumn("__any_same", F.max("__same").over(w))
            .where(F.col("__same") | ~F.col("__any_same"))
            .drop("__same", "__any_same"))


# --------------------------------------------------------------------------- E8 (cards) / E9 / W4

# Where a posting's fields stand on its page. Per field and variant:
# the classes of a ``div``, a text it must hold, whether all such elements count or
# the first only, and in them the first one of the given tag with the attribute value
# (exact, or its beginning); variant 2 is used only where variant 1 finds nothing.
POSTING_FIELD_SPEC = [
    ("project_name", 1, (["highlight-text"], "", False), ("h1", "class", "margin-bottom-xs", True)),
    ("company", 1, (["project-header"], "", True), ("a", "onclick", "window.open", False)),
    ("person", 1, (["list-item-main"], "", False), ("span", "class", "h5", True)),
    ("person", 2, (["media-body"], "", False), ("div", "class", "col-md-6", True)),
    ("email", 1, (["col-sm-6", "margin-bottom-sm"], "E-Mail", False), ("a", "href", "mailto:", False)),
    ("email", 2, (["col-md-6"], "@", False), ("a", "href", "mailto:", False)),
    ("project_description", 1, (["panel-body", "highlight-text"], "", False), None),
]
POSTING_FIELDS = ["project_name", "project_description", "company", "person", "email"]


def posting_links(listing: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """E8 + T3 + P10: the marked link inside every project card, in page order, absolute."""
    hrefs = _card_links(F.col(html_col))
    return (listing.select(id_col, url_col, F.posexplode_outer(hrefs).alias("pos", "href"))
            .where(non_empty_link("href"))
            .select(id_col, (F.col("pos") + 1).alias("pos"),
                    resolve_url(F.col(url_col), F.col("href")).alias("link")))


def posting_fields(pages: DataFrame, spec=POSTING_FIELD_SPEC, url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """E9 + W4: ``(url, project_name, project_description, company, person,
    email)`` from detail pages; per field the first non-empty variant. Of a
    person's second variant only the first line counts."""
    names = [f"__{field}_{variant}" for field, variant, _, _ in spec]
    staged = pages.select(F.col(url_col).alias("url"), posting_texts(list(spec))(F.col(html_col)).alias("__texts"))
    found = staged.select("url", *(F.col("__texts")[k].alias(n) for k, n in enumerate(names)))
    cols = [F.col("url")]
    for field in POSTING_FIELDS:
        texts = []
        for variant in sorted(v for f, v, _, _ in spec if f == field):
            text = F.col(f"__{field}_{variant}")
            if (field, variant) == ("person", 2):
                text = F.split_part(F.regexp_replace(text, r"^\s+", ""), F.lit("\n"), F.lit(1))
            texts.append(F.nullif(strip_ws(text), F.lit("")))
        cols.append((F.coalesce(*texts) if texts else F.lit(None).cast("string")).alias(field))
    return found.select(*cols)
