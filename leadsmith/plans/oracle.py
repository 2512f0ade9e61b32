"""DuckDB oracle SQL for the registered queries (same column names).

In DuckDB's dialect (RE2 regexes, ``lambda x: ...`` lambdas). Queries over generated
pages and contacts expect what the generator was given, from the source columns;
the lists marked as fixed values are shared. Views for the driver tables are pre-registered.
"""

from __future__ import annotations

from leadsmith.sources.lookups import CONTACT_BLOCKLIST, CONTACT_PATHS, DEOBFUSCATION_RULES, DOMAIN_BAD_LIST, LOCAL_PARTS

EMAIL_RE = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"

DOC_EMAILS = f"""
SELECT doc_id, pos, lower(m) AS email, string_split(lower(m), '@')[-1] AS domain
FROM (
  SELECT doc_id, UNNEST(range(1, len(ms) + 1)) AS pos, UNNEST(ms) AS m
  FROM (SELECT doc_id, regexp_extract_all(text, '{EMAIL_RE}') AS ms FROM documents)
)
"""

KEEP_FIRST = f"""
SELECT doc_id, pos, email, domain FROM ({DOC_EMAILS})
QUALIFY row_number() OVER (PARTITION BY email ORDER BY doc_id, pos) = 1
"""

SQL = {
    "email_scan": DOC_EMAILS,
    "email_keep_first": KEEP_FIRST,
    "email_blocklist": f"""
SELECT * FROM ({KEEP_FIRST})
WHERE NOT (email IN ('that.92@mail2.example.com')
           OR ends_with(domain, 'mail3.example.com')
           OR ends_with(domain, 'ail8.example.com'))
""",
    "email_blocklist_boundary": f"""
SELECT * FROM ({KEEP_FIRST})
WHERE NOT (email IN ('that.92@mail2.example.com')
           OR domain = 'mail3.example.com' OR ends_with(domain, '.mail3.example.com')
           OR domain = 'ail8.example.com' OR ends_with(domain, '.ail8.example.com'))
""",
}


# ============================================================================ snippets
def q(s: str) -> str:
    """A DuckDB string literal (no backslash processing; quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm_sql(x: str) -> str:
    return f"lower({strip_sql(x)})"


def domain_first_sql(e: str) -> str:
    return f"CASE WHEN strpos({e}, '@') > 0 THEN {norm_sql(f'substr({e}, strpos({e}, {q(chr(64))}) + 1)')} END"


def normalize_domain_sql(u: str) -> str:
    return f"split_part(regexp_replace({norm_sql(u)}, '^(https?://)?(www\\.)?', ''), '/', 1)"


def host_sql(u: str) -> str:
    return (f"nullif(lower(regexp_extract({u}, "
            f"'^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//(?:[^@/?#]*@)?([^:/?#]*)', 1)), '')")


def same_host_sql(u: str, d: str) -> str:
    h = host_sql(u)
    return f"coalesce(({h} = {d}) OR ends_with({h}, '.' || {d}), false)"


def dot_segments_sql(p: str) -> str:
    """Remove '.' and '..' segments from an absolute path (string fold)."""
    fold = (f"list_reduce(list_prepend('', string_split({p}, '/')[2:]), lambda acc, x: "
            f"CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc "
            f"ELSE acc || '/' || x END)")
    return f"(CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN {fold} || '/' ELSE {fold} END)"


def resolve_sql(b: str, h: str) -> str:
    origin = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    no_frag = f"regexp_replace({b}, '#.*$', '')"
    no_query = f"regexp_replace({no_frag}, '\\?.*$', '')"
    path = f"regexp_extract({no_query}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/.*)?$', 1)"
    directory = f"regexp_replace({path}, '[^/]*$', '')"
    h_path = f"regexp_extract({h}, '^([^?#]*)', 1)"
    h_rest = f"substr({h}, length({h_path}) + 1)"
    merged = f"regexp_replace((CASE WHEN {directory} = '' THEN '/' ELSE {directory} END) || {h_path}, '/{{2,}}', '/', 'g')"
    return f"""CASE WHEN {h} IS NULL THEN NULL
 WHEN {h} = '' THEN {b}
 WHEN regexp_matches({h}, '^([A-Za-z][A-Za-z0-9+.\\-]*):') THEN {h}
 WHEN starts_with({h}, '//') THEN regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) || ':' || {h}
 WHEN starts_with({h}, '/') THEN {origin} || {dot_segments_sql(h_path)} || {h_rest}
 WHEN starts_with({h}, '?') THEN {no_query} || {h}
 WHEN starts_with({h}, '#') THEN {no_frag} || {h}
 ELSE {origin} || {dot_segments_sql(merged)} || {h_rest} END"""


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"),
            ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"),
            ("&#64;", "@"), ("&#x40;", "@"), ("&amp;", "&")]
RULES = DEOBFUSCATION_RULES


def unescape_sql(x: str) -> str:
    for ent, ch in ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def clean_sql(x: str) -> str:
    x = unescape_sql(x)
    x = f"regexp_replace({x}, '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    for pat, rep in RULES:
        x = f"regexp_replace({x}, {q('(?i)' + pat)}, {q(rep)}, 'g')"
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def strip_markup_sql(x: str) -> str:
    for pat in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->"):
        x = f"regexp_replace({x}, {q(pat)}, ' ', 'g')"
    return f"regexp_replace({x}, '(?s)<[^<>]+>', ' ', 'g')"


def visible_sql(x: str) -> str:
    return strip_sql(clean_sql(strip_markup_sql(x)))


def emails_sql(x: str) -> str:
    """Lower-cased generic matches as a list."""
    return f"list_transform(regexp_extract_all({x}, {q(EMAIL_RE)}), lambda m: lower(m))"


ANCHOR_HREF_RE = r"""(?is)<a\b[^<>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""


# The driver's pages hold no mailto link, protected address, script data or iframe:
# what is found there is in the visible text or in the raw page.
PAGE_SUMMARY = f"""
WITH p AS (SELECT page_id, {normalize_domain_sql('url')} AS domain, html, {visible_sql('html')} AS vt FROM pages),
a AS (SELECT *, list_distinct(list_concat({emails_sql('vt')}, {emails_sql('html')})) AS all_e FROM p),
k AS (SELECT *, list_filter(all_e, lambda e: ends_with(e, '@' || domain)) AS same FROM a)
SELECT page_id, array_to_string(list_sort(CASE WHEN len(same) > 0 THEN same ELSE all_e END), ',') AS emails_extracted,
       '' AS iframe_candidates, length(vt) AS text_len FROM k
"""


# ============================================================================ batch 2
PAGE_LINKS = f"""
WITH h AS (SELECT page_id, url, list_transform(regexp_extract_all(html, {q(ANCHOR_HREF_RE)}, 1),
  lambda v: {unescape_sql("trim(v, chr(34) || chr(39))")}) AS hs FROM pages),
x AS (SELECT page_id, url, UNNEST(range(1, len(hs) + 1)) AS pos, UNNEST(hs) AS href FROM h)
SELECT page_id, pos, {resolve_sql('url', 'href')} AS link
FROM x WHERE href IS NOT NULL AND href <> ''
"""

SQL.update({
    "page_links": PAGE_LINKS,
    "page_link_first_seen": f"""
SELECT page_id, pos, link FROM ({PAGE_LINKS})
QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, pos) = 1
""",
    "slug_title": "SELECT page_id, replace(string_split(url, '/')[-1], '-', ' ') AS title FROM pages",
    "same_host": f"""
SELECT page_id, {host_sql('url')} AS host, {normalize_domain_sql('url')} AS domain,
       {same_host_sql('url', normalize_domain_sql('url'))} AS same_as_domain,
       {same_host_sql('url', q('example.com'))} AS under_example_com
FROM pages
""",
    "title_exclude": f"""
SELECT p_partkey, p_name FROM part
WHERE NOT coalesce(contains({norm_sql('p_name')}, 'widget') OR contains({norm_sql('p_name')}, 'ring'), false)
""",
    "anti_master": """
SELECT doc_id, lang, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id)
""",
    "anti_domain_master": f"""
WITH f AS (SELECT doc_id, pos, email, {domain_first_sql('email')} AS domain FROM ({DOC_EMAILS})),
firsts AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY domain ORDER BY doc_id, pos) = 1),
m AS (SELECT DISTINCT {domain_first_sql('e')} AS domain
      FROM (SELECT lower(UNNEST(regexp_extract_all(html, {q(EMAIL_RE)}))) AS e FROM pages))
SELECT doc_id, pos, email, domain FROM firsts
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.domain IS NOT DISTINCT FROM firsts.domain)
""",
    "recency_0": "SELECT event_id, user_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-30'",
    "recency_1": "SELECT event_id, user_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-29'",
    "recency_7": """SELECT event_id, user_id, event_type FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'""",
    "drop_any_null": f"""
SELECT * FROM (
  SELECT d.doc_id,
         CASE WHEN {strip_sql('d.lang')} = '' THEN NULL ELSE d.lang END AS lang,
         CASE WHEN {strip_sql('d.source')} = '' THEN NULL ELSE d.source END AS source,
         d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
) WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL
    AND quality IS NOT NULL AND toxic IS NOT NULL
""",
    "conversation_clean": f"SELECT conv_id, turn, role, {clean_sql('text')} AS text_clean FROM conversations",
    "visible_text": f"""
SELECT page_id, length(t) AS text_len, t AS text FROM (SELECT page_id, {visible_sql('html')} AS t FROM pages)
""",
})


# ============================================================================ batch 3: sites
SITES = """
SELECT s_suppkey AS k, s_name, s_acctbal, n_regionkey AS r,
       's' || CAST(s_suppkey AS VARCHAR) || '.' || regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') || '.example' AS d
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

# What the sites were given, not what a pattern finds: (page_id, source, email).
PERSON_MAIL = "'p' || CAST(k AS VARCHAR) || '.contact@' || d"
GIVEN = f"""
(WITH s AS ({SITES})
 SELECT k * 10 + 1 AS page_id, 'text' AS source, {PERSON_MAIL} AS email FROM s
 UNION ALL SELECT k * 10 + 1, 'label', {PERSON_MAIL} FROM s
 UNION ALL SELECT k * 10 + 1, 'mailto', 'info@' || d FROM s WHERE r = 0
 UNION ALL SELECT k * 10 + 1, 'mailto', 'sales@' || d FROM s WHERE r = 0 AND k % 2 = 0
 UNION ALL SELECT k * 10 + 1, 'cf', 'kontakt@' || d FROM s WHERE r = 1
 UNION ALL SELECT k * 10 + 1, 'jsonld', 'jobs@' || d FROM s WHERE r = 1
 UNION ALL SELECT k * 10 + 1, 'jsonld', 'hr@' || d FROM s WHERE r = 1
 UNION ALL SELECT k * 10 + 1, 'raw', 'key@' || d FROM s WHERE r = 1
 UNION ALL SELECT k * 10 + 1, 'mailto', 'o''brien@' || d FROM s WHERE r = 4
 UNION ALL SELECT k * 10 + 1, 'raw', 'brien@' || d FROM s WHERE r = 4
 UNION ALL SELECT k * 10 + 2, 'label', 'office@' || d FROM s WHERE r = 2
 UNION ALL SELECT k * 10 + 3, 'mailto', 'team@' || d FROM s WHERE r = 3)
"""
HOME_ORIGIN = "CASE WHEN k % 3 = 0 THEN 'https://' || upper(d) || ':443' ELSE 'https://' || d END"
FRAMES = ["/frame/a", "/frame/b", "/frame/c", "/frame/kontakt"]
SITE_TEXTS = f"""
(WITH s AS ({SITES})
 SELECT k * 10 + 1 AS page_id, concat_ws(' ', s_name, s_name, CASE WHEN r = 0 THEN 'Mail' END,
        CASE WHEN r = 0 AND k % 2 = 0 THEN 'Sales' END, CASE WHEN r = 1 THEN '[email protected]' END,
        CASE WHEN r = 4 THEN 'B' END, 'Ansprechpartner: ' || {PERSON_MAIL}) AS vt,
        CASE WHEN r = 2 THEN array_to_string([({HOME_ORIGIN}) || f FOR f IN {FRAMES}], ',') ELSE '' END AS frames FROM s
 UNION ALL SELECT k * 10 + 2, CASE WHEN r = 2 THEN 'Kontakt: ' || repeat('lorem ', 50) || 'office@' || d ELSE 'Kontakt:' END, '' FROM s
 UNION ALL SELECT k * 10 + 3, concat_ws(' ', 'Impressum', CASE WHEN r = 3 THEN 'Team' END, s_name), '' FROM s)
"""
BEST = "CASE r WHEN 0 THEN 'info@' || d WHEN 1 THEN 'kontakt@' || d WHEN 2 THEN 'office@' || d WHEN 3 THEN 'team@' || d END"

PATHS = CONTACT_PATHS
LP_VALUES = "(VALUES " + ", ".join(f"({i + 1}, {q(p)})" for i, p in enumerate(LOCAL_PARTS)) + ") AS lp(rank, local_part)"
GRID_VALUES = "(VALUES " + ", ".join(
    f"({t}, {(b - 1) * 27 + i + 1}, {q(tpl + p)})"
    for t, b, tpl in [(1, 1, "https://{d}/"), (1, 2, "https://www.{d}/"), (2, 1, "http://{d}/"), (2, 2, "http://www.{d}/")]
    for i, p in enumerate(PATHS)) + ") AS g(tier, url_rank, tpl)"


SQL.update({
    **{f"site_{n}": f"SELECT DISTINCT page_id, email FROM {GIVEN} WHERE source = '{src}'"
       for n, src in (("mailto", "mailto"), ("cf_decode", "cf"), ("jsonld", "jsonld"), ("labels", "label"))},
    "site_iframes": f"""
SELECT k * 10 + 1 AS page_id, CAST(i AS BIGINT) AS pos, ({HOME_ORIGIN}) || {FRAMES}[i] AS frame_url
FROM ({SITES}), range(1, 5) AS t(i) WHERE r = 2
""",
    "site_iframes_top": f"""
SELECT k * 10 + 1 AS page_id, ({HOME_ORIGIN}) || {FRAMES}[i] AS frame_url FROM ({SITES}), range(1, 4) AS t(i) WHERE r = 2
""",
    "site_findings": f"""
SELECT t.page_id, coalesce(g.emails, '') AS emails_extracted, t.frames AS iframe_candidates, length(t.vt) AS text_len
FROM {SITE_TEXTS} t LEFT JOIN (SELECT page_id, string_agg(DISTINCT email, ',' ORDER BY email) AS emails
                              FROM {GIVEN} GROUP BY page_id) g ON t.page_id = g.page_id
""",
    "frontier": f"""
SELECT domain, tier, url_rank, replace(tpl, '{{d}}', domain) AS url
FROM (SELECT DISTINCT {normalize_domain_sql('url')} AS domain FROM pages) p, {GRID_VALUES}
WHERE domain <> ''
""",
    "candidates": f"""
SELECT d AS domain, CAST(rank AS BIGINT) AS rank, lower(local_part || '@' || d) AS email
FROM ({SITES}) s, {LP_VALUES}
""",
    "candidates_best": f"SELECT d AS domain, {BEST} AS email_common FROM ({SITES})",
    "common_mailbox": f"SELECT d AS domain, {BEST} AS email_common FROM ({SITES}) WHERE NOT coalesce(s_acctbal < 0, false)",
})


# ============================================================================ batch 4
FIRST_NAMES = ["Anna", "Max", "Lena", "Jan", "Maria", "Paul", "Sophie", "Lukas", "Andrea", "Kim"]
LAST_NAMES = ["Mueller", "Schmidt", "Heide", "Berg", "Wagner", "Becker", "Hoffmann", "Koch", "Richter", "Wolf"]
NAME_GENDER = [("Anna", "female"), ("Max", "male"), ("Lena", "female"), ("Jan", "male"),
               ("Maria", "female"), ("Paul", "male"), ("Sophie", "mostly_female"),
               ("Lukas", "male"), ("Andrea", "andy")]


def _list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


CC = f"""
(SELECT c_custkey AS ingest_seq, f, l, c_mktsegment AS company,
  CASE WHEN c_acctbal < 0 THEN NULL
       WHEN c_custkey % 7 = 0 THEN f || ' ' || l || CASE WHEN c_custkey % 3 = 1 THEN ' MBA' ELSE '' END
       WHEN c_custkey % 7 = 1 THEN l || ', ' || f
       WHEN c_custkey % 7 = 2 THEN 'Dr. ' || f || ' von der ' || l
       WHEN c_custkey % 7 = 3 THEN f || ' Maria ' || l || CASE WHEN c_custkey % 2 = 1 THEN ', PhD' ELSE '' END
       WHEN c_custkey % 7 = 4 THEN f
       WHEN c_custkey % 7 = 5 THEN 'Prof. Dr. ' || f || ' van den ' || l
       ELSE '  ' END AS person,
  lower(f) || '.' || lower(l) || '.' || CAST(c_custkey AS VARCHAR) || '@' || lower(c_mktsegment) || '.example' AS email
 FROM (SELECT *, {_list(FIRST_NAMES)}[c_custkey % 10 + 1] AS f,
              {_list(LAST_NAMES)}[(c_custkey // 10) % 10 + 1] AS l FROM customer))
"""

# First and last name that each shape was built from.
NAMED = f"""
(SELECT ingest_seq, company, person, email,
        CASE WHEN person IS NOT NULL AND ingest_seq % 7 <> 6 THEN f END AS first_name,
        CASE WHEN person IS NULL OR ingest_seq % 7 IN (4, 6) THEN NULL WHEN ingest_seq % 7 = 2 THEN 'von der ' || l
             WHEN ingest_seq % 7 = 5 THEN 'van den ' || l ELSE l END AS last_name
 FROM {CC})
"""
NAME_SPLIT = f"SELECT ingest_seq AS c_custkey, person, first_name, last_name FROM {NAMED}"

GENDER_DICT = ("(SELECT lower(trim(fn)) AS fn, min(g) AS gender FROM (VALUES "
               + ", ".join(f"({q(a)}, {q(b)})" for a, b in NAME_GENDER) + ") AS t(fn, g) GROUP BY 1)")

ENRICHED = f"""
(SELECT c.ingest_seq, c.company, c.person, c.email, coalesce(g.gender, 'unknown') AS gender,
        c.first_name, c.last_name
 FROM {NAMED} c LEFT JOIN {GENDER_DICT} g ON lower(c.first_name) = g.fn)
"""

SAL = """CASE WHEN last_name IS NULL THEN 'Sehr geehrte Damen und Herren '
     WHEN gender = 'male' THEN 'Lieber Herr ' WHEN gender = 'female' THEN 'Liebe Frau '
     ELSE 'Sehr geehrte Damen und Herren ' END"""
ADDR = "CASE WHEN gender IN ('male', 'female') AND last_name IS NOT NULL THEN last_name ELSE '' END"


def _template_sql() -> str:
    import re
    from leadsmith.operators.outbox import DEFAULT_TEMPLATE
    parts, pos = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*(?:\|\s*default\(\s*\"([^\"]*)\"\s*\))?\s*\}\}", DEFAULT_TEMPLATE):
        parts.append(q(DEFAULT_TEMPLATE[pos:m.start()]))
        name, default = m.group(1), m.group(2)
        parts.append({"ansprache": SAL, "name": ADDR}.get(name) or q(default))
        pos = m.end()
    parts.append(q(DEFAULT_TEMPLATE[pos:]))
    return " || ".join(f"({p})" for p in parts)


CONTACT_NEW = f"""(SELECT ingest_seq, company, person, email FROM {CC} UNION ALL
  SELECT ingest_seq + 1000000000, company, person, email FROM {CC} WHERE company = 'BUILDING')"""
CONTACT_MASTER = f"(SELECT email FROM {CC} WHERE company = 'AUTOMOBILE')"
BLOCKED = (f"coalesce({norm_sql('email')} IN ('anna.mueller.0@furniture.example') "
           f"OR ends_with(string_split({norm_sql('email')}, '@')[-1], 'hinery.example'), false)")

PART_POSTINGS = """
(SELECT p_partkey AS ingest_seq,
        'https://projects.example/projekte/projekt-' || CAST(p_partkey AS VARCHAR) || '-' || replace(p_name, ' ', '-') AS url,
        p_name AS project_name, p_type AS project_description, p_brand AS company,
        CASE WHEN p_size <= 45 THEN 'Agent ' || brand END AS person, 'jobs@' || brand || '.example' AS email
 FROM (SELECT *, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand FROM part))
"""
POSTING_COMPLETE = ("(ingest_seq IS NOT NULL AND url IS NOT NULL AND project_name IS NOT NULL AND "
                    "project_description IS NOT NULL AND company IS NOT NULL AND person IS NOT NULL AND email IS NOT NULL)")
POSTING_EXCLUDED = (f"coalesce(contains({norm_sql('project_name')}, 'ring') OR "
                    f"contains({norm_sql('project_name')}, 'bolt'), false)")

URL_BASE = """(SELECT url, CAST(DATE '2024-01-01' + CAST(page_id AS INTEGER) AS VARCHAR) AS date,
  NULL::BOOLEAN AS url_checked FROM pages)"""
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
URL_CHANGES = """(SELECT e.event_id AS seq,
   CASE WHEN e.event_type = 'signup' THEN 'signup://' || CAST(e.user_id AS VARCHAR)
        ELSE coalesce(p.url, 'user://' || CAST(e.user_id AS VARCHAR)) END AS url,
   e.event_type AS col,
   CASE WHEN e.value < 5 THEN NULL ELSE CAST(CAST(round(e.value * 100) AS BIGINT) AS VARCHAR) END AS value
 FROM events e LEFT JOIN pages p ON e.user_id = p.page_id)"""

PROFILES = {
    "p1": {"mini": ["the", "and", "of", "to", "in", "for", "with", "that", "this", "by",
                    "les", "des", "une", "und", "der", "die", "que", "los", "las", "del"],
           "top": ["tion", "ment", "ing"], "heading": ["the", "le"], "exclude": ["sap"]},
    "p2": {"mini": ["ou", "ai", "ch", "qu"], "top": ["eau", "ier"], "heading": ["de"], "exclude": ["wordpress"]},
}


def _hits_sql(col: str, terms) -> str:
    return f"len(list_filter({_list(terms)}, lambda t: contains({col}, t)))"


def _score_sql() -> str:
    w = repr(1 / 3)
    parts = []
    for prof, g in sorted(PROFILES.items()):
        score = (f"0.0 + {w} * {_hits_sql('body', g['mini'])} / {len(g['mini'])}"
                 f" + {w} * {_hits_sql('body', g['top'])} / {len(g['top'])}"
                 f" + {w} * (CASE WHEN {_hits_sql('heading', g['heading'])} > 0 THEN 1.0 ELSE 0.0 END)")
        parts.append(f"""SELECT doc_id, {q(prof)} AS profile, round(s, 6) AS score, s * 100 >= 75.0 AS passes
FROM (SELECT doc_id, {score} AS s, {_hits_sql('body', g['exclude'])} > 0 AS excluded
      FROM (SELECT doc_id, lower(text) AS body, lower(split_part(text, chr(10), 1)) AS heading FROM documents))
WHERE NOT excluded""")
    return "\nUNION ALL\n".join(parts)


SQL.update({
    "name_split": NAME_SPLIT,
    "gender_lookup": f"""
SELECT n.c_custkey, n.first_name, coalesce(g.gender, 'unknown') AS gender
FROM ({NAME_SPLIT}) n LEFT JOIN {GENDER_DICT} g ON lower(n.first_name) = g.fn
""",
    "enrich_contacts": f"SELECT * FROM {ENRICHED}",
    "salutation": f"SELECT ingest_seq AS c_custkey, gender, {SAL} AS ansprache, {ADDR} AS name FROM {ENRICHED}",
    "outbox": f"SELECT email, 'Anfrage zu Beauftragungen' AS subject, {_template_sql()} AS content FROM {ENRICHED}",
    "clean_contacts": f"""
WITH f AS (SELECT * FROM {CONTACT_NEW} n
           WHERE NOT EXISTS (SELECT 1 FROM {CONTACT_MASTER} m WHERE m.email IS NOT DISTINCT FROM n.email)),
g AS (SELECT * FROM f WHERE NOT {BLOCKED})
SELECT company, person, email FROM g QUALIFY row_number() OVER (PARTITION BY email ORDER BY ingest_seq) = 1
""",
    "contact_funnel": f"""
WITH pk AS (SELECT email, count(*) AS n FROM {CONTACT_NEW} GROUP BY email),
fl AS (SELECT n, EXISTS (SELECT 1 FROM {CONTACT_MASTER} m WHERE m.email IS NOT DISTINCT FROM pk.email) AS known,
              {BLOCKED} AS blocked FROM pk)
SELECT CAST(sum(n) AS BIGINT) AS input, CAST(sum(n - 1) AS BIGINT) AS duplicates,
       count(*) FILTER (WHERE known) AS already_known,
       count(*) FILTER (WHERE NOT known AND blocked) AS excluded,
       CAST(sum(n) - count(*) FILTER (WHERE NOT known AND NOT blocked) AS BIGINT) AS removed,
       count(*) FILTER (WHERE NOT known AND NOT blocked) AS "left"
FROM fl
""",
    "clean_postings": f"SELECT * FROM {PART_POSTINGS} WHERE {POSTING_COMPLETE} AND NOT {POSTING_EXCLUDED}",
    "posting_funnel": f"""
SELECT count(*) AS input, count(*) FILTER (WHERE NOT {POSTING_COMPLETE}) AS incomplete,
       count(*) FILTER (WHERE {POSTING_COMPLETE} AND {POSTING_EXCLUDED}) AS excluded,
       count(*) FILTER (WHERE {POSTING_COMPLETE} AND NOT {POSTING_EXCLUDED}) AS "left"
FROM {PART_POSTINGS}
""",
    "append_master": f"""
SELECT * FROM {ENRICHED} WHERE company = 'AUTOMOBILE'
UNION ALL
SELECT * FROM {ENRICHED} e WHERE NOT EXISTS (
  SELECT 1 FROM {ENRICHED} m WHERE m.company = 'AUTOMOBILE' AND m.email IS NOT DISTINCT FROM e.email)
""",
    "accumulate_merge": """
SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, n_name FROM (
  SELECT c_custkey, c_name, c_mktsegment, NULL::VARCHAR AS n_name FROM customer
  UNION ALL SELECT c_custkey, c_name, c_mktsegment, NULL FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT c_custkey, c_name, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
            WHERE c_acctbal > 9000)
""",
    "append_union": """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment, NULL::DOUBLE AS acctbal
FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, s_acctbal FROM supplier
""",
    "upsert": f"""
WITH last AS (SELECT * FROM {URL_CHANGES} WHERE url IS NOT NULL AND col IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY url, col ORDER BY seq DESC) = 1),
pv AS (SELECT url, {", ".join(f"bool_or(col = {q(t)}) AS has_{t}, max(CASE WHEN col = {q(t)} THEN value END) AS v_{t}" for t in EVENT_TYPES)}
       FROM last GROUP BY url)
SELECT coalesce(b.url, pv.url) AS url, b.date, b.url_checked,
       {", ".join(f"CASE WHEN has_{t} THEN v_{t} END AS {t}" for t in EVENT_TYPES)}
FROM {URL_BASE} b FULL OUTER JOIN pv ON b.url = pv.url
""",
    "delete_key": f"""
SELECT * FROM {URL_BASE} b WHERE NOT EXISTS (
  SELECT 1 FROM pages p JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') e
    ON p.page_id = e.user_id WHERE p.url = b.url)
""",
    "keyword_score": _score_sql(),
})


# ============================================================================ batch 6: streaming
SQL.update({
    "stream_ingest": f"""
SELECT doc_id, pos, email, domain FROM ({KEEP_FIRST})
WHERE NOT (email IN ('that.92@mail2.example.com')
           OR ends_with(domain, 'mail3.example.com')
           OR ends_with(domain, 'ail8.example.com'))
""",
    "stream_keep_first": "SELECT DISTINCT user_id FROM events",
    "stream_keep_first_batches": "SELECT DISTINCT user_id FROM events",
    "stream_ingest_batches": f"""
SELECT DISTINCT email, domain FROM ({DOC_EMAILS})
WHERE NOT (email IN ('that.92@mail2.example.com')
           OR ends_with(domain, 'mail3.example.com')
           OR ends_with(domain, 'ail8.example.com'))
""",
})


# ============================================================================ batch 7: postings, url state
PART_AGENCY = """
(WITH li AS (SELECT l_partkey, l_suppkey FROM lineitem
             QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1)
 SELECT p.p_partkey, p.p_name, p.p_brand, p.p_type, p.p_size, s.s_suppkey, s.s_name
 FROM part p LEFT JOIN li ON p.p_partkey = li.l_partkey LEFT JOIN supplier s ON li.l_suppkey = s.s_suppkey)
"""

_FN = f"{_list(FIRST_NAMES)}[s_suppkey % 10 + 1]"
_LN = f"{_list(LAST_NAMES)}[(s_suppkey // 10) % 10 + 1]"
AGENT = f"{_FN} || ' ' || {_LN}"
AGENT_MAIL = f"lower({_FN}) || '@s' || CAST(s_suppkey AS VARCHAR) || '.example'"
PART_URL = ("'https://projects.example/projekte/projekt-' || CAST(p_partkey AS VARCHAR) || '-' || replace(p_name, ' ', '-')")
LISTING_NO = "CAST(floor(p_partkey / 100) + 1 AS BIGINT)"
# What each page was built from.
POSTINGS = f"""
(SELECT {PART_URL} AS url, trim(p_name) AS project_name, p_type || ' ' || p_brand AS project_description,
        s_name AS company, CASE WHEN s_suppkey IS NOT NULL THEN {AGENT} END AS person,
        CASE WHEN s_suppkey IS NOT NULL THEN {AGENT_MAIL} END AS email, p_size, {LISTING_NO} AS listing FROM {PART_AGENCY})
"""
FIELDS = "url, project_name, project_description, company, person, email"
# Complete records of earlier runs, or listed from 2024-01-23 to 2024-01-30.
COLLECTED = f"(SELECT * FROM {POSTINGS} WHERE company IS NOT NULL AND (p_size <= 25 OR listing % 10 <= 7))"

SQL.update({
    "posting_links": f"""
SELECT {LISTING_NO} AS page_id, row_number() OVER (PARTITION BY {LISTING_NO} ORDER BY p_partkey) AS pos, {PART_URL} AS link
FROM part
""",
    "posting_fields": f"SELECT {FIELDS} FROM {POSTINGS}",
    "collect_postings": f"SELECT DISTINCT {FIELDS} FROM {COLLECTED}",
    "collect_agencies": f"SELECT DISTINCT company, person, email FROM {COLLECTED}",
    "url_state": f"""
WITH second AS (
  SELECT * FROM ({SQL['upsert']}) u WHERE NOT EXISTS (
    SELECT 1 FROM pages p JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') e
      ON p.page_id = e.user_id WHERE p.url = u.url)),
f AS (SELECT url, arg_max(CAST(page_id AS VARCHAR), page_id) AS flag01 FROM pages WHERE page_id % 3 = 0 GROUP BY url),
c AS (SELECT url, true AS checked FROM pages WHERE page_id % 10 = 0 GROUP BY url),
k AS (SELECT url FROM f UNION SELECT url FROM c),
ch AS (SELECT k.url, f.flag01, c.checked FROM k LEFT JOIN f ON k.url = f.url LEFT JOIN c ON k.url = c.url)
SELECT coalesce(s.url, ch.url) AS url, s.date, coalesce(ch.checked, s.url_checked) AS url_checked,
       {", ".join(f"s.{t}" for t in EVENT_TYPES)}, ch.flag01
FROM second s FULL OUTER JOIN ch ON s.url = ch.url
""",
})


CONTACT_BLOCK_DEFAULT = CONTACT_BLOCKLIST
_DR_BLOCKED = "coalesce(" + " OR ".join(
    f"ends_with(string_split({norm_sql('email')}, '@')[-1], {q(t)})" for t in CONTACT_BLOCK_DEFAULT) + ", false)"
MASTER = f"""
(SELECT s_name AS company, {AGENT} AS person, {AGENT_MAIL} AS email, 'unknown' AS gender, {_FN} AS first_name, {_LN} AS last_name
 FROM supplier WHERE s_suppkey % 4 = 0)
"""
DAY_CONTACTS = f"""
(WITH c AS (SELECT url, company, person, email FROM {COLLECTED} WHERE NOT {_DR_BLOCKED}
              AND email NOT IN (SELECT email FROM {MASTER})
            QUALIFY row_number() OVER (PARTITION BY email ORDER BY url) = 1)
 SELECT company, person, email, coalesce(g.gender, 'unknown') AS gender, split_part(person, ' ', 1) AS first_name,
        split_part(person, ' ', 2) AS last_name
 FROM c LEFT JOIN {GENDER_DICT} g ON lower(split_part(person, ' ', 1)) = g.fn)
"""
SQL.update({
    "daily_run": f"SELECT * FROM {MASTER} UNION ALL SELECT * FROM {DAY_CONTACTS}",
    "daily_run_agencies": f"SELECT DISTINCT company, person, email FROM {COLLECTED}",
    "daily_run_postings": f"SELECT DISTINCT {FIELDS} FROM {COLLECTED} WHERE NOT {POSTING_EXCLUDED}",
    "daily_run_outbox": f"SELECT email, 'Anfrage zu Beauftragungen' AS subject, {_template_sql()} AS content FROM {DAY_CONTACTS}",
})


# ============================================================================ batch 8: A3 on documents, host blocklist
HOSTS = f"(SELECT page_id, {host_sql('url')} AS host FROM pages)"
SQL.update({
    "email_strict_domain": f"""
SELECT doc_id, pos, email, domain FROM (
  SELECT *, bool_or(ends_with(email, '@mail2.example.com')) OVER (PARTITION BY doc_id) AS any_pref
  FROM ({DOC_EMAILS}))
WHERE ends_with(email, '@mail2.example.com') OR NOT any_pref
""",
    "host_blocklist": f"""
SELECT page_id, host FROM {HOSTS}
WHERE NOT coalesce(ends_with(string_split({norm_sql('host')}, '@')[-1], 'spam-farm.example.org')
  OR ends_with(string_split({norm_sql('host')}, '@')[-1], 'cheap-pills.example.com')
  OR ends_with(string_split({norm_sql('host')}, '@')[-1], 'ther.example.org')
  OR ends_with(string_split({norm_sql('host')}, '@')[-1], 'hre.example.com'), false)
""",
    "host_blocklist_boundary": f"""
SELECT page_id, host FROM (SELECT page_id, host, string_split({norm_sql('host')}, '@')[-1] AS d FROM {HOSTS})
WHERE NOT coalesce(d = 'spam-farm.example.org' OR ends_with(d, '.spam-farm.example.org')
  OR d = 'cheap-pills.example.com' OR ends_with(d, '.cheap-pills.example.com')
  OR d = 'ther.example.org' OR ends_with(d, '.ther.example.org')
  OR d = 'hre.example.com' OR ends_with(d, '.hre.example.com'), false)
""",
})


SQL["page_findings"] = PAGE_SUMMARY

_BLOCKED_CONTACTS = f"SELECT upper(email) AS term FROM {CC} WHERE ingest_seq % 4 <> 0"
SQL.update({
    "exclude_term_table": """
WITH t AS (SELECT DISTINCT UNNEST(regexp_extract_all(lower(text), '[a-z]{11,}')) AS term FROM documents)
SELECT conv_id, turn FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(lower(c.text), t.term))
""",
    "email_block_table": f"""
SELECT ingest_seq, email FROM {CC}
WHERE ingest_seq % 4 = 0 AND NOT ends_with(email, 'household.example')
""",
    "load_csv": f"""
SELECT ingest_seq, CASE WHEN ingest_seq % 5 = 0 THEN NULL ELSE company END AS company,
       CASE WHEN trim(person) = '' THEN NULL ELSE person END AS person, email FROM {CC}
""",
    "load_or_create": f"SELECT ingest_seq, company, person, email FROM {CC} WHERE ingest_seq % 2 = 0",
    "append_rows": f"""
SELECT ingest_seq, company, person, email FROM {CC}
UNION ALL SELECT ingest_seq, company, person, email FROM {CC} WHERE ingest_seq % 3 = 0
""",
    "admitted_pages": """
SELECT page_id, length(html) AS n FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 11 <> 0
""",
})


# ============================================================================ audits in the pass that writes
_DAY_KEYS = f"""
(SELECT email, count(*) AS n, email IN (SELECT email FROM {MASTER}) AS known, {_DR_BLOCKED} AS blocked
 FROM (SELECT DISTINCT {FIELDS} FROM {COLLECTED}) GROUP BY email)
"""
_DAY_RECORDS = f"(SELECT * FROM {POSTINGS} WHERE listing % 10 <= 7)"
_MAIL_DOMAINS = f"""
(SELECT domain, count(*) AS n, coalesce({" OR ".join(f"contains(domain, {q(t)})" for t in DOMAIN_BAD_LIST)}, false) AS listed,
        coalesce(domain IN (SELECT d FROM ({SITES}) WHERE s_acctbal < 0), false) AS known, coalesce(contains(domain, '.'), false) AS valid
 FROM (SELECT d AS domain FROM ({SITES}) UNION ALL SELECT d FROM ({SITES}) WHERE r = 0
       UNION ALL SELECT 'jobs.aplitrak.com' FROM ({SITES}) WHERE s_acctbal > 9000
       UNION ALL SELECT CASE c_custkey % 3 WHEN 0 THEN 'intranet' || (c_custkey % 5) WHEN 1 THEN NULL
                             ELSE lower(c_mktsegment) || '.example' END FROM customer)
 GROUP BY domain)
"""


def _contact_steps(keys: str) -> str:
    return f"""
SELECT CAST(sum(n) AS BIGINT) AS input, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (WHERE known) AS already_known,
       count(*) FILTER (WHERE NOT known AND blocked) AS excluded,
       CAST(sum(n - 1) + count(*) FILTER (WHERE known) + count(*) FILTER (WHERE NOT known AND blocked) AS BIGINT) AS removed,
       count(*) FILTER (WHERE NOT known AND NOT blocked) AS "left"
FROM {keys}
"""


SQL.update({
    "audited_contacts": SQL["clean_contacts"],
    "audited_contacts_funnel": SQL["contact_funnel"],
    "audited_postings": SQL["clean_postings"],
    "audited_postings_funnel": SQL["posting_funnel"],
    "daily_run_contact_funnel": _contact_steps(_DAY_KEYS),
    "daily_run_posting_funnel": f"""
SELECT count(*) AS input, 0::BIGINT AS incomplete, count(*) FILTER (WHERE {POSTING_EXCLUDED}) AS excluded,
       count(*) FILTER (WHERE NOT {POSTING_EXCLUDED}) AS "left"
FROM (SELECT DISTINCT {FIELDS} FROM {COLLECTED})
""",
    "daily_run_record_funnel": f"""
SELECT count(*) AS input, {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS without_{c}" for c in FIELDS.split(", "))},
       count(*) FILTER (WHERE company IS NULL) AS removed, count(*) FILTER (WHERE company IS NOT NULL) AS "left"
FROM {_DAY_RECORDS}
""",
    "mailbox_funnel": f"""
SELECT CAST(sum(n) AS BIGINT) AS input, CAST(coalesce(sum(n) FILTER (WHERE listed), 0) AS BIGINT) AS excluded,
       CAST(coalesce(sum(n) FILTER (WHERE NOT listed AND known), 0) AS BIGINT) AS already_known,
       CAST(coalesce(sum(n - 1) FILTER (WHERE NOT listed AND NOT known), 0) AS BIGINT) AS duplicates,
       count(*) FILTER (WHERE NOT listed AND NOT known AND NOT valid) AS invalid,
       CAST(sum(n) - count(*) FILTER (WHERE NOT listed AND NOT known AND valid) AS BIGINT) AS removed,
       count(*) FILTER (WHERE NOT listed AND NOT known AND valid) AS "left"
FROM {_MAIL_DOMAINS}
""",
    "rejected_domains": f"SELECT domain, n FROM {_MAIL_DOMAINS} WHERE NOT listed AND NOT known AND NOT valid",
})

SQL["url_state_buckets"] = SQL["url_state"]


# ============================================================================ layouts, rejects, findings per domain
_MASTERED = f"(SELECT ingest_seq, company, person, CASE WHEN ingest_seq % 11 <> 0 THEN email END AS email FROM {CC})"
_DOMAIN_FOUND = f"(SELECT DISTINCT d AS domain, page_id, email FROM {GIVEN} g JOIN ({SITES}) s ON g.page_id // 10 = s.k)"


def _rejects_sql(line: str) -> str:
    fits = "ingest_seq % 13 <> 0 AND ingest_seq % 17 <> 0"
    return f"""
SELECT CASE WHEN {fits} THEN ingest_seq END AS ingest_seq, CASE WHEN {fits} THEN company END AS company,
       CASE WHEN {fits} THEN email END AS email, CASE WHEN NOT ({fits}) THEN {line} END AS line
FROM (SELECT *, CASE WHEN ingest_seq % 13 = 0 THEN 'x' ELSE '' END || ingest_seq AS no FROM {CC})
"""


SQL.update({
    "stream_earliest": """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""",
    "bucketed_master": f"""
SELECT * FROM {_MASTERED} WHERE company = 'AUTOMOBILE'
UNION ALL
SELECT * FROM {_MASTERED} e WHERE NOT EXISTS (
  SELECT 1 FROM {_MASTERED} m WHERE m.company = 'AUTOMOBILE' AND m.email IS NOT DISTINCT FROM e.email)
""",
    "domain_addresses": f"SELECT domain, email, count(DISTINCT page_id) AS n_pages FROM {_DOMAIN_FOUND} GROUP BY domain, email",
    "domain_summary": f"""
SELECT domain, count(DISTINCT email) AS n_addresses, count(DISTINCT page_id) AS n_pages FROM {_DOMAIN_FOUND} GROUP BY domain
""",
    "recency_by_day": SQL["recency_7"],
    "load_csv_rejects": _rejects_sql("no || ',' || company || ',' || email || CASE WHEN ingest_seq % 17 = 0 THEN ',more' ELSE '' END"),
    "load_json_rejects": _rejects_sql(
        "'{\"ingest_seq\": ' || no || ', \"company\": \"' || company || '\", \"email\": \"' || email || "
        "CASE WHEN ingest_seq % 17 = 0 THEN '\"' ELSE '\"}' END"),
})

SQL["create_and_replace"] = f"SELECT ingest_seq, company, person, email FROM {CC}"
