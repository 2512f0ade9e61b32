"""Lookup lists shipped as defaults.

Lists are parameters of every operator: callers pass their own tables; these
are only defaults. Order matters where a list is a priority (local parts,
contact paths): the row position becomes an explicit ``rank`` column.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the behaviour being reproduced, so they are
# stated as-is, in their original order.
# ---------------------------------------------------------------------------

# Generic mailbox local parts; list order is priority (first = best).
LOCAL_PARTS = [
    "info", "kontakt", "contact", "freelancer", "freelance",
    "inbox", "recruiting", "bewerbung", "application", "applications", "projects",
    "hello", "hi", "office", "mail", "post", "team",
    "sales", "vertrieb", "business", "b2b", "partner", "alliances",
    "jobs", "career", "karriere", "hr", "humanresources",
]

# Contact / imprint paths tried per domain, in priority order.
CONTACT_PATHS = [
    "", "kontakt", "kontakt/", "impressum", "impressum/",
    "imprint", "imprint/", "contact", "contact/",
    "about", "team", "datenschutz", "datenschutz/",
    "privacy", "privacy/",
    "de/impressum", "de/impressum/", "de/kontakt", "de/kontakt/",
    "en/contact", "en/contact/", "en/privacy", "en/privacy/",
    "legal-notice", "legal-notice/", "legal", "legal/",
]

# Base URL templates per scheme tier (https tier 1 is tried before http tier 2).
BASE_TEMPLATES = [
    (1, 1, "https://{d}/"), (1, 2, "https://www.{d}/"),
    (2, 1, "http://{d}/"), (2, 2, "http://www.{d}/"),
]

# Contact-domain blocklist (terms with "@" are full addresses, others domains).
# The original list lost a comma between the last two entries; here they are
# two separate entries, both effective.
CONTACT_BLOCKLIST = [
    "concordcobalt.de",
    "ferchau.com",
    "hays.de",
    "hays.at",
    "etengo.de",
    "percision.de",
    "sparkm.de",
    "sw-xperts.com",
    "solcom.de",
    "varius-ti.com",
    "weissenberg-group.de",
]

# Posting-title exclusion terms (case-insensitive substrings).
TITLE_TERMS = ["bauleiter", "Linux", "SAP", "Unix", "wordpress"]

# Domain substring blocklist for the mailbox finder.
DOMAIN_BAD_LIST = ["aplitrak.com"]

# Surname particles joined to the last name when they sit in the middle.
NAME_PARTICLES = ["von", "van", "vom", "zu", "zur", "zum", "de", "der", "den", "del", "della", "du", "di"]

# Salutations by gender; anything else gets the neutral text and no name.
SALUTATION_MALE = "Lieber Herr "
SALUTATION_FEMALE = "Liebe Frau "
SALUTATION_NEUTRAL = "Sehr geehrte Damen und Herren "

# Zero-width code points removed before matching.
ZERO_WIDTH = ["\u200b", "\u200c", "\u200d", "\u2060", "\ufeff"]

# De-obfuscation rules, applied in this order (case-insensitive, Java regex).
DEOBFUSCATION_RULES = [
    (r"\s*\[\s*at\s*\]\s*", "@"),
    (r"\s*\(\s*at\s*\)\s*", "@"),
    (r"\s+at\s+", "@"),
    (r"\s*\{\s*at\s*\}\s*", "@"),
    (r"\s*\[\s*dot\s*\]\s*", "."),
    (r"\s*\(\s*dot\s*\)\s*", "."),
    (r"\s+dot\s+", "."),
    (r"\s*\{\s*dot\s*\}\s*", "."),
]

# Generic address pattern (Java regex; same text in the DuckDB oracle).
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"

# Label words that mark a contact segment.
LABEL_PATTERN = r"(?i)e-?mail|kontakt|contact|impressum"

# Class names of the job board's pages.
CARD_TAG, CARD_LINK_CLASSES = "search-project-card", ["small", "fw-semibold", "link-warning"]

# Recency periods: 0 = the as-of day, 1 = the day before, 7 = the last 7 days.
RECENCY_PERIODS = (0, 1, 7)

# Keyword-score groups, each worth one third by default, and the hand-off
# threshold in percent.
SCORE_GROUP_WEIGHTS = {"mini": 1 / 3, "top": 1 / 3, "heading": 1 / 3}
SCORE_THRESHOLD = 75.0

# Outbox subject line.
MAIL_SUBJECT = "Anfrage zu Beauftragungen"
