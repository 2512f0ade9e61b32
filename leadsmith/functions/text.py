"""Column expressions for strings, URLs and e-mail addresses.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen. The single exception is ``clean_text(exact=True)``,
which routes only rows that need it (an ``&`` or a non-ASCII character)
through one Arrow-batched pandas UDF for HTML-unescape and NFKC.
"""

from __future__ import annotations

import html as _html
import sys
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsmith.sources.lookups import DEOBFUSCATION_RULES, EMAIL_PATTERN, ZERO_WIDTH

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- T6


def norm_str(c: ColumnOrName) -> Column:
    """Strip white space (newlines included, unlike ``trim``) and lower-case."""
    return F.lower(F.regexp_replace(_c(c), r"^\s+|\s+$", ""))


def strip_ws(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def blank_to_null(c: ColumnOrName, na_words: Sequence[str] = ()) -> Column:
    """Empty / white-space-only text (and optional NA words) become null."""
    col = _c(c)
    stripped = strip_ws(col)
    cond = (stripped == F.lit(""))
    if na_words:
        cond = cond | stripped.isin(list(na_words))
    return F.when(cond, F.lit(None).cast("string")).otherwise(col)


# --------------------------------------------------------------------------- T4 / T5


def email_domain_first(c: ColumnOrName) -> Column:
    """Text after the first ``@``, stripped and lower-cased; null without ``@``."""
    col = _c(c)
    at = F.instr(col, "@")
    return F.when(at > 0, norm_str(F.substr(col, at + 1)))


def email_domain_last(c: ColumnOrName) -> Column:
    """Text after the last ``@``; the whole value if there is none."""
    return F.element_at(F.split(_c(c), "@"), -1)


# --------------------------------------------------------------------------- T2 / URL parts


def normalize_domain(c: ColumnOrName) -> Column:
    """trim + lower, drop ``http(s)://`` and ``www.``, cut at the first ``/``."""
    return F.split_part(
        F.regexp_replace(norm_str(c), r"^(https?://)?(www\.)?", ""), F.lit("/"), F.lit(1)
    )


_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_AUTHORITY_HEAD_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
_HOST_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^@/?#]*@)?([^:/?#]*)"


def url_host(c: ColumnOrName) -> Column:
    """Lower-cased host name (no port, no user info); null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(_c(c), _HOST_RE, 1)), F.lit(""))


def normalize_url(c: ColumnOrName) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, ``/`` for
    an empty path; text that is no URL with a host stays as it is."""
    u = _c(c)
    head = F.lower(F.regexp_extract(u, _AUTHORITY_HEAD_RE, 1))
    rest = F.regexp_replace(F.substr(u, F.length(F.regexp_extract(u, _AUTHORITY_HEAD_RE, 1)) + 1), "#.*$", "")
    bare = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.when(rest == "", F.lit("/")).when(F.startswith(rest, F.lit("?")), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(head == "", u).otherwise(F.concat(bare, path))


def same_host(url: ColumnOrName, domain: ColumnOrName) -> Column:
    """Host equals the domain or is a sub-domain of it; junk URL -> false."""
    host = url_host(url)
    d = _c(domain)
    return F.coalesce((host == d) | host.endswith(F.concat(F.lit("."), d)), F.lit(False))


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal for an absolute path (``/a/b/../c`` ->
    ``/a/c``); a trailing ``.`` or ``..`` leaves a trailing slash."""
    segs = F.split(path, "/")
    body = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
    folded = F.aggregate(
        body, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(x == ".", acc)
        .otherwise(F.concat(acc, F.array(x))))
    last = F.element_at(segs, -1)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    plain = F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("/."))     # no dot segment: as it is
    return F.when(plain, path).otherwise(F.concat(F.lit("/"), F.array_join(folded, "/")))


def resolve_url(base: ColumnOrName, href: ColumnOrName) -> Column:
    """Resolve ``href`` against ``base`` for the common URL shapes.

    absolute (``scheme:``) as is; ``//host`` takes the base scheme; ``/path``
    takes scheme and authority; ``?q`` / ``#f`` replace query / fragment;
    anything else is joined to the base directory (empty segments in the
    middle dropped). Rooted and relative paths then lose their ``.`` and
    ``..`` segments; query and fragment are kept as written.
    """
    b, h = _c(base), _c(href)
    scheme = F.regexp_extract(b, _SCHEME_RE, 1)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_frag = F.regexp_replace(b, r"#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    path = F.regexp_extract(no_query, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/.*)?$", 1)
    directory = F.regexp_replace(path, r"[^/]*$", "")
    h_path = F.regexp_extract(h, r"^([^?#]*)", 1)
    h_rest = F.substr(h, F.length(h_path) + 1)
    # relative: base directory + reference, empty middle segments dropped
    merged = F.concat(F.when(directory == "", F.lit("/")).otherwise(directory), h_path)
    merged = F.regexp_replace(merged, "/{2,}", "/")
    return (
        F.when(h.isNull(), F.lit(None).cast("string"))
        .when(h == "", b)
        .when(h.rlike(_SCHEME_RE), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, _remove_dot_segments(h_path), h_rest))
        .when(h.startswith("?"), F.concat(no_query, h))
        .when(h.startswith("#"), F.concat(no_frag, h))
        .otherwise(F.concat(origin, _remove_dot_segments(merged), h_rest))
    )


def slug_title(c: ColumnOrName) -> Column:
    """Last ``/`` segment of a URL with ``-`` turned into blanks."""
    return F.replace(F.element_at(F.split(_c(c), "/"), -1), F.lit("-"), F.lit(" "))


# --------------------------------------------------------------------------- T12


def quote_regex(term: str) -> str:
    """Java literal quoting (``Pattern.quote`` rules)."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def literal_alternation(terms: Sequence[str]) -> str:
    return "|".join(quote_regex(t) for t in terms if t is not None and t != "")


# --------------------------------------------------------------------------- T1


def _zero_width_class() -> str:
    return "[" + "".join(ZERO_WIDTH) + "]"


# White space as Python's ``str.isspace`` defines it, spelled out so the Java
# patterns need no Unicode-class flag (which makes every rule much slower).
WS_CLASS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def deobfuscate(c: ColumnOrName) -> Column:
    """White space collapsed, then the eight ``[at]``/``dot`` rules in order."""
    return _rules(_c(c), False)


_BASIC_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"),
    ("&apos;", "'"), ("&nbsp;", " "), ("&#64;", "@"), ("&#x40;", "@"), ("&amp;", "&"),
]


def unescape_basic(c: ColumnOrName) -> Column:
    """Native unescape of the common entities (``&amp;`` last)."""
    col = _c(c)
    for ent, ch in _BASIC_ENTITIES:
        col = F.replace(col, F.lit(ent), F.lit(ch))
    return col


# Entities decoded natively in clean_text; the value is what unescape + NFKC
# would give. Any other ``&`` sequence sends the row to the exact UDF path.
_NATIVE_ENTITY_NAMES = [
    "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "middot", "bull", "hellip",
    "ndash", "mdash", "laquo", "raquo", "euro", "deg", "auml", "ouml", "uuml", "Auml", "Ouml",
    "Uuml", "szlig", "eacute", "egrave", "agrave", "ccedil", "#39", "#039", "#64", "#x40",
    "#34", "#160", "amp",
]
_NATIVE_ENTITIES = [(f"&{n};", unicodedata.normalize("NFKC", _html.unescape(f"&{n};")))
                    for n in _NATIVE_ENTITY_NAMES]


def _nfkc_sensitive_class() -> str:
    """Character class of code points NFKC may change or compose with.

    Derived from ``unicodedata`` (a rule, not a list) for U+0080-U+02FF,
    where Latin-script text lives: characters whose NFKC form differs. From
    U+0300 on (combining marks, other scripts, compatibility blocks) every
    character counts, which keeps the class to a few ranges: Java tests a
    class range by range, so a long class would cost per character.
    """
    def sensitive(cp: int) -> bool:
        if 0xD800 <= cp <= 0xDFFF:
            return False
        ch = chr(cp)
        return unicodedata.normalize("NFKC", ch) != ch or unicodedata.combining(ch) != 0
    ranges: list[tuple[int, int]] = []
    for cp in range(0x80, 0x300):
        if sensitive(cp):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1] = (ranges[-1][0], cp)
            else:
                ranges.append((cp, cp))
    body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return "[" + body + "\\x{300}-\\x{10FFFF}]"


_NATIVE_ENTITY_ALT = "|".join(n for n in _NATIVE_ENTITY_NAMES)
NEEDS_EXACT_RE = f"&(?!(?:{_NATIVE_ENTITY_ALT});)|{_nfkc_sensitive_class()}"


def unescape_native(c: ColumnOrName) -> Column:
    col = _c(c)
    out = col
    for ent, ch in _NATIVE_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return F.when(F.instr(col, "&") > 0, out).otherwise(col)


_ZERO_WIDTH = dict.fromkeys(map(ord, ZERO_WIDTH))


def _unescape_nfkc_py(s: pd.Series) -> pd.Series:
    def one(v):
        if v is None:
            return None
        return unicodedata.normalize("NFKC", _html.unescape(v).translate(_ZERO_WIDTH))
    return s.map(one)


# The UDF's function is shipped to the Python workers by value (it needs only
# the standard library there), so executors do not need this package installed.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
_unescape_nfkc = F.pandas_udf(_unescape_nfkc_py, T.StringType())


def _unescaped(col: Column, exact: bool) -> Column:
    """Unescape (+ NFKC on the exact path) and drop zero-width characters."""
    native = unescape_native(col)
    if exact:
        needs = col.rlike(NEEDS_EXACT_RE)
        col = F.when(needs, _unescape_nfkc(F.when(needs, col))).otherwise(native)
    else:
        col = native
    return F.regexp_replace(col, _zero_width_class(), "")


def clean_text(c: ColumnOrName, exact: bool = True) -> Column:
    """Unescape, drop zero-width, NFKC, de-obfuscate, collapse spaces.

    Rows whose entities are all common ones and that hold no character NFKC
    could change stay on the JVM (native entity table). With ``exact=True``
    the remaining rows go through one Arrow UDF (full HTML unescape + NFKC);
    with ``exact=False`` they get the native table only. Pass a column
    reference (not a long expression): the input is read more than once.
    ``with_clean_text`` is the staged form for DataFrames.
    """
    return deobfuscate(_unescaped(_c(c), exact))


def _rules(col: Column, only_spaced: bool) -> Column:
    # Collapsed first: a rule that begins with white space then looks at one blank, not
    # at each end of a long run. No rule leaves two blanks in a row.
    col = F.regexp_replace(col, WS_CLASS + "+", " ")
    for pattern, repl in DEOBFUSCATION_RULES:
        if only_spaced and any("\\" + b in pattern for b in "[({"):
            continue
        col = F.regexp_replace(col, "(?i)" + pattern.replace(r"\s", " "), repl)
    return col


def deobfuscate_guarded(c: ColumnOrName) -> Column:
    """``deobfuscate`` for a column reference: text without any of ``[ ( {``
    runs only the two space-based rules (the bracket rules cannot match it,
    and no rule inserts a bracket), all other text runs all eight."""
    col = _c(c)
    has_bracket = (F.instr(col, "[") > 0) | (F.instr(col, "(") > 0) | (F.instr(col, "{") > 0)
    return F.when(has_bracket, _rules(col, False)).otherwise(_rules(col, True))


def with_clean_text(df, in_col: str, out_col: str, exact: bool = True, strip: bool = False):
    """T1 on a DataFrame, staged: unescape/NFKC/zero-width in one projection,
    the rules in the next (each reads a column, not a repeated expression)."""
    cols = [c for c in df.columns if c != out_col]
    staged = df.select(*cols, _unescaped(F.col(in_col), exact).alias("__unesc"))
    cleaned = deobfuscate_guarded(F.col("__unesc"))
    return staged.select(*cols, (strip_ws(cleaned) if strip else cleaned).alias(out_col))


# --------------------------------------------------------------------------- E1 / E10


def email_matches(c: ColumnOrName) -> Column:
    """Array of all generic address matches, in text order (not lowered).

    Text without an ``@`` cannot match, so it skips the regex (a substring
    test instead of a scan that tries every word start)."""
    col = _c(c)
    return F.when(F.instr(col, "@") > 0, F.regexp_extract_all(col, F.lit(EMAIL_PATTERN), F.lit(0))) \
        .otherwise(F.array().cast("array<string>"))


# Without an end tag the rest of the page belongs to the script, as in a browser; so no
# start is searched to the end of the page more than once.
SCRIPT_RE = r"(?is)<script\b.*?(?:</script\s*+>|\z)"
STYLE_RE = r"(?is)<style\b.*?(?:</style\s*+>|\z)"
COMMENT_RE = r"(?s)<!--.*?(?:-->|\z)"
TAG_RE = r"(?s)<[^<>]+>"  # stops at the next "<": a stray "<" costs no scan to the end


def strip_markup(c: ColumnOrName) -> Column:
    """Drop script, style and comments; every tag becomes a blank."""
    col = _c(c)
    for pat in (SCRIPT_RE, STYLE_RE, COMMENT_RE):
        col = F.regexp_replace(col, pat, " ")
    return F.regexp_replace(col, TAG_RE, " ")


def visible_text(c: ColumnOrName, exact: bool = True) -> Column:
    """E10 as one expression (see ``with_visible_text`` for the staged form)."""
    return strip_ws(clean_text(strip_markup(c), exact=exact))


def with_visible_text(df, html_col: str = "html", out_col: str = "text", exact: bool = True):
    """E10 on a DataFrame: markup is stripped in one projection and cleaned in
    the next, so the stripped text is computed once per row."""
    cols = [c for c in df.columns if c != out_col]
    staged = df.select(*cols, strip_markup(html_col).alias("__stripped"))
    return with_clean_text(staged, "__stripped", out_col, exact=exact, strip=True).drop("__stripped")
