"""Mail outbox rendering.

The template is split once on the driver into literal text and placeholders;
each row's content is then one ``concat`` of literals and columns (no per-row
template engine). Placeholders: ``{{ name }}`` or
``{{ name | default("text") }}``. A placeholder that is neither a column nor
has a default fails when the plan is built. Values are inserted as they are
(no HTML escaping). Sending is not part of this library.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsmith.functions.names import addressed_name, salutation_safe
from leadsmith.sources.lookups import MAIL_SUBJECT

PLACEHOLDER_RE = re.compile(r"\{\{\s*(\w+)\s*(?:\|\s*default\(\s*\"([^\"]*)\"\s*\))?\s*\}\}")

# Default template (our own wording). ``ansprache`` and ``name`` come from
# the salutation step; ``link_hinweis`` / ``link_text`` have defaults.
DEFAULT_TEMPLATE = (
    "<p>{{ ansprache }} {{ name }},</p>\n"
    "<p>wir suchen Projekte fuer ganze Teams statt Einzelbeauftragungen.</p>\n"
    "<p>{{ link_hinweis | default(\"Mehr zu uns finden Sie \") }}"
    "<a href=\"https://team.example/\">{{ link_text | default(\"auf unserer Website\") }}</a>.</p>\n"
)


def compile_template(template: str, columns: list[str]) -> Column:
    """Split the template into a ``concat`` of literals and column values."""
    parts: list[Column] = []
    pos = 0
    for m in PLACEHOLDER_RE.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name, default = m.group(1), m.group(2)
        if name in columns:
            col = F.col(name).cast("string")
            parts.append(F.coalesce(col, F.lit(default)) if default is not None else F.coalesce(col, F.lit("")))
        elif default is not None:
            parts.append(F.lit(default))
        else:
            raise KeyError(f"template placeholder '{name}' has no column and no default")
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def build_outbox(enriched: DataFrame, template: str = DEFAULT_TEMPLATE, subject: str = MAIL_SUBJECT,
                 email_col: str = "email", last_col: str = "last_name",
                 gender_col: str = "gender") -> DataFrame:
    """``(email, subject, content)`` per contact.

    ``male`` / ``female`` get the personal salutation with the last name;
    anything else (and a null last name) the neutral one with an empty name.
    """
    staged = enriched.select(
        F.col(email_col).alias("email"),
        salutation_safe(F.col(gender_col), F.col(last_col)).alias("ansprache"),
        addressed_name(F.col(gender_col), F.col(last_col)).alias("name"),
    )
    content = compile_template(template, staged.columns)
    return staged.select("email", F.lit(subject).alias("subject"), content.alias("content"))
