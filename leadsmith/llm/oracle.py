"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from leadsmith.llm.license_scan import TEMPLATES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _words(text: str) -> str:
    return _WORDS.format(f"coalesce({text}, '')")


OP10 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS g
       FROM b, range(greatest(len(w) - 13, 0) + 1) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM d, lens, range(len(w) - n + 1) AS t(i)),
occ AS (SELECT * FROM dw WHERE g IN (SELECT g FROM bw)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM occ, range(n) AS t(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256
       FROM occ JOIN bw USING (g) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _op3() -> str:
    """Every template is tried at every place: its key phrases and its two rarest
    words must stand there. The rarest are those of the highest IDF, ties by place."""
    rows = ",\n".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {_list(t.words)}, "
        f"[{', '.join(str(j) for j in sorted({j for a, b in t.keys for j in range(a, b)}))}])"
        for k, t in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
t(k, label, base, words, keys) AS (VALUES {rows}),
vocabulary AS (SELECT DISTINCT UNNEST(words) AS word FROM t),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT r, UNNEST(w) AS word FROM d) JOIN vocabulary USING (word) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) + 1e-3 AS x FROM vocabulary LEFT JOIN df USING (word)),
tw AS (SELECT k, j, words[j + 1] AS word, x, row_number() OVER (PARTITION BY k ORDER BY x DESC, j) AS rarity
       FROM t, range(len(words)) AS g(j) JOIN idf ON idf.word = words[j + 1]),
needs AS (SELECT tw.k, list(j) AS js, list(word) AS ws FROM tw JOIN t ON t.k = tw.k
          WHERE rarity <= 2 OR list_contains(keys, j) GROUP BY tw.k),
place AS (SELECT r, i, needs.k FROM d, needs, range(len(w)) AS g(i)
          WHERE list_bool_and([w[i + js[q] + 1] IS NOT DISTINCT FROM ws[q] FOR q IN range(1, len(js) + 1)])),
share AS (SELECT place.r, place.i, place.k,
                 least(sum(CASE WHEN d.w[place.i + tw.j + 1] = tw.word THEN tw.x ELSE 0 END) / sum(tw.x), 1.0) AS s
          FROM place JOIN d ON d.r = place.r JOIN tw ON tw.k = place.k GROUP BY ALL),
whole AS (SELECT share.*, t.label, t.base, CASE WHEN len(t.keys) = len(t.words) THEN 1.0 ELSE s END AS part
          FROM share JOIN t ON t.k = share.k),
found AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(i) FILTER (WHERE base) AS first_word,
                 max(i) FILTER (WHERE base) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR part >= 0.8) AS labels, max(part) AS score
          FROM whole GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (r)
"""


OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- Pieces first: taking a part of a text costs as much as what stands before it.
piece AS (SELECT doc_id, c * 256 AS begin_at, substr(h, 512 * c + 1, 512 + 198) AS p
          FROM d, range((len(h) // 2 + 255) // 256) AS t(c)),
win AS (SELECT doc_id, begin_at + o AS i, md5_number(substr(p, 2 * o + 1, 200)) AS k, doc_id::HUGEINT * 4294967296 + begin_at + o AS place
        FROM piece, range(least(256, len(p) // 2 - 99)) AS t(o)),
first AS (SELECT k, min(place) AS first FROM win GROUP BY k),
rep AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win JOIN first USING (k) WHERE place > first),
numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END)
                               OVER (PARTITION BY doc_id ORDER BY i) AS g FROM rep),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span),
cut AS (SELECT d.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
               string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
        FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""

OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, """ + _LOWER.format("coalesce(text, '')") + r""" AS t FROM documents),
piece AS (SELECT lang, row_number() OVER () AS q, p
          FROM (SELECT lang, UNNEST(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
w AS (SELECT lang, q, UNNEST(regexp_extract_all(p, '[^\x20\x09]+')) AS word, generate_subscripts(regexp_extract_all(p, '[^\x20\x09]+'), 1) AS i
      FROM piece),
total AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
g AS (SELECT lang, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4,
             lead(word, 4) OVER o AS w5 FROM w WINDOW o AS (PARTITION BY q ORDER BY i)),
f AS (SELECT lang, k, p, count(*) AS f FROM (
        SELECT lang, 1 AS k, word AS p FROM g UNION ALL
        SELECT lang, 2, word || ' ' || w2 FROM g UNION ALL
        SELECT lang, 3, word || ' ' || w2 || ' ' || w3 FROM g UNION ALL
        SELECT lang, 4, word || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM g UNION ALL
        SELECT lang, 5, word || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM g)
      WHERE p IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, k, p, f, string_split(p, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
longer AS (SELECT lang, array_to_string(ws[i + 1 : i + m], ' ') AS p, max(f) AS longer
           FROM c, range(2, k) AS t(m), range(k - m + 1) AS u(i) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * f),
-- One key for language and phrase: joins on the language alone would pair all its phrases.
part AS (SELECT lang || chr(10) || p AS key, f FROM f WHERE f >= 100 AND k < 5),
cuts AS (SELECT lang, p, f AS a, j, lang || chr(10) || array_to_string(ws[1 : j], ' ') AS front,
                lang || chr(10) || array_to_string(ws[j + 1 :], ' ') AS back
         FROM kept, range(1, k) AS t(j)),
scored AS (SELECT cuts.lang, cuts.p, a, j, x.f AS l, y.f AS r, n,
                  ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cuts JOIN part AS x ON x.key = front JOIN part AS y ON y.key = back
           JOIN total ON total.lang = cuts.lang),
cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM cut QUALIFY rank <= 2000
"""

SQL = {"op12_collocations": OP12, "op3_licenses": _op3(), "op5_suffix_dedup": OP5, "op10_decontamination": OP10}
