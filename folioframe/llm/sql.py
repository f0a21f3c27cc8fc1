"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

from folioframe.llm import decontamination, license_scan, line_dedup

_WORD = "[^\\x20\\x09-\\x0D]"


def line_dedup_sql() -> str:
    k = line_dedup
    return f"""
WITH src AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS k, doc_id, text FROM documents
), l AS (
  SELECT r, k, pos, line,
         CASE WHEN regexp_matches(line, '[0-9]') THEN regexp_replace(line, '{_WORD}*[0-9]{_WORD}*', '<*>', 'g') ELSE line END AS m
  FROM (SELECT r, k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM src WHERE text IS NOT NULL)
), w AS (SELECT * FROM l WHERE regexp_matches(line, '{_WORD}')
), d AS (SELECT m, count(DISTINCT k) AS docs, regexp_extract_all(m, '{_WORD}+') AS t FROM w GROUP BY m
), f AS (SELECT *, (len(t), {", ".join(f"coalesce(t[{i + 1}], '')" for i in range(k.DEPTH))}) AS leaf FROM d
), n AS (SELECT *, sum(docs) OVER (PARTITION BY leaf) AS n, count(*) OVER (PARTITION BY leaf) AS kinds FROM f
), x AS (SELECT leaf, m, docs, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM n WHERE n >= {k.MIN_DOCS} AND kinds > 1
), y AS (SELECT *, sum(docs) OVER (PARTITION BY leaf, pos, token) >= {k.MIN_DOCS} AS same FROM x
), s AS (SELECT leaf, m, string_agg(CASE WHEN same THEN token ELSE '<*>' END, ' ' ORDER BY pos) AS shape FROM y GROUP BY leaf, m
         HAVING 100 * count(*) FILTER (WHERE same) >= {k.SIMILAR} * count(*)
), z AS (SELECT n.m, n.leaf, coalesce(s.shape, array_to_string(n.t, ' ')) AS shape FROM n LEFT JOIN s ON n.leaf = s.leaf AND n.m = s.m WHERE n.n >= {k.MIN_DOCS}
), h AS (SELECT w.r, w.k, w.pos, z.leaf, z.shape FROM w JOIN z ON w.m = z.m
), q AS (SELECT leaf, shape, min(k) AS first FROM h GROUP BY leaf, shape HAVING count(DISTINCT k) >= {k.MIN_DOCS}
), g AS (SELECT DISTINCT h.r, h.pos FROM h JOIN q ON h.leaf = q.leaf AND h.shape = q.shape WHERE h.k <> q.first
), o AS (SELECT l.r, count(*) AS n_lines, count(g.pos) AS n_dropped, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS kept
         FROM l LEFT JOIN g ON l.r = g.r AND l.pos = g.pos GROUP BY l.r)
SELECT src.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_dropped, 0) AS n_dropped, CASE WHEN src.text IS NOT NULL THEN coalesce(o.kept, '') END AS kept
FROM src LEFT JOIN o ON src.r = o.r"""


def license_scan_sql() -> str:
    k = license_scan
    known = ", ".join(f"('{s}', '{i}')" for s, i in k.known().items())
    names = ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(k.rules()))
    left = "'|' || string_agg(id, '||' ORDER BY pos) || '|'"
    for i, (_, sequence) in enumerate(k.rules()):
        left = f"replace({left}, '|{k.MARK.join(sequence)}|', '<{i}>')"
    return f"""
WITH known(s, id) AS (VALUES {known}), rules(i, name) AS (VALUES {names}),
t AS (SELECT doc_id, regexp_replace('|' || regexp_replace(regexp_replace(lower(replace(text, '{k.DOTTED}', 'I')), '{k.CUT}', '|', 'g'), '{k.OTHER}', ' ', 'g') || '|', '{k.GAP}', '{k.MARK}', 'g') AS s FROM documents),
h AS (SELECT doc_id, regexp_extract_all(s, '{k.pattern()}') AS h FROM t),
u AS (SELECT doc_id, trim(regexp_replace(unnest(h), '[ |]+', ' ', 'g')) AS s, generate_subscripts(h, 1) AS pos FROM h),
f AS (SELECT doc_id, string_agg(id, '|' ORDER BY pos) AS ids, {left} AS rest FROM u JOIN known ON known.s = u.s GROUP BY doc_id),
r AS (SELECT doc_id, CAST(unnest(n) AS INTEGER) AS i, generate_subscripts(n, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(rest, '<([0-9]+)>', 1) AS n FROM f)),
m AS (SELECT doc_id, string_agg(name, '|' ORDER BY pos) AS licenses FROM (SELECT doc_id, name, min(pos) AS pos FROM r JOIN rules ON r.i = rules.i GROUP BY doc_id, name) GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.ids, '') AS identifiers, coalesce(m.licenses, '') AS licenses
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


def decontamination_sql() -> str:
    k = decontamination.SHINGLE
    gram = lambda table, key: f"""
  SELECT {key}, len(w) - {k - 1} AS n, generate_subscripts(w[1:len(w) - {k - 1}], 1) - 1 AS p, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS h
  FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}) WHERE len(w) >= {k}"""  # noqa: E731
    return f"""
WITH d AS ({gram("documents", "doc_id")}), i AS ({gram("benchmark", "item_id")}),
win AS (SELECT DISTINCT doc_id, i.n AS size, least(i.n, d.n) AS size_, greatest(0, least(d.p - i.p, d.n - least(i.n, d.n))) AS start FROM d JOIN i ON d.h = i.h),
x AS (SELECT win.doc_id, win.start, win.size, win.size_, d.h, count(*) AS c FROM win JOIN d ON d.doc_id = win.doc_id AND d.p >= win.start AND d.p < win.start + win.size_ GROUP BY ALL),
y AS (SELECT item_id, n AS size, h, count(*) AS c FROM i GROUP BY ALL),
z AS (SELECT x.doc_id, x.start, y.item_id, sum(least(x.c, y.c)) AS both_, max(x.size_ + y.size) AS total FROM x JOIN y ON x.size = y.size AND x.h = y.h GROUP BY ALL),
s AS (SELECT doc_id, item_id, start, both_, total - both_ AS either_ FROM z WHERE 100 * both_ >= {decontamination.PERCENT} * (total - both_))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(both_ AS DOUBLE) / CAST(either_ AS DOUBLE) AS similarity
FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(both_ AS DOUBLE) / CAST(either_ AS DOUBLE) DESC, start) = 1"""
