"""Queries on thresholds, with SQL twins."""

from __future__ import annotations

from folioframe.operators import pixels as P
from folioframe.operators import thresholds as H
from folioframe.plans.raster_queries import HIST, OTSU, T, _stats, gray, sql_pass

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


DENSE = "SELECT i.img_id, CAST(r.g AS INTEGER) AS g, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT img_id FROM {0}) i CROSS JOIN range(256) r(g) LEFT JOIN {1} h ON h.img_id = i.img_id AND h.g = r.g"
add("peak_threshold", gray(H.peak), f"""{T}, h0 AS ({HIST}), h AS ({DENSE.format('tile', 'h0')}), u AS (SELECT *, max(n) OVER (PARTITION BY img_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u, max(n) OVER (PARTITION BY img_id ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM h),
s AS (SELECT *, min(CASE WHEN n < u * 0.66::DOUBLE THEN g END) OVER (PARTITION BY img_id) AS stop, max(CASE WHEN n < d * 0.66::DOUBLE THEN g END) OVER (PARTITION BY img_id) AS start FROM u),
l AS (SELECT img_id, g AS l FROM s WHERE g < coalesce(stop, 256) QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY n DESC, g) = 1), r AS (SELECT img_id, g AS r FROM s WHERE g > coalesce(start, -1) QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY n DESC, g DESC) = 1)
SELECT l.img_id, CAST(floor(l + (r - l) * 0.75) AS INTEGER) AS threshold FROM l JOIN r ON r.img_id = l.img_id""")
add("mokji_threshold", gray(lambda t: H.edge_mean(t, 2, 20)), f"""{T}, m AS ({sql_pass('tile', 'min', 'g', (-2, 2), (-2, 2), 'm', ', g')}), e AS (SELECT img_id, CASE WHEN x BETWEEN 2 AND max(x) OVER (PARTITION BY img_id) - 2 AND y BETWEEN 2 AND max(y) OVER (PARTITION BY img_id) - 2 AND g - m >= 20 THEN g + m END AS v FROM m)
SELECT img_id, CAST(CASE WHEN count(v) > 0 THEN (sum(v) + count(v)) // (2 * greatest(count(v), 1)) ELSE 128 END AS INTEGER) AS threshold FROM e GROUP BY img_id""")
ONE = "(0.5::DOUBLE * (g * ((g + 1) / (mean + 1) - 0.5)) + (1 - 0.5::DOUBLE) * g)"
for name, plus, divide, value in (("edge_plus", 0.5, 0.0, ONE), ("edge_div", 0.5, 0.5, None)):
    norm = f"(0.5::DOUBLE * ((mean + 1) / ({ONE} + 1) - 0.5) + (1 - 0.5::DOUBLE))"
    value = value or f"CASE WHEN {norm} > 0 THEN g / {norm} ELSE g END"
    add(f"bin_{name}", gray(lambda t, a=plus, b=divide: (lambda s: P.binarized_count(s, P.otsu(s)))(H.edge_divided(t, 5, a, b))), OTSU.replace("tile AS", "tile0 AS", 1).replace("bw AS (SELECT img_id, y, x, CAST(g < 128 AS INTEGER) AS bw FROM tile)", f"{_stats(5).replace('FROM tile', 'FROM tile0')}, tile AS (SELECT img_id, y, x, CAST(floor(greatest(0.0, least(255.0, round({value}, 6)))) AS INTEGER) AS g FROM (SELECT * REPLACE (CAST(g AS DOUBLE) AS g) FROM st))", 1) + " SELECT o.img_id, threshold, CAST(sum(CAST(g < threshold AS INTEGER)) AS BIGINT) AS black FROM tile JOIN o ON o.img_id = tile.img_id GROUP BY ALL")
add("dominant_background", gray(H.dominant_background), f"""{OTSU}, w AS (SELECT tile.img_id, g FROM tile JOIN o ON o.img_id = tile.img_id WHERE g >= threshold), w1 AS (SELECT img_id, g, count(*) AS n FROM w GROUP BY ALL), d AS ({DENSE.format('w', 'w1')}),
e AS (SELECT *, sum(n) OVER (PARTITION BY img_id ORDER BY g ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM d), f AS (SELECT img_id, g AS first, s FROM e WHERE g <= 246 QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY s DESC, g) = 1),
k AS (SELECT d.img_id, d.g, f.s, sum(d.n) OVER (PARTITION BY d.img_id ORDER BY d.g) AS upto FROM d JOIN f ON f.img_id = d.img_id AND d.g BETWEEN first AND first + 9) SELECT img_id, min(g) AS level FROM k WHERE upto >= s // 2 GROUP BY img_id""")
