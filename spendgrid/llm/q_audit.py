"""Registered query: source divergence audit (op11) and its twin."""

from __future__ import annotations

from spendgrid.llm.source_audit import audit_sources
from spendgrid.session import read_table

#: Fixed by the task: documents of a kept term, smoothing, scale of the shares, terms reported.
AUDIT_MIN_DOCS = 30
AUDIT_SMOOTHING = 5
AUDIT_SCALE = 1_000_000_000
AUDIT_TERMS = 50


def op11_source_audit(spark, sf_dir):
    return audit_sources(read_table(spark, sf_dir, "documents"), AUDIT_MIN_DOCS, AUDIT_SMOOTHING, AUDIT_SCALE, AUDIT_TERMS)


def _share_sql(count: str, total: str) -> str:
    return f"1 + ({AUDIT_SCALE}::HUGEINT * ({count} + {AUDIT_SMOOTHING})) // ({total} + {AUDIT_SMOOTHING} * v)"


_OP11_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, sum(n) AS n, count(*) AS docs
  FROM (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {AUDIT_MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, kept.term, kept.total, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
big AS (SELECT lang, source, sum(n) AS group_n FROM grid GROUP BY ALL),
s AS (SELECT grid.lang, grid.source, term, n, {_share_sql("n", "group_n")} AS p, {_share_sql("total", "lang_n")} AS q
  FROM grid JOIN big USING (lang, source) JOIN l USING (lang)),
diff AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(diff.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN diff ON diff.lang = a.lang AND diff.source = a.source AND diff.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR k <= {AUDIT_TERMS}"""

QUERIES = {"op11_source_audit": op11_source_audit}
SQL = {"op11_source_audit": _OP11_SQL}
