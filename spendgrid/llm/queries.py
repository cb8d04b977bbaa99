"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from spendgrid.llm import q_audit, q_count, q_dedup, q_embed, q_mix, q_pieces, q_text

_MODULES = (q_dedup, q_text, q_mix, q_count, q_audit, q_pieces, q_embed)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
