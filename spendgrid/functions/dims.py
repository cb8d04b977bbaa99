"""Dimension registry and parent map for the weekly fact.

``DIMS`` maps a user alias to the fact column (``global`` has none). ``PARENTS`` lists
the columns grouped *with* a dimension so that homonyms under different parents stay
apart. Hierarchies are ordered alias lists used by roll-up trees.
"""

from __future__ import annotations

DIMS = {
    "agrupa1": "agrupa1",
    "division": "division",
    "territorio": "territorio",
    "pdc": "pdc",
    "grupo_cuentas": "grupo",
    "cuentas": "cuenta",
    "global": None,
}

PARENTS = {
    "division": ["agrupa1"],
    "territorio": ["agrupa1", "division"],
    "pdc": ["agrupa1", "division", "territorio"],
    "grupo_cuentas": ["agrupa1"],
    "cuentas": ["agrupa1", "grupo"],
}

HIER_TERR = ["agrupa1", "division", "territorio", "pdc"]
HIER_ACCOUNT = ["agrupa1", "grupo", "cuenta"]


def group_columns(alias: str, available: list[str], exclude_parents=()) -> list[str]:
    """Parents present in the data (minus excluded ones) followed by the child column."""
    col = DIMS[alias]
    parents = [p for p in PARENTS.get(alias, []) if p in available and p not in exclude_parents]
    return parents + ([col] if col else [])
