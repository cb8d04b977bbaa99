"""SQL (DuckDB) spellings of the text functions, for the twins of the text queries."""

from __future__ import annotations

from spendgrid.functions import text as T

WS = T.WS
LB = T.LINE_BREAK


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def lines(x: str) -> str:
    """splitlines(): split on line breaks, drop the empty element after a trailing break."""
    sp = f"string_split_regex({x}, '{LB}')"
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN []::VARCHAR[] "
            f"WHEN regexp_matches({x}, '({LB})$') THEN list_slice({sp}, 1, len({sp}) - 1) ELSE {sp} END")


def corpus_cte(marker: str, name: str = "corpus") -> str:
    m = marker.replace("'", "''")
    return f"""{name} AS (
  SELECT d.doc_id, coalesce(array_to_string(list_transform({lines('d.text')},
           lambda l, i: CASE WHEN i % 7 = 0 THEN '{m}' || l ELSE l END), chr(10)), '') AS text
  FROM documents d)"""


def lines_cte(src: str = "corpus", name: str = "ln") -> str:
    return f"""{name} AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {lines('text')} AS l FROM {src}))"""


def tokens_word(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '{T.WORD_RUN}'), "
            f"lambda w: regexp_full_match(w, '[a-z0-9_áéíóúñ]+') AND length(w) > 1)")


def _drop(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _undouble(y: str) -> str:
    return (f"CASE WHEN length({y}) > 3 AND right({y}, 1) = substr({y}, length({y}) - 1, 1) "
            f"AND right({y}, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN {_drop(y, 1)} ELSE {y} END")


def stem_list(lst: str) -> str:
    s1 = (f"list_transform({lst}, lambda x: CASE "
          f"WHEN suffix(x, 'ies') AND length(x) > 4 THEN {_drop('x', 3)} || 'y' "
          f"WHEN suffix(x, 'es') AND length(x) > 4 AND substr(x, length(x) - 2, 1) IN ('s', 'x', 'z') THEN {_drop('x', 2)} "
          f"WHEN suffix(x, 's') AND NOT suffix(x, 'ss') AND length(x) > 3 THEN {_drop('x', 1)} ELSE x END)")
    s2 = (f"list_transform({s1}, lambda x: CASE "
          f"WHEN suffix(x, 'ing') AND length(x) > 5 THEN {_undouble(_drop('x', 3))} "
          f"WHEN suffix(x, 'ed') AND length(x) > 4 THEN {_undouble(_drop('x', 2))} ELSE x END)")
    return f"list_transform({s2}, lambda x: CASE WHEN suffix(x, 'e') AND length(x) > 4 THEN {_drop('x', 1)} ELSE x END)"


def tokens_stem(x: str) -> str:
    sw = ", ".join(f"'{w}'" for w in T.STOPWORDS_B)
    raw = f"regexp_extract_all(replace(lower({x}), '''', ''), '[a-z0-9]+')"
    kept = f"list_filter({raw}, lambda w: NOT list_contains([{sw}], w) AND length(w) >= 2)"
    return stem_list(kept)


def expansion_ctes(src: str, out: str) -> str:
    """Unrolled F9 over ``src(qid, toks)`` -> ``out(qid, toks)`` (originals + additions)."""
    parts = [f"{out}_0 AS (SELECT qid, toks, list_distinct(toks) AS seen, []::VARCHAR[] AS extra FROM {src})"]
    for i, (key, syns) in enumerate(T.QUERY_EXPANSION, start=1):
        stems = stem_list("[" + ", ".join(f"'{w}'" for w in syns) + "]")
        arr = f"list_filter({stems}, lambda p, j: list_position({stems}, p) = j)"
        kstem = stem_list(f"['{key}']") + "[1]"
        new = f"list_filter({arr}, lambda p: NOT list_contains(seen, p))"
        hit = f"(list_contains(seen, {kstem}) OR list_contains(seen, '{key}'))"
        parts.append(
            f"{out}_{i} AS (SELECT qid, toks, CASE WHEN {hit} THEN list_concat(seen, {new}) ELSE seen END AS seen, "
            f"CASE WHEN {hit} THEN list_concat(extra, {new}) ELSE extra END AS extra FROM {out}_{i - 1})"
        )
    n = len(T.QUERY_EXPANSION)
    parts.append(f"{out} AS (SELECT qid, list_concat(toks, extra) AS toks FROM {out}_{n})")
    return ",\n".join(parts)
