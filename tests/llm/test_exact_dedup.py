"""Exact deduplication against a brute-force grouping."""

import hashlib
import re
from collections import defaultdict

from spendgrid.llm.exact_dedup import drop_copies, exact_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        norm = SPACE.sub("", t or "")
        best = min(groups[norm])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (5, "a b c"), (3, "abc"), (9, " a  b c "), (7, "abd"), (1, None), (2, ""), (4, " \t\n"), (6, "a bc"), (8, "ä ö"), (10, "äö"),
    (None, "zz z"), (11, "z zz"), (12, "x" * 200_000), (13, "x" * 199_999 + " x"), (14, "x" * 100 + "y"), (15, "x" * 100 + "z"),
]


def test_matches_brute_force(make_docs):
    got = exact_dedup(make_docs(ROWS), digest=True).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    lazy = exact_dedup(make_docs(ROWS)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in lazy), key=str) == sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str
    )
    # the whole text of a row is hashed only where length and prefix repeat
    assert {r.doc_id for r in lazy if r.text_sha256 is None} == {6, 7}


def test_repeated_rows_keep_one(make_docs):
    got = exact_dedup(make_docs([(1, "a")] * 3 + [(2, "a")])).collect()
    assert [r.group_size for r in got] == [4] * 4 and sum(r.kept for r in got) == 1
    assert drop_copies(make_docs([(1, "a")] * 3 + [(2, "a"), (None, "b"), (None, "b ")])).count() == 2


def test_empty_table(make_docs):
    assert exact_dedup(make_docs([])).collect() == [] and drop_copies(make_docs([])).collect() == []


def test_drop_copies_keeps_all_columns(make_docs):
    docs = make_docs(ROWS)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.keep_id for r in exact_dedup(docs).collect()}


def test_drop_copies_with_any_ids_and_names(spark):
    """Null and repeated ids are rows like any other; no column name is reserved."""
    rows = [(None, f"text {i % 40}") for i in range(60)] + [(5, f"other {i}") for i in range(10)] + [(5, "other 1 "), (6, "text 3"), (7, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for clash in ("_row", "_kept_id", "_sha", "_norm", "_id", "_survives", "a.b"):
        docs = docs.selectExpr("*", f"'mine' AS `{clash}`")
    got = drop_copies(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert sorted(SPACE.sub("", r.text or "") for r in found) == sorted({SPACE.sub("", t or "") for _, t in rows})
    assert {c for r in found for c in r[2:]} == {"mine"}
    assert [r.doc_id for r in found if r.text == "text 3"] == [6] and [r.text for r in found if r.text and r.text.startswith("other 1")] == ["other 1 "]


def test_only_groups_of_one_length_and_prefix_are_hashed(spark):
    """The refinement's last step reads what the first two left over."""
    head = "x" * 64
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "bc"), (4, head + "b "), (5, "y" * 65)]
    got = {r.doc_id: (r.kept, r.text_sha256 is not None) for r in exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False), 4: (True, True), 5: (True, False)}
