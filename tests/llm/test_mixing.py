"""Mixing: targets, constraints and rounding."""

import random
import re
from collections import Counter, defaultdict

import pytest

from spendgrid.llm import mixing
from spendgrid.llm.mixing import mix_sources, source_targets, take_copies


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, budget = {}, list(order), share * sum(sizes.values())
    while left:
        part = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if part[s] > cap * sizes[s]]
        if not over:
            return target | part
        for s in over:
            target[s] = cap * sizes[s]
            left.remove(s)
        budget -= sum(target[s] for s in over)
    return target


def rows_of(seed=0, docs=600):
    rng = random.Random(seed)
    rows = []
    for i in range(docs):
        source = rng.choices(["a", "b", "Z", None, "é", "c"], [30, 5, 3, 2, 10, 1])[0]
        rows.append((i, " \n".join(["w"] * rng.choice([0, 1, 3, 20, 50, 51, 300, rng.randint(1, 900)])), "en", source))
    return rows + [(9000, None, "en", "a"), (9001, "x " * 30_000, "en", "a"), (9002, "x y", "en", "a"), (9002, "x y", "en", "a"), (None, "p q r", "en", "b")]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("part_rows", [50_000, 7])
def test_sources_meet_their_targets(make_docs, monkeypatch, part_rows):
    monkeypatch.setattr(mixing, "CELL_PART_ROWS", part_rows)
    rows = rows_of()
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    got = mix_sources(make_docs(rows), [3, 1, 2]).collect()
    assert sorted(str((r.doc_id, r.size)) for r in got) == sorted(str((r[0], words(r[1]))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= max(2, 0.002 * want[s]), (s, n, want[s], taken[s])


def test_rates_are_tilted_exponentially(make_docs):
    got = [r for r in mix_sources(make_docs(rows_of()), [3, 1, 2]).collect() if r.size and r.target < 2 * r.source_size]
    import math

    by_source = defaultdict(list)
    for r in got:
        if r.rate < 2:
            by_source[r.source].append(math.log(r.rate) / r.size)
    for tilts in by_source.values():
        assert max(tilts) == pytest.approx(min(tilts), rel=1e-9)


def test_reruns_agree_whatever_the_order(make_docs):
    rows = rows_of(2, 300)
    first = sorted(map(str, mix_sources(make_docs(rows), [3, 1, 2]).collect()))
    random.Random(0).shuffle(rows)
    assert first == sorted(map(str, mix_sources(make_docs(rows).repartition(7), [3, 1, 2]).collect()))


def test_copies_are_rows(make_docs):
    docs = make_docs(rows_of(3, 200))
    out = take_copies(docs, [3, 1, 2])
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mix_sources(docs, [3, 1, 2]).collect())


def test_null_and_repeated_ids_are_rows(spark):
    """Each row gives exactly its own copies, whatever its id; no column name is reserved."""
    rng = random.Random(4)
    rows = [(None if i % 2 else i % 7, "w " * rng.randint(1, 60), rng.choice("ab"), f"row {i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tag string")
    for clash in ("_row", "_copies", "_copy", "_taken_id", "copies", "row", "id", "size"):
        docs = docs.selectExpr("*", f"'mine' AS `{clash}`")
    out = take_copies(docs, [3, 1, 2])
    assert out.columns == docs.columns
    got = out.collect()
    times, of_tag = Counter(r.tag for r in got), {tag: (i, t, s) for i, t, s, tag in rows}
    assert max(times.values()) <= 2 and all((r.doc_id, r.text, r.source) == of_tag[r.tag] and r._copies == r.size == "mine" for r in got)
    mixed = mix_sources(docs, [3, 1, 2]).collect()
    assert len(got) == sum(r.copies for r in mixed)
    want = defaultdict(float)
    for r in mixed:
        want[r.source] = r.target
    for s in "ab":
        taken = sum(words(r.text) for r in got if r.source == s)
        assert taken == sum(r.taken for r in mixed if r.source == s) == pytest.approx(want[s], rel=0.02)


def test_rows_without_an_id_are_spread(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_PART_ROWS", 7)
    rows = [(None, "same size here", "en", "a")] * 100 + [(i, "two words", "en", "b") for i in range(100)]
    got = mix_sources(make_docs(rows), [1, 3]).collect()
    assert sum(r.taken for r in got if r.source == "a") == pytest.approx(got[0].target if got[0].source == "a" else next(r.target for r in got if r.source == "a"), abs=3)


def test_degenerate_tables(make_docs):
    assert mix_sources(make_docs([]), [3, 1, 2]).collect() == []
    got = mix_sources(make_docs([(1, None, "en", None), (2, "", "en", "a")]), [3, 1, 2]).collect()
    assert all(r.taken == r.target == r.source_size == 0 for r in got) and len(got) == 2


def test_excess_is_shared_again():
    got = {r["source"]: r["target"] for r in source_targets([("a", 10), ("b", 1000), (None, 1000)], [3, 1, 2], 1.5, 2)}
    assert got == {"a": 20.0, "b": pytest.approx(2995 / 3), None: pytest.approx(2 * 2995 / 3)}
