"""Source divergence audit against a plain dense count."""

import random
import re
from collections import Counter, defaultdict

import pytest

from spendgrid.llm import source_audit
from spendgrid.llm.source_audit import audit_sources

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", g or "", s or "") for _, t, g, s in rows):
        terms = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counter[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        of = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(of[s][t] - whole[t], t) for t in kept if count[lang, s][t] and of[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def rows_of(seed=0, docs=300):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "Été", "naïve", "中文", "x", "don't", "a1b", "Ünïc", "\0z"] + [f"w{chr(97 + i)}q" for i in range(20)]
    rows = []
    for i in range(docs):
        source = rng.choices(["s1", "s2", "s3", None, "é", ""], [50, 10, 5, 3, 3, 2])[0]
        words = rng.choices(vocabulary, [rng.random() ** 3 + 0.01 for _ in vocabulary], k=rng.randint(0, 30))
        rows.append((i, rng.choice([" ", "\n", "-", "3"]).join(words), rng.choice(["en", "en", "fr", None]), source))
    return rows + [(None, None, "en", "s1"), (7, "", "xx", "only"), (8, "rare words", "yy", "p"), (8, "rare words", "yy", "q"), (9, "long " * 50_000, "en", "s2")]


@pytest.mark.parametrize(("tile", "terms", "cells"), [(128, 2048, 1 << 18), (2, 3, 5)])
def test_against_dense_counts(make_docs, monkeypatch, tile, terms, cells):
    monkeypatch.setattr(source_audit, "TILE", tile)
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", terms)
    monkeypatch.setattr(source_audit, "MAX_CELLS", cells)
    rows = rows_of()
    docs = make_docs(rows).selectExpr("*", "'clash' AS term", "1 AS v", "2 AS part").repartition(5)
    got = sorted(tuple(r) for r in audit_sources(docs, min_docs=5, top_terms=4).collect())
    want = brute(rows, 5, 4)
    assert got == want and {r[2] for r in want} == {"pair", "term"}


def test_defined_edges(make_docs):
    assert audit_sources(make_docs([])).collect() == []
    rows = [(1, None, None, None), (2, "a", None, "z"), (3, "a", "", "")]
    got = audit_sources(make_docs(rows)).collect()  # no term in 30 documents
    assert sorted(tuple(r) for r in got) == [("", "", "pair", "z", 0, 1), ("", "z", "pair", "", 0, 1)]


def test_shares_beyond_a_long_product(spark):
    """Counts at which scale * count leaves a long are still exact."""
    df = spark.createDataFrame([(10**13 + 7, 3 * 10**13, 10**6)], "n bigint, total bigint, v bigint")
    got = df.select(source_audit._share("n", "total", "v", 5, 10**9).cast("bigint").alias("p")).first().p
    assert got == 1 + 10**9 * (10**13 + 7 + 5) // (3 * 10**13 + 5 * 10**6)
