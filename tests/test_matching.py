"""Pattern matching: automata against plain look-ups, on long texts and large catalogs."""

import random
import time

import pytest

from spendgrid.functions.matching import containing


@pytest.mark.parametrize("chars", [1 << 20, 40])
def test_against_plain_lookup(spark, chars):
    """The same hits from one automaton and from many: overlapping, nested and repeated patterns, any characters."""
    rng = random.Random(chars)
    texts = [(i, "".join(rng.choices("abcé中 ", k=rng.randint(0, 60)))) for i in range(200)] + [(7, None), (None, "abc"), (8, "")]
    pats = ["".join(rng.choices("abcé中 ", k=rng.randint(1, 5))) for _ in range(60)] + ["a", "ab", "abc", "bc", "", None]
    rows = [(p, i, "x") for i, p in enumerate(pats)] + [("abc", 99, "y")]
    q = spark.createDataFrame(texts, "id int, t string")
    got = containing(q, "id", "t", spark.createDataFrame(rows, "pat string, n int, key string"), "pat", chars)
    assert got.columns == ["id", "pat", "n", "key"]
    want = [(i, p, n, k) for i, t in texts for p, n, k in rows if t and p and p in t]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_megabyte_texts_are_read_once(spark):
    """Time grows with the text, not with the patterns; no exchange of the texts and no exploded substrings in the plan."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(20_000)]
    texts = [(i, " ".join(rng.choices(words, k=130_000))) for i in range(4)]
    q = spark.createDataFrame(texts, "id int, t string")
    pats = sorted(set(words[:5_000] + ["".join(rng.choices("xyz", k=9)) for _ in range(5_000)]))
    start = time.time()
    hits = containing(q, "id", "t", spark.createDataFrame([(p,) for p in pats], "pat string"), "pat")
    got = hits.groupBy("id").count().collect()
    assert time.time() - start < 30
    assert {r.id: r["count"] for r in got} == {i: len(set(t.split()) & set(pats)) for i, t in texts}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
