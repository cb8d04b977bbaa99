"""The corpus pipeline against the brute-force versions of its stages."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from test_exact_dedup import SPACE
from test_mixing import brute_targets, words
from test_simhash import brute_groups

from spendgrid.llm import langid, packing
from spendgrid.llm.common import written
from spendgrid.session import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read_table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "pipeline-test"))
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    assert all(s.schema == stages[0].schema for s in stages[:5])


def test_language(stages):
    model = langid.train(stages[0])
    want = [(d, t) for d, t in rows(stages[0]) if model.predict(t)[0] != "und" and model.predict(t)[1] >= model.threshold]
    assert rows(stages[1]) == want and len(want) >= 0.99 * stages[0].filter("text rlike '[a-z]'").count()


def test_exact(stages):
    groups = defaultdict(list)
    for d, t in rows(stages[1]):
        groups[SPACE.sub("", t)].append((-len(t), d, t))
    assert rows(stages[2]) == sorted((d, t) for _, d, t in map(min, groups.values()))


def test_near(stages):
    before = rows(stages[2])
    stay = {d for d, _, c in brute_groups(before) if d == c}
    assert rows(stages[3]) == [(d, t) for d, t in before if d in stay]


def test_mix(stages):
    sizes, taken, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in stages[3].collect():
        sizes[r.source] += words(r.text)
    for r in stages[4].collect():
        taken[r.source] += words(r.text)
        times[r.doc_id] += 1
    want = brute_targets(sizes)
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in stages[3].collect()}
    for s, target in want.items():
        assert taken[s] == pytest.approx(target, rel=0.05, abs=50)


def test_pack_and_run(spark, stages):
    got = stages[5].collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((d, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for d, t in rows(stages[4]))
    hist = defaultdict(int)
    for r in got:
        hist[-(-r.n_tokens // 8) * 8] += 1
    assert sorted({r.bucket_len for r in got}) == packing.optimal_boundaries(list(hist.items()), corpus_pipeline.PACK_BUCKETS)
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens, r.bucket_len) for r in again.collect()) == sorted((r.doc_id, r.n_tokens, r.bucket_len) for r in got)


def test_null_and_repeated_ids_and_clashing_names(spark, stages):
    """Every stage keeps the rows of unlike texts, whatever their ids; other columns pass through."""
    base = [r for r in stages[0].collect() if r.text and r.lang][:150]
    rows = [(None if i % 3 == 0 else i % 5, r.text, r.lang, r.source, r.n_chars, f"tag {i}") for i, r in enumerate(base)]
    rows += [(None, base[0].text + " ", "en", base[0].source, 1, "copy"), (3, None, None, None, None, "null")]
    docs = spark.createDataFrame(rows, stages[0].schema.add("_row", "string"))
    for clash in ("_copies", "_sha", "fp", "row", "id", "size", "k"):
        docs = docs.selectExpr("*", f"'mine' AS `{clash}`")
    model = langid.train(stages[0])
    got = written(langid.keep_identified(docs, model), "pipeline-test")
    assert got.columns == docs.columns and "null" not in {r._row for r in got.collect()}
    before = {r._row: r.text for r in got.collect()}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        got = written(stage(spark, got, SF), "pipeline-test")
        assert got.columns == docs.columns, name
        tags = [r._row for r in got.collect()]
        if name == "exact dedup":
            assert sorted(SPACE.sub("", before[t]) for t in tags) == sorted({SPACE.sub("", t) for t in before.values()})
            before = {t: before[t] for t in tags}
        elif name == "SimHash near-dedup":
            number = {t: i for i, t in enumerate(sorted(before))}
            groups = {c for _, _, c in brute_groups([(number[t], x) for t, x in before.items()])}
            assert len(tags) == len(groups)
            before = {t: before[t] for t in tags}
        else:
            assert set(tags) <= set(before) and max(map(tags.count, tags)) <= 2 and {r.fp for r in got.collect()} == {"mine"}
    assert corpus_pipeline.STAGES[4][1](spark, got, SF).count() == got.count()


def test_empty_table(spark, stages):
    got = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, SF)
        assert got.collect() == []
