"""Unit tests of operators on small fixtures (brute force where useful)."""

import pandas as pd
from pyspark.sql import functions as F


def test_apply_filters_skips_missing(spark):
    from spendgrid.operators.filters import apply_filters

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "x int, y string")
    out = apply_filters(df, [("y", ("a", "c")), ("nope", 1)])
    assert sorted(r.x for r in out.collect()) == [1, 3]


def test_stemmer(spark):
    from spendgrid.functions.text import stem_word, tokens_stem

    text = "Rescheduling the payments: declined, missed, stopped; boxes flies hopping I'd agreed cars glasses uses"
    df = spark.createDataFrame([(text,)], "t string")
    want = ["reschedul", "payment", "declin", "mis", "stop", "box", "fly", "hop", "id", "agre", "car", "glass", "use"]
    assert df.select(tokens_stem(F.col("t"))).first()[0] == want
    words = spark.createDataFrame([(w,) for w in ("rescheduling", "flies", "bee", "ss", "falling")], "w string")
    assert [r[0] for r in words.select(stem_word(F.col("w"))).collect()] == ["reschedul", "fly", "bee", "ss", "fal"]


def test_tokens_word_drops_foreign_words(spark):
    from spendgrid.functions.text import tokens_word

    got = spark.createDataFrame([("Über año a_b x über niño 42",)], "t string").select(tokens_word(F.col("t"))).first()[0]
    assert got == ["año", "a_b", "niño", "42"]


def test_expand_query_cascades(spark):
    from spendgrid.functions.text import expand_query, tokens_stem

    got = spark.createDataFrame([("where is my money",)], "t string").select(expand_query(tokens_stem(F.col("t")))).first()[0]
    assert got[:1] == ["money"] and "refund" in got and got.count("refund") == 1


def test_chunk_headings(spark):
    from spendgrid.operators.chunking import chunk_headings

    text = "intro line\n\n# First\nbody 1\n## Second\nbody 2\n"
    out = chunk_headings(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("start_line").collect()
    assert [(r.heading, r.start_line, r.end_line) for r in out] == [("General", 1, 2), ("First", 3, 4), ("Second", 5, 6)]
    assert out[1].content == "# First\nbody 1"


def test_chunk_h2_and_code(spark):
    from spendgrid.operators.chunking import chunk_code, chunk_h2

    d = spark.createDataFrame([("p.md", "# Title\npre\n## A\na\n## B\nb"), ("q.md", "no headings here")], "doc_id string, text string")
    h2 = {(r.doc_id, r.heading): r.content for r in chunk_h2(d).collect()}
    assert h2 == {("p.md", "Title"): "# Title\npre", ("p.md", "A"): "## A\na", ("p.md", "B"): "## B\nb",
                  ("q.md", "q"): "no headings here"}
    c = spark.createDataFrame([(1, "import x\n\ndef f(a):\n  return a\nclass K(object):\n  pass")], "doc_id int, text string")
    assert [r.heading for r in chunk_code(c).orderBy("start_line").collect()] == ["modulo", "f", "K"]


def test_normalize_ascii(spark):
    from spendgrid.functions.text import normalize_ascii

    s = "July 11 – can’t​ stop"
    assert spark.createDataFrame([(s,)], "t string").select(normalize_ascii(F.col("t"))).first()[0] == "July 11 - can't stop"


def test_label_with_id(spark):
    from spendgrid.operators.catalog import label_with_id

    df = spark.createDataFrame([("Mega",), ("Alone",), ("nan",), (None,)], "pdc string")
    cat = spark.createDataFrame([("Mega", "4821.0"), ("Alone", "0")], "name string, id string")
    got = {r.pdc: r.label for r in label_with_id(df, "pdc", cat).collect()}
    assert got == {"Mega": "4821 · Mega", "Alone": "Alone", "nan": "Sin agrupar", None: "Sin agrupar"}


def test_learn_canonical(spark):
    from spendgrid.operators.catalog import learn_canonical

    a = spark.createDataFrame([("Gastos De Operación",), ("Renta",)], "g string")
    b = spark.createDataFrame([("Gastos de Operación",), ("RENTA",)], "g string")
    m = {r.value: r.canonical for r in learn_canonical([a, b], ["g"]).collect()}
    assert m["Gastos De Operación"] == "Gastos de Operación" and m["RENTA"] == "Renta"


def test_parse_notes_both_shapes(spark):
    from spendgrid.operators.support import parse_notes

    lines = ["stray note", "— Variaciones Negativas vs AA (YTD) —", "1. Renta (12.5 mdp) / (4.2%) · comment",
             "Mantenimiento | 12.5 | 4.2% | Higher spend"]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(lines)], "list_id string, pos int, text string")
    out = parse_notes(df).orderBy("pos").collect()
    assert out[0].section == "(sin sección)" and out[0].account == "stray note"
    assert (out[1].account, out[1].amount, out[1].pct, out[1].comment) == ("Renta", "(12.5mdp)", "(4.2%)", "comment")
    assert (out[2].account, out[2].amount, out[2].pct, out[2].section) == ("Mantenimiento", "12.5", "4.2%", "Variaciones Negativas vs AA (YTD)")


def test_score_answers_and_routes(spark):
    from spendgrid.operators.support import infer_route, score_answers

    g = spark.createDataFrame([("1", "tool", ["July 11"], ["waived"]), ("2", "policy", [], [])],
                              "id string, expected_route string, must_include array<string>, must_not_include array<string>")
    a = spark.createDataFrame([("1", "tool", "Due july 11, nothing WAIVED")], "id string, route string, answer string")
    s = {r.id: r for r in score_answers(g, a).collect()}
    assert s["1"].reasons == ["forbidden waived"] and not s["2"].passed and s["2"].reasons == ["missing answer"]
    log = spark.createDataFrame([("a", "search_policy"), ("a", "get_order"), ("b", "escalate"), ("c", "get_orders")], "id string, tool string")
    assert {r.id: r.route for r in infer_route(log).collect()} == {"a": "both", "b": "escalate", "c": "tool"}


def test_prefix_sum_matches_window(spark):
    from pyspark.sql.window import Window

    from spendgrid.functions.windows import prefix_sum

    rows = [("hot" if i % 3 else f"k{i % 5}", i, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, o int, v double")
    got = {(r.key, r.o): r.run for r in prefix_sum(df, ["key"], [F.col("o")], "v", "run", partitions=7).collect()}
    w = Window.partitionBy("key").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = {(r.key, r.o): r.run for r in df.withColumn("run", F.sum("v").over(w)).collect()}
    assert got == exp


def test_sequential_split(spark):
    from spendgrid.operators.ml import sequential_split

    df = spark.createDataFrame([(i,) for i in range(103)], "id int")
    out = sequential_split(df, ["id"], 0.2).collect()
    assert sorted(r.idx for r in out) == list(range(103))
    assert sum(r.split == "train" for r in out) == 103 - 21
    assert all((r.split == "train") == (r.id < 82) for r in out)


def test_dp_means_three_blobs(spark):
    import numpy as np

    from spendgrid.operators.cluster import dp_means

    rng = np.random.default_rng(0)
    centres = [(0, 0), (5, 5), (-4, 3)]
    pts = [(i, [float(c[0] + rng.normal(0, 0.3)), float(c[1] + rng.normal(0, 0.3))]) for i, c in enumerate(centres * 50)]
    df = spark.createDataFrame(pts, "id int, vec array<double>")
    assigned, hist = dp_means(df, lam=4.0, max_iter=20)
    blob = {i: i % 3 for i in range(150)}
    by_cluster = {}
    for r in assigned.collect():
        by_cluster.setdefault(r["cluster"], set()).add(blob[r["id"]])
    assert len(by_cluster) >= 3 and all(len(b) == 1 for b in by_cluster.values())  # pure clusters
    assert hist[-1] == len(by_cluster)


def test_classification_report_zero_division(spark):
    from spendgrid.operators.ml import classification_report

    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "label int, prediction int")
    r = {x["class"]: x for x in classification_report(df).collect()}
    assert r["0.0"]["precision"] == 0.0 and r["1.0"]["recall"] == 1.0 and abs(r["accuracy"]["f1"] - 2 / 3) < 1e-9


def test_double_ml_recovers_effect(spark):
    import numpy as np

    from spendgrid.operators.ml import double_ml

    rng = np.random.default_rng(1)
    n = 2000
    x = rng.normal(size=n)
    t = 0.8 * x + rng.normal(size=n)
    y = 1.0 * t + 2.0 * x + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "t": t, "x": x, "fold": np.arange(n) % 5}))
    tau = double_ml(df, "y", "t", ["x"], 5, "ols1").first()["tau"]
    assert abs(tau - 1.0) < 0.1


def test_cov_corr_pairs_with_gaps(spark):
    """Many assets, and dates on which some have no return: each pair uses its own common dates."""
    import numpy as np

    from spendgrid.operators import risk as RK

    rng = np.random.default_rng(3)
    data = {(d, a): float(rng.normal()) for d in range(40) for a in range(60) if rng.random() < 0.8}
    ret = spark.createDataFrame([(d, f"a{a}", v) for (d, a), v in data.items()], "date int, asset string, ret double")
    got = {(r.asset_i, r.asset_j): (r.cov, r.corr) for r in RK.cov_corr_matrix(ret, rounded=False).collect()}
    assert len(got) == 3600
    for i, j in ((0, 1), (5, 5), (59, 7)):
        days = [d for d in range(40) if (d, i) in data and (d, j) in data]
        x, y = [data[d, i] for d in days], [data[d, j] for d in days]
        cov, corr = np.cov(x, y, ddof=1)[0, 1], np.corrcoef(x, y)[0, 1]
        assert abs(got[f"a{i}", f"a{j}"][0] - cov) < 1e-12 and abs(got[f"a{i}", f"a{j}"][1] - corr) < 1e-12


def test_positions_and_running_sums_with_carried_columns(spark):
    """400,000 rows in many partitions: dropping or carrying columns changes no position or sum."""
    from pyspark.sql.window import Window

    from spendgrid.functions.windows import global_index, prefix_sum

    df = spark.range(400_000).select(
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("o"), (F.col("id") % 3).alias("key"), (F.col("id") % 7).alias("v"),
        F.concat(F.lit("carried "), F.col("id").cast("string")).alias("extra"), "id",
    )
    idx = global_index(df, ["o", "id"])
    for cols in (["idx"], ["idx", "extra"], ["idx", "o", "id"]):
        r = idx.select(*cols).agg(F.count("idx"), F.countDistinct("idx"), F.min("idx"), F.max("idx")).first()
        assert tuple(r) == (400_000, 400_000, 0, 399_999)
    assert idx.filter((F.col("idx") == 0)).select("o").first()[0] == df.agg(F.min("o")).first()[0]
    run = prefix_sum(df, ["key"], [F.col("o"), F.col("id")], "v", "run", partitions=13)
    w = Window.partitionBy("key").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("want", F.sum("v").over(w)).select("id", "want")
    for cols in (["id", "run"], ["id", "run", "extra"]):
        j = run.select(*cols).join(want, "id")
        assert j.count() == 400_000 and j.filter(F.col("run") != F.col("want")).count() == 0


def test_exact_percentiles_per_group(spark):
    from spendgrid.functions.windows import exact_percentiles

    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("x")).union(spark.sql("SELECT 7L, cast(NULL AS double)"))
    df = spark.createDataFrame(df.collect(), "g bigint, x double")  # the random values once
    got = {r.g: (r.a, r.b) for r in exact_percentiles(df, ["g"], "x", {"a": 0.05, "b": 0.5}).collect()}
    want = df.groupBy("g").agg(F.percentile("x", F.lit(0.05)).alias("a"), F.percentile("x", F.lit(0.5)).alias("b")).filter("a IS NOT NULL")
    assert got.keys() == {0, 1, 2}
    for r in want.collect():
        assert abs(got[r.g][0] - r.a) < 1e-12 and abs(got[r.g][1] - r.b) < 1e-12


def test_lasso_cv_recovers_sparse_signal(spark):
    import numpy as np

    from spendgrid.operators.ml import double_ml, naive_lasso, sparse_fit

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 12))
    y = 3 * x[:, 2] - 2 * x[:, 7] + 0.01 * rng.normal(size=400)
    xs = [f"x{i}" for i in range(12)]
    df = spark.createDataFrame([(*map(float, r), float(t), i % 5) for i, (r, t) in enumerate(zip(x, y))], [*xs, "y", "fold"])
    w = sparse_fit(df, "y", xs)
    assert abs(w[2] - 3) < 0.02 and abs(w[7] + 2) < 0.02 and np.abs(np.delete(w, [2, 7])).max() < 0.02
    assert abs(naive_lasso(df, "y", "x2", ["x7", "x1"]).first().lasso_t - 3) < 0.05
    tau = double_ml(df, "y", "x2", ["x7", "x1"], 5, "lasso").first()
    assert abs(tau.tau - 3) < 0.02 and tau.ci_lo < 3.01 and tau.ci_hi > 2.99


def test_double_ml_refuses_unknown_and_many_covariates(spark):
    import pytest

    from spendgrid.operators.ml import double_ml

    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0)], "y double, t double, a double, b double, fold int")
    for xs, nuisance in ((["a"], "boosted"), (["a", "b"], "ols1")):
        with pytest.raises(ValueError):
            double_ml(df, "y", "t", xs, 1, nuisance)


def test_best_cut_uses_every_edge(spark):
    import pytest

    from spendgrid.operators.graphcut import best_cut

    square = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)], "i bigint, j bigint")
    assert best_cut(spark, square).first().best_cut == 4
    with pytest.raises(ValueError):
        best_cut(spark, spark.createDataFrame([(0, 90)], "i bigint, j bigint"))


def test_dp_means_raises_when_it_cannot_converge(spark):
    import pytest

    from spendgrid.operators.cluster import dp_means

    pts = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(12)], "id bigint, vec array<double>")
    with pytest.raises(RuntimeError):
        dp_means(pts, 0.01, max_iter=3)
    assigned, history = dp_means(pts, 0.01)
    assert history[-1] == 12 == assigned.select("cluster").distinct().count()


def test_snapshot_cache_rebuilds_when_a_source_is_newer(spark, tmp_path):
    import os

    from spendgrid.operators.snapshots import cached_aggregate

    src, target, built = str(tmp_path / "src"), str(tmp_path / "t"), []
    spark.range(3).write.parquet(src)

    def build():
        built.append(1)
        return spark.read.parquet(src).agg(F.sum("id").alias("s"))

    for _ in range(2):
        assert cached_aggregate(build, [src], target, spark).first().s == 3
    assert len(built) == 1
    later = max(os.stat(os.path.join(target, f)).st_mtime for f in os.listdir(target)) + 10
    for f in os.listdir(src):
        os.utime(os.path.join(src, f), (later, later))
    cached_aggregate(build, [src], target, spark)
    assert len(built) == 2


def test_best_cut_against_every_assignment(spark):
    """Sparse and dense graphs of up to 12 nodes, nodes without edges, repeated and reversed edges, self loops."""
    import random

    from spendgrid.operators.graphcut import best_cut

    rng = random.Random(2)
    for n, p in ((2, 1.0), (7, 0.3), (10, 0.6), (12, 1.0)):
        edges = [(i, j) for i in range(n) for j in range(i) if rng.random() < p] or [(1, 0)]
        n = max(max(e) for e in edges) + 1
        rows = edges + [(j, i) for i, j in edges[:2]] + [(0, 0)]
        cuts = [sum((a >> i ^ a >> j) & 1 for i, j in edges) for a in range(1 << n)]
        got = best_cut(spark, spark.createDataFrame(rows, "i bigint, j bigint")).first()
        assert (got.best_cut, got.n_optimal, got.first_optimal) == (max(cuts), cuts.count(max(cuts)), cuts.index(max(cuts)))
    assert tuple(best_cut(spark, spark.createDataFrame([], "i bigint, j bigint")).first()) == (0, 1, 0)


def test_dp_means_is_a_fixed_point_whatever_the_partitions(spark):
    """Every point lies within lambda of its nearest centre, centres are means, and the choice of new ones
    does not depend on how points are spread; hundreds of clusters take few passes."""
    import numpy as np

    from spendgrid.operators.cluster import dp_means

    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))[rng.integers(0, 60, 900)] * 3 + 0.3 * rng.standard_normal((900, 8))
    x[:20] = x[20:40]  # ties
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, vec array<double>")
    runs = [dp_means(df.repartition(n), 4.0) for n in (1, 5)]
    (one, h1), (two, h2) = [(sorted(map(tuple, a.collect())), h) for a, h in runs]
    assert [r[:2] for r in one] == [r[:2] for r in two] and h1 == h2
    assert 40 <= h1[-1] <= 70 and len(h1) < 25
    own = np.array([c for _, c, _ in one])
    centres = np.array([x[own == c].mean(axis=0) for c in range(own.max() + 1)])
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (d.argmin(axis=1) == own).mean() > 0.99 and max(r[2] for r in one) <= 4.0
    assert dp_means(df.limit(0), 1.0)[1] == [0]


def test_new_centres_lie_beyond_lambda_of_each_other():
    from spendgrid.operators.cluster import _opened

    far = [(9.0, -1, [0.0, 0.0]), (8.0, -2, [0.5, 0.0]), (7.0, -3, [3.0, 0.0]), (6.0, -4, [0.0, 3.0])]
    assert _opened(far, 1.0, 10) == [[0.0, 0.0], [3.0, 0.0], [0.0, 3.0]]
    assert _opened(far, 1.0, 2) == [[0.0, 0.0], [3.0, 0.0]]


def test_dp_means_passes_go_on_until_it_has_converged(spark):
    """No number of passes ends a run that nobody limits; before, 200 did."""
    import inspect

    from spendgrid.operators.cluster import dp_means

    assert inspect.signature(dp_means).parameters["max_iter"].default is None
    pts = spark.createDataFrame([(i, [float(i % 40), 0.0]) for i in range(80)], "id bigint, vec array<double>")
    assigned, history = dp_means(pts, 9.0)
    assert history[-1] == assigned.select("cluster").distinct().count() and assigned.filter("dmin > 9").count() == 0


def test_forest_rows_are_spread_whatever_the_files(spark, monkeypatch):
    """Rows of one partition are fitted by several tasks; every row stays."""
    from spendgrid.operators import ml as ML

    monkeypatch.setattr(ML, "FOREST_ROWS", 100)
    df = spark.range(0, 950, 1, 1).selectExpr("id", "id * 1.0 AS x")
    out = ML._spread(df)
    assert len(out.inputFiles()) == 10 and out.agg(F.sum("id"), F.count("x")).first()[:] == (950 * 949 // 2, 950)


def test_credit_features_scale_in_one_pass(spark):
    """All means and deviations come from one scalar subquery, not two a column."""
    from spendgrid.operators.ml import credit_features

    df = spark.createDataFrame([(i, "ab"[i % 2], float(i), float(i * i), 3.0) for i in range(8)], "id int, c string, x double, y double, z double")
    out = credit_features(df, ["c"], ["x", "y", "z"])
    plan = out._jdf.queryExecution().executedPlan()
    assert len(set(__import__("re").findall(r"Subquery scalar-subquery#(\d+)", plan.toString()))) <= 1 and out.filter("z_z <> 0").count() == 0
    assert out.selectExpr("round(avg(z_x), 9)", "round(stddev_pop(z_y), 9)").first()[:] == (0.0, 1.0)
