"""Pinned semantics on hand-made fixtures where the driver's synthetic text gives few hits:
question parsing and routing, entity detection, forecast allocation cases, result order."""

from decimal import Decimal

from pyspark.sql import functions as F


def test_parse_questions(spark):
    from spendgrid.operators.questions import parse_questions

    q = spark.createDataFrame(
        [("1", "Gasto acumulado a la semana 12 del CECO 4567, por semana"), ("2", "Semana 77 en la División Norte"),
         ("3", "  ¿Cuánto lleva el Centro de Costos #123456?  ")],
        "id string, question string",
    )
    r = {x.id: x for x in parse_questions(q, "question", 30).collect()}
    assert (r["1"].cut, r["1"].cumulative, r["1"].weekly, r["1"].centre_id) == (12, True, True, "4567")
    assert (r["2"].cut, r["2"].cumulative, r["2"].centre_id) == (30, False, None)  # week out of 1..53
    assert r["3"].centre_id == "123456" and r["3"].folded.startswith("¿cuanto")


def test_detect_entities_and_route(spark):
    from spendgrid.operators.questions import detect_entities, parse_questions, route_column

    q = spark.createDataFrame(
        [("a", "gasto de la division norte en renta"), ("b", "cuanto gasto el territorio bajio"),
         ("c", "pago de sueldos"), ("d", "hola"), ("e", "mapeo de cecos")],
        "id string, question string",
    )
    p = parse_questions(q, "question", 30)
    divs = spark.createDataFrame([("Division Norte",), ("Division Sur",)], "division string")
    ters = spark.createDataFrame([("Territorio Bajío",)], "territorio string")
    grps = spark.createDataFrame([("Renta y Luz",), ("Nómina",)], "grupo string")
    e = detect_entities(p, divs, ters, grps).withColumn("route", route_column())
    r = {x.id: x for x in e.collect()}
    assert (r["a"].division, r["a"].grupo, r["a"].route) == ("Division Norte", "Renta y Luz", "division")
    assert (r["b"].territory, r["b"].route) == ("Territorio Bajío", "territory")
    assert (r["c"].grupo, r["c"].route) == ("Nómina", "group")  # through the synonym list
    assert r["d"].route == "general" and r["e"].route == "match"


def test_allocation_cases(spark):
    """One account in one group (kept whole); one in three groups with mixed signs (by
    |actual| share); one with no actual (equal split); an id with no match (dropped)."""
    from spendgrid.functions.measures import Period
    from spendgrid.operators.forecast import allocate_forecast

    D = lambda x: Decimal(str(x))
    facts = spark.createDataFrame(
        [("solo", "g1", 1, D(0), D(10), D(0), D(5)),
         ("multi", "g1", 1, D(0), D(10), D(0), D(30)),
         ("multi", "g2", 1, D(0), D(10), D(0), D(-10)),
         ("multi", "g3", 1, D(0), D(10), D(0), D(0)),
         ("zero", "g1", 1, D(0), D(10), D(0), D(0)),
         ("zero", "g2", 1, D(0), D(10), D(0), D(0))],
        "account_id string, grp string, sem int, real_py decimal(18,5), plan decimal(18,5), new_plan decimal(18,5), real decimal(18,5)",
    )
    fc = spark.createDataFrame([("solo", 1, D(100)), ("multi", 1, D(80)), ("zero", 1, D(50)), ("ghost", 1, D(999))],
                               "account_id string, sem int, forecast decimal(18,5)")
    a = {r.grp: r.forecast_alloc for r in allocate_forecast(facts, fc, ["grp"], Period(1, 30), 30).collect()}
    assert abs(a["g1"] - (100 + 80 * 30 / 40 + 25)) < 1e-9
    assert abs(a["g2"] - (80 * 10 / 40 + 25)) < 1e-9
    assert abs(a["g3"] - 0.0) < 1e-9


def test_order_result(spark):
    from spendgrid.operators.rollup import order_result

    df = spark.createDataFrame([("Otros", 1.0), ("Zeta", 5.0), ("Division Sur", -9.0), ("Division Norte", 2.0), ("Alfa", 0.0)],
                               "division string, real double")
    got = [r.division for r in order_result(df, ["division"]).collect()]
    assert got == ["Division Norte", "Division Sur", "Otros", "Alfa", "Zeta"]
    g = spark.createDataFrame([("B", 1.0), ("A", 2.0), ("C", 3.0)], "grupo string, real double")
    cat = spark.createDataFrame([("C", 1), ("B", 2)], "group string, ord int")
    assert [r.grupo for r in order_result(g, ["grupo"], cat).collect()] == ["C", "B", "A"]  # A has no order: 999
    other = spark.createDataFrame([("x", 1.0), ("y", -5.0), ("z", 3.0)], "pdc string, real double")
    assert [r.pdc for r in order_result(other, ["pdc"]).collect()] == ["y", "z", "x"]


def test_months_weight(spark):
    """Months mode: each measure uses its own year's day fractions (1997 vs 1998 Jan)."""
    from spendgrid.functions.measures import Period, sum_weighted, weighted

    D = lambda x: Decimal(str(x))
    f = spark.createDataFrame([(1, D(7), D(7), D(7), D(7))],
                              "sem int, real_py decimal(18,5), plan decimal(18,5), new_plan decimal(18,5), real decimal(18,5)")
    s = weighted(f, Period(mode="months", months=(1,)), 30).agg(*sum_weighted()).first()
    # week 1: 4 January days in 1997 (as in 2025), 3 in 1998 (as in 2026); sums are x7
    assert float(s.s_real_py) / 7 == 4.0 and float(s.s_plan) / 7 == 3.0 and float(s.s_real) / 7 == 3.0


def test_credit_features_unknown_level_and_population_sd(spark):
    from spendgrid.operators.ml import credit_features

    train = spark.createDataFrame([(1, "a", 1.0), (2, "b", 3.0), (3, "c", 5.0)], "id int, cat string, x double")
    test = spark.createDataFrame([(9, "zzz", 3.0), (8, "b", 5.0)], "id int, cat string, x double")
    f = {r.id: r for r in credit_features(train, ["cat"], ["x"], apply_to=test, key="id").collect()}
    # first level 'a' dropped; an unseen level gives all zeros; sd is the population sd (sqrt(8/3))
    assert (f[9]["cat=b"], f[9]["cat=c"], f[9]["z_x"]) == (0.0, 0.0, 0.0)
    assert f[8]["cat=b"] == 1.0 and abs(f[8]["z_x"] - 2.0 / (8.0 / 3.0) ** 0.5) < 1e-12


def test_monthly_null_rule_and_quarterly_forecast(spark):
    from spendgrid.operators.rollup import monthly, quarterly

    rows = [(s, 7.0, 7.0, 7.0, 7.0 if s <= 30 else None) for s in range(1, 54)]
    wk = spark.createDataFrame(rows, "sem int, real_py double, plan double, new_plan double, real double")
    m = {r.month: r for r in monthly(wk).collect()}
    assert m[12].real is None and m[1].real is not None  # no non-null week in December -> null, not 0
    assert abs(sum(r.plan for r in m.values()) - 365.0) < 1e-9  # 7 per week x 365 days / 7
    q = {r.quarter: r for r in quarterly(wk.filter("sem <= 39"), smr=30).collect()}
    assert set(q) == {"Q1", "Q2", "Q3"}
    assert all(r.forecast_ye == 30 * 7.0 + 9 * 7.0 for r in q.values())  # actual to week 30 + plan after


def test_bm25_empty_query_and_ranking(spark):
    from spendgrid.operators.retrieval import bm25_index, chunk_key, search_bm25

    chunks = spark.createDataFrame(
        [(1, 1, "Refunds", "refund timeline for returns"), (1, 5, "Fees", "late fee policy"), (2, 1, "Cards", "virtual card setup")],
        "doc_id int, start_line int, heading string, content string",
    )
    q = spark.createDataFrame([(1, "where is my money"), (2, "the and of")], "qid int, text string")
    r = search_bm25(q, bm25_index(chunk_key(chunks)), 2).orderBy("qid", "rank").collect()
    hits1 = [(x.doc_id, x.start_line) for x in r if x.qid == 1]
    assert hits1[0] == (1, 1)  # 'money' expands to refund/return -> the refunds chunk first
    # only stop words: no usable token -> the first k chunks in corpus order, score 0
    assert [(x.doc_id, x.start_line, x.score) for x in r if x.qid == 2] == [(1, 1, 0.0), (1, 5, 0.0)]


def test_read_jsonl_last_wins(spark):
    import os

    from pyspark.sql import types as T

    from spendgrid.operators.support import read_jsonl
    from spendgrid.session import scratch_path

    d = scratch_path(spark, "jsonl-test")
    local = d.replace("file:", "", 1)  # the test writes the fixture files with plain Python
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "a.jsonl"), "w") as f:
        f.write('{"id": "1", "v": "old"}\n\n{"id": "2", "v": "only"}\n{"id": "1", "v": "mid"}\n')
    with open(os.path.join(local, "b.jsonl"), "w") as f:
        f.write('\n{"id": "1", "v": "new"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])
    got = {r.id: r.v for r in read_jsonl(spark, d, schema).collect()}
    assert got == {"1": "new", "2": "only"}


def test_quotes_follow_each_other(spark):
    """A term that the first quote shows is not quoted again; at most two quotes, joined as sentences."""
    import datetime

    from spendgrid.operators.support import guard_answers

    answers = spark.createDataFrame([("a", "policy", "You can return it"), ("b", "policy", "It takes 30 days!"), ("c", "policy", "Hello.")], "id string, route string, answer string")
    decisions = spark.createDataFrame([("c", True, "fraud", "hacked", ["password"])], "id string, forced_escalate boolean, category string, matched_phrase string, extra_required array<string>")
    text = "Refunds take 30 days. Returns within 30 days are free. There is no fee. We pause plans."
    hits = spark.createDataFrame([(i, 1, "POLICY", text) for i in "abc"], "id string, rank int, doc string, text string")
    due = spark.createDataFrame([("b", datetime.date(2026, 7, 11)), ("b", datetime.date(2026, 8, 1))], "id string, due_date date")
    got = {r.id: r for r in guard_answers(answers, decisions, hits, due).collect()}
    assert got["a"].answer == 'You can return it. Per POLICY: "Refunds take 30 days.". Per POLICY: "There is no fee."'
    assert got["b"].answer == (
        'It takes 30 days! Per POLICY: "There is no fee.". Per POLICY: "We pause plans.". '
        "(Actual due date on file: 2026-07-11, July 11.) (Actual due date on file: 2026-08-01, August 1.)"
    )
    assert got["c"].route == "escalate" and "Per POLICY" not in got["c"].answer
    assert got["c"].answer.endswith("please change your password and enable 2FA right away.")


def test_missing_route_fails_the_route_check(spark):
    from spendgrid.operators.support import score_answers

    g = spark.createDataFrame([("1", "policy", ["ok"], ["bad"])], "id string, expected_route string, must_include array<string>, must_not_include array<string>")
    a = spark.createDataFrame([("1", None, "ok")], "id string, route string, answer string")
    r = score_answers(g, a).first()
    assert not r.passed and r.reasons == ["route "]


def test_first_order_of_the_document_wins(spark):
    from spendgrid.operators.support import match_merchant, read_order_docs

    q = spark.createDataFrame([("q", "u1", "Where is my refund from Blue Shop?"), ("r", "u2", "Blue Shop?"), ("s", "u1", "no name")], "id string, user_id string, question string")
    o = spark.createDataFrame([("u1", "ord_9", 0, "Blue Shop"), ("u1", "ord_10", 1, "blue shop"), ("u2", "ord_1", 0, "Red")], "user_id string, order_id string, pos int, merchant string")
    assert [(r.id, r.order_id) for r in match_merchant(q, o).collect()] == [("q", "ord_9")]
    assert read_order_docs  # its orders carry the place in the document


def test_pick_grain_by_size_and_account_fallback(spark, tmp_path):
    import pytest

    from spendgrid.operators.grains import pick_grain

    small, large = str(tmp_path / "s"), str(tmp_path / "l")
    spark.range(10).selectExpr("id AS sem", "id AS division", "id AS a", "id AS b").write.parquet(small)
    spark.range(100_000).selectExpr("id AS sem", "id AS division").write.parquet(large)
    grains = {"few_rows": spark.read.parquet(small), "few_columns": spark.read.parquet(large)}
    assert pick_grain(["sem", "division"], grains)[0] == "few_rows"
    old = {"pdc": spark.read.parquet(large), "cuentas": spark.read.parquet(small)}
    assert pick_grain(["sem", "division"], old, alias="zona")[0] == "pdc"
    assert pick_grain(["sem", "a"], old, alias="zona")[0] == "cuentas"  # the point grain lacks the account column
    with pytest.raises(KeyError):
        pick_grain(["sem", "c"], old, alias="zona")


def test_containing_matches_any_pattern_length(spark):
    from spendgrid.functions.matching import containing

    q = spark.createDataFrame([(1, "a refund was pushed"), (2, "xy"), (3, None), (4, "")], "id int, t string")
    p = spark.createDataFrame([("refund",), ("was p",), ("xy",), ("x",), ("",), (None,), ("pushed!",)], "pat string")
    got = sorted((r.id, r.pat) for r in containing(q, "id", "t", p, "pat").collect())
    assert got == [(1, "refund"), (1, "was p"), (2, "x"), (2, "xy")]
    assert containing(q, "id", "t", p.limit(0), "pat").collect() == []


def test_stream_keeps_the_first_copy_of_an_id(spark, tmp_path):
    import datetime

    from spendgrid.streaming.cases import stream_cases

    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    hints = spark.createDataFrame([("fraud", 0, "hacked", ["password"])], "category string, cat_order int, hint string, extra array<string>")
    orders = spark.createDataFrame([("u1", "ord_1", 0, "Blue Shop", "active", 5)], "user_id string, order_id string, pos int, merchant string, status string, total int")
    inst = spark.createDataFrame([("u1", "ord_1", 1, 2, datetime.date(2026, 7, 1), "upcoming")], "user_id string, order_id string, installment int, amount int, due_date date, status string")
    search = lambda q: q.selectExpr("qid", "'P1' AS doc")
    schema = "id string, user_id string, question string"

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{src}/{name}")
        return {r.id: r for r in stream_cases(spark, src + "/*", out, ckpt, hints, orders, inst, search, schema).collect()}

    got = run("a", [("1", "u1", "refund from Blue Shop"), ("2", "u2", "I was hacked")])
    assert (got["1"].order_id, got["1"].order_result, str(got["1"].next_due), got["1"].policy_doc) == ("ord_1", "found", "2026-07-01", "P1")
    assert got["2"].forced_escalate and got["2"].order_id is None
    got = run("b", [("1", "u1", "sent again"), ("3", "u1", "new")])
    assert len(got) == 3 and got["1"].question == "refund from Blue Shop"


def test_jsonl_keeps_the_last_line_over_files_and_splits(spark, tmp_path):
    from pyspark.sql import types as T

    from spendgrid.operators.support import read_jsonl

    lines = [f'{{"id": "{i % 500}", "v": "{i}"}}' for i in range(40_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "b.jsonl").write_text('{"id": "7", "v": "last"}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])
        got = {r.id: r.v for r in read_jsonl(spark, str(tmp_path / "*.jsonl"), schema).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 500 and got["7"] == "last" and got["8"] == str(40_000 - 500 + 8)


def test_text_corpus_skips_ignored_folders(spark, tmp_path):
    from spendgrid.sources.io import read_text_corpus

    for name, text in (("a.md", b"one"), ("x/b.py", b"two\xff!"), ("x/c.txt", b"no"), (".git/d.md", b"no"), ("x/__pycache__/e.py", b"no")):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text)
    got = sorted((r.path, r.text) for r in read_text_corpus(spark, str(tmp_path)).collect())
    assert got == [("a.md", "one"), ("x/b.py", "two!")]
    assert read_text_corpus(spark, str(tmp_path / "x" / "__pycache__"), exts=(".md",)).collect() == []


def test_coarse_grains_come_from_written_finer_ones(spark, tmp_path):
    from spendgrid.functions.measures import MEASURES
    from spendgrid.operators import grains as G

    rows = [(1 + i % 3, f"d{i % 2}", f"t{i % 4}", *[i + k for k in range(4)]) for i in range(40)]
    leaf = spark.createDataFrame(rows, "sem int, division string, territorio string, " + ", ".join(f"{m} int" for m in MEASURES))
    read, build = [], G.build_grains
    G.build_grains = lambda source, spec, helpers=None: (read.append(source), build(source, spec, helpers))[1]
    try:
        paths = G.write_grains(leaf, {"division": ["division"], "territorio": ["division", "territorio"]}, str(tmp_path))
    finally:
        G.build_grains = build
    assert [s is leaf for s in read] == [True, False]
    got = {(r.sem, r.division): r.plan for r in spark.read.parquet(paths["division"]).collect()}
    assert got == {(r.sem, r.division): r.plan for r in build(leaf, {"x": ["division"]})["x"].collect()}
