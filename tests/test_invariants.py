"""Invariants over the driver tables (sf0.001): tree levels add up, allocation sums to
the account forecast, two grains give the same roll-up, and plans stay in the JVM."""

from pyspark.sql import functions as F

from spendgrid.functions.measures import Period
from spendgrid.operators import forecast as FC
from spendgrid.operators import rollup as R
from spendgrid.plans import bindings as B

SF_SMALL = "/root/testdata/sf0.001"


def test_tree_children_sum_to_parent(spark):
    facts = B.facts(spark, SF_SMALL)
    t = R.rollup_tree(facts, ["agrupa1", "division"], Period(1, 53, "range"), smr=B.SMR)
    lvl = {r.level: r for r in t.groupBy("level").agg(F.sum("plan").alias("plan")).collect()}
    # P6 drops immaterial rows; with the full year every group is material here
    assert abs(lvl[1].plan - lvl[0].plan) < 0.05 and abs(lvl[2].plan - lvl[0].plan) < 0.05


def test_allocation_sums_to_account_forecast(spark):
    facts = B.facts(spark, SF_SMALL)
    fc = B.forecast_by_account_id(spark, SF_SMALL)
    alloc = FC.allocate_forecast(facts, fc, ["agrupa1", "division"], Period(1, 30), B.SMR)
    matched = fc.join(facts.select("account_id").distinct(), "account_id").filter("sem <= 30")
    total = float(matched.agg(F.sum("forecast")).first()[0])
    assert abs(alloc.agg(F.sum("forecast_alloc")).first()[0] - total) < 1e-4 * max(1.0, abs(total))


def test_same_answer_from_two_grains(spark):
    from spendgrid.operators.grains import build_grains

    leaf = B.facts(spark, SF_SMALL)
    g = build_grains(leaf, {"pdc": ["agrupa1", "division", "territorio", "pdc"]})["pdc"]
    a = sorted(tuple(r) for r in R.rollup_variance(leaf, "division", Period(1, 30), smr=B.SMR).collect())
    b = sorted(tuple(r) for r in R.rollup_variance(g, "division", Period(1, 30), smr=B.SMR).collect())
    assert a == b


def _recorded_plans(monkeypatch, build):
    """Executed plans of what ``build`` stores on the way, and of its result."""
    from spendgrid.functions import measures

    plans, store = [], measures.stored

    def recording(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    for module in (measures, R):
        monkeypatch.setattr(module, "stored", recording)
    df = build()
    df.collect()
    return [*plans, df._jdf.queryExecution().executedPlan().toString()]


def test_flagship_plan_is_jvm_only_and_pushed_down(spark, monkeypatch):
    plans = _recorded_plans(monkeypatch, lambda: R.rollup_variance(B.facts(spark, SF_SMALL), "division", Period(1, 30), smr=B.SMR))
    assert not any("Python" in p or "ArrowEval" in p for p in plans)
    assert "GreaterThanOrEqual(o_orderdate" in plans[0]  # the year filter reaches the orders scan


def test_roll_ups_scan_the_facts_once(spark, monkeypatch):
    hier = ["agrupa1", "division", "territorio", "zona", "region", "pdc"]
    for build in (
        lambda: R.rollup_variance(B.facts(spark, SF_SMALL), "division", Period(1, 30), smr=B.SMR),
        lambda: R.rollup_tree(B.facts(spark, SF_SMALL), hier, Period(1, 30), smr=B.SMR),
        lambda: R.quarter_matrix(B.facts(spark, SF_SMALL), ["division"], smr=B.SMR),
    ):
        plans = _recorded_plans(monkeypatch, build)
        final = plans[-1].split("== Initial Plan ==")[0]
        assert sum(p.count("lineitem.parquet") for p in [*plans[:-1], final]) == 1


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and "sort_key" in df.columns


def test_query_terms_are_broadcast_only_while_small(spark):
    from spendgrid.operators import chunking as CH
    from spendgrid.operators import retrieval as RV

    idx = RV.bm25_index(RV.chunk_key(CH.chunk_h2(B.corpus(spark, SF_SMALL, "## "))))

    def plan():
        return RV.search_bm25(B.passages(spark, SF_SMALL), idx, 3)._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan() and "Python" not in plan() and "CartesianProduct" not in plan()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "BroadcastHashJoin" not in plan()  # beyond the session's bound both sides are shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_flagship_cross_join_is_the_one_row_total(spark):
    df = R.rollup_variance(B.facts(spark, SF_SMALL), "division", Period(1, 30), smr=B.SMR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") <= 1 and "CartesianProduct" not in plan


def test_queries_load_when_pyspark_comes_from_its_zip():
    import os
    import subprocess
    import sys

    import pyspark

    zipped = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib", "pyspark.zip")
    if not os.path.exists(zipped):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path[:0] = [{zipped!r}, {root!r}]; import pyspark, __spark_entry__ as e; print(pyspark.__file__); print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/tmp", timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "pyspark.zip" in out.stdout and int(out.stdout.split()[-2]) >= 135


def test_a_cluster_session_needs_a_shared_checkpoint_folder():
    import pytest

    from spendgrid.session import checkpoint_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_scratch_tables_share_a_folder_that_can_be_cleared(spark, tmp_path):
    import os

    from spendgrid import session

    a, b = session.scratch_path(spark, "a"), session.scratch_path(spark, "b")
    assert os.path.dirname(a) == os.path.dirname(b) and a != b
    root = session._scratch_root
    session._scratch_root = lambda _: str(tmp_path / "tables")  # not the folder that other tests still read
    try:
        assert session.stored(spark.range(5), "five").count() == 5
        assert len(os.listdir(tmp_path / "tables")) == 1
        session.clear_scratch(spark)
        assert not (tmp_path / "tables").exists()
    finally:
        session._scratch_root = root
