"""The registered queries: names, and SQL twins where there are any."""

import pytest

import __spark_entry__ as entry
from spendgrid.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple("None" if v is None or v != v else str(v) for v in r) for r in want[cols].astype(object).itertuples(index=False))


def test_numbers_of_a_table_in_files_and_of_any_other(spark, tmp_path, monkeypatch):
    """Read from files, a row has its place in them, without a copy; anything else is written with numbers."""
    from spendgrid.llm.common import numbered

    spark.range(1000).selectExpr("id", "id % 3 AS _row", "'x' AS `a.b`").repartition(7).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    exploded = read.selectExpr("*", "explode(array(1, 2)) AS e")
    monkeypatch.setattr("spendgrid.llm.common.MAX_FILES", 7)
    for df, rows, copied in ((read, 1000, False), (exploded, 2000, True), (read.filter("id < 10"), 10, True), (spark.range(5), 5, True)):
        out, number = numbered(df, "number-test")
        assert out.columns == [*df.columns, number] and number not in df.columns
        assert out.select(number).distinct().count() == out.count() == rows
        assert any("number-test" in f for f in out.inputFiles()) == copied
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) != copied and "SortMergeJoin" not in plan  # rows stay where they lie
        first, again = (sorted(map(str, x.collect())) for x in (out, out.repartition(3).coalesce(1)))
        assert first == again
