"""Known answers from the source's notes and notebooks."""

from pyspark.sql import functions as F

from spendgrid.functions.calendar import split_weeks, week_calendar


def _days(cal, sem, month):
    r = cal.filter((F.col("sem") == sem) & (F.col("month") == month)).select("days").collect()
    return r[0][0] if r else 0


def test_calendar_2026(spark):
    cal = week_calendar(spark, 2026)
    assert _days(cal, 1, 1) == 3
    assert _days(cal, 27, 6) == 3 and _days(cal, 27, 7) == 4
    assert _days(cal, 53, 12) == 5
    assert cal.agg(F.sum("days")).first()[0] == 365
    assert split_weeks(cal).select("sem").distinct().count() == 8


def test_calendar_2025(spark):
    cal = week_calendar(spark, 2025)
    assert _days(cal, 1, 1) == 4
    assert _days(cal, 53, 12) == 4
    assert cal.agg(F.sum("days")).first()[0] == 365
    assert split_weeks(cal).select("sem").distinct().count() == 10


def test_calendar_same_as_1997_1998(spark):
    """The binding's years share the anchor weekday of 2025/2026."""
    for a, b in ((1997, 2025), (1998, 2026)):
        x = sorted(tuple(r) for r in week_calendar(spark, a).select("sem", "month", "days").collect())
        y = sorted(tuple(r) for r in week_calendar(spark, b).select("sem", "month", "days").collect())
        assert x == y


def test_auction(spark):
    from spendgrid.operators.alloc import allocate_by_bid, auction_prices

    bids = spark.createDataFrame([("a", i, float(b)) for i, b in enumerate([50, 40, 30, 20])], "auction string, agent int, bid double")
    tot = spark.createDataFrame([("a", 100.0)], "auction string, total double")
    out = {r["agent"]: r for r in auction_prices(allocate_by_bid(bids, tot)).collect()}
    assert [out[i]["alloc"] for i in range(4)] == [50.0, 40.0, 10.0, 0.0]
    assert [out[i]["price"] for i in range(4)] == [40.0, 50.0, 50.0, 0.0]
    assert out[0]["welfare"] == 100.0


def test_best_cut(spark):
    from spendgrid.operators.graphcut import best_cut

    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)], "i int, j int")
    assert best_cut(spark, e).first()["best_cut"] == 4


def test_mrr_ndcg(spark):
    from spendgrid.operators.retrieval import mrr, ndcg

    lists = {1: [1, 1, 1, 0, 0], 2: [1, 0, 1, 0, 1], 3: [0, 0, 1, 1, 1]}
    rows = [(q, i + 1, r) for q, rel in lists.items() for i, r in enumerate(rel)]
    df = spark.createDataFrame(rows, "qid int, rank int, rel int")
    m = {r["qid"]: r["mrr"] for r in mrr(df).collect()}
    assert m == {1: 1.0, 2: 1.0, 3: round(1 / 3, 9)}
    n = {r["qid"]: r["ndcg"] for r in ndcg(df, 5).collect()}
    assert n[1] == 1.0 and 0 < n[3] < n[2] < 1


def test_authorisation(spark):
    """Wrong owner, unknown order and unknown user give the same 'not found' row."""
    from spendgrid.operators.support import lookup_order

    orders = spark.createDataFrame(
        [("u001", "ord_3001", "Acme", "active", 10.0), ("u002", "ord_3005", "Beta", "active", 5.0)],
        "user_id string, order_id string, merchant string, status string, total double",
    )
    req = spark.createDataFrame(
        [("u001", "ord_3005"), ("u001", "ord_99999"), ("u9999", "ord_3001"), ("u001", "ord_3001")], "user_id string, order_id string"
    )
    res = {(r["user_id"], r["order_id"]): r["result"] for r in lookup_order(req, orders).collect()}
    assert res == {("u001", "ord_3005"): "not found", ("u001", "ord_99999"): "not found",
                   ("u9999", "ord_3001"): "not found", ("u001", "ord_3001"): "found"}
