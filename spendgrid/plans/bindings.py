"""Bindings: derive each operator's input shape from the driver's tables.

These only reshape rows into the schema an operator expects; the operators do the
work. Every binding reads whole tables, so its size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrid.functions.calendar import fiscal_week
from spendgrid.functions.measures import MONEY_TYPE
from spendgrid.session import stored

PRIOR_YEAR = 1997
CURRENT_YEAR = 1998
SMR = 30  # last closed week of the current year


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str, prior: int = PRIOR_YEAR, current: int = CURRENT_YEAR, smr: int = SMR) -> DataFrame:
    """V1: wide weekly fact, one row per line item of an order placed in the two compared years.

    Dimensions: agrupa1=region, division=nation, territorio=market segment,
    zona and region by customer key, pdc=customer name, grupo=brand, cuenta=type, account_id=brand/type,
    centre=customer key. Measures (DECIMAL): real_py = net price in ``prior``,
    plan = gross price, new_plan = gross*(1-disc/2) and real = net price up to week ``smr``
    in ``current``.
    """
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount")
    o = t("orders").filter(
        F.year("o_orderdate").isin(prior, current)
        & (F.col("o_orderdate") >= F.lit(f"{prior}-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit(f"{current + 1}-01-01").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_custkey", "o_orderdate")
    c = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # nation (25 rows) and region (5 rows) are fixed-size dimension tables
    n = F.broadcast(t("nation").select("n_nationkey", "n_name", "n_regionkey"))
    r = F.broadcast(t("region").select("r_regionkey", "r_name"))
    p = t("part").select("p_partkey", "p_brand", "p_type")
    j = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
    )
    ext = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    net = (ext * (F.lit(1) - disc)).cast(MONEY_TYPE)
    gross = ext.cast(MONEY_TYPE)
    new_plan = (ext * (F.lit(1) - disc * F.lit(0.5).cast("decimal(2,1)"))).cast(MONEY_TYPE)
    zero = F.lit(0).cast(MONEY_TYPE)
    yr = F.year("o_orderdate")
    sem = fiscal_week(F.col("o_orderdate"))
    cur = yr == current
    return j.select(
        F.col("r_name").alias("agrupa1"),
        F.col("n_name").alias("division"),
        F.col("c_mktsegment").alias("territorio"),
        F.concat(F.lit("Zona "), (F.col("c_custkey") % 7).cast("string")).alias("zona"),
        F.concat(F.lit("Region "), (F.col("c_custkey") % 21).cast("string")).alias("region"),
        F.col("c_name").alias("pdc"),
        F.col("p_brand").alias("grupo"),
        F.col("p_type").alias("cuenta"),
        F.concat_ws("/", "p_brand", "p_type").alias("account_id"),
        F.col("c_custkey").alias("centre"),
        F.col("l_linenumber").alias("line"),
        yr.alias("yr"),
        sem.alias("sem"),
        F.when(yr == prior, net).otherwise(zero).alias("real_py"),
        F.when(cur, gross).otherwise(zero).alias("plan"),
        F.when(cur, new_plan).otherwise(zero).alias("new_plan"),
        F.when(cur & (sem <= smr), net).otherwise(zero).alias("real"),
    )


def forecast_by_account_id(spark: SparkSession, sf_dir: str, fact: DataFrame | None = None) -> DataFrame:
    """V3: (account_id, sem, forecast) = current-year plan x 1.02 per account and week."""
    f = (facts(spark, sf_dir) if fact is None else fact).filter(F.col("yr") == CURRENT_YEAR)
    return f.groupBy("account_id", "sem").agg(
        (F.sum("plan") * F.lit(1.02).cast("decimal(3,2)")).cast("decimal(20,7)").alias("forecast")
    )


def forecast_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grupo, cuenta, sem, real, forecast) for the forecast tab."""
    f = facts(spark, sf_dir).filter(F.col("yr") == CURRENT_YEAR)
    return f.groupBy("grupo", "cuenta", "sem").agg(
        F.sum("real").alias("real"),
        (F.sum("plan") * F.lit(1.02).cast("decimal(3,2)")).cast("decimal(20,7)").alias("forecast"),
    )


def account_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account catalog with duplicate keys: one row per part of size <= 40 (the
    'official' parts), key = brand/type padded with spaces as in raw extracts."""
    p = table(spark, sf_dir, "part").filter(F.col("p_size") <= 40)
    return p.select(
        F.concat(F.lit(" "), F.concat_ws("/", "p_brand", "p_type"), F.lit(" ")).alias("account_raw"),
        F.col("p_brand").alias("grupo"),
        F.col("p_type").alias("cuenta"),
        F.col("p_partkey").alias("pos"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """V4: weekly extracts of actuals and plan, each a whole-year copy.

    Actuals: snapshot 30 = all lines (weeks <= 30), 29 = lines 1..5 (weeks <= 29),
    28 = lines 1..3 (weeks <= 28). Plan: 30 = all lines, 29 = lines 1..5 (no plan
    extract exists for 28). Account ids arrive untrimmed.
    """
    f = stored(facts(spark, sf_dir).filter(F.col("yr") == CURRENT_YEAR), "current-facts")  # five extracts are cut from it
    acc = F.concat(F.lit(" "), F.col("account_id"), F.lit(" ")).alias("account_raw")
    real_parts, plan_parts = [], []
    for snap, max_line in ((30, None), (29, 5), (28, 3)):
        sub = f if max_line is None else f.filter(F.col("line") <= max_line)
        real_parts.append(
            sub.filter(F.col("sem") <= snap).select(F.lit(snap).alias("snapshot"), "sem", acc, F.col("real").alias("amount"))
        )
        if snap != 28:
            plan_parts.append(sub.select(F.lit(snap).alias("snapshot"), "sem", acc, F.col("plan").alias("amount")))
    real = real_parts[0].unionByName(real_parts[1]).unionByName(real_parts[2])
    plan = plan_parts[0].unionByName(plan_parts[1])
    return real, plan


def facts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: the long fact (unpivot of V1), monto DECIMAL."""
    from spendgrid.operators.longfact import to_long

    ids = ["division", "territorio", "pdc", "grupo", "cuenta", "centre", "sem"]
    return to_long(facts(spark, sf_dir), ids)


def _merchant(key: str):
    """A two-word merchant name from a nation key, its digits as letters (12 -> ``Casa Mbc``)."""
    return F.concat(F.lit("Casa M"), F.translate(F.col(key).cast("string"), "0123456789", "abcdefghij"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as questions; id = conv-turn. Askers are customers, dealt
    by conversation. Three of four conversations open their turns with a phrase of a support
    ticket: a refund asked of a merchant, an order to postpone, or a merchant's charge."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("conversations").filter(F.col("role") == "user")
    users = t("customer").select(F.max("c_custkey")).scalar()
    n = t("nation").select(F.col("n_nationkey").alias("_n"), _merchant("n_nationkey").alias("m"))
    kind = F.col("conv_id") % 4
    c = c.join(n, F.col("conv_id") % 25 == F.col("_n"))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("u"), (F.col("conv_id") % users + 1).cast("string")).alias("user_id"),
        F.concat(
            F.when(kind == 1, F.concat(F.lit("Where is my refund from "), F.col("m"), F.lit("? ")))
            .when(kind == 2, F.lit("Can you postpone my order? "))
            .when(kind == 3, F.concat(F.lit("Today "), F.col("m"), F.lit(" charged me. ")))
            .otherwise(F.lit("")),
            F.col("text"),
        ).alias("question"),
    )


def finance_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as finance questions: seven of eight conversations ask about a nation, segment,
    cost centre (customer), brand, weekly series or match, with and without a week phrase."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("conversations").filter(F.col("role") == "user")
    centres, parts = t("customer").select(F.max("c_custkey")).scalar(), t("part").select(F.max("p_partkey")).scalar()
    c = c.withColumn("k", F.col("conv_id") % 8).withColumn("_c", F.lit(100) + F.col("conv_id") % (centres - 99))
    c = c.withColumn("_p", F.lit(1) + F.col("conv_id") % parts)
    c = c.join(t("nation").select(F.col("n_nationkey").alias("_n"), "n_name"), F.col("conv_id") % 25 == F.col("_n"))
    c = c.join(t("customer").select(F.col("c_custkey").alias("_c"), "c_mktsegment"), "_c")
    c = c.join(t("part").select(F.col("p_partkey").alias("_p"), "p_brand"), "_p")
    s = lambda e: e.cast("string")
    q = (
        F.when(F.col("k") == 0, F.concat(F.lit("¿Cuánto gastó la división "), "n_name", F.lit(" hasta la semana "), s(F.col("conv_id") % 53 + 1)))
        .when(F.col("k") == 1, F.concat(F.lit("Gasto del territorio "), "c_mktsegment", F.lit(" en la semana "), s(F.col("conv_id") % 60 + 1)))
        .when(F.col("k") == 2, F.concat(F.lit("Detalle del ceco "), s(F.col("_c")), F.lit(" acumulado a la semana 20")))
        .when(F.col("k") == 3, F.concat(F.lit("Evolución semanal de "), "n_name"))
        .when(F.col("k") == 4, F.lit("Match de centros sin punto"))
        .when(F.col("k") == 5, F.concat(F.lit("Total del grupo "), "p_brand"))
        .when(F.col("k") == 6, F.concat(F.lit("Por semana del centro "), s(F.col("_c")), F.lit(" "), "p_brand"))
        .otherwise(F.col("text"))
    )
    return c.select(F.concat_ws("-", s(F.col("conv_id")), s(F.col("turn"))).alias("id"), q.alias("question"))


def corpus(spark: SparkSession, sf_dir: str, marker: str = "# ") -> DataFrame:
    """V6: documents with ``marker`` injected on every 7th line (no document line starts
    with ``#`` or ``def``, so chunk boundaries are placed by rule)."""
    from spendgrid.operators.chunking import inject_headings

    return inject_headings(table(spark, sf_dir, "documents").select("doc_id", "text"), marker, 7)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: benchmark passages as queries (qid, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: weekly average order value per order priority: (date, asset, price)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.date_trunc("week", "o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("asset")
    ).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("price"))


def candidate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate portfolios: each customer's mix of order priorities (portfolio, asset, w)."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("portfolio"), F.col("o_orderpriority").alias("asset")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return o.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("portfolio"))).drop("n")


def order_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity to execute per order priority: (asset, Q)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.groupBy(F.col("o_orderpriority").alias("asset")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("Q")
    )


def bids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """auctions = brands, agents = parts, bid = retail price (DECIMAL); the
    quantity on offer in each auction is half its total bid."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("auction"), F.col("p_partkey").alias("agent"), F.col("p_retailprice").cast("decimal(18,2)").alias("bid")
    )
    totals = p.groupBy("auction").agg((F.sum("bid") * F.lit(0.5).cast("decimal(2,1)")).alias("total"))
    return p, totals


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation graph: an edge joins a customer's and a supplier's nation whenever a
    line item links them (distinct, no self loops, i < j)."""
    t = lambda n: table(spark, sf_dir, n)
    j = (
        t("lineitem").select("l_orderkey", "l_suppkey")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return (
        j.filter(F.col("c_nationkey") != F.col("s_nationkey"))
        .select(F.least("c_nationkey", "s_nationkey").alias("i"), F.greatest("c_nationkey", "s_nationkey").alias("j"))
        .distinct()
    )


def _lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order and the merchant (its supplier's nation) of the line."""
    t = lambda n: table(spark, sf_dir, n)
    sup = t("supplier").select("s_suppkey", _merchant("s_nationkey").alias("line_merchant"))
    li = t("lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    return li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))


_ORDER_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'payment_failed' END"
_INSTALLMENT_STATUS = "CASE WHEN o_orderstatus = 'O' THEN 'upcoming' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'paid' END"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 flat: (user_id, order_id, pos, merchant, status, total) of every order with lines;
    ``pos`` is the order's place in its user's document, the merchant that of its first line."""
    g = _lines_of_orders(spark, sf_dir).groupBy("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").agg(
        F.min_by("line_merchant", F.struct("l_linenumber", "l_suppkey")).alias("merchant")
    )
    return g.select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("order_id"), F.col("o_orderkey").alias("pos"),
        "merchant", F.expr(_ORDER_STATUS).alias("status"), F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
    )


def installments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 flat: an order's line items as its installments: amount = extended price, due date =
    ship date, status = upcoming for open orders, else failed for returned lines, else paid."""
    x = _lines_of_orders(spark, sf_dir)
    return x.select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.col("l_linenumber").alias("installment"), F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
        F.col("l_shipdate").cast("date").alias("due_date"), F.expr(_INSTALLMENT_STATUS).alias("status"),
    )


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: one order document per customer (users + orders with nested installments), for the
    document reader S4. A user's orders stand in order of their key, installments by number."""
    is_r = F.col("l_returnflag") == "R"
    inst = F.struct(
        F.col("l_linenumber").alias("installment"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
        F.col("l_shipdate").cast("date").alias("due_date"),
        F.expr(_INSTALLMENT_STATUS).alias("status"),
        F.when(F.expr(_INSTALLMENT_STATUS) == "paid", F.col("l_shipdate").cast("date")).alias("paid_date"),
    )
    keys = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"]
    per_order = _lines_of_orders(spark, sf_dir).groupBy(*keys).agg(
        F.array_sort(F.collect_list(inst)).alias("installments"),
        F.min_by("line_merchant", F.struct("l_linenumber", "l_suppkey")).alias("merchant"),
        F.sum(is_r.cast("int")).alias("n_r"),
        F.sum(F.when(is_r, F.col("l_extendedprice").cast("decimal(12,2)"))).alias("r_amount"),
        F.max(F.when(is_r, F.col("l_shipdate").cast("date"))).alias("r_date"),
    )
    order = F.struct(
        F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("merchant"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
        F.col("o_orderpriority").alias("plan"),
        F.expr(_ORDER_STATUS).alias("status"),
        F.col("n_r").cast("int").alias("reschedules_used"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("n_r") > 0),
               F.struct(F.col("r_amount").alias("amount"), F.col("r_date").alias("issued_date"), F.lit("issued").alias("status"))).alias("refund"),
        F.col("installments"),
    )
    placed = F.struct(F.col("o_orderkey").alias("key"), order.alias("order"))
    per_user = per_order.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["order"]).alias("orders"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    u = per_user.join(c, F.col("o_custkey") == F.col("c_custkey"))
    user = F.struct(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("account_status"), F.create_map().cast("map<string,int>").alias("reschedules_used"),
    )
    return u.select(F.lit(42).alias("generated_seed"), F.lit("1998-08-02").cast("date").alias("today"),
                    F.array(user).alias("users"), F.col("orders"))


def labeled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7 golden: labelled documents as cases. Expected route: escalate when toxic, policy
    otherwise; must_include: a common word of the document's language; must_not_include:
    a password mention or an SSN-like number."""
    lab = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    j = lab.join(d, "doc_id")
    word = F.when(F.col("lang") == "fr", "le").when(F.col("lang") == "de", "der").when(F.col("lang") == "es", "el").otherwise("the")
    return j.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("toxic") == 1, "escalate").otherwise("policy").alias("expected_route"),
        F.array(F.concat(F.lit("(^|[^a-z])"), word, F.lit("([^a-z]|$)"))).alias("must_include"),
        F.array(F.lit("password"), F.lit("[0-9]{3}-[0-9]{2}-[0-9]{4}")).alias("must_not_include"),
        F.col("text"),
    )


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: orders with their customer and line aggregates; label = fully shipped ('F'),
    amount = order total."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        (F.sum(F.col("l_discount").cast("decimal(4,2)")).cast("double") / F.count(F.lit(1))).alias("avg_disc"),
        F.sum((F.col("l_extendedprice").cast("decimal(18,2)") * (1 + F.col("l_tax").cast("decimal(4,2)"))
               * (1 - F.col("l_discount").cast("decimal(4,2)")))).cast("double").alias("line_total"),
    )
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").alias("id"), "o_orderpriority", "c_mktsegment", "c_acctbal", F.col("n_lines").cast("double").alias("n_lines"),
        "sum_qty", "avg_disc", F.month("o_orderdate").cast("double").alias("month"), "line_total",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("amount"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a causal panel: y = extended price, t = discount, x = quantity,
    fold = order key mod 5."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_extendedprice").cast("decimal(18,2)").cast("double").alias("y"),
        F.col("l_discount").cast("decimal(4,2)").cast("double").alias("t"),
        F.col("l_quantity").cast("decimal(18,2)").cast("double").alias("x"),
        F.col("l_tax").cast("double").alias("x2"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
    )


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V14, second binding: customers as points (id, vec): account balance in thousands, order value in millions."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    spent = F.coalesce(F.col("t"), F.lit(0)).cast("double") / 1e6
    return c.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, spent).alias("vec"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as points (id, vec); vectors that are null stay out."""
    e = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
