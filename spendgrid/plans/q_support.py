"""Registered support-ticket queries and their twins (S4, S5, J7-J9, O7, E1-E8, F13-F15,
X1)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.functions import text as TX
from spendgrid.operators import chunking as CH
from spendgrid.operators import questions as QN
from spendgrid.operators import support as SP
from spendgrid.plans import bindings as B
from spendgrid.plans import sqltext as S
from spendgrid.session import scratch_path, stored
from spendgrid.plans.registry import register

# --- order documents -----------------------------------------------------------------------------
MERCHANT_SQL = """(SELECT l2.l_orderkey, arg_min('Casa M' || translate(CAST(s.s_nationkey AS VARCHAR), '0123456789', 'abcdefghij'),
    (l2.l_linenumber, l2.l_suppkey)) AS merchant FROM lineitem l2 JOIN supplier s ON l2.l_suppkey = s.s_suppkey GROUP BY l2.l_orderkey)"""
INST_SQL = f"""inst AS (
  SELECT 'u' || CAST(o.o_custkey AS VARCHAR) AS user_id, 'ord_' || CAST(o.o_orderkey AS VARCHAR) AS order_id,
    m.merchant, CASE WHEN o.o_orderstatus = 'O' THEN 'active' WHEN o.o_orderstatus = 'F' THEN 'completed' ELSE 'payment_failed' END AS order_status,
    l.l_linenumber AS installment, CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS amount,
    CAST(l.l_shipdate AS DATE) AS due_date,
    CASE WHEN o.o_orderstatus = 'O' THEN 'upcoming' WHEN l.l_returnflag = 'R' THEN 'failed' ELSE 'paid' END AS status,
    CASE WHEN o.o_orderstatus <> 'O' AND l.l_returnflag <> 'R' THEN CAST(l.l_shipdate AS DATE) END AS paid_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN {MERCHANT_SQL} m ON m.l_orderkey = o.o_orderkey
  JOIN supplier s2 ON l.l_suppkey = s2.s_suppkey)"""


def _docs_dir(spark, sf_dir):
    path = scratch_path(spark, "order-docs")
    B.order_docs(spark, sf_dir).write.mode("overwrite").json(path)
    return path


@register("s04_read_order_docs", f"WITH {INST_SQL} SELECT * FROM inst")
def s04(spark, sf_dir):
    _, _, inst = SP.read_order_docs(spark, _docs_dir(spark, sf_dir))
    return inst.withColumn("amount", F.col("amount").cast("double"))


@register(
    "o07_next_payment",
    f"""WITH {INST_SQL}
SELECT user_id, n.order_id, n.installment, CAST(n.amount AS DOUBLE) AS amount, n.due_date, n.status FROM (
  SELECT user_id, arg_min({{'order_id': order_id, 'installment': installment, 'amount': amount, 'due_date': due_date, 'status': status}},
                          (due_date, order_id, installment)) AS n
  FROM inst WHERE status IN ('upcoming', 'failed') GROUP BY user_id)""",
)
def o07(spark, sf_dir):
    n = SP.next_payment(B.installments(spark, sf_dir))
    return n.select("user_id", "order_id", "installment", F.col("amount").cast("double").alias("amount"), "due_date", "status")


REQ_SQL = """req AS (
  SELECT 'u' || CAST(o_custkey AS VARCHAR) AS user_id, 'ord_' || CAST(o_orderkey AS VARCHAR) AS order_id FROM orders
  UNION ALL SELECT 'u' || CAST(o_custkey + 1 AS VARCHAR), 'ord_' || CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'u' || CAST(o_custkey AS VARCHAR), 'ord_' || CAST(o_orderkey + 1000000000 AS VARCHAR) FROM orders)"""


def _requests(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    u = lambda k: F.concat(F.lit("u"), k.cast("string")).alias("user_id")
    oid = lambda k: F.concat(F.lit("ord_"), k.cast("string")).alias("order_id")
    return (
        o.select(u(F.col("o_custkey")), oid(F.col("o_orderkey")))
        .unionAll(o.select(u(F.col("o_custkey") + 1), oid(F.col("o_orderkey"))))
        .unionAll(o.select(u(F.col("o_custkey")), oid(F.col("o_orderkey") + 1000000000)))
    )


@register(
    "j08_lookup_order",
    f"""WITH {REQ_SQL}
SELECT req.user_id, req.order_id, CASE WHEN o.o_orderkey IS NULL THEN 'not found' ELSE 'found' END AS result
FROM req LEFT JOIN (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) o
  ON req.user_id = 'u' || CAST(o.o_custkey AS VARCHAR) AND req.order_id = 'ord_' || CAST(o.o_orderkey AS VARCHAR)""",
)
def j08(spark, sf_dir):
    return SP.lookup_order(_requests(spark, sf_dir), B.orders(spark, sf_dir)).select("user_id", "order_id", "result")


TICKETS = """tk AS (SELECT CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR) AS id,
  'u' || CAST(c.conv_id % (SELECT max(c_custkey) FROM customer) + 1 AS VARCHAR) AS user_id,
  CASE c.conv_id % 4 WHEN 1 THEN 'Where is my refund from ' || m.m || '? ' WHEN 2 THEN 'Can you postpone my order? '
    WHEN 3 THEN 'Today ' || m.m || ' charged me. ' ELSE '' END || c.text AS question, c.conv_id, c.turn
  FROM conversations c JOIN (SELECT n_nationkey, 'Casa M' || translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'abcdefghij') AS m FROM nation) m ON c.conv_id % 25 = m.n_nationkey WHERE c.role = 'user')"""
GUESS_SQL = f"""guessed AS (SELECT id, user_id, lower(regexp_replace(regexp_extract(question, '{SP.MERCHANT_RE}', 1), '^{TX.WS}+|{TX.WS}+$', '', 'g')) AS guess
      FROM tk WHERE regexp_extract(question, '{SP.MERCHANT_RE}', 1) <> ''),
om AS (SELECT 'u' || CAST(o.o_custkey AS VARCHAR) AS user_id, 'ord_' || CAST(o.o_orderkey AS VARCHAR) AS order_id, o.o_orderkey AS pos,
         lower(m.merchant) AS m FROM orders o JOIN {MERCHANT_SQL} m ON m.l_orderkey = o.o_orderkey),
j9 AS (SELECT gs.id, arg_min(om.order_id, om.pos) AS order_id FROM guessed gs JOIN om ON gs.user_id = om.user_id
  WHERE om.m <> '' AND (instr(gs.guess, om.m) > 0 OR instr(om.m, gs.guess) > 0) GROUP BY gs.id)"""


@register("j09_match_merchant", f"WITH {TICKETS}, {GUESS_SQL} SELECT id, order_id FROM j9")
def j09(spark, sf_dir):
    return SP.match_merchant(B.tickets(spark, sf_dir), B.orders(spark, sf_dir))


# --- hint table derived from the questions: word pairs in at least HINT_SHARE of them ---------------
HINT_SHARE = 0.02  # so there are at most 50 times the mean number of pairs in a question
HINTS_SQL = f"""w AS (SELECT id, regexp_extract_all(lower(question), '{TX.WORD_RUN}') AS ws FROM tk),
bg AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] AS hint FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM w)),
rk AS (SELECT hint, length(hint) % 4 AS c FROM bg GROUP BY hint HAVING COUNT(*) >= {HINT_SHARE} * (SELECT COUNT(*) FROM tk)),
hints AS (SELECT 'cat' || CAST(c AS VARCHAR) AS category, CAST(c AS INTEGER) AS cat_order, hint,
            CASE WHEN c = 0 THEN ['password', '2fa'] ELSE []::VARCHAR[] END AS extra FROM rk)"""


def _hints(spark, sf_dir):
    t = B.tickets(spark, sf_dir)
    w = t.select("id", F.regexp_extract_all(F.lower("question"), F.lit(TX.WORD_RUN), 0).alias("ws")).filter(F.size("ws") > 1)
    bg = w.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.concat(
        F.element_at("ws", i), F.lit(" "), F.element_at("ws", i + 1))))).alias("hint"))
    rk = bg.groupBy("hint").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HINT_SHARE * t.select(F.count(F.lit(1))).scalar())
    c = (F.length("hint") % 4).cast("int")
    return rk.select(
        F.concat(F.lit("cat"), c.cast("string")).alias("category"), c.alias("cat_order"), "hint",
        F.when(c == 0, F.array(F.lit("password"), F.lit("2fa"))).otherwise(F.array().cast("array<string>")).alias("extra"),
    )


E4_SQL = f"""{TICKETS}, {HINTS_SQL},
hit AS (SELECT tk.id, arg_min({{'category': category, 'hint': hints.hint, 'extra': extra}}, (cat_order, -length(hints.hint), hints.hint)) AS b
        FROM tk JOIN hints ON instr(lower(tk.question), hints.hint) > 0 GROUP BY tk.id),
e4 AS (SELECT tk.id, hit.b IS NOT NULL AS forced_escalate, hit.b.category AS category, hit.b.hint AS matched_phrase,
         coalesce(hit.b.extra, []::VARCHAR[]) AS extra_required FROM tk LEFT JOIN hit ON tk.id = hit.id)"""


@register("e04_classify_tickets", f"WITH {E4_SQL} SELECT * FROM e4")
def e04(spark, sf_dir):
    return SP.classify_tickets(B.tickets(spark, sf_dir), _hints(spark, sf_dir))


_TOPIC = " OR ".join(f"contains(lower(question), '{w}')" for w in SP.ORDER_TOPIC_WORDS).replace("where's", "where''s")
E5_SQL = f"(({_TOPIC}) AND (contains(lower(question), 'my order') OR regexp_extract(question, '{SP.MERCHANT_RE}', 1) <> ''))"


@register("e05_needs_order_lookup", f"WITH {TICKETS} SELECT id, {E5_SQL} AS needs_lookup FROM tk")
def e05(spark, sf_dir):
    t = B.tickets(spark, sf_dir)
    return t.select("id", SP.needs_order_lookup(F.col("question")).alias("needs_lookup"))


TOOLS_SQL = f"""{E4_SQL},
tools AS (SELECT id, 'search_policy' AS tool FROM tk
          UNION ALL SELECT id, 'get_order' FROM tk WHERE {E5_SQL}
          UNION ALL SELECT id, 'escalate' FROM e4 WHERE forced_escalate)"""


def _tool_log(spark, sf_dir):
    t = B.tickets(spark, sf_dir)
    e4 = SP.classify_tickets(t, _hints(spark, sf_dir))
    return (
        t.select("id", F.lit("search_policy").alias("tool"))
        .unionByName(t.filter(SP.needs_order_lookup(F.col("question"))).select("id", F.lit("get_order").alias("tool")))
        .unionByName(e4.filter("forced_escalate").select("id", F.lit("escalate").alias("tool")))
    )


@register(
    "e06_infer_route",
    f"""WITH {TOOLS_SQL}
SELECT id, CASE WHEN bool_or(tool = 'escalate') THEN 'escalate'
  WHEN bool_or(tool = 'search_policy') AND bool_or(tool IN ('get_orders', 'get_order', 'get_next_payment')) THEN 'both'
  WHEN bool_or(tool = 'search_policy') THEN 'policy' WHEN bool_or(tool IN ('get_orders', 'get_order', 'get_next_payment')) THEN 'tool'
  ELSE 'policy' END AS route FROM tools GROUP BY id""",
)
def e06(spark, sf_dir):
    return SP.infer_route(_tool_log(spark, sf_dir))


# --- golden-set scoring over labelled documents ------------------------------------------------------
GOLD_SQL = f"""gold AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS id, CASE WHEN l.toxic = 1 THEN 'escalate' ELSE 'policy' END AS expected_route,
    ['(^|[^a-z])' || CASE WHEN d.lang = 'fr' THEN 'le' WHEN d.lang = 'de' THEN 'der' WHEN d.lang = 'es' THEN 'el' ELSE 'the' END || '([^a-z]|$)'] AS must_include,
    ['password', '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'] AS must_not_include, d.text
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
ans AS (SELECT id, 1 AS run, 'policy' AS route, text AS answer FROM gold
        UNION ALL SELECT id, 2, CASE WHEN regexp_matches(lower(text), '(secret|password|token)') THEN 'escalate' ELSE 'policy' END,
               translate(text, '{TX._F6_SRC}', '{TX._F6_DST}') FROM gold),
sc AS (SELECT g.id, a.run, g.expected_route, a.route,
  CASE WHEN a.route IS NULL AND a.answer IS NULL THEN ['missing answer'] ELSE list_concat(
    CASE WHEN a.route IS DISTINCT FROM g.expected_route THEN ['route ' || coalesce(a.route, '')] ELSE []::VARCHAR[] END,
    list_transform(list_filter(g.must_include, lambda p: NOT regexp_matches(coalesce(a.answer, ''), p, 'i')), lambda p: 'missing ' || p),
    list_transform(list_filter(g.must_not_include, lambda p: regexp_matches(coalesce(a.answer, ''), p, 'i')), lambda p: 'forbidden ' || p))
  END AS reasons FROM gold g LEFT JOIN ans a ON g.id = a.id)"""


def _answers(spark, sf_dir, run):
    g = B.labeled_cases(spark, sf_dir)
    if run == 1:
        return g.select("id", F.lit("policy").alias("route"), F.col("text").alias("answer"))
    esc = F.lower("text").rlike("(secret|password|token)")
    return g.select("id", F.when(esc, "escalate").otherwise("policy").alias("route"), TX.normalize_ascii(F.col("text")).alias("answer"))


def _scored(spark, sf_dir):
    g = B.labeled_cases(spark, sf_dir)
    parts = [SP.score_answers(g, _answers(spark, sf_dir, r)).withColumn("run", F.lit(r)) for r in (1, 2)]
    return parts[0].unionByName(parts[1])


@register(
    "e01_score_answers",
    f"WITH {GOLD_SQL} SELECT id, run, expected_route, route, reasons, len(reasons) = 0 AS passed FROM sc",
)
def e01(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "run", "expected_route", "route", "reasons", "passed")


@register(
    "e02_pass_rates",
    f"""WITH {GOLD_SQL},
s1 AS (SELECT *, len(reasons) = 0 AS passed FROM sc WHERE run = 1),
r AS (SELECT * FROM (VALUES ('policy'), ('tool'), ('both'), ('escalate')) v(expected_route)),
g AS (SELECT expected_route, SUM(CAST(passed AS INTEGER)) AS passed, COUNT(*) AS total FROM s1 GROUP BY expected_route),
u AS (SELECT r.expected_route, coalesce(g.passed, 0) AS passed, coalesce(g.total, 0) AS total FROM r LEFT JOIN g ON r.expected_route = g.expected_route
      UNION ALL SELECT 'all', SUM(CAST(passed AS INTEGER)), COUNT(*) FROM s1)
SELECT expected_route, CAST(passed AS BIGINT) AS passed, CAST(total AS BIGINT) AS total,
  round(CASE WHEN total > 0 THEN passed / total * 100 ELSE 0.0 END, 4) AS pct FROM u""",
)
def e02(spark, sf_dir):
    s = _scored(spark, sf_dir).filter(F.col("run") == 1)
    return SP.pass_rates(s)


@register(
    "e03_compare_runs",
    f"""WITH {GOLD_SQL}, s AS (SELECT id, run, len(reasons) = 0 AS passed FROM sc),
l AS (SELECT *, lag(passed) OVER (PARTITION BY id ORDER BY run) AS prev FROM s)
SELECT id, run, passed, coalesce(prev AND NOT passed, false) AS regression, coalesce(NOT prev AND passed, false) AS fix FROM l""",
)
def e03(spark, sf_dir):
    return SP.compare_runs(_scored(spark, sf_dir).select("id", "run", "passed"))


@register(
    "e08_run_batch",
    f"""WITH {GOLD_SQL} SELECT id, 'policy' AS route, text AS answer FROM gold""",
)
def e08(spark, sf_dir):
    g = B.labeled_cases(spark, sf_dir)
    cases = g.select("id", F.col("id").cast("bigint").alias("pos"))
    out = scratch_path(spark, "answers")
    ans = _answers(spark, sf_dir, 1)
    SP.run_batch(cases, ans, out, chunk=None)
    return SP.run_batch(cases, ans, out, chunk=None)  # resumed: nothing left to add


# --- S5 / J7 over case files written as JSON lines ---------------------------------------------------
CASE_SCHEMA = "id string, user_id string, question string"


def _case_files(spark, sf_dir):
    """Tickets as JSON lines in several files; every ticket of an odd conversation is
    written again in a later file with its text normalised (the later line wins)."""
    t = B.tickets(spark, sf_dir).withColumn("conv", F.split("id", "-")[0].cast("bigint"))
    path = scratch_path(spark, "case-files")
    t.select("id", "user_id", "question").repartition(3, "id").write.mode("overwrite").json(os.path.join(path, "a"))
    again = t.filter(F.col("conv") % 2 == 1).select(
        "id", "user_id", TX.normalize_ascii(F.concat("question", F.lit(" [resent]"))).alias("question"))
    again.repartition(2, "id").write.mode("overwrite").json(os.path.join(path, "b"))
    return path


@register(
    "s05_read_jsonl",
    f"""WITH {TICKETS}
SELECT id, user_id, CASE WHEN conv_id % 2 = 1 THEN translate(question || ' [resent]', '{TX._F6_SRC}', '{TX._F6_DST}') ELSE question END AS question FROM tk""",
)
def s05(spark, sf_dir):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "user_id", "question")])
    return SP.read_jsonl(spark, _case_files(spark, sf_dir) + "/*/*.json", schema)


@register(
    "j07_pending",
    f"""WITH {GOLD_SQL}
SELECT g.id, CAST(g.id AS BIGINT) AS pos FROM gold g JOIN labels l ON g.id = CAST(l.doc_id AS VARCHAR)
WHERE l.quality = 0 ORDER BY pos LIMIT 50""",
)
def j07(spark, sf_dir):
    g = B.labeled_cases(spark, sf_dir)
    lab = B.table(spark, sf_dir, "labels")
    cases = g.select("id", F.col("id").cast("bigint").alias("pos"))
    done = lab.filter(F.col("quality") == 1).select(F.col("doc_id").cast("string").alias("id"))
    return SP.pending(cases, done, 50)


# --- F13-F15 ---------------------------------------------------------------------------------------
def _f14_sql():
    from spendgrid.plans.q_text import T2_SQL, _chunks_cte
    from spendgrid.plans.sqltext import strip

    ws = TX.WS
    sents = f"list_filter(list_transform(string_split(regexp_replace(content, '([.!?]){ws}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"
    m = f"regexp_extract(sent, '{TX.TERM_RE}', 0)"
    return f"""WITH {_chunks_cte(T2_SQL, 'ch')},
f14s AS (SELECT doc_id, start_line, unnest(sl) AS sent, generate_subscripts(sl, 1) AS spos FROM (SELECT doc_id, start_line, {sents} AS sl FROM ch)),
f14t AS (SELECT *, CASE WHEN {m} <> '' THEN regexp_replace({m}, '^[^a-z0-9A-Z]+|[^a-z0-9A-Z%]+$', '', 'g') END AS term FROM f14s)
SELECT doc_id, start_line, arg_min(sent, spos) AS sentence, arg_min(term, spos) AS term FROM f14t WHERE term IS NOT NULL
GROUP BY doc_id, start_line"""


@register("f14_policy_terms", _f14_sql)
def f14(spark, sf_dir):
    ch = CH.chunk_h2(B.corpus(spark, sf_dir, "## "))
    return SP.policy_terms(ch)


@register(
    "f15_date_forms",
    f"""WITH {INST_SQL}, t AS (
  SELECT order_id, installment, due_date, strftime(due_date, '%B') || ' ' || CAST(day(due_date) AS VARCHAR) AS due_text,
    CASE installment % 4 WHEN 0 THEN strftime(due_date, '%Y-%m-%d') WHEN 1 THEN upper(strftime(due_date, '%B') || ' ' || CAST(day(due_date) AS VARCHAR))
      WHEN 2 THEN strftime(due_date + 40, '%Y-%m-%d') ELSE strftime(due_date, '%d/%m/%Y') END AS said FROM inst)
SELECT order_id, installment, due_text, contains('Due on ' || said, strftime(due_date, '%Y-%m-%d'))
  OR contains(lower('Due on ' || said), lower(due_text)) AS present FROM t""",
)
def f15(spark, sf_dir):
    i = B.installments(spark, sf_dir)
    kind, due = F.col("installment") % 4, F.col("due_date")
    said = (
        F.when(kind == 0, F.date_format(due, "yyyy-MM-dd")).when(kind == 1, F.upper(TX.date_text(due)))
        .when(kind == 2, F.date_format(F.date_add(due, 40), "yyyy-MM-dd")).otherwise(F.date_format(due, "dd/MM/yyyy"))
    )
    i = i.withColumn("text", F.concat(F.lit("Due on "), said))
    return i.select("order_id", "installment", TX.date_text(due).alias("due_text"), TX.date_present(F.col("text"), due).alias("present"))


# --- E7: guardrails over assistant replies ---------------------------------------------------------
def _appended(ans: str, clause: str) -> str:
    """SQL of ``ans`` with a clause appended as a sentence."""
    a = f"regexp_replace({ans}, '{TX.WS}+$', '')"
    return f"({a} || CASE WHEN {a} <> '' AND NOT regexp_matches({a}, '[.!?]$') THEN '.' ELSE '' END || ' ' || {clause})"


def _e07_sql():
    from spendgrid.plans.q_text import bm25_ctes
    from spendgrid.plans.sqltext import strip

    q = lambda x: x.replace("'", "''")
    policy = "(ch.content || '. Refunds take ' || CAST(ch.doc_id % 30 + 1 AS VARCHAR) || ' business days. There is no fee.')"
    universal = " OR ".join(f"contains(lower(answer), '{p}')" for p in SP.UNIVERSAL_ESCALATE_PHRASES)
    sents = f"list_filter(list_transform(string_split(regexp_replace({policy}, '([.!?]){TX.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"
    term = f"regexp_extract(sent, '{TX.TERM_RE}', 0)"
    suppressed = ", ".join(f"'{c}'" for c in SP.SUPPRESS_QUOTING)
    quote = "'Per ' || doc || ': \"' || sent || '\"'"
    when = "strftime(due_date, '%B') || ' ' || CAST(day(due_date) AS VARCHAR)"
    return f"""WITH {E4_SQL}, {INST_SQL}, {bm25_ctes('SELECT id AS qid, question AS text FROM tk')},
due AS (SELECT user_id, arg_min(due_date, (due_date, order_id, installment)) AS due_date
        FROM inst WHERE status IN ('upcoming', 'failed') GROUP BY user_id),
a0 AS (SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS id, a.text AS answer
       FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant'),
a1 AS (SELECT a0.id, coalesce(e4.forced_escalate, false) AS esc, e4.category, coalesce(e4.extra_required, []::VARCHAR[]) AS extra,
         CASE WHEN coalesce(e4.forced_escalate, false) AND NOT ({universal}) THEN {_appended('answer', f"'{q(SP.ESCALATION_SENTENCE)}'")} ELSE answer END AS answer
       FROM a0 LEFT JOIN e4 ON a0.id = e4.id),
a2 AS (SELECT *, list_filter(extra, lambda p: NOT contains(lower(answer), p)) AS missing FROM a1),
a3 AS (SELECT id, esc, category, CASE WHEN esc AND len(missing) > 0 THEN {_appended('answer', f"CASE WHEN list_has_any(missing, ['password', '2fa']) THEN '{q(SP.SECURITY_SENTENCE)}' ELSE '(' || array_to_string(missing, '; ') || ')' END")}
         ELSE answer END AS answer FROM a2),
s0 AS (SELECT hits.qid AS id, hits.rank, CAST(ch.doc_id AS VARCHAR) AS doc, {sents} AS sl
       FROM hits JOIN ch ON hits.doc_id = ch.doc_id AND hits.start_line = ch.start_line),
s1 AS (SELECT id, rank, doc, unnest(sl) AS sent, generate_subscripts(sl, 1) AS spos FROM s0),
cand AS (SELECT s1.id, rank, spos, {quote} AS quote, lower(regexp_replace({term}, '^[^a-z0-9A-Z]+|[^a-z0-9A-Z%]+$', '', 'g')) AS term
         FROM s1 JOIN a3 ON s1.id = a3.id WHERE {term} <> '' AND (a3.category IS NULL OR a3.category NOT IN ({suppressed}))),
q1 AS (SELECT c.id, arg_min({{'r': c.rank, 's': c.spos, 'q': c.quote}}, (c.rank, c.spos)) AS q FROM cand c JOIN a3 ON c.id = a3.id
       WHERE NOT contains(lower(a3.answer), c.term) GROUP BY c.id),
q2 AS (SELECT c.id, arg_min(c.quote, (c.rank, c.spos)) AS q FROM cand c JOIN a3 ON c.id = a3.id JOIN q1 ON c.id = q1.id
       WHERE (c.rank, c.spos) > (q1.q.r, q1.q.s) AND NOT contains(lower(a3.answer) || ' ' || lower(q1.q.q), c.term) GROUP BY c.id),
a4 AS (SELECT a3.id, a3.esc, CASE WHEN q1.q IS NOT NULL THEN {_appended('a3.answer', "(q1.q.q || coalesce('. ' || q2.q, ''))")} ELSE a3.answer END AS answer
       FROM a3 LEFT JOIN q1 ON a3.id = q1.id LEFT JOIN q2 ON a3.id = q2.id),
a5 AS (SELECT a4.*, due.due_date FROM a4 JOIN tk ON a4.id = tk.id LEFT JOIN due ON tk.user_id = due.user_id)
SELECT id, CASE WHEN esc THEN 'escalate' ELSE 'policy' END AS route,
  CASE WHEN due_date IS NOT NULL AND NOT contains(answer, strftime(due_date, '%Y-%m-%d')) AND NOT contains(lower(answer), lower({when}))
    THEN {_appended('answer', f"('(Actual due date on file: ' || strftime(due_date, '%Y-%m-%d') || ', ' || {when} || '.)')")} ELSE answer END AS answer
FROM a5"""


@register("e07_guard_answers", _e07_sql)
def e07(spark, sf_dir):
    from spendgrid.operators import retrieval as RV
    from spendgrid.plans.q_text import corpus_index

    t = B.tickets(spark, sf_dir)
    conv = B.table(spark, sf_dir, "conversations")
    # the model answer to a user turn is the next assistant turn of the conversation
    q = conv.filter(F.col("role") == "user").select("conv_id", "turn")
    a = conv.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    answers = q.join(a, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.lit("policy").alias("route"), "answer",
    )
    decisions = SP.classify_tickets(t, _hints(spark, sf_dir))
    hits = RV.search_bm25(t.select(F.col("id").alias("qid"), F.col("question").alias("text")), corpus_index(spark, sf_dir, "bm25"), 3)
    hits = stored(hits, "hits")  # of known size: the chunks they meet need no shuffle if it is small
    found = stored(hits.select("doc_id").distinct(), "hit-documents")
    ch = CH.chunk_h2(B.corpus(spark, sf_dir, "## ").join(found, "doc_id", "left_semi"))  # others are not cut again
    hits = hits.join(ch.select("doc_id", "start_line", "content"), ["doc_id", "start_line"]).select(
        F.col("qid").alias("id"), "rank", F.col("doc_id").cast("string").alias("doc"),
        # the documents hold no policy terms: two sentences with some stand at the end of each chunk
        F.concat("content", F.lit(". Refunds take "), (F.col("doc_id") % 30 + 1).cast("string"), F.lit(" business days. There is no fee.")).alias("text"))
    nxt = SP.next_payment(B.installments(spark, sf_dir))
    due = t.join(nxt.select("user_id", "due_date"), "user_id").select("id", "due_date")
    return SP.guard_answers(answers, decisions, hits, due)


# --- F13: variation notes written from the division roll-up, then parsed back -----------------------
def _notes(spark, sf_dir):
    from spendgrid.functions.measures import Period
    from spendgrid.operators import rollup as R

    v = R.rollup_variance(B.facts(spark, sf_dir), "division", Period(1, 30), smr=B.SMR)
    w = Window.partitionBy("list_id", "agrupa1").orderBy("division")
    v = v.withColumn("list_id", F.when(F.col("vs_plan_abs") > 0, "riesgos").otherwise("oportunidades"))
    v = v.withColumn("k", F.row_number().over(w))
    amt = F.format_number(F.col("vs_plan_abs") / 1e6, 2)
    pct = F.format_number(F.col("vs_plan_pct"), 1)
    dotted = F.concat(F.col("k").cast("string"), F.lit(". "), F.col("division"), F.lit(" ("), amt, F.lit(" mdp) / ("), pct,
                      F.lit("%) · "), F.col("label_plan"))
    piped = F.concat(F.col("division"), F.lit(" | "), amt, F.lit(" | "), pct, F.lit("% | "), F.col("label_plan"))
    notes = v.select("list_id", "agrupa1", (F.col("k") * 2).alias("pos"),
                     F.when(F.col("k") % 2 == 1, dotted).otherwise(piped).alias("text"))
    heads = v.select("list_id", "agrupa1").distinct().select(
        "list_id", "agrupa1", F.lit(0).alias("pos"), F.concat(F.lit("— "), F.col("agrupa1"), F.lit(" —")).alias("text"))
    lines = notes.unionByName(heads)
    order = F.dense_rank().over(Window.partitionBy("list_id").orderBy("agrupa1", "pos"))
    return lines.select("list_id", order.cast("bigint").alias("pos"), "text")


def _f13_sql():
    from spendgrid.plans.q_joins import _a1_sql
    from spendgrid.plans.sqltext import strip

    def fmt(x, dp):
        return f"format('{{:,.{dp}f}}', {x})"

    note, pipe, head = SP.NOTE_RE, SP.PIPE_RE, SP.HEADER_RE
    t = "t"
    ex = lambda rx, i: f"regexp_extract({t}, '{rx}', {i})"
    return f"""WITH v AS ({_a1_sql('agrupa1, division')}),
n0 AS (SELECT CASE WHEN vs_plan_abs > 0 THEN 'riesgos' ELSE 'oportunidades' END AS list_id, agrupa1, division,
         vs_plan_abs, vs_plan_pct, label_plan FROM v),
n1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY list_id, agrupa1 ORDER BY division) AS k FROM n0),
l0 AS (SELECT list_id, agrupa1, k * 2 AS pos, CASE WHEN k % 2 = 1
          THEN CAST(k AS VARCHAR) || '. ' || division || ' (' || {fmt('vs_plan_abs / 1e6', 2)} || ' mdp) / (' || {fmt('vs_plan_pct', 1)} || '%) · ' || label_plan
          ELSE division || ' | ' || {fmt('vs_plan_abs / 1e6', 2)} || ' | ' || {fmt('vs_plan_pct', 1)} || '% | ' || label_plan END AS text FROM n1
       UNION ALL SELECT DISTINCT list_id, agrupa1, 0, '— ' || agrupa1 || ' —' FROM n0),
l AS (SELECT list_id, dense_rank() OVER (PARTITION BY list_id ORDER BY agrupa1, pos) AS pos, text FROM l0),
x AS (SELECT *, {strip('text')} AS t FROM l),
x2 AS (SELECT *, CASE WHEN regexp_extract(t, '{head}', 1) <> '' THEN {strip(f"regexp_extract(t, '{head}', 1)")} END AS hdr FROM x),
y AS (SELECT *, coalesce(last_value(hdr IGNORE NULLS) OVER (PARTITION BY list_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '(sin sección)') AS section FROM x2)
SELECT list_id, pos, section,
  CASE WHEN regexp_matches(t, '{note}') THEN {strip(ex(note, 1))} WHEN regexp_matches(t, '{pipe}') THEN {strip(ex(pipe, 1))} ELSE t END AS account,
  CASE WHEN regexp_matches(t, '{note}') THEN replace({ex(note, 2)}, ' ', '') WHEN regexp_matches(t, '{pipe}') THEN {ex(pipe, 2)} ELSE '' END AS amount,
  CASE WHEN regexp_matches(t, '{note}') THEN {ex(note, 3)} WHEN regexp_matches(t, '{pipe}') THEN {ex(pipe, 3)} ELSE '' END AS pct,
  CASE WHEN regexp_matches(t, '{note}') THEN {strip(ex(note, 4))} WHEN regexp_matches(t, '{pipe}') THEN {strip(ex(pipe, 4))} ELSE '' END AS comment
FROM y WHERE hdr IS NULL"""


@register("f13_parse_notes", _f13_sql)
def f13(spark, sf_dir):
    return SP.parse_notes(_notes(spark, sf_dir))


# --- X1: the same scoring as an incremental stream over case files --------------------------------
def _x01_sql():
    from spendgrid.plans.q_text import bm25_ctes

    return f"""WITH {E4_SQL}, {GUESS_SQL}, {INST_SQL}, {bm25_ctes('SELECT id AS qid, question AS text FROM tk')},
due AS (SELECT user_id, arg_min(due_date, (due_date, order_id, installment)) AS next_due
        FROM inst WHERE status IN ('upcoming', 'failed') GROUP BY user_id)
SELECT e4.*, tk.user_id, tk.question, j9.order_id, CASE WHEN j9.order_id IS NOT NULL THEN 'found' END AS order_result, due.next_due,
  CAST(hits.doc_id AS VARCHAR) AS policy_doc
FROM e4 JOIN tk ON e4.id = tk.id LEFT JOIN j9 ON tk.id = j9.id LEFT JOIN due ON tk.user_id = due.user_id
LEFT JOIN hits ON tk.id = hits.qid AND hits.rank = 1"""


@register("x01_stream_cases", _x01_sql)
def x01(spark, sf_dir):
    from spendgrid.operators import retrieval as RV
    from spendgrid.plans.q_text import corpus_index
    from spendgrid.streaming.cases import stream_cases

    t = B.tickets(spark, sf_dir).withColumn("conv", F.split("id", "-")[0].cast("bigint"))
    base = scratch_path(spark, "stream")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    hints, idx = stored(_hints(spark, sf_dir), "hints"), corpus_index(spark, sf_dir, "bm25")
    orders, inst = stored(B.orders(spark, sf_dir), "orders"), stored(B.installments(spark, sf_dir), "installments")

    def search(q):
        return RV.search_bm25(q, idx, 1).select("qid", F.col("doc_id").alias("doc"))

    def run():
        return stream_cases(spark, src + "/*", out, ckpt, hints, orders, inst, search, CASE_SCHEMA)

    cols = ["id", "user_id", "question"]
    # run 1: tickets of even conversations arrive
    t.filter(F.col("conv") % 2 == 0).select(*cols).repartition(3, "id").write.json(f"{src}/part1")
    run()
    # run 2 (a restart): odd conversations arrive, plus re-sent copies of run-1 tickets
    t.filter(F.col("conv") % 2 == 1).select(*cols).repartition(2, "id").write.json(f"{src}/part2")
    resent = t.filter(F.col("conv") % 2 == 0).select("id", "user_id", F.concat("question", F.lit(" [resent]")).alias("question"))
    resent.repartition(2, "id").write.json(f"{src}/part3")
    return run().drop("batch_id")
