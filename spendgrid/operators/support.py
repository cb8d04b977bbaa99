"""Support-ticket jobs: order documents, scoped lookups, routing, guardrails and golden-set
scoring (S4, S5, J7, J8, J9, O7, E1-E8, F13, F14).

Everything is a DataFrame column expression or join; answers produced elsewhere enter
as a table. Hint phrases meet the questions in an equi-join, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendgrid.functions.matching import containing
from spendgrid.functions.text import WS, first_term, sentences, strip_ws
from spendgrid.functions.windows import prefix_sum

INSTALLMENT = T.StructType(
    [
        T.StructField("installment", T.IntegerType()),
        T.StructField("amount", T.DecimalType(12, 2)),
        T.StructField("due_date", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("paid_date", T.DateType()),
    ]
)
REFUND = T.StructType(
    [T.StructField("amount", T.DecimalType(12, 2)), T.StructField("issued_date", T.DateType()), T.StructField("status", T.StringType())]
)
ORDER = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("total", T.DecimalType(12, 2)),
        T.StructField("plan", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reschedules_used", T.IntegerType()),
        T.StructField("refund", REFUND),
        T.StructField("installments", T.ArrayType(INSTALLMENT)),
    ]
)
USER = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("account_status", T.StringType()),
        T.StructField("reschedules_used", T.MapType(T.StringType(), T.IntegerType())),
    ]
)
ORDER_DOC = T.StructType(
    [
        T.StructField("generated_seed", T.IntegerType()),
        T.StructField("today", T.DateType()),
        T.StructField("users", T.ArrayType(USER)),
        T.StructField("orders", T.ArrayType(ORDER)),
    ]
)


def read_order_docs(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested order documents with a declared schema -> users, orders (nested
    installments kept; ``pos`` is the place in the document) and flattened installments. ``multiline=True`` reads one pretty-
    printed document per file; the default reads one document per line (splittable)."""
    docs = spark.read.schema(ORDER_DOC).json(path, multiLine=multiline)
    users = docs.select(F.explode("users").alias("u")).select("u.*")
    orders = docs.select(F.posexplode("orders").alias("pos", "o")).select("pos", "o.*")
    inst = orders.select("user_id", "order_id", "merchant", F.col("status").alias("order_status"),
                         F.explode("installments").alias("i")).select("user_id", "order_id", "merchant", "order_status", "i.*")
    return users, orders, inst


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """JSON-lines files keyed by ``key``; blank lines skipped; when a key repeats,
    the last line wins (files in name order, then line order).

    Lines are read in splits, so a large file is shared by many tasks. A line's place is its
    file, the start of the split it was read in, and its row number inside that split's task.
    The dedup is one ``max_by`` aggregate on that place.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    lines = spark.read.text(path).select(place.alias("place"), "value").filter(strip_ws(F.col("value")) != "")
    parsed = lines.select("place", F.from_json("value", schema).alias("r"))
    last = parsed.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", "place").alias("r"))
    return last.select("r.*")


def pending(cases: DataFrame, done: DataFrame, n: int, key: str = "id", pos: str = "pos") -> DataFrame:
    """Cases whose id is not in the output yet, the first ``n`` in input order."""
    return cases.join(done.select(key), key, "left_anti").orderBy(pos).limit(n)


NOT_FOUND = "not found"


def lookup_order(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """Scoped lookup on (user, order); a wrong owner and an unknown order give the
    same 'not found' row (left join on *both* keys)."""
    o = orders.select("user_id", "order_id", "merchant", "status", "total")
    j = requests.join(o, ["user_id", "order_id"], "left")
    return j.withColumn("result", F.when(F.col("status").isNull(), F.lit(NOT_FOUND)).otherwise(F.lit("found")))


# A capitalised multi-word merchant name (word edges = non-letters).
MERCHANT_RE = r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s*&?\s*[A-Z][a-z]+)+)(?:[^\p{L}\p{N}_]|$)"


def merchant_guess(text: Column) -> Column:
    g = F.regexp_extract(text, MERCHANT_RE, 1)
    return F.when(g != "", F.lower(strip_ws(g)))


def match_merchant(questions: DataFrame, orders: DataFrame) -> DataFrame:
    """The question's guessed merchant vs the user's own orders' merchants: a match when
    either contains the other; the first order of the user's document (``pos``) wins.

    A user's distinct merchants are compared, not all orders: their first orders come from a
    partial aggregate, so a user with very many orders is one row per merchant in the join."""
    q = questions.select("id", "user_id", merchant_guess(F.col("question")).alias("guess")).filter(F.col("guess").isNotNull())
    o = orders.select("user_id", "order_id", "pos", F.lower("merchant").alias("m")).filter(F.col("m") != "")
    o = o.groupBy("user_id", "m").agg(F.min(F.struct("pos", "order_id")).alias("o"))
    j = q.join(o, "user_id").filter((F.instr("guess", F.col("m")) > 0) | (F.instr("m", F.col("guess")) > 0))
    return j.groupBy("id").agg(F.min("o")["order_id"].alias("order_id"))


def next_payment(inst: DataFrame, by=("user_id",)) -> DataFrame:
    """The soonest installment with status upcoming or failed, per user (or per user
    and order); ties by order id then installment number."""
    open_ = inst.filter(F.col("status").isin("upcoming", "failed"))
    best = F.min_by(F.struct("order_id", "installment", "amount", "due_date", "status"), F.struct("due_date", "order_id", "installment"))
    return open_.groupBy(*by).agg(best.alias("n")).select(*by, "n.*")


# --- E-family -------------------------------------------------------------------------
ROUTES = ["policy", "tool", "both", "escalate"]


def score_answers(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """Missing answer fails; route must equal; every must_include regex found and no
    must_not_include regex found (both case-insensitive); reasons listed in order."""
    j = golden.join(answers.select("id", "route", "answer"), "id", "left")
    ans = F.coalesce(F.col("answer"), F.lit(""))
    inc_miss = F.filter("must_include", lambda p: ~F.regexp_like(ans, F.concat(F.lit("(?i)"), p)))
    exc_hit = F.filter("must_not_include", lambda p: F.regexp_like(ans, F.concat(F.lit("(?i)"), p)))
    reasons = F.when(F.col("route").isNull() & F.col("answer").isNull(), F.array(F.lit("missing answer"))).otherwise(
        F.concat(
            # a missing route is a wrong one
            F.when(~F.col("route").eqNullSafe(F.col("expected_route")), F.array(F.concat(F.lit("route "), F.coalesce("route", F.lit("")))))
            .otherwise(F.array().cast("array<string>")),
            F.transform(inc_miss, lambda p: F.concat(F.lit("missing "), p)),
            F.transform(exc_hit, lambda p: F.concat(F.lit("forbidden "), p)),
        )
    )
    return j.select("id", "expected_route", "route", reasons.alias("reasons")).withColumn("passed", F.size("reasons") == 0)


def pass_rates(scored: DataFrame) -> DataFrame:
    """Pass count and rate per expected route (all four routes shown) plus overall."""
    spark = scored.sparkSession
    routes = spark.createDataFrame([(r, i) for i, r in enumerate(ROUTES)], "expected_route string, ord int")
    g = scored.groupBy("expected_route").agg(
        F.sum(F.col("passed").cast("int")).alias("passed"), F.count(F.lit(1)).alias("total")
    )
    per = routes.join(g, "expected_route", "left").fillna(0, ["passed", "total"])
    allr = scored.agg(F.sum(F.col("passed").cast("int")).alias("passed"), F.count(F.lit(1)).alias("total")).select(
        F.lit("all").alias("expected_route"), F.lit(-1).alias("ord"), "passed", "total"
    )
    out = per.unionByName(allr)
    return out.select(
        "expected_route", F.col("passed").cast("bigint").alias("passed"), F.col("total").cast("bigint").alias("total"),
        F.round(F.when(F.col("total") > 0, F.col("passed") / F.col("total") * 100).otherwise(0.0), 4).alias("pct"),
    )


def compare_runs(scored: DataFrame) -> DataFrame:
    """Pass matrix case x run with regressions (pass -> fail) and fixes (fail ->
    pass) between consecutive runs of each case."""
    w = Window.partitionBy("id").orderBy("run")
    prev = F.lag("passed").over(w)
    return scored.select(
        "id", "run", "passed",
        F.coalesce(prev & ~F.col("passed"), F.lit(False)).alias("regression"),
        F.coalesce(~prev & F.col("passed"), F.lit(False)).alias("fix"),
    )


def classify_tickets(questions: DataFrame, hints: DataFrame) -> DataFrame:
    """Ordered categories; inside a category the longest hint first; the first hit
    gives (category, phrase, extra required words). ``hints(category, cat_order, hint,
    extra)``, matched as substrings by one automaton pass over each text, whatever the number of hints."""
    q = questions.select("id", F.lower("question").alias("q"))
    h = hints.select("category", "cat_order", F.lower("hint").alias("hint"), "extra")
    hit = containing(q, "id", "q", h, "hint")
    key = F.struct("cat_order", (-F.length("hint")).alias("neg_len"), "hint")
    best = hit.groupBy("id").agg(F.min_by(F.struct("category", "hint", "extra"), key).alias("b"))
    out = questions.select("id").join(best, "id", "left")
    return out.select(
        "id", (F.col("b").isNotNull()).alias("forced_escalate"), F.col("b.category").alias("category"),
        F.col("b.hint").alias("matched_phrase"), F.coalesce(F.col("b.extra"), F.array().cast("array<string>")).alias("extra_required"),
    )


# Topic words that mark an order-specific question.
ORDER_TOPIC_WORDS = ["refund", "return", "reschedule", "push back", "postpone", "missed", "failed payment",
                     "where is my money", "where's my money"]


def needs_order_lookup(question: Column) -> Column:
    """E5: a topic word and (``my order`` or a capitalised multi-word name)."""
    q = F.lower(question)
    topic = F.lit(False)
    for w in ORDER_TOPIC_WORDS:
        topic = topic | q.contains(w)
    return topic & (q.contains("my order") | (F.regexp_extract(question, MERCHANT_RE, 1) != ""))


ORDER_TOOLS = ["get_orders", "get_order", "get_next_payment"]


def infer_route(tool_log: DataFrame) -> DataFrame:
    """Route from the set of tools used: escalate > policy+order = both > policy >
    order = tool > nothing = policy."""
    s = tool_log.groupBy("id").agg(F.collect_set("tool").alias("tools"))
    has_p = F.array_contains("tools", "search_policy")
    has_o = F.arrays_overlap("tools", F.array(*[F.lit(t) for t in ORDER_TOOLS]))
    route = (
        F.when(F.array_contains("tools", "escalate"), "escalate")
        .when(has_p & has_o, "both").when(has_p, "policy").when(has_o, "tool").otherwise("policy")
    )
    return s.select("id", route.alias("route"))


# Phrases that count as an escalation, and the appended texts.
UNIVERSAL_ESCALATE_PHRASES = ["escalat", "human agent", "human specialist", "human team", "transfer", "connect you"]
ESCALATION_SENTENCE = "I'm escalating this to a human agent who can help further."
SECURITY_SENTENCE = "For your security, please change your password and enable 2FA right away."
SUPPRESS_QUOTING = ["hardship", "fraud", "limit", "fee_waiver"]


def _append(ans: Column, clause: Column) -> Column:
    a = F.regexp_replace(ans, f"{WS}+$", "")
    sep = F.when((a != "") & ~a.rlike(r"[.!?]$"), F.lit(".")).otherwise(F.lit(""))
    return F.concat(a, sep, F.lit(" "), clause)


def guard_answers(answers: DataFrame, decisions: DataFrame, policy_hits: DataFrame, due_dates: DataFrame) -> DataFrame:
    """Guardrail pass over model answers (all column expressions after joins).

    1. a forced escalation sets the route; escalated answers get the escalation sentence
       when no universal phrase is present, then the missing extra words (the security
       sentence when password/2FA is missing);
    2. outside hardship/fraud/limit/fee_waiver, up to two policy sentences are quoted whose term is
       absent from the answer as it stands then (``policy_hits(id, rank, doc, text)``);
    3. true due dates (``due_dates(id, due_date)``) absent in both ISO and ``Month D``
       form are appended.
    """
    from spendgrid.functions.text import date_present, date_text

    a = answers.join(decisions, "id", "left")
    route = F.when(F.coalesce(F.col("forced_escalate"), F.lit(False)), F.lit("escalate")).otherwise(F.col("route"))
    a = a.withColumn("route", route)
    low = F.lower("answer")
    has_universal = F.lit(False)
    for p in UNIVERSAL_ESCALATE_PHRASES:
        has_universal = has_universal | low.contains(p)
    esc = F.col("route") == "escalate"
    ans = F.when(esc & ~has_universal, _append(F.col("answer"), F.lit(ESCALATION_SENTENCE))).otherwise(F.col("answer"))
    a = a.withColumn("answer", ans)
    extra = F.coalesce(F.col("extra_required"), F.array().cast("array<string>"))
    missing = F.filter(extra, lambda p: ~F.lower("answer").contains(p))
    sec = F.arrays_overlap(missing, F.array(F.lit("password"), F.lit("2fa")))
    add = F.when(sec, F.lit(SECURITY_SENTENCE)).otherwise(F.concat(F.lit("("), F.array_join(missing, "; "), F.lit(")")))
    a = a.withColumn("answer", F.when(esc & F.col("forced_escalate") & (F.size(missing) > 0), _append(F.col("answer"), add)).otherwise(F.col("answer")))
    # 2. policy quotes in (chunk rank, sentence) order; a term that the answer or the quote before
    # shows already is not quoted again
    s = policy_hits.select("id", "rank", "doc", F.posexplode(sentences(F.col("text"))).alias("spos", "sent"))
    s = s.withColumn("term", first_term(F.col("sent"))).filter(F.col("term").isNotNull())
    # a question's candidates: the sentences with a term of its few hits
    s = s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "spos", "doc", "sent", "term"))).alias("cand"))
    a = a.join(s, "id", "left")
    quote = lambda x: F.concat(F.lit("Per "), x["doc"], F.lit(': "'), x["sent"], F.lit('"'))
    none = F.array().cast("array<string>")
    may_quote = F.col("category").isNull() | ~F.col("category").isin(SUPPRESS_QUOTING)
    start = F.struct(F.lower("answer").alias("shown"), none.alias("quotes"))

    def quoted(acc, x):
        new = (F.size(acc["quotes"]) < 2) & ~acc["shown"].contains(F.lower(x["term"]))
        shown = F.concat(acc["shown"], F.lit(" "), F.lower(quote(x)))
        return F.when(new, F.struct(shown.alias("shown"), F.concat(acc["quotes"], F.array(quote(x))).alias("quotes"))).otherwise(acc)

    quotes = F.when(may_quote & F.col("cand").isNotNull(), F.aggregate("cand", start, quoted)["quotes"]).otherwise(none)
    a = a.withColumn("quotes", quotes)
    a = a.withColumn("answer", F.when(F.size("quotes") > 0, _append(F.col("answer"), F.array_join("quotes", ". "))).otherwise(F.col("answer")))
    # 3. due dates
    d = due_dates.join(a.select("id", "answer"), "id").filter(~date_present(F.col("answer"), F.col("due_date")))
    d = d.groupBy("id").agg(F.array_sort(F.collect_set("due_date")).alias("ds"))
    d = d.select("id", F.array_join(F.transform("ds", lambda x: F.concat(
        F.lit("(Actual due date on file: "), F.date_format(x, "yyyy-MM-dd"), F.lit(", "), date_text(x), F.lit(".)"))), " ").alias("dd"))
    a = a.join(d, "id", "left").withColumn(
        "answer", F.when(F.col("dd").isNotNull(), _append(F.col("answer"), F.col("dd"))).otherwise(F.col("answer"))
    )
    return a.select("id", "route", "answer")


def run_batch(cases: DataFrame, answers: DataFrame, out: str, chunk: int | None = None) -> DataFrame:
    """Attach answer columns to the pending cases (J7 against what ``out`` already
    holds) and append them as JSON lines; rerunning resumes where it stopped."""
    spark = cases.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    written = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    done = spark.read.schema("id string").json(out) if written else spark.createDataFrame([], "id string")
    todo = cases.join(done, "id", "left_anti")
    if chunk is not None:
        todo = todo.orderBy("pos").limit(chunk)
    rows = todo.join(answers, "id").select("id", "route", "answer")
    rows.write.mode("append").json(out)
    return spark.read.schema("id string, route string, answer string").json(out)


# --- F13 / F14 ------------------------------------------------------------------------
NOTE_RE = (
    r"^[0-9]+\.\s*(.+?)\s+(\(?[0-9.,]+\s*mdp\)?)\s*/\s*(\(?[0-9.,]+%\)?)\s*(?:·\s*(.*))?$"
)
PIPE_RE = r"^(.+?)\s*\|\s*(-?[0-9.,]+)\s*\|\s*(-?[0-9.,]+%)\s*(?:\|\s*(.*))?$"
HEADER_RE = r"^[—-]+\s*(.+?)\s*[—-]+$"
NO_SECTION = "(sin sección)"


def parse_notes(lines: DataFrame) -> DataFrame:
    """``lines(list_id, pos, text)``. Section headers ``— title —`` open a section
    (running last header per list); notes before any header go to ``(sin sección)``.
    A note ``N. account (amount mdp) / (pct%) · comment`` or ``account | amount | pct% |
    comment`` is split; any other text is the account with empty fields."""
    t = strip_ws(F.col("text"))
    hdr = F.regexp_extract(t, HEADER_RE, 1)
    x = lines.withColumn("_t", t).withColumn("_hdr", F.when(hdr != "", strip_ws(hdr)))
    # the last header at or before a note: headers number sections (a running count, split over
    # tasks however long a list is), notes take the header of their number
    x = x.withColumn("_one", F.col("_hdr").isNotNull().cast("bigint"))
    x = prefix_sum(x, ["list_id"], [F.col("pos")], "_one", "_section")
    heads = x.filter(F.col("_hdr").isNotNull()).select(F.col("list_id").alias("_l"), F.col("_section").alias("_s"), F.col("_hdr").alias("section"))
    x = x.join(heads, F.col("list_id").eqNullSafe(F.col("_l")) & (F.col("_section") == F.col("_s")), "left")
    x = x.withColumn("section", F.coalesce("section", F.lit(NO_SECTION)))
    x = x.filter(F.col("_hdr").isNull())
    m1 = F.col("_t").rlike(NOTE_RE)
    m2 = F.col("_t").rlike(PIPE_RE)
    g = lambda rx, i: F.regexp_extract("_t", rx, i)
    return x.select(
        "list_id", "pos", "section",
        F.when(m1, strip_ws(g(NOTE_RE, 1))).when(m2, strip_ws(g(PIPE_RE, 1))).otherwise(F.col("_t")).alias("account"),
        F.when(m1, F.regexp_replace(g(NOTE_RE, 2), " ", "")).when(m2, g(PIPE_RE, 2)).otherwise(F.lit("")).alias("amount"),
        F.when(m1, g(NOTE_RE, 3)).when(m2, g(PIPE_RE, 3)).otherwise(F.lit("")).alias("pct"),
        F.when(m1, strip_ws(g(NOTE_RE, 4))).when(m2, strip_ws(g(PIPE_RE, 4))).otherwise(F.lit("")).alias("comment"),
    )


def policy_terms(chunks: DataFrame) -> DataFrame:
    """per chunk, the first sentence holding a policy term and the term."""
    s = chunks.select("doc_id", "start_line", F.posexplode(sentences(F.col("content"))).alias("spos", "sent"))
    s = s.withColumn("term", first_term(F.col("sent"))).filter(F.col("term").isNotNull())
    return s.groupBy("doc_id", "start_line").agg(F.min_by(F.struct("spos", "sent", "term"), "spos").alias("f")).select(
        "doc_id", "start_line", F.col("f.sent").alias("sentence"), F.col("f.term").alias("term")
    )
